"""Books of the Bible in the Douay canon, and scripture references as marked or printed."""

from __future__ import annotations

import re

#: The canon in order; a book's number is its place, from 1.
CANON = (
    "genesis", "exodus", "leviticus", "numbers", "deuteronomy", "josue", "judges", "ruth", "1 kings", "2 kings", "3 kings", "4 kings",
    "1 paralipomenon", "2 paralipomenon", "1 esdras", "2 esdras", "tobias", "judith", "esther", "job", "psalms", "proverbs", "ecclesiastes",
    "canticles", "wisdom", "ecclesiasticus", "isaias", "jeremias", "lamentations", "baruch", "ezechiel", "daniel", "osee", "joel", "amos",
    "abdias", "jonas", "micheas", "nahum", "habacuc", "sophonias", "aggeus", "zacharias", "malachias", "1 machabees", "2 machabees",
    "matthew", "mark", "luke", "john", "acts", "romans", "1 corinthians", "2 corinthians", "galatians", "ephesians", "philippians",
    "colossians", "1 thessalonians", "2 thessalonians", "1 timothy", "2 timothy", "titus", "philemon", "hebrews", "james", "1 peter",
    "2 peter", "1 john", "2 john", "3 john", "jude", "apocalypse",
)
#: OSIS codes by the number of their book.
OSIS = {
    "Gen": 1, "Exod": 2, "Lev": 3, "Num": 4, "Deut": 5, "Josh": 6, "Judg": 7, "Ruth": 8, "1Sam": 9, "2Sam": 10, "1Kgs": 9, "2Kgs": 10,
    "1Kgdms": 9, "2Kgdms": 10, "3Kgdms": 11, "4Kgdms": 12, "1Chr": 13, "2Chr": 14, "Ezra": 15, "Neh": 16, "1Esd": 15, "2Esd": 16, "Tob": 17,
    "Jdt": 18, "Esth": 19, "Job": 20, "Ps": 21, "Prov": 22, "Eccl": 23, "Song": 24, "Wis": 25, "Sir": 26, "Isa": 27, "Jer": 28, "Lam": 29,
    "Bar": 30, "Ezek": 31, "Dan": 32, "Hos": 33, "Joel": 34, "Amos": 35, "Obad": 36, "Jonah": 37, "Mic": 38, "Nah": 39, "Hab": 40,
    "Zeph": 41, "Hag": 42, "Zech": 43, "Mal": 44, "1Macc": 45, "2Macc": 46, "Matt": 47, "Mark": 48, "Luke": 49, "John": 50, "Acts": 51,
    "Rom": 52, "1Cor": 53, "2Cor": 54, "Gal": 55, "Eph": 56, "Phil": 57, "Col": 58, "1Thess": 59, "2Thess": 60, "1Tim": 61, "2Tim": 62,
    "Titus": 63, "Phlm": 64, "Heb": 65, "Jas": 66, "1Pet": 67, "2Pet": 68, "1John": 69, "2John": 70, "3John": 71, "Jude": 72, "Rev": 73,
}
#: Abbreviations as printed, by the name they stand for.
PRINTED = {
    "genesis": "gn gen", "exodus": "ex exod", "leviticus": "lev", "numbers": "num", "deuteronomy": "dt deut", "josue": "jos josh joshua",
    "judges": "judg", "paralipomenon": "paral para", "esdras": "esdr esdra esd", "tobias": "tob", "judith": "jdt", "esther": "esth",
    "psalms": "ps psalm", "proverbs": "prov", "ecclesiastes": "eccles eccl", "canticles": "cant", "wisdom": "wis", "ecclesiasticus": "ecclus",
    "isaias": "is isa isaiah", "jeremias": "jer jeremiah", "lamentations": "lam", "baruch": "bar", "ezechiel": "ezech ezek", "daniel": "dan",
    "osee": "os hos", "abdias": "abd", "jonas": "jon", "micheas": "mich", "habacuc": "hab", "sophonias": "soph", "aggeus": "agg",
    "zacharias": "zach", "malachias": "mal", "machabees": "mach macc", "matthew": "mt mat matt", "mark": "mk", "luke": "lk luc", "john": "jn",
    "romans": "rom", "corinthians": "cor", "galatians": "gal", "ephesians": "eph", "philippians": "phil", "colossians": "col",
    "thessalonians": "thess", "timothy": "tim", "titus": "tit", "philemon": "philem", "hebrews": "heb", "james": "jas", "peter": "pet",
    "apocalypse": "apoc rev",
}
_NAME = {short: name for name, all_ in PRINTED.items() for short in all_.split()}

Passage = tuple[int, int, list[int]]


def book_name(number: int) -> str:
    return CANON[number - 1].title() if 1 <= number <= len(CANON) else ""


def printed_book(printed: str) -> int | None:
    """The number of a book as printed: "3 Kings", "Ecclus.", "1 Cor"."""
    m = re.fullmatch(r"(?:([1-4])\s*)?([a-z]+)\.?", printed.strip().lower())
    if not m:
        return None
    name = _NAME.get(m[2], m[2])
    whole = f"{m[1]} {name}" if m[1] else name
    return CANON.index(whole) + 1 if whole in CANON else None


def _whole(x: str) -> int:
    return int(x) if x.strip().isdecimal() else 0


def marked_passages(marked: str) -> list[Passage]:
    """(book, chapter, verses) of "version|book|chapter|verse|to chapter|to verse" references, ";" between; a range of chapters keeps no verses."""
    out: list[Passage] = []
    for one in marked.split(";"):
        _, code, *rest = [*one.split("|"), "", "", "", "", ""][:6]
        chapter, verse, to_chapter, to_verse = map(_whole, rest)
        book = OSIS.get(code)
        if not book or not chapter:
            continue
        if to_chapter and to_chapter != chapter:
            out += [(book, c, []) for c in range(chapter, max(to_chapter, chapter) + 1)]
        else:
            out.append((book, chapter, list(range(verse, max(to_verse or verse, verse) + 1)) if verse else []))
    return out


def printed_passages(text: str) -> list[Passage]:
    """The passage of "3 Kings 10:4,5"; none if it is no scripture."""
    m = re.match(r"\s*((?:[1-4]\s*)?[A-Za-z]+)\.?\s+(\d+)(?:\s*:\s*([\d\s,-]+))?", text)
    book = printed_book(m[1]) if m else None
    if not book:
        return []
    verses: list[int] = []
    for part in (m[3] or "").split(","):
        low, _, high = part.partition("-")
        if _whole(low):
            verses += range(int(low), max(_whole(high) or int(low), int(low)) + 1)
    return [(book, int(m[2]), verses)]
