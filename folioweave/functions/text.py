"""Text functions: names, titles, markup, numbers. JVM expressions but for Unicode normalisation and Jaro-Winkler."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: White space as browsers and Unicode count it; Java's plain \\s leaves out the no-break kinds.
SPACE = r"[\s\p{Z}\x{FEFF}]"

#: Words after a comma that end a cited title.
TITLE_ENDS = ("ed.", "edition", "chapter", "chap.", "ch.", "vol", "vols", "book", "bk", "part", "pt", "tom", "tome", "lib", "p.", "pp.")
#: Leading articles, and words of names that identify nobody.
ARTICLES = ("a", "an", "the", "le", "la", "les", "l", "der", "die", "das", "il", "lo", "el")
NAME_NOISE = (
    "st", "saint", "rev", "fr", "dr", "prof", "mgr", "card", "cardinal", "bp", "bishop", "pope", "sj", "op", "osb", "ofm", "de", "di", "du",
    "del", "della", "des", "von", "van", "der", "den", "le", "la", "da", "of", "and", "the", "ed", "tr", "trans",
)
#: Authors that name nobody.
NO_AUTHOR = ("anonymous", "bible")
#: Character references of page markup.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&nbsp;": " "}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


@pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F))


@pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")


def squashed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, rf"{SPACE}+", " "))


def fold(s: Column) -> Column:
    """Without accents, lower case, words that a line end broke rejoined."""
    return F.regexp_replace(F.lower(_decomposed(s)), rf"(\p{{L}})[-\x{{AD}}]{SPACE}+(\p{{Ll}})", "$1$2")


def like_pattern(q: str) -> str:
    """A pattern that finds ``q`` itself anywhere."""
    return "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_ignoring_case(c: Column, q: str) -> Column:
    return c.ilike(like_pattern(q))


def guarded_number(s: Column) -> Column:
    """Digits only as a number, else null; as long as they may be."""
    return F.when(s.rlike(r"^[0-9]+\z"), s.try_cast("decimal(38,0)"))


def cited_title(s: Column) -> Column:
    ends = "|".join(x.replace(".", r"\.") for x in TITLE_ENDS)
    return trimmed(F.regexp_replace(s, rf"(?i),{SPACE}*(?:\d+(?:st|nd|rd|th){SPACE}+ed|{ends})(?![a-z]).*\z", ""))


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)`` for which c is made once, however often it is named there: as the only element of a list."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def roman_to_int(s: Column) -> Column:
    """Of letters i, v, x, l, c, d and m: smaller before larger ones count against."""
    values = "map(" + ", ".join(f"'{k}', {v}" for k, v in ROMAN.items()) + ")"
    digits = F.transform(F.split(F.lower(s), ""), lambda c: F.coalesce(F.try_element_at(F.expr(values), c), F.lit(0)))
    later = lambda d: F.concat(F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), F.array(F.lit(0)))
    signed = lambda d: F.zip_with(d, later(d), lambda a, b: F.when(a < b, -a).otherwise(a))
    return _once(digits, lambda d: F.aggregate(signed(d), F.lit(0), lambda n, v: n + v))


def volume_of(s: Column) -> Column:
    found = F.regexp_extract(F.coalesce(s, F.lit("")), r"(?i)\b(?:vols?|volume|tom)\.?[\s\p{Z}]*([ivxlc]+|\d+)\b", 1)
    number = lambda f: F.when(f == "", None).when(f.rlike(r"^\d+\z"), f.try_cast("int")).otherwise(roman_to_int(f))
    return _once(found, number)


_NUMERALS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def to_roman(n: Column) -> Column:
    """The upper-case numeral of a number from 1 on."""
    left, out = n, F.lit("")
    for value, letters in _NUMERALS:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(n >= 1, out)


#: Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with")


def tidy_title(s: Column) -> Column:
    """Without "(EIGHT ARTICLES)"; all capitals become title case."""
    bare = F.trim(F.regexp_replace(s, r"(?i)\s*\((?:[A-Z-]+|\d+) ARTICLES?\)\s*\z", ""))
    pieces = F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}[\p{L}']*|[^\p{L}]+"), F.lit(0))
    cased = F.transform(pieces, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
    return F.when(bare == F.upper(bare), F.array_join(cased, "")).otherwise(bare)


def tokens(s: Column) -> Column:
    """Words of a title or a name, folded."""
    parts = F.split(F.regexp_replace(fold(s), "&", " and "), "[^a-z0-9]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.when(t == "st", F.lit("saint")).otherwise(t))


def drop_article(t: Column) -> Column:
    return F.when((F.size(t) > 1) & F.get(t, F.lit(0)).isin(*ARTICLES), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)


def main_title(s: Column) -> Column:
    """Tokens before a subtitle."""
    cut = rf"(?i)[:;]|{SPACE}[-—]{SPACE}|,?{SPACE}+by{SPACE}+|,{SPACE}*or,?{SPACE}+"
    return tokens(F.get(F.split(cited_title(s), cut, 2), F.lit(0)))


def surnames(author: Column) -> Column:
    return F.filter(tokens(author), lambda t: (F.length(t) > 2) & ~t.isin(*NAME_NOISE) & ~t.rlike(r"^\d+\z"))


def key_names(author: Column) -> Column:
    """The names that have to match: before a comma, all of a double name, else the last."""
    names = surnames(author)
    return (
        F.when(author.contains(","), surnames(F.get(F.split(author, ",", 2), F.lit(0))))
        .when(author.rlike(r"\p{L}-\p{L}"), names)
        .otherwise(F.slice(names, F.greatest(F.size(names), F.lit(1)), F.lit(1)))
    )


def same_author(cited: Column, other: Column) -> Column:
    return F.arrays_overlap(key_names(cited), surnames(other))


def names_an_author(author: Column) -> Column:
    name = F.lower(trimmed(author))
    return (name != "") & ~name.isin(*NO_AUTHOR)


def should_be_skipped(author: Column, title: Column) -> Column:
    """Citations that have nothing to go by, and those of the Bible."""
    return (trimmed(author) == "") | (trimmed(title) == "") | (F.lower(trimmed(author)) == "bible") | (F.length(F.array_join(tokens(title), "")) < 4)


def similarity(a: str, b: str) -> float:
    """Jaro-Winkler: up to four letters of a common prefix add a tenth each, whatever the score."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left, right = [True] * len(b), [], []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == x), None)
        if j is not None:
            free[j] = False
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i in range(4) if i >= min(len(a), len(b)) or a[i] != b[i]), 4)
    return jaro + prefix * 0.1 * (1 - jaro)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _begins(longer: Column, shorter: Column) -> Column:
    """A list before its subtitle: begins it, and is long enough or nearly all of it."""
    fits = (F.size(shorter) >= 3) | (F.size(longer) <= F.size(shorter) + 2)
    return (F.size(shorter) >= 2) & (F.slice(longer, F.lit(1), F.size(shorter)) == shorter) & fits


def title_forms(s: Column) -> Column:
    """What ``same_title`` compares of a title: (words, main), without articles; to be made once for each title."""
    whole = F.when(cited_title(s) != "", cited_title(s)).otherwise(s)
    return F.struct(drop_article(tokens(whole)).alias("words"), drop_article(main_title(whole)).alias("main"))


def same_title(cited: Column, other: Column) -> Column:
    """Whether two titles, as ``title_forms``, name one work; the similarity is asked only where no rule decides."""
    c, o, cm, om = cited["words"], other["words"], cited["main"], other["main"]
    spots = F.sequence(F.lit(1), F.greatest(F.size(om) - F.size(c) + 1, F.lit(1)))
    inside = F.exists(spots, lambda i: F.slice(om, i, F.greatest(F.size(c), F.lit(0))) == c)
    ruled = (
        (c == o)
        | _begins(o, c)
        | _begins(c, om)
        | ((F.size(cm) >= 1) & (cm == om) & ((F.size(cm) >= 2) | (F.size(c) == F.size(cm))))
        | ((F.size(c) >= 3) & (F.size(om) >= F.size(c)) & inside & (F.size(c) >= 0.6 * F.size(om)))
    )
    left, right = F.array_join(c, " "), F.array_join(o, " ")
    close = F.coalesce(jaro_winkler(F.when(~ruled & (F.length(left) >= 12), left), right) >= 0.93, F.lit(False))
    return (F.size(c) > 0) & (F.size(o) > 0) & (ruled | close)


#: Letters and digits from rare to common; any order does, this one tells most apart by the first few.
_RARE = "zqjxkvwyfbghpm0123456789cdulrsontaie "
#: So many of each character have a bit of their own; the rest are only counted.
_EACH = 5
_LIKE = 0.93
#: By the characters that two texts begin with in common (3 standing for three or more): what m/a + m/b of their lengths and common characters has to be for ``_LIKE``.
_NEEDED = {n: 3 * (_LIKE - 0.1 * most) / (1 - 0.1 * most) - 1 - 1e-9 for n, most in ((0, 0), (1, 1), (2, 2), (3, 4))}
_LIKENESS = StructType([StructField("n", IntegerType()), StructField("bits", ArrayType(LongType())), StructField("more", IntegerType()), StructField("keys", ArrayType(StringType()))])


def _likeness(s: str) -> tuple[int, list[int], int, list[str]]:
    seen: dict[str, int] = {}
    bits, more, all_ = 0, 0, []
    for c in s:
        seen[c] = nth = seen.get(c, 0) + 1
        code = _RARE.find(c)
        all_.append((code if code >= 0 else -1, c, nth))
        if code < 0 or nth > _EACH:
            more += 1
        else:
            bits |= 1 << (code * _EACH + nth - 1)
    all_.sort()
    keys = [f"3:{s[:3]}"] if len(s) > 2 else []
    for begin in range(min(3, len(s) + 1)):
        least = math.ceil((_NEEDED[begin] - 1) * len(s))
        keys += [f"{begin}:{s[:begin]}:{c}{nth}" for _, c, nth in all_[: len(s) - least + 1]]
    return len(s), [(bits >> (62 * i)) & ((1 << 62) - 1) for i in range(3)], more, keys


@pandas_udf(_LIKENESS)
def likeness(s: pd.Series) -> pd.DataFrame:
    """Of each text its length, its characters as bits, the number of those without a bit, and keys: texts as near as ``_LIKE`` share a key.

    The nearer their beginnings, the fewer characters two texts need in common. Of m common ones of n, one is
    among the first n - m + 1 in any order of all; m is at least what ``_NEEDED`` asks of a text's own length.
    """
    return pd.DataFrame([_likeness(x or "") for x in s], columns=["n", "bits", "more", "keys"])


def may_be_similar(key: Column, a: Column, b: Column) -> Column:
    """Whether two ``likeness`` rows that share a key can be as near as ``_LIKE``: bits in common bound their common characters."""
    common = F.least(a["more"], b["more"])
    for i in range(3):
        common = common + F.bit_count(F.get(a["bits"], F.lit(i)).bitwiseAND(F.get(b["bits"], F.lit(i))))
    needed = F.lit(None)
    for n, least in _NEEDED.items():
        needed = F.coalesce(needed, F.when(F.substring(key, 1, 2) == f"{n}:", F.lit(least)))
    return common / a["n"] + common / b["n"] >= needed


def title_keys(forms: Column, cited: bool) -> Column:
    """What a title (``title_forms``) is found by, but for likeness: titles that the rules of ``same_title`` take for one share a key.

    A cited title is looked for as a whole among beginnings and runs of words of others, and by its beginnings among their main titles.
    """
    words, main = forms["words"], forms["main"]
    keys = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(f"{kind} "), F.array_join(x, " ")))
    upto = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda n: F.slice(c, F.lit(1), n))
    if cited:
        return F.array_distinct(F.concat(keys("words", F.array(words)), keys("main", F.array(main)), keys("begins", upto(words))))
    n = F.size(main)
    # runs of at least three words and six tenths of the main title
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda z: (z >= 3) & (z >= 0.6 * n))
    inner = F.flatten(F.transform(sizes, lambda z: F.transform(F.sequence(F.lit(1), n - z + 1), lambda i: F.slice(main, i, z))))
    return F.array_distinct(F.concat(keys("words", F.concat(upto(words), inner)), keys("main", F.array(main)), keys("begins", F.array(main))))


def decoded(html: Column) -> Column:
    """Character references in one pass, so that none is read twice."""
    pieces = F.split(html, r"(?=&(?:amp|lt|gt|quot|nbsp|#x27|#39);)|(?<=&(?:amp|lt|gt|quot|nbsp|#x27|#39);)")
    known = "map(" + ", ".join("'{}', '{}'".format(k, v.replace("'", "\\'")) for k, v in ENTITIES.items()) + ")"
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.expr(known), p), p)), "")


def stripped(html: Column) -> Column:
    """Markup to text: line breaks are blanks, other tags nothing."""
    return decoded(F.regexp_replace(F.regexp_replace(html, rf"(?i)<br{SPACE}*/?>", " "), "<[^>]+>", ""))


def normal(s: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def block_text(html: Column) -> Column:
    """A block's paragraphs, a line each."""
    lines = F.split(decoded(F.regexp_replace(F.regexp_replace(html, rf"(?i)<br{SPACE}*/?>|</(?:p|li|tr|h[1-6])>", "\n"), "<[^>]+>", "")), "\n")
    return F.array_join(F.filter(F.transform(lines, squashed), lambda x: x != ""), "\n")


def page_text(blocks: Column) -> Column:
    """Ordered blocks (label, html) as text, running heads and feet left out."""
    body = F.filter(blocks, lambda b: ~b["label"].isin("PageHeader", "PageFooter"))
    return F.array_join(F.filter(F.transform(body, lambda b: block_text(b["html"])), lambda t: t != ""), "\n\n")


def keyword_key(s: Column) -> Column:
    return squashed(F.lower(_compatible(s)))


def insight_key(s: Column) -> Column:
    """What two insights share that differ in case, spacing, quotes or closing punctuation only."""
    x = F.regexp_replace(F.regexp_replace(F.lower(_compatible(s)), "[‘’`]", "'"), "[“”]", '"')
    return trimmed(F.regexp_replace(F.regexp_replace(x, rf"{SPACE}+", " "), rf"[\s\p{{Z}}.;:,!]+\z", ""))


def keyword_pattern(keyword: Column) -> Column:
    """A pattern for the keyword as whole words; spacing after inner dots is free. Null for one of under three letters."""
    key = F.regexp_replace(keyword_key(keyword), r"\. ", ".")
    safe = F.regexp_replace(key, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    free = F.regexp_replace(F.regexp_replace(safe, r"\\\.(?!\z)", r"\\.\\s*"), " ", r"\\s+")
    return F.when(F.length(key) >= 3, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), free, F.lit(r"(?![\p{L}\p{N}])")))


def has_keyword(text: Column, keyword: Column) -> Column:
    return F.coalesce(F.rlike(keyword_key(text), keyword_pattern(keyword)), F.lit(False))


def runs(values: Column, dash: str = "-") -> Column:
    """Numbers with consecutive ones drawn together: "4-5", "3, 23, 28"."""
    step = F.aggregate(
        values,
        F.expr("cast(array() as array<struct<a: int, b: int>>)"),
        lambda done, v: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] == v - 1),
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["a"].alias("a"), v.cast("int").alias("b")))),
        ).otherwise(F.concat(done, F.array(F.struct(v.cast("int").alias("a"), v.cast("int").alias("b"))))),
    )
    return F.array_join(F.transform(step, lambda r: F.when(r["a"] < r["b"], F.concat(r["a"].cast("string"), F.lit(dash), r["b"].cast("string"))).otherwise(r["a"].cast("string"))), ", ")


def file_name(url: Column) -> Column:
    """The last part of the URL's path."""
    return F.regexp_extract(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"([^/]*)\z", 1)


def folder_name(url: Column) -> Column:
    """The file name without ".pdf", other dots as underscores: the id of a scanned book."""
    return F.regexp_replace(F.regexp_replace(file_name(url), r"(?i)\.pdf\z", ""), r"\.", "_")


def cutoff_year(today: Column | None = None) -> Column:
    """Works of that year or before are in the public domain in the US."""
    return F.year(F.current_date() if today is None else today) - 96


def is_summa(title: Column, author: Column) -> Column:
    return trimmed(F.regexp_replace(title, rf"-{SPACE}+", "")).rlike(r"(?i)^summa[\s\p{Z}]+theol(?:ogica|ogiae)?\.?\z") & author.rlike("(?i)thomas|aquinas")


def is_ibid(raw: Column) -> Column:
    return raw.rlike(r"(?i)^\W*ibid\b")


#: The parts of the Summa by their short labels, as (type, value) lists.
SUMMA_PARTS = {
    "I": (("book", 1),), "I-II": (("book", 2),), "II-II": (("book", 3),), "III": (("book", 4),), "Suppl.": (("book", 5),),
    "Suppl. App. 1": (("book", 5), ("appendix", 1)), "Suppl. App. 2": (("book", 5), ("appendix", 2)),
}


def summa_parts(label: Column) -> Column:
    """A page label of the Summa ("I-II q. 3 a. 2") as a place; null for other labels."""
    form = r"^(.+?)(?: prol\.| q\. (\d+)(?: a\. (\d+))?)\z"
    part = lambda t, v: f"named_struct('type', '{t}', 'value', {v})"
    known = "map(" + ", ".join(f"'{k}', array({', '.join(part(t, v) for t, v in ps)})" for k, ps in SUMMA_PARTS.items()) + ")"
    book = F.try_element_at(F.expr(known), F.regexp_extract(label, form, 1))
    more = [
        F.when(F.regexp_extract(label, form, i) != "", F.array(F.struct(F.lit(t).alias("type"), F.regexp_extract(label, form, i).try_cast("int").alias("value")))).otherwise(F.expr("cast(array() as array<struct<type: string, value: int>>)"))
        for i, t in ((2, "question"), (3, "article"))
    ]
    return F.concat(book, *more)
