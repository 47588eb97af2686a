"""License scans by template-markup matching.

A template is a license text with two kinds of markup: ``<<optional>> ... <<end>>`` may be left out, and
``<<any n>>`` stands for up to n words of the writer's own, ``<<version n>>`` for one to n numbers. It is compiled to an automaton over tokens whose
edges are words, optional regions (edges without a word) and bounded gaps. A text is accepted where a path
reads its words without a break: mandatory wording has to match exactly, markup may vary. Wording right after a word that denies
it ("not licensed under ...") is not taken.

Phrases are templates of plain words; they give the base labels. Defined results: null and empty texts have
no words, no labels and score 0; repeated rows are scanned each; very long texts are scanned whole, from the words that open a template; columns other than key and text are
ignored; an empty table gives an empty one. Words are those of ``text.plain_words``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_batches, plain_words

#: The phrases of the base labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_VERSION = "<<optional>> <<optional>> v <<end>> <<optional>> version <<end>> <<version 2>> <<end>>"
_COPYRIGHT = "<<optional>> copyright <<any 20>> <<end>>"
_NO_WARRANTY = (
    "<<optional>> and <<any 6>> <<end>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<any 8>> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
    "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any 1>> redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer <<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
#: Published licenses and notices with markup, by label; the score is that of a text with the wording. Licenses are whole,
#: with their disclaimers; of the long ones it is the notice that their authors prescribe for files.
TEMPLATES = (
    (
        "mit",
        1.0,
        f"<<optional>> the <<end>> <<optional>> mit license <<optional>> mit <<end>> <<end>> {_COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        1.0,
        f"<<optional>> isc license <<end>> {_COPYRIGHT} permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<any 4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("bsd", 1.0, f"{_BSD} this software is provided by <<any 8>> {_NO_WARRANTY}"),
    ("bsd", 1.0, f"{_BSD} <<any 1>> neither the name of <<any 12>> may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<any 8>> {_NO_WARRANTY}"),
    (
        "unlicense",
        1.0,
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib",
        1.0,
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "<<any 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<any 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<any 1>> this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache",
        1.0,
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 <<optional>> txt <<end>> <<optional>> html <<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        1.0,
        "is free software you can redistribute it and or modify it under the terms of the gnu <<optional>> lesser <<end>> <<optional>> affero <<end>> general public license as published by the free software foundation either version <<version 2>> of the license or at your option any later version <<optional>> <<any 6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<optional>> lesser <<end>> <<optional>> affero <<end>> general public license for more details <<end>>",
    ),
    ("mpl", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http <<optional>> s <<end>> <<optional>> www <<end>> mozilla org mpl 2 0"),
    ("mit", 0.9, "spdx license identifier mit"),
    ("isc", 0.9, "spdx license identifier isc"),
    ("bsd", 0.9, "spdx license identifier bsd <<version 1>> clause"),
    ("unlicense", 0.9, "spdx license identifier unlicense"),
    ("zlib", 0.9, "spdx license identifier zlib"),
    ("apache", 0.9, "spdx license identifier apache <<version 2>>"),
    ("gpl", 0.9, "spdx license identifier <<optional>> l <<end>> gpl <<version 2>> <<optional>> only <<end>> <<optional>> or later <<end>>"),
    ("gpl", 0.9, "spdx license identifier <<optional>> lgpl <<end>> <<optional>> agpl <<end>> <<version 2>> <<optional>> only <<end>> <<optional>> or later <<end>>"),
    ("mpl", 0.9, "spdx license identifier mpl <<version 2>>"),
    ("mit", 0.8, "released under the mit license"),
    ("mit", 0.8, "licensed under the mit license"),
    ("apache", 0.8, f"licensed under the apache license {_VERSION} <<optional>> the license <<end>>"),
    ("gpl", 0.8, f"licensed under the gnu general public license {_VERSION}"),
    ("gpl", 0.8, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by", 0.8, "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by <<version 2>>"),
    ("cc-by-nc", 0.8, "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc <<version 2>>"),
    ("cc-by-sa", 0.8, "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by sa <<version 2>>"),
    ("cc-by", 0.8, "licensed under a creative commons attribution <<optional>> <<version 2>> <<end>> <<optional>> international <<end>> license"),
    ("cc-by-nc", 0.8, "licensed under a creative commons attribution noncommercial <<optional>> <<version 2>> <<end>> <<optional>> international <<end>> license"),
    ("mpl", 0.8, f"subject to the terms of the mozilla public license {_VERSION}"),
    ("proprietary", 0.5, "all rights reserved"),
)
#: Words that deny what follows them.
DENIALS = frozenset((b"not", b"never", b"nor"))
#: The score of a text that only has a license's name.
NAMED = 0.5


#: An edge that reads a word of digits; no word is empty.
NUMBER = b""


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``steps[s]`` has (word, None for any word or ``NUMBER``, next state); ``last`` accepts."""

    label: str
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    start: frozenset[int]
    accepting: frozenset[int]
    #: a word that every accepted text has, to look for first
    needed: bytes

    def match(self, words: list[bytes], at: int) -> int:
        """The longest accepted run of words from ``at`` on: its end, or -1."""
        states, end = self.start, -1
        for i in range(at, len(words)):
            word, after = words[i], set()
            for s in states:
                for w, t in self.steps[s]:
                    if w == word or w is None or w == NUMBER and word.isdigit():
                        after.add(t)
            if not after:
                break
            states = after
            if states & self.accepting:
                end = i + 1
        return end


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; edges without a word are closed over, so none is left."""
    words: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[set[int]] = [set()]
    plain: list[bytes] = []
    opened: list[int] = []
    here = 0

    def state() -> int:
        words.append([])
        free.append(set())
        return len(words) - 1

    for mark in re.findall(r"<<[^>]*>>|[^<\s]+", template):
        if mark == "<<optional>>":
            opened.append(here)
        elif mark == "<<end>>":
            free[opened.pop()].add(here)
        elif mark.startswith(("<<any", "<<version")):
            name, most = mark.strip("<>").split()
            exits = [here]
            for _ in range(int(most)):
                then = state()
                words[here].append((None if name == "any" else NUMBER, then))
                exits.append(then)
                here = then
            for e in exits[name == "version" : -1]:
                free[e].add(here)
        else:
            then = state()
            words[here].append((mark.encode(), then))
            if not opened:
                plain.append(mark.encode())
            here = then
    assert not opened and plain, f"unbalanced or empty template: {template!r}"

    def closed(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    steps = tuple(tuple(step for t in sorted(closed(s)) for step in words[t]) for s in range(len(words)))
    return Automaton(label, steps, frozenset({0}), frozenset(s for s in range(len(words)) if here in closed(s)), max(plain, key=lambda w: (len(w), w)))


@cache
def automata() -> tuple[Automaton, ...]:
    return tuple(compiled(label, t) for label, _, t in TEMPLATES)


@cache
def _phrases() -> tuple[tuple[Automaton, str], ...]:
    return tuple((compiled(label, p), label) for p, label in PHRASES)


def _places(auto: Automaton, words: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, int]]:
    """(first, end) of every place where the automaton accepts."""
    if auto.needed not in where:
        return []
    opening = {w for s in auto.start for w, _ in auto.steps[s]}
    starts = range(len(words)) if opening & {None, NUMBER} else sorted(i for w in opening for i in where.get(w, ()))
    return [(i, e) for i in starts if (e := auto.match(words, i)) >= 0]


def scan(text: str | None) -> dict[str, object]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans of one whole text."""
    words = plain_words(text)
    needed, wanted = _vocabulary()
    where: dict[bytes, list[int]] = {}
    if not needed.isdisjoint(words):
        for i, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(i)
    base = [(i, label) for auto, label in _phrases() for i, _ in _places(auto, words, where)]
    found = [(a, e, auto.label, score) for auto, (_, score, _) in zip(automata(), TEMPLATES, strict=True) for a, e in _places(auto, words, where) if not (a and words[a - 1] in DENIALS)] if where else []
    spans = [x[:3] for x in found]
    labels = {x for _, x in base}
    every = labels | {x for *_, x in spans}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((i for i, _ in base), default=None),
        "last_word": max((i for i, _ in base), default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(every)),
        "score": max([x[3] for x in found], default=NAMED if base else 0.0),
        "spans": sorted(spans),
    }


@cache
def _vocabulary() -> tuple[frozenset[bytes], frozenset[bytes]]:
    """Words of which a text needs one, and all words that a template may open with."""
    every = (*automata(), *(a for a, _ in _phrases()))
    needed = frozenset(a.needed for a in every)
    return needed, frozenset(needed | {w for a in every for s in a.start for w, _ in a.steps[s] if w is not None})


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string>>"


def licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    schema = pa.schema(
        [
            ("k", rows.select("k").limit(0).toArrow().schema[0].type),
            *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
            ("base_labels", pa.string()),
            ("labels", pa.string()),
            ("score", pa.float64()),
            ("spans", span),
        ]
    )

    def work(cols: dict[str, list]) -> dict[str, list]:
        found = [scan(t) for t in cols["text"]]
        out = {n: [f[n] for f in found] for n in schema.names[1:-1]}
        return {"k": cols["k"], **out, "spans": [[{"first": a, "end": e, "label": x} for a, e, x in f["spans"]] for f in found]}

    return map_batches(rows, work, schema, f"k {kind}, {_COLUMNS}").withColumnRenamed("k", key)
