"""Two tokenizers' tokens of one text, aligned by the byte offsets at which tokens of both end.

Python only tokenises. Words (a word here is a run of text up to a space that follows something else than white space)
are what neither tokenizer's tokens cross, so each different word of the corpus is tokenised and aligned once. A batch of texts is handed on as its
different words and, for each text, the numbers of its words. All the rest are functions of arrays in Spark: the cuts of a word
are ``array_intersect`` of its two arrays of ends, and groups are slices between cuts. The marks of a word are the ends of both sides with the numbers of
their tokens (``sequence``), sorted; every stretch between two marks lies in one token of each side, which makes it a link. Links are counted
over the corpus by (A id, B id), each word's once with its number of occurrences; the counts come back to the words, the words' sums to the batches
that have them, and a text sums its words' by ``aggregate``.

A count is needed wherever its pair occurs. ``HOT`` pairs with the highest counts, a bound that does not grow
with the data, are broadcast, and what is not among them meets its count in a shuffled join; both ways are exact.

Defined results: a text that is null or empty, or whose tokens of A or B do not join to a space and the text, has no tokens:
zeros, and '' for its groups. Repeated rows are rows of their own and count each; other columns of the input are
ignored, whatever their names; keys may be null; an empty table gives an empty one. A text of any length is a batch of its own at most.
Ties of counts: all links of a B id whose pairs have its highest count are best.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

TOKENIZERS = "/opt/tokenizers"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: So many pairs are broadcast, whatever the size of the corpus; about 20 MB.
HOT = 1 << 18
#: Texts of about this many bytes share their words.
BATCH_BYTES = 16 << 20
#: Words meet their sums in so many rounds, each with its share of the words; the shuffle of one is gone before the next.
ROUNDS = 2
_CHUNK, _ROWS = 1 << 16, 20_000
#: Its tables are ids and texts of digits, which it takes to a good third of what the default codec leaves.
_CODEC = "zstd"
#: A fixed value: the expression that splits text before the merges of byte-level BPE.
_BYTE_BPE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_ENDS = re.compile(r"(?<=\S)(?= )")
_BROKEN = re.compile(r"\s |\s\Z")
_MARK = "▁"

#: Of one side: the ids of all words' tokens, their ends within their words, and where each word's tokens begin.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def words_of(text: str) -> list[str]:
    """A space and the text, cut before each space that follows something else than white space."""
    return [f" {w}" for w in text.split(" ")] if not _BROKEN.search(f" {text}") else _WORD_ENDS.split(f" {text}")


class Pair:
    """The two tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece
        import tiktoken

        model = json.loads(Path(a_path).read_text())
        special = {t["id"] for t in model["added_tokens"]}
        by_char = _byte_of_char()
        ranks = {bytes(by_char[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special}
        # ids of a byte-level vocabulary are in the order of its merges, which makes them ranks
        self._a = tiktoken.Encoding("a", pat_str=_BYTE_BPE, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        names = {i: t for t, i in ranks.items()}
        self._names = ([names.get(i, b"") for i in range(max(names) + 1)], [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)])
        self._sizes = [np.array([len(n) for n in side], np.int64) for side in self._names]
        #: Whether no piece goes on behind a space, so that words can be tokenised alone.
        self.by_words = not any(_MARK in p.lstrip(_MARK) for p in pieces)

    def _encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text that starts with a space; None if the tokens of one do not join to it."""
        raw, a = text.encode(), self._a.encode_ordinary(text)
        # a lone space is nothing to the second, which adds one to what is not empty
        b = self._b.encode(text[1:]) if len(text) > 1 else [self._b.piece_to_id(_MARK)]
        whole = all(b"".join(map(names.__getitem__, ids)) == raw for ids, names in zip((a, b), self._names, strict=True))
        return (a, b) if whole else None

    def words(self, wanted: list[str]) -> tuple[np.ndarray, Side, Side]:
        """Whether each word's tokens join to it, and both sides. Words that may stand before any other are tokenised many at a time."""
        joins = np.ones(len(wanted), bool)
        sides: tuple[list, list] = ([], [])

        def learn(begin: int, end: int) -> None:
            found = self._encoded("".join(wanted[begin:end])) if begin < end else ([], [])
            if found is None and end - begin > 1:
                for i in range(begin, end):
                    learn(i, i + 1)
                return
            if found is None:
                joins[begin], found = False, ([], [])
            borders = np.cumsum([len(w.encode()) for w in wanted[begin:end]])
            for side, ids, sizes in zip(sides, found, self._sizes, strict=True):
                ids = np.array(ids, np.int32)
                ends = np.cumsum(sizes[ids])
                last = np.searchsorted(ends, borders) + 1 if len(ids) else np.zeros(end - begin, np.int64)
                n = np.diff(last, prepend=0)
                side.append((ids, (ends - np.repeat(np.concatenate([[0], borders[:-1]]), n)).astype(np.int32) if len(ids) else ids, n))

        begin, size = 0, 0
        for i, w in enumerate(wanted):
            if w[-1].isspace():  # what comes behind it would change its tokens
                learn(begin, i)
                learn(i, i + 1)
                begin, size = i + 1, 0
            elif (size := size + len(w)) > _CHUNK:
                learn(begin, i + 1)
                begin, size = i + 1, 0
        learn(begin, len(wanted))
        return joins, *(tuple(np.concatenate([np.empty(0, np.int32), *column]) for column in zip(*side, strict=True)) for side in sides)


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """Loaded once a worker."""
    return Pair(a_path, b_path)


_INTS = pa.list_(pa.int32())


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def numbered(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds for each batch of texts: one (batch, docs) with the keys and the numbers of the words of its texts, and one (batch, w, word, times) for each word."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, arrow_key = rows.schema["key"].dataType.simpleString(), rows.select("key").limit(0).toArrow().schema[0].type
    doc = pa.struct([("key", arrow_key), ("words", _INTS)])
    schema = pa.schema([("batch", pa.int64()), ("docs", pa.list_(doc)), ("w", pa.int32()), ("word", pa.string()), ("times", pa.int64())])

    def batch(name: int, keys: list, texts: list[str | None], cut: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        docs = [np.fromiter((number.setdefault(w, len(number)) for w in cut(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        joined = np.concatenate([np.empty(0, np.int32), *docs])
        listed = pa.StructArray.from_arrays([pa.array(keys, arrow_key), _lists(joined, [len(d) for d in docs])], fields=list(doc))
        whole = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), whole, *(pa.nulls(1, f.type) for f in list(schema)[2:])], schema=schema)
        times, words = np.bincount(joined, minlength=len(number)), list(number)
        for i in range(0, len(words), _ROWS):
            part = words[i : i + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.int64()), pa.nulls(len(part), schema.field("docs").type), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part, pa.string()), pa.array(times[i : i + _ROWS], pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = words_of if pair(a_path, b_path).by_words else lambda t: [f" {t}"]
        keys, texts, size = [], [], 0
        names = count(TaskContext.get().partitionId() << 32)
        for got in batches:
            for k, t in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                keys.append(k)
                texts.append(t)
                size += len(t or "")
                if size >= BATCH_BYTES:
                    yield from batch(next(names), keys, texts, cut)
                    keys, texts, size = [], [], 0
        if keys:
            yield from batch(next(names), keys, texts, cut)

    return rows.mapInArrow(run, f"batch bigint, docs array<struct<key: {kind}, words: array<int>>>, w int, word string, times bigint")


def tokenised(words: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(id, word, times, joins, a, a_ends, b, b_ends) of rows (word, times); a word whose tokens of A or B do not join to it has none."""
    schema = pa.schema([("id", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("joins", pa.bool_()), ("a", _INTS), ("a_ends", _INTS), ("b", _INTS), ("b_ends", _INTS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, begin = pair(a_path, b_path), TaskContext.get().partitionId() << 40
        for got in batches:
            joins, *sides = both.words(got.column(0).to_pylist())
            columns = [_lists(side[c], side[2]) for side in sides for c in (0, 1)]
            ids = pa.array(range(begin, begin + got.num_rows), pa.int64())
            begin += got.num_rows
            yield pa.RecordBatch.from_arrays([ids, got.column(0), got.column(1), pa.array(joins), *columns], schema=schema)

    ints = "array<int>"
    return words.select("word", "times").mapInArrow(run, f"id bigint, word string, times bigint, joins boolean, a {ints}, a_ends {ints}, b {ints}, b_ends {ints}")


def without_broken(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` words with ``times`` less those in texts with a word that does not join; found: what ``numbered`` gives."""
    listed = found.where("word is not null").select("batch", "w", "word")
    broken = listed.join(known.where("not joins").select("word"), "word", "left_semi").groupBy("batch").agg(F.collect_set("w").alias("broken"))
    docs = found.where("docs is not null").join(broken, "batch").select("batch", "broken", F.explode("docs.words").alias("words")).where(F.arrays_overlap("words", "broken"))
    less = docs.select("batch", F.explode("words").alias("w")).groupBy("batch", "w").agg(F.count("*").alias("n"))
    less = less.join(listed, ["batch", "w"]).groupBy("word").agg(F.sum("n").alias("n"))
    return known.join(less, "word", "left").withColumn("times", F.col("times") - F.coalesce("n", F.lit(0))).drop("n")


#: Added to the numbers of B tokens in marks, so that at a cut A comes first.
_SIDE = 1 << 30
#: Words of more tokens than this have their cuts found in the sorted marks, shorter ones by looking for each.
_SHORT = 64


def _packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 32) - 1))


def marks() -> Column:
    """Of (a_ends, b_ends) the ends of both sides in order, each in the high half with its token's number in the low one."""
    side = lambda ends, base: F.zip_with(ends, F.sequence(F.lit(base), F.size(ends) - 1 + base), _packed)
    return F.sort_array(F.concat(side("a_ends", 0), side("b_ends", _SIDE)))


def _closes(own: Column, m: Column, r: Column) -> Column:
    """Whether a mark is B's at the same end as A's before it."""
    return (_low(m) >= _SIDE) & F.coalesce(F.shiftright(F.get(own, r - 1), 32) == F.shiftright(m, 32), F.lit(False))


def with_links(words: DataFrame) -> DataFrame:
    """A row for each link of each word, with ``link``: A's id in the high half, B's in the low one.

    Of a mark's rank as many as are not its own side's before it are the other side's, which gives the number of the token there.
    """
    each = words.withColumn("marks", marks()).select("*", F.posexplode("marks").alias("r", "m"))
    number = _low(F.col("m"))
    of_a = F.when(number < _SIDE, number).otherwise(F.col("r") - number + _SIDE).cast("int")
    return each.where(~_closes(F.col("marks"), F.col("m"), F.col("r"))).withColumn("link", _packed(F.get("a", of_a), F.get("b", F.col("r") - of_a))).drop("r", "m", "marks")


def groups_of() -> Column:
    """Of (a, a_ends, b, b_ends, cuts) the groups as ``a1,a2|b1;a3|b2,b3``."""
    ids = lambda c: F.array_join(c.cast("array<string>"), ",")

    # tells how many tokens of each side end up to each cut, and joins what lies between
    def joined(a_at: Column, b_at: Column) -> Column:
        def piece(of: str, at: Column, k: Column) -> Column:
            before = F.when(k == 0, 0).otherwise(F.get(at, k - 1))
            return ids(F.slice(of, before + 1, F.get(at, k) - before))

        each = lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.size("cuts") - 1), lambda k: F.concat(piece("a", at["a"], k), F.lit("|"), piece("b", at["b"], k))), ";")
        return F.transform(F.array(F.struct(a_at.alias("a"), b_at.alias("b"))), each)[0]

    place = lambda ends: F.transform("cuts", lambda c: F.array_position(ends, c).cast("int"))
    looked_for = joined(place("a_ends"), place("b_ends"))

    # from the marks of B at cuts
    def found(own: Column) -> Column:
        at = F.filter(F.transform(own, lambda m, r: F.when(_closes(own, m, r), F.struct((r - _low(m) + _SIDE).cast("int").alias("a"), (_low(m) - _SIDE + 1).cast("int").alias("b")))), lambda x: x.isNotNull())
        return F.transform(F.array(at), lambda x: joined(x["a"], x["b"]))[0]

    in_marks = F.transform(F.array(marks()), found)[0]
    whole = F.concat(ids(F.col("a")), F.lit("|"), ids(F.col("b")))
    return F.when(F.size("cuts") == 1, whole).when(F.size("a") + F.size("b") <= _SHORT, looked_for).otherwise(in_marks)


def counts(links: DataFrame) -> DataFrame:
    """(link, n, best): how many links of the corpus are of each pair of ids, and whether no other pair of its B id has more. links: (link, times)."""
    n = links.groupBy("link").agg(F.sum("times").alias("n")).withColumn("b", F.expr("link & 4294967295"))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, a_path: str = f"{TOKENIZERS}/{A}", b_path: str = f"{TOKENIZERS}/{B}", key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row; groups as ``a1,a2|b1;a3|b2,b3``."""
    work = Workspace(df.sparkSession, "alignment")
    found = work.put("numbers", numbered(df, a_path, b_path, key, text), compression=_CODEC)
    listed = found.where("word is not null").drop("docs")
    vocabulary = work.put("tokens", tokenised(listed.groupBy("word").agg(F.sum("times").alias("times")), a_path, b_path), compression=_CODEC)
    if not vocabulary.where("not joins").isEmpty():
        vocabulary = work.put("corrected", without_broken(vocabulary, found), compression=_CODEC)
    words = vocabulary.where("joins")
    links = with_links(words)
    n = work.put("counts", counts(links.where("times > 0").select("link", "times")))
    known = F.broadcast(n.orderBy(F.desc("n"), "link").limit(hot).withColumnRenamed("link", "_link"))
    few = n.limit(hot + 1).count() <= hot
    # a word that is in broken texts only has pairs without a count
    met = links.where("times > 0").select("id", "link").join(known, F.col("link") == F.col("_link"), "inner" if few else "left")
    often = met.where("n is not null").select("id", F.when(F.col("best"), 1).otherwise(0).cast("long").alias("n_best"), F.col("n").alias("count_sum"))
    rare = met.where("n is null").groupBy("id", "link").agg(F.count("*").alias("times")).join(n, "link")
    rare = rare.select("id", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    both = often if few else often.unionByName(rare)
    summed = both.groupBy("id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    # two small numbers in one, so that a text adds up three arrays instead of five
    own = words.withColumn("cuts", F.array_intersect("a_ends", "b_ends")).select("id", "word", F.size("cuts").alias("n_groups"), _packed(F.size("a"), F.size("b")).alias("sizes"), groups_of().alias("groups"))
    own = work.put("words", own.join(summed, "id").select("word", "sizes", _packed(F.col("n_groups"), F.col("n_best")).alias("small"), "count_sum", "groups"), compression=_CODEC)
    work.drop("tokens", "corrected", "counts")
    # every word of a batch has its place in the arrays, those without tokens with nulls, which the sums of their texts take on
    # rows of a word lie together in the table, which leaves little of them there
    of = ("sizes", "small", "count_sum", "groups")
    for i in range(ROUNDS):
        here = lambda rows: rows.where(F.pmod(F.xxhash64("word"), F.lit(ROUNDS)) == i)  # noqa: B023, E731
        work.put(f"each/round={i}", here(listed.select("batch", "w", "word")).join(here(own), "word", "left").select("batch", "w", *of), compression=_CODEC)
    work.drop("words")
    each = work.spark.read.schema("batch bigint, w int, sizes bigint, small bigint, count_sum bigint, groups string").parquet(*[work.path(f"each/round={i}") for i in range(ROUNDS)])
    # the words' rows go before their sums are shuffled
    docs = work.put("docs", found.where("docs is not null").select("batch", "docs"), compression=_CODEC)
    work.drop("numbers")
    arrays = each.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("w", *of))).alias("of")).select(F.col("batch").alias("_batch"), *(F.col(f"of.{c}").alias(c) for c in of))
    texts = docs.join(arrays, F.col("batch") == F.col("_batch"), "left")
    return _texts(texts).withColumnRenamed("key", key)


def _texts(batches: DataFrame) -> DataFrame:
    """The rows of the texts, from the numbers of their words and the arrays of the words' sums; zeros where a sum is null."""

    def total(doc: Column, of: str) -> Column:
        return F.aggregate(doc["words"], F.lit(0).cast("long"), lambda so_far, w: so_far + F.get(of, w))

    def row(doc: Column) -> Column:
        groups = F.array_join(F.transform(doc["words"], lambda w: F.get("groups", w)), ";")
        return F.struct(doc["key"].alias("key"), *(total(doc, c).alias(c) for c in ("sizes", "small", "count_sum")), groups.alias("groups"))

    rows = batches.select(F.explode(F.transform("docs", row)).alias("d")).select("d.key", *(F.coalesce(f"d.{c}", F.lit(0)).alias(c) for c in ("sizes", "small", "count_sum")), F.when(F.col("d.sizes").isNull(), "").otherwise(F.col("d.groups")).alias("groups"))
    low = lambda c: F.expr(f"{c} & 4294967295")
    rows = rows.select("key", F.shiftright("sizes", 32).alias("n_a"), low("sizes").alias("n_b"), F.shiftright("small", 32).alias("n_groups"), low("small").alias("n_best"), "count_sum", "groups")
    # each stretch between two ends is a link, and the ends at cuts are of both sides
    n_links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    return rows.select("key", "n_a", "n_b", "n_groups", n_links.alias("n_links"), "n_best", "count_sum", "groups")
