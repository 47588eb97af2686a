"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its failure as one bit beside the
measurements. A policy is a version and a mask, so that changing a policy, or leaving a rule out of it,
costs an ``&`` over the ledger and no second look at the texts.

Defined results: a null or empty text measures zero everywhere and fails ``few_words``; repeated rows are
judged row by row; other columns of the input, whatever their names, are ignored by ``ledger`` and kept by
``keep``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .text import map_batches, pieces

_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_ascii_letters")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; ``bit`` never changes once ledgers exist."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 5 * word_chars"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "capitals", "n_ascii_letters >= 50 AND 100 * n_upper > 45 * n_ascii_letters"),
    Rule(5, "word_length", "word_chars > 40 * n_words OR (n_words > 0 AND word_chars < 2 * n_words)"),
)
BASE = Policy("base", ("few_words", "repeated_phrases"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(r.name for r in RULES)))}


#: Texts of more words are counted in arrays: a list of windows would take a hundred bytes a word.
LONG = 100_000


def count_repeated(words: list[bytes]) -> int:
    """Words inside a window of three words that the text has twice or more, first ones included."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n > LONG:
        often = _often(words)
    else:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == n:
            return 0
        times = Counter(windows)
        often = np.fromiter((times[w] > 1 for w in windows), bool, n)
    hit = np.zeros(n + 2, bool)
    for i in range(3):
        hit[i : i + n] |= often
    return int(hit.sum())


def _often(words: list[bytes]) -> np.ndarray:
    """Whether each window comes again; pairs and triples are numbered, so the count is exact."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    return times[which] > 1


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_BLANK.decode())]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _BLANK))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        count_repeated(words),
        upper,
        upper + lower,
    )


def measurements(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements) of each row."""
    kind = df.select(key).schema[0].dataType.simpleString()
    arrow = pa.schema([("id", df.select(key).limit(0).toArrow().schema[0].type), *((m, pa.int64()) for m in MEASURES)])

    def work(cols: dict[str, list]) -> dict[str, list]:
        found = list(zip(*map(measure, cols["text"]), strict=True)) or [()] * len(MEASURES)
        return {"id": cols["id"], **dict(zip(MEASURES, map(list, found), strict=True))}

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = map_batches(rows, work, arrow, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumnRenamed("id", key)


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, measurements, fail_bits): a row for each row of ``df``."""
    return measurements(df, key, text).withColumn("fail_bits", failure_bits(rules))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in policy.rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Over a ledger: whether the policy keeps the row."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that only it rejects (kept if it were left out).

    The ledger is first summed by bit pattern, of which there are at most 2 to the number of rules.
    """
    m = mask(policy, rules)
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    listed = ", ".join(f"named_struct('rule', '{r.name}', 'bit', {1 << r.bit}L)" for r in rules if r.name in policy.rules)
    return (
        seen.selectExpr("bits", "n", f"inline(array({listed}))")
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum(F.when(F.expr("bits & bit != 0"), F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.expr("bits = bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )


def keep(df: DataFrame, policy: Policy = POLICIES["v1"], text: str = "text") -> DataFrame:
    """The rows of ``df``, with their own columns, that the policy keeps; judged where they stand, without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                found = pa.array([measure(t) for t in part.column(at).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "_measured"])

    at, plain = df.columns.index(text), [f"_{i}" for i in range(len(df.columns))]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(plain, df.schema, strict=True)), StructField("_measured", ArrayType(LongType()))])
    rows = df.toDF(*plain).mapInArrow(run, schema)
    judged = rows.select(*plain, *(F.col("_measured")[i].alias(m) for i, m in enumerate(MEASURES))).withColumn("fail_bits", failure_bits())
    return judged.filter(passes(policy)).select(*plain).toDF(*df.columns)
