"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are learnt from at most ``SAMPLE`` labelled rows that are not held out, those with the least hashes of their keys. The lexicon is
learnt too: words and beginnings of words that toxic texts have more often, weighted by the logarithm of how much more often. So that the trees see the
lexicon as it does on new texts, each half of the sample is measured with the lexicon of the other half; all other texts
with that of both. A quarter of the sample does not go to the trees but calibrates their margins. Features are densities: of the lexicon
by strength, near words of the second person, in capitals, and found only after digits and signs in words are undone; of capitals, marks,
signs and such words. Language, source and key are no features.

Defined results: a null or empty text has features of zero and a score like any other; rows are scored one by one, so repeated ones get the same score;
a null key is not held out and has no label; of several labels of a key the largest counts, null labels none; without labels of both
kinds every score is the share of toxic labels (0 without any); very long texts are read whole; other columns are ignored, whatever their names; an empty table gives
an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import pieces
from .workspace import Workspace

#: Labelled rows that are learnt from at most, and entries of the lexicon.
SAMPLE, LEXICON = 12_000, 1_500
TREES, DEPTH, STEP = 24, 3, 0.2
THRESHOLD = 0.7
#: Beginnings of words of these lengths may be entries; an entry is in at least so many toxic texts of what it is learnt from.
PREFIXES, SUPPORT = range(4, 9), 3
#: An entry's weight is at least this and at most twice ``STRONG``.
WEAK, STRONG = 1.0, 3.0
#: So many words on either side of a word of the second person are near it.
NEAR = 5
_WORDS = 300_000
#: The second person in four languages.
_YOU = frozenset("you your yours yourself ur du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os vuestro vuestra".split())
#: Digits and signs that stand for letters.
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_EDGE, _SIGNS, _LONG = re.compile(r"^\W+|\W+$"), re.compile(r"[\W_]+"), re.compile(r"(.)\1{2,}")
FEATURES = (
    "words", "lexicon", "strong", "strong_times", "medium", "weak", "greatest", "weight", "near_you", "near_you_times", "you", "capitals", "lexicon_in_capitals",
    "exclamations", "marks", "signs", "obfuscated", "lexicon_obfuscated", "different",
)


def folded(token: str) -> tuple[str, str]:
    """A token in lower case without marks around it, and with the signs and repeats inside it undone."""
    plain = _EDGE.sub("", token.lower())
    undone = _LONG.sub(r"\1", _SIGNS.sub("", _EDGE.sub("", token.lower().rstrip(".,;:!?")).translate(_LEET)))
    return plain, undone


def entries(word: str) -> list[str]:
    """A word and its beginnings, as entries of a lexicon."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)] if word else []


class _Tokens(dict):
    """A token to a number: its weight in sixteenths, its signs, and the hash of its word in the high half."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self._lexicon = lexicon

    def _weight(self, word: str) -> float:
        return max((self._lexicon.get(e, 0.0) for e in entries(word)), default=0.0)

    def __missing__(self, token: str) -> int:
        if len(self) >= _WORDS:
            self.clear()
        plain, undone = folded(token)
        weight, hidden = self._weight(plain), False
        if undone != plain and len(undone) > 2:
            other = self._weight(undone)
            if other > weight:
                weight, hidden = other, True
        odd = undone != plain and any(c.isalpha() for c in plain) and any(not c.isalnum() or c.isdigit() for c in plain)
        letters = sum(c.isalpha() for c in token)
        flags = (plain in _YOU) | (letters > 1 and token.isupper()) << 1 | odd << 2 | hidden << 3
        self[token] = found = min(int(weight * 16), 255) | int(flags) << 8 | (crc32(plain.encode()) & 0xFFFF) << 16
        return found


_EXCLAIM, _MARKS, _OTHER = b"!?", b".,;:", b"#$%&*+-/<=>@\\^_|~()[]{}\"'`0123456789"


def features(text: str | None, tokens: _Tokens) -> list[float]:
    """The values of ``FEATURES`` of a whole text."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    code = np.fromiter(map(tokens.__getitem__, words), np.int64, n)
    weight, flags = (code & 255) / 16, code >> 8 & 255
    you, capital, odd, hidden = ((flags >> i & 1).astype(bool) for i in range(4))
    strong, medium = weight >= STRONG, (weight >= 2) & (weight < STRONG)
    hit = weight >= 2
    near = np.zeros(n, bool)
    if you.any() and hit.any():
        reach = np.concatenate([[0], np.cumsum(you)])
        at = np.arange(n)
        near = hit & (reach[np.minimum(at + NEAR + 1, n)] - reach[np.maximum(at - NEAR, 0)] > 0)
    raw = text.encode()
    count = lambda signs: len(raw) - len(raw.translate(None, signs))
    log = np.log1p
    return [float(x) for x in (
        log(n), 100 * weight.sum() / n, 100 * strong.sum() / n, log(strong.sum()), 100 * medium.sum() / n, 100 * ((weight > 0) & (weight < 2)).sum() / n, weight.max(), log(weight[hit].sum()),
        100 * near.sum() / n, log(near.sum()), you.sum() / n, capital.sum() / n, 100 * (hit & capital).sum() / n, count(_EXCLAIM) / n, count(_MARKS) / n, count(_OTHER) / n, odd.sum() / n, 100 * hidden.sum() / n,
        log(len(np.unique(code[hit]))),
    )]


def measured(df: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """The other columns of ``df``, and ``features`` in place of the text."""
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, text)
    arrow = [rows.select(*kept).limit(0).toArrow().schema.field(i) for i in range(len(kept))]
    schema = pa.schema([*arrow, ("features", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(lexicon)
        for batch in batches:
            for part in pieces(batch):
                found = pa.array([features(t, tokens) for t in part.column(len(kept)).to_pylist()], schema.field("features").type)
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(f.type) for i, f in enumerate(arrow)), found], schema=schema)

    spark_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "features array<double>"])
    return rows.mapInArrow(run, spark_schema)


def held_out(key: Column) -> Column:
    """Whether labels of the row may not be learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = SAMPLE) -> DataFrame:
    """(toxic, half, part, text) of the rows that are learnt from; a quarter has part 0."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    order = F.xxhash64(F.col("_id"), F.lit("sample"))
    some = known.where(~held_out(F.col("_id"))).orderBy(order, "_id").limit(most)
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(some), F.col("_key") == F.col("_id"))
    return rows.select("toxic", F.pmod(order, F.lit(2)).cast("int").alias("half"), F.pmod(F.shiftright(order, 8), F.lit(4)).cast("int").alias("part"), "text")


def lexicons(rows: DataFrame, work: Workspace, most: int = LEXICON) -> list[dict[str, float]]:
    """The lexicons of half 0, half 1 and both: at most ``most`` entries each, with their weights."""
    schema = pa.schema([("entry", pa.string()), ("half", pa.int32()), ("toxic", pa.int32()), ("texts", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts, times = Counter(), Counter()
                for toxic, half, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own: Counter[str] = Counter()
                    words = Counter(folded(t)[0] for t in (text or "").split())
                    for w, n in words.items():
                        for e in entries(w):
                            own[e] += n
                    own[""] = sum(words.values())
                    for e, n in own.items():
                        texts[e, half, toxic] += 1
                        times[e, half, toxic] += n if e == "" else min(n, 10)
                columns = [*zip(*texts, strict=True)] if texts else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(texts.values(), pa.int64()), pa.array(times.values(), pa.int64())], schema=schema)

    found = rows.select("toxic", "half", "text").mapInArrow(run, "entry string, half int, toxic int, texts long, times long").groupBy("entry", "half", "toxic").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times"))
    found = work.put("entries", found)
    each = found.select("entry", F.explode(F.array(F.col("half"), F.lit(2))).alias("of"), "toxic", "texts", "times")
    bad, good = F.col("toxic") == 1, F.col("toxic") == 0
    one = each.groupBy("entry", "of").agg(*(F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n) for c, v, n in ((bad, F.col("texts"), "in_bad"), (bad, F.col("times"), "bad"), (good, F.col("times"), "good"))))
    all_ = one.where("entry = ''").select(F.col("of").alias("_of"), F.col("bad").alias("all_bad"), F.col("good").alias("all_good"))
    weighed = one.where((F.col("entry") != "") & (F.col("in_bad") >= SUPPORT)).join(all_, F.col("of") == F.col("_of"))
    weight = F.log((F.col("bad") + 0.5) / (F.col("all_bad") + 1)) - F.log((F.col("good") + 0.5) / (F.col("all_good") + 1))
    kept = weighed.select("entry", "of", "in_bad", F.least(weight, F.lit(2 * STRONG)).alias("weight")).where(F.col("weight") >= WEAK)
    best = (F.col("weight") * F.sqrt("in_bad")).alias("rank")
    out = []
    for of in range(3):
        some = kept.where(F.col("of") == of).select("entry", "weight", best).orderBy(F.desc("rank"), "entry").limit(most)
        out.append({r.entry: r.weight for r in some.collect()})
    return out


class Model:
    """A lexicon, trees over the features and a calibration of their margins; or one share for all texts."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, steps: IsotonicRegressionModel | None, share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The other columns of ``df``, and ``score``."""
        if self.trees is None:
            return df.drop(text).withColumn("score", F.lit(self.share))
        rows = measured(df, self.lexicon, text)
        kept = [F.col(c) for c in rows.columns if c != "features"]
        return self.steps.transform(_margins(self.trees, rows)).select(*kept, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    seen = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return seen.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    work = Workspace(documents.sparkSession, "toxicity")
    rows = work.put("sample", sample(documents, labels, key, text, label))
    seen = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    if not seen.get(0) or not seen.get(1):
        return Model({}, None, None, share)
    first, second, both = lexicons(rows, work)
    halves = measured(rows.where("half = 0"), second).unionByName(measured(rows.where("half = 1"), first))
    table = work.put("features", halves.select(F.col("toxic").cast("double").alias("label"), "part", "features")).coalesce(4)
    learnt, kept = table.where("part <> 0"), table.where("part = 0")
    if learnt.select("label").distinct().count() < 2 or kept.limit(1).count() == 0:
        learnt = kept = table
    vectors = learnt.withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=12, subsamplingRate=1.0, minInstancesPerNode=5).fit(vectors)
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(_margins(trees, kept))
    return Model(both, trees, steps, share)


def toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    scored = fit(documents, labels, key, text).score(documents.select(key, text), text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
