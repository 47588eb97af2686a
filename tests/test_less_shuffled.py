"""What the queries of citations send and store on the way, in bytes, and that a change counts like a recount."""

import uuid

import pytest
from pyspark.sql import functions as F

from folioweave.operators import citing

from .test_shared_ids import found, library


def sent(spark, df):
    """Bytes that all stages of a frame's job write for others."""
    sc, group, was = spark.sparkContext, uuid.uuid4().hex, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sc.setJobGroup(group, group)
        df().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    known = [s for s in stages if sc.statusTracker().getStageInfo(s)]
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in known)


@pytest.mark.parametrize(("kind", "most"), [("number_matches", 100_000), ("cited_counts", 1_000_000), ("page_sources", 1_200_000)])
def test_little_is_sent(spark, kind, most):
    """Before, 144,622, 1,504,739 and 2,064,601 bytes of the same tables."""
    _, frames = library(spark, 300, 600)
    assert 0 < sent(spark, lambda: found(kind, frames)) < most


def test_a_change_as_one_frame(spark):
    _, t = library(spark, 12, 90)
    before, after = (citing.counting(t["citations"].where(w), t["aliases"], t["checks"]) for w in ("id % 7 <> 3", "id % 5 <> 0"))
    counts, want = (citing.cited_counts(t["pages"], t["places"], t["groups"], of, t["aliases"]) for of in (before, after))
    by = citing.count_change(t["pages"], t["places"], t["groups"], citing.change(before, after), t["aliases"])
    assert sorted(map(tuple, citing.moved(counts, by).collect())) == sorted(map(tuple, want.collect()))
    assert by.agg(F.min("n"), F.max("n")).first()[0] < 0


def test_shuffle_files_of_a_step_go(spark, monkeypatch):
    from folioweave.plans.session import checkpoints, tables

    checkpoints(spark)
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, put = spark.conf.get(name), type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, v: (seen.append((k, v)), put(self, k, v))[1])
    assert tables(spark, "step")(spark.range(10).groupBy("id").count()).count() == 10
    assert seen == [(name, "true"), (name, before)]
