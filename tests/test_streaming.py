"""The queue as a stream: windows with late changes, and last states by micro-batch."""

from datetime import datetime

from folioweave.streaming.queue import last_states, state_counts


def at(minute):
    return datetime(2024, 1, 1, 10 + minute // 60, minute % 60)


def test_state_counts_and_last_states(spark, tmp_path):
    kind = "id long, status string, at timestamp"
    batches = [[(1, "queued", at(1)), (2, "queued", at(5)), (1, "inProgress", at(7))], [(2, "queued", at(3)), (1, "imported", at(80))], [(3, "queued", at(2)), (2, "imported", at(200))]]
    changes = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        counts = state_counts(changes()).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c1")
        counts.trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.start.hour, r.status): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the change that comes after its window has closed is left out
    assert got[10, "queued"] == 3 and got[10, "inProgress"] == 1 and got[11, "imported"] == 1
    seen = {}
    store = lambda df, epoch: seen.update({r.id: r.status for r in df.collect()})
    q = changes().writeStream.foreachBatch(last_states(store)).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    assert seen[1] == "imported" and seen[3] == "queued"
