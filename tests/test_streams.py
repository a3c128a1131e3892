import os

import pytest
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def fed(spark, make, schema, parts, folder, out):
    """Runs a stream over Parquet parts, each its own run that starts from the checkpoint; what it gave."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = make(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


REQUESTS = "resource string, at double, owner string, ttl double"


def test_leases_run_out(rocks, tmp_path):
    from larkspur.streaming.stateful import lease_events, lease_stream

    one = [("r", 100.0, "a", 10.0), ("r", 105.0, "b", 10.0), ("r", 108.0, "a", 10.0), ("s", 101.0, "x", 3.0)]
    two = [("r", 119.0, "b", 5.0), ("s", 109.0, "x", 3.0), ("r", 130.0, "b", 5.0)]
    last = [("t", 1000.0, "z", 1.0)]  # moves the watermark, so timers fire
    more = [("t", 2000.0, "y", 1.0)]
    schema = REQUESTS
    got = fed(rocks, lambda s: lease_stream(s.withColumn("ts", F.col("at").cast("timestamp")), "1 second"), schema, [one, two, last, more], str(tmp_path), str(tmp_path / "out"))
    want = lease_events(rocks.createDataFrame(one + two + last + more, schema), 1500.0)
    assert rows_of(got) == rows_of(want)
    assert {r for r in rows_of(got) if r[3] == "released"} == {("r", 118.0, "a", "released"), ("r", 124.0, "b", "released"), ("r", 135.0, "b", "released"), ("s", 104.0, "x", "released"), ("s", 112.0, "x", "released"), ("t", 1001.0, "z", "released")}


EVENTS = "base string, seq long, kind string, change_id string, executed long, failed string"


def test_probation_over_a_stream(rocks, tmp_path, monkeypatch):
    from larkspur.streaming import stateful as S

    rows = [("b", 1, "begin", "c1", None, None), ("b", 2, "begin", "c2", None, None), ("b", 3, "evaluate", None, 2, None), ("b", 4, "evaluate", None, 2, None), ("x", 1, "evaluate", None, 0, None), ("b", 5, "begin", "c3", None, None)]
    more = [("b", 6, "evaluate", None, 0, None), ("b", 7, "begin", "c4", None, None), ("b", 8, "close", None, None, None), ("b", 9, "begin", "c5", None, None), ("b", 10, "evaluate", None, 3, "t1,t2"), ("b", 11, "what", None, None, None)]
    got = fed(rocks, S.probation_stream, EVENTS, [rows, more], str(tmp_path), str(tmp_path / "out"))
    assert rows_of(got) == rows_of(S.probation_batch(rocks.createDataFrame(rows + more, EVENTS)))
    said = {r.seq: (r.status, r.change_id, r.reason, r.history) for r in got.where("base = 'b'").collect()}
    assert said == {
        1: ("probation_started", "c1", None, 0), 2: ("blocked", "c2", "active_probation", 0), 3: ("promoted", "c1", None, 1), 4: ("no_active_probation", None, None, 1), 5: ("probation_started", "c3", None, 1),
        6: ("reverted", "c3", "probation_failed:c3:all_skipped", 2), 7: ("blocked", "c4", "circuit_open", 2), 8: ("circuit_closed", None, "probation_failed:c3:all_skipped", 2),
        9: ("probation_started", "c5", None, 2), 10: ("reverted", "c5", "probation_failed:c5:t1,t2", 3), 11: ("unknown", None, "what", 3),
    }


ITEM = "queue string, name string, id string, kind string, schema_version int, priority int, approval_scope string, action_type string, path string, content string"


def started(spark, folder, *items):
    from larkspur.sources.versioned import Store
    from larkspur.streaming import ticks as T

    store = Store(spark, folder)
    T.begin_ticks(store, spark.createDataFrame(list(items), ITEM))
    return store


def report(k, scope="workspace_artifacts", priority=None, path="artifacts/a.md"):
    return ("reports", f"report-{k}.json", f"report-{k}", "report", 1, priority, scope, "write_text", path, f"text {k}")


def test_ticks_carry_a_report_to_its_end(spark, tmp_path):
    from larkspur.streaming.ticks import tick

    store = started(spark, str(tmp_path / "s"), report(1), report(2, scope="other", priority=5))
    assert [tick(store) for _ in range(5)] == ["report_rejected", "report_to_task", "task_to_handoff", "handoff_accepted", "idle"]
    assert rows_of(store.table("artifacts")) == [("artifacts/a.md", "text 1")]
    assert rows_of(store.table("items").select("queue", "name", "state")) == [("handoffs", "handoff-1.json", "accepted"), ("reports", "report-1.json", "archive"), ("reports", "report-2.json", "rejected"), ("tasks", "task-1.json", "archive")]


def test_a_damaged_artifact_is_retried_and_then_opens_the_circuit(spark, tmp_path):
    from larkspur.streaming.ticks import tick

    store, seen = started(spark, str(tmp_path / "s"), report(1)), []
    for _ in range(10):
        seen.append(tick(store))
        if seen[-1] == "task_to_handoff":
            store.commit(store.current(), {"artifacts": store.table("artifacts").withColumn("content", F.lit("damaged"))})
    assert seen == ["report_to_task", *["task_to_handoff", "handoff_rejected"] * 3, "task_to_handoff", "circuit_opened", "circuit_open"]
    assert store.table("items").where("queue = 'tasks'").first().retry_count == 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from larkspur.streaming import ticks as T

    store = started(spark, str(tmp_path / "s"), report(1), report(2))
    asked, check = str(tmp_path / "in"), str(tmp_path / "check")
    spark.range(3).coalesce(1).write.parquet(asked)

    def run():
        T.tick_stream(spark.readStream.schema("id long").parquet(asked), store.folder, check).trigger(availableNow=True).start().awaitTermination()

    run()
    first, number = rows_of(store.table("log")), store.current().number
    assert [r[2] for r in first] == ["report_to_task", "task_to_handoff", "handoff_accepted"] and {r[0] for r in first} == {0}
    for name in ("0", ".0.crc"):  # the stream dies before it notes that the batch is done
        os.remove(f"{check}/commits/{name}")
    run()
    assert store.current().number == number and rows_of(store.table("log")) == first
    # a batch that stopped after one of its two ticks goes on with the second
    assert T.tick(store, 7, 0) == "report_to_task"
    assert T.run_batch(store, spark.range(2), 7) == 1 and T.run_batch(store, spark.range(2), 7) == 0
    assert [r[2] for r in rows_of(store.table("log").where("batch = 7"))] == ["report_to_task", "task_to_handoff"]
