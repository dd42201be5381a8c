"""Structured Streaming twins (L-01, L-02, L-03)."""

import datetime as dt
import os

from piisieve.streaming import incremental as S


def test_incremental_verification(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write('{"recordId": "1", "input": "Contact a.b@gmail.com now", "entityType": "EMAIL", '
                '"entityValue": "a.b@gmail.com"}\n{bad\n\n')
    with open(os.path.join(src, "b.jsonl"), "w") as f:
        f.write('{"recordId": "2", "input": "server 10.0.0.1", "entityType": "IPV4", "entityValue": "10.0.0.1"}\n')
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    q = S.start_append(S.verify_entity_stream(spark, src), out, ck)
    q.awaitTermination()
    got = {r.recordId: r.verified for r in spark.read.json(out).collect()}
    assert got == {"1": True, "2": False}


def test_window_and_dedupe_streams(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "res")
    os.makedirs(src)
    t = dt.datetime(2024, 1, 1, 0, 5)
    rows = [("r1", "m", True, 10.0, t), ("r1", "m", False, 20.0, t), ("r2", "m", True, 30.0, t)]
    spark.createDataFrame(rows, "recordId string, model string, verified boolean, latency_ms double, ts timestamp") \
        .write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(
        "recordId string, model string, verified boolean, latency_ms double, ts timestamp").parquet(src)
    q = (S.dedupe_results_stream(stream).writeStream.format("memory").queryName("dedup")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("select count(*) c from dedup").first().c == 2
    w = (S.windowed_stats_stream(stream).writeStream.format("memory").queryName("winstats")
         .outputMode("update").trigger(availableNow=True).start())
    w.awaitTermination()
    r = spark.sql("select * from winstats").first()
    assert r.total == 3 and r.verified == 2


def test_stream_dead_letters(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in2")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write('{"recordId": "1", "input": "Contact a.b@gmail.com", "entityType": "EMAIL", '
                '"entityValue": "a.b@gmail.com"}\n{bad\n{"input": "no id"}\n\n')
    out, dead, ck = (os.path.join(tmpdir_path, d) for d in ("out2", "dead2", "ck2"))
    S.start_with_dead_letters(spark, src, out, dead, ck).awaitTermination()
    assert [r.recordId for r in spark.read.json(out).collect()] == ["1"]
    reasons = sorted(r.reject_reason for r in spark.read.json(dead).collect())
    assert reasons == ["invalid_json", "missing_recordId"]


def test_late_rows_dropped_by_watermark(spark, tmpdir_path):
    src, ck = os.path.join(tmpdir_path, "res3"), os.path.join(tmpdir_path, "ck3")
    schema = "recordId string, model string, verified boolean, latency_ms double, ts timestamp"
    on_time = [("r1", "m", True, 10.0, dt.datetime(2024, 1, 1, 5, 0))]
    late = [("r2", "m", True, 20.0, dt.datetime(2024, 1, 1, 1, 0)),      # hours behind: dropped
            ("r3", "m", False, 30.0, dt.datetime(2024, 1, 1, 5, 30))]    # on time: counted
    spark.createDataFrame(on_time, schema).write.mode("append").parquet(src)

    out = os.path.join(tmpdir_path, "wm_out")

    def keep(batch, epoch):   # update-mode rows of each micro-batch, replay-safe per epoch
        batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        q = (S.windowed_stats_stream(stream).writeStream.foreachBatch(keep).outputMode("update")
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    spark.createDataFrame(late, schema).write.mode("append").parquet(src)
    run()
    rows = spark.read.parquet(out).collect()
    last = max(r.epoch for r in rows)
    got = [(r.total, r.verified) for r in rows if r.epoch == last and r.total > 0]
    assert got == [(2, 1)]   # window 05:00 now holds r1 and r3; r2 (hours late) was dropped
