"""Streams against their batch forms: shuffled files over several micro-batches, and rows that come too late."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.functions import dims
from docweave.operators import conversations, logs
from docweave.streaming import chat_log, in_order
from tests.test_operators import rocks, run  # noqa: F401

DELAY = "400 days"


def streamed(spark, rows, path, order, time="ts", far=None, delay=DELAY):
    """Rows as a stream of shuffled files, one a micro-batch, and then one that moves the watermark past all."""
    last = rows.limit(1).withColumn(time, F.lit("2031-01-01").cast("timestamp")).withColumns(far or {})
    in_order.shuffled_files(rows, path, 4, order, last)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark(time, delay)


def same(a, b):
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_limits_in_event_time(rocks, tmp_path):  # noqa: F811
    spark = rocks
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    stream = streamed(spark, events, str(tmp_path / "in"), F.hash("request_id"), far={"key": F.lit(-1).cast("long")})
    got = run(in_order.rate_limit_stream(stream, 2, 86_400_000), "ordered_limits", spark)
    want = logs.rate_limit_replay(events.withColumn("ms", F.unix_millis("ts")), 2, 86_400_000)
    same(got.where("key >= 0"), want)
    assert want.where("NOT allowed").count() > 0


def test_history_in_event_time(rocks, tmp_path):  # noqa: F811
    spark = rocks
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ["prompt", "rename", "pin", "archive", "delete", "transcript", "prompt"])), (F.col("event_id") * 7 % 31 % 7 + 1).cast("int"))
    text = F.when(F.col("event_id") % 5 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("  a  long   text of event "), F.repeat(F.col("event_id").cast("string"), 20)))
    events = e.select((F.col("user_id") % 40).alias("conv_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("type"), text.alias("text"))
    stream = streamed(spark, events, str(tmp_path / "in"), F.hash("event_id"), "at", {"conv_id": F.lit(-1).cast("long")})
    got = in_order.latest_history(run(in_order.history_stream(stream), "histories", spark)).where("conv_id >= 0")
    want = conversations.apply_history_events(events).withColumn("updated_ms", F.unix_millis("updated_at")).drop("updated_at")
    same(got, want)


def test_parts_until_their_end(rocks, tmp_path):  # noqa: F811
    spark = rocks
    rows = []
    for r in range(12):
        kinds = ["text", "citation", "text", "citation", "agent-state", "text", "citation", "suggestions", "suggestions", "error" if r % 4 == 0 else "outcome"]
        for n, kind in enumerate(kinds):
            payload = f'{{"id":"c{(n + r) % 2}","place":{n}}}' if kind == "citation" else f"{kind}{n} "
            rows.append((r, n, kind, payload, 1_700_000_000 + 10 * n + r))
    parts = spark.createDataFrame(rows, "request_id long, seq int, type string, payload string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream = streamed(spark, parts, str(tmp_path / "in"), F.hash("request_id", "seq"), far={"request_id": F.lit(-1).cast("long")})
    got = run(in_order.part_stream(stream), "parts", spark)
    want = conversations.fold_parts(parts)
    same(got.withColumn("citations", F.to_json("citations")), want.withColumn("citations", F.to_json("citations")))
    assert want.where("size(citations) = 2").count() > 0


def test_starts_without_an_end_come_with_the_watermark(rocks, tmp_path):  # noqa: F811
    spark = rocks
    log = [("started", "a", 0), ("completed", "a", 10), ("started", "b", 5), ("failed", "c", 300), ("started", "c", 200), ("started", "d", 400), ("cancelled", "d", 5000)]
    rows = spark.createDataFrame(log, "event string, request_id string, s long").select("event", "request_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("error_code"))
    path = str(tmp_path / "in")
    in_order.shuffled_files(rows, path, 3, F.hash("request_id", "event"), rows.limit(2).withColumns({"ts": F.lit("2031-01-01").cast("timestamp"), "request_id": F.lit("z")}))
    spark.createDataFrame([("completed", "z", None, None)], "event string, request_id string, outcome string, error_code string").withColumn("ts", F.lit("2031-01-01 00:00:01").cast("timestamp")).select(rows.columns).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(chat_log.lifecycle_stream(stream, DELAY, "15 minutes"), "outer", spark).where("request_id != 'z'")
    want = logs.lifecycle(rows).select("request_id", "started_at", "ended", "outcome", "error_code", "duration_ms")
    far = F.col("duration_ms") > 900_000  # an end beyond the longest time is none
    want = want.withColumns({"ended": F.when(far, None).otherwise(F.col("ended")), "duration_ms": F.when(far, None).otherwise(F.col("duration_ms"))})
    same(got, want)
    assert got.where("ended IS NULL").count() == 2


@pytest.mark.parametrize("kind", ["rates", "usage"])
def test_windows_and_rows_too_late(rocks, tmp_path, kind):  # noqa: F811
    spark = rocks
    rows = [(k, 1_700_000_000 + 700 * k, ["answered", None][k % 2], ["E", None, None][k % 3], 10 * k, ["m1", "m2"][k % 2]) for k in range(60)]
    table = spark.createDataFrame(rows, "id long, s long, outcome string, error_code string, duration_ms long, model string").withColumns({"ts": F.timestamp_seconds("s"), "provider": F.lit("p"), "input_tokens": F.col("id"), "output_tokens": F.col("id") * 2})
    path = str(tmp_path / "in")
    table.repartitionByRange(3, "s").sortWithinPartitions("s").write.parquet(path)
    late = table.where("id = 3").withColumn("duration_ms", F.lit(999_999).cast("long")).withColumn("input_tokens", F.lit(999_999).cast("long"))
    far = table.where("id = 0").withColumn("ts", F.lit("2031-01-01").cast("timestamp"))
    for more in (late, far):  # the late row comes when its window is over
        more.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "1 hour")
    if kind == "rates":
        got, want = chat_log.outcome_rate_stream(stream, "1 hour"), logs.outcome_rates(table.withColumn("started_at", F.col("ts")), "1 hour")
    else:
        prices = dims.prices(spark, [("p", "m1", 2.0, 6.0)])
        got, want = chat_log.token_usage_stream(stream, prices, "1 hour"), logs.token_usage(table, prices, "1 hour")
    same(run(got, f"windows_{kind}", spark), want)


def test_ends_in_the_millisecond_of_their_start(rocks, tmp_path):  # noqa: F811
    spark = rocks
    log = [("started", "a", 700), ("cancelled", "a", 0), ("started", "b", 999), ("completed", "b", 900_000_000), ("started", "c", 0), ("failed", "c", 900_001_000), ("started", "d", 999), ("failed", "d", 900_001_000)]
    rows = spark.createDataFrame(log, "event string, request_id string, us long").select("event", "request_id", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000).alias("ts"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("error_code"))
    far = [rows.where(f"event = '{event}'").limit(1).withColumns({"ts": F.lit(at).cast("timestamp"), "request_id": F.lit("z")}) for event, at in (("started", "2031-01-01"), ("completed", "2031-01-01 00:00:01"))]
    in_order.shuffled_files(rows, str(tmp_path / "in"), 3, F.hash("request_id", "event"), far[0].unionByName(far[1]))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = chat_log.lifecycle_stream(stream, DELAY, "15 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    made.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r.request_id, r.started_at.microsecond, r.ended, r.duration_ms) for r in spark.read.parquet(str(tmp_path / "out")).where("request_id != 'z'").collect()}
    assert got == {("a", 700, "cancelled", 0), ("b", 999, "completed", 900_000), ("c", 0, None, None), ("d", 999, None, None)}
