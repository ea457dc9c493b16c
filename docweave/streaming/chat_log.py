"""The request log as a stream: reading, limits per client, time-outs, rates and usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from docweave.operators.logs import ENDS, token_usage

LOG = "event string, request_id string, ts timestamp, outcome string, error_code string"


def read_log_stream(spark: SparkSession, path: str, schema: str = LOG, kind: str = "json", late: str = "10 minutes", **options: str) -> DataFrame:
    """Events with a fixed schema and a watermark on ``ts``."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(path).withWatermark("ts", late)


class Deadline(StatefulProcessor):
    """Reports a request whose first chunk or end has not come when its time is over."""

    def __init__(self, limit_ms: int, first_chunk_ms: int):
        self.limit_ms, self.first_chunk_ms = limit_ms, first_chunk_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField(c, LongType()) for c in ("started", "chunk", "ended")]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, chunk, ended = self.held.get() if self.held.exists() else (-1, -1, -1)
        for batch in rows:
            for event, at in zip(batch["event"], batch["ms"].astype(int)):
                if event == "started":
                    started = int(at)
                    for limit in {self.limit_ms, self.first_chunk_ms or self.limit_ms}:
                        self.handle.registerTimer(started + limit)
                elif event == "first_chunk":
                    chunk = int(at) if chunk < 0 else min(chunk, int(at))
                elif event in ENDS:
                    ended = int(at) if ended < 0 else min(ended, int(at))
        self.held.update((started, chunk, ended))
        yield self.late(key, started, None)

    def late(self, key: tuple, started: int, broke: str | None) -> pd.DataFrame:
        n = int(broke is not None)
        return pd.DataFrame({"request_id": pd.Series([key[0]] * n, dtype="str"), "started_ms": pd.Series([started] * n, dtype="int64"), "broke": pd.Series([broke] * n, dtype="str")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        started, chunk, ended = self.held.get()
        signs = [at for at in (chunk, ended) if at >= 0]
        broke = None
        if self.first_chunk_ms and (not signs or min(signs) > started + self.first_chunk_ms):
            broke = "first_chunk"
        elif expiredTimerInfo.getExpiryTimeInMs() >= started + self.limit_ms and (ended < 0 or ended > started + self.limit_ms):
            broke = "total"
        if broke or expiredTimerInfo.getExpiryTimeInMs() >= started + self.limit_ms:
            self.held.clear()
        yield self.late(key, started, broke)

    def close(self) -> None:
        pass


def timeout_stream(log: DataFrame, limit_ms: int = 45_000, first_chunk_ms: int | None = 15_000) -> DataFrame:
    """Requests of a log stream with a watermark that broke a limit of event time, as ``logs.timeouts`` finds them."""
    return log.select("request_id", "event", "ts", F.unix_millis("ts").alias("ms")).groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=Deadline(limit_ms, first_chunk_ms or 0), outputStructType="request_id string, started_ms long, broke string", outputMode="Append", timeMode="EventTime"
    )


def lifecycle_stream(log: DataFrame, late: str = "10 minutes", longest: str = "15 minutes") -> DataFrame:
    """Starts with the end of the same request within ``longest``; a start without one comes, with nulls, once the watermark says that none can come.

    Times are compared in whole milliseconds, as durations are: an end in the millisecond of its start counts, whatever their microseconds.
    """
    milli = lambda c: F.date_trunc("millisecond", c)
    start = log.where("event = 'started'").select(F.col("request_id"), F.col("ts").alias("_at"), milli("ts").alias("started_at")).withWatermark("started_at", late)
    end = log.where(F.col("event").isin(*ENDS)).select(F.col("request_id").alias("_id"), milli("ts").alias("ended_at"), "event", "outcome", "error_code").withWatermark("ended_at", late)
    near = (F.col("request_id") == F.col("_id")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"))
    return start.join(end, near, "left_outer").select("request_id", F.col("_at").alias("started_at"), F.col("event").alias("ended"), "outcome", "error_code", (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"))


def outcome_rate_stream(ended: DataFrame, window: str = "5 minutes") -> DataFrame:
    """``logs.outcome_rates`` of a stream with a watermark on ``ts``: a window is told when it is over, and rows later than the watermark are dropped."""
    return ended.groupBy(F.window("ts", window).alias("w"), "outcome", "error_code").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("long").alias("p95_ms")
    ).select(F.col("w.start").alias("window_start"), "outcome", "error_code", "n", "mean_ms", "max_ms", "p95_ms")


def token_usage_stream(usage: DataFrame, prices: DataFrame, window: str = "1 day") -> DataFrame:
    """``logs.token_usage`` of a stream with a watermark on ``ts``, joined with the prices at hand."""
    return token_usage(usage, prices, window)


def first_requests(requests: DataFrame) -> DataFrame:
    """A stream without repeats of a client request id within the watermark."""
    return requests.dropDuplicatesWithinWatermark(["client_request_id"])
