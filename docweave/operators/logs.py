"""Request logs in batch: limits, life cycles, failures, rates, usage and redaction."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import dims
from docweave.functions.text import strip
from docweave.session import stored


ENDS = ("completed", "failed", "cancelled")


def rate_limit_replay(log: DataFrame, most: int = 20, window_ms: int = 60_000) -> DataFrame:
    """Each request of (request_id, key, ms) with ``allowed`` and ``retry_after_ms``.

    A window begins with the key's first request that finds none open.  Rows of a key are read
    in order as a stream of batches and only the open window is held, so a client that sends a
    third of the log needs no more memory than another.
    """
    kinds = dict(log.dtypes)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, reset = None, 0, -1
        seen = False
        for rows in batches:
            allowed, retry = [], []
            for own, at in zip(rows["key"], rows["ms"]):
                if not seen or own != key or reset <= at:
                    key, count, reset, seen = own, 1, at + window_ms, True
                    allowed.append(True)
                    retry.append(0)
                elif count >= most:
                    allowed.append(False)
                    retry.append(max(1, reset - at))
                else:
                    count += 1
                    allowed.append(True)
                    retry.append(0)
            yield pd.DataFrame({"request_id": rows["request_id"], "key": rows["key"], "ms": rows["ms"], "allowed": allowed, "retry_after_ms": retry})

    dealt = log.select("request_id", "key", "ms").repartition("key").sortWithinPartitions("key", "ms", "request_id")
    return dealt.mapInPandas(replay, f"request_id {kinds['request_id']}, key {kinds['key']}, ms long, allowed boolean, retry_after_ms long")


def rate_limit_key(real_ip: Column, forwarded: Column) -> Column:
    """Digest of the client's address, as far as headers tell it."""
    first = F.nullif(strip(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit(""))
    return F.sha2(F.substring(F.coalesce(F.nullif(strip(real_ip), F.lit("")), first, F.lit("unidentified-client")), 1, 128), 256)


def retry_after_seconds(ms: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(ms / 1000)).cast("int")


def lifecycle(log: DataFrame) -> DataFrame:
    """One row a request from its events (request_id, event, ts, outcome, error_code).

    Events are started, first_chunk, and the ends completed, failed and cancelled, of which the first counts.
    """
    end = F.when(F.col("event").isin(*ENDS), F.struct("ts", "event", "outcome", "error_code"))
    at = lambda event: F.min(F.when(F.col("event") == event, F.col("ts")))
    rows = log.groupBy("request_id").agg(at("started").alias("started_at"), at("first_chunk").alias("chunk_at"), F.min(end).alias("e"))
    return rows.where("started_at IS NOT NULL").select(
        "request_id", "started_at", F.col("e.event").alias("ended"), F.col("e.outcome").alias("outcome"), F.col("e.error_code").alias("error_code"),
        (F.unix_millis("e.ts") - F.unix_millis("started_at")).alias("duration_ms"), (F.unix_millis("chunk_at") - F.unix_millis("started_at")).alias("first_chunk_ms"),
    )


def timeouts(log: DataFrame, limit_ms: int = 45_000, first_chunk_ms: int | None = 15_000) -> DataFrame:
    """Requests that were started and broke a limit, and which of the two.

    ``first_chunk``: neither a first chunk nor an end came in ``first_chunk_ms`` (None: a log without
    such events); else ``total``: no end came in ``limit_ms``.
    """
    sign = F.least("first_chunk_ms", "duration_ms")
    waited = F.lit(False) if first_chunk_ms is None else sign.isNull() | (sign > first_chunk_ms)
    late = F.col("duration_ms").isNull() | (F.col("duration_ms") > limit_ms)
    which = F.when(waited, "first_chunk").when(late, "total")
    return lifecycle(log).withColumn("broke", which).where("broke IS NOT NULL").select("request_id", "started_at", F.lit("TIMEOUT").alias("error_code"), "broke")


def classify_failures(failures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds code, status and retryable to rows of cause and phase; unknown causes fall back by phase."""
    table = known if known is not None else dims.failures(failures.sparkSession)
    near = failures.join(table, ["cause", "phase"], "left")
    stream = F.col("phase") == "streaming"
    return near.withColumns(
        {
            "code": F.coalesce("code", F.when(stream, "STREAM_INTERRUPTED").otherwise("INTERNAL_ERROR")),
            "status": F.coalesce("status", F.lit(500)),
            "retryable": F.coalesce("retryable", stream),
        }
    )


def outcome_rates(ended: DataFrame, window: str = "1 day") -> DataFrame:
    """Counts and latencies by window of ``started_at``, outcome and error code.

    The percentile is exact: the least latency that 95 of 100 don't exceed.  Latencies are counted, then the
    stretch of 1000 ms that holds the rank is found, and the rank's place in it, so no group meets in one task.
    """
    keys = ["w", "outcome", "error_code"]
    rows = ended.select(F.window("started_at", window).getField("start").alias("w"), "outcome", "error_code", "duration_ms", F.floor(F.col("duration_ms") / 1000).alias("s"))
    counted = stored(rows.groupBy(*keys, "s", "duration_ms").agg(F.count(F.lit(1)).alias("n")))
    sums = {"n": F.sum("n"), "_known": F.sum(F.when(F.col("duration_ms").isNotNull(), F.col("n"))), "_sum": F.sum(F.col("duration_ms") * F.col("n")), "max_ms": F.max("duration_ms")}
    whole = counted.groupBy(*keys).agg(*(c.alias(name) for name, c in sums.items()))
    upto = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = counted.where("s IS NOT NULL").groupBy(*keys, "s").agg(F.sum("n").alias("_n"))
    rank = F.expr("(sum(_n) OVER (PARTITION BY w, outcome, error_code) * 95 + 99) DIV 100")
    ranks = sizes.withColumns({"_rank": rank, "_upto": F.sum("_n").over(upto.partitionBy(*keys).orderBy("s"))})
    ranks = ranks.where("_upto >= _rank AND _upto - _n < _rank").select(*(F.col(k).alias(f"_{k}") for k in [*keys, "s"]), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    same = lambda a, names: functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(F.col(f"_{k}")) for k in names])
    held = counted.join(ranks, same(counted, [*keys, "s"]))
    reached = held.withColumn("_upto", F.sum("n").over(upto.partitionBy(*keys).orderBy("duration_ms"))).where("_upto >= _rank")
    found = reached.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("duration_ms").alias("p95_ms"))
    return whole.join(found, same(whole, keys), "left").select(F.col("w").alias("window_start"), "outcome", "error_code", "n", (F.col("_sum") / F.col("_known")).alias("mean_ms"), "max_ms", "p95_ms")


def token_usage(usage: DataFrame, prices: DataFrame, window: str = "1 day") -> DataFrame:
    """Tokens and cost by window, provider and model; prices are per token."""
    sums = usage.groupBy(F.window("ts", window).alias("w"), "provider", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))
    return sums.join(prices, ["provider", "model"], "left").select(
        F.col("w.start").alias("window_start"), "provider", "model", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), cost.alias("cost")
    )


def duplicate_requests(requests: DataFrame) -> DataFrame:
    """Later rows with a client request id that was seen before."""
    turn = F.row_number().over(Window.partitionBy("client_request_id").orderBy("ms", "request_id"))
    return requests.where("client_request_id IS NOT NULL").withColumn("turn", turn).where("turn > 1")


ALLOWED = ("event", "request_id", "ts", "duration_ms", "outcome", "error_code")


def redact_log(log: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Only the listed fields, whatever else a log holds."""
    return log.select(*(c for c in allowed if c in log.columns))
