"""From requests to what an answer is written from: routes, matches, contexts and citations in one job.

A request row is that of :mod:`docweave.operators.routing`, and may have category, framework and service as
filters (``filter_category`` and so on).  ``shown`` has what evidence shows of a chunk: chunk_id, title, heading,
published_url, anchor, path, category and content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import dims
from docweave.operators import evidence, ranking, routing
from docweave.operators.index import Index
from docweave.session import cut, scratch, stored

FILTERS = ("category", "framework", "service")
#: Matches that a request asks for.
LIMIT = 6


def answer_requests(requests: DataFrame, built: Index, shown: DataFrame, limit: int = LIMIT, composed: bool = False) -> dict[str, DataFrame]:
    """routes (with outcome), matches, contexts and citations; only requests that route to retrieval are looked up.

    Every request has a row in routes; a request that retrieves has a context even where nothing matches.
    """
    spark = requests.sparkSession
    routed = cut(routing.route(requests, dims.intents(spark), composed))
    given = [F.col(f"filter_{c}").alias(c) for c in FILTERS if f"filter_{c}" in requests.columns]
    filters = requests.select("request_id", *given)
    asks = routed.where("route = 'retrieve'").select("request_id", F.col("retrieval_text").alias("text"), F.lit(float(limit)).alias("limit"))
    asks = stored((asks.join(filters, "request_id") if given else asks).withColumnRenamed("request_id", "question_id"))
    found, outcome = ranking.retrieve(asks, built, dims.stopwords(spark), dims.aliases(spark), composed)
    matches = stored(found.select("question_id", "rank", "chunk_id", "score", "matched_terms"))
    packed, contexts = evidence.pack_context(matches.select("question_id", "rank", "chunk_id").join(evidence.packable(shown), "chunk_id"))
    cited = evidence.citations(packed.select("question_id", "citation_index", "chunk_id").join(evidence.shortened(shown), "chunk_id"))
    asked = asks.select(F.col("question_id").alias("request_id")).join(contexts.withColumnRenamed("question_id", "request_id"), "request_id", "left")
    kinds = outcome.select(F.col("question_id").alias("request_id"), F.col("kind").alias("outcome"), "n_matches", "considered_count")
    return {
        "routes": routed.join(kinds, "request_id", "left"),
        "matches": matches.withColumnRenamed("question_id", "request_id"),
        "contexts": asked.withColumn("formatted", F.coalesce("formatted", F.lit("[]"))),
        "citations": cited.withColumnRenamed("question_id", "request_id"),
    }


def cite_answers(answers: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of answers (request_id, answer) the citations that they refer to, in order, and their evidence status."""
    own = answers.withColumnRenamed("request_id", "answer_id")
    found = cited.withColumnRenamed("request_id", "answer_id").withColumn("pos", F.col("display_index"))
    referenced = evidence.referenced_citations(own, found)
    status = evidence.evidence_status(own, referenced)
    return tuple(rows.withColumnRenamed("answer_id", "request_id") for rows in (referenced, status))


def answer_stream(requests: DataFrame, opened: Callable[[], Index], shown: Callable[[], DataFrame], path: str, limit: int = LIMIT, composed: bool = False):
    """A writer that answers each micro-batch of a stream of requests and writes its tables below ``path``.

    The index is opened once for a batch, so a revision published meanwhile serves the next one.  A batch that is
    run again after a loss replaces what it wrote.  Start it with a checkpoint location and a trigger.
    """

    def answer(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            for name, rows in answer_requests(stored(batch), opened(), shown(), limit, composed).items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return requests.writeStream.foreachBatch(answer)
