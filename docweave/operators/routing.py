"""Where a question goes: a direct reply, a request for details, or retrieval.

A request row has request_id, message, recent (array of role and content) and, all nullable,
framework, runtime, service and preferred_language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import dims
from docweave.functions.text import is_persian, nfkc, strip


def normalize_intent(message: Column, composed: bool = False) -> Column:
    folded = F.translate(F.lower(message if composed else nfkc(message)), "يك", "یک")
    return strip(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def direct_intent(requests: DataFrame, intents: DataFrame, composed: bool = False) -> DataFrame:
    """Adds ``intent``: greeting, thanks, acknowledgement or meta, in that order, else null."""
    rows = requests.withColumn("_intent", normalize_intent(F.coalesce("message", F.lit("")), composed))
    known = intents.select(F.col("phrase").alias("_intent"), F.col("intent").alias("_said"))
    near = rows.join(known, "_intent", "left")
    meta = F.lit(False)
    for pattern in dims.META_PATTERNS:
        meta = meta | F.col("_intent").rlike(pattern)
    greeting = (F.col("_said") == "greeting") | F.col("_intent").rlike(dims.GREETING_PATTERN)
    return near.withColumn("intent", F.when(greeting, "greeting").when(F.col("_said").isNotNull(), F.col("_said")).when(meta, "meta")).drop("_intent", "_said")


def needs_clarification() -> Column:
    """Trouble is reported, but framework, stage or details are missing."""
    message = F.coalesce("message", F.lit(""))
    said = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    framework = said("framework") | said("runtime") | message.rlike(dims.FRAMEWORK_FIELD) | message.rlike(dims.FRAMEWORK)
    return message.rlike(dims.TROUBLE) & ~(framework & message.rlike(dims.STAGE) & message.rlike(dims.DETAIL))


def retrieval_text() -> Column:
    """The message, the last two recent messages and what is known about the project."""
    recent = F.coalesce("recent", F.array().cast("array<struct<role:string,content:string>>"))
    last = F.slice(recent, F.greatest(F.size(recent) - 1, F.lit(1)), 2)
    return F.concat_ws(" ", "message", F.transform(last, lambda m: m["content"]), "framework", "runtime", "service")


def route(requests: DataFrame, intents: DataFrame, composed: bool = False) -> DataFrame:
    """request_id, route, intent, language and the text to retrieve with; the first match wins."""
    rows = direct_intent(requests, intents, composed)
    where = F.when(F.col("intent").isNotNull(), "direct").when(needs_clarification(), "clarification").otherwise("retrieve")
    language = F.when(is_persian(F.coalesce("message", F.lit("")), F.col("preferred_language")), "fa").otherwise("en")
    return rows.select("request_id", where.alias("route"), "intent", language.alias("language"), retrieval_text().alias("retrieval_text"))


# Labels of the form, which the patterns of trouble, stage and detail know.
CLARIFIED = ["Original question: ", "Framework/runtime: ", "Error stage: ", "Error message/log:\n", "Additional details:\n"]


def clarified_message(original: Column, framework: Column, stage: Column, log: Column, details: Column) -> Column:
    """The follow-up that a clarification form sends; it always routes to retrieval."""
    given = lambda c: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("Not provided"))
    said = zip(CLARIFIED, (original, framework, stage, given(log), given(details)))
    return F.concat_ws("\n\n", *(F.concat(F.lit(label), answer) for label, answer in said))


def route_mix(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route", "language").agg(F.count(F.lit(1)).alias("n"))
