"""Stored conversation histories: reading JSON of either schema, and writing it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import strip
from docweave.operators.conversations import CONNECTION_MODES, OPAQUE

# Names, bounds and states of stored records.
MOST_RECORDS, MOST_ENTRIES = 200, 100
FIELDS = ["id", "title", "updatedAt", "pinned", "archived"]
ANSWER_PARTS = ["analysis", "problemDetected", "whyThisHappens", "recommendedFix"]
AGENT_STATES = ("understanding", "clarification_required", "retrieving", "generating")
OUTCOMES = ("completed", "cancelled", "failed")
ERRORS = ("RATE_LIMITED", "INVALID_INPUT", "RETRIEVAL_FAILED", "MODEL_UNAVAILABLE", "STREAM_INTERRUPTED", "TIMEOUT", "INTERNAL_ERROR")
TONES = ("property", "string", "keyword", "punctuation", "plain")
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"

TOKEN = "struct<text:string,tone:string>"
CODE = f"struct<fileName:string,language:string,lines:array<struct<tokens:array<{TOKEN}>,important:boolean>>,note:string>"
RESPONSE = "struct<" + ",".join(f"{p}:string" for p in ANSWER_PARTS) + f",codeExample:{CODE}>"
SOURCE = "struct<id:string,title:string,url:string,sectionHeading:string,documentationPath:string,snippet:string,serviceCategory:string>"
ENTRY = (
    f"struct<id:string,prompt:string,sentAt:string,response:{RESPONSE},agentState:string,outcomeStatus:string,"
    f"citations:array<struct<id:string,displayIndex:int,source:{SOURCE}>>,suggestions:array<struct<id:string,label:string,prompt:string>>,"
    "liveText:string,error:struct<code:string,message:string,requestId:string,retryable:boolean>,cancelled:boolean,transportMode:string>"
)
RECORD = "struct<" + ",".join(f"{c}:{'boolean' if c in ('pinned', 'archived') else 'string'}" for c in FIELDS) + f",entries:array<{ENTRY}>>"


def sized(text: Column, least: int, most: int, ends: bool = False) -> Column:
    size = F.length(strip(text)) if ends else F.length(text)
    return F.coalesce((size >= least) & (size <= most), F.lit(False))


def maybe(value: Column, rule: Column) -> Column:
    return value.isNull() | F.coalesce(rule, F.lit(False))


def each(values: Column, most: int, rule: Callable[[Column], Column]) -> Column:
    """A list that may be missing, of at most ``most`` values that keep the rule."""
    return maybe(values, (F.size(values) <= most) & F.forall(values, rule))


def opaque(text: Column) -> Column:
    return F.coalesce(text.rlike(OPAQUE), F.lit(False))


def instant(text: Column) -> Column:
    return F.coalesce(text.rlike(INSTANT), F.lit(False)) & F.try_to_timestamp(text).isNotNull()


def all_of(*rules: Column) -> Column:
    found = F.lit(True)
    for rule in rules:
        found = found & rule
    return found


def response_ok(r: Column) -> Column:
    code = r["codeExample"]
    token = lambda t: sized(t["text"], 0, 8000) & maybe(t["tone"], t["tone"].isin(*TONES))
    lines = code["lines"].isNotNull() & each(code["lines"], 2000, lambda x: x["tokens"].isNotNull() & each(x["tokens"], 100, token))
    shown = all_of(sized(code["fileName"], 0, 256), sized(code["language"], 0, 64), lines, maybe(code["note"], sized(code["note"], 0, 8000)))
    return all_of(*(sized(r[p], 0, 48_000) for p in ANSWER_PARTS), maybe(code, shown))


Origins = list[tuple[str, str | None]]


def on_origin(url: Column, origins: Origins) -> Column:
    """Whether a link names a listed host and lies under its path, where one is given."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    found = F.lit(False)
    for name, prefix in origins:
        under = F.lit(True) if prefix is None else (path == prefix) | path.startswith(f"{prefix}/")
        found = found | ((host == name) & under)
    return F.coalesce(found, F.lit(False))


def citation_ok(c: Column, origins: Origins | None = None) -> Column:
    s = c["source"]
    texts = all_of(*(maybe(s[f], sized(s[f], 1, most, True)) for f, most in (("sectionHeading", 200), ("documentationPath", 500), ("snippet", 1000), ("serviceCategory", 80))))
    link = F.coalesce(F.try_parse_url(s["url"], F.lit("PROTOCOL")) == "https", F.lit(False))
    link = link if origins is None else link & on_origin(s["url"], origins)
    return all_of(opaque(c["id"]), F.coalesce(c["displayIndex"].between(1, 99), F.lit(False)), opaque(s["id"]), sized(s["title"], 1, 200, True), link, texts)


def entry_ok(e: Column, origins: Origins | None = None) -> Column:
    """Whether an entry of a transcript keeps every bound; ``origins`` are the hosts that links of citations may name (None: any)."""
    error = e["error"]
    return all_of(
        sized(e["id"], 1, 128),
        sized(e["prompt"], 1, 16_000, True),
        instant(e["sentAt"]),
        maybe(e["response"], response_ok(e["response"])),
        maybe(e["agentState"], e["agentState"].isin(*AGENT_STATES)),
        maybe(e["outcomeStatus"], e["outcomeStatus"].isin(*OUTCOMES)),
        each(e["citations"], 24, lambda c: citation_ok(c, origins)),
        each(e["suggestions"], 4, lambda s: all_of(opaque(s["id"]), sized(s["label"], 1, 120, True), sized(s["prompt"], 1, 1000, True))),
        maybe(e["liveText"], sized(e["liveText"], 0, 48_000)),
        maybe(error, all_of(error["code"].isin(*ERRORS), sized(error["message"], 1, 500, True), opaque(error["requestId"]), error["retryable"].isNotNull())),
        maybe(e["transportMode"], e["transportMode"].isin(*CONNECTION_MODES)),
    )


def record_ok(c: Column) -> Column:
    return all_of(sized(c["id"], 1, 128), sized(c["title"], 1, 80, True), instant(c["updatedAt"]), c["pinned"].isNotNull(), c["archived"].isNotNull())


def read_history(rows: DataFrame, origins: Origins | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations of owners (owner, json), and the owners whose history can't be used.

    All records follow the current schema, or all the legacy one, which has no entries (they get
    none); other fields of a record, a broken bound or more than 200 records spoil the history.
    Other fields of an entry are dropped.  An owner whose history is an empty list has one row, without a conversation.
    """
    parsed = rows.withColumn("j", F.from_json("json", "array<string>"))
    parsed = parsed.withColumn("h", F.transform("j", lambda x: F.from_json(x, RECORD)))
    keys = F.transform("j", lambda x: F.array_sort(F.json_object_keys(x)))
    legacy = F.array(*map(F.lit, sorted(FIELDS)))
    current = F.array(*map(F.lit, sorted([*FIELDS, "entries"])))
    now = F.forall(keys, lambda k: k.eqNullSafe(current)) & F.forall("h", lambda c: c["entries"].isNotNull() & each(c["entries"], MOST_ENTRIES, lambda e: entry_ok(e, origins)))
    whole = F.forall("h", record_ok) & (now | F.forall(keys, lambda k: k.eqNullSafe(legacy)))
    good = F.coalesce(F.col("h").isNotNull() & (F.size("h") <= MOST_RECORDS) & whole, F.lit(False))
    found = parsed.where(good).select("owner", F.explode_outer("h").alias("c")).select(
        "owner", F.col("c.id").alias("conv_id"), strip(F.col("c.title")).alias("title"), F.try_to_timestamp("c.updatedAt").alias("updated_at"),
        F.col("c.pinned").alias("pinned"), F.col("c.archived").alias("archived"), F.when(F.col("c").isNotNull(), F.coalesce("c.entries", F.array().cast(f"array<{ENTRY}>"))).alias("entries"),
    )
    return found, parsed.where(~good).select("owner")


def write_history(conversations: DataFrame) -> DataFrame:
    """One JSON text for each owner (an empty list where there is no conversation), newest first; a transcript that is invalid or too long becomes empty."""
    kind = f"array<{ENTRY}>"
    ok = F.col("entries").isNotNull() & each(F.col("entries"), MOST_ENTRIES, lambda e: entry_ok(e))
    entries = F.when(ok, F.col("entries")).otherwise(F.array().cast(kind))
    utc = F.date_format(F.to_utc_timestamp("updated_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = F.struct(F.col("updated_at").alias("at"), F.struct(F.col("conv_id").alias("id"), "title", utc.alias("updatedAt"), "pinned", "archived", entries.alias("entries")).alias("c"))
    listed = conversations.groupBy("owner").agg(F.sort_array(F.collect_list(F.when(F.col("conv_id").isNotNull(), record)), False).alias("r"))
    return listed.select("owner", F.to_json(F.transform("r", lambda r: r["c"])).alias("json"))
