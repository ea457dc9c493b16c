"""Queries of the operators that no other query reaches, over whole driver tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import dims
from docweave.functions.identity import section_id
from docweave.operators import audits, chunking, conversations, evidence, index, logs, ranking, structure
from docweave.plans import adapters as ad
from docweave.plans import oracles
from docweave.plans.registry import CHUNKS_SQL, ENDED_SQL, FAR, NO_DELAY_TOO_LONG, QUESTIONS_SQL, answers, as_markdown, chat_log, query, streamed, through_stream
from docweave.session import shared_folder, stored
from docweave.sources import corpus, history
from docweave.streaming import chat_log as chat_log_stream
from docweave.streaming import in_order

def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


# Retrieval

ASKED_SQL = f"""asked AS (SELECT item_id AS question_id, {ad.CATEGORY_SQL.replace('doc_id', 'item_id')} AS category, CASE item_id % 3 WHEN 0 THEN 'src' || item_id % 10 WHEN 1 THEN '' END AS framework,
 CASE WHEN item_id % 4 = 3 THEN 'src' || (10 + item_id % 10) END AS service FROM benchmark)"""


@query(f"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {ASKED_SQL}
SELECT question_id, CASE WHEN question_id IN (SELECT question_id FROM groups) THEN (SELECT count(*) FROM chunks c WHERE c.category = a.category AND (a.framework IS NULL OR (a.framework <> '' AND c.framework = a.framework)) AND (a.service IS NULL OR c.service = a.service)) ELSE 0 END AS considered_count FROM asked a""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that pass each question's filters; names of filters are written in other ways, and some hold no letter."""
    k, ten = F.col("question_id"), (F.col("question_id") % 10).cast("string")
    named = {
        "category": F.element_at(F.array(*map(F.lit, ad.CATEGORIES)), (F.pmod(k, F.lit(11)) + 1).cast("int")),
        "framework": F.when(k % 3 == 0, F.concat(F.lit(" SRC-"), ten)).when(k % 3 == 1, F.lit(" - ")),
        "service": F.when(k % 4 == 3, F.concat(F.lit("Src_1"), ten)),
    }
    questions = ad.questions(spark, sf_dir).withColumns(named)
    wanted = ranking.asked(questions, composed=True)
    groups = ranking.question_terms(questions, dims.stopwords(spark), composed=True)
    return ranking.considered(wanted, index.index_fields(ad.chunks(spark, sf_dir), composed=True), groups)


@query(f"""WITH q AS (SELECT item_id AS question_id, unnest(['deploy', 'next.js', 'databases', 'xyzzy']) AS term FROM benchmark)
SELECT question_id, term, CASE term WHEN 'deploy' THEN 'deploy deployed deployment استقرار دیپلوی مستقر' WHEN 'next.js' THEN 'next.js next js nextjs نکست' WHEN 'databases' THEN 'databases دیتابیس' ELSE term END AS tokens FROM q""")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question also asks for terms that have aliases, in the aliases' own order."""
    said = ad.questions(spark, sf_dir).withColumn("text", F.lit("How to deploy Next.js with databases xyzzy?"))
    terms = ranking.question_terms(said, dims.stopwords(spark), composed=True)
    return ranking.expand_aliases(terms, dims.aliases(spark)).select("question_id", "term", F.array_join("tokens", " ").alias("tokens"))


# Structure

@query(f"""SELECT doc_id, md5({oracles.prose('text')}) AS prose, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\n', ''), '\\s+$', '')) AS code FROM documents""")
def prose_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(structure.normalize_prose(F.col("text"))).alias("prose"), F.md5(structure.normalize_code(F.col("text"))).alias("code"))


@query("""SELECT event_id, event_type || ' | —' || chr(10) || user_id || ' | — | ✓' || chr(10) || props AS lines FROM events""")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two rows, with empty and true cells and a row without any."""
    e = ad.table(spark, sf_dir, "events")
    rows = F.array(F.array(F.col("user_id").cast("string"), F.lit(" "), F.lit("true")), F.array().cast("array<string>"), F.array("props"))
    return e.select("event_id", F.array_join(structure.table_rows(F.array("event_type", F.lit("")), rows), "\n").alias("lines"))


@query(f"""WITH p AS (SELECT conv_id AS doc_id, turn, turn % 4 AS k, role, {oracles.prose("coalesce(text, '')")} AS said FROM conversations)
SELECT doc_id, turn * 2 AS pos, 'section' AS kind, md5(role) AS digest FROM p WHERE k = 0
UNION ALL SELECT doc_id, turn * 2 + 1, 'text', md5(CASE k WHEN 0 THEN said WHEN 1 THEN 'Tab: ' || role || ' ' || said WHEN 2 THEN 'Step ' || role || ' ' || said ELSE 'Note: ' || said END) FROM p WHERE said <> '' OR k > 0""")
def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = ad.table(spark, sf_dir, "conversations"), F.col("turn") % 4
    component = F.when(k == 0, "question").when(k == 1, "tab").when(k == 2, "step").otherwise("note")
    parts = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), component.alias("component"), F.col("role").alias("label"), F.col("text").alias("content"))
    return structure.labelled_blocks(parts).select("doc_id", "pos", "kind", F.md5("text").alias("digest"))


@query("""WITH r AS (SELECT user_id % 5 AS doc_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS turn, event_type, event_id FROM events)
SELECT doc_id, turn, CASE WHEN turn = 101 THEN 'diagnostic_limit_reached' ELSE event_type END AS code, CASE WHEN turn <= 100 THEN event_id END AS "offset" FROM r WHERE turn <= 101""")
def capped_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    place = F.struct(F.lit(1).alias("line"), F.lit(1).alias("column"), F.col("event_id").cast("int").alias("offset"))
    found = e.select((F.col("user_id") % 5).alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("code"), F.lit("said").alias("message"), place.alias("position"))
    got = structure.limit_diagnostics(found)
    return got.select("doc_id", F.col("turn").cast("long").alias("turn"), "code", F.col("position.offset").cast("long").alias("offset"))


@query(f"""WITH {oracles.SECTIONS}, listed AS (SELECT m.doc_id, m.pos, list(h.text ORDER BY h.pos) AS path FROM heads m JOIN heads h ON h.doc_id = m.doc_id AND h.pos <= m.pos
  WHERE NOT EXISTS (SELECT 1 FROM heads g WHERE g.doc_id = m.doc_id AND g.pos > h.pos AND g.pos <= m.pos AND g.level <= h.level) GROUP BY ALL),
parts AS (SELECT n.doc_id, section_order, coalesce(path, CAST([] AS VARCHAR[])) AS path FROM numbered n LEFT JOIN listed l ON l.doc_id = n.doc_id AND l.pos = n.head),
said AS (SELECT doc_id, section_order, list_concat([CAST(doc_id AS VARCHAR), CAST(len(path) AS VARCHAR)], path, ['', CAST(section_order AS VARCHAR)]) AS parts FROM parts)
SELECT doc_id, section_order, 'section_' || substr(sha256('section' || chr(0) || array_to_string(list_transform(parts, lambda p: strlen(p) || ':' || p), '')), 1, 24) AS section_id FROM said""")
def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = structure.build_sections(structure.compact_blocks(structure.markdown_blocks(as_markdown(spark, sf_dir))))
    own = section_id(F.col("doc_id").cast("string"), F.col("heading_path"), F.col("anchor"), F.col("section_order"))
    return found.select("doc_id", "section_order", own.alias("section_id"))


BUDGET = "(1792 - CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END)"
BREAK = "CASE WHEN contains(c, chr(10)) THEN length(c) - strpos(reverse(c), chr(10)) ELSE -1 END"


@query(f"""WITH RECURSIVE r AS (
  SELECT doc_id, 0 AS part, CAST(NULL AS VARCHAR) AS piece, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, part + 1, substr(rest, 1, e), substr(rest, e + 1) FROM (SELECT doc_id, part, rest, CASE WHEN length(rest) <= {BUDGET} THEN length(rest) WHEN {BREAK} >= floor({BUDGET} * 0.4e0) THEN {BREAK} + 1 ELSE {BUDGET} END AS e
    FROM (SELECT *, substr(rest, 1, {BUDGET}) AS c FROM r WHERE rest <> ''))
) SELECT doc_id, CAST(part - 1 AS INT) AS part, md5('```' || CASE doc_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'C++' ELSE '' END || chr(10) || piece || chr(10) || '```') AS digest FROM r WHERE part > 0""")
def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code blocks, some with a language that is none."""
    k = F.col("doc_id") % 4
    named = F.when(k == 0, F.lit("py")).when(k == 1, F.lit(" C++ ")).when(k == 2, F.lit("no language!"))
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "text", chunking.code_language(named).alias("language"))
    each = docs.select("doc_id", "language", F.posexplode(chunking.split_code(F.col("text"), F.col("language"))).alias("part", "piece"))
    return each.select("doc_id", "part", F.md5(chunking.render_code(F.col("piece"), F.col("language"))).alias("digest"))


# A whole corpus: from files to written tables

CORPUS_SQL = f"""{oracles.SECTIONS.replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0")},
blocks AS (SELECT n.doc_id * 100000 + n.section_order AS doc_id, i.pos AS block_no, CASE i.kind WHEN 'code' THEN '```' || i.language || chr(10) || i.text || chr(10) || '```' ELSE i.text END AS text
  FROM items i JOIN bodies b ON b.doc_id = i.doc_id AND b.pos = i.pos JOIN numbered n ON n.doc_id = b.doc_id AND n.head IS NOT DISTINCT FROM b.head), tl AS (SELECT * FROM blocks), """


@query("WITH RECURSIVE " + CORPUS_SQL + oracles.packed_sql("string_split(content, ' ')", blocks="tx AS (SELECT 1)") + """
SELECT 'files' AS what, '' AS detail, count(*) AS n FROM documents UNION ALL SELECT 'documents', '', count(DISTINCT doc_id) FROM sections UNION ALL SELECT 'chunks', '', count(*) FROM ordered
UNION ALL SELECT 'skipped', CASE WHEN doc_id % 3 = 0 THEN 'empty_source' ELSE 'no_retrievable_content' END, count(*) FROM documents WHERE doc_id % 5 = 0 GROUP BY 2
UNION ALL SELECT 'diagnostics', 'duplicate_section_anchor', count(*) FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, section_order % 3 ORDER BY section_order) AS turn FROM sections WHERE heading IS NOT NULL) WHERE turn > 1 HAVING count(*) > 0""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus built from Markdown, written and read back: some files are blank or hold a title only, and anchors repeat."""
    k = F.col("doc_id")
    docs = as_markdown(spark, sf_dir).withColumn("raw", F.when(k % 5 == 0, F.when(k % 3 == 0, F.lit(" \n")).otherwise(F.lit("# Only a title"))).otherwise(F.col("raw")))
    rows = stored(structure.sectioned(structure.compact_blocks(structure.markdown_blocks(docs))))
    by, _, _ = structure.sections_of(rows)
    # anchors by the section's number, so that they repeat whatever the headings are; only markers meet them
    anchors = by.select("doc_id", "section_no", F.concat(F.lit("a"), (F.col("section_order") % 3).cast("string")).alias("anchor"))
    marks = rows.where("marker").drop("anchor").join(anchors, ["doc_id", "section_no"], "left")
    sections, blocks, doubled = structure.sections_of(rows.where("NOT marker").unionByName(stored(marks)))
    sections = stored(sections)
    chunks = chunking.number_chunks(chunking.pack_chunks(chunking.expand_blocks(stored(blocks))))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    made = {"files": docs.select("doc_id", ad.category().alias("category")), "documents": sections.select("doc_id").distinct(), "chunks": chunks, "skipped": structure.classify_skips(docs, sections), "diagnostics": doubled}
    corpus.write_corpus(path, **made)
    return audits.corpus_counts(*(spark.read.parquet(f"{path}/{name}") for name in made))


# Evidence

@query("""SELECT page_id, md5('{"citation":' || page_id || ',"title":' || to_json(url) || ',"section":null,"officialUrl":' || to_json(url) || ',"content":' || to_json(html) || '}') AS digest FROM pages""")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ad.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(evidence.serialize_evidence(F.col("page_id"), F.col("url"), null_of("string"), F.col("url"), F.col("html"))).alias("digest"))


@query("""SELECT item_id AS question_id, 'User:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '{"framework":"django"}' ELSE '{}' END || chr(10) || chr(10) || 'Said:' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '[{"role":"user","content":"one"}]' ELSE '[]' END
 || chr(10) || chr(10) || 'Known:' || chr(10) || '[]' || chr(10) || chr(10) || 'Asked:' || chr(10) || text AS prompt FROM benchmark""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    rows = ad.table(spark, sf_dir, "benchmark").select(
        k.alias("question_id"), "text", F.when(k % 2 == 0, F.struct(F.lit("django").alias("framework"))).alias("preferences"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("one").alias("content")))).alias("recent"), null_of("string").alias("formatted"),
    )
    return evidence.prompt_rows(rows, {"preferences": "User", "recent": "Said", "formatted": "Known", "text": "Asked"})


@query("""SELECT conv_id * 1000 + turn AS answer_id, CASE turn % 3 WHEN 1 THEN '1 analyzed file' ELSE '2 analyzed files' END AS descriptor FROM conversations WHERE role = 'assistant' AND turn % 3 > 0""")
def project_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = answers(spark, sf_dir).select("answer_id", (F.col("turn") % 3).alias("n_files"))
    return evidence.project_items(said).select("answer_id", "descriptor")


# Files

#: More than the 32 folders up to which Spark lists one after the other.
SHARDS = 64


def write_pages(pages: DataFrame, root: str) -> None:
    """A file for each page below folders that one task alone fills.

    Such a folder moves into place whole, so the end of the write has no step for each page, and
    the tree is listed by as many tasks as there are folders.
    """
    shard = F.concat_ws("-", F.spark_partition_id().cast("string"), F.pmod(F.xxhash64("page_id"), F.lit(SHARDS)).cast("string"))
    pages.select("page_id", "html", shard.alias("shard")).write.partitionBy("shard", "page_id").text(root)


@query("""SELECT page_id, strlen(html) + 1 AS length, md5(html || chr(10)) AS digest FROM pages WHERE html IS NOT NULL AND strpos(html, chr(10)) = 0 AND strlen(html) + 1 <= 3000""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a tree of files and scanned; large ones are left out by their length, before they are read."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    pages = ad.table(spark, sf_dir, "pages").where("html IS NOT NULL").where(~F.contains("html", F.lit("\n")))
    write_pages(pages, root)
    small, _ = corpus.enforce_size(corpus.scan_corpus(spark, root, "*.txt"), 3000)
    return small.select(F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("page_id"), "length", F.md5("raw").alias("digest"))


# Conversations

PART = {"click": "text", "view": "citation", "signup": "agent-state", "purchase": "outcome", "error": "error"}


@query("""WITH p AS (SELECT user_id AS request_id, event_id AS seq, event_type, CASE WHEN event_type = 'view' THEN '{"id":"c' || event_id % 7 || '","at":' || event_id || '}' ELSE 'p' || event_id || ' ' END AS payload FROM events),
c AS (SELECT request_id, arg_min(payload, seq) AS payload, min(seq) AS seq FROM p WHERE event_type = 'view' GROUP BY request_id, seq % 7), cc AS (SELECT request_id, string_agg(payload, ',' ORDER BY seq) AS citations FROM c GROUP BY ALL)
SELECT p.request_id, md5(coalesce(string_agg(payload, '' ORDER BY seq) FILTER (event_type = 'click'), '')) AS digest, coalesce(any_value(citations), '') AS citations, arg_max(payload, seq) FILTER (event_type = 'signup') AS agent_state,
 arg_max(payload, seq) FILTER (event_type = 'purchase') AS outcome, arg_max(payload, seq) FILTER (event_type = 'error') AS error FROM p LEFT JOIN cc USING (request_id) GROUP BY p.request_id""")
def folded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in PART.items() for x in pair)), F.col("event_type"))
    said = F.when(F.col("event_type") == "view", F.format_string('{"id":"c%d","at":%d}', F.col("event_id") % 7, F.col("event_id"))).otherwise(F.concat(F.lit("p"), F.col("event_id").cast("string"), F.lit(" ")))
    got = conversations.fold_parts(e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), kind.alias("type"), said.alias("payload")))
    return got.select("request_id", F.md5("text").alias("digest"), F.array_join("citations", ",").alias("citations"), "agent_state", "outcome", "error")


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT request_id, md5(text) AS digest, '{"id":"c0","at":0},{"id":"c1","at":1}' AS citations, CASE WHEN turn % 5 = 0 THEN 'broke' END AS error, CASE WHEN turn % 5 > 0 THEN 'done' END AS outcome FROM a""")
def streamed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in parts - words, citations of which ids repeat, and an end - by a stream over shuffled files."""
    t = ad.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    cited = F.transform(F.array(*map(F.lit, range(4))), lambda k: F.struct(F.lit("citation").alias("type"), F.format_string('{"id":"c%d","at":%d}', k % 2, k).alias("payload")))
    said = F.transform(F.split("text", "(?<= )"), lambda w: F.struct(F.lit("text").alias("type"), w.alias("payload")))
    end = F.when(F.col("turn") % 5 == 0, F.struct(F.lit("error").alias("type"), F.lit("broke").alias("payload"))).otherwise(F.struct(F.lit("outcome").alias("type"), F.lit("done").alias("payload")))
    parts = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.posexplode(F.concat(cited, said, F.array(end))).alias("seq", "p"))
    parts = parts.select("request_id", "seq", "p.type", "p.payload", F.timestamp_seconds(F.col("seq") + 1_700_000_000).alias("ts"))
    got = through_stream(parts, "ts", "request_id", "payload", in_order.part_stream)
    return got.where("request_id >= 0").select("request_id", F.md5("text").alias("digest"), F.array_join("citations", ",").alias("citations"), "error", "outcome")


@query("""SELECT event_id AS entry_id, CASE WHEN event_id % 2 = 0 THEN 'stream' ELSE 'local' END AS text, CASE WHEN event_id % 5 = 0 THEN 'E' WHEN event_id % 7 = 0 THEN 'L' END AS error,
 CASE WHEN event_id % 3 = 0 THEN 'cancelled' WHEN event_id % 11 = 0 OR event_id % 5 = 0 THEN 'failed' WHEN event_id % 4 > 0 THEN 'completed' ELSE 'running' END AS state FROM events""")
def entry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    flags = {"aborted": k % 3 == 0, "disconnected": k % 11 == 0, "finished": k % 4 > 0}
    texts = {"stream_text": F.when(k % 2 == 0, "stream"), "local_text": F.lit("local"), "stream_error": F.when(k % 5 == 0, "E"), "local_error": F.when(k % 7 == 0, "L")}
    rows = ad.table(spark, sf_dir, "events").select(k.alias("entry_id"), *(c.alias(n) for n, c in {**texts, **flags}.items()))
    return conversations.entry_state(rows)


@query("""SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'preview' WHEN 1 THEN 'live' ELSE 'bad' END AS mode, CASE event_id % 8 WHEN 0 THEN 'django' END AS framework FROM events""")
def stored_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of eight records break one rule each."""
    texts = [
        '{"userContext":{"framework":"django"},"connectionMode":"preview","sendOnEnter":true}', '{"userContext":{},"connectionMode":"live","sendOnEnter":false}',
        '{"userContext":{},"connectionMode":"other","sendOnEnter":true}', '{"userContext":{},"connectionMode":"live","sendOnEnter":"true"}', '{"userContext":{},"connectionMode":"live","sendOnEnter":true,"more":1}',
        '{"connectionMode":"live","sendOnEnter":true}', '{"userContext":{"answerDepth":"deep"},"connectionMode":"live","sendOnEnter":true}', "[1]",
    ]
    k = F.col("event_id")
    rows = ad.table(spark, sf_dir, "events").select(k.alias("id"), F.element_at(F.array(*map(F.lit, texts)), (k % 8 + 1).cast("int")).alias("json"))
    good, bad = conversations.read_preferences(rows)
    return good.select("id", F.col("connectionMode").alias("mode"), F.col("userContext.framework").alias("framework")).unionByName(bad.select("id", F.lit("bad").alias("mode"), null_of("string").alias("framework")))


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'x' || event_id END AS framework, CASE event_type WHEN 'click' THEN 'beginner' WHEN 'view' THEN 'advanced' END AS "experienceLevel" FROM events""")
def user_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    level = F.when(kind == "click", "beginner").when(kind == "view", "advanced").otherwise(kind)
    rows = ad.table(spark, sf_dir, "events").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("\t x"), k.cast("string"), F.lit(" \n"))).otherwise(F.lit(" \n")).alias("framework"), level.alias("experienceLevel"))
    return conversations.normalize_user_context(rows)


@query("""WITH c AS (SELECT user_id AS owner FROM events WHERE event_type = 'click'), n AS (SELECT owner, count(*) AS n FROM c GROUP BY ALL)
SELECT owner, CASE WHEN owner % 4 >= 2 OR n > 200 THEN 0 ELSE n END AS n_records, CASE WHEN owner % 4 >= 2 OR n > 200 THEN 0 WHEN owner % 4 = 1 THEN 0 ELSE n END AS n_entries FROM n""")
def stored_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of both schemas and spoilt ones, read, written and read again; those of too many records are spoilt too."""
    e, owner = ad.table(spark, sf_dir, "events").where("event_type = 'click'"), F.col("user_id")
    at, key = F.lit("2024-01-02T03:04:05.000Z"), F.col("event_id").cast("string")
    entry = F.struct(F.concat(F.lit("e"), key).alias("id"), F.lit("why").alias("prompt"), at.alias("sentAt"), F.lit("live").alias("transportMode"), F.lit(1).alias("more"))
    record = F.struct(
        F.concat(F.lit("c"), key).alias("id"), F.when(owner % 4 == 2, F.lit(" ")).otherwise(F.lit("title")).alias("title"), at.alias("updatedAt"), F.lit(False).alias("pinned"), F.lit(True).alias("archived"),
        F.when(owner % 4 != 1, F.array(entry)).alias("entries"), F.when(owner % 4 == 3, F.lit("x")).alias("unknown"),
    )
    texts = e.groupBy(owner.alias("owner")).agg(F.to_json(F.collect_list(record)).alias("json"))
    found, bad = history.read_history(texts)
    again, none = history.read_history(history.write_history(found))
    got = again.groupBy("owner").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("entries")).alias("n_entries"))
    return got.unionByName(bad.unionByName(none).select("owner", F.lit(0).cast("long").alias("n_records"), F.lit(0).cast("long").alias("n_entries")))


# Logs

@query(f"""WITH {ENDED_SQL}, ok AS (SELECT *, duration_ms <= 900000 AS within FROM l)
SELECT request_id, CASE WHEN within THEN ended END AS ended, CASE WHEN within THEN duration_ms END AS duration_ms FROM ok""")
def streamed_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends joined as streams over shuffled files; starts without an end come once the watermark has passed them."""
    log = chat_log(spark, sf_dir)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    far = [log.where("event = 'started'").limit(1).withColumns({"ts": F.lit(FAR).cast("timestamp"), "request_id": F.lit(-1).cast("long")})]
    far.append(far[0].withColumns({"ts": F.lit(f"{FAR} 00:00:01").cast("timestamp"), "event": F.lit("completed")}))
    in_order.shuffled_files(log, f"{path}/in", 3, F.hash("request_id", "event"), far[0].unionByName(far[1]))
    read = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streamed(chat_log_stream.lifecycle_stream(read, NO_DELAY_TOO_LONG), f"{path}/out")
    return spark.read.parquet(f"{path}/out").where("request_id >= 0").select("request_id", "ended", "duration_ms")


@query("""SELECT event_id AS request_id, 'started' AS event, epoch_us(ts) // 1000 AS ms FROM events
UNION ALL SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'cancelled' END, epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, 'first_chunk', epoch_us(ts) // 1000 + CAST(round(value * 500) AS BIGINT) FROM events WHERE event_type IN ('purchase', 'signup')""")
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the log with the listed fields; its prompts are gone."""
    log = logs.redact_log(chat_log(spark, sf_dir).withColumn("evidence", F.lit("secret")))
    return log.select("request_id", "event", F.unix_millis("ts").alias("ms"))


@query(f"WITH {ENDED_SQL} SELECT CAST(request_id AS VARCHAR) AS request_id, ended, coalesce(duration_ms, -1) AS duration_ms FROM l")
def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines of JSON, read as a stream and written again; then the life cycle of each request."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    said = chat_log(spark, sf_dir).withColumn("request_id", F.col("request_id").cast("string"))
    said.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    streamed(chat_log_stream.read_log_stream(spark, path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), f"{path}-rows")
    return logs.lifecycle(spark.read.parquet(f"{path}-rows")).select("request_id", "ended", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))
