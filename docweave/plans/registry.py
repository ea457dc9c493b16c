"""The registered queries of the library, over whole driver tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import dims, text
from docweave.functions.identity import chunk_id, document_id
from docweave.operators import answering, audits, chunking, conversations, evidence, index, logs, policy, ranking, routing, structure
from docweave.plans import adapters as ad
from docweave.plans import oracles
from docweave.session import cut, shared_folder, stored
from docweave.sources import corpus
from docweave.streaming import in_order

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# Pieces of SQL that mirror the text functions (texts of the tables are composed already).
CANDIDATE = r"@?[\p{L}\p{N}]+(?:[._/+:-][\p{L}\p{N}]+)*"


def norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '{CANDIDATE}'), ' ')"


def toks(n: str) -> str:
    parts = "list_filter(regexp_split_to_array(regexp_replace(c, '^@', ''), '[._/+:-]+'), lambda p: p <> '')"
    joined = f"array_to_string({parts}, '')"
    return (
        f"flatten(list_transform(list_filter(string_split({n}, ' '), lambda t: t <> ''), lambda c: CASE WHEN regexp_matches(c, '[@._/+:-]') "
        f"THEN list_concat([c], {parts}, CASE WHEN {joined} NOT IN ('', c) THEN [{joined}] ELSE [] END) ELSE [c] END))"
    )


NUMBER = "CAST(regexp_extract(source, '[0-9]+') AS INT)"
CHUNKS_SQL = f"""
chunks AS (
  SELECT doc_id AS chunk_id, text AS content, regexp_extract(text, '^[^.\\n]*') AS title, {ad.PATH_SQL} AS path,
    {ad.CATEGORY_SQL} AS category, '/' || {ad.CATEGORY_SQL} || '/' || source || '/doc-' || doc_id || '/' AS published_path,
    CASE WHEN {ad.CATEGORY_SQL} = 'paas' AND {NUMBER} < 10 THEN source END AS framework,
    CASE WHEN {ad.CATEGORY_SQL} = 'dbaas' AND {NUMBER} >= 10 THEN source END AS service
  FROM documents
), fields AS (
  SELECT chunk_id, content, path, {norm('content')} AS body_text, {norm('title')} AS title_text,
    {norm("path || ' ' || published_path")} AS path_text, {norm("concat_ws(' ', category, framework, service)")} AS class_text
  FROM chunks
), tokens AS (
  SELECT chunk_id, 0 AS field, unnest({toks('body_text')}) AS token FROM fields
  UNION ALL SELECT chunk_id, 1, unnest({toks('title_text')}) FROM fields
  UNION ALL SELECT chunk_id, 3, unnest({toks('path_text')}) FROM fields
  UNION ALL SELECT chunk_id, 4, unnest({toks('class_text')}) FROM fields
), postings AS (
  SELECT token, chunk_id, count(*) FILTER (field = 0) AS tf_body, bool_or(field = 1) AS in_title, bool_or(field = 2) AS in_heading,
    bool_or(field = 3) AS in_path, bool_or(field = 4) AS in_class
  FROM tokens GROUP BY token, chunk_id
), lengths AS (SELECT chunk_id, len({toks('body_text')}) AS body_len FROM fields),
stats AS (SELECT count(*) AS n_chunks, avg(body_len) AS avg_body_len FROM lengths),
df AS (SELECT token, count(*) AS df FROM postings GROUP BY token)
"""


# Text

@query(f"SELECT doc_id, md5({norm('text')}) AS digest, length({norm('text')}) AS chars FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    return docs.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("chars"))


@query(f"""WITH t AS (SELECT doc_id, {toks('n')} AS t FROM (SELECT doc_id, {norm('text')} AS n FROM documents))
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_unique, md5(array_to_string(t, ' ')) AS digest,
  greatest(1, CAST(ceil(length(text) / 4) AS BIGINT), CAST(ceil(len(t) * 1.3e0) AS BIGINT)) AS estimated_tokens FROM t JOIN documents USING (doc_id)""")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "text", text.tokenize(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(text.unique_tokens(F.col("t"))).cast("long").alias("n_unique"),
        F.md5(F.array_join("t", " ")).alias("digest"), text.estimated_tokens(F.col("text"), F.size("t")).cast("long").alias("estimated_tokens"),
    )


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({toks('n')}) AS token FROM (SELECT doc_id, {norm('text')} AS n FROM documents)) GROUP BY ALL")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text"), composed=True).alias("tokens"))
    return text.token_frequencies(docs, "doc_id")


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{Arabic}\p{Hebrew}]')) AS r, len(regexp_extract_all(text, '\p{Latin}')) AS l, doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 2 = 0) AS persian FROM documents)
SELECT doc_id, CASE WHEN r > l THEN 'rtl' ELSE 'ltr' END AS direction, persian FROM c""")
def text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one kind of id ask for Persian, of another kind hold a Persian word at times; no text of the tables does."""
    docs, k = ad.table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    wish = F.when(k == 0, F.lit("en")).when(k == 1, F.lit(" FA-ir "))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "text", F.lit("سلام"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.text_direction(F.col("text")).alias("direction"), text.is_persian(said, wish).alias("persian"))


# The spans in the SQL's own words: links and www names to the next white space, angle or bracket; drive and absolute paths; addresses.
SPANS_SQL = r"(?:https?://|www\.)[^\s<>()]+|[A-Za-z]:\\\S+|(?:/[0-9A-Za-z_.@~:+-]+)+|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


@query(f"SELECT doc_id, len(s) AS n_spans, array_to_string(s, ' ') AS spans FROM (SELECT doc_id, regexp_extract_all(text, '{SPANS_SQL}') AS s FROM documents)")
def technical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", text.technical_spans(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.array_join("s", " ").alias("spans"))


@query("""WITH a AS (SELECT conv_id, turn, text || chr(10) || '```py' || chr(10) || 'x = ' || turn || chr(10) || '```' AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 'py' AS lang, 'x = ' || turn AS code FROM a""")
def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.lit("\n```py\nx = "), F.col("turn").cast("string"), F.lit("\n```"))
    answers = ad.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    each = answers.select("conv_id", "turn", F.explode(text.fenced_code(said)).alias("c"))
    return each.select("conv_id", "turn", F.col("c.lang").alias("lang"), F.col("c.code").alias("code"))


@query(f"""WITH s AS (SELECT doc_id, source, list_distinct({toks('n')}) AS t FROM (SELECT doc_id, source, {norm('text')} AS n FROM documents)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.t AS x, b.t AS y FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
SELECT a, b, round(CASE WHEN len(x) + len(y) = 0 THEN 1e0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END, 9) AS jaccard FROM p""")
def jaccard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.tokenize(F.col("text"), composed=True)).alias("x"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("x").alias("y"))
    return docs.join(other, "doc_id").select(F.col("doc_id").alias("a"), "b", F.round(text.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


# Sources and policy

SOURCE_SQL = f"""src AS (SELECT doc_id, text, source, {ad.PATH_SQL} AS path, {ad.CATEGORY_SQL} AS category FROM documents)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = policy.build_sources(ad.files(spark, sf_dir), dims.categories(spark, ad.CATEGORIES), dims.taxonomy(spark, ad.TAXONOMY), ad.ORIGIN, ad.REPOSITORY)
    return good


@query(f"WITH {SOURCE_SQL} SELECT doc_id, 'doc_' || substr(sha256('document' || chr(0) || strlen(path) || ':' || path), 1, 24) AS document_id FROM src")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.files(spark, sf_dir).select("doc_id", document_id(F.col("path")).alias("document_id"))


@query(f"""WITH {SOURCE_SQL} SELECT doc_id, category, CASE WHEN category = 'paas' AND {NUMBER} < 10 THEN source END AS framework,
CASE WHEN category = 'dbaas' AND {NUMBER} >= 10 THEN source END AS service, category || '/' || source || '/doc-' || doc_id AS segments FROM src""")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("doc_id", "category", "framework", "service", F.array_join("segments", "/").alias("segments"))


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN replace(path, 'src/pages', 'src/other') WHEN 2 THEN replace(path, '/doc-', '/../doc-') WHEN 3 THEN replace(path, '.mdx', '.md') ELSE path END AS path,
 doc_id % 5 AS k, {ad.CATEGORY_SQL} AS category FROM (SELECT doc_id, source, {ad.PATH_SQL} AS path FROM documents))
SELECT path, CASE WHEN k < 4 THEN 'INVALID_REPOSITORY_PATH' ELSE 'UNSUPPORTED_CATEGORY' END AS code FROM p WHERE k < 4 OR category <> 'paas'""")
def rejected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, k, path = ad.files(spark, sf_dir), F.col("doc_id") % 5, F.col("path")
    broken = (
        F.when(k == 0, F.concat(F.lit("/"), path)).when(k == 1, F.replace(path, F.lit("src/pages"), F.lit("src/other")))
        .when(k == 2, F.replace(path, F.lit("/doc-"), F.lit("/../doc-"))).when(k == 3, F.replace(path, F.lit(".mdx"), F.lit(".md"))).otherwise(path)
    )
    _, bad = policy.build_sources(files.withColumn("path", broken), dims.categories(spark, ["paas"]), dims.taxonomy(spark, ad.TAXONOMY), ad.ORIGIN, ad.REPOSITORY)
    return bad


@query(f"""WITH {SOURCE_SQL} SELECT doc_id, '{ad.ORIGIN}/' || category || '/' || source || '/doc-' || doc_id || '/' AS published_url,
'{ad.REPOSITORY}/blob/{ad.REVISION}/' || path AS repository_url, 'Doc ' || doc_id AS title FROM src""")
def derive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("doc_id", "published_url", "repository_url", policy.slug_title(F.col("segments")).alias("title"))


@query("""SELECT page_id, starts_with(url, 'https://') AND regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%1%' AS allowlisted,
CASE WHEN regexp_matches(url, '^https?://[^/\\s]') THEN 'page (' || url || ')' ELSE 'page' END AS link FROM pages""")
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ad.table(spark, sf_dir, "pages")
    origins = pages.select(policy.host_of(F.col("url")).alias("host")).distinct().where("host LIKE '%1%'").withColumn("path_prefix", F.lit(None).cast("string"))
    return policy.with_allowlisted(pages, origins).select("page_id", "allowlisted", policy.safe_link(F.lit("page"), F.col("url")).alias("link"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'SOURCE_TREE_DIRTY' WHEN strlen(text) > 20000 THEN 'FILE_TOO_LARGE' WHEN doc_id % 11 = 0 THEN 'CONTENT_HASH_MISMATCH'
WHEN doc_id % 13 = 0 THEN 'INVALID_REVISION' ELSE 'accepted' END AS code FROM documents""")
def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, size, digest and revision checks in their order, on files of which some are spoilt."""
    files = ad.files(spark, sf_dir)
    manifest = files.where("doc_id % 7 != 0").select("path")
    files = files.withColumns(
        {
            "content_hash": F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("raw", F.lit("x")), 256)).otherwise(F.col("content_hash")),
            "revision": F.when(F.col("doc_id") % 13 == 0, F.lit("main")).otherwise(F.col("revision")),
        }
    )
    code = F.coalesce(corpus.size_code(20_000), corpus.hash_code(), corpus.revision_code())
    listed, lost = corpus.verify_manifest(files, manifest)
    rows = listed.select("doc_id", F.coalesce(code, F.lit("accepted")).alias("code"))
    return rows.unionByName(lost.join(files.select("path", "doc_id"), "path").select("doc_id", "code"))


@query("""SELECT a.doc_id AS doc_id, CASE WHEN a.doc_id % 9 = 0 THEN 'removed' WHEN a.doc_id % 9 = 1 THEN 'added' ELSE 'changed' END AS change
FROM documents a WHERE a.doc_id % 9 IN (0, 1, 2)""")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash"))
    new = docs.where("document_id % 9 != 0").withColumn("content_hash", F.when(F.col("document_id") % 9 == 2, F.lit("new")).otherwise(F.col("content_hash")))
    return audits.revision_diff(docs.where("document_id % 9 != 1"), new).withColumnRenamed("document_id", "doc_id")


# Structure and chunks

def as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the first line is the title, every fourth line a heading, one code block."""
    docs = ad.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i == 0, F.lit("# ")).when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (i / 4 % 3 + 2).cast("int")), F.lit(" "))).when(i % 7 == 3, F.lit("- ")).otherwise(F.lit("")), x, F.when(i % 4 == 0, F.lit("\n")).otherwise(F.lit(""))))
    return docs.select("doc_id", F.concat(F.array_join(lines, "\n"), F.lit("\n\n```py\nx = 1\n\ny = 2\n```\n")).alias("raw"))


@query(f"WITH {oracles.MARKDOWN} SELECT *, CAST(NULL AS VARCHAR) AS anchor FROM items")
def markdown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.compact_blocks(structure.markdown_blocks(as_markdown(spark, sf_dir)))


@query(f"WITH {oracles.SECTIONS} SELECT * FROM sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = structure.build_sections(structure.compact_blocks(structure.markdown_blocks(as_markdown(spark, sf_dir))))
    return found.select("doc_id", "section_order", "heading", F.array_join("heading_path", " > ").alias("heading_path"), "anchor", "n_blocks")


@query("""SELECT page_id AS doc_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS head_title FROM pages""")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.html_head(ad.table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), "head_title")


@query(f"WITH {oracles.HTML} SELECT * FROM page_blocks")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.compact_blocks(structure.html_blocks(ad.table(spark, sf_dir, "pages")))


@query(f"""WITH {oracles.HTML}, first AS (SELECT doc_id, arg_min(text, pos) AS said FROM page_items WHERE kind = 'heading' GROUP BY doc_id)
SELECT doc_id, coalesce(said, head_title, 'Page ' || doc_id) AS title FROM page_heads LEFT JOIN first USING (doc_id)""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ad.table(spark, sf_dir, "pages")
    heads = structure.html_head(pages).select(F.col("page_id").alias("doc_id"), "head_title", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("slug"))
    return structure.pick_titles(structure.html_blocks(pages), heads).select("doc_id", "title")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'empty_source' ELSE 'no_retrievable_content' END AS reason FROM documents WHERE doc_id % 5 = 0")
def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = as_markdown(spark, sf_dir).withColumn("raw", F.when(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).otherwise(F.lit("# Only a title"))).otherwise(F.col("raw")))
    found, _, _ = structure.build_sections(structure.markdown_blocks(docs))
    return structure.classify_skips(docs, found)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one section whose lines are text blocks."""
    docs = ad.table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.lit(0).alias("section_order"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return each.withColumns({"kind": F.lit("text"), "language": F.lit(None).cast("string")})


def made_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.number_chunks(chunking.pack_chunks(chunking.expand_blocks(blocks(spark, sf_dir))))
    return chunking.finish_chunks(made, F.col("doc_id").cast("string"), F.lit(None).cast("string"), composed=True)


PACKED_SQL = oracles.packed_sql(toks(f"({norm('content')})"))
@query(f"WITH RECURSIVE {oracles.split_sql('r', 'documents', 'doc_id')} SELECT doc_id, CAST(part - 1 AS INT) AS part, content FROM r WHERE part > 0")
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_text(F.col("text"))).alias("part", "content"))


@query(f"WITH RECURSIVE {PACKED_SQL} SELECT doc_id, chunk_order, chunk_id, estimated_tokens, CAST(length(content) AS INT) AS chars, md5(content) AS digest FROM packed")
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_chunks(spark, sf_dir).select("doc_id", "chunk_order", "chunk_id", "estimated_tokens", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query(f"""WITH RECURSIVE {PACKED_SQL}, by_doc AS (SELECT doc_id, count(*) AS n, min(chunk_order) AS lo, max(chunk_order) AS hi FROM packed GROUP BY doc_id)
SELECT (SELECT count(*) FROM by_doc WHERE lo <> 0 OR hi <> n - 1) AS order_gaps, (SELECT count(*) FROM (SELECT chunk_id FROM packed GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids,
 count(*) AS n_chunks, count(*) FILTER (length(content) > 1800) AS too_long, count(*) FILTER (trim(content, {oracles.WHITE}) = '') AS blank FROM packed""")
def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_invariants(stored(made_chunks(spark, sf_dir)))


@query("""SELECT doc_id, 'chunk_' || substr(sha256('chunk' || chr(0) || array_to_string(list_transform([CAST(doc_id AS VARCHAR), '', '0', sha256(text)], lambda p: strlen(p) || ':' || p), '')), 1, 24) AS chunk_id FROM documents""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents")
    return docs.select("doc_id", chunk_id(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


# Index and ranking

def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_fields(ad.chunks(spark, sf_dir), composed=True)


@query(f"WITH {CHUNKS_SQL} SELECT * FROM postings")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(fields(spark, sf_dir)).select("token", "chunk_id", "tf_body", "in_title", "in_heading", "in_path", "in_class")


@query(f"WITH {CHUNKS_SQL} SELECT token, df, round(ln(1 + (n_chunks - df + 0.5e0) / (df + 0.5e0)), 9) AS idf FROM df, stats")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(fields(spark, sf_dir))
    rows = index.document_frequency(index.postings(own)).crossJoin(F.broadcast(index.corpus_stats(own)))
    return rows.select("token", "df", F.round(index.idf(F.col("df"), F.col("n_chunks")), 9).alias("idf"))


@query(f"WITH {CHUNKS_SQL} SELECT n_chunks, round(avg_body_len, 6) AS avg_body_len FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(fields(spark, sf_dir)).select("n_chunks", F.round("avg_body_len", 6).alias("avg_body_len"))


STOP = "(" + ", ".join(f"'{w}'" for w in dims.STOPWORDS) + ")"
QUESTIONS_SQL = f"""
q AS (SELECT item_id AS question_id, {norm('text')} AS normal FROM benchmark),
groups AS (
  SELECT question_id, CAST(k - 1 AS INT) AS group_no, c AS term, list_distinct({toks('c')}) AS tokens
  FROM (SELECT question_id, unnest(string_split(normal, ' ')) AS c, generate_subscripts(string_split(normal, ' '), 1) AS k FROM q)
  WHERE c <> '' AND c NOT IN {STOP}
), each AS (SELECT question_id, group_no, unnest({toks('term')}) AS token, generate_subscripts({toks('term')}, 1) AS k FROM groups),
scoring AS (SELECT question_id, token, min(group_no * 1000 + k) AS pos FROM each GROUP BY ALL)
"""


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, group_no, term FROM groups")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.question_terms(ad.questions(spark, sf_dir), dims.stopwords(spark), composed=True)


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, token, pos AS place FROM scoring")
def scoring_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ranking.question_terms(ad.questions(spark, sf_dir), dims.stopwords(spark), composed=True)
    tokens = ranking.scoring_tokens(ranking.expand_aliases(terms, dims.aliases(spark)))
    return tokens.select("question_id", "token", (F.col("pos.group_no") * 1000 + F.col("pos.at") + 1).cast("long").alias("place"))


RANK_SQL = f"""{CHUNKS_SQL}, {QUESTIONS_SQL},
weighed AS (
  SELECT s.*, coalesce(df, 0) AS df, ln(1 + (n_chunks - coalesce(df, 0) + 0.5e0) / (coalesce(df, 0) + 0.5e0)) AS idf, n_chunks, avg_body_len
  FROM scoring s LEFT JOIN df USING (token), stats
), hits AS (
  SELECT question_id, chunk_id, w.token, pos, df, n_chunks, tf_body > 0 OR in_heading OR in_title OR in_path AS local,
    CASE WHEN tf_body > 0 THEN idf * (tf_body * 2.2e0) / (tf_body + 1.2e0 * (0.25e0 + 0.75e0 * (body_len / avg_body_len))) ELSE 0e0 END
      + CASE WHEN in_title THEN idf * 2.4e0 ELSE 0e0 END + CASE WHEN in_heading THEN idf * 1.9e0 ELSE 0e0 END
      + CASE WHEN in_path THEN idf * 1.15e0 ELSE 0e0 END + CASE WHEN in_class THEN idf * 0.85e0 ELSE 0e0 END AS part
  FROM weighed w JOIN postings USING (token) JOIN lengths USING (chunk_id)
), cand AS (
  SELECT question_id, chunk_id, sum(part) AS partial, list(token) AS matched, bool_or(local) AS local, bool_or(df / n_chunks <= 0.65e0) AS telling, any_value(n_chunks) AS n
  FROM hits GROUP BY ALL
), gw AS (
  SELECT question_id, group_no, max(idf) AS weight, any_value(g.tokens) AS tokens
  FROM groups g JOIN weighed w USING (question_id) WHERE list_contains(g.tokens, w.token) GROUP BY ALL
), total AS (SELECT question_id, sum(weight) AS total FROM gw GROUP BY ALL),
covered AS (
  SELECT c.question_id, c.chunk_id, sum(weight) AS hit FROM cand c JOIN gw USING (question_id) WHERE list_has_any(gw.tokens, c.matched) GROUP BY ALL
), gated AS (
  SELECT c.*, hit / total AS coverage FROM cand c JOIN covered USING (question_id, chunk_id) JOIN total USING (question_id)
  WHERE local AND hit / total >= 0.4e0 AND (n < 10 OR telling)
), final AS (
  SELECT question_id, chunk_id, path, round(partial + coverage * 0.35e0 + CASE WHEN (SELECT count(*) FROM scoring s WHERE s.question_id = g.question_id) < 2 THEN 0e0
    WHEN contains(title_text, normal) THEN 2.4e0 WHEN contains(body_text, normal) THEN 1.1e0 ELSE 0e0 END, 6) AS score
  FROM gated g JOIN q USING (question_id) JOIN fields USING (chunk_id)
), ranked AS (
  SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path, chunk_id) AS rank FROM final WHERE score >= 0.55e0
)
"""


DISTINCT_SQL = f"""f AS (SELECT doc_id, {norm('text')} AS body FROM documents),
c AS (SELECT sha256(body) AS body_hash, any_value(length(body)) AS chars, any_value(list_distinct({toks('body')})) AS t FROM f WHERE body <> '' GROUP BY 1)"""


def made_ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    built = ranking.build_index(ad.chunks(spark, sf_dir), composed=True)
    return built.fields, ranking.score_questions(ad.questions(spark, sf_dir), built, dims.stopwords(spark), dims.aliases(spark), composed=True)


def best_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best chunks, duplicates among them."""
    built = ranking.build_index(ad.chunks(spark, sf_dir), composed=True)
    made = ranking.prepare(ad.questions(spark, sf_dir), built, dims.stopwords(spark), dims.aliases(spark), composed=True)
    return ranking.top_k(ranking.ranked(ranking.first_scored(made, built, first=ranking.MOST_RESULTS)))


@query(f"WITH {RANK_SQL} SELECT question_id, chunk_id, round(coverage, 9) AS coverage FROM gated")
def gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, made = made_ranking(spark, sf_dir)
    return made["gated"].select("question_id", "chunk_id", F.round("coverage", 9).alias("coverage"))


@query(f"WITH {RANK_SQL} SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, score FROM ranked WHERE rank <= 10")
def ranked_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_ranked(spark, sf_dir).select("question_id", "rank", "chunk_id", "score")


@query(f"""WITH RECURSIVE {RANK_SQL}, {DISTINCT_SQL}, {oracles.SUPPRESSED}, terms AS (SELECT question_id, chunk_id, string_agg(token, ' ' ORDER BY pos) AS matched_terms FROM hits GROUP BY ALL)
SELECT k.question_id, k.rank, k.chunk_id, r.score, matched_terms FROM kept k JOIN ranked r USING (question_id, chunk_id) JOIN terms USING (question_id, chunk_id)""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    built = index.open_index(spark, path, ad.REVISION, lambda: index.index_fields(ad.chunks(spark, sf_dir)), buckets=8)
    matches, _ = ranking.retrieve(ad.questions(spark, sf_dir), built, dims.stopwords(spark), dims.aliases(spark))
    return matches.select("question_id", "rank", "chunk_id", "score", F.array_join("matched_terms", " ").alias("matched_terms"))


@query(f"""WITH {RANK_SQL}, n AS (SELECT question_id, count(*) AS k FROM ranked GROUP BY ALL)
SELECT question_id, CASE WHEN k > 0 THEN 'matches' ELSE 'no_matches' END AS kind, CASE WHEN question_id IN (SELECT question_id FROM groups) THEN (SELECT count(*) FROM chunks) ELSE 0 END AS considered_count
FROM q LEFT JOIN n USING (question_id)""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, made = made_ranking(spark, sf_dir)
    counted = ranking.considered(made["wanted"], own, made["tokens"])
    return ranking.outcomes(made["wanted"], ranking.top_k(made["ranked"]), counted).select("question_id", "kind", "considered_count")


@query(f"""WITH {RANK_SQL}, truth AS (SELECT item_id AS question_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hit AS (SELECT question_id, min(rank) AS rank FROM ranked JOIN truth USING (question_id, chunk_id) WHERE rank <= 10 GROUP BY ALL), t AS (SELECT DISTINCT question_id FROM truth)
SELECT count(*) AS n_questions, coalesce(round(avg(CASE WHEN rank = 1 THEN 1e0 ELSE 0e0 END), 9), 0) AS hit_at_1, coalesce(round(avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END), 9), 0) AS hit_at_k,
 coalesce(round(avg(coalesce(1e0 / rank, 0e0)), 9), 0) AS mrr FROM t LEFT JOIN hit USING (question_id)""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: documents that hold the whole text of a question."""
    questions = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    texts = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    got = audits.retrieval_quality(best_ranked(spark, sf_dir), audits.holding(texts, questions))
    return got.select("n_questions", *(F.round(c, 9).alias(c) for c in ("hit_at_1", "hit_at_k", "mrr")))


@query(f"WITH {DISTINCT_SQL} SELECT doc_id, sha256(body) AS body_hash, count(*) OVER (PARTITION BY body) AS copies FROM f WHERE body <> ''")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(fields(spark, sf_dir).where("body_text != ''").select(F.col("chunk_id").alias("doc_id"), "body_hash"))
    sizes = own.groupBy("body_hash").agg(F.count(F.lit(1)).alias("copies"))
    return own.join(sizes, "body_hash").select("doc_id", "body_hash", "copies")


@query(f"""WITH {DISTINCT_SQL}, n AS (SELECT * FROM c WHERE len(t) >= 20)
SELECT a.body_hash AS a, b.body_hash AS b FROM n a JOIN n b ON a.body_hash < b.body_hash AND least(a.chars, b.chars) >= greatest(a.chars, b.chars) * 0.85e0
AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.95e0
WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.95e0""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.near_duplicate_classes(fields(spark, sf_dir))


# Evidence and citations

def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked matches with what their evidence shows."""
    matches = cut(best_ranked(spark, sf_dir).select("question_id", "rank", "chunk_id"))
    return matches.join(shown_chunks(spark, sf_dir), "chunk_id")


def shown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence shows of a chunk."""
    return ad.chunks(spark, sf_dir).select("chunk_id", "title", "heading", F.concat(F.lit(ad.ORIGIN), "published_path").alias("published_url"), "path", "category", "content", F.lit(None).cast("string").alias("anchor"))


@query(f"""WITH RECURSIVE {RANK_SQL}, shown AS (SELECT question_id, rank, title, '{ad.ORIGIN}' || published_path AS url, content FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 10), {oracles.CONTEXTS}
SELECT question_id, CAST(length(formatted) AS INT) AS chars, md5(formatted) AS digest FROM contexts""")
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, contexts = evidence.pack_context(evidence_rows(spark, sf_dir))
    return contexts.select("question_id", F.length("formatted").alias("chars"), F.md5("formatted").alias("digest"))


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id, 'citation_' || chunk_id AS citation_id, '{ad.ORIGIN}' || published_path || '#a%20b%C3%A9(' || chunk_id || ')' AS url,
CASE WHEN length(content) <= 600 THEN content ELSE rtrim(substr(content, 1, 599), {oracles.WHITE}) || '…' END AS snippet FROM chunks""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.chunks(spark, sf_dir).withColumns({"question_id": F.lit(0), "citation_index": F.lit(1), "published_url": F.concat(F.lit(ad.ORIGIN), "published_path"), "anchor": F.concat(F.lit("a bé("), F.col("chunk_id").cast("string"), F.lit(")"))})
    return evidence.citations(rows).select(F.col("source_id").cast("long").alias("chunk_id"), "citation_id", "url", "snippet")


ANSWER_SQL = "(text || ' [' || (turn % 4 + 1) || '] [' || (conv_id % 9 + 1) || ']')"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.lit(" ["), (F.col("turn") % 4 + 1).cast("string"), F.lit("] ["), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("]"))
    rows = ad.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", said.alias("answer"))


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five citations an answer, of which the third has no link to the web."""
    rows = answers(spark, sf_dir).select("answer_id", "conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("display_index"))
    link = F.when(F.col("display_index") == 3, F.lit("mailto:x@example.org")).otherwise(F.concat(F.lit(ad.ORIGIN + "/p/"), F.col("display_index").cast("string")))
    none = F.lit(None).cast("string")
    return rows.withColumns({"citation_id": F.concat(F.lit("c"), (F.col("display_index") % 4).cast("string")), "source_id": F.lit("s1"), "url": link, "pos": F.col("display_index"), "title": F.when(F.col("display_index") == 4, F.lit(" ")).otherwise(F.lit("Title")), "section_heading": none, "documentation_path": F.lit("a/b"), "snippet": none, "service_category": none, "allowlisted": F.col("display_index") != 3})


ANSWERS_SQL = f"""a AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, {ANSWER_SQL} AS answer FROM conversations WHERE role = 'assistant'),
m AS (SELECT answer_id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) AS n, generate_subscripts(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), 1) AS k FROM a),
r AS (SELECT answer_id, 'c' || (n::INT % 4) AS citation_id, min(k) AS k FROM m WHERE n::INT IN (1, 2, 4, 5) GROUP BY ALL)"""


@query(f"WITH {ANSWERS_SQL} SELECT answer_id, citation_id, row_number() OVER (PARTITION BY answer_id ORDER BY k) AS place FROM r")
def referenced_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evidence.referenced_citations(answers(spark, sf_dir), answer_citations(spark, sf_dir))
    return got.select("answer_id", "citation_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {ANSWERS_SQL} SELECT answer_id, count(citation_id) AS n_cited, CASE WHEN count(citation_id) > 0 THEN 'partial' ELSE 'none' END AS status FROM a LEFT JOIN r USING (answer_id) GROUP BY answer_id")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = answers(spark, sf_dir)
    return evidence.evidence_status(said, evidence.referenced_citations(said, answer_citations(spark, sf_dir)))


@query("""SELECT conv_id * 1000 + turn AS answer_id, k AS display_index, CASE k WHEN 3 THEN 'bad_url' WHEN 4 THEN 'bad_title' ELSE '' END AS codes
FROM conversations, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE role = 'assistant'""")
def validate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.validate_citations(answer_citations(spark, sf_dir)).select("answer_id", "display_index", F.array_join("codes", ",").alias("codes"))


@query("""SELECT conv_id * 1000 + turn AS answer_id, 'citation:c' || (k % 4) AS item_id, CASE WHEN k = 3 THEN 'official-repository' ELSE 'official-docs' END AS kind, 'a/b' AS descriptor
FROM conversations, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE role = 'assistant'""")
def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.source_items(answer_citations(spark, sf_dir), "docs.example.org").select("answer_id", "item_id", "kind", "descriptor")


@query("""WITH c AS (SELECT conv_id, turn * 10 + k AS pos, 'c' || (k % 4) AS citation_id FROM conversations, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE role = 'assistant')
SELECT conv_id, citation_id, min(pos) AS pos FROM c GROUP BY ALL""")
def dedupe_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer_citations(spark, sf_dir).select("conv_id", (F.col("turn") * 10 + F.col("display_index")).alias("pos"), "citation_id")
    return evidence.dedupe_citations(rows).select("conv_id", "citation_id", "pos")


@query(f"""WITH {ANSWERS_SQL} SELECT answer_id, CASE WHEN count(citation_id) > 0 AND turn % 3 = 0 THEN 'official,project' WHEN count(citation_id) > 0 THEN 'official' WHEN turn % 3 = 0 THEN 'project' ELSE 'none' END AS badges
FROM a LEFT JOIN r USING (answer_id) GROUP BY answer_id, turn""")
def grounding_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = answers(spark, sf_dir)
    n = evidence.evidence_status(said, evidence.referenced_citations(said, answer_citations(spark, sf_dir)))
    rows = said.join(n, "answer_id").select("answer_id", F.col("n_cited").alias("n_citations"), F.when(F.col("turn") % 3 == 0, 2).otherwise(0).alias("n_files"), F.lit(False).alias("configuration_reviewed"))
    return evidence.grounding_badges(rows).select("answer_id", F.array_join("badges", ",").alias("badges"))


@query(f"""WITH {ANSWERS_SQL}, said AS (SELECT DISTINCT answer_id, n::INT AS display_index FROM m), held AS (SELECT answer_id, unnest([1, 2, 3, 4, 5]) AS display_index FROM a)
SELECT answer_id, 'missing' AS finding, display_index FROM said ANTI JOIN held USING (answer_id, display_index)
UNION ALL SELECT answer_id, 'unreferenced', display_index FROM held ANTI JOIN said USING (answer_id, display_index)
UNION ALL SELECT answer_id, 'non_official', 3 FROM a UNION ALL SELECT answer_id, 'malformed', 4 FROM a UNION ALL SELECT answer_id, 'duplicate', unnest([1, 5]) FROM a""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.citation_audit(answers(spark, sf_dir), answer_citations(spark, sf_dir))


# Routing

def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(ad.table(spark, sf_dir, "conversations"))


def requests_of(turns: DataFrame) -> DataFrame:
    """User turns as requests; some are given the wording of the other routes."""
    t = turns.where("role = 'user'")
    k = (F.col("conv_id") + F.col("turn")) % 7
    message = F.when(k == 0, F.lit("Hello!")).when(k == 1, F.lit("thank you")).when(k == 2, F.concat(F.lit("Deploy failed: "), "text")).when(k == 3, F.concat(F.lit("My Django build failed with exit code 137. "), "text")).otherwise(F.col("text"))
    none = F.lit(None).cast("string")
    recent = F.array(F.struct(F.lit("user").alias("role"), F.lit("one").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("two").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("three").alias("content")))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), message.alias("message"), recent.alias("recent"), none.alias("framework"), F.when(k == 4, F.lit("node")).alias("runtime"), none.alias("service"), F.when(k == 5, F.lit("fa-IR")).alias("preferred_language"))


ROUTES_SQL = """rq AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id + turn) % 7 AS k, text FROM conversations WHERE role = 'user'),
rt AS (SELECT request_id, CASE WHEN k <= 1 THEN 'direct' WHEN k = 2 THEN 'clarification' ELSE 'retrieve' END AS route, CASE WHEN k = 5 THEN 'fa' ELSE 'en' END AS language,
CASE k WHEN 0 THEN 'Hello!' WHEN 1 THEN 'thank you' WHEN 2 THEN 'Deploy failed: ' || text WHEN 3 THEN 'My Django build failed with exit code 137. ' || text ELSE text END || ' two three' || CASE WHEN k = 4 THEN ' node' ELSE '' END AS retrieval_text FROM rq)"""


@query(f"WITH {ROUTES_SQL} SELECT request_id, route, language, retrieval_text FROM rt")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(requests(spark, sf_dir), dims.intents(spark)).select("request_id", "route", "language", "retrieval_text")


@query(f"WITH {ROUTES_SQL} SELECT route, language, count(*) AS n FROM rt GROUP BY ALL")
def route_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_mix(routing.route(requests(spark, sf_dir), dims.intents(spark)))


@query("SELECT conv_id * 1000 + turn AS request_id, 'retrieve' AS route FROM conversations WHERE role = 'user'")
def clarified_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    none = F.lit(None).cast("string")
    said = routing.clarified_message(F.concat(F.lit("It failed: "), "message"), F.lit("Django"), F.lit("Build"), none, F.lit(" "))
    return routing.route(rows.withColumn("message", said), dims.intents(spark)).select("request_id", "route")


ANSWERED_SQL = f"""{RANK_SQL.replace(f"q AS (SELECT item_id AS question_id, {norm('text')} AS normal FROM benchmark)", f"{ROUTES_SQL}, q AS (SELECT request_id AS question_id, {norm('retrieval_text')} AS normal FROM rt WHERE route = 'retrieve')")}, {DISTINCT_SQL},
{oracles.SUPPRESSED.replace("len(kept) < 10", "len(kept) < 6").replace("walk", "shown_walk")}, shown AS (SELECT k.question_id, k.rank, title, '{ad.ORIGIN}' || published_path AS url, content FROM kept k JOIN chunks USING (chunk_id)), {oracles.CONTEXTS},
cited AS (SELECT question_id, count(*) AS n_matches FROM kept GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {ANSWERED_SQL} SELECT request_id, route, language, CASE WHEN route = 'retrieve' THEN CASE WHEN n_matches > 0 THEN 'matches' ELSE 'no_matches' END END AS outcome,
 CASE WHEN route = 'retrieve' THEN coalesce(n_matches, 0) END AS n_matches, CASE WHEN route = 'retrieve' THEN md5(coalesce(formatted, '[]')) END AS context,
 CASE WHEN route = 'retrieve' THEN CAST(CASE WHEN formatted IS NULL THEN 0 ELSE (length(formatted) - length(replace(formatted, '{{"citation":', ''))) // length('{{"citation":') END AS BIGINT) END AS n_citations
 FROM rt LEFT JOIN cited ON cited.question_id = request_id LEFT JOIN contexts ON contexts.question_id = request_id""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream against the index of a revision: routes, matches, contexts and citations of each micro-batch."""
    path, source = f"{shared_folder(spark)}/{uuid.uuid4().hex}", f"{sf_dir}/conversations.parquet"
    index.open_index(spark, path, ad.REVISION, lambda: index.index_fields(ad.chunks(spark, sf_dir), composed=True), buckets=8)
    read = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[{source[-1]}]")
    job = answering.answer_stream(requests_of(read), lambda: index.read_index(spark, path, ad.REVISION), lambda: shown_chunks(spark, sf_dir), f"{path}/answers", composed=True)
    job.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    routed, contexts, cited = (spark.read.parquet(f"{path}/answers/{name}") for name in ("routes", "contexts", "citations"))
    n = cited.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    whole = routed.join(contexts.select("request_id", F.md5("formatted").alias("context")), "request_id", "left").join(n, "request_id", "left")
    return whole.select("request_id", "route", "language", "outcome", "n_matches", "context", F.when(F.col("route") == "retrieve", F.coalesce("n", F.lit(0))).alias("n_citations"))


# Conversations

@query("""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair_no, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations WHERE role = 'user')
SELECT u.conv_id, pair_no, u.text AS prompt, (SELECT arg_min(a.text, a.turn) FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn > u.turn AND (upto IS NULL OR a.turn < upto)) AS answer FROM u""")
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.pair_turns(ad.turns(spark, sf_dir)).select("conv_id", "pair_no", "prompt", "answer")


TITLE_SQL = "CASE WHEN length(s) <= 48 THEN s ELSE rtrim(substr(s, 1, 47)) || '…' END"


@query(f"WITH t AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, {TITLE_SQL} AS title FROM t")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.titles(ad.turns(spark, sf_dir))


@query("""WITH m AS (SELECT conv_id, turn, role, substr(CASE WHEN role = 'assistant' THEN trim(text) ELSE text END, 1, 2000) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT *, sum(length(c)) OVER (PARTITION BY conv_id ORDER BY back) AS used FROM m WHERE back <= 6)
SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ':' || c, '|' ORDER BY turn)) AS digest FROM s WHERE used <= 6000 GROUP BY conv_id""")
def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text of the tables is so long that a later message could fit after one that does not."""
    got = conversations.recent_context(ad.turns(spark, sf_dir))
    said = F.array_join(F.transform("recent", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return got.select("conv_id", F.size("recent").cast("long").alias("n_messages"), F.md5(said).alias("digest"))


HISTORY = {"click": "prompt", "signup": "rename", "view": "pin", "purchase": "archive"}


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "delete")
    for name, means in HISTORY.items():
        kind = kind.when(F.col("event_type") == name, means)
    text_ = F.concat(F.lit(" event  "), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("type"), text_.alias("text")).where("type IS NOT NULL")


HISTORY_SQL = f"""e AS (SELECT user_id AS conv_id, ts AS tm, event_id, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'delete' WHEN event_type = 'click' THEN 'prompt' WHEN event_type = 'signup' THEN 'rename' WHEN event_type = 'view' THEN 'pin' WHEN event_type = 'purchase' THEN 'archive' END AS type FROM events),
g AS (SELECT e.* FROM e LEFT JOIN (SELECT conv_id, max(tm) AS gone FROM e WHERE type = 'delete' GROUP BY 1) d USING (conv_id) WHERE gone IS NULL OR tm > gone),
p AS (SELECT conv_id, min(tm) AS first, max(tm) AS last, arg_min('event ' || event_id, tm) AS said FROM g WHERE type = 'prompt' GROUP BY 1),
h AS (SELECT conv_id, coalesce(arg_max('event ' || event_id, tm) FILTER (type = 'rename'), any_value(said)) AS title, epoch_us(any_value(last)) // 1000 AS updated_ms,
 count(*) FILTER (type = 'pin') % 2 = 1 AS pinned, count(*) FILTER (type = 'archive' AND tm > last) % 2 = 1 AS archived FROM g JOIN p USING (conv_id) WHERE tm >= first GROUP BY conv_id)"""


@query(f"WITH {HISTORY_SQL} SELECT * FROM h")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.apply_history_events(history_events(spark, sf_dir)).select("conv_id", "title", F.unix_millis("updated_at").alias("updated_ms"), "pinned", "archived")


@query(f"WITH {HISTORY_SQL} SELECT conv_id, title FROM h WHERE NOT archived AND contains(lower(title), 'event 9')")
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.search_conversations(conversations.apply_history_events(history_events(spark, sf_dir)), " Event 9", "all").select("conv_id", "title")


@query(f"""WITH {HISTORY_SQL}, n AS (SELECT date_trunc('day', max(ts)) AS today FROM events)
SELECT conv_id, CASE WHEN date_trunc('day', make_timestamp(updated_ms * 1000)) = today THEN 'Today' WHEN date_trunc('day', make_timestamp(updated_ms * 1000)) = today - INTERVAL 1 DAY THEN 'Yesterday' ELSE 'Older' END AS "group",
 row_number() OVER (PARTITION BY CASE WHEN date_trunc('day', make_timestamp(updated_ms * 1000)) = today THEN 0 WHEN date_trunc('day', make_timestamp(updated_ms * 1000)) = today - INTERVAL 1 DAY THEN 1 ELSE 2 END ORDER BY pinned DESC, updated_ms DESC, conv_id) AS place FROM h, n""")
def group_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = ad.events(spark, sf_dir).agg(F.max("ts").alias("now"))
    rows = conversations.apply_history_events(history_events(spark, sf_dir)).crossJoin(F.broadcast(now))
    return conversations.group_conversations(rows, F.col("now")).select("conv_id", "group", "place")


REQUEST_SQL = """b AS (SELECT conv_id * 1000 + turn AS request_id, turn % 4 AS k, conv_id % 5 AS c, text FROM conversations),
bodies AS (SELECT *, '{"version":"' || CASE k WHEN 2 THEN '2' ELSE '1' END || '","conversationId":"' || CASE k WHEN 3 THEN '-bad-' ELSE 'conv-1' END || '","message":' || to_json(CASE WHEN k = 3 THEN chr(10) || ' ' ELSE coalesce(text, '') END) ||
 CASE c WHEN 1 THEN ',"recentContext":[{"role":"user","content":"one"}],"userContext":{"framework":"django"}' WHEN 2 THEN ',"recentContext":[{"role":"system","content":"one"}]' WHEN 3 THEN ',"userContext":{"framework":" "}'
 WHEN 4 THEN ',"recentContext":[{"role":"user","content":"one","more":1}]' ELSE '' END || CASE k WHEN 1 THEN ',"extra":"x"' ELSE '' END || '}' AS body FROM b)"""


@query(f"""WITH {REQUEST_SQL} SELECT request_id, concat_ws(',', CASE WHEN strlen(body) > 16384 THEN 'body_too_large' END, CASE WHEN k = 1 THEN 'unknown_field' END, CASE WHEN k = 2 THEN 'bad_version' END,
 CASE WHEN k = 3 THEN 'bad_conversation_id' END, CASE WHEN k = 3 OR length(trim(coalesce(text, ''), {oracles.WHITE})) NOT BETWEEN 1 AND 8000 THEN 'bad_message' END, CASE WHEN c IN (2, 4) THEN 'bad_recent' END, CASE WHEN c = 3 THEN 'bad_user_context' END) AS codes FROM bodies""")
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the whole texts as messages; recent messages and contexts by conversation, some spoilt."""
    t, k, c = ad.table(spark, sf_dir, "conversations"), F.col("turn") % 4, F.col("conv_id") % 5
    none = F.lit(None).cast("string")
    message = lambda role, more: F.array(F.struct(F.lit(role).alias("role"), F.lit("one").alias("content"), more.alias("more")))
    body = F.to_json(F.struct(
        F.when(k == 2, F.lit("2")).otherwise(F.lit("1")).alias("version"), F.when(k == 3, F.lit("-bad-")).otherwise(F.lit("conv-1")).alias("conversationId"),
        F.when(k == 3, F.lit("\n ")).otherwise(F.coalesce("text", F.lit(""))).alias("message"),
        F.when(c == 1, message("user", none)).when(c == 2, message("system", none)).when(c == 4, message("user", F.lit("1"))).alias("recentContext"),
        F.when(c == 1, F.struct(F.lit("django").alias("framework"))).when(c == 3, F.struct(F.lit(" ").alias("framework"))).alias("userContext"),
        F.when(k == 1, F.lit("x")).alias("extra"),
    ))
    good, bad = conversations.validate_requests(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), body.alias("body")))
    return good.select("request_id", F.lit("").alias("codes")).unionByName(bad.select("request_id", F.array_join("codes", ",").alias("codes")))


# Logs

DAY = 86_400_000


REPLAY_SQL = """WITH RECURSIVE e AS (SELECT event_id AS request_id, user_id AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT request_id, key, ms, i, 1 AS n, ms + 86400000 AS reset, true AS allowed, CAST(0 AS BIGINT) AS wait FROM e WHERE i = 1
UNION ALL SELECT e.request_id, e.key, e.ms, e.i, CASE WHEN r.reset <= e.ms THEN 1 WHEN r.n >= 2 THEN r.n ELSE r.n + 1 END, CASE WHEN r.reset <= e.ms THEN e.ms + 86400000 ELSE r.reset END,
 r.reset <= e.ms OR r.n < 2, CASE WHEN r.reset <= e.ms OR r.n < 2 THEN 0 ELSE greatest(1, r.reset - e.ms) END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)"""


@query(f"{REPLAY_SQL} SELECT request_id, allowed, wait AS retry_after_ms, CASE WHEN allowed THEN 0 ELSE CAST(greatest(1, ceil(wait / 1000)) AS INT) END AS retry_after_s FROM r")
def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = logs.rate_limit_replay(ad.events(spark, sf_dir), 2, DAY)
    wait = F.when(F.col("allowed"), F.lit(0)).otherwise(logs.retry_after_seconds(F.col("retry_after_ms")))
    return got.select("request_id", "allowed", "retry_after_ms", wait.alias("retry_after_s"))


def streamed(made: DataFrame, path: str) -> None:
    """Runs a stream over what there is and writes its rows as Parquet."""
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that processors need; other settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    return own


#: No row of the tables is later than the watermark; the last row moves it past all others.
NO_DELAY_TOO_LONG, FAR = "3650 days", "2099-01-01"


def through_stream(rows: DataFrame, time: str, key: str, order: str, make, files: int = 4) -> DataFrame:
    """``rows`` written as shuffled files, read as a stream of one file a micro-batch through ``make``, and what that wrote.

    A last row, whose key is -1, moves the watermark past all others.
    """
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    last = rows.limit(1).withColumns({time: F.lit(FAR).cast("timestamp"), key: F.lit(-1).cast(dict(rows.dtypes)[key])})
    in_order.shuffled_files(rows, f"{path}/in", files, F.hash(order), last)
    read = stream_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streamed(make(read.withWatermark(time, NO_DELAY_TOO_LONG)), f"{path}/out")
    return spark.read.parquet(f"{path}/out")


@query(f"{REPLAY_SQL} SELECT request_id, allowed, wait AS retry_after_ms FROM r")
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions as the replay, by the stateful stream over shuffled files."""
    rows = ad.events(spark, sf_dir).select("request_id", "key", "ts")
    got = through_stream(rows, "ts", "key", "request_id", lambda s: in_order.rate_limit_stream(s, 2, DAY))
    return got.where("key >= 0").select("request_id", "allowed", "retry_after_ms")


@query(f"WITH {HISTORY_SQL} SELECT * FROM h")
def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histories again, by a stream of their events in shuffled files."""
    changes = through_stream(history_events(spark, sf_dir), "at", "conv_id", "event_id", in_order.history_stream)
    return in_order.latest_history(changes).where("conv_id >= 0").select("conv_id", "title", "updated_ms", "pinned", "archived")


@query("SELECT event_id AS request_id, sha256(CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 1 THEN '10.1.0.' || user_id ELSE 'unidentified-client' END) AS key FROM events")
def rate_limit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    real = F.when(k == 0, F.concat(F.lit(" 10.0.0."), user)).otherwise(F.lit(" "))
    forwarded = F.when(k == 1, F.concat(F.lit("10.1.0."), user, F.lit(", 1.1.1.1")))
    return e.select(F.col("event_id").alias("request_id"), logs.rate_limit_key(real, forwarded).alias("key"))


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start for each event; an end after ``value`` seconds unless it is a view, and a first chunk halfway to completed ones."""
    e = ad.events(spark, sf_dir)
    none = F.lit(None).cast("string")
    start = e.select("request_id", F.lit("started").alias("event"), "ts", none.alias("outcome"), none.alias("error_code"), F.lit("secret").alias("prompt"))
    kind = F.col("event_type")
    event = F.when(kind.isin("purchase", "signup"), "completed").when(kind == "error", "failed").otherwise("cancelled")
    end = e.where(kind != "view").select(
        "request_id", event.alias("event"), F.timestamp_millis(F.col("ms") + F.round(F.col("value") * 1000).cast("long")).alias("ts"),
        F.when(kind.isin("purchase", "signup"), "answered").alias("outcome"), F.when(kind == "error", "MODEL_UNAVAILABLE").alias("error_code"), F.lit("secret").alias("prompt"),
    )
    chunk = e.where(kind.isin("purchase", "signup")).select(
        "request_id", F.lit("first_chunk").alias("event"), F.timestamp_millis(F.col("ms") + F.round(F.col("value") * 500).cast("long")).alias("ts"),
        none.alias("outcome"), none.alias("error_code"), F.lit("secret").alias("prompt"),
    )
    return logs.redact_log(start.unionByName(end).unionByName(chunk))


ENDED_SQL = """l AS (SELECT event_id AS request_id, ts AS started_at, CASE WHEN event_type IN ('purchase', 'signup') THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type <> 'view' THEN 'cancelled' END AS ended,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'answered' END AS outcome, CASE WHEN event_type = 'error' THEN 'MODEL_UNAVAILABLE' END AS error_code,
CASE WHEN event_type <> 'view' THEN CAST(round(value * 1000) AS BIGINT) END AS duration_ms FROM events)"""


@query(f"WITH {ENDED_SQL} SELECT request_id, ended, outcome, error_code, coalesce(duration_ms, -1) AS duration_ms FROM l")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.lifecycle(chat_log(spark, sf_dir)).select("request_id", "ended", "outcome", "error_code", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


@query(f"""WITH {ENDED_SQL}, s AS (SELECT l.*, CASE WHEN ended = 'completed' THEN least(duration_ms, CAST(round(value * 500) AS BIGINT)) ELSE duration_ms END AS sign_ms FROM l JOIN events ON event_id = request_id)
SELECT request_id, 'TIMEOUT' AS error_code, CASE WHEN sign_ms IS NULL OR sign_ms > 15000 THEN 'first_chunk' ELSE 'total' END AS broke FROM s WHERE sign_ms IS NULL OR sign_ms > 15000 OR duration_ms > 45000""")
def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.timeouts(chat_log(spark, sf_dir)).select("request_id", "error_code", "broke")


@query(f"WITH {ENDED_SQL} SELECT epoch_ms(date_trunc('day', started_at)) AS window_ms, outcome, error_code, count(*) AS n, coalesce(round(avg(duration_ms), 6), -1e0) AS mean_ms, coalesce(max(duration_ms), -1) AS max_ms, coalesce(quantile_disc(duration_ms, 0.95), -1) AS p95_ms FROM l GROUP BY ALL")
def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = logs.outcome_rates(logs.lifecycle(chat_log(spark, sf_dir)))
    return got.select(F.unix_millis("window_start").alias("window_ms"), "outcome", "error_code", "n", F.coalesce(F.round("mean_ms", 6), F.lit(-1.0)).alias("mean_ms"), F.coalesce("max_ms", F.lit(-1)).alias("max_ms"), F.coalesce("p95_ms", F.lit(-1)).alias("p95_ms"))


@query("""WITH u AS (SELECT epoch_ms(date_trunc('day', ts)) AS window_ms, event_type AS model, CAST(json_extract(props, '$.k') AS BIGINT) AS i, event_id % 100 AS o FROM events)
SELECT window_ms, model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(CASE WHEN model = 'view' THEN 0e0 ELSE i * 2e0 + o * 6e0 END), 6) AS cost FROM u GROUP BY ALL""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.events(spark, sf_dir)
    usage = e.select("ts", F.lit("p").alias("provider"), F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), (F.col("request_id") % 100).alias("output_tokens"))
    prices = dims.prices(spark, [("p", m, 2.0, 6.0) for m in ("click", "signup", "purchase", "error")])
    got = logs.token_usage(usage, prices)
    return got.select(F.unix_millis("window_start").alias("window_ms"), "model", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


@query("""SELECT request_id, turn FROM (SELECT event_id AS request_id, row_number() OVER (PARTITION BY user_id || ':' || json_extract_string(props, '$.k') ORDER BY ts, event_id) AS turn FROM events) WHERE turn > 1""")
def duplicate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.events(spark, sf_dir)
    rows = e.select("request_id", "ms", F.concat(F.col("key").cast("string"), F.lit(":"), F.get_json_object("props", "$.k")).alias("client_request_id"))
    return logs.duplicate_requests(rows).select("request_id", F.col("turn").cast("long").alias("turn"))


@query("""SELECT event_id AS request_id, CASE event_type WHEN 'click' THEN 'RATE_LIMITED' WHEN 'view' THEN 'TIMEOUT' WHEN 'signup' THEN 'INVALID_INPUT' ELSE 'STREAM_INTERRUPTED' END AS code,
CASE event_type WHEN 'click' THEN 429 WHEN 'view' THEN 504 WHEN 'signup' THEN 400 ELSE 500 END AS status, event_type <> 'signup' AS retryable FROM events""")
def classify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = ad.events(spark, sf_dir), F.col("event_type")
    cause = F.when(kind == "click", "provider_429").when(kind == "view", "timeout").when(kind == "signup", "invalid_request").otherwise("unheard_of")
    phase = F.when(kind == "signup", "before").otherwise("streaming")
    return logs.classify_failures(e.select("request_id", cause.alias("cause"), phase.alias("phase"))).select("request_id", "code", "status", "retryable")


from docweave.plans import further  # noqa: E402, F401  (registers the remaining queries)
