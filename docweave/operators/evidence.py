"""Evidence packing, citations and what answers say about their sources.

A match row has question_id, rank, chunk_id, title, heading, published_url, anchor, path,
category and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import strip, strip_end
from docweave.session import stored

BUDGET, SNIPPET = 12_000, 600


def serialize_evidence(citation: Column, title: Column, section: Column, url: Column, content: Column) -> Column:
    """Compact JSON with nulls kept."""
    item = F.struct(citation.alias("citation"), title.alias("title"), section.alias("section"), url.alias("officialUrl"), content.alias("content"))
    return F.to_json(item, {"ignoreNullFields": "false"})


def packable(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Without title, heading and content where these can't fit into a context, whatever else is in it."""
    said = serialize_evidence(F.lit(1), F.col("title"), F.col("heading"), F.col("published_url"), F.col("content"))
    fits = F.length(said) + 2 <= budget
    return rows.withColumns({c: F.when(fits, F.col(c)) for c in ("title", "heading", "content")})


def pack_context(matches: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Evidence rows with their citation index, and one formatted context a question.

    Matches are at most 20 a question.  Blank or repeated contents and those that do not fit
    are skipped, and later ones may still fit, so this is a fold; the length of an item depends
    on the index that it gets.  Contents that can't fit at all are dropped before they are moved.
    """
    item = F.struct("rank", "chunk_id", "title", "heading", "published_url", "content")
    listed = packable(matches, budget).groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = dict(matches.dtypes)
    start = F.struct(
        F.lit(2).alias("used"),
        F.array().cast(f"array<struct<chunk_id:{kind['chunk_id']},rank:{kind['rank']},content:string,said:string>>").alias("kept"),
    )

    def step(done: Column, m: Column) -> Column:
        n = F.size(done["kept"])
        said = serialize_evidence((n + 1).cast("int"), m["title"], m["heading"], m["published_url"], m["content"])
        trimmed = strip(m["content"])
        need = F.length(said) + F.when(n > 0, 1).otherwise(0)
        ok = (F.coalesce(trimmed, F.lit("")) != "") & ~F.exists(done["kept"], lambda k: k["content"] == trimmed) & (done["used"] + need <= budget)
        more = F.struct(m["chunk_id"].alias("chunk_id"), m["rank"].alias("rank"), trimmed.alias("content"), said.alias("said"))
        return F.struct(F.when(ok, done["used"] + need).otherwise(done["used"]).alias("used"), F.when(ok, F.concat(done["kept"], F.array(more))).otherwise(done["kept"]).alias("kept"))

    folded = stored(listed.select("question_id", F.aggregate("items", start, step, lambda d: F.transform(d["kept"], lambda k: k.dropFields("content"))).alias("kept")))
    evidence = folded.select("question_id", F.posexplode("kept").alias("at", "k")).select("question_id", (F.col("at") + 1).alias("citation_index"), F.col("k.chunk_id").alias("chunk_id"), F.col("k.rank").alias("rank"))
    contexts = folded.select("question_id", F.concat(F.lit("["), F.array_join(F.transform("kept", lambda k: k["said"]), ","), F.lit("]")).alias("formatted"))
    return evidence, contexts


def encode_component(text: Column) -> Column:
    """Percent encoding that keeps what a URI component may hold."""
    coded = F.url_encode(text)
    for code, letter in {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        coded = F.replace(coded, F.lit(code), F.lit(letter))
    return coded


def snippet(content: Column, most: int = SNIPPET) -> Column:
    return F.when(F.length(content) <= most, content).otherwise(F.concat(strip_end(F.substring(content, 1, most - 1)), F.lit("…")))


def shortened(rows: DataFrame) -> DataFrame:
    """With as much of the content as a citation's snippet depends on."""
    return rows.withColumn("content", F.substring("content", 1, SNIPPET + 1))


def citations(evidence: DataFrame) -> DataFrame:
    """One citation for each evidence row that carries its match's columns."""
    url = F.when(F.col("anchor").isNull(), F.col("published_url")).otherwise(F.concat("published_url", F.lit("#"), encode_component(F.col("anchor"))))
    return evidence.select(
        "question_id",
        F.concat(F.lit("citation_"), F.col("chunk_id").cast("string")).alias("citation_id"),
        F.col("citation_index").alias("display_index"),
        F.col("chunk_id").cast("string").alias("source_id"),
        "title",
        url.alias("url"),
        F.col("heading").alias("section_heading"),
        F.col("path").alias("documentation_path"),
        snippet(F.col("content")).alias("snippet"),
        F.col("category").alias("service_category"),
    )


def markers(answers: DataFrame) -> DataFrame:
    """Rows of answer_id, place and number for each ``[n]`` in an answer."""
    found = F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1)
    return answers.select("answer_id", F.posexplode(found).alias("at", "n")).select("answer_id", "at", F.expr("try_cast(n AS INT)").alias("display_index"))


def usable(found: DataFrame) -> DataFrame:
    """Of citations (answer_id, display_index, citation_id, url, pos) with a http(s) link the first of each index."""
    safe = F.try_parse_url("url", F.lit("PROTOCOL")).isin("http", "https")
    first = F.row_number().over(Window.partitionBy("answer_id", "display_index").orderBy("pos"))
    return found.where(safe).withColumn("_turn", first).where("_turn = 1").drop("_turn")


def referenced_citations(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Citations that an answer refers to, in the order in which it first does."""
    near = markers(answers).join(usable(found).select("answer_id", "display_index", "citation_id"), ["answer_id", "display_index"])
    first = near.groupBy("answer_id", "citation_id").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))).select("answer_id", "citation_id", "place")


def evidence_status(answers: DataFrame, referenced: DataFrame) -> DataFrame:
    """``none`` where no citation is referred to, else what retrieval found (``partial``)."""
    n = referenced.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_cited"))
    rows = answers.select("answer_id").join(n, "answer_id", "left")
    return rows.select("answer_id", F.coalesce("n_cited", F.lit(0)).alias("n_cited"), F.when(F.col("n_cited") > 0, "partial").otherwise("none").alias("status"))


OPAQUE = "^[A-Za-z0-9][A-Za-z0-9._:-]*$"


def citation_codes() -> Column:
    """Codes of what is wrong with a citation row that has ``allowlisted`` beside its columns."""
    text = lambda c, most: F.col(c).isNull() | ((F.length(strip(c)) >= 1) & (F.length(strip(c)) <= most))
    opaque = lambda c: F.coalesce(F.col(c).rlike(OPAQUE) & (F.length(c) <= 128), F.lit(False))
    rules = {
        "bad_id": opaque("citation_id"),
        "bad_source_id": opaque("source_id"),
        "bad_index": F.coalesce((F.col("display_index") >= 1) & (F.col("display_index") <= 99), F.lit(False)),
        "bad_title": F.col("title").isNotNull() & text("title", 200),
        "bad_url": F.col("allowlisted"),
        "bad_section": text("section_heading", 200),
        "bad_path": text("documentation_path", 500),
        "bad_snippet": text("snippet", 1000),
        "bad_category": text("service_category", 80),
    }
    return F.array_compact(F.array(*(F.when(~ok, F.lit(code)) for code, ok in rules.items())))


def validate_citations(found: DataFrame) -> DataFrame:
    return found.withColumn("codes", citation_codes())


def source_items(found: DataFrame, docs_host: str, default: str = "Documentation") -> DataFrame:
    """What a reader sees of each citation: kind by host, and the best description at hand."""
    kind = F.when(F.try_parse_url("url", F.lit("HOST")) == docs_host, "official-docs").otherwise("official-repository")
    return found.select(
        "answer_id",
        F.concat(F.lit("citation:"), "citation_id").alias("item_id"),
        kind.alias("kind"),
        "title",
        F.coalesce("section_heading", "documentation_path", "service_category", F.lit(default)).alias("descriptor"),
    )


def project_items(contexts: DataFrame) -> DataFrame:
    """The extra row of answers (answer_id, n_files) that looked into a project."""
    n = F.col("n_files")
    return contexts.where("n_files > 0").select(
        "answer_id", F.lit("evidence:project-context").alias("item_id"), F.lit("project-context").alias("kind"), F.lit("Project context").alias("title"),
        F.concat(n.cast("string"), F.lit(" analyzed "), F.when(n == 1, "file").otherwise("files")).alias("descriptor"),
    )


def grounding_badges(answers: DataFrame) -> DataFrame:
    """Badges of answers with n_citations, n_files and configuration_reviewed."""
    badges = F.array_compact(F.array(F.when(F.col("n_citations") > 0, "official"), F.when(F.col("n_files") > 0, "project"), F.when(F.col("configuration_reviewed"), "configuration")))
    return answers.select("answer_id", F.when(F.size(badges) == 0, F.array(F.lit("none"))).otherwise(badges).alias("badges"))


def dedupe_citations(found: DataFrame) -> DataFrame:
    """Of each conversation's citations (conv_id, pos, citation_id) the first of each id."""
    turn = F.row_number().over(Window.partitionBy("conv_id", "citation_id").orderBy("pos"))
    return found.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


#: Headings of a prompt's parts; callers put their own wording.
HEADINGS = {"preferences": "About the reader", "recent": "Said before", "formatted": "Evidence", "text": "Question"}


def prompt_rows(questions: DataFrame, headings: dict[str, str] = HEADINGS) -> DataFrame:
    """One prompt a question from question_id, text, preferences (struct), recent (array) and formatted.

    Each part is a heading and then its JSON (the question: its text); what is missing is empty.
    """
    as_json = {c: F.coalesce(F.to_json(c), F.lit(none)) for c, none in (("preferences", "{}"), ("recent", "[]"))}
    as_json |= {"formatted": F.coalesce("formatted", F.lit("[]")), "text": F.coalesce("text", F.lit(""))}
    parts = [F.concat(F.lit(f"{said}:\n"), as_json[c]) for c, said in headings.items()]
    return questions.select("question_id", F.concat_ws("\n\n", *parts).alias("prompt"))
