"""From texts to items, and from items to sections.

An item row has doc_id, pos, kind (heading, section, text or code), depth, text, language
and anchor.  Rows of one document meet in one window by doc_id; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import strip

DEEPEST = 6
MOST_DIAGNOSTICS = 100
EMPTY_CELL = "—"
TICK = "✓"


def normalize_prose(text: Column) -> Column:
    """Runs of white space as one space; one pass, which matches only what changes."""
    return strip(F.regexp_replace(text, r"\s{2,}|[\t\n\r]", " "))


def normalize_code(text: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\A\n", "")
    return F.regexp_replace(lines, r"\s+\z", "")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Items of Markdown: headings, paragraphs, fenced code with its language, lists and quotations.

    docs has doc_id and raw.  A line is inside a fence if the fences before it are odd in number;
    lines of one kind that follow each other are one paragraph.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("raw", F.lit("")), r"\r\n?", "\n"), "\n")).alias("line", "text"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("text").rlike(r"^\s*```")
    rows = lines.withColumn("fences", F.sum(fence.cast("int")).over(before))
    opens, inside = fence & (F.col("fences") % 2 == 1), ~fence & (F.col("fences") % 2 == 1)
    kind = (
        F.when(fence, "fence")
        .when(inside, "code")
        .when(F.col("text").rlike(r"^#{1,6}\s+\S"), "heading")
        .when(F.col("text").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S"), "list")
        .when(F.col("text").rlike(r"^\s*>"), "quote")
        .when(strip(F.col("text")) == "", "blank")
        .otherwise("text")
    )
    rows = rows.withColumn("kind", kind).withColumn("opens", opens)
    order = Window.partitionBy("doc_id").orderBy("line")
    # headings and list entries stand alone; other lines join the run that they continue
    starts = F.col("kind").isin("heading", "list", "blank", "fence") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(before))
    language = F.when(F.col("opens"), strip(F.regexp_replace("text", r"^\s*```", "")))
    rows = rows.withColumn("language", F.last(language, ignorenulls=True).over(before)).where("kind NOT IN ('blank', 'fence')")
    joined = rows.groupBy("doc_id", "run", "kind").agg(
        F.min("line").alias("pos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("raw"),
        F.first("language").alias("language"),
    )
    raw = F.col("raw")
    number = F.regexp_extract(raw, r"^\s*(\d+)[.)]", 1)
    text = (
        F.when(F.col("kind") == "heading", normalize_prose(F.regexp_replace(raw, r"^#{1,6}\s+|\s+#+\s*$", "")))
        .when(F.col("kind") == "code", normalize_code(raw))
        .when(F.col("kind") == "list", F.concat(F.when(number != "", F.concat(number, F.lit(". "))).otherwise("- "), normalize_prose(F.regexp_replace(raw, r"^\s*(?:[-*+]|\d+[.)])\s+", ""))))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), normalize_prose(F.regexp_replace(raw, r"(?m)^\s*>\s?", ""))))
        .otherwise(normalize_prose(raw))
    )
    return joined.select(
        "doc_id",
        "pos",
        F.when(F.col("kind").isin("heading", "code"), F.col("kind")).otherwise("text").alias("kind"),
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract(raw, "^#+", 0))).alias("depth"),
        text.alias("text"),
        F.when((F.col("kind") == "code") & (F.col("language") != ""), F.col("language")).alias("language"),
        F.lit(None).cast("string").alias("anchor"),
    ).where("kind = 'text' OR text != ''")  # a text has a line that isn't blank, so its long expression isn't needed twice


#: The named entities that pages use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
BLOCK = r"(?is)<(h[1-6]|p|li|pre|blockquote)\b([^>]*)>(.*?)(?=</\1\s*>|<(?:h[1-6]|p|li|pre|blockquote|div|section|article|nav|ul|ol|footer)\b|</(?:div|section|article|nav|ul|ol|footer|body)|\z)"


def decode_entities(text: Column) -> Column:
    for name, letter in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def plain_html(html: Column) -> Column:
    """A page without scripts, styles, media and comments."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|svg|video|audio|noscript)\b.*?</\1\s*>", " ")


def inner_text(html: Column) -> Column:
    return normalize_prose(decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def html_head(pages: DataFrame) -> DataFrame:
    """Title and description from each page's head (null where it has none)."""
    title = inner_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1))
    described = decode_entities(F.regexp_extract("html", r"""(?is)<meta\s+name=["']description["']\s+content=["']([^"']*)""", 1))
    return pages.select("page_id", F.nullif(title, F.lit("")).alias("head_title"), F.nullif(described, F.lit("")).alias("description"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Items of pages with page_id and html; an element that isn't closed ends where the next begins."""
    plain = plain_html(F.coalesce("html", F.lit("")))
    zipped = F.arrays_zip(*(F.regexp_extract_all(plain, F.lit(BLOCK), k).alias(n) for k, n in ((1, "tag"), (2, "attributes"), (3, "inner"))))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(zipped).alias("pos", "b"))
    tag = F.lower("b.tag")
    text = (
        F.when(tag == "pre", normalize_code(decode_entities(F.regexp_replace("b.inner", r"(?s)<[^>]*>", ""))))
        .when(tag == "li", F.concat(F.lit("- "), inner_text(F.col("b.inner"))))
        .when(tag == "blockquote", F.concat(F.lit("> "), inner_text(F.col("b.inner"))))
        .otherwise(inner_text(F.col("b.inner")))
    )
    head = tag.rlike("^h[1-6]$")
    anchor = F.regexp_extract("b.attributes", r"""(?i)\bid=["']([^"']+)""", 1)
    return rows.select(
        "doc_id", "pos",
        F.when(head, "heading").when(tag == "pre", "code").otherwise("text").alias("kind"),
        F.when(head, F.substring(tag, 2, 1).cast("int")).alias("depth"),
        text.alias("text"), F.lit(None).cast("string").alias("language"), F.nullif(anchor, F.lit("")).alias("anchor"),
    ).where("text NOT IN ('', '- ', '> ')")


def table_rows(header: Column, rows: Column) -> Column:
    """Lines of a table: cells joined, empty ones marked, true ones ticked."""
    cell = lambda c: F.when(F.coalesce(strip(c), F.lit("")) == "", EMPTY_CELL).when(c == "true", TICK).otherwise(strip(c))
    line = lambda r: F.array_join(F.transform(r, cell), " | ")
    return F.concat(F.when(F.size(header) > 0, F.array(line(header))).otherwise(F.array().cast("array<string>")), F.transform(F.filter(rows, lambda r: F.size(r) > 0), line))


def labelled_blocks(parts: DataFrame) -> DataFrame:
    """Items of labelled parts (doc_id, pos, component, label, content).

    Tabs, steps and notes give a text item with their label before the content; a question
    becomes a section marker with the answer as text.
    """
    lead = F.when(F.col("component") == "tab", F.concat(F.lit("Tab: "), "label")).when(F.col("component") == "step", F.concat(F.lit("Step "), "label")).when(F.col("component") == "note", F.lit("Note:"))
    marks = parts.where("component = 'question'").select("doc_id", (F.col("pos") * 2).alias("pos"), F.lit("section").alias("kind"), F.lit(1).alias("depth"), normalize_prose(F.col("label")).alias("text"))
    said = F.when(F.col("component") == "question", F.col("content")).otherwise(F.concat_ws("\n", lead, "content"))
    texts = parts.select("doc_id", (F.col("pos") * 2 + 1).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("depth"), normalize_prose(said).alias("text"))
    more = {"language": F.lit(None).cast("string"), "anchor": F.lit(None).cast("string")}
    return marks.unionByName(texts).where("text != ''").withColumns(more)


def compact_blocks(items: DataFrame) -> DataFrame:
    """Without empty items, and without a text that repeats the kept text before it.

    Of a run of equal texts the first stays, so comparing with the row before is enough.
    """
    earlier = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = strip(F.col("text")) != ""
    # empty items go after the window: before it, the filter would work out each text a second time
    before = F.last(F.when(said, F.struct("kind", "text")), ignorenulls=True).over(earlier)
    same = (F.col("kind") == "text") & (F.col("_before.kind") == "text") & (F.col("_before.text") == F.col("text"))
    return items.withColumn("_before", before).where(said & ~F.coalesce(same, F.lit(False))).drop("_before")


def pick_titles(items: DataFrame, heads: DataFrame) -> DataFrame:
    """Title of each document of ``heads`` (doc_id, head_title, slug): first heading of any depth, head, slug."""
    first = items.where("kind = 'heading'").groupBy("doc_id").agg(F.min_by("text", "pos").alias("first_heading"), F.min("pos").alias("title_pos"))
    return heads.join(first, "doc_id", "left").select("doc_id", F.coalesce("first_heading", "head_title", "slug").alias("title"), "title_pos")


def sectioned(items: DataFrame) -> DataFrame:
    """Each item with the number of its section and, on markers, the heading path.

    The first heading is the title: it opens no section.  A heading of level L keeps those
    ancestors of a level below L after which no heading of a lower level came.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = F.sum((F.col("kind") == "heading").cast("int")).over(before)
    marker = (F.col("kind") == "section") | ((F.col("kind") == "heading") & (F.col("heads") > 1))
    rows = items.withColumn("heads", heads).withColumn("marker", marker).where("marker OR kind NOT IN ('heading', 'section')")
    level = F.when(F.col("marker"), F.when(F.col("kind") == "section", F.lit(1)).otherwise(F.greatest(F.lit(1), F.col("depth") - 1)))
    rows = rows.withColumn("level", level).withColumn("section_no", F.sum(F.col("marker").cast("int")).over(before))
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "text")), ignorenulls=True).over(before) for k in range(1, DEEPEST)}
    rows = rows.withColumns({f"_l{k}": c for k, c in last.items()})
    path = []
    for k in range(1, DEEPEST):
        at = F.col(f"_l{k}.pos")
        fresh = [F.coalesce(at > F.col(f"_l{j}.pos"), F.col(f"_l{j}").isNull()) for j in range(1, k)]
        ok = (F.col("level") >= k) & at.isNotNull()
        for f in fresh:
            ok = ok & f
        path.append(F.when(ok, F.col(f"_l{k}.text")))
    return rows.withColumn("heading_path", F.when(F.col("marker"), F.array_compact(F.array(*path)))).drop(*(f"_l{k}" for k in range(1, DEEPEST)), "heads", "level")


def build_sections(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, their blocks, and diagnostics about repeated anchors.

    Sections without text are dropped and order counts those that stay; a repeated anchor stays
    with its first section.
    """
    return sections_of(sectioned(items))


def sections_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`build_sections`, from the rows of :func:`sectioned`, which may be stored."""
    own = rows.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("marker"), F.col("text"))).alias("heading"),
        F.max(F.when(F.col("marker"), F.col("heading_path"))).alias("heading_path"),
        F.max(F.when(F.col("marker"), F.col("anchor"))).alias("anchor"),
        F.min("pos").alias("pos"),
        F.count_if(~F.col("marker") & (strip(F.col("text")) != "")).alias("n_blocks"),
    )
    order = Window.partitionBy("doc_id").orderBy("section_no")
    kept = own.where("n_blocks > 0").withColumn("section_order", F.row_number().over(order) - 1)
    use = F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy("section_order"))
    kept = kept.withColumn("use", F.when(F.col("anchor").isNotNull(), use))
    sections = kept.select(
        "doc_id", "section_no", "section_order", "heading", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"),
        F.when(F.col("use") == 1, F.col("anchor")).alias("anchor"), "n_blocks",
    )
    doubled = kept.where("use > 1").select(
        "doc_id", "section_order", F.lit("duplicate_section_anchor").alias("code"), F.concat(F.lit("another section has the anchor "), "anchor").alias("message"), F.col("pos")
    )
    blocks = rows.where("NOT marker").join(sections.select("doc_id", "section_no", "section_order"), ["doc_id", "section_no"])
    numbered = Window.partitionBy("doc_id", "section_no").orderBy("pos")  # as the join has dealt them
    return sections, blocks.select("doc_id", "section_order", (F.row_number().over(numbered) - 1).alias("block_no"), "kind", "text", "language"), doubled


def classify_skips(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents (doc_id, raw) without sections, and why."""
    blank = strip(F.coalesce("raw", F.lit(""))) == ""
    reasons = docs.select("doc_id", F.when(blank, "empty_source").otherwise("no_retrievable_content").alias("reason"))
    return reasons.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")


def limit_diagnostics(found: DataFrame, most: int = MOST_DIAGNOSTICS) -> DataFrame:
    """At most ``most`` rows a document in their order (``pos``), then one that says so.

    found has doc_id, pos and code, and message and position (line, column, offset) where they are known.
    """
    place = "struct<line:int,column:int,offset:int>"
    more = {c: F.lit(None).cast(k) for c, k in (("message", "string"), ("position", place)) if c not in found.columns}
    rows = found.withColumns(more).withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "code")))
    kept = rows.where(F.col("turn") <= most).select("doc_id", "turn", "code", "message", F.col("position").cast(place).alias("position"))
    over = rows.where(F.col("turn") == most + 1).select(
        "doc_id", "turn", F.lit("diagnostic_limit_reached").alias("code"), F.lit(f"more than {most} diagnostics").alias("message"), F.lit(None).cast(place).alias("position")
    )
    return kept.unionByName(over)
