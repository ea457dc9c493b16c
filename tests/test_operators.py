"""Examples with literal rows for what the driver tables can't show."""

import itertools
import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.functions import dims, text
from docweave.functions.identity import digest_id, section_id
from docweave.operators import audits, chunking, conversations, evidence, index, logs, policy, ranking, routing, structure
from docweave.plans import further
from docweave.sources import corpus, history
from docweave.streaming import chat_log


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_text(spark):
    c = F.col("t")
    assert one(spark, text.normalize_text(c), t="ＮＥＸＴ.js  و كتابِ‌ يك") == "next.js و کتاب یک"
    assert one(spark, text.tokenize(c), t="Use @acme/cli and next.js!") == ["use", "@acme/cli", "acme", "cli", "acmecli", "and", "next.js", "next", "js", "nextjs"]
    assert one(spark, text.tokenize(c), t=" ?! ") == []
    assert one(spark, text.text_direction(c), t="سلام world") == "ltr"
    assert one(spark, text.text_direction(c), t="سلام دنیا ok") == "rtl"
    assert one(spark, text.text_direction(c), t="ab سل") == "ltr" and one(spark, text.text_direction(c), t="سل ab") == "rtl"
    assert one(spark, text.technical_spans(c), t=r"see https://a.b/c (C:\x\y) /var/log/app 10.0.0.1") == ["https://a.b/c", r"C:\x\y)", "/var/log/app", "10.0.0.1"]
    assert [tuple(x) for x in one(spark, text.fenced_code(c), t="a\n```\nx\n```\nb\n```py\ny\nz\n```")] == [("text", "x"), ("py", "y\nz")]
    assert one(spark, text.jaccard(F.split("a", " "), F.split("b", " ")), a="x y z", b="y z w") == 0.5
    assert one(spark, text.is_persian(F.col("q"), F.col("p")), q="hello", p="fa-IR") and not one(spark, text.is_persian(F.col("q"), F.col("p")), q="سلام", p="en")


def test_ids_keep_borders_apart(spark):
    ids = {one(spark, digest_id("x_", F.array(*map(F.lit, parts)), "n")) for parts in (["a", "bc"], ["ab", "c"], ["a", "b", "c"])}
    assert len(ids) == 3
    a = one(spark, section_id(F.lit("d"), F.array(F.lit("A"), F.lit("B")), F.lit(None).cast("string"), F.lit(0)))
    b = one(spark, section_id(F.lit("d"), F.array(F.lit("A")), F.lit("B"), F.lit(0)))
    assert a != b and len(a) == len("section_") + 24


def test_paths(spark):
    rows = ["src/pages/paas/nodejs/guide.mdx", "src/pages/one-click-apps/wordpress/setup.mdx", "src/pages/one-click-apps/about/x.mdx", "/src/pages/paas/a.mdx", "src/pages/paas/../a.mdx", "src/pages/paas/.mdx", "src/pages/other/a.mdx", "src\\pages\\a.mdx", "src/pages/paas/a b.mdx"]
    files = spark.createDataFrame([(r, "A" * 40, "x") for r in rows], "path string, revision string, raw string")
    good, bad = policy.build_sources(files, dims.categories(spark, ["paas", "one-click-apps"]), dims.taxonomy(spark), "https://d.example", "https://c.example/d")
    found = {r.path: (r.framework, r.service, r.published_url) for r in good.collect()}
    assert found == {rows[0]: ("nodejs", None, "https://d.example/paas/nodejs/guide/"), rows[1]: (None, "wordpress", "https://d.example/one-click-apps/wordpress/setup/"), rows[2]: (None, None, "https://d.example/one-click-apps/about/x/")}
    assert {r.path: r.code for r in bad.collect()} == {r: "UNSUPPORTED_CATEGORY" if "other" in r else "INVALID_REPOSITORY_PATH" for r in rows[3:]}
    links = spark.createDataFrame([("https://d.example/x",), ("http://d.example/x",), ("https://c.example/d/y",), ("https://c.example/dd",), ("nonsense ::",)], "url string")
    got = policy.with_allowlisted(links, dims.origins(spark, [("d.example", None), ("c.example", "/d")]))
    assert [r.url for r in got.where("allowlisted").collect()] == ["https://d.example/x", "https://c.example/d/y"]


def test_scan_and_write(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src/pages/paas").mkdir(parents=True)
    (root / "src/pages/paas/a.mdx").write_text("# é")
    (root / "src/pages/paas/b.txt").write_text("no")
    (root / "src/pages/paas/c.mdx").write_text("x" * 300)
    got = corpus.scan_corpus(spark, str(root))
    small, large = corpus.enforce_size(got, 100)
    assert [(r.path, r.raw) for r in small.collect()] == [("src/pages/paas/a.mdx", "# é")]
    assert [(r.path, r.code) for r in large.collect()] == [("src/pages/paas/c.mdx", "FILE_TOO_LARGE")]
    corpus.write_corpus(str(tmp_path / "out"), files=small.withColumn("category", F.lit("paas")))
    assert spark.read.parquet(str(tmp_path / "out/files")).count() == 1
    with pytest.raises(Exception, match="FILE_TOO_LARGE"):
        corpus.fail_on(large).collect()


def test_sections_keep_ancestry(spark):
    raw = "# Title\nintro one\nintro two\n\n## A\ntext a\n### B\n- item\n1. first\n> quote\n> more\n#### C\n## D\n```py\n# not a heading\n```\n### E\nend\nend"
    items = structure.markdown_blocks(spark.createDataFrame([(1, raw), (2, " "), (3, "# only")], "doc_id long, raw string"))
    sections, blocks, doubled = structure.build_sections(structure.compact_blocks(items))
    got = [(r.heading, r.heading_path) for r in sections.orderBy("section_order").collect()]
    assert got == [(None, []), ("A", ["A"]), ("B", ["A", "B"]), ("D", ["D"]), ("E", ["D", "E"])]
    said = [(r.section_order, r.kind, r.text) for r in blocks.orderBy("section_order", "block_no").collect()]
    assert said == [(0, "text", "intro one intro two"), (1, "text", "text a"), (2, "text", "- item"), (2, "text", "1. first"), (2, "text", "> quote more"), (3, "code", "# not a heading"), (4, "text", "end end")]
    skips = structure.classify_skips(spark.createDataFrame([(1, raw), (2, " "), (3, "# only")], "doc_id long, raw string"), sections)
    assert {(r.doc_id, r.reason) for r in skips.collect()} == {(2, "empty_source"), (3, "no_retrievable_content")}
    assert doubled.count() == 0


def test_repeated_anchors_and_labels(spark):
    rows = [(1, 0, "heading", 1, "T", "t"), (1, 1, "heading", 2, "A", "same"), (1, 2, "text", None, "x", None), (1, 3, "heading", 2, "B", "same"), (1, 4, "text", None, "y", None), (1, 5, "text", None, "y", None)]
    items = spark.createDataFrame(rows, "doc_id long, pos long, kind string, depth int, text string, anchor string").withColumn("language", F.lit(None).cast("string"))
    sections, blocks, doubled = structure.build_sections(structure.compact_blocks(items))
    assert [(r.heading, r.anchor) for r in sections.orderBy("section_order").collect()] == [("A", "same"), ("B", None)]
    assert [r.code for r in doubled.collect()] == ["duplicate_section_anchor"] and blocks.count() == 2
    parts = spark.createDataFrame([(1, 0, "question", "Why?", "Because."), (1, 1, "note", None, "Mind."), (1, 2, "tab", "npm", "run")], "doc_id long, pos long, component string, label string, content string")
    assert [(r.kind, r.text) for r in structure.labelled_blocks(parts).orderBy("pos").collect()] == [("section", "Why?"), ("text", "Because."), ("text", "Note: Mind."), ("text", "Tab: npm run")]
    got = one(spark, structure.table_rows(F.split("h", ","), F.array(F.split("r", ","))), h="a,b", r="true,")
    assert got == ["a | b", "✓ | —"]
    many = spark.range(150).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit("c").alias("code"))
    got = structure.limit_diagnostics(many).collect()
    assert len(got) == 101 and sum(r.code == "diagnostic_limit_reached" for r in got) == 1
    placed = spark.createDataFrame([(1, 0, "c", "said", (1, 2, 3))], "doc_id long, pos long, code string, message string, position struct<line:int,column:int,offset:int>")
    r = structure.limit_diagnostics(placed).first()
    assert r.message == "said" and tuple(r.position) == (1, 2, 3)


def test_prose_of_every_run_of_white_space(spark):
    """One pass gives what the steps give one after the other: line ends, tabs and spaces, lines, runs."""
    runs = ["".join(r) for n in range(1, 5) for r in itertools.product(" \t\n\r\x0b\f", repeat=n)]
    steps = [(r"\r\n?", "\n"), ("[\t ]+", " "), (" *\n *", " "), (r"[ \t\n\x0b\f\r]{2,}", " ")]
    want = {}
    for r in runs:
        text = f"a{r}b"
        for what, by in steps:
            text = re.sub(what, by, text)
        want[r] = text
    got = spark.createDataFrame([(r,) for r in runs], "r string").select("r", structure.normalize_prose(F.concat(F.lit("a"), "r", F.lit("b"))).alias("t"))
    assert {x.r: x.t for x in got.collect()} == want


def test_repeated_texts_go_past_empty_ones(spark):
    rows = [(1, 0, "text", "a"), (1, 1, "text", " "), (1, 2, "text", "a"), (1, 3, "heading", "h"), (1, 4, "text", "a"), (1, 5, "code", "\u00a0"), (1, 6, "text", "a"), (1, 7, "text", None), (2, 0, "text", "a")]
    got = structure.compact_blocks(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string"))
    assert sorted((r.doc_id, r.pos) for r in got.collect()) == [(1, 0), (1, 3), (1, 4), (2, 0)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_worked_out_once_and_rows_cut_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\n\nx\n\n# B\n\ny\n\nz"), (2, "# C\n\nw")], "doc_id long, raw string")
    items = structure.compact_blocks(structure.markdown_blocks(docs))
    marked = r"(?m)^\s*>\s?"  # a pattern of the text's expression, which the filter of empty items doesn't repeat
    assert plan_of(items).count(marked) == plan_of(structure.markdown_blocks(docs)).count(marked)
    structure.sectioned(items).write.parquet(f"{tmp_path}/rows")
    stored = structure.sections_of(spark.read.parquet(f"{tmp_path}/rows"))
    for a, b in zip(stored, structure.build_sections(items)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert sorted(tuple(r)[:3] for r in stored[1].collect()) == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 0, 0)]


def test_html(spark):
    html = "<html><head><title>A &amp; B</title><meta name='description' content='d'></head><body><h1 id='x'>Top</h1><p>one <b>two</b><p>three<ul><li>item</ul><script>bad()</script><pre>\n a\n  b\n</pre></body></html>"
    page = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.kind, r.text, r.anchor) for r in structure.html_blocks(page).orderBy("pos").collect()] == [("heading", "Top", "x"), ("text", "one two", None), ("text", "three", None), ("text", "- item", None), ("code", " a\n  b", None)]
    assert structure.html_head(page).orderBy("page_id").collect()[0][1:] == ("A & B", "d")


def test_chunks(spark):
    assert chunking.text_parts("word " * 100, 60)[0] == ("word " * 12).strip()
    code = "\n".join("line %d" % k for k in range(100))
    assert "".join(chunking.code_parts(code, 50)) == code and max(map(len, chunking.code_parts(code, 50))) <= 50
    made = chunking.packed(["text", "text", "code", "text"], ["a" * 150, "b" * 90, "c" * 100, "d" * 90], 260, 100)
    assert made == ["a" * 150 + "\n\n" + "b" * 90, "b" * 90 + "\n\n" + "c" * 100, "d" * 90]
    with pytest.raises(ValueError):
        chunking.check_budget(199, 0)
    blocks = spark.createDataFrame([(1, 0, 0, "code", "x\n" * 400, "py"), (1, 0, 1, "text", "tail words " * 40, None)], "doc_id long, section_order int, block_no int, kind string, text string, language string")
    got = chunking.number_chunks(chunking.pack_chunks(chunking.expand_blocks(blocks, 300), 300, 60)).orderBy("chunk_order").collect()
    assert all(len(r.content) <= 300 for r in got) and [r.chunk_order for r in got] == list(range(len(got)))
    assert got[0].content.startswith("```py\n")


def test_batches_are_turned_into_objects_by_stretches(spark):
    """A worker's memory goes by bytes, whatever the rows of a batch are; rows keep their order."""
    texts = pa.array(["a" * 10, None, "", "b" * 5000, "c" * 30, *["d" * 40] * 200, None], pa.string())
    got = list(chunking.stretches(texts, pa.array(range(len(texts))), most=500))
    assert [x for part, _ in got for x in part] == texts.to_pylist() and [k for _, part in got for k in part] == list(range(len(texts)))
    assert all(len(part) == 1 or sum(len(x or "") for x in part) <= 500 for part, _ in got) and len(got) > 10
    assert list(chunking.stretches(texts.slice(0, 0))) == [([],)]
    rows = [(k, None if k % 7 == 0 else f"{k} line\n" * (k % 5 * 3000)) for k in range(300)]  # several stretches in one batch
    each = spark.createDataFrame(rows, "k long, t string").coalesce(1).select("k", "t", chunking.split_code(F.col("t"), F.lit("py")).alias("c"), chunking.split_text(F.col("t")).alias("p"))
    for r in each.collect():
        assert (r.c, r.p) == ((None, None) if r.t is None else (chunking.code_parts(r.t, 1790), chunking.text_parts(r.t, 1800)))


def test_sections_are_packed_by_stretches(spark, monkeypatch):
    lists = pa.array([["u" * 90] * (k % 6) for k in range(100)], pa.list_(pa.string()))
    got = [part for (part,) in chunking.stretches(lists, most=1500)]
    assert [x for part in got for x in part] == lists.to_pylist() and max(sum(map(len, sum(part, []))) for part in got) <= 1500
    seen = []  # rows that are objects at once, in this process
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: lambda *a: seen.extend(len(x) for x in f(iter([(lists, lists)]))) or F.array(F.lit("")))
    monkeypatch.setattr(chunking.stretches, "__defaults__", None)
    monkeypatch.setattr(chunking.stretches, "__kwdefaults__", {"most": 1500})
    chunking.pack_chunks(spark.createDataFrame([(1, 0, 0, 0, "text", "u")], "doc_id long, section_order int, block_no int, part int, kind string, rendered string"))
    assert sum(seen) == 100 and max(seen) < 20


def test_tokens_are_counted_within_rows(spark):
    rows = [(1, ["b", "a", "b", None, "b", None]), (2, []), (3, None), (4, ["x"]), (5, ["k"] * 5000 + ["j"])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = {(1, "a", 1), (1, "b", 3), (1, None, 2), (4, "x", 1), (5, "k", 5000), (5, "j", 1)}
    got = text.token_frequencies(docs, "id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and got.columns == ["id", "token", "n"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # ids that have one row stay where they are
    again = docs.union(spark.createDataFrame([(4, ["x", "y"]), (None, ["n"]), (None, ["n"])], docs.schema))
    more = (want - {(4, "x", 1)}) | {(4, "x", 2), (4, "y", 1), (None, "n", 2)}
    assert sorted(map(str, map(tuple, text.token_frequencies(again, "id").collect()))) == sorted(map(str, more))
    assert {r.id: r.frequencies for r in text.frequency_map(docs.where("id > 3"), "id").collect()} == {4: {"x": 1}, 5: {"k": 5000, "j": 1}}


def test_pages_lie_in_folders_of_one_task(spark, tmp_path):
    """The end of the write and the listing have a step for each folder, not for each page."""
    rows = [(k, f"<p>{k}</p>") for k in range(200)] + [(7, "<p>again</p>")]
    further.write_pages(spark.createDataFrame(rows, "page_id long, html string").coalesce(2), f"{tmp_path}/tree")
    folders = [p for p in (tmp_path / "tree").iterdir() if p.is_dir()]
    assert len(folders) <= 2 * further.SHARDS and all(p.name.startswith("shard=") for p in folders)
    further.write_pages(spark.range(0, 200 * 64, 64).selectExpr("id AS page_id", "'x' AS html").coalesce(1), f"{tmp_path}/like")  # ids that are alike are dealt out too
    assert 32 < sum(p.is_dir() for p in (tmp_path / "like").iterdir()) <= further.SHARDS
    found = corpus.scan_corpus(spark, f"{tmp_path}/tree", "*.txt").select(F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("k"), "raw", "length")
    assert sorted(map(tuple, found.collect())) == sorted((k, f"{t}\n", len(t) + 1) for k, t in rows)


def chunk(spark, rows):
    kind = "chunk_id long, document_id long, section_id long, path string, published_path string, title string, heading string, heading_path array<string>, content string, chunk_order int, category string, framework string, service string"
    return spark.createDataFrame([(i, d, s, f"src/pages/paas/{t}/p{i}.mdx", f"/paas/{t}/p{i}/", title, None, [], body, 0, "paas", t, None) for i, d, s, t, title, body in rows], kind)


def test_retrieval_of_aliases_filters_and_duplicates(spark):
    same = "install the package and configure the server with care before you begin the journey " + " ".join(f"w{k}" for k in range(30))
    rows = [(1, 1, None, "nextjs", "Next.js guide", "How to deploy a Next.js application"), (2, 2, None, "django", "Django", "django settings and database"), (3, 3, None, "php", "Copy", same), (4, 4, None, "php", "Copy two", same), (5, 5, 1, "vue", "Part", same + " x"), (6, 5, 2, "vue", "Part", same + " y")]
    rows += [(10 + k, 10 + k, None, "go", f"t{k}", f"filler number {k}") for k in range(6)]
    questions = spark.createDataFrame([(1, "استقرار nextjs", 5.0, None), (2, "django database", 5.0, "PHP"), (3, "configure package journey care w1 w2", 5.0, None), (4, "how to", 5.0, None), (5, "django database", 0.0, None), (6, "django settings", float("nan"), "d.j-a ngo")], "question_id long, text string, limit double, framework string")
    matches, outcome = ranking.retrieve(questions, ranking.build_index(chunk(spark, rows)), dims.stopwords(spark), dims.aliases(spark))
    got = {}
    for r in matches.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got[1] == [1]
    assert got[3] == [3]  # equal and near bodies are left out
    said = {r.question_id: (r.kind, r.considered_count) for r in outcome.collect()}
    assert said[2] == ("no_matches", 2) and said[4] == ("no_matches", 0) and said[5] == ("no_matches", 0) and said[6] == ("no_matches", 0)


def test_context_and_citations(spark):
    rows = [(1, 1, "T", None, "u", "one"), (1, 2, "T", "S", "u", " one "), (1, 3, "T", None, "u", "x" * 500), (1, 4, "T", None, "u", "four"), (1, 5, "T", None, "u", " ")]
    m = spark.createDataFrame(rows, "question_id long, rank int, title string, heading string, published_url string, content string").withColumn("chunk_id", F.col("rank"))
    kept, contexts = evidence.pack_context(m, 220)
    assert [(r.citation_index, r.chunk_id) for r in kept.orderBy("citation_index").collect()] == [(1, 1), (2, 4)]
    said = json.loads(contexts.first().formatted)
    assert [x["citation"] for x in said] == [1, 2] and said[0]["section"] is None and list(said[0]) == ["citation", "title", "section", "officialUrl", "content"]
    assert one(spark, evidence.encode_component(F.col("t")), t="a b(é)*~'!") == "a%20b(%C3%A9)*~'!"


def test_routes(spark):
    rows = [("سلام خوبی!", None), ("HELLO!!", None), ("thank you very much.", None), ("okay", None), ("Can you help me?", None), ("my build fails", None), ("It failed", "django"), ("Django build error: exit code 1", None), ("how do I deploy?", None)]
    r = spark.createDataFrame([(k, m, [], f, None, None, None) for k, (m, f) in enumerate(rows)], "request_id long, message string, recent array<struct<role:string,content:string>>, framework string, runtime string, service string, preferred_language string")
    got = {x.request_id: (x.route, x.intent, x.language) for x in routing.route(r, dims.intents(spark)).collect()}
    assert [got[k] for k in range(5)] == [("direct", "greeting", "fa"), ("direct", "greeting", "en"), ("direct", "thanks", "en"), ("direct", "acknowledgement", "en"), ("direct", "meta", "en")]
    assert got[5][0] == got[6][0] == "clarification" and got[7][0] == got[8][0] == "retrieve"


def test_history_round_trip(spark):
    good = json.dumps([{"id": "c1", "title": "t", "updatedAt": "2024-01-02T03:04:05.000Z", "pinned": False, "archived": True}])
    found, bad = history.read_history(spark.createDataFrame([(1, good), (2, "nonsense"), (3, "[" + ",".join([good[1:-1]] * 201) + "]")], "owner long, json string"))
    empty, none = history.read_history(spark.createDataFrame([(4, "[]")], "owner long, json string"))
    assert [(r.owner, r.conv_id) for r in empty.collect()] == [(4, None)] and none.count() == 0 and history.write_history(empty).first().json == "[]"
    assert [(r.owner, r.conv_id, r.entries) for r in found.collect()] == [(1, "c1", [])] and {r.owner for r in bad.collect()} == {2, 3}
    assert json.loads(history.write_history(found).first().json)[0]["archived"] is True


def whole_entry():
    source = {"id": "s", "title": "T", "url": "https://d.example/x", "snippet": "said"}
    code = {"fileName": "a.py", "language": "py", "lines": [{"tokens": [{"text": "x", "tone": "plain"}], "important": True}], "note": "n"}
    response = {"analysis": "a", "problemDetected": "p", "whyThisHappens": "w", "recommendedFix": "r", "codeExample": code}
    error = {"code": "TIMEOUT", "message": "late", "requestId": "r1", "retryable": True}
    return {
        "id": "e1", "prompt": "why", "sentAt": "2024-01-02T03:04:05.000Z", "response": response, "agentState": "generating", "outcomeStatus": "completed",
        "citations": [{"id": "c", "displayIndex": 1, "source": source}], "suggestions": [{"id": "g", "label": "L", "prompt": "P"}], "liveText": "", "error": error,
        "cancelled": False, "transportMode": "live",
    }


def test_history_keeps_whole_entries(spark):
    record = {"id": "c1", "title": "t", "updatedAt": "2024-01-02T03:04:05.000Z", "pinned": False, "archived": True, "entries": [whole_entry()]}
    spoilt = [{"prompt": " "}, {"sentAt": "yesterday"}, {"agentState": "x"}, {"transportMode": "x"}, {"error": {"code": "X", "message": "m", "requestId": "r", "retryable": True}}, {"citations": [{"id": "c", "displayIndex": 100, "source": {"id": "s", "title": "T", "url": "https://d"}}]}, {"suggestions": [{"id": "g", "label": "L", "prompt": "P"}] * 5}]
    rows = [(1, json.dumps([record])), (2, json.dumps([{**record, "more": 1}])), (3, json.dumps([{**record, "entries": [{**whole_entry(), "more": 1}]}])), (4, json.dumps([record, {k: v for k, v in record.items() if k != "entries"}])), (5, json.dumps([{**record, "title": "t" * 81}])), (6, None)]
    rows += [(10 + k, json.dumps([{**record, "entries": [{**whole_entry(), **s}]}])) for k, s in enumerate(spoilt)]
    found, bad = history.read_history(spark.createDataFrame(rows, "owner long, json string"))
    assert {r.owner for r in bad.collect()} == {2, 4, 5, 6, *(10 + k for k in range(len(spoilt)))}
    back = {r.owner: json.loads(r.json) for r in history.write_history(found).collect()}
    assert back[1] == [record] and back[3] == [record]
    rows = spark.createDataFrame(rows[:1], "owner long, json string")
    assert history.read_history(rows, [("d.example", "/x")])[1].count() == 0 and history.read_history(rows, [("d.example", "/y"), ("e.example", None)])[1].count() == 1
    long = found.where("owner = 1").withColumn("entries", F.array_repeat(F.col("entries")[0], 101))
    assert json.loads(history.write_history(long).first().json)[0]["entries"] == []


def test_requests_are_strict(spark):
    good = {"version": "1", "message": " hi ", "recentContext": [{"role": "user", "content": "x"}], "userContext": {"framework": "django", "answerDepth": "concise"}, "conversationId": "c-1"}
    spoilt = {
        "bad_version": {"version": 1}, "bad_message": {"message": 5}, "bad_recent": {"recentContext": [{"role": "user", "content": "x", "more": 1}]}, "bad_conversation_id": {"conversationId": 7},
        "bad_user_context": {"userContext": {"framework": " "}}, "unknown_field": {"userContext": {"x": "y"}},
    }
    more = [("bad_message", {"message": "\n\u00a0\n"}), ("bad_message", {"message": "x" * 8001}), ("bad_recent", {"recentContext": [{"role": "user", "content": "x"}] * 7}), ("bad_recent", {"recentContext": [{"role": "system", "content": "x"}]}), ("bad_recent", {"recentContext": [{"role": "user", "content": "x" * 1500}] * 5}), ("bad_recent", {"recentContext": "x"}), ("bad_user_context", {"userContext": {"answerDepth": "deep"}}), ("bad_client_request_id", {"clientRequestId": None})]
    cases = [*spoilt.items(), *more]
    rows = [(0, json.dumps(good)), (1, '{"version":"1","message":"m"}')] + [(10 + k, json.dumps({**good, **s})) for k, (_, s) in enumerate(cases)] + [(90, "{"), (91, None), (92, "[]")]
    ok, bad = conversations.validate_requests(spark.createDataFrame(rows, "request_id long, body string"))
    assert {r.request_id: r.message for r in ok.collect()} == {0: "hi", 1: "m"}
    codes = {r.request_id: r.codes for r in bad.collect()}
    assert {i: codes[i] for i in codes if i < 90} == {10 + k: [code] for k, (code, _) in enumerate(cases)}
    assert all("not_json" in codes[i] for i in (90, 91, 92))


def test_long_runs_of_parts(spark):
    """One megabyte of parts in one run: neither the stack nor the time may grow with it."""
    for made in (text.normalize_text(F.col("t")), F.array_join(text.tokenize(F.col("t")), " "), F.array_join(text.technical_spans(F.col("t")), " ")):
        for t in ("a." * 500_000, "/x" * 500_000, "1.2" * 330_000):
            assert len(one(spark, made, t=t) or "") >= 0
    assert chunking.text_parts("x" * 1_000_000, 1800)[-1] == "x" * (1_000_000 % 1800)


def test_stable_characters():
    """No character of the class changes in composition, alone or beside another; so texts of them need no Python."""
    import random
    import re
    import unicodedata

    stable = [c for c in map(chr, range(0x2100)) if re.match(f"[{text.STABLE}]", c.encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass"))]
    assert len(stable) > 500 and all(unicodedata.normalize("NFKC", c) == c for c in stable)
    pick = random.Random(1)
    for _ in range(20_000):
        run = "".join(pick.choices(stable, k=6))
        assert unicodedata.normalize("NFKC", run) == run


def slow_pack(units, most, overlap):
    """Chunks by the stated rules, one unit at a time."""
    chunks, held = [], []
    length = lambda us: len("\n\n".join(t for _, t in us))
    for unit in units:
        if held and length(held + [unit]) > most:
            chunks.append(held)
            whole = max((k for k in range(len(held) + 1) if all(x == "text" for x, _ in held[len(held) - k :]) and (k == 0 or length(held[len(held) - k :]) <= overlap)), default=0)
            kind, last = held[-1]
            if overlap == 0:
                held = []
            elif whole:
                held = held[len(held) - whole :]
            elif kind == "text":
                end = last[-overlap:]
                end = (end[end.index(" ") + 1 :] if " " in end else end).strip()
                held = [("text", end)] if end else []
            else:
                held = []
            if length(held + [unit]) > most:
                held = []
        held = held + [unit]
    return ["\n\n".join(t for _, t in c) for c in chunks + [held] if c]


def test_packing_against_the_rules():
    import random

    pick = random.Random(4)
    for _ in range(600):
        most, overlap = pick.randint(20, 60), pick.choice([0, 5, 12, 19])
        units = []
        for _ in range(pick.randint(0, 14)):
            words = " ".join("w" * pick.randint(1, 9) for _ in range(pick.randint(1, 6)))[:most].strip()
            units.append((pick.choice(["text", "text", "text", "code"]), words))
        assert chunking.packed([k for k, _ in units], [t for _, t in units], most, overlap) == slow_pack(units, most, overlap)


def test_preferences_and_parts(spark):
    whole = {"userContext": {"framework": "django"}, "connectionMode": "live", "sendOnEnter": True}
    spoilt = [{"more": 1}, {"connectionMode": "other"}, {"sendOnEnter": "true"}, {"userContext": {"framework": 5}}, {"userContext": {"x": "y"}}, {"userContext": []}, {"userContext": {"answerDepth": "deep"}}]
    rows = [(1, json.dumps(whole)), (2, json.dumps({**whole, "userContext": {}})), (3, "x"), (4, None), (5, json.dumps({"connectionMode": "live", "sendOnEnter": True}))]
    rows += [(10 + k, json.dumps({**whole, **s})) for k, s in enumerate(spoilt)]
    good, bad = conversations.read_preferences(spark.createDataFrame(rows, "id long, json string"))
    assert [r.id for r in good.orderBy("id").collect()] == [1, 2] and {r.id for r in bad.collect()} == {i for i, _ in rows[2:]}
    parts = [(1, 1, "text", "he"), (1, 3, "text", "llo"), (1, 2, "citation", "c1"), (1, 4, "citation", "c1"), (1, 5, "agent-state", "a"), (1, 6, "agent-state", "b"), (1, 7, "outcome", "ok")]
    r = conversations.fold_parts(spark.createDataFrame(parts, "request_id long, seq int, type string, payload string")).first()
    assert (r.text, r.citations, r.agent_state, r.outcome, r.error) == ("hello", ["c1"], "b", "ok", None)
    entries = spark.createDataFrame([(1, None, "local", None, None, True, False, False), (2, "s", "l", "E", None, False, False, False), (3, "s", None, None, None, False, False, True)], "entry_id long, stream_text string, local_text string, stream_error string, local_error string, aborted boolean, disconnected boolean, finished boolean")
    assert [(x.text, x.state) for x in conversations.entry_state(entries).orderBy("entry_id").collect()] == [("local", "cancelled"), ("s", "failed"), ("s", "completed")]
    ctx = conversations.normalize_user_context(spark.createDataFrame([(" ", " x ", "expert")], "framework string, runtime string, experienceLevel string")).first()
    assert tuple(ctx) == (None, "x", None)


def test_recent_context_skips_what_does_not_fit(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "x" * size) for k, size in enumerate([100, 1900, 2000, 2000, 1500, 500])]
    got = conversations.recent_context(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [m.turn for m in got.recent] == [2, 3, 4, 5]


def test_prompts_and_project_items(spark):
    q = spark.createDataFrame([(1, "why?", None)], "question_id long, text string, formatted string").withColumns({"preferences": F.struct(F.lit("x").alias("framework")), "recent": F.array(F.struct(F.lit("user").alias("role")))})
    assert '{"framework":"x"}' in evidence.prompt_rows(q).first().prompt
    items = evidence.project_items(spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "answer_id long, n_files int")).collect()
    assert [i.descriptor for i in items] == ["2 analyzed files", "1 analyzed file"]
    old = spark.createDataFrame([(1, "a")], "chunk_id long, content string")
    assert audits.changed_chunks(old, old.unionByName(spark.createDataFrame([(2, "b")], old.schema))).count() == 1


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streams_of_the_log(rocks, tmp_path):
    spark = rocks
    log = [("started", "a", 0), ("completed", "a", 10), ("started", "b", 0), ("started", "c", 1), ("failed", "c", 100), ("started", "z", 4000), ("started", "y", 9000)]
    rows = spark.createDataFrame(log, "event string, request_id string, s long").select("event", "request_id", F.timestamp_seconds(F.col("s") + 100).alias("ts"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("error_code"))
    for k, part in enumerate([rows.where("s < 3000"), rows.where("s BETWEEN 3000 AND 5000"), rows.where("s > 5000")]):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    read = lambda: chat_log.read_log_stream(spark, str(tmp_path / "log"), late="1 seconds", maxFilesPerTrigger="1")
    late = {(r.request_id, r.broke) for r in run(chat_log.timeout_stream(read()), "late", spark).collect()}
    want = {("b", "first_chunk"), ("c", "first_chunk")}
    assert late in (want, want | {("z", "first_chunk")})  # z's time is over once y has come
    late = {(r.request_id, r.broke) for r in run(chat_log.timeout_stream(read(), first_chunk_ms=None), "later", spark).collect()}
    want = {("b", "total"), ("c", "total")}
    assert late in (want, want | {("z", "total")})
    ended = {(r.request_id, r.ended, r.duration_ms) for r in run(chat_log.lifecycle_stream(read()), "ended", spark).where("ended IS NOT NULL").collect()}
    assert ended == {("a", "completed", 10_000), ("c", "failed", 99_000)}
    base = read().withColumn("duration_ms", F.lit(5))
    assert run(chat_log.outcome_rate_stream(base), "rates", spark).count() >= 1
    firsts = run(chat_log.first_requests(read().withColumn("client_request_id", F.col("request_id"))), "firsts", spark)
    assert firsts.count() == 5


def test_scratch_removes_what_was_stored(spark):
    import os

    from docweave import session

    rows = spark.range(3)
    with session.scratch(spark):
        one = session.stored(rows)
        inner = session.kept(spark, f"{session.shared_folder(spark)}/kept-table", lambda: session.stored(one))
        paths = [f.removeprefix("file:").removeprefix("//") for f in one.inputFiles()]
        assert all(map(os.path.exists, paths)) and inner.count() == 3
    assert not any(map(os.path.exists, paths)) and inner.count() == 3
    session.remove(spark, f"{session.shared_folder(spark)}/kept-table")


def test_texts_that_hold_a_question(spark):
    texts = spark.createDataFrame([(1, "say one two\tthree now"), (2, "one two"), (3, "x one twofold"), (4, "bar foo"), (5, ""), (6, None), (7, "xone two threefold")], "chunk_id long, text string")
    asked = [(1, "one two\tthree"), (2, "one two"), (3, "foo"), (4, "absent words here"), (5, ""), (6, None)]
    got = audits.holding(texts, spark.createDataFrame(asked, "question_id long, text string")).collect()
    want = {(q, c) for q, a in asked for c, t in [(r.chunk_id, r.text) for r in texts.collect()] if a and t and a in t}
    assert {(r.question_id, r.chunk_id) for r in got} == want and len(want) == 6


def test_walk_in_stretches(spark):
    """Short stretches give what one long walk gives, and what a plain loop gives."""
    import random

    pick = random.Random(2)
    bodies = [" ".join(f"w{b}x{k}" for k in range(30)) for b in range(9)] + ["short text", ""]
    rows, texts = [], {}
    for i in range(60):
        b = pick.randrange(len(bodies))
        texts[i] = bodies[b] + (f" extra{i}" if b < 9 and pick.random() < 0.5 else "")
    near = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) >= 0.95 if min(len(set(x.split())), len(set(y.split()))) >= 20 else False
    made = chunk(spark, [(i, i % 50, i % 3 if i % 2 else None, "go", f"t{i}", t) for i, t in texts.items()])
    fields = index.index_fields(made).cache()
    for q in range(3):
        for i in pick.sample(range(60), 45):
            rows.append((q, i, i % 50, i % 3 if i % 2 else None, f"p{i}", 0, [3, 20, 8][q], ["t"], round(pick.random(), 6)))
    kinds = "question_id long, chunk_id long, document_id long, section_id long, path string, chunk_order int, limit int, matched_terms array<string>, score double"
    scored = spark.createDataFrame(rows, kinds).join(fields.select("chunk_id", "body_hash", (F.col("body_text") == "").alias("body_empty")), "chunk_id").cache()
    want = set()
    for q in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[8], r[4])):
            apart = lambda k: k[2] == r[2] and k[3] is not None and r[3] is not None and k[3] != r[3]  # noqa: E731, B023
            same = lambda k: (texts[k[1]] == texts[r[1]] != "") or near(texts[k[1]], texts[r[1]])  # noqa: E731, B023
            if len(kept) < r[6] and not any(not apart(k) and same(k) for k in kept):
                kept.append(r)
        want |= {(q, n + 1, r[1]) for n, r in enumerate(kept)}
    for first in (4, 100):
        got = {(r.question_id, r.rank, r.chunk_id) for r in ranking.suppress_duplicates(scored, fields, first).collect()}
        assert got == want


def test_places_of_groups(spark):
    rows = [(k, f"2024-01-{10 - k % 4:02d} 10:{k % 7:02d}:{k % 5:02d}", k % 6 == 0) for k in range(80)]
    table = spark.createDataFrame(rows, "conv_id long, at string, pinned boolean").select("conv_id", F.to_timestamp("at").alias("updated_at"), "pinned")
    got = {(r.conv_id, r.group, r.place) for r in conversations.group_conversations(table, F.to_timestamp(F.lit("2024-01-10 23:00:00"))).collect()}
    day = {"2024-01-10": "Today", "2024-01-09": "Yesterday"}
    want = set()
    for name in ("Today", "Yesterday", "Older"):
        own = sorted((r for r in sorted(rows) if day.get(r[1][:10], "Older") == name), key=lambda r: r[1], reverse=True)
        want |= {(r[0], name, n + 1) for n, r in enumerate(sorted(own, key=lambda r: not r[2]))}
    assert got == want


def test_places_within_a_millisecond(spark):
    """Microseconds don't decide: ids do, as for equal times."""
    rows = [(3, "10:00:00.000900"), (1, "10:00:00.000100"), (2, "10:00:00.000999"), (0, "10:00:00.001000"), (4, "09:59:59.999999")]
    table = spark.createDataFrame(rows, "conv_id long, at string").select("conv_id", F.to_timestamp(F.concat(F.lit("2024-01-10 "), "at")).alias("updated_at"), F.lit(False).alias("pinned"))
    got = conversations.group_conversations(table, F.to_timestamp(F.lit("2024-01-10 23:00:00"))).orderBy("place").collect()
    assert [r.conv_id for r in got] == [0, 1, 2, 3, 4]


def test_exact_percentiles(spark):
    """More latencies than an approximation counts exactly, repeats and nulls among them."""
    k, day = F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000))
    rows = spark.range(120_000).select(day.alias("started_at"), F.when(k % 3 == 0, "answered").alias("outcome"), F.lit(None).cast("string").alias("error_code"), F.when(k % 3 != 2, (k * 7919) % 100_003 * F.when(k % 2 == 0, 1).otherwise(5)).alias("duration_ms"))
    rows = rows.unionByName(rows.where("duration_ms IS NULL").limit(5).withColumn("error_code", F.lit("E")))
    got = {(r.outcome, r.error_code): (r.n, r.mean_ms, r.max_ms, r.p95_ms) for r in logs.outcome_rates(rows).collect()}
    want, own = {}, {}
    for r in rows.collect():
        own.setdefault((r.outcome, r.error_code), []).append(r.duration_ms)
    for key, all_ in own.items():
        d = sorted(x for x in all_ if x is not None)
        want[key] = (len(all_), sum(d) / len(d), d[-1], d[-(-95 * len(d) // 100) - 1]) if d else (len(all_), None, None, None)
    assert got == want and len(want) == 3
