"""Requests answered as a stream and in batch, and what answers say about their citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import answering, evidence, index
from tests.test_operators import chunk

KIND = "request_id long, message string, recent array<struct<role:string,content:string>>, framework string, runtime string, service string, preferred_language string, filter_framework string"


def tables(spark):
    body = lambda k: f"deploy the application number{k} with the console and wait for the build " + " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, k, None, "nodejs" if k % 2 else "django", f"Guide {k}", body(k % 9)) for k in range(12)]
    chunks = chunk(spark, rows)
    shown = chunks.select("chunk_id", "title", "heading", F.lit("https://docs.example.org/").alias("published_url"), "path", "category", "content", F.lit(None).cast("string").alias("anchor"))
    asked = [(1, "hello", None), (2, "it failed", None), (3, "number3 number4", None), (4, "what is number4 w4x1 w4x2", "Django"), (5, "qqq zzz", None), (6, "number5 w5x1 w5x2 w5x3", "django"), (7, "w0x1 w0x2 w0x3", None)]
    requests = spark.createDataFrame([(i, m, [], None, None, None, None, f) for i, m, f in asked], KIND)
    return index.index_fields(chunks), shown, requests


def test_stream_equals_batch(spark, tmp_path):
    fields, shown, requests = tables(spark)
    path = str(tmp_path)
    opened = lambda: index.open_index(spark, path, "r1", lambda: fields, 4)
    whole = answering.answer_requests(requests, opened(), shown)
    for part in ("request_id < 4", "request_id BETWEEN 4 AND 5", "request_id > 5"):
        requests.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    read = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    job = answering.answer_stream(read, opened, lambda: shown, f"{path}/out")
    job.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    for name, want in whole.items():
        got = spark.read.schema(want.schema).parquet(f"{path}/out/{name}").select(want.columns)
        assert spark.read.parquet(f"{path}/out/{name}").select("batch").distinct().count() == 3
        assert got.exceptAll(want).count() == 0 and got.count() == want.count(), name
    routes = {r.request_id: (r.route, r.outcome) for r in whole["routes"].collect()}
    assert routes == {1: ("direct", None), 2: ("clarification", None), 3: ("retrieve", "matches"), 4: ("retrieve", "matches"), 5: ("retrieve", "no_matches"), 6: ("retrieve", "no_matches"), 7: ("retrieve", "matches")}
    matches = {}
    for r in whole["matches"].orderBy("request_id", "rank").collect():
        matches.setdefault(r.request_id, []).append(r.chunk_id)
    assert matches[7] == [0] and set(matches) == {3, 4, 7}  # 9 is a copy of 0
    contexts = {r.request_id: r.formatted for r in whole["contexts"].collect()}
    assert set(contexts) == {3, 4, 5, 6, 7} and contexts[5] == "[]" and '"citation":1' in contexts[7]
    cited = whole["citations"].where("request_id = 7").first()
    assert (cited.citation_id, cited.display_index, cited.title) == ("citation_0", 1, "Guide 0")
    again = evidence.pack_context(whole["matches"].where("request_id = 3").withColumnRenamed("request_id", "question_id").join(shown, "chunk_id"))[1]
    assert again.first().formatted == contexts[3]


def test_answers_and_their_citations(spark, tmp_path):
    fields, shown, requests = tables(spark)
    built = index.open_index(spark, str(tmp_path), "r1", lambda: fields, 4)
    cited = answering.answer_requests(requests, built, shown)["citations"].cache()
    assert {r.request_id: r.n for r in cited.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {3: 2, 4: 1, 7: 1}
    answers = spark.createDataFrame([(3, "So [2] and [1] and [2] [77]"), (7, "none"), (5, "[1]")], "request_id long, answer string")
    referenced, status = answering.cite_answers(answers, cited)
    index_of = {r.citation_id: r.display_index for r in cited.where("request_id = 3").collect()}
    assert [index_of[r.citation_id] for r in referenced.orderBy("place").collect()] == [2, 1]
    assert {(r.request_id, r.status) for r in status.collect()} == {(3, "partial"), (7, "none"), (5, "none")}
