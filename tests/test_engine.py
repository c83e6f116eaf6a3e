"""Whole questions, model plug-ins, and documents from upload to index and out again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens import engine, lifecycle
from foliolens.functions import models
from foliolens.operators import catalog
from foliolens.operators.answers import NOTHING, UNANSWERED

CHUNKS = "chunk_id string, doc_id string, text string, from_page int, to_page int"
CATALOG = "id string, title string, rank int"


def library(spark):
    data = [("a_0", "a", "The pump is red. It hums.", 1, 2), ("a_1", "a", "The pump is <old>.", 3, 3), ("b_0", "b", "A valve is closed.", -1, -1), ("c_0", "c", None, None, None), ("g_0", "gone", "The pump burst.", 5, 5)]
    chunks = spark.createDataFrame(data, CHUNKS).withColumn("embedding", models.embedding(F.col("text")))
    return chunks, spark.createDataFrame([("a", "Pump & book", 1), ("b", None, 1), ("c", "Nothing", 1)], CATALOG)


def test_ask(spark):
    chunks, listed = library(spark)
    asked = spark.createDataFrame([(1, "the pump"), (2, "zebra"), (3, "  "), (4, "valve closed"), (5, None)], "query_id long, text string")
    for mode in ("hybrid", "knn", "keyword"):
        got = {r.query_id: r for r in engine.ask(asked, chunks, listed, k=4, mode=mode).collect()}
        assert got[1].answer.startswith("<p>The pump is ") and "<li>Pump &amp; book p. 1-3</li>" in got[1].answer and "- The pump is red. It hums.\n" in got[1].context and "gone" not in got[1].answer
        assert got[4].answer == "<p>A valve is closed.</p><p>Sources:</p><ul>\n<li>untitled</li>\n</ul>\n"
        assert all(got[i].answer == NOTHING and got[i].context is None and got[i].status == "COMPLETED" for i in (2, 3, 5))
    with pytest.raises(ValueError):
        engine.search(asked, chunks, mode="other")
    with pytest.raises(Exception):
        engine.search(asked, chunks.drop("text"), mode="keyword").collect()
    assert engine.search(asked, chunks.drop("text"), mode="keyword", on_error="empty").count() == 0
    assert engine.debug_lines(spark.createDataFrame([(1, 0.5, "x")], "query_id long, score double, text string")).first().line == "[0.5000] x"


def test_chat_plugs_states_and_unknown_documents(spark):
    chunks, listed = library(spark)
    asked = spark.createDataFrame([(1, "the pump"), (2, "zebra"), (4, "valve closed")], "query_id long, text string")

    def model():
        def reply(prompt, contexts):
            if "valve" in contexts[0]:
                raise RuntimeError("no line")
            return [" "]

        return reply

    found = engine.hits(asked, chunks, k=4)
    got = {r.query_id: r for r in engine.reply(asked, found, listed, model).collect()}
    assert got[1].answer == UNANSWERED and (got[4].status, got[4].answer) == ("FAILED", "no line") and got[2].answer == NOTHING
    log = [(r.job_id, r.seq, r.status, r.answer) for r in engine.job_log(engine.reply(asked, found, listed, model)).orderBy("job_id", "seq").collect()]
    assert [x[2] for x in log if x[0] == 4] == ["QUEUED", "RETRIEVING", "RERANKING", "ANSWERING", "FAILED"]
    assert [x for x in log if x[0] == 2] == [(2, i + 1, s, NOTHING if i == 3 else None) for i, s in enumerate(["QUEUED", "RETRIEVING", "RERANKING", "COMPLETED"])]
    assert not catalog.illegal_steps(spark.createDataFrame([(*x, 1) for x in log if x[0] == 1], "job_id long, seq long, status string, answer string, loaded_at int"), list(engine.STATES)).count()
    with pytest.raises(Exception, match="document not found: gone"):
        engine.reply(asked, found, listed, unknown="raise").collect()
    wrong = found.withColumn("to_page", F.when(F.col("doc_id") == "a", 0).otherwise(F.col("to_page")))
    with pytest.raises(Exception, match="begins after its end"):
        engine.reply(asked, wrong, listed).collect()


def test_library(spark, tmp_path):
    from foliolens.sources.tables import files

    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "one.txt").write_text("The pump is red.\f" + "It hums. " * 400)
    (raw / "two.TXT").write_text("A valve is closed.")
    (raw / "bad.txt").write_bytes(b"\xff\xfe")

    def parse(content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")

    lib = lifecycle.Library(spark, str(tmp_path / "lib"), buckets=4, parse=parse)
    assert lib.catalog().count() == 0 and lib.index().count() == 0
    lib.ingest(files(spark, str(raw)))
    first = {r.title: r for r in lib.catalog().collect()}
    assert {t: (r.status, r.mime, r.embed_model) for t, r in first.items()} == {"one.txt": ("INDEXED", "text/plain", "hashed-64"), "two.TXT": ("INDEXED", "text/plain", "hashed-64"), "bad.txt": ("FAILED", "text/plain", "")}
    rows = lib.index().collect()
    assert first["one.txt"].chunks == sum(r.doc_id == first["one.txt"].id for r in rows) > 1 and {r.from_page for r in rows} <= {1, 2} and all(len(r.embedding) == 64 for r in rows)
    lib.ingest(files(spark, str(raw)))  # again: the same rows
    assert sorted(r.chunk_id for r in lib.index().collect()) == sorted(r.chunk_id for r in rows)
    lib.reindex(spark.createDataFrame([(first["two.TXT"].id,)], "id string"))
    lib.delete(spark.createDataFrame([(first["one.txt"].id,)], "id string"))
    assert {r.title for r in lib.catalog().collect()} == {"two.TXT", "bad.txt"} and {r.doc_id for r in lib.index().collect()} == {first["two.TXT"].id}
    assert len(list((tmp_path / "lib" / "files").iterdir())) == 2
    with pytest.raises(ValueError, match="not found"):
        lib.delete(spark.createDataFrame([("zz",)], "id string"))
    got = engine.ask(spark.createDataFrame([(1, "valve")], "query_id long, text string"), lib.index(), lib.catalog(), mode="keyword").first()
    assert got.answer == "<p>A valve is closed.</p><p>Sources:</p><ul>\n<li>two.TXT p. 1</li>\n</ul>\n"


def test_submit_and_lookup(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=37 * (i * 7 % 20))) for i in range(20)] + [(99, None), (None, t)]
    q = spark.createDataFrame(rows, "query_id long, asked_at timestamp")
    want = [99, *sorted(range(20), key=lambda i: rows[i][1])]
    assert [r.query_id for r in catalog.submit(q, after=5).orderBy("job_id").collect()] == want and {r.job_id for r in catalog.submit(q, 5).collect()} == set(range(6, 27))
    assert catalog.lookup(q, "query_id", [3, 77]).count() == 1 == catalog.lookup(q, "query_id", q.filter("query_id = 3")).count()
    assert catalog.submit(q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        catalog.upsert(q, q.limit(0), "query_id", empty="raise")
    with pytest.raises(ValueError):
        catalog.upsert(q, q, "query_id", empty="raise")


def test_queue_progress(spark):
    queue = spark.createDataFrame([(1, 1, 4), (1, 2, 0), (1, 3, 2), (2, 1, None), (3, 1, 3)], "run int, place int, chunks int")
    got = lambda *d: {r.run: (r.total_percent, r.document_percent) for r in catalog.queue_progress(queue, spark.createDataFrame(list(d), "run int, done int")).collect()}
    assert got((1, 1)) == {1: (16, 25), 2: (0, 100), 3: (0, 0)}
    assert got((1, 5), (3, 3)) == {1: (83, 50), 2: (0, 100), 3: (100, 100)}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from foliolens.sources.pages import plain_text_pages
    from foliolens.streaming import jobs

    raw, sink = tmp_path / "raw", str(tmp_path / "sink")
    raw.mkdir()
    stream = lambda: spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(raw))
    for name in ("a", "b"):
        (raw / f"{name}.txt").write_text(f"{name}\fx")
        jobs.ingest(stream(), plain_text_pages, sink, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(sink)
    assert sorted((r.doc_id, r.page, r.text) for r in rows.collect()) == [("a.txt", 1, "a"), ("a.txt", 2, "x"), ("b.txt", 1, "b"), ("b.txt", 2, "x")]


def test_models():
    assert models.pool(np.array([[[2.0], [4.0], [9.0]]]), np.array([[1, 1, 0]])).tolist() == [[3.0]]
    assert models.unit(np.array([[3.0, 4.0], [0.0, 0.0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]
    assert models.logit(np.array([[5.0], [6.0]])).tolist() == [5.0, 6.0] and models.logit(np.array([[1.0, 2.0]])).tolist() == [2.0] and models.logit(np.array([7.0])).tolist() == [7.0]


def test_plugged_scorer_and_progress(spark):
    from foliolens.operators.retrieve import rerank

    rows = spark.createDataFrame([(1, 1, "q", "a b"), (1, 2, "q", "a b c")], "query_id long, doc_id long, query_text string, text string")
    by_length = models.scorer(lambda: lambda q, w: np.array([[float(len(x))] for x in w]))
    assert [(r.doc_id, r.score) for r in rerank(rows, scorer=by_length).orderBy("rank").collect()] == [(2, 3.0), (1, 2.0)]
    p = spark.createDataFrame([(0, 4), (1, 4), (4, 4), (0, 0)], "d int, t int")
    assert [r.p for r in p.select(models.document_progress(F.col("d"), F.col("t")).alias("p")).collect()] == [None, 25, None, None]


def test_model_inputs(spark):
    ids, mask = models.padded([[1, 5, 2], [1, 2], []], most=2)
    assert ids.tolist() == [[1, 5], [1, 2], [0, 0]] and mask.tolist() == [[1, 1], [1, 1], [0, 0]]
    fed = models.model_inputs(ids, mask, ["input_ids", "token_type_ids", "other"])
    assert list(fed) == ["input_ids", "token_type_ids"] and not fed["token_type_ids"].any()
    assert models.hashed_tokenizer()("Ab ab")[0] == 1 and len(set(models.hashed_tokenizer()("Ab ab"))) == 3
    make = models.token_embedder(models.hashed_tokenizer, lambda: lambda x: np.stack([x["input_ids"] % 7, x["input_ids"] % 5], -1), ["input_ids", "attention_mask"])
    rows = spark.createDataFrame([("one two",), (None,)], "t string").select(models.embedding(F.col("t"), make).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-6 and rows[1].v is None


def test_questions_go_to_chunks_in_full_depth(spark, monkeypatch):
    from foliolens.plans import core

    base, seen = "/root/testdata/sf0.001", {}
    search, rerank = engine.search, engine.retrieve.rerank
    monkeypatch.setattr(engine, "search", lambda q, c, k, *a: seen.update(k=k, ids=c.select("chunk_id")) or search(q, c, k, *a))
    monkeypatch.setattr(engine.retrieve, "rerank", lambda *a, **o: seen.update(keep=o["keep"]) or rerank(*a, **o))
    core.ask_questions(spark, base)
    assert (seen["k"], seen["keep"]) == (100, 50)
    assert seen["ids"].distinct().count() == seen["ids"].count() == spark.read.parquet(f"{base}/chunks.parquet").select("chunk_id").distinct().count()


@pytest.mark.parametrize("name", ["answer_sources", "ask_questions", "job_log"])
def test_every_question_is_asked(spark, name):
    import duckdb

    from foliolens.plans import core

    base, sql = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("questions", "chunks", "doc_catalog"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    got = core.QUERIES[name](spark, base)
    want = sql.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
    asked = {r[0] for r in sql.execute("SELECT query_id FROM questions WHERE length(trim(text)) > 0").fetchall()}
    seen = {r[0] for r in got.select(got.columns[0]).distinct().collect()}
    assert any(q % 20 for q in seen) and seen <= asked and (name == "answer_sources" or seen == asked)
