"""Questions to answers over a chunk table, in one plan for all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions.models import chat, embedding, extract_chat, hashed_embedder
from foliolens.functions.text import words
from foliolens.operators import answers, retrieve
from foliolens.sources.tables import written

PROMPT = (
    "Answer only from the context below. Name every cause and condition that it gives. Say so if it holds no answer. "
    "Begin with one summarising sentence, then list the points as HTML bullets, in at most a hundred lines."
)
#: What a question goes through.
STATES = ("QUEUED", "RETRIEVING", "RERANKING", "ANSWERING", "COMPLETED")


def search(questions: DataFrame, chunks: DataFrame, k: int = 100, mode: str = "hybrid", make=hashed_embedder, norms: str = "exact", key: str = "chunk_id", on_error: str = "raise") -> DataFrame:
    """(query_id, key, score, rank) of the k best chunks; chunks: key, text, embedding; mode: hybrid, knn or keyword.

    Each leg of a hybrid search fetches 2k. Blank questions have no rows. Errors raise; with on_error='empty' those that
    show before the search runs (a missing column, an unreadable table) give no rows. Many questions go in groups, see
    `retrieve.grouped`.
    """
    if mode not in ("hybrid", "knn", "keyword"):
        raise ValueError(f"unknown mode {mode}")
    try:
        asked = questions.filter(F.length(F.trim("text")) > 0)
        deep = 2 * k if mode == "hybrid" else k
        near = worded = None
        if len(asked.select("query_id").limit(retrieve.GROUPED_QUERIES).collect()) == retrieve.GROUPED_QUERIES:
            many = asked.select("query_id", "text", embedding(F.col("text"), make).alias("embedding"))
            found = retrieve.grouped(many, chunks, k, deep, mode, key=key, norms=norms)
            if found is not None:
                return found
        if mode != "keyword":
            q = asked.select("query_id", embedding(F.col("text"), make).alias("embedding"))
            near = retrieve.knn(q, chunks.select(key, "embedding"), deep, key=key, query_key="query_id")
        if mode != "knn":
            worded = retrieve.bm25(asked, chunks, deep, key=key, norms=norms)
        return retrieve.fuse(near, worded, k, key=key) if mode == "hybrid" else near if worded is None else worded
    except Exception:
        if on_error != "empty":
            raise
        return questions.sparkSession.createDataFrame([], f"query_id long, `{key}` string, score double, rank int")


def hydrate(found: DataFrame, chunks: DataFrame, rows: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Hits with their chunks' columns. `rows` is the most hits that there can be: few are broadcast, so that chunks stay where they are."""
    return chunks.join(retrieve.sized(found, rows), key)


def hits(questions: DataFrame, chunks: DataFrame, k: int = 100, keep: int = 50, mode: str = "hybrid", make=hashed_embedder, scorer=retrieve.overlap_score) -> DataFrame:
    """(query_id, chunk_id, doc_id, from_page, to_page, text, query_text, score, rank): passages that survive search and reranking.

    What search and reranking found is written once (see `written`), without texts; a computed `chunks` should be too.
    """
    asked = questions.filter(F.length(F.trim("text")) > 0).select("query_id", F.col("text").alias("query_text"))
    n = asked.count()
    found = search(questions, chunks, k, mode, make).select("query_id", "chunk_id")
    spread = chunks.repartition("chunk_id") if k * n > retrieve.BROADCAST_ROWS else chunks  # texts are cut into words behind the shuffle
    rows = hydrate(found, spread.select("chunk_id", words("text").alias("text")), k * n).join(retrieve.sized(asked.withColumn("query_text", words("query_text")), n), "query_id")
    best = written(retrieve.rerank(rows, key="chunk_id", keep=keep, scorer=scorer))
    told = hydrate(best, chunks.select("chunk_id", "doc_id", "from_page", "to_page", "text"), keep * n).join(retrieve.sized(asked, n), "query_id")
    return told.select("query_id", "chunk_id", "doc_id", "from_page", "to_page", "text", "query_text", "score", "rank")


def reply(questions: DataFrame, found: DataFrame, catalog: DataFrame, model=extract_chat, prompt: str = PROMPT, unknown: str = "skip") -> DataFrame:
    """(query_id, status, context, answer) from the passages of `hits`: context, the chat model's reply, and cited sources.

    Without passages a question is COMPLETED with a fixed notice and a null context, and the model is not asked. If the
    model fails, the question is FAILED with its message as the answer.
    """
    said = answers.context(found).withColumn("c", chat(F.col("context"), prompt, model))
    rows = answers.html_answer(questions, said.select("query_id", "context", "c.body", "c.error"), answers.cited(found, catalog, unknown=unknown))
    failed = F.col("error").isNotNull()
    return rows.select("query_id", F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), "context", F.when(failed, F.col("error")).otherwise(F.col("answer")).alias("answer"))


def ask(questions: DataFrame, chunks: DataFrame, catalog: DataFrame, k: int = 100, keep: int = 50, mode: str = "hybrid", make=hashed_embedder, scorer=retrieve.overlap_score, model=extract_chat) -> DataFrame:
    """(query_id, status, context, answer) of every question.

    chunks: chunk_id, doc_id, text, from_page, to_page, embedding; catalog: id, title. Documents that the catalog does
    not have are not cited. See `hits` and `reply`.
    """
    return reply(questions, hits(questions, chunks, k, keep, mode, make, scorer), catalog, model)


def job_log(replies: DataFrame) -> DataFrame:
    """(job_id, seq, status, answer): the states that each question of `ask` went through; only the last has an answer."""
    steps = F.when(F.col("context").isNull(), F.array(*map(F.lit, STATES[:3]))).otherwise(F.array(*map(F.lit, STATES[:4])))
    rows = replies.select("query_id", "answer", F.concat(steps, F.array("status")).alias("s"))
    rows = rows.select("query_id", "answer", F.size("s").alias("n"), F.posexplode("s").alias("seq", "status"))
    return rows.select(F.col("query_id").alias("job_id"), (F.col("seq") + 1).cast("long").alias("seq"), "status", F.when(F.col("seq") + 1 == F.col("n"), F.col("answer")).alias("answer"))


def debug_lines(hits: DataFrame) -> DataFrame:
    """(query_id, line): '[score] text' of hits, for eyes only."""
    return hits.select("query_id", F.format_string("[%.4f] %s", F.col("score").cast("double"), F.coalesce("text", F.lit(""))).alias("line"))
