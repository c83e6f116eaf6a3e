"""Keyed changes of tables, states of jobs and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str, empty: str = "allow") -> DataFrame:
    """All rows of `new`, and those rows of `existing` whose key it does not have. Null keys of existing stay.

    With empty='raise' a `new` without rows, or with a null or blank key, is refused.
    """
    if empty == "raise":
        bad = new.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).alias("bad")).first()
        if not bad.n or bad.bad:
            raise ValueError("nothing to insert" if not bad.n else f"null or blank {key}")
    return existing.join(new.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the given ones; unknown keys do nothing."""
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def lookup(rows: DataFrame, key: str, ids) -> DataFrame:
    """Rows of the given ids: a list, which is pushed to the scan, or a table with the key; unknown ids have none."""
    return rows.join(ids.select(key).distinct(), key, "left_semi") if isinstance(ids, DataFrame) else rows.filter(F.col(key).isin(list(ids)))


def submit(questions: DataFrame, after: int = 0, key: str = "query_id", at: str = "asked_at") -> DataFrame:
    """(key, job_id, status): job ids from `after` + 1 on in the order of time, then of key; null times come first. All are QUEUED.

    Numbered by hour, with the hours' counts added up, so that no task orders all rows. Null keys have no job.
    """
    rows = questions.filter(F.col(key).isNotNull()).select(key, at, F.date_trunc("hour", at).alias("hour"))
    hours = rows.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    before = hours.select("hour", (F.sum("n").over(Window.orderBy("hour")) - F.col("n")).alias("before"))  # a row an hour
    number = F.row_number().over(Window.partitionBy("hour").orderBy(F.col(at).asc_nulls_first(), key))
    ranked = rows.withColumn("i", number)
    return ranked.join(before, ranked["hour"].eqNullSafe(before["hour"])).select(key, (F.lit(after) + F.col("before") + F.col("i")).alias("job_id"), F.lit("QUEUED").alias("status"))


def latest_states(events: DataFrame) -> DataFrame:
    """(job_id, status, answer, steps): the status of a job's last step and its last answer. An event sent again counts once, the latest load wins."""
    one = events.filter("job_id is not null and seq is not null").groupBy("job_id", "seq").agg(F.max_by("status", "loaded_at").alias("status"), F.max_by("answer", "loaded_at").alias("answer"))
    return one.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("seq"))).alias("answer"), F.count(F.lit(1)).alias("steps"))


def illegal_steps(events: DataFrame, order: list[str]) -> DataFrame:
    """(job_id, seq, status, before): steps that do not follow the stated order; FAILED may follow any."""
    one = events.filter("job_id is not null and seq is not null").groupBy("job_id", "seq").agg(F.max_by("status", "loaded_at").alias("status"))
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    return one.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("status") != "FAILED") & (place(F.col("status")) != place(F.col("before")) + 1)).select("job_id", "seq", "status", "before")


def percent(done, total):
    """Whole percents between 0 and 100; 0 of 0 is 0."""
    return F.when(total > 0, F.least(F.greatest(F.floor(100 * done / total), F.lit(0)), F.lit(100))).otherwise(0).cast("int")


def progress(expected: DataFrame, done: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, total, done, percent) of each document's chunks. Documents without any finished chunk have 0."""
    n = done.groupBy(doc).agg(F.count(F.lit(1)).alias("done"))
    rows = expected.join(n, doc, "left").fillna(0, ["done"])
    return rows.select(doc, "total", "done", percent(F.col("done"), F.col("total")).alias("percent"))


def queue_progress(queue: DataFrame, steps: DataFrame, run: str = "run", place: str = "place") -> DataFrame:
    """(run, done, total, total_percent, document_percent): how far each run's queue of documents is.

    queue: run, place, chunks, documents in the order in which they wait; steps: run, done, finished chunks. Documents
    are worked off one after the other; the current one is the first that is not finished. None left gives 100 percent
    for it, and nothing to do 0 percent in all. Null chunks count as 0.
    """
    size = F.coalesce(F.col("chunks").cast("long"), F.lit(0).cast("long"))
    ends = queue.select(run, size.alias("n"), F.sum(size).over(Window.partitionBy(run).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    all_ = ends.join(steps.select(run, F.col("done").cast("long").alias("done")), run, "left").fillna(0, ["done"])
    now = F.min_by(F.struct((F.col("done") - F.col("end") + F.col("n")).alias("d"), "n"), F.when((F.col("end") > F.col("done")) & (F.col("n") > 0), F.col("end")))
    rows = all_.groupBy(run).agg(F.max("done").alias("done"), F.sum("n").alias("total"), now.alias("now"))
    return rows.select(run, "done", "total", percent(F.col("done"), F.col("total")).alias("total_percent"), F.coalesce(F.floor(100 * F.col("now.d") / F.col("now.n")), F.lit(100)).cast("int").alias("document_percent"))
