"""Closed integer intervals per key: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _segments(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from that of the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _merge(new: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and start: where a period begins, and the running end within the key."""
    rank = np.cumsum(new).astype(np.int64) << 33
    reach = np.maximum.accumulate(rank + hi) - rank
    start = new.copy()
    start[1:] |= lo[1:] > reach[:-1] + 1
    return start, reach


def _combine(keys: list[str]):
    """Lists of disjoint intervals out of any rows: sort a batch, merge neighbours, keep one row for each period."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.sort_by([(k, "ascending") for k in [*keys, "lo"]])
            lo, hi = (b.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            start, reach = _merge(_segments(b, keys), lo, hi)
            at = np.flatnonzero(start)
            ends = reach[np.append(at[1:], len(lo)) - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array(lo[at].astype(np.int32)), pa.array(ends.astype(np.int32))], [*keys, "lo", "hi"])

    return run


def _finish(keys: list[str]):
    """Periods and gaps of rows that come sorted by key and start; the last open period is carried to the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            out, kept = _emit(t.combine_chunks(), keys, last=False)
            yield from out
        if kept is not None:
            yield from _emit(kept, keys, last=True)[0]

    return run


def _emit(t: pa.Table, keys: list[str], last: bool):
    if not t.num_rows:
        return [], None
    b = t.combine_chunks().to_batches()[0]
    lo, hi = (b.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    new = _segments(b, keys)
    start, reach = _merge(new, lo, hi)
    at = np.flatnonzero(start)
    ends = reach[np.append(at[1:], len(lo)) - 1]
    same = ~new[at[1:]]  # the next period has the same key
    gap = np.flatnonzero(same)
    kept = None
    n = len(at) if last else len(at) - 1
    if not last:
        kept = pa.table({**{k: b.column(k).take(at[-1:]) for k in keys}, "lo": pa.array(lo[at[-1:]], pa.int32()), "hi": pa.array(ends[-1:], pa.int32())}).select([*keys, "lo", "hi"])
    periods = pa.RecordBatch.from_arrays([*(b.column(k).take(at[:n]) for k in keys), pa.array(np.repeat("period", n), pa.string()), pa.array(lo[at[:n]], pa.int32()), pa.array(ends[:n], pa.int32())], [*keys, "kind", "from_page", "to_page"])
    gaps = pa.RecordBatch.from_arrays([*(b.column(k).take(at[gap]) for k in keys), pa.array(np.repeat("gap", len(gap)), pa.string()), pa.array(ends[gap] + 1, pa.int32()), pa.array(lo[at[gap + 1]] - 1, pa.int32())], [*keys, "kind", "from_page", "to_page"])
    return [periods, gaps], kept


def _ranges(rows: DataFrame, keys: list[str], split_rows: int) -> DataFrame | None:
    """Keys with more than `split_rows` rows, where their starts begin, and the width of ranges that hold about so many; none: None."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("from_"), F.max("lo").alias("to_")).filter(F.col("n") > split_rows)
    width = F.ceil((F.col("to_").cast("long") - F.col("from_") + 1) / F.ceil(F.col("n") / split_rows)).cast("int")
    large = counts.select(*keys, "from_", F.greatest(width, F.lit(1)).alias("width"))
    return large if large.limit(1).count() else None


def _across(leaf: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """Periods and gaps of large keys, a task a range of starts.

    What earlier ranges reach is one number a range, a running maximum over the ranges of a key; rows are cut at it, so
    that the ranges' periods follow one another. Only the first and last period of a range can touch one of another
    range; these few are merged once more.
    """
    part = [*keys, "range_"]
    rows = leaf.join(F.broadcast(large), keys).select(*keys, F.floor((F.col("lo") - F.col("from_")) / F.col("width")).alias("range_"), "lo", "hi")
    reach = rows.groupBy(*part).agg(F.max("hi").alias("reach"))
    order = Window.partitionBy(*keys).orderBy("range_")
    reach = reach.select(*part, F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    cut = rows.join(F.broadcast(reach), part).filter(F.col("before").isNull() | (F.col("hi") > F.col("before"))).select(*part, F.greatest("lo", F.coalesce(F.col("before").cast("long") + 1, F.col("lo"))).cast("int").alias("lo"), "hi")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in part)
    done = cut.repartition(*part).sortWithinPartitions(*part, "lo").mapInArrow(_finish(part), f"{kinds}, kind string, from_page int, to_page int")
    w = Window.partitionBy(*part).orderBy("from_page")
    periods = done.filter("kind = 'period'").withColumn("first", F.lag("to_page").over(w).isNull()).withColumn("last", F.lead("from_page").over(w).isNull())
    edges = periods.filter("first or last")
    v = Window.partitionBy(*keys).orderBy("from_page")
    new = F.when(F.lag("to_page").over(v).cast("long") + 1 >= F.col("from_page"), 0).otherwise(1)
    joined = edges.withColumn("new_", new).withColumn("island", F.sum("new_").over(v)).groupBy(*keys, "island").agg(F.min("from_page").alias("from_page"), F.max("to_page").alias("to_page"))
    between = edges.withColumn("other", F.lag("range_").over(v)).withColumn("end", F.lag("to_page").over(v)).filter((F.col("other") != F.col("range_")) & (F.col("from_page") - 1 > F.col("end")))
    out = lambda df, kind, a, b: df.select(*keys, F.lit(kind).alias("kind"), F.expr(a).cast("int").alias("from_page"), F.expr(b).cast("int").alias("to_page"))
    parts = [out(periods.filter("not first and not last"), "period", "from_page", "to_page"), out(joined, "period", "from_page", "to_page"), out(done.filter("kind = 'gap'"), "gap", "from_page", "to_page"), out(between, "gap", "end + 1", "from_page - 1")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def periods_and_gaps(intervals: DataFrame, keys: list[str], lo: str = "from_page", hi: str = "to_page", split_rows: int = 1_000_000) -> DataFrame:
    """Rows (keys, kind, from_page, to_page) of the continuous periods and of the gaps between neighbouring ones.

    A mergeable aggregate over sorted lists of disjoint closed intervals, combined in a reduction tree. Leaf: each batch
    of each input partition is sorted and merged where it lies. Root: the lists meet by key, sorted by start, and are
    merged linearly in one streaming pass, which holds one open period and emits the list and its complement. Keys with
    more than `split_rows` rows, as counted, get a level between: their starts are cut into ranges of about so many rows,
    each merged in a task of its own, and what meets at the ranges' ends is merged once more. Memory is bounded by a
    batch at every level.

    Rows count if no key is null and 1 <= lo <= hi; others (null, unknown or reversed ends) are ignored. Overlapping,
    nested, equal, repeated and directly following intervals form one period. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    ok = (F.col(lo) >= 1) & (F.col(lo) <= F.col(hi))
    for k in keys:
        ok &= F.col(k).isNotNull()
    rows = intervals.filter(ok).select(*keys, F.col(lo).cast("int").alias("lo"), F.col(hi).cast("int").alias("hi"))
    schema = rows.schema
    leaf = rows.mapInArrow(_combine(keys), schema)
    large = _ranges(rows, keys, split_rows)
    small = leaf if large is None else leaf.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    root = small.repartition(*keys).sortWithinPartitions(*keys, "lo")
    kinds = [f for f in schema.fields if f.name in keys]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "kind string", "from_page int", "to_page int"])
    done = root.mapInArrow(_finish(keys), out)
    return done if large is None else done.unionByName(_across(leaf, large, keys))


def coalesced(intervals: DataFrame, keys: list[str], lo: str = "from_page", hi: str = "to_page") -> DataFrame:
    """Continuous periods (keys, from_page, to_page); as periods_and_gaps without the gaps."""
    return periods_and_gaps(intervals, keys, lo, hi).filter("kind = 'period'").drop("kind")


def checked(intervals: DataFrame, lo: str = "from_page", hi: str = "to_page") -> DataFrame:
    """The rows as they are; a row whose ends are reversed raises when it is read. Null and unknown ends (below 1) pass."""
    wrong = (F.col(lo) >= 1) & (F.col(lo) > F.col(hi))
    message = F.concat(F.lit("interval begins after its end: "), F.col(lo).cast("string"), F.lit(" > "), F.col(hi).cast("string"))
    return intervals.withColumn(lo, F.when(wrong, F.raise_error(message).cast("int")).otherwise(F.col(lo)))
