"""Filling containers of fixed capacity with texts."""

from __future__ import annotations

import base64
import heapq
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this public vocabulary's texts are cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str):
    """A function that counts a text's tokens: pieces are cut by the pattern, and each distinct piece is merged once."""
    import regex
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    pieces = regex.compile(PATTERN).findall
    memo: dict[str, int] = {}

    def count(text: str) -> int:
        n = 0
        for piece in pieces(text):
            k = memo.get(piece)
            if k is None:
                if len(memo) > 400_000:
                    memo.clear()
                k = memo[piece] = len(encode(piece))
            n += k
        return n

    return count


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of each text; null and empty texts have 0. Each key counts once, null keys have no rows."""

    docs.sparkSession.sparkContext.addFile(tokenizer)  # only the driver needs the path
    name = os.path.basename(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(SparkFiles.get(name))
        for b in batches:
            n = pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], [key, "tokens"])

    rows = docs.filter(F.col(key).isNotNull()).select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, tokens long").dropDuplicates([key])


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many containers, sizes in them) for a histogram of sizes from 1 to capacity.

    Sizes are placed longest first, each into the emptiest containers that it fits; containers of one pattern are
    handled as one with their number, so that the work depends on the number of sizes, not of items.
    """
    spaces: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    heap: list[int] = []

    def put(space: int, n: int, pattern: tuple[int, ...]) -> None:
        if not spaces[space]:
            heapq.heappush(heap, -space)
        spaces[space].append((n, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            if heap and -heap[0] >= size:
                space = -heap[0]
                n, pattern = spaces[space].pop()
                if not spaces[space]:
                    heapq.heappop(heap)
                used = min(n, left)
                if used < n:
                    put(space, n - used, pattern)
                put(space - size, used, (*pattern, size))
                left -= used
            else:
                fit = max(1, capacity // size)
                full, rest = divmod(left, fit)
                if full:
                    put(capacity - fit * size, full, (size,) * fit)
                if rest:
                    put(capacity - rest * size, 1, (size,) * rest)
                left = 0
    return [x for s in sorted(spaces) for x in spaces[s]]


def _plan(histogram: dict[int, int], capacity: int, gap: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, first container, position, start) of each slot of each pattern, and the number of containers."""
    sized = {n + gap: c for n, c in histogram.items() if n + gap > 0}
    slots, base, used = [], 0, defaultdict(int)
    for n, pattern in shortest_pack_first(sized, capacity + gap):
        start = 0
        for pos, size in enumerate(pattern):
            slots.append((size - gap, used[size], base, pos, start))
            used[size] += n
            start += size
        base += n
    return slots, base


def pack(docs: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, bucket_rows: int = 500_000) -> DataFrame:
    """(limit_id, container, position, key, part, start_token, tokens): where each text goes under each limit.

    Sizes are tokens of a public tokenizer. A text beyond the capacity is cut into full parts and a rest; no other is
    cut. Only the histogram of sizes (a row for each size up to the capacity) goes to the driver, where
    shortest-pack-first makes packing patterns; texts get their slots by their rank among those of the same size, which
    is counted in buckets, so that a size which a third of all texts have is spread over tasks. Neighbours in a
    container are parted by separator_tokens.

    Null and empty texts have 0 tokens: they take a slot each, or, without separators, join other containers in turn.
    Each key counts once, null keys have no rows. Limits with a null or a capacity below 1 are left out. Equal limits
    under different ids are packed apart. Other columns are ignored. An empty table gives no rows.
    """
    sizes = written(token_counts(docs, key, text, tokenizer))
    known = sorted({(r.limit_id, r.capacity_tokens, r.separator_tokens or 0) for r in limits.select("limit_id", "capacity_tokens", "separator_tokens").collect() if r.limit_id is not None and (r.capacity_tokens or 0) > 0})  # a few settings
    spark = docs.sparkSession
    caps = F.broadcast(spark.createDataFrame(known, "limit_id int, cap int, gap int"))
    full = F.floor(F.col("tokens") / F.col("cap")).cast("int")
    rest = F.col("tokens") - full * F.col("cap")
    parts = full + F.when((rest > 0) | (full == 0), 1).otherwise(0)
    items = sizes.crossJoin(caps).select("limit_id", key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), full.alias("full"), rest.alias("rest"), "cap")
    items = items.select("limit_id", key, "part", F.when(F.col("part") < F.col("full"), F.col("cap")).otherwise(F.col("rest")).cast("int").alias("tokens"))
    buckets = max(16, -(-sizes.count() // bucket_rows) * 16)
    items = items.withColumn("bucket", F.pmod(F.xxhash64(key, "part"), F.lit(buckets)).cast("int"))
    counts = items.groupBy("limit_id", "tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("limit_id", "tokens").orderBy("bucket")) - F.col("n")).drop("n")
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts.groupBy("limit_id", "tokens").agg(F.sum("n").alias("n")).collect():  # at most a row for each size of each limit
        histogram[r.limit_id][r.tokens] = r.n
    rows, totals = [], {}
    for i, cap, gap in known:
        slots, totals[i] = _plan(histogram[i], cap, gap)
        rows += [(i, *s) for s in slots]
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shift = 40
    lead = np.unique(table[:, :2], axis=0)
    code = {tuple(x): n for n, x in enumerate(lead.tolist())}
    starts = np.array([code[i, n] << shift for i, n in table[:, :2].tolist()], np.int64) + table[:, 2]
    boxes = {i: max(1, n) for i, n in totals.items()}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, n, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("limit_id", "tokens", "rank"))
            out = np.zeros((len(i), 3), np.int64)
            free = np.array([(x, y) not in code for x, y in zip(i.tolist(), n.tolist())], bool)
            if free.any():  # no tokens and no separators: any container has room
                out[free, 0] = rank[free] % np.array([boxes[x] for x in i[free].tolist()])
                out[free, 1] = -1
            at = np.flatnonzero(~free)
            if len(at):
                k = np.searchsorted(starts, np.array([code[x, y] << shift for x, y in zip(i[at].tolist(), n[at].tolist())], np.int64) + rank[at], "right") - 1
                out[at] = np.stack([table[k, 3] + rank[at] - table[k, 2], table[k, 4], table[k, 5]], 1)
            yield pa.RecordBatch.from_arrays([b.column("limit_id"), pa.array(out[:, 0]), pa.array(out[:, 1], pa.int32()), b.column(key), b.column("part"), pa.array(out[:, 2], pa.int32()), b.column("tokens")], ["limit_id", "container", "position", key, "part", "start_token", "tokens"])

    local = F.row_number().over(Window.partitionBy("limit_id", "tokens", "bucket").orderBy(key, "part")) - 1
    ranked = items.withColumn("local", local).join(before, ["limit_id", "tokens", "bucket"]).select("limit_id", key, "part", "tokens", (F.col("before") + F.col("local")).alias("rank"))
    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"limit_id int, container long, position int, `{key}` {kind}, part int, start_token int, tokens int")


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, containers, tokens, fill): how much of the containers' room the texts take."""
    sums = packed.groupBy("limit_id").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id").select("limit_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def broken_rules(packed: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(limit_id, texts, overfull, cut): texts placed, containers beyond their capacity, and texts cut without need; the last two should be 0."""
    caps = F.broadcast(limits.select("limit_id", "capacity_tokens"))
    texts = packed.groupBy("limit_id", key).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).join(caps, "limit_id")
    texts = texts.groupBy("limit_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("cut"))
    full = packed.groupBy("limit_id", "container").agg(F.max(F.col("start_token") + F.col("tokens")).alias("end")).join(caps, "limit_id")
    full = full.groupBy("limit_id").agg(F.count_if(F.col("end") > F.col("capacity_tokens")).alias("overfull"))
    return texts.join(full, "limit_id").select("limit_id", "texts", "overfull", "cut")
