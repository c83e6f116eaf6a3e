"""Search by vectors, by keywords, and by both."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.text import words
from foliolens.sources.tables import written


#: Most rows of short columns that are broadcast; beyond, a join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Most queries, and most words of queries, that every task holds; beyond, queries are shuffled.
TASK_QUERIES, TASK_WORDS = 20_000, 500_000
#: From so many queries on a whole search takes groups of queries through all rows; most queries of a group, and most rows that it meets at once.
GROUPED_QUERIES, GROUP, GROUP_ROWS = 1_000, 2_048, 4_096


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table with a broadcast hint if it has few rows: as many as stated, else as counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _blocks(df: DataFrame, key: str, vector: str, rows: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of about `rows` vectors in the order of their keys, and the keys' type."""
    n = max(1, -(-df.select(key).count() // rows))
    block = F.pmod(F.xxhash64(key), F.lit(n)).alias(names[0])
    good = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    return good.select(block, key, vector).groupBy(names[0]).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")))).alias(names[1]))


class _Best:
    """The k best scores of each query so far in one task; what is worse than these is not in the result."""

    def __init__(self, queries: int, k: int):
        self.k, self.top, self.low = k, np.full((queries, k), -1.0), np.full(queries, -1.0)
        self.step = max(16, min(4096, 4_000_000 // max(1, queries)))  # rows that meet all queries at once

    def take(self, q: np.ndarray, d: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Numbers of the candidates (query, row, score) that stay; of equal scores the first rows."""
        order = np.lexsort((d, -score, q))
        q, s = q[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        good = (place < self.k) & (s >= self.low[q])
        asked, row = np.unique(q[good], return_inverse=True)
        if len(asked):
            fresh = np.full((len(asked), int(place[good].max()) + 1), -1.0)
            fresh[row, place[good]] = s[good]
            both = np.hstack([self.top[asked], fresh])
            self.top[asked] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
            self.low[asked] = self.top[asked].min(1)
        return order[good]


def _parts(b: pa.RecordBatch, key: str, step: int) -> Iterable[pa.RecordBatch]:
    """Runs of at most `step` rows of a batch in the order of their keys."""
    b = b.sort_by(key)
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def _knn_tasks(queries: pa.Table, k: int, key: str):
    """Batches of (key, v) to the rows that may be among each query's k nearest; queries: id, v."""
    ids = queries.column("id").combine_chunks()
    x = queries.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
    square = (x**2).sum(1)

    def run(batches: Iterable[pa.RecordBatch]):
        best = _Best(len(ids), k)
        for batch in batches:
            for b in _parts(batch, key, best.step):
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                dist = square[:, None] + (v**2).sum(1) - 2 * x @ v.T
                # a little more than what could round to the last score or better
                far = np.where(best.low > 0, 1 / np.maximum(best.low - 1e-6, 1e-9) - 1 + 1e-9, np.inf)
                if b.num_rows > k:
                    near = np.maximum(np.partition(dist, k - 1, 1)[:, k - 1], 0)
                    far = np.minimum(far, 1 / np.maximum(1 / (1 + near) - 2e-6, 1e-9) - 1)
                q, d = np.nonzero(dist <= far[:, None])
                score = np.round(1 / (1 + np.maximum(dist[q, d], 0)), 6)
                good = best.take(q, d, score)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[good])), b.column(key).take(pa.array(d[good])), pa.array(score[good])], ["query_id", key, "score"])

    return run


def knn(queries: DataFrame, data: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2000, query_key: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k rows nearest to each query, score = 1 / (1 + squared distance) at six decimals.

    Up to TASK_QUERIES queries go to every task, where they meet its rows in blocks of bounded size, one matrix product
    a block, and only rows leave that may be among the k nearest. More queries meet all rows in pairs of blocks of
    `block_rows`. Equal scores come by key. Null vectors are left out; all others must have one length.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    asked = queries.filter(F.col(vector).isNotNull() & F.col(query_key or key).isNotNull()).select(F.col(query_key or key).alias("id"), F.col(vector).alias("v"))
    own = asked.limit(TASK_QUERIES + 1).toArrow()
    if own.num_rows <= TASK_QUERIES:
        types = f"query_id {asked.schema['id'].dataType.simpleString()}, `{key}` {data.schema[key].dataType.simpleString()}, score double"
        rows = data.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
        found = rows.mapInArrow(_knn_tasks(own, k, key), types) if own.num_rows else data.sparkSession.createDataFrame([], types)
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)
    q = _blocks(queries, query_key or key, vector, block_rows, ("qb", "q"))
    d = _blocks(data, key, vector, block_rows, ("db", "d"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def unpack(column: pa.Array, i: int):
        rows = column.slice(i, 1).flatten()
        return rows.field("id"), rows.field("v").flatten().to_numpy().reshape(len(rows), -1)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                (qi, qv), (di, dv) = unpack(b.column("q"), i), unpack(b.column("d"), i)
                dist = (qv**2).sum(1)[:, None] + (dv**2).sum(1) - 2 * qv @ dv.T
                score = np.round(1 / (1 + np.maximum(dist, 0)), 6)
                order = np.argsort(-score, 1, kind="stable")[:, :k]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(np.repeat(np.arange(len(qi)), n))), di.take(pa.array(order.ravel())), pa.array(np.take_along_axis(score, order, 1).ravel())], ["query_id", key, "score"])

    found = q.crossJoin(d).mapInArrow(run, f"query_id {kind(queries, query_key or key)}, `{key}` {kind(data, key)}, score double")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf): how often each word stands in each document."""
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term, and its occurrences."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def quantized(dl):
    """The length as an index stores it in one byte: exact below 40, then with four significant bits above 24."""
    over = (dl - 24).cast("long")
    shift = F.length(F.bin(over)) - 4
    kept = F.floor(over / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)
    return F.when(dl < 40, dl.cast("double")).otherwise(24 + kept)


def _stored(dl: np.ndarray) -> np.ndarray:
    """The same as `quantized` in a task."""
    over = np.maximum(dl - 24, 8).astype(np.int64)
    unit = np.left_shift(1, np.floor(np.log2(over)).astype(np.int64) - 3)
    return np.where(dl < 40, dl, 24 + over // unit * unit)


def _found_words(w: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of the words of each row that are among the terms."""
    n = pc.list_value_length(w).to_numpy(zero_copy_only=False)
    t = pc.fill_null(pc.index_in(w.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    code = (np.repeat(np.arange(len(w)), n) * len(terms) + t)[t >= 0]
    code, tf = np.unique(code, return_counts=True)
    return code // len(terms), code % len(terms), tf


def _word_stats(terms: pa.Array):
    """Of batches of (key, w): documents by term number; number and summed length of all documents at -1."""

    def run(batches: Iterable[pa.RecordBatch]):
        df, n, size = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            w = b.column("w")
            df += np.bincount(_found_words(w, terms)[1], minlength=len(terms))
            n, size = n + b.num_rows, size + len(w.flatten())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n)), pa.array(np.append(np.zeros(len(at), np.int64), size))], ["t", "n", "size"])

    return run


def _bm25_tasks(ids: pa.Array, terms: pa.Array, q: np.ndarray, t: np.ndarray, weight: np.ndarray, avgdl: float, k: int, query: str, key: str, norms: str, k1: float, b: float):
    """Batches of (key, w) to the documents that may be among each query's k best; `weight` is that of term t for query q."""
    order = np.argsort(t, kind="stable")
    q, weight = q[order], weight[order]
    cuts = np.searchsorted(t[order], np.arange(len(terms) + 1))

    def run(batches: Iterable[pa.RecordBatch]):
        best = _Best(len(ids), k)
        for batch in batches:
            for part in _parts(batch, key, best.step):
                doc, term, tf = _found_words(part.column("w"), terms)
                dl = pc.list_value_length(part.column("w")).to_numpy(zero_copy_only=False).astype(np.float64)
                if norms == "quantized":
                    dl = _stored(dl)
                x = tf / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
                by = np.argsort(term, kind="stable")
                doc, x = doc[by], x[by]
                present, first = np.unique(term[by], return_index=True)
                ends = np.append(first[1:], len(doc))
                score = np.zeros((len(ids), part.num_rows))
                usual = (cuts[present + 1] - cuts[present]) * (ends - first) > 0.02 * score.size
                for m, a, e in zip(present[~usual], first[~usual], ends[~usual]):
                    score[np.ix_(q[cuts[m] : cuts[m + 1]], doc[a:e])] += weight[cuts[m] : cuts[m + 1], None] * x[a:e]
                if usual.any():  # words of many queries and documents as one matrix product
                    left, right = np.zeros((len(ids), int(usual.sum()))), np.zeros((int(usual.sum()), part.num_rows))
                    for i, (m, a, e) in enumerate(zip(present[usual], first[usual], ends[usual])):
                        left[q[cuts[m] : cuts[m + 1]], i] = weight[cuts[m] : cuts[m + 1]]
                        right[i, doc[a:e]] = x[a:e]
                    score += left @ right
                low = np.maximum(best.low - 1e-6, 1e-12)
                if part.num_rows > k:
                    low = np.maximum(low, np.partition(score, part.num_rows - k, 1)[:, part.num_rows - k] - 2e-6)
                qi, d = np.nonzero((score >= low[:, None]) & (score > 0))
                s = np.floor(score[qi, d] * 1e6 + 0.5) / 1e6
                good = best.take(qi, d, s)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(qi[good])), part.column(key).take(pa.array(d[good])), pa.array(s[good])], [query, key, "score"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", text: str = "text", norms: str = "exact", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank): the k documents that fit each query's words best, any word may match.

    A word's repetitions in the query count. Equal scores (at six decimals) come by key. Statistics are of the given
    documents, which need distinct keys. Up to TASK_QUERIES queries with TASK_WORDS words go to every task: documents are
    read once for counts and once for scores, and only those leave that may be among the k best. Of more queries, words
    that some query asks are shuffled, by document. Null texts count as documents without words, null keys have no rows.
    An empty table gives no rows.
    """
    terms = postings(queries, query, text).withColumnRenamed("tf", "qtf")
    own = terms.filter(F.col(query).isNotNull()).limit(TASK_WORDS + 1).toArrow()
    ids = pc.unique(own.column(query).combine_chunks())
    if 0 < len(ids) <= TASK_QUERIES and own.num_rows <= TASK_WORDS:
        words_ = pc.unique(own.column("term").combine_chunks())
        w = docs.select(key, words(F.col(text)).alias("w"))
        stats = {r.t: (r.n, r["size"]) for r in w.mapInArrow(_word_stats(words_), "t long, n long, size long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()}  # a row a term
        n, size = stats.get(-1, (0, 0))
        df = np.array([stats.get(i, (0, 0))[0] for i in range(len(words_))])
        t = pc.index_in(own.column("term").combine_chunks(), value_set=words_).to_numpy()
        weight = own.column("qtf").to_numpy() * np.log(1 + (n - df + 0.5) / (df + 0.5))[t]
        task = _bm25_tasks(ids, words_, pc.index_in(own.column(query).combine_chunks(), value_set=ids).to_numpy(), t, weight, size / max(1, n), k, query, key, norms, k1, b)
        found = w.filter(F.col(key).isNotNull()).mapInArrow(task, f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {docs.schema[key].dataType.simpleString()}, score double")
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
        return found.withColumn("score", F.round("score", 6)).withColumn("rank", rank).filter(F.col("rank") <= k)
    asked = terms.select("term").distinct()
    few = asked.count()
    w = docs.select(key, words(F.col(text)).alias("w"))
    # the words of a document that some query asks, and '' for the document itself; one shuffle by document serves all below
    rows = w.select(key, F.size("w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    rows = rows.join(sized(asked.union(asked.sparkSession.range(1).select(F.lit(""))), few), "term", "left_semi")
    posts = rows.repartition(key).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    whole = posts.agg(F.count_if(F.col("term") == "").alias("N"), F.avg(F.when(F.col("term") == "", F.col("dl"))).alias("avgdl"))  # one row
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    dl = quantized(F.col("dl")) if norms == "quantized" else F.col("dl")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * dl / F.col("avgdl")))
    weights = sized(terms.join(sized(df, few), "term"), terms.count())
    scores = posts.join(weights, "term").crossJoin(F.broadcast(whole)).groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """(query, key, score, rank): both legs' scores over the leg's best for the query, weighted and added; a row missing from a leg has 0 there."""
    best = F.max("score").over(Window.partitionBy(query))
    leg = lambda df, w: df.select(query, key, (F.lit(w) * F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0))).alias("score"))
    both = leg(vector, weights[0]).unionByName(leg(keyword, weights[1])).groupBy(query, key).agg(F.round(F.sum("score"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value for each run of values between two starts."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of `_binary`, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind)
    return data, np.diff(at) // np.dtype(kind).itemsize


def _pack_tasks(terms: pa.Array, key: str, kind: str):
    """Batches of (key, v, w) to rows of (key, v, dl, w): vectors and pairs of (term number, count) as bytes, lengths in words."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            row, term, tf = _found_words(b.column("w"), terms)
            w = _binary(np.column_stack([term, tf]).astype("<i4").ravel(), 2 * np.searchsorted(row, np.arange(b.num_rows + 1)))
            size = pc.fill_null(pc.list_value_length(b.column("v")), 0).to_numpy(zero_copy_only=False)
            v = _binary(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind), np.append(0, np.cumsum(size)))
            yield pa.RecordBatch.from_arrays([b.column(key), v, pc.list_value_length(b.column("w")), w], [key, "v", "dl", "w"])

    return run


def _packed_stats(terms: int):
    """Of batches of (dl, w) of `_pack_tasks` the same as `_word_stats`."""

    def run(batches: Iterable[pa.RecordBatch]):
        df, n, size = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            df += np.bincount(_values(b.column("w"), "<i4")[0][::2], minlength=terms)
            n, size = n + b.num_rows, size + int(b.column("dl").to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n)), pa.array(np.append(np.zeros(len(at), np.int64), size))], ["t", "n", "size"])

    return run


class _Top:
    """The k best (query, row, score) of a group of queries so far; rows come in order, and of equal scores the first stay."""

    def __init__(self, queries: int, k: int):
        self.k, self.low, self.most = k, np.full(queries, -1.0), 2 * k * queries
        self.parts, self.waiting = [(np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        good = score > self.low[q]
        self.parts.append((q[good].astype(np.uint16), row[good], score[good]))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best so far by query and falling score."""
        q, row, score = map(np.concatenate, zip(*self.parts))
        by = np.argsort(-score, kind="stable")
        by = by[np.argsort(q[by], kind="stable")]
        q, row, score = q[by], row[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.low[q[last]] = score[last]
        good = place < self.k
        self.parts, self.waiting = [(q[good], row[good], score[good])], 0
        return self.parts[0]


def _round6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _file_batches(uris: list[str], columns: list[str], rows: int):
    """Batches of Parquet files in their order, read by a task from the folder that all workers share."""
    for uri in uris:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=rows, columns=columns)


class _Near:
    """The nearest rows to a group of vectors."""

    def __init__(self, v: pa.Array, k: int):
        at = np.flatnonzero(v.is_valid())
        self.at, self.top = at, _Top(len(at), k)
        self.x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1) if len(at) else np.zeros((0, 1))
        self.square = (self.x**2).sum(1)
        self.left = np.hstack([-2 * self.x, np.ones((len(at), 1))])

    def meet(self, first: int, v: np.ndarray) -> None:
        """v: a row's values and its square, infinite for rows without a vector."""
        if not len(self.at):
            return
        far = np.where(self.top.low > 0, 1 / np.maximum(self.top.low - 1e-6, 1e-9) - 1 + 1e-9, np.inf)  # a little more than what could round to better
        part = self.left @ v.T
        at = np.flatnonzero(part < (far - self.square)[:, None])
        q, d = np.divmod(at, len(v))
        self.top.add(q, first + d, np.round(1 / (1 + np.maximum(part.ravel()[at] + self.square[q], 0)), 6))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, row, score = self.top.settle()
        return self.at[q], row, score


class _Worded:
    """The rows that fit the words of a group of queries best."""

    def __init__(self, w: pa.Array, terms: pa.Array, idf: np.ndarray, k: int):
        q, t, qtf = _found_words(w, terms)
        by = np.argsort(t, kind="stable")
        self.q, self.weight, self.queries = q[by], (qtf * idf[t])[by], len(w)
        self.cuts = np.searchsorted(t[by], np.arange(len(terms) + 1))
        self.top = _Top(len(w), k)

    def meet(self, first: int, rows: int, doc: np.ndarray, term: np.ndarray, x: np.ndarray) -> None:
        """x: the weight of a term in a row, by term and row."""
        cuts = self.cuts
        present, start = np.unique(term, return_index=True)
        ends = np.append(start[1:], len(doc))
        asked = cuts[present + 1] > cuts[present]
        present, start, ends = present[asked], start[asked], ends[asked]
        score = np.zeros((self.queries, rows))
        usual = (cuts[present + 1] - cuts[present]) * (ends - start) > 0.004 * score.size
        if usual.any():  # words of many queries and rows as one matrix product
            left, right = np.zeros((self.queries, int(usual.sum()))), np.zeros((int(usual.sum()), rows))
            for i, (m, a, e) in enumerate(zip(present[usual], start[usual], ends[usual])):
                left[self.q[cuts[m] : cuts[m + 1]], i] = self.weight[cuts[m] : cuts[m + 1]]
                right[i, doc[a:e]] = x[a:e]
            np.matmul(left, right, out=score)
        for m, a, e in zip(present[~usual].tolist(), start[~usual].tolist(), ends[~usual].tolist()):
            score[self.q[cuts[m] : cuts[m + 1], None], doc[a:e]] += self.weight[cuts[m] : cuts[m + 1], None] * x[a:e]
        at = np.flatnonzero(score >= np.maximum(self.top.low - 1e-6, 1e-12)[:, None])
        q, d = np.divmod(at, rows)
        self.top.add(q, first + d, _round6(score.ravel()[at]))


def _fused(legs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) as of `fuse`, of all rows; the legs come by query and falling score."""
    q, row, score = map(np.concatenate, zip(*[(q, row, w * np.divide(s, top, out=np.zeros(len(s)), where=top > 0)) for (q, row, s), w in zip(legs, weights) for top in [s[np.searchsorted(q, q)]]]))
    by = np.lexsort((row, q))
    q, row, score = q[by], row[by], score[by]
    first = np.flatnonzero(np.append(np.ones(min(1, len(q)), bool), (q[1:] != q[:-1]) | (row[1:] != row[:-1])))
    return q[first], row[first], _round6(np.add.reduceat(score, first) if len(first) else score)


def _group_tasks(uris: list[str], kind: str, terms: pa.Array, idf: np.ndarray, avgdl: float, k: int, deep: int, mode: str, query: str, key: str, norms: str, weights: tuple[float, float], k1: float, b: float):
    """Batches of queries (id, v, w) to their k best rows of the packed files; each group of queries meets all rows."""

    def group(asked: pa.RecordBatch):
        near = _Near(asked.column("v"), deep) if mode != "keyword" else None
        worded = _Worded(asked.column("w"), terms, idf, deep) if mode != "knn" else None
        first, step = 0, 2 * deep
        for batch in _file_batches(uris, ["v", "dl", "w"], GROUP_ROWS):
            at = 0
            while at < batch.num_rows:  # few rows at first, until it is known what is good
                part = batch.slice(at, step)
                n = part.num_rows
                if near is not None:
                    v, size = _values(part.column("v"), kind)
                    dim = near.x.shape[1]
                    rows = np.zeros((n, dim + 1))
                    rows[size > 0, :dim] = v.reshape(-1, dim) if len(near.at) else 0
                    rows[:, dim] = np.where(size > 0, (rows[:, :dim] ** 2).sum(1), np.inf)
                    near.meet(first, rows)
                if worded is not None:
                    w, size = _values(part.column("w"), "<i4")
                    doc, term, tf = np.repeat(np.arange(n), size // 2), w[::2], w[1::2]
                    by = np.argsort(term, kind="stable")
                    doc, term, tf = doc[by], term[by], tf[by]
                    dl = part.column("dl").to_numpy().astype(np.float64)
                    if norms == "quantized":
                        dl = _stored(dl)
                    worded.meet(first, n, doc, term, tf / (tf + k1 * (1 - b + b * dl[doc] / avgdl)))
                if first < 4 * GROUP_ROWS:
                    for leg in (near, worded):
                        if leg is not None:
                            leg.top.settle()
                first, at = first + n, at + n
                step = min(GROUP_ROWS, 2 * step)
        legs = ([near.best()] if near is not None else []) + ([worded.top.settle()] if worded is not None else [])
        q, row, score = _fused(legs, weights) if mode == "hybrid" else legs[0]
        q = q.astype(np.int64)
        by = np.lexsort((row, -score, q))
        q, row, score = q[by], row[by], score[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        good = rank <= k
        q, row, score, rank = q[good], row[good], score[good], rank[good]
        by = np.argsort(row, kind="stable")
        q, row, score, rank = q[by], row[by], score[by], rank[by]
        first = 0
        for batch in _file_batches(uris, [key], 16 * GROUP_ROWS):  # the keys of the rows found
            a, e = np.searchsorted(row, [first, first + batch.num_rows])
            if e > a:
                yield pa.RecordBatch.from_arrays([asked.column("id").take(pa.array(q[a:e])), batch.column(key).take(pa.array(row[a:e] - first)), pa.array(score[a:e]), pa.array(rank[a:e].astype(np.int32))], [query, key, "score", "rank"])
            first += batch.num_rows

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                yield from group(batch.slice(i, GROUP))

    return run


def grouped(queries: DataFrame, docs: DataFrame, k: int, deep: int, mode: str = "hybrid", query: str = "query_id", key: str = "doc_id", vector: str = "embedding", text: str = "text", norms: str = "exact", weights: tuple[float, float] = (0.6, 0.4), k1: float = 1.2, b: float = 0.75) -> DataFrame | None:
    """(query, key, score, rank) of many queries (query, text, vector): the same as `knn`, `bm25` or the `fuse` of both at depth `deep`.

    Rows are packed, sorted by key and written once; a task takes a group of queries through all of them, reads the files
    itself, and only the k best of each query leave it. None if the queries have more than TASK_WORDS different words.
    """
    terms = queries.select(F.explode(words(F.col(text))).alias("term")).distinct().limit(TASK_WORDS + 1).toArrow().column("term").combine_chunks() if mode != "knn" else pa.array([], pa.string())
    if len(terms) > TASK_WORDS:
        return None
    none = F.lit(None).cast("array<float>")
    v = none if mode == "keyword" else F.col(vector)
    kind = "<f4" if mode == "keyword" or docs.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    name = lambda df, c: df.schema[c].dataType.simpleString()
    own = lambda c: words(F.col(c)) if mode != "knn" else F.array().cast("array<string>")
    packed = written(docs.select(key, v.alias("v"), own(text).alias("w")).mapInArrow(_pack_tasks(terms, key, kind), f"`{key}` {name(docs, key)}, v binary, dl int, w binary"))
    stats = {r.t: (r.n, r["size"]) for r in packed.select("dl", "w").mapInArrow(_packed_stats(len(terms)), "t long, n long, size long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()}  # a row a term
    n, size = stats.get(-1, (0, 0))
    df = np.array([stats.get(i, (0, 0))[0] for i in range(len(terms))])
    rows = written(packed.filter(F.col(key).isNotNull()).orderBy(key))
    uris = sorted(rows.inputFiles(), key=lambda x: x.rsplit("/", 1)[-1])
    task = _group_tasks(uris, kind, terms, np.log(1 + (n - df + 0.5) / (df + 0.5)), size / max(1, n) or 1.0, k, deep, mode, query, key, norms, weights, k1, b)
    asked = queries.count()
    groups = max(1, -(-asked // GROUP), min(-(-asked // 256), 2 * queries.sparkSession.sparkContext.defaultParallelism))
    q = queries.filter(F.col(query).isNotNull()).repartition(groups).select(F.col(query).alias("id"), v.alias("v"), own(text).alias("w"))
    return q.mapInArrow(task, f"`{query}` {name(queries, query)}, `{key}` {name(docs, key)}, score double, rank int")


def overlap_score(query_words, window):
    """Stand-in for a model: 2 x share of the query's distinct words that the window has, less 1."""
    asked = F.array_distinct(query_words)
    return 2 * F.coalesce(F.try_divide(F.size(F.array_intersect(asked, window)).cast("double"), F.size(asked)), F.lit(0.0)) - 1


def rerank(candidates: DataFrame, query: str = "query_id", key: str = "doc_id", query_text: str = "query_text", text: str = "text", limit: int = 512, size: int = 480, overlap: int = 50, keep: int = 50, threshold: float = 0.0, scorer=overlap_score) -> DataFrame:
    """(query, key, score, rank): candidates scored in windows of words, the best window counts; below the threshold or NaN they go, `keep` stay.

    The query's words followed by the passage's are one window up to `limit` words, else windows of `size` that share
    `overlap`; the scorer takes the columns of the query's words and of a window's passage words. A model's pandas
    function fits there. Texts that are arrays already are taken as words.
    """
    from foliolens.operators.pages import pair_windows

    split = lambda c: F.col(c) if candidates.schema[c].dataType.typeName() == "array" else words(F.col(c))
    rows = candidates.select(query, key, split(query_text).alias("q"), split(text).alias("w"))
    long = F.size("q") + F.size("w") > limit
    start = F.explode(pair_windows(F.size("q"), F.size("w"), limit, size, size - overlap)).alias("start")
    rows = rows.select(query, key, "q", "w", F.when(long, size).otherwise(limit).alias("wide"), start)
    first = F.greatest(F.col("start") - F.size("q"), F.lit(0))
    rows = rows.select(query, key, "q", F.slice("w", first + 1, F.greatest(F.col("start") + F.col("wide") - F.size("q") - first, F.lit(0))).alias("part"))
    best = rows.groupBy(query, key).agg(F.max(F.round(scorer(F.col("q"), F.col("part")), 6)).alias("score"))
    good = best.filter((F.col("score") >= threshold) & ~F.isnan("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return good.withColumn("rank", rank).filter(F.col("rank") <= keep)
