"""The most similar vectors of every vector: an index of cells with anisotropic four-bit codes, and exact reranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

CODES = 16  # four bits


class Index:
    """Centres of cells and codebooks, fitted on a bounded sample of unit vectors.

    The codebooks minimise the score-aware loss: the residual's part parallel to the vector weighs `eta` times the part
    across, as it is what changes large inner products. eta = (d - 1) t^2 / (1 - t^2) for scores above t.
    """

    def __init__(self, sample: np.ndarray, cells: int, width: int = 2, t: float = 0.8, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.width, self.parts = width, d // width
        self.eta = (d - 1) * t * t / (1 - t * t)
        x = sample.astype(np.float32)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            c = np.zeros_like(c)
            np.add.at(c, near, x)
            size = np.linalg.norm(c, axis=1)
            c[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
            c /= np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
        self.centres = c
        y = x[:8_000]
        book = np.stack([y[rng.choice(len(y), CODES, replace=len(y) < CODES), m * width : (m + 1) * width] for m in range(self.parts)])
        self.book = book
        for _ in range(4):  # plain rounds, then score-aware ones
            codes = self._nearest(y)
            for m in range(self.parts):
                for k in range(CODES):
                    own = y[codes[:, m] == k, m * width : (m + 1) * width]
                    if len(own):
                        self.book[m, k] = own.mean(0)
        for _ in range(3):
            self._solve(y, self.encode(y))

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.parts), np.uint8)
        for m in range(self.parts):
            part = x[:, m * self.width : (m + 1) * self.width]
            out[:, m] = ((self.book[m] ** 2).sum(1) - 2 * part @ self.book[m].T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.book[m][codes[:, m]] for m in range(self.parts)], 1)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of unit vectors by coordinate descent on the score-aware loss."""
        codes = self._nearest(x)
        along = ((x - self.decode(codes)) * x).sum(1)  # residual along the vector
        for _ in range(rounds):
            for m in range(self.parts):
                part = x[:, m * self.width : (m + 1) * self.width]
                prod = part @ self.book[m].T
                err = (part**2).sum(1)[:, None] - 2 * prod + (self.book[m] ** 2).sum(1)
                old = np.take_along_axis(prod, codes[:, m : m + 1].astype(np.int64), 1)
                side = along[:, None] + old - prod
                codes[:, m] = (err + (self.eta - 1) * side**2).argmin(1)
                along = np.take_along_axis(side, codes[:, m : m + 1].astype(np.int64), 1)[:, 0]
        return codes

    def _solve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codebooks that minimise the loss for given codes: one linear system."""
        w, n = self.width, len(x)
        size = self.parts * CODES * w
        at = (np.arange(self.parts)[:, None] * CODES * w + np.arange(w)) + codes[:, :, None].astype(np.int64) * w
        z = np.zeros((n, size), np.float32)
        np.put_along_axis(z, at.reshape(n, -1), x, 1)
        weight = np.zeros(size)
        right = np.zeros(size)
        np.add.at(weight, at.reshape(-1), 1.0)
        np.add.at(right, at.reshape(-1), x.reshape(-1).astype(np.float64))
        a = (self.eta - 1) * (z.T @ z).astype(np.float64) + np.diag(weight + 1e-3)
        b = right + (self.eta - 1) * z.T @ (x**2).sum(1) + 1e-3 * self.book.reshape(-1)
        self.book = np.linalg.solve(a, b).astype(np.float32).reshape(self.parts, CODES, w)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords."""
        return np.stack([queries[:, m * self.width : (m + 1) * self.width] @ self.book[m].T for m in range(self.parts)], 1)

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate scores of queries with coded vectors by table look-ups alone."""
        t = self.tables(queries)
        out = np.take(t[:, 0], codes[:, 0], 1)
        for m in range(1, self.parts):
            out += np.take(t[:, m], codes[:, m], 1)
        return out


def _pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, ::2] << 4 | codes[:, 1::2]


def _unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows)])


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _closest(x: np.ndarray, centres: np.ndarray, group: np.ndarray, probes: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The `probes` groups of cells with the nearest centres of each vector, nearest first, and these centres' scores."""
    several = np.bincount(group) > 1
    near, best = np.empty((len(x), probes), np.int64), np.empty((len(x), probes), np.float32)
    for a in range(0, len(x), rows):
        score = x[a : a + rows] @ centres.T
        at = np.arange(len(score))
        for j in range(probes):
            c = score.argmax(1)
            g = group[c]
            near[a : a + rows, j], best[a : a + rows, j] = g, score[at, c]
            if j < probes - 1:
                score[at, c] = -9
                for k in np.unique(g[several[g]]):
                    score[np.ix_(g == k, group == k)] = -9
    return near, best


def _sizes(index: Index, dim: int):
    """Size and sum of the vectors of each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(len(index.centres), np.int64), np.zeros((len(index.centres), dim))
        for b in batches:
            if b.num_rows:
                _, first = np.unique(b.column("h").to_numpy(), return_index=True)
                x = _unit(_matrix(b.column("v"), dim)[first])
                near = _closest(x.astype(np.float32), index.centres, np.arange(len(size)), 1)[0][:, 0]
                order = np.argsort(near, kind="stable")
                cell, start = np.unique(near[order], return_index=True)
                size += np.bincount(near, minlength=len(size))
                total[cell] += np.add.reduceat(x[order], start, axis=0)
        cell = np.flatnonzero(size)
        ends = (np.arange(len(cell) + 1) * dim).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(size[cell]), pa.ListArray.from_arrays(pa.array(ends), pa.array(total[cell].astype(np.float32).reshape(-1)))], ["cell", "n", "v"])

    return run


def _merged(centres: np.ndarray, size: np.ndarray, total: np.ndarray, spread: float) -> np.ndarray:
    """A group number for each cell: cells of one group are parts of one crowd, which no centres tell apart.

    Two cells are joined if the members of either lie at most `spread` times as far (squared) from the other's centre as
    from their own. So a crowd that drew many centres is one group, whatever the number of cells.
    """
    far = 1 - (total / np.maximum(size, 1)[:, None]) @ centres.T.astype(np.float64)
    joined = far <= spread * np.diagonal(far)[:, None]
    joined &= joined.T & (size > 0) & (size > 0)[:, None]
    group = np.arange(len(size))
    while True:
        least = np.minimum(np.where(joined, group, len(size)).min(1), group)
        if (least == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = least


_ASSIGNED = "cell int, block int, base boolean, h long, key string, code binary, vec binary"


def _assign(index: Index, dim: int, probes: int, ratio: float, group: np.ndarray, blocks: np.ndarray):
    """Each vector once to the block of its group of cells, and as a query to all other blocks of its nearest groups."""
    p = min(probes, len(blocks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.sort_by([("h", "ascending"), ("k", "ascending")])
            h, first = np.unique(b.column("h").to_numpy(), return_index=True)
            b = b.take(pa.array(first))
            v = _matrix(b.column("v"), dim)
            x = _unit(v).astype(np.float32)
            near, score = _closest(x, index.centres, group, p)
            close = score >= ratio * score[:, :1]
            code = _binary(_pack(index.encode(x)))
            vec = _binary(v)
            own = h % blocks[near[:, 0]]
            none = pa.nulls(len(h), pa.string())
            yield _batch(near[:, 0], own, True, h, b.column("k"), code, vec)
            for j in range(p):
                for k in range(int(blocks[near[:, j]].max())):
                    at = (blocks[near[:, j]] > k) & ((own != k) if j == 0 else close[:, j])
                    if at.any():
                        i = pa.array(np.flatnonzero(at))
                        yield _batch(near[at, j], np.full(at.sum(), k), False, h[at], none.take(i), pa.nulls(int(at.sum()), pa.binary()), vec.take(i))

    def _batch(cell, block, base, h, key, code, vec):
        n = len(h)
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(n, base)), pa.array(h, pa.int64()), key, code, vec], ["cell", "block", "base", "h", "key", "code", "vec"])

    return run


def _best(sim: np.ndarray, near: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m most similar of each row; of equal ones those of smaller numbers, as rows stand in the order of their keys."""
    order = sim * (2 << 32) - near
    first = np.argpartition(-order, m - 1, 1)[:, :m]
    return np.take_along_axis(sim, first, 1), np.take_along_axis(near, first, 1)


_NONE = -(10**9)


class Block:
    """The rows of a block in the order of their keys, as codes and vectors, in cells of their own where they are many.

    A block of more than twice `cell_rows` rows is cut into cells of half as many by centres fitted on rows spread over it. How many of
    them a query looks into is measured: as many as hold `share` of the true neighbours of some of its rows, all of them
    if these lie anywhere. So the work of a query grows far less than the block, unless its rows are one crowd. Table scores
    of many queries are one product with the decoded codes, the same sums as by look-ups (Index.scan) in less time.
    """

    def __init__(self, index: Index, vectors: np.ndarray, codes: np.ndarray, h: np.ndarray, top: int, rerank: int, cell_rows: int, share: float = 0.99, tried: int = 64):
        self.h, self.top, self.rerank = h, top, rerank
        coded = index.decode(codes)
        along = (coded * vectors).sum(1)  # what coding left of the vector's length along it, and how much it added across
        across = np.sqrt(np.maximum((coded**2).sum(1) - along**2, 0))
        n = len(h)
        self.cells, self.probes = [np.arange(n)], 1
        self.centres = np.zeros((1, vectors.shape[1]), np.float32)
        if n > 2 * cell_rows:
            k = 2 * n // cell_rows
            some = vectors[np.linspace(0, n - 1, min(n, 20 * k)).astype(np.int64)].astype(np.float32)
            c = some[:: max(1, len(some) // k)][:k].copy()
            for _ in range(5):
                near = (some @ c.T).argmax(1)
                total = np.zeros_like(c)
                np.add.at(total, near, some)
                size = np.linalg.norm(total, axis=1)
                c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-9)[:, None], c)
            x = vectors.astype(np.float32)
            near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, n, 8192)])
            at = np.linspace(0, n - 1, min(n, tried)).astype(np.int64)
            sim = x[at] @ x.T
            sim[np.arange(len(at)), at] = -2
            true = np.argpartition(-sim, top - 1, 1)[:, :top]
            place = np.argsort(np.argsort(-(x[at] @ c.T), 1), 1)  # the place of each cell for each query
            probes = int(np.quantile(np.take_along_axis(place, near[true], 1), share, method="higher")) + 1
            if probes <= k // 2:
                order = np.argsort(near, kind="stable")
                cuts = np.searchsorted(near[order], np.arange(k + 1))
                self.cells, self.centres, self.probes = [order[a:e] for a, e in zip(cuts, cuts[1:])], c, probes
        self.rows, self.cuts = np.concatenate(self.cells), np.cumsum([0, *map(len, self.cells)])
        self.vectors = vectors[self.rows]  # cell by cell, as are the codes with their errors
        self.single = self.vectors.astype(np.float32)
        known = np.column_stack([coded, np.where(along > 0, along, -100).astype(np.float32), across.astype(np.float32)])  # a code that points away is never ruled out
        self.known = known[self.rows]
        self.scanned = 0  # codes that were looked at so far

    def _asked(self, near: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The rows of each cell, and the queries that look into it."""
        order = np.argsort(near, axis=None, kind="stable")
        ends = np.searchsorted(near.reshape(-1)[order], np.arange(len(self.cells) + 1))
        for c in np.flatnonzero(np.diff(ends)):
            if len(self.cells[c]):
                yield slice(self.cuts[c], self.cuts[c + 1]), order[ends[c] : ends[c + 1]] // near.shape[1]

    def _floor(self, x: np.ndarray, own: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
        """A similarity that the m best of each query reach: that of the m-th of the best `rerank` codes of its nearest cell."""
        last = np.full(len(x), -1.0, np.float32)
        for at, q in self._asked(first):
            score = x[q] @ self.known[at, :-2].T
            self.scanned += score.size
            keep = min(self.rerank, score.shape[1])
            if keep < m:
                continue
            near = np.argpartition(score, score.shape[1] - keep, 1)[:, score.shape[1] - keep :] + at.start
            sim = np.matmul(self.single[near], x[q][:, :, None])[:, :, 0]
            sim[self.h[self.rows[near]] == own[q][:, None]] = -1
            last[q] = np.partition(sim, keep - m, 1)[:, keep - m]
        return np.clip(last - 5e-6, -1, 1)

    def search(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most similar rows of each query but its own: similarities in millionths, and numbers; _NONE fills up.

        A row's exact similarity s and its table score differ by the known error of its code: the score is at least
        s * along - sqrt(1 - s^2) * across. So one product of the queries with codes and errors tells which rows can be
        as good as the floor; these are compared exactly.
        """
        m = min(self.top, len(self.h))
        x32 = x.astype(np.float32)
        near = np.zeros((len(x), 1), np.int64)
        if len(self.cells) > 1:
            near = np.argpartition(score := -(x32 @ self.centres.T), self.probes - 1, 1)[:, : self.probes]
        last = self._floor(x32, own, near if len(self.cells) == 1 else score.argmin(1)[:, None], m)[:, None]
        asked = np.hstack([x32, -last, np.sqrt(1 - last**2)])
        found = [(np.zeros(0, np.int64),) * 3]
        for at, q in self._asked(near):
            room = asked[q] @ self.known[at].T
            self.scanned += room.size
            could = room >= -1e-5
            could[last[q, 0] <= 0] = True  # the bound holds for similarities above zero
            if np.count_nonzero(could) > 0.05 * could.size:  # codes tell too little: vectors in single precision do
                could &= x32[q] @ self.single[at].T >= last[q]
            if (count := np.count_nonzero(could)) > 0.05 * could.size:
                sim = np.rint(x[q] @ self.vectors[at].T * 1e6).astype(np.int64)
                sim[~could | (self.h[self.rows[at]] == own[q][:, None])] = _NONE
                s, k = _best(sim, np.broadcast_to(self.rows[at], sim.shape), min(m, sim.shape[1]))
                found.append((np.repeat(q, s.shape[1]), s.reshape(-1), k.reshape(-1)))
            elif count:
                i, j = np.divmod(np.flatnonzero(could), could.shape[1])
                sim = np.einsum("nd,nd->n", x[q[i]], self.vectors[j + at.start])
                found.append((q[i], np.rint(sim * 1e6).astype(np.int64), self.rows[j + at.start]))
        q, s, k = map(np.concatenate, zip(*found))
        good = (s > _NONE) & (self.h[k] != own[q])
        q, s, k = q[good], s[good], k[good]
        order = np.lexsort((k, -s, q))
        q, s, k = q[order], s[order], k[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = np.full((len(x), m), _NONE, np.int64), np.full((len(x), m), len(self.h), np.int64)
        for b, of in zip(best, (s, k)):
            b[q[place < m], place[place < m]] = of[place < m]
        return best


def _search(index: Index, dim: int, top: int, rerank: int, cell_rows: int, batch_rows: int = 65_536):
    """Nearest rows of each block for its queries. The rows of a block come before those that are only queries, which are answered in batches."""

    def prepared(t: pa.Table) -> Block | None:
        """The rows of a block in the order of their keys, of equal vectors the one of the smallest key."""
        h = t.column("h").to_numpy()
        base = np.flatnonzero(t.column("base").to_numpy(zero_copy_only=False))
        keys = np.array(t.column("key").take(pa.array(base)).to_pylist(), object)
        base = base[np.argsort(keys, kind="stable")]
        _, first = np.unique(h[base], return_index=True)
        base = base[np.sort(first)]
        if not len(base):
            return None
        codes = _unpack(_rows(t.column("code").take(pa.array(base)), np.uint8, index.parts // 2))
        return Block(index, _unit(_rows(t.column("vec").take(pa.array(base)), np.float32, dim)), codes, h[base], top, rerank, cell_rows)

    def answers(t: pa.Table, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:
            return
        h, vecs = t.column("h").to_numpy(), _rows(t.column("vec"), np.float32, dim)
        _, queries = np.unique(h, return_index=True)
        step = max(32, min(2048, 2_000_000 // max(map(len, block.cells)), 8_000_000 * len(block.cells) // (block.probes * len(block.h))))
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            s, k = block.search(_unit(vecs[q]), h[q])
            good = s > _NONE
            ends = np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[q]), pa.ListArray.from_arrays(pa.array(ends), pa.array(block.h[k[good]])), pa.ListArray.from_arrays(pa.array(ends), pa.array(s[good].astype(np.int32)))], ["h", "n", "s"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, kept, block = None, [], None
        for b in batches:
            where = b.column("cell").to_numpy().astype(np.int64) << 32 | b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:]):
                if e == a:
                    continue
                if where[a] != open_:
                    if kept:
                        t = pa.Table.from_batches(kept).combine_chunks()
                        yield from answers(t, block or prepared(t))
                    kept, block = [], None
                open_ = where[a]
                kept.append(b.slice(a, e - a))
                if sum(x.num_rows for x in kept) >= batch_rows and not kept[-1].column("base")[-1].as_py():
                    t = pa.Table.from_batches(kept).combine_chunks()
                    block = block or prepared(t)
                    yield from answers(t, block)
                    kept = []
        if kept:
            t = pa.Table.from_batches(kept).combine_chunks()
            yield from answers(t, block or prepared(t))

    return run


def _nearest(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", dim: int = 64, k: int = 5, probes: int = 3, ratio: float = 0.85, rerank: int = 32, cell_rows: int = 400, max_cells: int = 2048, sample_rows: int = 40_000, block_rows: int = 100_000, spread: float = 1.35) -> DataFrame:
    """Numbered keys (i, k, h), numbers in the order of keys, and (i, best): each key's nearest as (similarity, number)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.filter(F.col(key).isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("string").alias("k"), v.cast("array<float>").alias("v")).withColumn("h", F.xxhash64("v"))
    n = good.count()
    share = min(1.0, sample_rows / max(1, n))
    picked = good.filter(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(sample_rows).toArrow()
    out = "h long, n array<long>, s array<int>"
    if picked.num_rows:
        index = Index(_unit(_matrix(picked.column("v").combine_chunks(), dim)), max(1, min(max_cells, n // cell_rows)))
        sums = good.mapInArrow(_sizes(index, dim), "cell int, n long, v array<float>").groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("v")).collect()  # a row a cell
        size, total = np.zeros(len(index.centres), np.int64), np.zeros((len(index.centres), dim))
        for r in sums:
            size[r.cell], total[r.cell] = r.n, r.v
        group = _merged(index.centres, size, total, spread)
        blocks = np.maximum(1, -(-np.bincount(group, weights=size).astype(np.int64) // block_rows))
        routed = good.mapInArrow(_assign(index, dim, probes, ratio, group, blocks), _ASSIGNED).repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("base"))
        lists = routed.mapInArrow(_search(index, dim, k + 1, rerank, cell_rows), out)
    else:
        lists = df.sparkSession.createDataFrame([], out)
    members = written(good.select("h", "k").dropDuplicates(["k"]).sort("k").withColumn("i", F.monotonically_increasing_id()))
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("i"))).filter(F.col("r") <= k + 1)
    first = first.groupBy("h").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    copies = first.filter(F.size("ids") > 1).select("h", F.col("h").alias("n"), F.lit(1_000_000).alias("s"))
    hits = lists.groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("n", "s")))).alias("x"))
    floor = F.element_at(F.sort_array(F.col("x.s"), False), F.least(F.size("x"), F.lit(k + 1)))
    hits = hits.filter(F.size("x") > 0).select("h", F.explode(F.filter("x", lambda y: y["s"] >= floor)).alias("y")).select("h", F.col("y.n").alias("n"), F.col("y.s").alias("s"))
    found = hits.unionByName(copies).join(first.withColumnRenamed("h", "n"), "n").groupBy("h").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda y: F.struct((-F.col("s")).alias("s"), y.alias("i")))))), 1, k + 1).alias("best")
    )
    return members, members.select("i", "h").join(found, "h").select("i", F.slice(F.filter("best", lambda y: y["i"] != F.col("i")), 1, k).alias("best"))


def nearest(df: DataFrame, key: str = "chunk_id", **options) -> DataFrame:
    """(key, near, similarity, rank): the k most similar other vectors of every vector, by cosine rounded to six decimals; of equally similar ones the smaller key comes first.

    The index is fitted on a sample of at most `sample_rows` (40,000) vectors, chosen by a hash of their keys; every vector is
    indexed and every vector is a query. A query looks into its nearest cell and into up to `probes` that are at least
    `ratio` as similar. The `rerank` best of its nearest cell by table scores of their four-bit codes give a floor; all rows
    are scored exactly in double precision where the known error of their code, along and across the vector, leaves
    room for a score as good. There are n / `cell_rows` cells, `max_cells` at most; beyond, each cell is cut again where
    it is searched (see Block), so that a query's work hardly grows. Cells beyond `block_rows` are cut into blocks that
    are searched apart. Cells that split one crowd are joined first: with its members' distances from the centres at most
    `spread` times (squared) those from their own, they hold one another's neighbours. A crowd costs the square of its
    size. Equal vectors are searched once: their keys meet by the vector's hash, of which the k + 1 smallest can be
    anyone's neighbours. Recall is measured in the tests against brute force.

    Vectors count that have `dim` finite numbers, not all zero; null, short, long and other vectors and null keys have
    no rows. Each key counts once. Other columns are ignored. Fewer than k other vectors give fewer rows, an empty table
    none.
    """
    members, own = _nearest(df, key, **options)
    rows = own.select("i", F.posexplode("best").alias("rank", "b")).select("i", F.col("b.i").alias("j"), F.col("b.s").alias("s"), "rank")
    rows = rows.join(members.select("i", F.col("k").alias(key)), "i").join(members.select(F.col("i").alias("j"), F.col("k").alias("near")), "j")
    return rows.select(key, "near", (-F.col("s") / 1e6).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def nearest_pairs(df: DataFrame, key: str = "chunk_id", **options) -> DataFrame:
    """(key_a, key_b), smaller first: at least one is among the other's most similar. As nearest."""
    members, own = _nearest(df, key, **options)
    rows = own.select("i", F.explode("best.i").alias("j")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    rows = rows.join(members.select(F.col("i").alias("a"), F.col("k").alias(f"{key}_a")), "a")
    return rows.join(members.select(F.col("i").alias("b"), F.col("k").alias(f"{key}_b")), "b").select(f"{key}_a", f"{key}_b")
