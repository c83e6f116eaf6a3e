"""Nearest vectors: recall against brute force, ties, copies and odd input."""

import time

import numpy as np

from foliolens.llm.neighbours import Block, Index, _closest, nearest, nearest_pairs

SCHEMA = "chunk_id string, embedding array<float>, near string, h long"


def brute(data, k=5):
    ok = sorted({c: v for c, v, *_ in data if c is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}.items())
    x = np.array([v for _, v in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    out = {}
    for i, (c, _) in enumerate(ok):
        order = sorted((j for j in range(len(ok)) if j != i), key=lambda j: (-s[i, j], j))[:k]
        out[c] = [ok[j][0] for j in order]
    return out


def test_recall_and_odd_vectors(rows):
    g = np.random.default_rng(3)
    centres = g.normal(size=(60, 64))
    data = [(f"c{i:04d}", (centres[i % 60] + 0.3 * g.normal(size=64)).astype(np.float32).tolist(), "x", 1) for i in range(1500)]
    data += data[:50]
    data += [("n1", None, "x", 1), ("n2", [1.0] * 63, "x", 1), ("n3", [0.0] * 64, "x", 1), ("n4", [float("nan")] * 64, "x", 1), ("n5", [float("inf")] * 64, "x", 1), (None, data[0][1], "x", 1)]
    got: dict = {}
    for r in nearest(rows(data, SCHEMA), cell_rows=100).collect():
        got.setdefault(r.chunk_id, {})[r["rank"]] = r.near
    want = brute(data)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[c].values()) & set(w)) for c, w in want.items())
    assert hits / (5 * len(want)) >= 0.95


def test_copies_and_ties(rows):
    g = np.random.default_rng(5)
    base = g.normal(size=64).astype(np.float32)
    data = [(f"k{i:03d}", base.tolist(), "x", 1) for i in range(40)] + [(f"m{i}", (base * 2 ** (i + 1)).tolist(), "x", 1) for i in range(3)] + [("z", g.normal(size=64).astype(np.float32).tolist(), "x", 1)]
    want = brute(data)
    got = {}
    for r in nearest(rows(data, SCHEMA)).orderBy("rank").collect():
        got.setdefault(r.chunk_id, []).append(r.near)
    assert got == want
    pairs = [tuple(r) for r in nearest_pairs(rows(data, SCHEMA)).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {tuple(sorted((a, b))) for a, w in want.items() for b in w}


def test_few_and_none(rows):
    assert nearest_pairs(rows([], SCHEMA)).count() == 0
    v = [1.0] * 64
    assert nearest_pairs(rows([("a", v, "", 1)], SCHEMA)).count() == 0
    assert [tuple(r) for r in nearest_pairs(rows([("b", v, "", 1), ("a", v[:-1] + [0.5], "", 1)], SCHEMA)).collect()] == [("a", "b")]


def test_codes_beat_plain_ones_on_large_scores():
    g = np.random.default_rng(6)
    x = g.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = Index(x, 4)
    own = (index.scan(x[:200], index.encode(x[:200]))).diagonal()
    plain = (index.scan(x[:200], index._nearest(x[:200]))).diagonal()
    assert np.abs(own - 1).mean() < np.abs(plain - 1).mean()


def recall(rows, data, keys, **options):
    """Share of the true five nearest of `keys` that are found; data without ties and odd vectors."""
    x = np.array([v for _, v, *_ in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    names = np.array([c for c, *_ in data])
    want = dict(zip(names, names[np.argpartition(-s, 5, 1)[:, :5]].tolist()))
    got: dict = {}
    for r in nearest(rows(data, SCHEMA), **options).collect():
        got.setdefault(r.chunk_id, set()).add(r.near)
    return sum(len(got.get(c, set()) & set(want[c])) for c in keys) / (5 * len(keys))


def test_a_third_in_one_tight_group(rows):
    g = np.random.default_rng(8)
    tight = g.normal(size=64) / 8 + np.sqrt(0.03 / 0.97) * g.normal(size=(1000, 64)) / 8
    rest = (g.normal(size=(250, 1, 64)) + 0.3 * g.normal(size=(250, 8, 64))).reshape(-1, 64)
    data = [(f"{i * 7919 % 3000:05d}{'t' if i < 1000 else 'r'}", v.astype(np.float32).tolist(), "x", 1) for i, v in enumerate([*tight, *rest])]
    crowd = recall(rows, data, [c for c, *_ in data if c[-1] == "t"], cell_rows=20, rerank=1000)
    assert crowd >= 0.9 and recall(rows, data, [c for c, *_ in data], cell_rows=20, rerank=1000) >= 0.9, crowd


def test_more_equal_and_near_equal_rows_than_are_reranked(rows):
    g = np.random.default_rng(9)
    base = g.integers(-8, 9, 64).astype(np.float32)
    data = [(f"k{i * 7919 % 400:03d}", (base * (i + 1)).tolist(), "x", 1) for i in range(400)]  # one direction, other lengths
    got: dict = {}
    for r in nearest(rows(data, SCHEMA)).orderBy("rank").collect():
        got.setdefault(r.chunk_id, []).append(r.near)
    first = [f"k{i:03d}" for i in range(6)]
    assert got == {c: [f for f in first if f != c][:5] for c, *_ in data}
    fine = g.normal(size=64) + 0.1 * g.normal(size=(1000, 64))
    data = [(f"f{i:04d}", v.astype(np.float32).tolist(), "x", 1) for i, v in enumerate([*fine, *g.normal(size=(1000, 64))])]
    assert recall(rows, data, [c for c, *_ in data[:1000]], cell_rows=2000) >= 0.99


def test_work_of_a_query_grows_less_than_blocks():
    """Codes looked at for a query in a block of 4,000 rows and in one ten times as large, of groups of 20; recall of both."""
    g = np.random.default_rng(10)
    looked = []
    for n in (4_000, 40_000):
        x = np.repeat(g.normal(size=(n // 20, 64)), 20, 0) + 0.5 * g.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        index = Index(x[:3000].astype(np.float32), 8)
        block = Block(index, x, index.encode(x.astype(np.float32)), np.arange(n), 5, 32, 400)
        q = np.arange(0, n, n // 200)
        s, k = block.search(x[q], q)
        looked.append(block.scanned / len(q))
        sim = x[q] @ x.T
        sim[np.arange(len(q)), q] = -2
        want = np.argpartition(-sim, 5, 1)[:, :5]
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(k.tolist(), want.tolist())]) >= 0.95
        assert len(block.cells) == n // 200
    assert looked[1] < 4 * looked[0] and looked[1] < 6_000, looked
    crowd = g.normal(size=64) / 8 + 0.02 * g.normal(size=(2_000, 64))  # neighbours lie in any cell: all are searched
    crowd /= np.linalg.norm(crowd, axis=1)[:, None]
    assert len(Block(index, crowd, index.encode(crowd.astype(np.float32)), np.arange(2_000), 5, 32, 400).cells) == 1


def test_large_blocks_cost_less_than_plain_products():
    """A block as large as those at 16 million vectors, of groups of 40: its search takes far less CPU time than brute force."""
    g = np.random.default_rng(12)
    x = np.repeat(g.normal(size=(200, 64)), 40, 0) + 0.35 * g.normal(size=(8_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x32, h = x.astype(np.float32), np.arange(8_000)
    index = Index(x32[:3000], 8)
    block = Block(index, x, index.encode(x32), h, 6, 32, 400)
    took = {"plain": [], "block": []}
    for _ in range(3):
        start = time.process_time()
        want = np.vstack([np.argpartition(-(x32[i : i + 200] @ x32.T), 7, 1)[:, :7] for i in range(0, 8_000, 200)])
        took["plain"].append(time.process_time() - start)
        start = time.process_time()
        found = np.vstack([block.search(x[i : i + 1000], h[i : i + 1000])[1] for i in range(0, 8_000, 1000)])
        took["block"].append(time.process_time() - start)
    assert np.mean([len(set(a) & (set(b) - {i})) / 6 for i, (a, b) in enumerate(zip(found.tolist(), want.tolist()))]) >= 0.98
    assert min(took["block"]) < 0.6 * min(took["plain"]), took


def test_nearest_groups_of_cells():
    g = np.random.default_rng(13)
    x, centres = g.normal(size=(700, 64)).astype(np.float32), g.normal(size=(40, 64)).astype(np.float32)
    group = np.unique(g.integers(0, 25, 40), return_inverse=True)[1]
    near, score = _closest(x, centres, group, 3)
    each = np.stack([(x @ centres[group == k].T).max(1) for k in range(group.max() + 1)], 1)
    assert (near == np.argsort(-each, 1)[:, :3]).all() and np.allclose(score, -np.sort(-each, 1)[:, :3])


def test_cells_cut_again(rows):
    g = np.random.default_rng(11)
    x = (g.normal(size=(150, 1, 64)) + 0.4 * g.normal(size=(150, 20, 64))).reshape(-1, 64)
    data = [(f"{i * 7919 % 3000:05d}", v.astype(np.float32).tolist(), "x", 1) for i, v in enumerate(x)]
    assert recall(rows, data, [c for c, *_ in data], cell_rows=100, max_cells=2) >= 0.9
