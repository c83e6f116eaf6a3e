"""Packing keeps every token, fits every container and wastes little; patterns are checked on random histograms."""

import base64
import random

import pytest

from foliolens.llm.packing import PATTERN, TOKENIZER, broken_rules, counter, fill, pack, shortest_pack_first, token_counts

LIMITS = "limit_id int, purpose string, capacity_tokens int, separator_tokens int"


def test_patterns_keep_the_histogram():
    r = random.Random(2)
    for _ in range(60):
        cap = r.randrange(1, 60)
        hist = {s: r.randrange(1, 500) for s in range(1, cap + 1) if r.random() < 0.5}
        seen: dict[int, int] = {}
        for n, pattern in shortest_pack_first(hist, cap):
            assert n > 0 and sum(pattern) <= cap
            for s in pattern:
                seen[s] = seen.get(s, 0) + n
        assert seen == hist


def test_pack(rows):
    r = random.Random(1)
    texts = [" ".join(r.choice(["pump", "Größe", "水泵", "12"]) for _ in range(r.choice([0, 1, 5, 30, 30, 200]))) for _ in range(300)]
    data = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (900, None, 0), (901, "", 0), (902, "pump " * 5000, 0), (None, "x", 0)]
    docs = rows(data, "doc_id long, text string, container int")
    limits = rows([(1, "a", 64, 0), (2, "b", 100, 2), (3, "c", None, 1), (None, "d", 9, 1)], LIMITS)
    sizes = {x.doc_id: x.tokens for x in token_counts(docs).collect()}
    packed = pack(docs, limits).collect()
    for limit, cap, gap in ((1, 64, 0), (2, 100, 2)):
        own = [x for x in packed if x.limit_id == limit]
        total: dict[int, int] = {}
        boxes: dict[int, list] = {}
        for x in own:
            total[x.doc_id] = total.get(x.doc_id, 0) + x.tokens
            if x.position >= 0:
                boxes.setdefault(x.container, []).append(x)
            assert x.part == 0 or sizes[x.doc_id] > cap
        assert total == sizes
        for box in boxes.values():
            at = 0
            for n, x in enumerate(sorted(box, key=lambda x: x.position)):
                assert x.position == n and x.start_token == at
                at += x.tokens + gap
            assert at - gap <= cap
        assert sum(sizes.values()) / (len(boxes) * cap) > (0.95 if gap == 0 else 0.8)
    assert {x.limit_id for x in packed} == {1, 2} and {x.limit_id for x in fill(pack(docs, limits), limits).collect()} == {1, 2}
    assert {(x.limit_id, x.texts, x.overfull, x.cut) for x in broken_rules(pack(docs, limits), limits).collect()} == {(1, 303, 0, 0), (2, 303, 0, 0)}
    assert pack(rows([], "doc_id long, text string"), limits).count() == 0


def test_counts_equal_the_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    with open(TOKENIZER) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = counter(TOKENIZER)
    for text in ("It's  a\n\n test 12,5\t!", "水泵 ひらがな ไทย", "  \n ", "don't stop 🙂", "a" * 300):
        assert count(text) == len(whole.encode_ordinary(text))
