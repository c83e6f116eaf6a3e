"""FM-index against direct search, and leaks against brute-force alignment."""

import random

import numpy as np
import pytest

from foliolens.llm.leakage import FMIndex, Passages, build_shards, leaked_stretches, leaks, normal_words, removal_spans, search_shards

ITEM = "item_id long, passage string, doc_id long"
DOC = "doc_id long, text string, item_id long"


def test_index_equals_search():
    g = np.random.default_rng(4)
    for n, top in ((1, 1), (50, 2), (900, 7), (900, 300)):
        seq = g.integers(1, top + 1, n)
        seq = np.concatenate([seq, seq[: n // 2], seq])
        index = FMIndex(seq, top)
        for length in (1, 2, 5):
            if len(seq) < length:
                continue
            pats = np.array([seq[i : i + length] for i in range(0, len(seq) - length + 1, 13)] + [g.integers(1, top + 1, length)])
            lo, hi = index.search(pats)
            for p, a, b in zip(pats, lo, hi):
                got = sorted(index.locate(np.arange(a, b)).tolist())
                assert got == [i for i in range(len(seq) - length + 1) if (seq[i : i + length] == p).all()]


def test_leaks(rows):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = {i: [word() for _ in range(60)] for i in range(12)}
    noise = lambda n: [word() for _ in range(n)]
    docs, want = {}, set()
    for d in range(60):
        i = r.randrange(12)
        own = items[i]
        kind = d % 5
        if kind == 0:  # whole, in other case, with accents and breaks
            part = [w.upper().replace("A", "Á") for w in own]
        elif kind == 1:  # half of it, one word in ten changed or dropped
            part = [w if k % 10 else "zzz" for k, w in enumerate(own[20:54])]
        elif kind == 2:  # too short
            part = own[:20]
        elif kind == 3:  # too many changes
            part = [w if k % 5 else "zzz" for k, w in enumerate(own)]
        else:
            part = []
        if kind < 2:
            want.add((i, d))
        docs[d] = ",\n ".join(noise(40) + part + noise(30))
    docs[60], docs[61], docs[62] = (" ".join(x) for x in (items[3][25:] + noise(40), noise(9) + items[4][:33], items[5][20:52]))  # cut off by the document's start, end, both
    want |= {(3, 60), (4, 61), (5, 62)}
    data = [(d, t, 1) for d, t in docs.items()] + [(0, docs[0], 1), (100, docs[0], 1), (101, None, 1), (102, " ", 1), (None, docs[0], 1), (103, "x " * 50_000, 1)]
    want |= {(i, 100) for i, d in want if d == 0}
    ask = [(i, " ".join(p), 1) for i, p in items.items()] + [(98, None, 1), (99, "...", 1), (None, "a b", 1)]
    got = {tuple(x) for x in leaks(rows(data, DOC), rows(ask, ITEM), shard_words=700).collect()}
    assert got == want
    spans = {x.doc_id: (x.first_word, x.end_word) for x in removal_spans(rows(data, DOC), rows(ask, ITEM)).collect()}
    assert set(spans) == {d for _, d in want} and all(30 <= b - a <= 75 for a, b in spans.values()) and spans[0] == (40, 100)


def test_odd_input(rows):
    assert leaks(rows([], DOC), rows([(1, "a b c d e f", 1)], ITEM)).count() == 0
    assert leaks(rows([(1, "a b c d e f", 1)], DOC), rows([], ITEM)).count() == 0
    assert normal_words("Ａ-b É_ß 漢字") == ["a", "b", "e", "ss", "漢", "字"]


def test_index_written_and_searched_again(rows, tmp_path):
    words = [f"w{i}" for i in range(60)]
    docs = rows([(i, " ".join(["x"] * i + words[i : i + 40]), 1) for i in range(20)], DOC)
    items = [(1, " ".join(words[:40])), (2, " ".join(words[20:])), (3, "w1 w2 w3"), (4, " ".join(words[::-1]))]
    one = Passages(items[:2], 5, 0.5, 0.125, {w: n + 2 for n, w in enumerate(words)})
    path = str(tmp_path / "index")
    build_shards(docs, one.vocabulary, shard_words=200).write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    assert kept.count() > 2
    for some in (items[:2], items[2:], items):
        got = {tuple(r) for r in search_shards(kept, Passages(some, 5, 0.5, 0.125, one.vocabulary)).collect()}
        ask = rows([(i, p, 1) for i, p in some], ITEM)
        assert got == {tuple(r) for r in leaked_stretches(docs, ask).collect()} == {tuple(r) for r in leaked_stretches(docs, ask, pass_chars=100).collect()}
    with pytest.raises(ValueError):
        Passages([(1, "other words")], 5, 0.5, 0.125, one.vocabulary)


def distance(a, b):
    d = list(range(len(b) + 1))
    for x in a:
        d, old = [d[0] + 1], d
        for k, y in enumerate(b):
            d.append(min(old[k] + (x != y), old[k + 1] + 1, d[k] + 1))
    return d[-1]


def test_stretch_equals_brute_force():
    r = random.Random(3)
    for _ in range(60):
        own = [r.choice("abcdef") for _ in range(12)]
        doc = [r.choice("abcdefgh") for _ in range(r.randrange(9))]
        copy = own[r.randrange(4) : 9 + r.randrange(4)]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(copy))
            copy[at : at + r.randrange(2)] = [r.choice("abcxyz")] * r.randrange(2)
        doc += copy + [r.choice("abcdefgh") for _ in range(r.randrange(5))]
        p = Passages([(1, " ".join(own))], 5, 0.5, 0.125)
        words = np.array([p.vocabulary.get(w, 1) for w in doc], np.int32)
        got = p.stretch(0, words, -len(own), len(doc))
        found = [j - i for i in range(12) for j in range(i + 6, 13) for s in range(len(doc)) for e in range(s + 1, len(doc) + 1) if doc[s] == own[i] and doc[e - 1] == own[j - 1] and distance(own[i:j], doc[s:e]) <= (j - i) // 8]
        assert (got is None) == (not found)
        if got:
            assert min(distance(own[i : i + max(found)], doc[got[0] : got[1]]) for i in range(13 - max(found))) <= max(found) // 8


def test_short_passages(rows):
    items = rows([(1, "red pump", 1), (2, "one two three four five six seven", 1), (3, "a b c d e f g h i j k l m n o p", 1)], ITEM)
    docs = rows([(1, "the red door", 1), (2, "one two three four", 1), (3, "two three four", 1), (4, "x one two zero three four five", 1), (5, "c d e f X h i j k", 1), (6, "c d e X g X i j k", 1)], DOC)
    assert {tuple(r) for r in leaks(docs, items).collect()} == {(1, 1), (2, 2), (3, 5)}


def test_words_of_any_characters():
    """The table of letters and digits finds the words of the regular expression it replaced, for any code point."""
    import re
    import unicodedata

    from foliolens.llm import leakage

    assert len(leakage._IN_WORD) == 0x110000
    for i in range(0, 0x110000, 0x400):
        text = "a_B" + "x".join(chr(o) for o in range(i, i + 0x400)) + "Z9"
        plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
        want = re.findall(r"[^\W_]+", re.sub("([฀-๿぀-ヿ㐀-鿿])", r" \1 ", plain))
        assert leakage.normal_words(text) == want
    assert leakage.normal_words("The_Pump's 2nd-test.\n\x1fok") == ["the", "pump", "s", "2nd", "test", "ok"]
