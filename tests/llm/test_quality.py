"""Kinds of text and their statistics on plain examples, mixtures and odd input."""

import random

import numpy as np

from foliolens.llm.quality import KINDS, Listed, blocks, divergence, not_prose, text_quality, text_statistics

COMMON = [("en", w, i) for i, w in enumerate("the of and to in a was by for with that at on is it".split())] + [("de", w, i) for i, w in enumerate("die der und wurde am in den mit".split())] + [(None, "x", 1), ("en", None, 2)]
PROSE = "The pump was checked by the crew on Monday. It is in the hall, and a note was left for the guard. "
NAMES = "pump hall valve guard crew note archive boiler ledger tank".split()
SIZES = "red blue green old new small large long short wide".split()
r = random.Random(4)
pick = lambda *x: " ".join(r.choice(y) for y in x)
FUNCTION = "the of and to in a was by for with".split()


def make(kind: str, n: int) -> str:
    """A text of some kind; many of each give the profiles."""
    if kind == "prose":
        return " ".join(f"The {pick(SIZES, NAMES)} was checked by the {pick(NAMES)} on Monday. It is in the {pick(NAMES)}, and a {pick(NAMES)} was left for the {pick(SIZES, NAMES)}." for _ in range(n))
    if kind == "wrapped":
        return make("prose", n).replace(" checked by", "\nchecked by").replace(" left for", "\nleft for")
    if kind == "list":
        return "\n".join(f"{'- ' if n % 2 else ''}{pick(SIZES, NAMES)}" for _ in range(3 * n))
    if kind == "table":
        sep = "\t|;,"[n % 4]
        return "\n".join(sep.join([f"{r.random() * 900:.2f}", pick(NAMES), f"{r.randrange(9999)}", "yes"]) for _ in range(2 * n))
    if kind == "words":
        return " ".join(r.choice(FUNCTION + NAMES + SIZES) for _ in range(30 * n))
    if kind == "again":
        return " ".join([pick(SIZES, NAMES, NAMES)] * (8 * n))
    if kind == "signs":
        return "".join(r.choice("=@^<$~*&;|>/#_%-") for _ in range(60 * n))
    return make("prose", n).encode().decode("latin-1").translate({ord("e"): "Ã©", ord("o"): "Ã¶", ord("a"): "Ã¤"})


MADE = ["prose", "wrapped", "list", "table", "words", "again", "signs", "torn"]
DOCS = {i: make(MADE[i % 8], 2 + i // 8 % 5) for i in range(160)}
MIXED = {200: make("prose", 6) + "\n" + "\n".join(f"- pump {i}" for i in range(8)), 201: make("prose", 1) + "\n\n" + make("list", 11), 202: None, 203: "  \n ", 204: PROSE, 205: "word", 206: "(" * 50_000}
WANT = {i: {"list": "list", "table": "table"}.get(MADE[i % 8], "junk") for i in DOCS if i % 8 > 1} | {201: "list"}
SCHEMA = "doc_id long, text string, kind string, words int"


def test_kinds(rows):
    docs = rows([(i, t, "k", 1) for i, t in (DOCS | MIXED).items()] + [(1, DOCS[1], "k", 1), (None, "x", "k", 1)], SCHEMA)
    common = rows(COMMON, "lang string, word string, freq_rank int")
    got = {r.doc_id: r.kind for r in not_prose(docs, common).collect()}
    assert {i: k for i, k in got.items() if i not in (205, 206)} == WANT
    stats = {r.doc_id: r for r in text_quality(docs, common).collect()}
    assert set(stats) == set(DOCS | MIXED) - {202, 203}
    for r in stats.values():
        near = {k: r[f"{k}_divergence"] for k in KINDS}
        assert all(0 <= d <= 1 for d in near.values()) and (r.doc_id in MIXED or min(near, key=near.get) == r.kind)
    r = stats[204]
    assert r.words == 22 and r.symbol_ratio == 0 and r.punctuated_lines == 1 and 0.2 < r.common_words < 0.8
    assert stats[6].symbol_ratio > 0.5
    few = {r.doc_id for r in not_prose(docs, common, sample_docs=120).collect()}
    assert len(few ^ set(got)) <= 5


def test_empty(rows):
    common = rows(COMMON, "lang string, word string, freq_rank int")
    assert not_prose(rows([], SCHEMA), common).count() == 0 and text_statistics(rows([], SCHEMA), common).count() == 0
    only = rows([(1, None, "", 1), (2, "word", "", 1)], SCHEMA)
    assert [r.doc_id for r in text_quality(only, common).collect()] == [2]
    assert [r.words for r in text_quality(only, rows([], "lang string, word string, freq_rank int")).collect()] == [1]


def test_blocks():
    listed = Listed([("en", "the"), ("zh", "的")])
    texts = ["The pump.\n\n- a b\n- c d\n", " ", "x|y|z\np|q|r\nThe 水的泵。", "🙂 ok"]
    owner, size, parts = blocks(texts, listed)
    assert owner.tolist() == [0, 0, 2, 2, 3] and size.tolist() == [9, 10, 10, 8, 4]
    assert all((x.sum(1) >= 0).all() and len(x) == 5 for x in parts.values())
    assert parts["words"][0].tolist() == [9, 0, 4] and parts["words"][3].tolist() == [9, 3, 2]
    assert blocks([" \n "], listed)[1].tolist() == []


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    q = np.array([[0.0, 1.0], [0.5, 0.5]])
    m = lambda x: -(x[x > 0] * np.log2(x[x > 0])).sum()
    want = [[m((a + b) / 2) - (m(a) + m(b)) / 2 for b in q] for a in p]
    assert np.allclose(divergence(p, q), want, atol=1e-6)


def test_profiles_of_all_documents(spark, rows):
    """two documents of a form that no other has, which a sample of 8,000 by the hash of keys would leave out."""
    from pyspark.sql import functions as F

    out = spark.range(9000, 9200).filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) > 995_000 * 8000 // 8102).limit(2)
    junk = [r.id for r in out.collect()]
    docs = rows([(i, PROSE + " " + PROSE, "", 1) for i in range(8100)] + [(i, "0a 1b ff c3 " * 40, "", 1) for i in junk], SCHEMA)
    got = {r.doc_id: r for r in text_quality(docs, rows(COMMON, "lang string, word string, freq_rank int")).collect()}
    assert len(got) == 8102 and all(got[i].kind == "junk" and got[i].junk_divergence < 0.01 for i in junk)
