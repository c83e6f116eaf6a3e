"""Look-alike texts: stated pairs, visible differences, odd input, and a brute-force grouping."""

import itertools

from foliolens.llm.lookalike import Decoder, consistent_text, look_classes, same_look_pairs

SCHEMA = "chunk_id string, text string, look string, n int"
FILL = [(f"f{i}", t, "x", 1) for i, t in enumerate(["the cope spare house dose was there", "Это русский текст с ростом и сорока осами", "η τουρμπίνα ελέγχθηκε νωρίς"] * 5)]


def pairs(rows, data):
    return {tuple(r) for r in same_look_pairs(rows(data, SCHEMA)).collect()}


def test_pairs_and_visible_differences(rows):
    base = "The first office, é 12 dose - Rest"
    same = {
        "b": "The ﬁrst oﬃce, é 12 dose - Rest", "c": "Thе first оffice, é 12 dоse - Rest", "d": "The first office, é 12　dose - Rest",
        "e": "T​he fi­rst office, é 12 dose - Rest", "f": "The first office， é １２ ｄose - Rest", "g": "The first office, é 12 dose ‑ Rest",
    }
    other = {"s": "The first office, e 12 dose - Rest", "t": "the first office, é 12 dose - Rest", "u": "The first office. é 12 dose - Rest", "v": "The first office, é 13 dose - Rest", "w": "The first offices, é 12 dose - Rest", "x": "The first office, é 12 dose – Rest"}
    data = [("a", base, "z", 0), ("a", base, "z", 0), *((k, t, "z", 0) for k, t in (same | other).items()), ("h", base, "z", 0), *FILL]
    got = pairs(rows, data)
    keys = ["a", *same]
    want = set(itertools.combinations(sorted(keys), 2)) | {(k, "h") for k in same if k < "h"}
    assert got == want


def test_odd_input(rows):
    assert pairs(rows, []) == set()
    data = [("a", None, "", 1), ("b", "  ", "", 1), ("c", "​", "", 1), (None, "text", "", 1), ("d", "x" * 200_000, "", 1), ("e", "x" * 199_999 + "х", "", 1)]
    assert pairs(rows, data) == {("d", "e")}


def test_spelling_follows_script(rows):
    out = {r.chunk_id: r.form for r in consistent_text(rows([*FILL, ("q", "соре spare Это роcтом", "x", 1), ("n", None, "x", 1), ("o", "", "x", 1)], SCHEMA)).collect()}
    assert out["q"] == "cope spare Это ростом" or out["q"] == "соре spare Это ростом"
    assert out["n"] is None and out["o"] == ""
    decoder = Decoder({("^", "т"): 5, ("т", "о"): 5, ("о", "$"): 5})
    assert decoder.token("тo") == "то"  # a Latin o beside a Cyrillic letter


def test_hot_group(rows):
    data = [(f"k{i:05d}", "same text here" if i % 2 else "same tехt here", "x", 1) for i in range(400)]
    classes = look_classes(rows([*data, data[0], ("z", None, "x", 1)], SCHEMA)).collect()
    assert {tuple(r) for r in classes} == {(k, "k00000", 400, 200) for k, *_ in data} and len(classes) == 400
    got = {tuple(r) for r in same_look_pairs(rows(data, SCHEMA), block=50).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] != b[1]}
