"""Repair of scanned texts: stated defects, the repaired text, and odd input."""

from foliolens.llm.scans import candidates, repaired_texts, scan_defects, viterbi

CHUNK = "doc_id string, chunk_id string, text string, page_start int, page_end int, title string, n int"
CAT = "id string, title string, mime string, text string"
CLEAN = "The quarterly statement was inspected by the maintenance crew during the second shift. The long-term archive remained closed. Harbour boards meet here."
BAD = """The quarfer1y statement was inspe-
Page 4 of 9
cted by the maintenance crew diiring the
VALLEY MINUTES 12   4

seco¬
nd shift. The long-
term archive remained clo5ed.
4.2 Quarterly statement
All 12 units of L1-999 left.
Northfen Works Archive
The crew met again
"""
OTHER = "The crew met.\nNorthfen Works Archive\nThe second shift closed."


def tables(rows, extra=()):
    chunks = [("c", f"c{i}", CLEAN, -1, -1, "t", 1) for i in range(4)] + [("s", "s1", BAD, 4, 5, "t", 1)] * 2 + [("s", "s2", OTHER, 6, 6, "t", 1), *extra]
    catalog = [("s", "Valley Minutes 12.tif", "image/tiff", "x"), ("s", "Valley Minutes 12.tif", "image/tiff", "x"), ("c", "Clean.pdf", "application/pdf", "x"), ("u", None, "image/tiff", "x"), (None, "q", "image/tiff", "x")]
    return rows(chunks, CHUNK), rows(catalog, CAT)


def test_defects(rows):
    got = [tuple(r) for r in scan_defects(*tables(rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {
        ("s1", "hyphen", "inspected"), ("s1", "hyphen", "second"), ("s1", "header", ""), ("s1", "page_number", ""), ("s2", "header", ""),
        ("s1", "misread", "quarterly"), ("s1", "misread", "during"), ("s1", "misread", "closed"),
    }


def test_repaired(rows):
    text = {r.chunk_id: r.text for r in repaired_texts(*tables(rows)).collect()}["s1"]
    assert text.startswith("The quarterly statement was inspected by the maintenance crew during the second shift. The long-term archive remained closed.")
    assert "MINUTES" not in text and "Page 4" not in text and "Northfen" not in text and "L1-999" in text


def test_odd_input(rows):
    extra = [("s", "e1", None, 1, 1, "t", 1), ("s", "e2", " \n ", 1, 1, "t", 1), ("s", None, BAD, 1, 1, "t", 1), ("u", "u1", "diiring the shift\n7\n", None, None, "t", 1), (None, "x", "Plain text.", 1, 1, "t", 1), ("s", "e3", "word " * 40_000, 1, 1, "t", 1)]
    got = {tuple(r) for r in scan_defects(*tables(rows, extra)).collect()}
    assert {x for x in got if x[0] in ("u1", "e1", "e2", "e3", "x")} == {("u1", "misread", "during"), ("u1", "page_number", "")}
    chunks, catalog = tables(rows)
    assert scan_defects(chunks.limit(0), catalog).count() == 0 and scan_defects(chunks, catalog.limit(0)).count() == 0


def test_parts():
    assert "during" in candidates("diiring") and "closed" in candidates("clo5ed") and "at" not in candidates("at")
    word = lambda pos, w, c, link=-1: {"pos": pos, "link": link, "word": w, "n_next": 9, "c": c}
    one = word(0, "farm", {"farm": (0.0, 5, 0, 0), "form": (-3.0, 50, 0, 40)})
    assert viterbi([one], {}, 1000.0) == ["form"]
    assert viterbi([word(0, "farm", {"farm": (0.0, 5, 4, 4), "form": (-3.0, 50, 0, 0)})], {}, 1000.0) == ["farm"]
    # alone each of two neighbours would stay; their candidates are known side by side
    two = [word(0, "blaek", {"blaek": (0.0, 0.01, 0, 0), "black": (-6.0, 20, 0, 0), "bleak": (-6.0, 20, 0, 0)}, 6), word(6, "bax", {"bax": (0.0, 0.01, 0, 0), "box": (-6.0, 30, 0, 0)})]
    assert viterbi(two, {(0, "black", "box"): 15}, 1000.0) == ["black", "box"]
    assert viterbi(two, {(0, "bleak", "box"): 15}, 1000.0) == ["bleak", "box"]


def test_neighbours_and_real_words(rows):
    """Two misread words side by side, and a misreading that is a word of the clean texts."""
    clean = [("c", f"c{i}", "They sent the form to the bureau. Please sign the form today. A small farm lies north. The farm is old. Some bulky modern lamps hang there.", -1, -1, "t", 1) for i in range(200)]
    bad = [("s", "s1", "They sent the farm to the bureau and bu1ky modem lamps.\nA small farm lies north.", 1, 1, "t", 1), ("s", "s2", "Some bulhy modcrn lamps hang there.", 1, 1, "t", 1)]
    clean += [("c", "c99", "The modem is new. A modem hums.", -1, -1, "t", 1)]
    catalog = [("s", "Other.tif", "image/tiff", "x")]
    got = {tuple(r) for r in scan_defects(rows(clean + bad, CHUNK), rows(catalog, CAT)).collect()}
    assert {("s1", "misread", "bulky"), ("s1", "misread", "modern"), ("s2", "misread", "modern")} <= got
    assert not any(w in ("farm", "north", "small") for _, _, w in got)
