"""Sentence extents on hand-split texts of many scripts, and odd input."""

from foliolens.llm.sentences import Splitter, sentences

TEXTS = {
    "en": ["Dr. Lustrane met Mr. J. K. Brennowe of Ostrel Ltd. at noon.", "The log was closed at 7 p.m.", "She noted: “Check the pump first.”", "“It is open. Please wait.” was all he said.", "The pump (it failed twice!) stalled ... then ran.", "See Fig. 12 and No. 7, i.e. the valve.", "iTherm readings rose.", "Why?!", "255 of the units, e.g. belts, broke…", "Nobody came."],
    "de": ["Am 6. September wurde die Anlage geprüft.", "„Bitte warten!“ stand auf dem Zettel.", "Mehrere Teile, z. B. die Pumpe, fehlten.", "Der Wert lag bei ca. 12 % (vgl. S. 100).", "Die Anlage läuft."],
    "fr": ["« La vanne est prête. Merci. » disait la note.", "Il faut arrêter la pompe !", "La station a-t-elle été fermée ?", "Voir la fig. 9 et le no. 4."],
    "ru": ["Были заменены ремни, болты и т. д.", "«турбина готова. Ждите.» — так сказано.", "См. рис. 3 и табл. 4, где всё видно."],
    "el": ["Γιατί η άδεια αναβλήθηκε;", "Ο κ. Lustrane ήρθε.", "Η τιμή έφτασε, δηλ. 12 %."],
    "hi": ["डॉ. Welvander के अनुसार टंकी बदली गई।", "क्या पंप 28.44 बार तक पहुँचा?", "काम हुआ।"],
    "ar": ["قال د. Ascarine إنه تم الفحص.", "لماذا تم التأجيل؟", "كتب الحارس: «جاهز. انتظروا.» ثم غادر."],
}
PACKED = {"zh": ["工程师说：“请等候！”然后离开了现场。", "压力达到86.14巴。", "为什么？"], "ja": ["担当者は「古いです。お待ちください。」と述べました。", "止めてください！"], "th": ["สัญญารหัส DE-6133 ถูกปฏิเสธ", "วาล์วชั่วคราว", "ความดัน 12.29 บาร์"]}
SCHEMA = "doc_id string, chunk_id string, text string, token string, n int"
#: Other texts of the corpus, which tell names and words apart.
MORE = ["The pump ran and nobody saw the log. Check it, she said, and why not. See it.", "Wurde die Pumpe geprüft? Der Zettel lag da. Mehrere kamen.", "Ждите! Были дни. См. выше. Болты и т. д. Были дни."] * 3


def cut(rows, data):
    out = {}
    for r in sentences(rows(data, SCHEMA)).collect():
        out.setdefault(r.chunk_id, []).append((r.sent_start, r.sent_end))
    return {k: sorted(v) for k, v in out.items()}


def test_scripts(rows):
    data, want = [], {}
    for k, s in {**TEXTS, **PACKED}.items():
        text = (" " if k in TEXTS or k == "th" else "").join(s)
        data += [("d" + k, k, text, "t", 1)] * 2
        want[k] = s
    data += [("m", f"m{i}", t, "t", 1) for i, t in enumerate(MORE)]
    got = cut(rows, data)
    text = {k: t for _, k, t, *_ in data}
    for k, s in want.items():
        assert [text[k][a:b] for a, b in got[k]] == s, k


def test_odd_input(rows):
    assert cut(rows, []) == {}
    long = "A pump ran here. " * 20_000
    data = [("d", "a", None, "", 1), ("d", "b", " \n　", "", 1), ("d", None, "Text.", "", 1), (None, "c", "  One is here.\nTwo came.  ", "", 1), ("d", "e", "no mark", "", 1), ("d", "f", long, "", 1), ("d", "g", ".", "", 1)]
    got = cut(rows, data)
    assert set(got) == {"c", "e", "f", "g"}
    assert got["c"] == [(2, 14), (15, 24)] and got["e"] == [(0, 7)] and len(got["f"]) == 20_000


def test_offsets_with_invisible_and_wide_characters():
    text = "O​ne is arranged． Two­ came！ Go"
    first, last, sure, _ = Splitter().split(text)
    assert (first, last) == (0, len(text))
    assert [text[a:b] for a, b in zip([0, *(s for _, s in sure)], [*(e for e, _ in sure), last])] == ["O​ne is arranged．", "Two­ came！", "Go"]


def test_many_unclosed_marks():
    for marks in ("(" * 100_000, "(" * 50_000 + "]" * 50_000, ":( " * 30_000):
        first, last, sure, _ = Splitter().split(marks + "One came. (Two left.) Three stayed.")
        assert (marks + "One came. (Two left.) Three stayed.")[sure[-1][1] : last] == "Three stayed."


def test_document_before_corpus_before_list(rows):
    """'col' and 'art' are listed; a document that has one without a full stop, or with a small letter after it, decides for itself."""
    other = [("d1", f"m{i}", "The pump ran. Pumps ran. A pump and a col and then Brennowe came. He saw Brennowe there.", "t", 1) for i in range(3)]
    said = "They crossed the col. Brennowe waited."
    data = [*other, ("d2", "a", f"Here the col is high. {said}", "t", 1), ("d3", "b", f"See col. xii here. {said}", "t", 1), ("d4", "c", "They met sra. Brennowe there.", "t", 1), ("d5", "e", said, "t", 1)]
    got = cut(rows, data)
    text = {k: t for _, k, t, *_ in data}
    assert [text["a"][a:b] for a, b in got["a"]] == ["Here the col is high.", "They crossed the col.", "Brennowe waited."]
    assert len(got["b"]) == 2 and len(got["c"]) == 1 and len(got["e"]) == 2  # the document's word, the list's, the corpus's


def test_words_of_a_document_in_other_chunks(rows):
    """a document's word without a full stop counts in whatever chunk it stands, also where no end hangs on it."""
    corpus = [(f"d{i}", f"k{i}", "We know the qorl. of today and then Anna came. But we saw that Anna left.", "t", 1) for i in range(2, 12)]
    text = "They took the qorl. Anna saw it."
    own = [("d1", "a", text, "t", 1), ("d1", "b", "One qorl here, and a qorl there.", "t", 1)]
    assert cut(rows, corpus + own[:1])["a"] == [(0, len(text))]
    assert cut(rows, corpus + own)["a"] == [(0, 19), (20, len(text))]
