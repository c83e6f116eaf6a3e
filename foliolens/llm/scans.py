"""Repair of texts from scanned pages: frame lines, words cut at line ends, misread characters."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Usual confusions of character recognition, right form and what is read, with their probabilities.
CONFUSIONS = {
    ("e", "c"): 0.003, ("a", "@"): 0.003, ("t", "f"): 0.002, ("i", "l"): 0.003, ("s", "5"): 0.003, ("n", "ri"): 0.002,
    ("o", "0"): 0.003, ("l", "1"): 0.003, ("d", "cl"): 0.003, ("i", "!"): 0.003, ("u", "ii"): 0.002, ("m", "rn"): 0.003,
    ("g", "9"): 0.003, ("h", "b"): 0.002, ("b", "6"): 0.003, ("w", "vv"): 0.003, ("in", "m"): 0.001, ("li", "h"): 0.001,
    ("rn", "m"): 0.002, ("cl", "d"): 0.002, ("ri", "n"): 0.001, ("c", "e"): 0.001, ("f", "t"): 0.001, ("l", "i"): 0.001,
    ("b", "h"): 0.001, ("ii", "u"): 0.001, ("s", "$"): 0.001, ("i", "1"): 0.002, ("l", "!"): 0.001, ("l", "|"): 0.001,
    ("i", "|"): 0.001, ("e", "o"): 0.0005, ("z", "2"): 0.001, ("b", "8"): 0.001, ("q", "9"): 0.0005, ("vv", "w"): 0.0005,
    ("é", "6"): 0.0005, ("a", "o"): 0.0005, ("n", "u"): 0.0005, ("u", "n"): 0.0005, ("l", "I"): 0.001, ("u", "v"): 0.0005,
}
HYPHENS = "-‐¬­"
_HYPHEN_SET = frozenset(HYPHENS)
_SIGNS = "0123456789@!$|"
_WORD = re.compile(r"[^\W\d_]+")
_NOISY = re.compile(rf"[^\W_]*[^\W\d_](?:[^\W_]|[@!$|](?=[^\W\d_]))*")
_EDGE = re.compile(rf"([^\W\d_](?:[^\W_]|[@!$|])*)[{HYPHENS}]\s*$")
_HEAD = re.compile(r"^\s*((?:[^\W_]|[@!$|](?=[^\W\d_]))*[^\W\d_](?:[^\W_]|[@!$|](?=[^\W\d_]))*)")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
_ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = re.compile(rf"^(?:[-–—·\[(|]|p\.|pp\.|s\.|pág\.|page|seite|página|стр\.)?\s*(?:(\d{{1,5}})(?:\s*(?:of|de|von|sur|/)\s*\d{{1,5}})?|({_ROMAN}))\s*[-–—·\])|]?$", re.IGNORECASE)
_PARTS = re.compile(r"\s{2,}|\s[|–—]\s")
_MINOR = re.compile(rf"^(?:v[o0][l1i!|]|r[ec][vu]|no|nr|bd|t|tome|band|ed|issue)\.?\s*(?:\d+|[ivxlc1!|]{{1,7}})$", re.IGNORECASE)
_HEADING = re.compile(r"^\d+(?:\.\d+)+\.?\s|^(?:fig|figure|table|tab|abb|abbildung|tabelle|figura|tabla|tableau)\b", re.IGNORECASE)
_LONG = re.compile(r"[^\W\d_][\w’'@!]*")
_MARKS = re.compile(r"[.,;:?„“”\"«»]|!(?!\w)|[-‐¬­]$")
_SENTENCE = re.compile(r"[.!?…:;,][\"”»“’)]*\s*$")
_FOLD = [("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("li", "h"), ("in", "m")]
_SAME = str.maketrans("015689@!$|cefhlq", "oisbbgaisitttbig")


def fold(text: str) -> str:
    """A key that confused characters do not change."""
    t = "".join(c for c in text.lower() if c.isalnum() or c in "@!$|").translate(_SAME)
    for a, b in _FOLD:
        t = t.replace(a.translate(_SAME), b.translate(_SAME))
    return t


def title_key(title: str | None) -> str:
    """The folded title without file endings and copy marks."""
    t = re.sub(r"\.(?:tiff?|pdf|jpe?g|png)\b", "", title or "", flags=re.IGNORECASE)
    t = re.sub(r"^\s*copy of\s+|\s*\(\d+\)\s*$|\s*-\s*copy\s*$", "", t.replace("_", " "), flags=re.IGNORECASE)
    return fold(t)


def _core(line: str) -> tuple[str, bool]:
    """A line without volume, revision and page number at its edges, and whether a page number was there."""
    parts = [p.strip() for p in _PARTS.split(line.strip()) if p.strip()]
    number = any(_NUMBER.match(p) for p in parts)
    return " ".join(p for p in parts if not _NUMBER.match(p) and not _MINOR.match(p)), number


def _lines(text: str, title: str, first: int | None, last: int | None) -> list[tuple[str, str, str, bool]]:
    """(kind, line, key, page number) of each line: blank, number, title, open (may be a series header) or text."""
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            out.append(("blank", line, "", False))
            continue
        if m := _NUMBER.match(s):
            known = first is not None and last is not None and 1 <= first <= last
            if m[2] or not known or first - 3 <= int(m[1]) <= last + 3:
                out.append(("number", line, "", True))
                continue
        if len(s) <= 95 and not _SENTENCE.search(s) and (s[0].isupper() or s[0].isdigit() or not s[0].isalnum()) and not _HEADING.match(s):
            core, number = _core(s)
            words = [w for w in _LONG.findall(core) if len(w) > 3]
            capital = len(words) >= 2 and not _MARKS.search(core) and sum(w[0].isupper() for w in words) >= 0.8 * len(words) and core[0].isupper()
            if capital or abs(len(core) - len(title)) <= 24:
                key = fold(core)
                if len(title) >= 5 and key == title:
                    out.append(("title", line, key, number))
                    continue
                if capital and len(key) >= 6 and len(s) <= 80:
                    out.append(("open", line, key, number))
                    continue
        out.append(("text", line, "", False))
    return out


def _tokens(lines: list[tuple[int, str]]):
    """(words, cuts): words of the running text as (line, start, end, word) in order, and words cut at line ends as (line, first, second, mark)."""
    words: list[tuple[int, int, int, str]] = []
    cuts: list[tuple[int, str, str, str]] = []
    carried = 0
    for n, (i, line) in enumerate(lines):
        stop = len(line)
        m = _EDGE.search(line) if line.rstrip()[-1:] in _HYPHEN_SET else None
        if m and n + 1 < len(lines) and (h := _HEAD.match(lines[n + 1][1])):
            second = h[1]
            mark = line.rstrip()[-1]
            if second[0].isalpha() and second[0].islower() or second[0] in _SIGNS or mark not in "-‐":
                cuts.append((i, m[1], second, mark))
                stop = m.start(1)
                nxt = h.end(1)
            else:
                nxt = 0
        else:
            nxt = 0
        for w in _NOISY.finditer(line, carried, stop):
            words.append((i, w.start(), w.end(), w[0].lower()))
        if stop < len(line) or nxt:
            words.append((i, stop, len(line), (m[1] + h[1]).lower()))
        carried = nxt
    return words, cuts


def candidates(word: str) -> dict[str, float]:
    """Spellings that may have been read as the word, with the log probability of the confusions; one of them, or two where signs stand in it."""
    def undo(w: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for (right, seen), p in CONFUSIONS.items():
            at = w.find(seen)
            while at >= 0:
                c = w[:at] + right + w[at + len(seen) :]
                out[c] = max(out.get(c, -99.0), math.log(p))
                at = w.find(seen, at + 1)
        return out

    one = undo(word)
    out = dict(one)
    if sum(c in _SIGNS for c in word) > 1 or len(word) > 6:
        for w, p in one.items():
            if sum(c in _SIGNS for c in word) > 1 or p > math.log(0.0025):
                for c, q in undo(w).items():
                    out[c] = max(out.get(c, -99.0), p + q)
    return {c: p for c, p in out.items() if c.isalpha() and c != word}


@cache
def _letters() -> np.ndarray:
    """Whether each code point stands in words, as in _WORD; the border between texts (1) is a word of its own."""
    out = np.zeros(0x110000, bool)
    out[:0x20000] = [_WORD.match(chr(o)) is not None for o in range(0x20000)]
    out[0x20000:0x32000] = True  # further ideographs
    out[1] = True
    return out


def _runs_of_words(texts: list[str]) -> list[str]:
    """Words of texts in lower case, with a border after each text."""
    codes = np.frombuffer("".join(f"{t.lower()} \x01 " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, 32).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split()


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, compounds and neighbouring words of a batch: (a, b, clean, n); b is null for words alone. Pairs are counted in clean texts."""
    for b in batches:
        clean: list[str] = []
        noisy, joined = [], []
        seen: Counter = Counter()
        compounds: Counter = Counter()
        for text, scan in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            if scan:
                noisy += text.lower().split()
                continue
            clean.append(text)
            if "-" in text or "‐" in text:
                joined += [w for w in text.lower().split() if "-" in w or "‐" in w]
        for found, pattern, tokens in ((seen, _NOISY, noisy), (compounds, _COMPOUND, joined)):
            for token, n in Counter(tokens).items():  # no match has a blank inside
                for w in pattern.findall(token):
                    found[w.replace("‐", "-")] += n
        coded = pa.array(_runs_of_words(clean), pa.string()).dictionary_encode()
        ids, names = coded.indices.to_numpy().astype(np.int64), np.array(coded.dictionary.to_pylist(), object)
        border = np.flatnonzero(names == "\x01")
        count = np.bincount(ids, minlength=len(names))
        inner = ~np.isin(ids, border)
        pairs, many = np.unique((ids[:-1] << 32 | ids[1:])[inner[:-1] & inner[1:]], return_counts=True)
        extra = [*compounds.items()]
        strange = [(w, n) for w, n in seen.items() if len(w) <= 60]
        real = np.flatnonzero(names != "\x01")
        first = [*names[real].tolist(), *(w for w, _ in extra), *(w for w, _ in strange), *names[pairs >> 32].tolist()]
        second = [None] * (len(real) + len(extra) + len(strange)) + names[pairs & 0xFFFFFFFF].tolist()
        own = [*count[real].tolist(), *(n for _, n in extra), *([0] * len(strange)), *many.tolist()]
        whole = [*count[real].tolist(), *(n for _, n in extra), *(n for _, n in strange), *many.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(own, pa.int64()), pa.array(whole, pa.int64())], ["a", "b", "clean", "n"])


def _open_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, d, text, title, first, last in zip(*(b.column(k).to_pylist() for k in range(6))):
            for n, (kind, _, key, _) in enumerate(_lines(text, title_key(title), first, last)):
                if kind == "open":
                    rows.append((i, d, n, key))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["id", "doc", "line", "key"])


def _parsed(text, title, first, last, series):
    """Kinds of lines with series headers decided, and the running text's lines."""
    lines = _lines(text, title_key(title), first, last)
    kinds = ["header" if k == "title" or n in series else "text" if k == "open" else k for n, (k, *_) in enumerate(lines)]
    return kinds, lines, [(n, lines[n][1]) for n, k in enumerate(kinds) if k == "text"]


#: Places of the table of words that may be misread; its size is fixed, words that share a place are parted by the join.
SLOTS = 1 << 20


def _scan(slots: np.ndarray):
    """Rows of frame lines, of words that may be misread with their neighbours, and of words cut at line ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["what", "id", "line", "pos", "word", "prev", "next", "first", "second", "mark", "link"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6, pa.int32()]
        memo: dict[str, bool] = {}

        def odd(w: str) -> bool:
            hit = memo.get(w)
            if hit is None:
                if len(memo) > 300_000:
                    memo.clear()
                hit = memo[w] = bool(slots[xxhash.xxh64_intdigest(w.encode(), 42) % SLOTS])
            return hit

        for b in batches:
            rows = []
            for i, _, text, title, first, last, series in zip(*(b.column(k).to_pylist() for k in range(7))):
                marks, lines, body = _parsed(text, title, first, last, set(series or ()))
                if "header" in marks:
                    rows.append(("header", i, *[None] * 9))
                if any(lines[n][3] and k in ("header", "number") for n, k in enumerate(marks)):
                    rows.append(("page_number", i, *[None] * 9))
                words, cuts = _tokens(body)
                whole = {(line, (x + y).lower()): (x.lower(), y.lower(), mark) for line, x, y, mark in cuts}
                open_ = [(2 < len(w) <= 60 or len(w) == 2 and w.isalpha()) and (odd(w) or (line, w) in whole) for line, _, _, w in words]
                for n, (line, start, _, w) in enumerate(words):
                    if open_[n]:
                        cut = whole.get((line, w), (None, None, None))
                        after = words[n + 1] if n + 1 < len(words) else (-1, -1, -1, "")
                        link = after[1] if n + 1 < len(words) and open_[n + 1] and after[0] == line else -1
                        rows.append(("word", i, line, start, w, words[n - 1][3] if n else "", after[3], *cut, link))
            cols = list(zip(*rows)) if rows else [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    return run


def _guess(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, c, p) for w in b.column(0).to_pylist() for c, p in candidates(w).items()]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], ["word", "cand", "channel"])


#: Weight of the words' own counts against those of pairs (pseudo-counts), and counts of words that no clean text has.
BACKOFF = 200.0
UNSEEN = 5e-4  # of letters alone
UNSEEN_SIGNS = 1e-6
UNSEEN_COMPOUND = 5e-3  # of two known words


def viterbi(lattice: list[dict], links: dict[tuple[int, str, str], int], total: float) -> list[str]:
    """Best candidate of each open word of a line, in order.

    A word of the lattice: pos, link (pos of the open word right after it, else -1), n_next (count of the word after it),
    c: candidate -> (log channel probability, count, count with the word before as read, with the word after as read).
    links: counts of candidates of linked words side by side, by the first one's pos. Scores are log channel
    probabilities and log probabilities of each word after the one before: (pair + BACKOFF x own share) / (count of the
    word before + BACKOFF).
    """
    paths: dict[str, tuple[float, list[str]]] = {"": (0.0, [])}
    before = None
    for x in lattice:
        linked = before is not None and before["link"] == x["pos"]
        step = {}
        for c, (channel, n, left, right) in x["c"].items():
            own = BACKOFF * n / total
            leave = 0.0 if x["link"] >= 0 else math.log((right + BACKOFF * (x["n_next"] + UNSEEN) / total) / (n + BACKOFF))
            if linked:
                pair = lambda a: links.get((before["pos"], a, c), left if a == before["word"] else before["c"][a][3] if c == x["word"] else 0)  # noqa: B023, E731
                s, p = max(((s + math.log((pair(a) + own) / (before["c"][a][1] + BACKOFF)), p) for a, (s, p) in paths.items()), key=lambda y: y[0])
            else:
                s, p = max(paths.values(), key=lambda y: y[0])
                s += math.log(left + own)
            step[c] = (s + channel + leave, [*p, c])
        paths, before = step, x
    return max(paths.values(), key=lambda y: y[0])[1]


def _decode(total: float):
    """Rows of one line's open words to the words chosen, with what they were cut into; unchanged words that were not cut have no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, line, found, joined in zip(*(b.column(k).to_pylist() for k in range(4))):
                by: dict[int, dict] = {}
                for x in found:
                    w = x["word"]
                    slot = by.setdefault(x["pos"], {k: x[k] for k in ("pos", "link", "word", "first", "second")} | {"n_next": x["n_next"], "c": {w: (0.0, UNSEEN if w.isalpha() else UNSEEN_SIGNS, 0, 0)}})
                    if x["cand"] is not None:
                        seen = 0.0 if x["cand"] != w else UNSEEN if w.isalpha() else UNSEEN_SIGNS
                        slot["c"][x["cand"]] = (x["channel"], x["n"] + seen, x["left"], x["right"])
                    if x["mark"] in ("-", "‐"):  # the compound with its own hyphen
                        slot["c"][f"{x['first']}-{x['second']}"] = (0.0, x["n_compound"] + (UNSEEN_COMPOUND if x["parts"] and not x["n_compound"] else UNSEEN_SIGNS), 0, 0)
                lattice = [by[p] for p in sorted(by)]
                best = viterbi(lattice, {(x["pos"], x["a"], x["b"]): x["n"] for x in joined or ()}, total)
                for x, w in zip(lattice, best):
                    if x["first"] is not None or w != x["word"]:
                        rows.append((i, line, x["pos"], x["word"], w, x["first"] is not None, x["first"] is not None and w == f"{x['first']}-{x['second']}"))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()))], ["id", "line", "pos", "word", "right", "cut", "compound"])

    return run


class Repair:
    """Everything found about the texts of scanned documents."""

    def __init__(self, chunks: DataFrame, scans: DataFrame, least: int = 2, series_docs: int = 3, real: float = 0.01):
        titles = F.broadcast(scans) if scans.count() <= 1_000_000 else scans
        rows = chunks.filter(F.col("text").isNotNull() & F.col("chunk_id").isNotNull()).select("doc_id", "chunk_id", "text", "page_start", "page_end")
        joined = rows.dropDuplicates(["chunk_id"]).join(titles, "doc_id", "left")
        counts = written(joined.select("text", F.col("title").isNotNull().cast("int").alias("scan")).mapInArrow(_count, "a string, b string, clean long, n long"))
        sums = counts.groupBy("a", "b").agg(F.sum("clean").alias("clean"), F.sum("n").alias("n"))
        words = sums.filter("b is null").select(F.col("a").alias("cand"), "clean", "n")
        pairs = sums.filter("b is not null").select("a", "b", "n")
        own = written(rows.join(titles, "doc_id").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("doc"), "text", "title", "page_start", "page_end"))
        lines = own.mapInArrow(_open_lines, "id string, doc string, line int, key string")
        lines = written(lines)
        series = lines.groupBy("key", "doc").agg(F.countDistinct("id").alias("k")).groupBy("key").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("docs"))
        series = series.filter((F.col("k") >= 2) | (F.col("docs") >= series_docs)).select("key")
        headers = lines.join(series, "key").groupBy("id").agg(F.collect_set("line").alias("series"))
        self.texts = own.join(headers, "id", "left")
        # words that the clean texts have less than twice, or so rarely that a usual word is as likely; and what they may be
        known = words.select(F.col("cand").alias("word"), F.col("clean").alias("self"), "n")

        def fixes(strange):
            guesses = strange.select("word").mapInArrow(_guess, "word string, cand string, channel double")
            found = guesses.join(words.select("cand", F.col("clean").alias("n")), "cand").filter(F.col("n") >= least).join(strange.select("word", "self"), "word")
            return found.filter((F.col("self") < least) | (F.col("n") * F.exp("channel") >= real * F.col("self"))).select("word", "cand", "channel", "self", "n")

        single = written(fixes(known.filter("n > self").drop("n")))
        slots = np.zeros(SLOTS, bool)
        slots[[r.s for r in single.select(F.expr(f"pmod(xxhash64(word), {SLOTS})").alias("s")).distinct().collect()]] = True  # at most SLOTS numbers
        self.rows = written(self.texts.select("id", "doc", "text", "title", "page_start", "page_end", "series").mapInArrow(_scan(slots), "what string, id string, line int, pos int, word string, prev string, next string, first string, second string, mark string, link int"))
        open_ = self.rows.filter("what = 'word'").drop("what")
        glued = open_.filter("first is not null").select("word").distinct().join(single.select("word").distinct(), "word", "left_anti")
        glued = glued.join(known.drop("n"), "word", "left").fillna(0, ["self"])
        all_ = single.unionByName(fixes(glued))
        same = single.select("word", "self").unionByName(glued).filter("self > 0").distinct()
        all_ = all_.unionByName(same.select("word", F.col("word").alias("cand"), F.lit(0.0).alias("channel"), "self", F.col("self").alias("n")))
        fixed = open_.join(all_, "word")
        # cut words without any candidate stay open for their compounds
        seen = fixed.unionByName(open_.filter("first is not null").join(all_.select("word").distinct(), "word", "left_anti"), allowMissingColumns=True)
        count = lambda name: words.select(F.col("cand").alias(name), F.col("clean").alias("n_" + name))
        seen = seen.join(count("next"), "next", "left").fillna(0, ["n_next"])
        left = pairs.select(F.col("a").alias("prev"), F.col("b").alias("cand"), F.col("n").alias("left"))
        right = pairs.select(F.col("a").alias("cand"), F.col("b").alias("next"), F.col("n").alias("right"))
        scored = seen.join(left, ["prev", "cand"], "left").join(right, ["cand", "next"], "left").fillna(0, ["left", "right"])
        # the compound with its own hyphen beside the whole word
        cuts = open_.filter("first is not null and mark in ('-', '‐')").select("first", "second").distinct().withColumn("compound", F.concat_ws("-", "first", "second"))
        cuts = cuts.join(count("compound"), "compound", "left").join(count("first"), "first", "left").join(count("second"), "second", "left").fillna(0)
        parts = (F.col("n_first") >= least) & (F.col("n_second") >= least) & (F.length("first") > 2) & (F.length("second") > 2)
        scored = scored.join(cuts.select("first", "second", "n_compound", parts.alias("parts")), ["first", "second"], "left").fillna(0, ["n_compound"])
        # candidates of open words side by side
        one = fixed.filter("link >= 0").select("id", "line", "pos", F.col("link").alias("at"), F.col("cand").alias("a"))
        two = fixed.select("id", "line", F.col("pos").alias("at"), F.col("cand").alias("b"))
        links = one.join(two, ["id", "line", "at"]).join(pairs, ["a", "b"]).groupBy("id", "line").agg(F.collect_list(F.struct("pos", "a", "b", "n")).alias("links"))
        fields = ("pos", "link", "word", "cand", "channel", "n", "n_next", "left", "right", "first", "second", "mark", "n_compound", "parts")
        lattice = scored.groupBy("id", "line").agg(F.collect_list(F.struct(*fields)).alias("x")).join(links, ["id", "line"], "left").select("id", "line", "x", "links")
        total = float(max(1, words.agg(F.sum("clean")).first()[0] or 0))
        decoded = written(lattice.mapInArrow(_decode(total), "id string, line int, pos int, word string, right string, cut boolean, compound boolean"))
        self.misread = decoded.filter("right <> word and not compound").select("id", "line", "pos", "word", "right")
        self.cuts = decoded.filter("cut and not compound").select("id", "line", F.col("right").alias("whole"))

    def defects(self) -> DataFrame:
        frame = self.rows.filter("what in ('header', 'page_number')").select("id", F.col("what").alias("defect"), F.lit("").alias("word"))
        cut = self.cuts.select("id", F.lit("hyphen"), "whole")
        wrong = self.misread.select("id", F.lit("misread"), "right")
        return frame.union(cut).union(wrong).distinct().toDF("chunk_id", "defect", "word")

    def repaired(self) -> DataFrame:
        wrong = self.misread.groupBy("id").agg(F.collect_list(F.struct("line", "pos", "word", "right")).alias("wrong"))
        cut = self.cuts.groupBy("id").agg(F.collect_set("line").alias("cut"))
        rows = self.texts.join(wrong, "id", "left").join(cut, "id", "left")
        return rows.select("id", "text", "title", "page_start", "page_end", "series", "wrong", "cut").mapInArrow(_rebuild, "chunk_id string, text string")


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = [], []
        for i, text, title, first, last, series, wrong, cut in zip(*(b.column(k).to_pylist() for k in range(8))):
            kinds, _, body = _parsed(text, title, first, last, set(series or ()))
            words, cuts = _tokens(body)
            right = {(x["line"], x["pos"]): x["right"] for x in wrong or ()}
            ends = {line: x for line, x, _, _ in cuts}
            real = set(cut or ())
            out: list[str] = []
            skip, glue = 0, False
            for n, (line, raw) in enumerate(body):
                m = _EDGE.search(raw) if line in ends else None
                stop = m.start(1) if m and line in real else len(raw)
                s = raw[:stop]
                for at, start, end, _ in reversed([w for w in words if w[0] == line and w[2] <= stop and (w[0], w[1]) in right]):
                    s = s[:start] + _cased(right[at, start], raw[start:end]) + s[end:]
                s = s[skip:] if not skip or (line, 0) not in right else s[len(s) - (stop - skip) :]
                skip, joins = 0, glue
                glue = bool(m) and line not in real
                if m and line in real:
                    h = _HEAD.match(body[n + 1][1])
                    skip = h.end(1)
                    s += _cased(right[line, stop], m[1]) if (line, stop) in right else m[1] + h[1]
                s = s.strip()
                if joins and s:
                    out.append(s)
                    continue
                if n and line > body[n - 1][0] + 1 and "blank" in kinds[body[n - 1][0] : line] and out and re.search(r"[.!?…][\"”»“’)]*$", out[-1]):
                    out.append("\n\n" + s)
                elif out and s and (s[0] in ".,;:!?)”»" or out[-1].endswith("\n")):
                    out.append(s)
                else:
                    out.append((" " if out and s else "") + s)
            ids.append(i)
            texts.append(re.sub(r"[ \t]+", " ", "".join(out)).strip())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["chunk_id", "text"])


def scanned(catalog: DataFrame) -> DataFrame:
    """(doc_id, title) of scanned documents; each once, a null title as ''."""
    rows = catalog.filter("mime = 'image/tiff' and id is not null")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.coalesce(F.max("title"), F.lit("")).alias("title"))


def scan_defects(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(chunk_id, defect, word) of chunks of scanned documents: hyphen, misread, header, page_number.

    Frame lines: page numbers that fit the chunk's pages; lines that repeat the document's title, or that stand alone in
    several chunks or documents with capitals throughout. Words across line ends are whole words if the corpus has them
    rather than the compound. Misread words: noisy-channel correction. Candidates undo known confusions of characters;
    a candidate's score is its channel probability times its count in texts that were not scanned, and the counts of its
    pairs with the words beside it; Viterbi picks the best candidates of a line.

    All counts are over all chunks. Null and blank texts, null keys and unknown documents have no rows; repeated chunks
    count once; pages of -1 or null fit any number. Other columns are ignored. Empty tables give no rows.
    """
    return Repair(chunks, scanned(catalog)).defects()


def repaired_texts(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(chunk_id, text) of chunks of scanned documents as running paragraphs of whole words. As scan_defects."""
    return Repair(chunks, scanned(catalog)).repaired()
