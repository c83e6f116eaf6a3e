"""Sentence extents in texts of many languages and scripts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import INVISIBLE, LOOKALIKES, look_table
from .store import written

#: Usual abbreviations, for where neither document nor corpus decides.
KNOWN = frozenset(
    "dr mr mrs ms prof st sr sra srta dra ing lic mme mlle m me no nr núm pág fig figs sec vol art abb abs bd tel "
    "approx ca env aprox vs cf eg ie etc bzw vgl usw evtl ggf inkl zzgl ltd inc corp co jr gen col sgt capt rev hon "
    "рис табл стр гл см ст ул им тыс млн млрд руб инж проф акад δρ κ κα σελ αρ δηλ πχ κλπ др г гг р п".split()
)
STRONG = "。｡؟।॥۔։።၊။៕！？"
_PLAIN = ".!?…"
_OPEN = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》", "‹": "›", "｢": "｣"}
_CLOSERS = "”“»)]」』）】〉》›｣\"’'"
_QUOTE = re.compile("[" + re.escape("".join(_OPEN) + "”»)]」』）】〉》›｣\"") + "]")
_MARK = re.compile(f"[{_PLAIN}]+|[{STRONG}]+|[;;]")
_THAI = re.compile(r"(?<=[ก-๎])\s+(?=[ก-๎])")
_AFTER = re.compile(f"[{re.escape(_CLOSERS)}]*")
_FRENCH = re.compile(r"\s+»")
_BLANK = re.compile(r"\s*")
_CAMEL = re.compile(r"[^\W\d_A-Z]{1,3}[A-Z]")
_BEFORE = re.compile(r"[^\s“”„«»()\[\]\"「」『』¿¡]*$")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_DANDA = re.compile("[।॥]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿" + INVISIBLE + "]")
_ODD = re.compile("[ﬀ-ﬆ！-｠]")
_UNSEEN = frozenset(c for c in map(chr, range(0x10000)) if _INVISIBLE.match(c))
_FIRST = re.compile(r"[\"“«„¿¡'(\[]*\s*([\w’'-]+)")
_FOLD = {ord(c): g[0] for g in LOOKALIKES for c in g[1:]}
#: Month names after a day's number with a full stop.
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner".split()
)
LONG = 7


def _key(token: str) -> str:
    """One spelling for a token however its letters are encoded."""
    return token if token.isascii() else unicodedata.normalize("NFKC", token).translate(_FOLD)


def _kind(text: str, i: int) -> str:
    """What stands at i: upper, lower, digit, opening mark, caseless letter, another mark, or the end."""
    if i >= len(text):
        return "$"
    c = text[i]
    if c.islower():
        return "U" if _CAMEL.match(text, i) else "l"
    if c.isupper() or c.istitle():
        return "U"
    if c.isdigit():
        return "d"
    if c in _OPEN or c in "\"'¿¡‘":
        return "o"
    return "c" if c.isalpha() else "x"


def _quotes(text: str) -> list[tuple[int, int]]:
    """Outermost spans from an opening mark to the closing mark that fits it."""
    spans: list[tuple[int, int]] = []
    inner: list[tuple[int, int]] = []  # outermost spans after the first mark that is still open
    stack: list[tuple[int, str]] = []
    fits: dict[str, list[int]] = {}  # by closing mark, the places in the stack that it closes
    for m in _QUOTE.finditer(text):
        i, c = m.start(), m[0]
        hit = fits[c][-1] if fits.get(c) else None
        opens = _OPEN.get(c) if hit is None else None
        if c == '"':
            before = text[i - 1] if i else " "
            if hit is None or (before.isspace() or before in "([«„“") and i + 1 < len(text) and not text[i + 1].isspace() and stack[hit][0] < i - 600:
                hit, opens = None, '"'
        if hit is not None:
            start = stack[hit][0]
            for _, marks in stack[hit:]:
                for x in marks:
                    fits[x].pop()
            del stack[hit:]
            if not stack or i - stack[0][0] > 1500:
                stack.clear()
                fits.clear()
                inner.clear()
                spans.append((start, i))
            else:
                while inner and inner[-1][0] > start:
                    inner.pop()
                inner.append((start, i))
        elif opens:
            for x in opens:
                fits.setdefault(x, []).append(len(stack))
            stack.append((i, opens))
    return spans + inner  # an opening mark that nothing closes hides no inner spans


class Splitter:
    """Finds sentence ends in a text: sure ones, and open ones that hang on a token and the word after it."""

    def split(self, raw: str):
        """(start, end, sure, open): ends and following starts; of open ones also the token, the kind of what follows, the next word."""
        text, at = raw, None
        if not raw.isascii():
            if _INVISIBLE.search(raw):
                at = [i for i, c in enumerate(raw) if c not in _UNSEEN]
                text = "".join(raw[i] for i in at)
            if _ODD.search(text):
                text = _ODD.sub(lambda m: (look_table().get(ord(m[0])) or m[0])[0], text)
        n = len(text)
        first = _BLANK.match(text).end()
        last = len(text.rstrip())
        if first >= last:
            return None
        sure: list[tuple[int, int]] = []
        maybe: list[tuple[int, int, str, str, str]] = []
        spans = _quotes(text) if _QUOTE.search(text) else []
        k, danda = 0, bool(_DANDA.search(text))
        done = 0
        for m in _MARK.finditer(text):
            i, j = m.start(), m.end()
            if i < done:
                continue
            while k < len(spans) and spans[k][1] < i:
                k += 1
            quoted = k < len(spans) and spans[k][0] < i
            if quoted:
                close = spans[k][1]
                if text[j:close].strip():
                    continue
                if m[0] == ";":
                    continue
                end = close + 1
                e2 = _AFTER.match(text, end).end()
                if not (e2 < n and e2 > end and text[e2 - 1] in '"“' and not text[end:e2].isspace() and text[e2].isalnum()):
                    end = e2
                if end < n and text[end] in _PLAIN + STRONG:
                    continue  # the mark after the quotation decides
            else:
                end = _AFTER.match(text, j).end() if j < n and text[j] in _CLOSERS else j
                if end > j and text[end - 1] in "“\"'’" and end < n and text[end].isalnum():
                    end = j
                    while end < n and text[end] in _CLOSERS and text[end] not in "“\"'’":
                        end += 1
                if end < n and text[end].isspace() and (f := _FRENCH.match(text, end)) and not any(a < f.end() - 1 <= b for a, b in spans):
                    end = f.end()
            nxt = end
            while nxt < n and text[nxt].isspace():
                nxt += 1
            kind = _kind(text, nxt)
            gap = nxt > end
            if kind == "$":
                done = n
                continue
            b = i - 1
            while b >= 0 and not text[b].isascii() and unicodedata.category(text[b])[0] == "M":
                b -= 1
            prev = text[b] if b >= 0 else " "
            mark = m[0]
            if mark in ";;":
                if _GREEK.search(text, max(0, i - 12), i) and kind in "Uocd":
                    sure.append((end, nxt))
                continue
            if quoted:
                if kind in "Uod" or kind == "c" and (prev.islower() or prev.isupper() or prev.isdigit() and mark[-1] == "."):
                    if not (mark == "." and text[spans[k][0]] in "([" and not gap):
                        sure.append((end, nxt))
                        done = end
                continue
            if mark[0] in STRONG:
                sure.append((end, nxt))
                continue
            if "!" in mark or "?" in mark:
                if kind in "Uc" or gap and kind in "do":
                    sure.append((end, nxt))
                elif kind == "o" and not prev.isspace():
                    sure.append((end, nxt))
                continue
            if kind in "lx":
                continue
            if mark != ".":  # a pause or an unfinished sentence
                if gap and (kind in "Udo" or kind == "c" and prev.islower()) or not gap and kind == "U":
                    sure.append((end, nxt))
                continue
            if not prev.isalnum():
                if gap or kind in "Uo":
                    sure.append((end, nxt))
                continue
            token = _BEFORE.search(text, max(0, i - 24), i)[0].lstrip("-–—'’‘,;:/")
            if not gap:
                if kind == "U" and len(token) > 1 and token[-2:].isalpha() and token[-1].islower() and "." not in token and nxt + 1 < n and not text[nxt + 1].isupper() and text[nxt + 1] not in "._":
                    sure.append((end, nxt))
                elif kind == "c" and prev.isalpha() and not prev.islower() and len(token) > 1 and not (0x900 <= ord(prev) < 0xE00):
                    sure.append((end, nxt))
                elif kind == "o" and len(token) > 1:
                    maybe.append((end, nxt, token, kind, self._word(text, nxt)))
                continue
            if 0x900 <= ord(prev) < 0xE00:
                if not danda and kind == "c" and len(token) > 3:
                    sure.append((end, nxt))
                continue
            if prev.isdigit():
                if kind in "do" or kind == "c":
                    if not (sure and sure[-1][1] == i - len(token) or first == i - len(token)):
                        sure.append((end, nxt))
                else:
                    maybe.append((end, nxt, "0", kind, self._word(text, nxt)))
                continue
            if not (prev.islower() or prev.isupper()):  # letters without case
                if len(token) > 1:
                    sure.append((end, nxt))
                continue
            if "." in token or len(token) <= LONG or token.lower() in KNOWN:
                if kind == "c":
                    if not (len(token) == 1 or token.lower() in KNOWN):
                        sure.append((end, nxt))
                    continue
                word = self._word(text, nxt)
                if len(word) == 1 and text[nxt + 1 : nxt + 2] == ".":  # an initial or the rest of a spaced abbreviation
                    if len(token) == 1 or "." in token:
                        continue
                    word = "#"
                maybe.append((end, nxt, token, kind, word))
            else:
                sure.append((end, nxt))
        for m in _THAI.finditer(text):
            if not any(a < m.start() < b for a, b in spans):
                sure.append((m.start(), m.end()))
        if at is not None:
            back = lambda e: at[e - 1] + 1 if e else 0
            sure = [(back(e), at[s]) for e, s in sure]
            maybe = [(back(e), at[s], *x) for e, s, *x in maybe]
            first, last = at[first], back(last)
        return first, last, sorted(set(sure)), maybe

    @staticmethod
    def _word(text: str, i: int) -> str:
        m = _FIRST.match(text, i)
        return _key(m[1]) if m else ""


class _Tokens:
    """What each distinct token between blanks says as the first and as the second of two neighbours."""

    def __init__(self, names: list[str]):
        n = len(names)
        self.keys: dict[str, int] = {}
        self.ends, self.begins = np.full(n, "", "U1"), np.full(n, "", "U1")
        self.core, self.long, self.name, self.bare, self.comma = (np.full(n, -1, np.int64) for _ in range(5))
        key = lambda t: self.keys.setdefault(_key(t), len(self.keys))
        for i, w in enumerate(names):
            if len(w) > 24:
                continue
            word = w.lstrip("\"“«„¿¡'([")
            c, z = word[:1], w[-1]
            up = c.isupper() or c.islower() and bool(_CAMEL.match(word))
            self.begins[i] = "U" if up else "l" if c.islower() else "d" if c.isdigit() else ""
            self.ends[i] = z if z in ".,!?" else "l" if z.islower() else ""
            if up and (t := w.strip("\"“«„¿¡'([.,;:!?)”»")):
                self.name[i] = key(t)
            if z == ".":
                core = w[:-1].lstrip("\"“«„¿¡'([-–—‘")
                if core and core[-1].isalnum() and not core[-1].isdigit() and (len(core) <= LONG or "." in core):
                    self.core[i] = key(core)
                elif len(core) > LONG:
                    self.long[i] = 1
            elif w[0].isalpha():
                if z in ",;:" and w[-2:-1] == ".":
                    self.comma[i] = key(w[:-2])
                elif (t := w.rstrip(",;:!?)”»\"")) and len(t) <= LONG + 8 and (t[0].islower() or t[0].isupper()):
                    self.bare[i] = key(t)


def _evidence(tokens: list[list[str]], docs: list[int | None]):
    """(token, doc or none, counts) of the tokens of a batch's chunks, then (tokens, doc, n) of tokens without a full stop.

    Counts are, after a full stop: a small letter or comma, a digit, a capital; without one; in capitals at a sure start;
    in capitals inside a sentence. The corpus has all; documents those of small letters and of capitals inside. How often
    a document has each token without a full stop, wherever its chunks stand, is said in binary places: its tokens are
    listed by n = 1, 2, 4 and so on, and a token's count is the sum of the n under which it is listed.
    """
    flat = [t for ts in tokens for t in ts]
    if not flat:
        return
    coded = pa.array(flat).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    t = _Tokens(coded.dictionary.to_pylist())
    if not t.keys:
        return
    chunk = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    a, b = ids[:-1], ids[1:]
    near = chunk[:-1] == chunk[1:]
    ends, begins, core = t.ends[a], t.begins[b], t.core[a]
    inside = ((ends == "l") | (ends == ",")) & (begins == "U") & (t.name[b] >= 0)
    slots = [
        (0, core, near & (core >= 0) & (begins == "l")), (1, core, near & (core >= 0) & (begins == "d")), (2, core, near & (core >= 0) & (begins == "U")),
        (4, t.name[b], near & (begins == "U") & (t.name[b] >= 0) & ((ends == "!") | (ends == "?") | (t.long[a] > 0))), (5, t.name[b], near & inside),
    ]
    keys = np.array(list(t.keys), object)
    counts = np.zeros((len(keys), 6), np.int64)
    for slot, key, mask in slots:
        counts[:, slot] += np.bincount(key[mask], minlength=len(keys))
    alone, comma = t.bare[ids], t.comma[ids]
    counts[:, 3] += np.bincount(alone[alone >= 0], minlength=len(keys))
    counts[:, 0] += np.bincount(comma[comma >= 0], minlength=len(keys))
    for i in np.flatnonzero(counts.any(1)):
        yield keys[i], None, counts[i].tolist()
    # the same by document
    named = sorted({d for d in docs if d is not None})
    at = {d: i for i, d in enumerate(named)}
    doc = np.array([at[d] if d is not None else -1 for d in docs], np.int64)[chunk]
    local = [(0, core, slots[0][2], doc[:-1]), (0, comma, comma >= 0, doc), (1, t.name[b], slots[4][2], doc[:-1])]
    code = np.concatenate([(d[m] * len(keys) + k[m]) * 2 + slot for slot, k, m, d in local])
    code, many = np.unique(code[code >= 0], return_counts=True)
    for x, n in zip(code.tolist(), many.tolist()):
        yield keys[x // 2 % len(keys)], named[x // 2 // len(keys)], [n if i == x % 2 else 0 for i in range(2)]
    code, many = np.unique((doc * len(keys) + alone)[(doc >= 0) & (alone >= 0)], return_counts=True)
    for p in range(int(many.max(initial=0)).bit_length()):
        some = code[many >> p & 1 == 1]
        cuts = np.flatnonzero(np.diff(some // len(keys), prepend=-1))
        for x in np.split(some, cuts[1:]) if len(some) else ():
            yield keys[x % len(keys)].tolist(), named[int(x[0]) // len(keys)], [1 << p]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    names = ["what", "id", "doc", "first", "last", "ends", "starts", "open", "token", "n", "bare"]
    split = Splitter().split
    for b in batches:
        rows: list[tuple] = []
        tokens, docs = [], []
        for doc, cid, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if cid is None or not text or (got := split(text)) is None:
                continue
            first, last, sure, maybe = got
            maybe = [(e, s, _key(t), k, w) for e, s, t, k, w in maybe]
            rows.append((0, cid, doc, first, last, [e for e, _ in sure], [s for _, s in sure], [{"e": e, "s": s, "token": t, "kind": k, "next": w} for e, s, t, k, w in maybe], None, None, None))
            tokens.append(text.split())
            docs.append(doc)
        for token, doc, n in _evidence(tokens, docs):
            bare = isinstance(token, list)
            rows.append((3 if bare else 1 if doc is None else 2, None, doc, None, None, None, None, None, None if bare else token, n, token if bare else None))
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        kinds = [pa.int8(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("e", pa.int32()), ("s", pa.int32()), ("token", pa.string()), ("kind", pa.string()), ("next", pa.string())])), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)


_SCHEMA = "what byte, id string, doc long, first int, last int, ends array<int>, starts array<int>, open array<struct<e:int,s:int,token:string,kind:string,next:string>>, token string, n array<bigint>, bare array<string>"
_SLOTS = ("low", "dig", "cap", "bare", "start", "mid")


def _sums(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(F.col("n")[i]).alias(prefix + s) for i, s in enumerate(_SLOTS)))


def sentences(chunks: DataFrame, doc: str = "doc_id", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, sent_start, sent_end) of every sentence: offsets in code points, the end exclusive, without outer blanks.

    Terminators follow the script before them; marks inside a quotation or bracket count only if the sentence ends with
    it. Full stops that may belong to an abbreviation, an initial or an ordinal are decided by evidence: whether the
    token takes a full stop in unambiguous places (a small letter, comma or digit after it) and whether the next word is
    a name (a capital inside sentences) or starts sentences elsewhere, first in the same document, else in the corpus.

    Each key counts once. Null, empty and blank texts and null keys have no rows. Null documents have corpus evidence
    only. Other columns are ignored. Text after the last mark is a sentence too. An empty table gives no rows.
    """
    scan = written(chunks.select(F.when(F.col(doc).isNotNull(), F.xxhash64(doc)).alias("d"), F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_scan, _SCHEMA))
    rows = scan.filter("what = 0").select("id", "first", "last", "ends", "starts").dropDuplicates(["id"])
    corpus = _sums(scan.filter("what = 1"), ["token"], "c_")
    local = scan.filter("what = 2").groupBy("doc", "token").agg(F.sum(F.col("n")[0]).alias("d_low"), F.sum(F.col("n")[1]).alias("d_mid"))
    asked = scan.filter("what = 0").select("id", "doc", F.explode("open").alias("o")).select("id", "doc", "o.*")
    # how often each document has its open tokens without a full stop: of one list at once, as most tokens are not asked for
    wanted = asked.filter("doc is not null").groupBy("doc").agg(F.collect_set("token").alias("t"))
    bare = scan.filter("what = 3").select("doc", "bare", F.col("n")[0].alias("n")).join(wanted, "doc")
    bare = bare.select("doc", F.explode(F.array_intersect("bare", "t")).alias("token"), "n").groupBy("doc", "token").agg(F.sum("n").alias("d_bare"))
    asked = asked.withColumn("case", F.xxhash64("doc", "token", "next", "kind"))
    types = asked.groupBy("token", "next").agg(F.count(F.lit(1)).alias("m"))
    # corpus evidence on the token and on the word after it
    c_next = corpus.select(F.col("token").alias("next"), *(F.col("c_" + s).alias("x_" + s) for s in ("start", "mid")))
    c_low = corpus.select(F.col("token").alias("small"), F.col("c_bare").alias("x_small"))
    words = types.select("next").distinct().withColumn("small", F.lower("next")).join(c_next, "next", "left").join(c_low, "small", "left").fillna(0, ["x_start", "x_mid", "x_small"])
    starter = (F.col("x_start") > 0) & (F.col("x_start") * 4 >= F.col("x_mid")) | (F.col("x_small") > F.col("x_mid") * 2) & (F.col("small") != F.col("next"))
    words = words.select("next", "x_mid", "x_small", starter.alias("starter"))
    enders = types.join(words, "next").groupBy("token").agg((F.sum(F.when(F.col("starter"), F.col("m")).otherwise(0)) / F.sum("m")).alias("ender"))
    tokens = enders.join(corpus, "token", "left").fillna(0, ["c_" + s for s in _SLOTS])
    known = F.lower("token").isin(*sorted(KNOWN))
    dotted = F.col("token").contains(".") | (F.length("token") == 1)
    shy = (F.col("c_bare") == 0) & (F.length("token") <= 5) & (F.upper(F.left("token", F.lit(1))) == F.left("token", F.lit(1))) & ~F.coalesce("starter", F.lit(False))
    d_low, d_bare = F.coalesce("d_low", F.lit(0)), F.coalesce("d_bare", F.lit(0))
    by_document = F.when((d_low > d_bare), True).when((d_low == 0) & (d_bare > 0) & (F.col("kind") != "d"), False)
    by_corpus = F.when((F.col("c_low") + F.col("c_dig") > 0.5 * F.col("c_cap")) | shy, True).when(F.col("c_bare") > 0, False)
    abbr = dotted | F.coalesce(by_document, by_corpus, known)
    numeric = F.col("c_dig") > F.greatest(F.col("c_cap"), F.col("c_low"))
    name = F.coalesce(F.col("d_mid") > 0, F.lit(False)) & ~(F.col("x_small") > 0) | (F.col("x_mid") > 0) & ~F.col("starter")
    fresh = F.col("starter") & ~name
    ends = (
        F.when(F.col("token") == "0", F.when(F.lower("next").isin(*sorted(MONTHS)), False).otherwise(fresh))
        .when(~abbr, True)
        .when(F.col("kind") == "d", ~numeric & (F.col("ender") > 0.3) & (F.length("token") > 1))
        .when(F.col("kind") == "o", F.col("ender") > 0.3)
        .otherwise(fresh & (F.col("ender") > 0.05))
    )
    cases = asked.select("case", "doc", "token", "next", "kind").dropDuplicates(["case"])
    d_next = local.select("doc", F.col("token").alias("next"), "d_mid")
    judged = (
        cases.join(tokens, "token").join(words, "next").join(local.select("doc", "token", "d_low"), ["doc", "token"], "left").join(bare, ["doc", "token"], "left").join(d_next, ["doc", "next"], "left")
        .filter(ends)
        .select("case")
    )
    won = asked.select("id", "e", "s", "case").join(judged, "case").groupBy("id").agg(F.collect_set(F.struct("e", "s")).alias("won"))
    cut = rows.join(won, "id", "left").select(
        "id", "first", "last",
        F.array_sort(F.concat(F.arrays_zip(F.col("ends").alias("e"), F.col("starts").alias("s")), F.coalesce("won", F.array().cast("array<struct<e:int,s:int>>")))).alias("cut"),
    )
    starts = F.concat(F.array("first"), F.col("cut.s"))
    stops = F.concat(F.col("cut.e"), F.array("last"))
    spans = cut.select("id", F.explode(F.arrays_zip(starts.alias("a"), stops.alias("b"))).alias("x"))
    return spans.select(F.col("id").alias(key), F.col("x.a").alias("sent_start"), F.col("x.b").alias("sent_end")).filter("sent_end > sent_start")
