"""Passages of evaluation items inside training documents, found with an FM-index for each shard of documents."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PACKED = re.compile("([฀-๿぀-ヿ㐀-鿿])")
_ACCENT = np.array([bool(unicodedata.combining(chr(o))) for o in range(0x20000)] + [False] * 0xF0000)
_IN_WORD = np.array([chr(o).isalnum() for o in range(0x110000)])
_LOWER = bytes(ord(chr(o).lower()) if o < 128 and chr(o).isalnum() else 32 for o in range(256))
OTHER = 1  # any word that no passage has, and the border between documents


def normal_words(text: str) -> list[str]:
    """Words without case, accents and punctuation; letters of scripts without spaces count as words."""
    if text.isascii():
        return text.encode().translate(_LOWER).decode().split()
    codes = np.frombuffer(unicodedata.normalize("NFKD", text.casefold()).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes[~_ACCENT[codes]]
    text = np.where(_IN_WORD[codes], codes, np.uint32(32)).tobytes().decode("utf-32-le")
    if _PACKED.search(text):
        text = _PACKED.sub(r" \1 ", text)
    return text.split()


class FMIndex:
    """Full-text index of a sequence of small integers > 0: counts and places of patterns by backward search."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        text = np.append(seq, 0).astype(np.int64)
        self.n, self.sample = len(text), sample
        sa = self._suffixes(text, symbols)
        bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]).astype(np.int64)
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):  # the wavelet matrix: at each level zeros go first, in their order
            bit = (level >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        kept = sa % sample == 0
        self.kept = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = sa[kept].astype(np.int32)

    def parts(self) -> dict[str, bytes]:
        """The index as bytes: counts of symbols, packed bits of each wavelet level, transform, sampled positions."""
        return {
            "first": self.first.tobytes(), "bwt": self.bwt.astype(np.int32).tobytes(), "places": self.places.tobytes(),
            "levels": b"".join(np.packbits(np.diff(x).astype(np.uint8)).tobytes() for x in self.ones), "kept": np.packbits(np.diff(self.kept).astype(np.uint8)).tobytes(),
        }

    @classmethod
    def of(cls, parts: dict[str, bytes], sample: int = 8) -> FMIndex:
        """The index of parts(); ranks are summed up anew from the bits."""
        self = cls.__new__(cls)
        self.bwt = np.frombuffer(parts["bwt"], np.int32).astype(np.int64)
        self.n, self.sample = len(self.bwt), sample
        self.first, self.places = np.frombuffer(parts["first"], np.int64), np.frombuffer(parts["places"], np.int32)
        self.bits = max(1, (len(self.first) - 2).bit_length())
        packed = np.frombuffer(parts["levels"], np.uint8).reshape(self.bits, -1)
        sums = lambda x: np.concatenate([[0], np.cumsum(np.unpackbits(x, count=self.n), dtype=np.int32)]).astype(np.int32)
        self.ones, self.kept = [sums(x) for x in packed], sums(np.frombuffer(parts["kept"], np.uint8))
        self.zeros = [self.n - int(x[-1]) for x in self.ones]
        return self

    @staticmethod
    def _suffixes(text: np.ndarray, symbols: int) -> np.ndarray:
        """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
        n = len(text)
        width = max(1, int(symbols).bit_length())
        span = max(1, 62 // width)
        key = np.zeros(n, np.int64)
        for k in range(span):
            key <<= width
            if k < n:
                key[: n - k] |= text[k:]
        order = np.argsort(key, kind="stable")
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        group = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        rank[order] = group
        h = span
        while True:
            tied = np.flatnonzero(~change | np.append(~change[1:], False))  # slots of groups with more than one suffix
            if not len(tied):
                return order
            at = order[tied]
            nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + nxt
            by = np.argsort(key, kind="stable")
            order[tied] = at[by]
            key = key[by]
            fresh = np.empty(len(key), bool)
            fresh[0] = True
            fresh[1:] = key[1:] != key[:-1]
            change[tied] = fresh
            rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
            h *= 2

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each c stands in the transform before each place."""
        lo = np.zeros_like(at)
        hi = at
        for k in range(self.bits):
            bit = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of patterns."""
        c = patterns[:, -1]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(lo < hi)
            c = patterns[live, k]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffix slots: steps back in the text until a sampled one."""
        out = np.full(len(slots), -1, np.int64)
        todo, slot, steps = np.arange(len(slots)), slots.copy(), 0
        while len(todo):
            hit = self.kept[slot + 1] > self.kept[slot]
            out[todo[hit]] = self.places[self.kept[slot[hit]]] + steps
            todo, slot = todo[~hit], slot[~hit]
            if len(todo):
                c = self.bwt[slot]
                slot = self.first[c] + self.rank(c, slot)
                steps += 1
        return out


class Passages:
    """Test passages as word numbers, their phrases, and the least counts of shared phrases that a case must have."""

    def __init__(self, items: list[tuple[int, str]], phrase: int, share: float, errors: float, vocabulary: dict[str, int] | None = None):
        self.share, self.errors = share, errors
        words = [(i, w) for i, p in items if (w := normal_words(p or ""))]
        self.vocabulary = vocabulary or numbered(x for _, w in words for x in w)
        self.symbols = len(self.vocabulary) + 2
        if missing := next((x for _, w in words for x in w if x not in self.vocabulary), None):
            raise ValueError(f"the index has no number for the word {missing!r}")
        self.ids = np.array([i for i, _ in words], np.int64)
        self.codes = [np.array([self.vocabulary[x] for x in w], np.int32) for _, w in words]
        by: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        self.need, self.slack = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k, c in enumerate(self.codes):
            m = len(c)
            n = np.arange(self.least(k), m + 1)
            wrong = np.floor(n * errors).astype(np.int64)
            # n words with so many errors keep a piece of this length whole
            q = int(min(phrase, (-(-(n - wrong) // (wrong + 1))).min()))
            self.need[k], self.slack[k] = max(1, int((n - q + 1 - q * wrong).min())), int(m * errors) + 1
            for p in range(m - q + 1):
                by.setdefault(q, {}).setdefault(tuple(c[p : p + q].tolist()), []).append((k, p))
        self.patterns = [np.array(list(g), np.int64).reshape(-1, q) for q, g in by.items()]
        postings = [x for g in by.values() for x in g.values()]
        self.posts = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)

    def least(self, k: int) -> int:
        """The least number of passage k's words that a case repeats."""
        return max(1, math.ceil(len(self.codes[k]) * self.share))

    def stretch(self, k: int, words: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
        """First and last word, exclusive, of the longest stretch that repeats enough of passage k within the errors allowed.

        Its first and last words are the passage's. Exact edit distances, by dynamic programming over all starts in the passage at once, between the diagonals `low`
        and `high` (place in `words` less place in the passage).
        """
        own, least = self.codes[k], self.least(k)
        m, wide = len(own), high - low + 1
        grid = np.arange(m)[:, None] + np.arange(low, high + 1)
        inside = (grid >= 0) & (grid < len(words))
        differs = (~inside | (words[np.clip(grid, 0, max(0, len(words) - 1))] != own[:, None])).astype(np.int32)
        ramp = np.arange(wide, dtype=np.int32)
        far, most = 1 << 20, int(m * self.errors)
        # the longest stretch begins where a run of equal words does
        begins = (differs == 0) & (np.vstack([np.ones((1, wide), np.int32), differs[:-1]]) > 0)
        begins[m - least + 1 :] = False
        start, dist = np.zeros(0, np.int64), np.zeros((0, wide + 1), np.int32)
        best = None
        for j in range(m):
            if begins[j].any():
                start, dist = np.append(start, j), np.vstack([dist, np.append(np.where(begins[j], 0, far), far)[None, :]])
            if not len(start):
                continue
            step = np.minimum(dist[:, :wide] + differs[j], dist[:, 1:] + 1)
            dist[:, :wide] = np.minimum.accumulate(step - ramp, axis=1) + ramp
            if j + 1 >= least:
                n = j + 1 - start
                ends = np.where(differs[j] == 0, dist[:, :wide], far)
                good = np.flatnonzero((ends.min(1) <= np.floor(n * self.errors)) & (n >= least))
                if len(good) and (best is None or n[good[0]] > best[0]):
                    i = int(good[0])
                    best = int(n[i]), int(start[i]), j, int(ends[i].argmin())
            if j % 8 == 7:  # distances only grow
                live = dist[:, :wide].min(1) <= most
                start, dist = start[live], dist[live]
        if best is None:
            return None
        _, i, j, g = best
        back = np.full(wide + 1, 1 << 20, np.int32)  # the same from the end, for the first word
        back[1 + g] = 0
        for p in range(j, i - 1, -1):
            step = np.minimum(back[1:] + differs[p], back[:-1] + 1)
            back[1:] = (np.minimum.accumulate((step + ramp)[::-1])[::-1]) - ramp
        return i + low + int(np.where(differs[i] == 0, back[1:], 1 << 21).argmin()), j + 1 + low + g


def numbered(words: Iterable[str]) -> dict[str, int]:
    """Numbers of the words that an index tells apart; 1 stands for all others."""
    out: dict[str, int] = {}
    for w in words:
        out.setdefault(w, len(out) + 2)
    return out


_PARTS = ["ids", "seq", "places_of", "starts", "first", "bwt", "places", "levels", "kept"]


def _sequence(docs: list[list[str]], code: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of documents one after the other, a run of other words as one; the place of each in its document; where documents begin."""
    get = code.get
    seqs, wheres, starts = [], [], [0]
    for words in docs:
        s = np.fromiter(map(get, words, repeat(OTHER)), np.int32, len(words))
        at = np.flatnonzero(np.append(True, (s[1:] != OTHER) | (s[:-1] != OTHER)))
        seqs += [s[at], [OTHER]]
        wheres += [at, [len(words)]]
        starts.append(starts[-1] + len(at) + 1)
    return np.concatenate(seqs).astype(np.int32), np.concatenate(wheres).astype(np.int32), np.array(starts, np.int64)


def build_shards(docs: DataFrame, vocabulary: dict[str, int], key: str = "doc_id", text: str = "text", shard_words: int = 400_000) -> DataFrame:
    """FM-indexes of shards of documents, a row each: about `shard_words` words of whole documents of one partition.

    `vocabulary` numbers the words that searches will use (see `numbered`); others count as one. The table may be written
    and searched again, by `search_shards`, with any passages of these words. Documents with equal text are indexed once
    in a shard. Null keys, null texts and texts without words are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[str, list[int]] = {}
        lists: list[list[str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            seq, where, starts = _sequence(lists, vocabulary)
            row = {"ids": [i for i in same.values() if i], "seq": seq.tobytes(), "places_of": where.tobytes(), "starts": starts.tobytes(), **FMIndex(seq, len(vocabulary) + 1).parts()}
            same.clear(), lists.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[c]], pa.list_(pa.list_(pa.int64())) if c == "ids" else pa.binary()) for c in _PARTS], _PARTS)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not t:
                    continue
                if t in same:
                    same[t].append(i)
                elif words := normal_words(t):
                    same[t] = [i]
                    lists.append(words)
                    size += len(words)
                    if size >= shard_words:
                        yield flush()
                        size = 0
        if lists:
            yield flush()

    schema = ", ".join(f"{c} {'array<array<long>>' if c == 'ids' else 'binary'}" for c in _PARTS)
    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, schema)


def _shard(p: Passages, index: FMIndex, seq: np.ndarray, where: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, document, first word, end word) of the cases in one shard."""
    found = [index.search(x) for x in p.patterns]
    lo, n = np.concatenate([a for a, _ in found]), np.concatenate([b - a for a, b in found])
    total = int(n.sum())
    if not total:
        return
    gram = np.repeat(np.arange(len(n)), n)
    place = index.locate(np.arange(total) - np.repeat(np.cumsum(n) - n, n) + lo[gram])
    doc, pos = np.searchsorted(starts, place, "right") - 1, where[place].astype(np.int64)
    # phrases of each passage that a document has at all, against the least number; only pairs that occur are held
    pair = np.unique(doc * len(n) + gram)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(pair, max(1, len(pair) // 50_000)):
        _, post, d = _expand(p, part % len(n), part // len(n))
        keys = np.concatenate([keys, d * len(p.ids) + p.posts[post, 0]])
        keys, own = np.unique(keys, return_inverse=True)
        counts = np.bincount(own, weights=np.append(counts, np.ones(len(own) - len(counts))), minlength=len(keys)).astype(np.int64)
    keys = keys[counts >= p.need[keys % len(p.ids)]]
    some = np.isin(doc, keys // len(p.ids))
    hit, post, d = _expand(p, gram[some], doc[some])
    k, off = p.posts[post, 0], p.posts[post, 1]
    ok = np.isin(d * len(p.ids) + k, keys)
    hit, d, k, off = hit[ok], d[ok], k[ok], off[ok]
    shift = pos[some][hit] - off
    # enough phrases of the passage on neighbouring diagonals
    order = np.lexsort((shift, k, d))
    d, k, off, shift = d[order], k[order], off[order], shift[order]
    key = d * len(p.ids) + k
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(key))):
        item, sh = int(k[a]), shift[a:b]
        slack, need = int(p.slack[item]), int(p.need[item])
        far = np.searchsorted(sh, sh + slack, "right")
        words, done = None, None
        for i in np.flatnonzero(far - np.arange(len(sh)) >= need):
            if done is not None and sh[i] <= done or len(np.unique(off[a + i : a + int(far[i])])) < need:
                continue
            if words is None:
                s, e = starts[d[a]], starts[d[a] + 1] - 1
                words = np.full(int(where[e]), OTHER, np.int32)
                words[where[s:e]] = seq[s:e]
            # a stretch drifts over `slack` diagonals at most, so one look covers those next to it as well
            found = p.stretch(item, words, int(sh[i]) - slack, int(sh[far[i] - 1]) + slack)
            if found:
                yield int(p.ids[item]), int(d[a]), *found
            done = int(sh[i]) + slack


def _expand(p: Passages, gram: np.ndarray, doc: np.ndarray):
    n = p.offsets[gram + 1] - p.offsets[gram]
    row = np.repeat(np.arange(len(gram)), n)
    post = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + p.offsets[gram][row]
    return row, post, doc[row]


def search_shards(shards: DataFrame, passages: Passages) -> DataFrame:
    """(item_id, doc_id, first_word, end_word) of the cases in the shards of `build_shards`, for passages of its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist() if len(passages.ids) else ():
                seq, where, starts = (np.frombuffer(r[c], t) for c, t in (("seq", np.int32), ("places_of", np.int32), ("starts", np.int64)))
                for it, d, first, end in _shard(passages, FMIndex.of(r), seq, where, starts):
                    rows += [(it, i, first, end) for i in r["ids"][d]]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["item_id", "doc_id", "first_word", "end_word"])

    return shards.mapInArrow(run, "item_id long, doc_id long, first_word long, end_word long")


def leaked_stretches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", phrase: int = 5, share: float = 0.5, errors: float = 0.125, shard_words: int = 400_000, pass_chars: int = 16_000_000) -> DataFrame:
    """(item_id, doc_id, first_word, end_word): stretches of documents that repeat at least `share` of a passage's words.

    Each shard of documents (some hundred thousand words, whole documents) is indexed by itself: the sequence of its
    words as numbers, words that no passage has as one number, gets a suffix array, a wavelet matrix of its
    Burrows-Wheeler transform and sampled suffix positions. All phrases of `phrase` words of all passages (fewer in short
    passages) are searched backward in it. By the q-gram lemma, a stretch with at most `errors` of its words changed,
    dropped or added keeps a least number of the passage's phrases on neighbouring diagonals; where they are found,
    exact edit distances decide. Documents never leave their task, only cases do.

    The items go to every task, at most `pass_chars` characters of passages at once: a larger set is cut by a hash of the
    item into that many passes over the documents. Documents with equal text are indexed once in a shard and all
    returned. Null, empty and blank texts and null keys have no rows, passages without words none either. Repeated rows
    give their rows once. Other columns are ignored. An empty table gives no rows.
    """
    asked = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).filter("i is not null and length(p) > 0").distinct()
    passes = max(1, -(-(asked.agg(F.sum(F.length("p"))).first()[0] or 0) // pass_chars))
    out = None
    for n in range(passes):
        rows = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == n)
        p = Passages(sorted((r.i, r.p) for r in rows.collect()), phrase, share, errors)  # bounded by pass_chars
        found = search_shards(build_shards(docs, p.vocabulary, key, text, shard_words), p)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(item_id, doc_id) of the documents that repeat an item's passage. As leaked_stretches."""
    return leaked_stretches(docs, items, **options).select("item_id", "doc_id").distinct()


def removal_spans(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, first_word, end_word): what to cut from each document, overlapping and touching stretches merged."""
    rows = leaked_stretches(docs, items, **options).select("doc_id", "first_word", "end_word").distinct()
    w = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("fresh", F.when(reach >= F.col("first_word"), 0).otherwise(1))
    marked = marked.withColumn("part", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "part").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")).drop("part")
