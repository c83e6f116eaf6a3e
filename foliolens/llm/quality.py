"""Statistics of document texts, and what is not prose."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: First and last code points of scripts' letters.
SCRIPTS = {"ru": (0x400, 0x52F), "el": (0x370, 0x3FF), "ar": (0x600, 0x77F), "hi": (0x900, 0x97F), "th": (0xE00, 0xE7F), "ko": (0xAC00, 0xD7A3), "ja": (0x3040, 0x30FF), "zh": (0x3400, 0x9FFF)}
PACKED = ("th", "zh", "ja", "ko")  # scripts whose function words stand inside runs of letters
KINDS = ("prose", "list", "table", "junk")
#: The distributions of a block, each with its weight in the divergence.
CHARS = [*"abcdefghijklmnopqrstuvwxyz", "other letters", *SCRIPTS, "digits", "blanks", "sentence marks", "commas", "brackets and quotes", "symbols", "replaced", "torn"]
TOKENS = ["1", "2", "3 to 4", "5 to 8", "9 to 14", "15 to 24", "25 to 40", "longer", "number", "code", "pair of hexadecimal digits", "symbols"]
LINES = ["tabs", "bars", "semicolons", "gaps", "commas", "marked", "short", "long", "stopped"]
STOPS = ["under 16", "under 40", "under 90", "under 200", "under 500", "longer"]
AGAIN = ["new", "again after one distance"]
WORDS = ["function words of the main language", "of others", "other words"]
GROUPS = {"chars": 2.0, "words": 1.5, "tokens": 1.0, "lines": 1.5, "stops": 1.5, "again": 2.5, "letters": 1.0}
_AT = {c: i for i, c in enumerate(CHARS)}
_LETTERS = _AT["digits"]  # classes below are letters
_STOP, _WIDE_STOP, _CLOSER = ".!?…؟۔।", "。！？。", "\"”“»’)]」』'"
_MARKS = "-*•–—·▪◦‣o"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each character of the basic plane; others are symbols or other letters."""
    kind, lower = np.full(0x10000, _AT["symbols"], np.uint8), np.arange(0x10000, dtype=np.int64)
    for o in range(0x10000):
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat[0] in "LM":
            small = ch.lower()
            if len(small) == 1:
                lower[o] = ord(small)
            base = unicodedata.normalize("NFD", small)[0]
            kind[o] = _AT[base] if "a" <= base <= "z" else next((_AT[k] for k, (a, b) in SCRIPTS.items() if a <= o <= b), _AT["other letters"])
        elif cat == "Nd":
            kind[o] = _AT["digits"]
        elif ch.isspace():
            kind[o] = _AT["blanks"]
        elif 0x80 <= o < 0xA0 or cat == "Co" or o == 0xFFFD or 0x25A0 <= o <= 0x25AF:
            kind[o] = _AT["replaced"]
    for name, chars in (("sentence marks", _STOP + _WIDE_STOP), ("commas", ",，、،;；:："), ("brackets and quotes", "()[]{}\"'“”„«»‘’「」『』（）")):
        kind[[ord(c) for c in chars]] = _AT[name]
    return kind, lower


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, [ord(c) for c in chars])


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


class Listed:
    """Function words by language: hashes of those that stand between blanks, and code points of those inside runs."""

    def __init__(self, words: list[tuple[str, str]]):
        self.langs = sorted({a for a, _ in words})
        at = {a: i for i, a in enumerate(self.langs)}
        self.inside = [(at[a], np.array([*map(ord, w)])) for a, w in words if a in PACKED]
        alone: dict[int, list[int]] = {}
        for a, w in words:
            if a not in PACKED:
                alone.setdefault(int(_hash(np.array([*map(ord, w.lower())]), np.array([0]), len(w))[0]), []).append(at[a])
        self.hashes = np.array(sorted(alone), np.int64)
        self.share = np.zeros((len(alone), len(self.langs)), np.float32)
        for i, h in enumerate(self.hashes.tolist()):  # a word of several languages counts for each in part
            self.share[i, alone[h]] = 1 / len(alone[h])


_FACTORS = np.random.default_rng(1).integers(1, 1 << 40, 256) * 2 + 1


def _hash(codes: np.ndarray, starts: np.ndarray, ends) -> np.ndarray:
    """A 64-bit hash of each run of code points; what lies between runs must be 0 or belong to none."""
    ends = np.broadcast_to(ends, starts.shape)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) if len(starts) and starts[0] == 0 else None
    if place is None:
        place = np.arange(len(codes)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(codes)]])))
    inside = np.zeros(len(codes) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    x = np.where(np.cumsum(inside[:-1]) > 0, codes, 0) * _FACTORS[place & 255]
    return np.add.reduceat(x, starts) + (ends - starts) if len(starts) else np.zeros(0, np.int64)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks(texts: list[str], listed: Listed) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(text number, characters) of each block of some texts, and its counts by distribution.

    A block is a run of lines without a blank line that are all rows of cells, all marked entries, or all others. A line
    is a row of cells if it has as many separators of one kind as a neighbour.
    """
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    table, small = _tables()
    low = np.minimum(codes, 0xFFFF)
    cls, lower = table[low].copy(), np.where(codes < 0x10000, small[low], codes)
    for o in np.unique(codes[codes > 0xFFFF]):
        cls[codes == o] = _AT["other letters" if unicodedata.category(chr(o))[0] in "LM" else "symbols"]
    n = len(codes)
    after = np.append(codes[1:], 10)
    lead = (codes >= 0xC0) & (codes <= 0xEF) | np.isin(codes, (0xD0, 0xD1))
    torn = lead & ((after >= 0x80) & (after <= 0xBF) | _among(after, "ŒœŠšŸŽžƒˆ˜‚„†‡•‰‹›€™“”‘’–—…"))
    cls[torn | np.append(False, torn[:-1])] = _AT["torn"]
    blank = cls == _AT["blanks"]
    # lines without outer blanks
    cut = np.flatnonzero(codes == 10)
    a, e = np.append(0, cut + 1), np.append(cut, n)
    solid = _sums(~blank)
    full = np.flatnonzero(solid[e] > solid[a])
    at_solid = np.flatnonzero(~blank)
    first, last = at_solid[solid[a[full]]], at_solid[solid[e[full]] - 1] + 1
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
    size = last - first
    if not len(full):
        return owner, size, {"chars": np.zeros((0, len(CHARS))), "words": np.zeros((0, len(listed.langs) + 1)), "tokens": np.zeros((0, len(TOKENS))), "lines": np.zeros((0, len(LINES))), "stops": np.zeros((0, len(STOPS))), "again": np.zeros((0, 2))}
    # separators, marks at the start, stops
    tail = last - _among(codes[last - 1], ",;")
    gap = blank & (codes != 10) & np.append(True, ~blank[:-1]) & np.append(blank[1:] & (codes[1:] == 32), False)
    seps = np.stack([_sums(x)[tail] - _sums(x)[first] for x in (codes == 9, codes == 124, codes == 59, gap, codes == 44)])
    seps[1][seps[1] < 2] = 0
    sep = np.where(seps.any(0), (seps > 0).argmax(0), -1)
    cells = np.where(sep >= 0, np.take_along_axis(seps, np.maximum(sep, 0)[None], 0)[0], 0)
    empty = (sep[1:] == 3) & (np.abs(cells[1:] - cells[:-1]) <= 2)  # cells parted by blanks may be left out
    same = (owner[1:] == owner[:-1]) & (sep[1:] == sep[:-1]) & ((cells[1:] == cells[:-1]) | empty) & (full[1:] == full[:-1] + 1)
    beside = np.append(False, same) | np.append(same, False)
    twice = np.append(False, same) & np.append(same, False)
    rowlike = beside & (sep >= 0) & ((sep < 4) | (cells > 1) | twice | np.append(False, twice[:-1]) | np.append(twice[1:], False))
    t_start, t_end = _runs(~blank)
    head = np.searchsorted(t_start, first)
    h_len, h0, h1 = t_end[head] - t_start[head], codes[first], codes[t_end[head] - 1]
    digit = _sums(cls == _AT["digits"])
    letter = _sums(cls < _LETTERS)
    counted = (h_len <= 4) & _among(h1, ".)") & ((digit[t_end[head] - 1] - digit[first] == h_len - 1) & (h_len > 1) | (h_len == 2) & (cls[first] < _LETTERS))
    more = t_end[head] < last
    marked = more & ((h_len == 1) & _among(h0, _MARKS) | counted | (h0 == 91) & (h_len <= 3) | (h0 == 40) & (h1 == 41) & (h_len <= 5))
    ending = np.append(blank[1:] | _among(codes[1:], _CLOSER), True)
    stop = _among(codes, _STOP) & ending | _among(codes, _WIDE_STOP)
    thai = (codes >= 0xE00) & (codes < 0xE80)
    pause = blank & np.append(False, thai[:-1]) & np.append(thai[1:], False)  # what parts Thai sentences
    body = np.where(counted & marked, t_end[head], first)
    stops = _sums(stop)
    has_stop = (stops[last] > stops[body]) & ~((stops[last] - stops[body] == 1) & _number_sign(codes, stops, body))
    form = np.where(rowlike & ~((marked | has_stop) & (sep > 1)), sep, np.where(marked & ~has_stop, 5, np.where(has_stop, 8, np.where(size <= 60, 6, 7))))
    group = np.where(form < 5, 0, np.where(form == 5, 1, 2))
    new = np.append(True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1]) | (full[1:] != full[:-1] + 1))
    block = np.cumsum(new) - 1
    count = int(block[-1]) + 1
    weight = lambda b, k, width, w: np.bincount(b * width + k, weights=w, minlength=count * width).reshape(count, width)
    # characters, words, tokens
    starts = first[new]
    of = np.searchsorted(starts, np.arange(n), "right") - 1
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside[:-1]) > 0
    chars = weight(of[inside], cls[inside].astype(np.int64), len(CHARS), None)
    is_letter = cls < _LETTERS
    joins = _among(codes, "'’-") & np.append(False, is_letter[:-1]) & np.append(is_letter[1:], False)
    w_start, w_end = _runs(is_letter | joins)
    width = len(listed.langs) + 1
    words = np.zeros((count, width))
    if len(w_start) and len(listed.hashes):
        h = _hash(lower, w_start, w_end)
        k = np.minimum(np.searchsorted(listed.hashes, h), len(listed.hashes) - 1)
        known = listed.hashes[k] == h
        for lang in range(width - 1):
            own = known & (listed.share[k, lang] > 0)
            words[:, lang] += np.bincount(of[w_start[own]], weights=(w_end - w_start)[own] * listed.share[k[own], lang], minlength=count)
    for lang, w in listed.inside:
        near = np.flatnonzero(codes == w[0])
        for i in range(1, len(w)):
            near = near[near + i < n]
            near = near[codes[near + i] == w[i]]
        words += weight(of[near], np.full(len(near), lang), width, np.full(len(near), len(w)))
    words[:, -1] = np.maximum(chars[:, :_LETTERS].sum(1) - words[:, :-1].sum(1), 0)
    words[:, :-1] *= 3  # function words are short: by letters they would hardly show
    t_size = t_end - t_start
    digits, letters = digit[t_end] - digit[t_start], letter[t_end] - letter[t_start]
    hexa = _sums(np.isin(codes, np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)))
    shape = np.searchsorted((1, 2, 4, 8, 14, 24, 40), t_size)
    shape = np.where((t_size == 2) & (hexa[t_end] - hexa[t_start] == 2), 10, np.where((letters == 0) & (digits > 0), 8, np.where(letters + digits == 0, 11, np.where((digits > 0) & (t_size <= 14), 9, shape))))
    tokens = weight(of[t_start], shape, len(TOKENS), t_size)
    # lines, distances of stops, words that come again
    lines = weight(block, form, len(LINES), size)
    mark = np.flatnonzero((stop | pause) & inside)
    b_of = of[mark]
    b_end = np.append(last[np.flatnonzero(new)[1:] - 1], last[-1])
    place = np.concatenate([mark + 1, b_end])
    whose = np.concatenate([b_of, np.arange(count)])
    order = np.lexsort((place, whose))
    place, whose = place[order], whose[order]
    before = np.where(np.append(-1, whose[:-1]) == whose, np.append(0, place[:-1]), starts[whose])
    span = np.maximum(place - before, 0)
    spans = weight(whose, np.searchsorted((16, 40, 90, 200, 500), span, "right"), len(STOPS), span)
    again = weight(of[t_start], _again(_hash(codes, t_start, t_end), of[t_start]).astype(np.int64), 2, t_size)
    size_of = np.bincount(block, weights=size, minlength=count).astype(np.int64)
    return owner[new], size_of, {"chars": chars, "words": words, "tokens": tokens, "lines": lines, "stops": spans, "again": again}


def _number_sign(codes: np.ndarray, stops: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Whether the first stop after each place is that of 'no.' or 'nr.' before a number."""
    where = np.flatnonzero(np.diff(stops))
    if not len(where):
        return np.zeros(len(body), bool)
    i = where[np.minimum(stops[body], len(where) - 1)]
    c = lambda k: codes[np.clip(i + k, 0, len(codes) - 1)]
    digit = lambda x: (x >= 48) & (x <= 57)
    return _among(c(-1), "or") & _among(c(-2), "nN") & (digit(c(1)) | (c(1) == 32) & digit(c(2)))


def _again(token: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Tokens that repeat the one a fixed distance before: the distance that most tokens of the block have from their last occurrence."""
    n = len(token)
    out = np.zeros(n, bool)
    if not n:
        return out
    order = np.lexsort((np.arange(n), token, block))
    same = (token[order[1:]] == token[order[:-1]]) & (block[order[1:]] == block[order[:-1]])
    back = np.zeros(n, np.int64)
    back[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
    hit = np.flatnonzero(back)
    if len(hit):
        key = block[hit] * (n + 1) + back[hit]
        pairs, many = np.unique(key, return_counts=True)
        b = pairs // (n + 1)
        top = np.full(int(block.max()) + 1, 0, np.int64)
        best = np.lexsort((many, b))
        top[b[best]] = pairs[best] % (n + 1)  # the last, most frequent one of each block stays
        d = top[block]
        i = np.flatnonzero(d > 0)
        i = i[(i >= d[i]) & (d[i] > 0)]
        out[i] = (token[i] == token[i - d[i]]) & (block[i] == block[i - d[i]])
    return out


def _distributions(parts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the distributions of its form and that of its letters; all sum up to their shares of the weights."""
    chars, words = parts["chars"], parts["words"]
    top = words[:, :-1].max(1) if words.shape[1] > 1 else np.zeros(len(words))
    form = {
        "chars": np.hstack([chars[:, :_LETTERS].sum(1, keepdims=True), chars[:, _LETTERS:]]),
        "words": np.stack([top, words[:, :-1].sum(1) - top, words[:, -1]], 1),
        **{g: parts[g] for g in ("tokens", "lines", "stops", "again")},
    }
    whole = sum(GROUPS.values())
    scaled = lambda x, g: (x / np.maximum(x.sum(1, keepdims=True), 1e-9) * (GROUPS[g] / whole)).astype(np.float32)
    return np.hstack([scaled(x, g) for g, x in form.items()]), scaled(chars[:, :_LETTERS], "letters")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q, of whatever sum."""
    out = np.zeros((len(p), len(q)), np.float32)
    row, col = np.nonzero(p)
    if not len(row):
        return out + q.sum(1) / 2
    x = p[row, col][:, None]
    y = q[:, col].T
    m = (x + y) / 2
    # where p is 0, q's part is half of q; so only places with p count
    part = x * np.log2(x / m) + np.where(y > 0, y * np.log2(np.maximum(y, 1e-12) / m), 0) - y
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    out[row[starts]] = np.add.reduceat(part, starts, 0)
    return np.clip((out + q.sum(1)) / 2, 0, 1)


def _seeds(parts: dict[str, np.ndarray], size: np.ndarray, listed: Listed) -> np.ndarray:
    """A first profile name for each block whose counts are plain, '' for others; they only start the fit."""
    share = lambda g, *names: sum(parts[g][:, {"chars": _AT, "tokens": {t: i for i, t in enumerate(TOKENS)}, "lines": {t: i for i, t in enumerate(LINES)}}[g][n]] for n in names) / np.maximum(parts[g].sum(1), 1)
    common = parts["words"][:, :-1]
    lang = np.array(listed.langs, object)[common.argmax(1)] if listed.langs else np.full(len(size), "", object)
    scripts = np.stack([parts["chars"][:, _AT[k]] for k in SCRIPTS], 1)
    own = np.array(list(SCRIPTS), object)[scripts.argmax(1)]
    own[(own == "zh") & (parts["chars"][:, _AT["ja"]] > 0.1 * parts["chars"][:, _AT["zh"]])] = "ja"
    letters = parts["chars"][:, :_LETTERS].sum(1)
    lang = np.where(scripts.max(1) > 0.5 * letters, own, lang)
    solid = np.maximum(parts["chars"].sum(1) - parts["chars"][:, _AT["blanks"]], 1)
    rate = common.sum(1) / 3 / np.maximum(letters, 1)
    free = parts["stops"][:, -2:].sum(1) / np.maximum(parts["stops"].sum(1), 1)  # in long stretches without a stop
    cells = share("lines", *LINES[:5])
    packed = np.where(np.isin(lang, PACKED), " packed", "").astype(object)
    out = np.full(len(size), "", object)
    put = lambda mask, name: out.__setitem__(mask & (out == ""), name[mask & (out == "")] if isinstance(name, np.ndarray) else name)
    put(parts["chars"][:, _AT["replaced"]] > 0.25 * solid, "junk replaced")
    torn = parts["chars"][:, _AT["torn"]] > 0.25 * solid
    put(torn & (share("tokens", "longer") > 0.5), "junk torn packed")
    put(torn, "junk torn")
    put(share("tokens", "longer") * (parts["chars"][:, :26].sum(1) > 0.5 * solid) > 0.6, "junk encoded")
    put(share("tokens", TOKENS[10]) > 0.6, "junk hexadecimal")
    put((letters + parts["chars"][:, _AT["digits"]] < 0.4 * solid) & (cells < 0.5), "junk symbols")
    again = (parts["again"][:, 1] > 0.75 * parts["again"].sum(1)) & (size > 60)
    put(again & (share("lines", "short") > 0.5), "junk repeated lines")
    put(again & (share("lines", "stopped") > 0.5), "junk repeated sentences")
    put(again, "junk repeated")
    for name in LINES[:5]:
        put(share("lines", name) > 0.8, "table " + name)
    put(share("lines", "marked") > 0.8, "list marked")
    thai = lang == "th"
    put(thai & (parts["stops"][:, 0] > 0.6 * parts["stops"].sum(1)) & (share("lines", "short") > 0.9) & (size > 20), "list short")
    put(thai & (parts["stops"][:, 0] > 0.6 * parts["stops"].sum(1)) & (share("lines", "long") > 0.9), "junk words packed")
    put((share("lines", "short") > 0.99) & (size > 60) & (rate < 0.08) & ~thai, "list short")
    put((free > 0.9) & (size > 200) & (rate > 0.02) & (share("lines", "long") > 0.9), "junk words" + packed)
    put((free > 0.9) & (size > 200) & (rate <= 0.02) & (share("lines", "long") > 0.9), "junk keystrokes")
    put((free < 0.3) & (size > 80) & (share("lines", "stopped", "long", "short") > 0.9), np.array(["prose " + str(x) for x in lang], object))
    return out


#: Junk whose letters are of no language.
_OWN_LETTERS = ("junk encoded", "junk hexadecimal", "junk keystrokes", "junk replaced", "junk torn", "junk torn packed")


class Profiles:
    """Mean distributions of prose by language and of lists, tables and junk by form.

    A block's divergence from a profile is that of its form, and that of its letters from those of the profile's
    language; lists, tables and junk of words may be of any language, so for them the nearest one counts.
    """

    def __init__(self, names: list[str], rows: np.ndarray, letters: np.ndarray):
        self.names, self.rows, self.letters = names, rows, letters
        self.kinds = np.array([KINDS.index(k.split(" ")[0]) for k in self.names], np.int64)

    def joined(self, form: np.ndarray, letters: np.ndarray, size: np.ndarray, seeds: np.ndarray, least: int = 60) -> np.ndarray:
        """The profile that each block counts for: its own first name, else the nearest one's; short ones say too little."""
        names = seeds.copy()
        open_ = np.flatnonzero((seeds == "") & (size >= least))
        if len(open_) and self.names:
            names[open_] = np.array(self.names, object)[self.all(form[open_], letters[open_]).argmin(1)]
        return names

    def all(self, form: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Divergence of each block from each profile."""
        if len(form) > 4000:  # some thousand blocks at once bound the memory
            return np.vstack([self.all(form[i : i + 4000], letters[i : i + 4000]) for i in range(0, len(form), 4000)])
        own = divergence(letters, self.letters)
        spoken = np.array([k.startswith("prose") for k in self.names])
        free = np.array([k.startswith(("list", "table", "junk")) and k not in _OWN_LETTERS for k in self.names])
        if spoken.any():
            own[:, free] = own[:, spoken].min(1, keepdims=True)
        return divergence(form, self.rows) + own

    def far(self, form: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Least divergence of each block from the profiles of each kind; infinite where a kind has none."""
        out = np.full((len(form), len(KINDS)), np.inf, np.float32)
        if self.names:
            d = self.all(form, letters)
            for k in range(len(KINDS)):
                if (self.kinds == k).any():
                    out[:, k] = d[:, self.kinds == k].min(1)
        return out


#: What words, blanks, symbols and the ends of punctuated lines are, for the expressions on whole texts.
WORD = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"
NO_LETTER = r"[^\p{L}\p{M}]+"
BLANK = r"[\s\p{Z}\p{Cc}]+"
NOT_BLANK = r"[^\s\p{Z}\p{Cc}]"
NO_SYMBOL = r"[\p{L}\p{M}\p{N}\s\p{Z}\p{Cc}.,;:!?'\"()\[\]«»“”„‘’…。、，！？；：「」『』（）।۔؟،؛–—-]+"
LINE_END = r"[.!?…。！？।؟۔:;,][\"”»“’)\]」』]*\s*$"


def _words_of(common_words: DataFrame) -> list[tuple[str, str]]:
    """The list of function words, some tens a language."""
    return sorted({(r.lang, r.word) for r in common_words.select("lang", "word").collect() if r.lang and r.word})


def statistics(text: Column, listed: list[tuple[str, str]]) -> dict[str, Column]:
    """Expressions for a text's statistics: words; mean_word_length (letters a word); symbol_ratio (of non-blank
    characters); punctuated_lines (share of non-blank lines); common_words (share of letters in listed words, those of
    scripts without blanks wherever they stand)."""
    n = F.length(F.regexp_replace(text, NO_LETTER, ""))
    words = F.regexp_count(text, F.lit(WORD))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    alone = sorted({w.lower() for a, w in listed if a not in PACKED}) or [""]
    inside = sorted({w for a, w in listed if a in PACKED}, key=lambda w: (-len(w), w))
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: w.isin(alone))
    common = F.length(F.array_join(found, ""))
    if inside:
        common += F.length(F.array_join(F.regexp_extract_all(text, F.lit("|".join(inside)), F.lit(0)), ""))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    return {
        "words": words.cast("long"), "mean_word_length": share(n, words),
        "symbol_ratio": share(F.length(F.regexp_replace(text, NO_SYMBOL, "")), F.length(F.regexp_replace(text, BLANK, ""))),
        "punctuated_lines": share(F.size(F.filter(lines, lambda x: x.rlike(LINE_END))), F.size(lines)), "common_words": F.least(F.lit(1.0), share(common, n)),
    }


def text_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key and the columns of `statistics`) of each text, by built-in expressions; null, empty and blank texts and null keys have no rows."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).rlike(NOT_BLANK))
    return rows.select(key, *(c.alias(a) for a, c in statistics(F.col(text), _words_of(common_words)).items()))


#: Places of the distributions of a block's form; those of its letters follow.
_FORM = len(CHARS) - _LETTERS + 1 + len(WORDS) + len(TOKENS) + len(LINES) + len(STOPS) + len(AGAIN)
_FAR = [f"{k}_divergence" for k in KINDS]


def _pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, each with the number of its first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def _vectors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, size, first name and distributions of the blocks of a batch of `_cut`."""
    n = b.column("size").value_lengths().to_numpy()
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32)
    names = np.array(b.column("seed").flatten().to_pylist(), object)
    return np.repeat(np.arange(b.num_rows), n), b.column("size").flatten().to_numpy(), names, x.reshape(int(n.sum()), -1)


def _cut(docs: DataFrame, listed: Listed, key: str, text: str, extra: dict[str, Column]) -> DataFrame:
    """Each document's key (k_) and extra columns, with size, first name and distributions of its blocks, written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in _pieces(b.column(1).to_pylist()):
                owner, size, parts = blocks(some, listed)
                form, letters = _distributions(parts)
                x = np.ascontiguousarray(np.hstack([form, letters]), np.float32)
                ends = np.searchsorted(owner, np.arange(len(some) + 1)).astype(np.int32)
                own = b.slice(at, len(some))
                lists = lambda v, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(v, t))  # noqa: B023, E731
                bytes_ = pa.array([x[i:e].tobytes() for i, e in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[2:], lists(size, pa.int64()), lists(_seeds(parts, size, listed), pa.string()), bytes_], [b.schema.names[0], *b.schema.names[2:], "size", "seed", "x"])

    out = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_"), *(c.alias(a) for a, c in extra.items()))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "t_"]
    return written(out.mapInArrow(run, ", ".join([*kinds, "size array<long>", "seed array<string>", "x binary"])))


def _means(cut: DataFrame, wide: int, before: Profiles | None, least: int = 2) -> Profiles:
    """Profiles of all blocks: means by the blocks' first names or, given profiles, by those that they join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            _, size, names, x = _vectors(b)
            if before is not None:
                names = before.joined(x[:, :wide], x[:, wide:], size, names)
            order = np.argsort(names.astype(str), kind="stable")
            order = order[names[order] != ""]
            if not len(order):
                continue
            w = np.minimum(size[order], 2000).astype(np.float64)[:, None]
            kinds, first = np.unique(names[order].astype(str), return_index=True)
            sums = np.add.reduceat(np.hstack([np.ones_like(w), w, x[order] * w]), first, 0)
            for k, s in zip(kinds.tolist(), sums):
                total[k] = total[k] + s if k in total else s
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], ["name", "s"])

    columns = 2 + wide + _LETTERS
    got = cut.select("size", "seed", "x").mapInArrow(run, "name string, s array<double>").groupBy("name").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(columns))).alias("s")).collect()  # a row a profile
    kept = sorted((r.name, r.s) for r in got if r.s[0] >= least)
    mean = np.array([s for _, s in kept]).reshape(len(kept), columns)
    mean = (mean[:, 2:] / np.maximum(mean[:, 1:2], 1)).astype(np.float32)
    return Profiles([k for k, _ in kept], mean[:, :wide], mean[:, wide:])


def _judged(docs: DataFrame, common_words: DataFrame, key: str, text: str, sample_docs: int | None, extra: dict[str, Column] | None = None) -> DataFrame:
    words = _words_of(common_words)
    extra = statistics(F.col(text), words) if extra is None else extra
    cut = _cut(docs.filter(F.col(key).isNotNull() & F.col(text).rlike(NOT_BLANK)), Listed(words), key, text, extra)
    own = cut
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(1, cut.count()))
        own = cut.filter(F.pmod(F.xxhash64("k_", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    wide = _FORM
    profiles = _means(own, wide, _means(own, wide, None))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far, total, sizes = np.zeros((b.num_rows, len(KINDS))), np.zeros(b.num_rows), np.zeros((b.num_rows, len(KINDS)), np.int64)
            owner, size, _, x = _vectors(b)
            d = profiles.far(x[:, :wide], x[:, wide:])
            np.add.at(sizes, (owner, d.argmin(1)), size)
            np.add.at(far, owner, d * size[:, None])
            np.add.at(total, owner, size)
            kind = np.where(2 * sizes.max(1) > total, sizes.argmax(1), 0)
            far /= np.maximum(total, 1)[:, None]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *(pa.array(np.where(np.isfinite(x), x, np.nan), mask=~np.isfinite(x)) for x in far.T), pa.array(np.array(KINDS, object)[kind], pa.string())], [*b.schema.names[:-3], *_FAR, "kind"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema[:-3]]
    return cut.mapInArrow(run, ", ".join([*kinds, *(f"{c} double" for c in _FAR), "kind string"])).withColumnRenamed("k_", key)


def text_quality(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int | None = None) -> DataFrame:
    """Statistics of each document's text, its divergences from the kinds of text, and its kind: prose, list, table or junk.

    Columns: key, those of `statistics`, prose_divergence, list_divergence, table_divergence, junk_divergence (least
    Jensen-Shannon divergence of its blocks from a profile of that kind, weighted by length; null if no profile of it was
    found), kind.

    Each block of lines has distributions over classes of characters, letters, function words, shapes of tokens, layout of
    lines, distances between stops, and words that come again. Profiles of each language's prose and of forms of lists,
    tables and junk are mean distributions over all documents (over about `sample_docs` if given): blocks whose counts
    are plain start them, the others join the nearest. The blocks are cut once and written. Every block of every document then takes the kind of the profile from
    which it diverges least. A document's kind is what makes up more than half of its characters, else prose.

    Null, empty and blank texts and null keys have no rows; repeated rows stay. Null words or languages in common_words
    are ignored. Other columns are ignored. An empty table gives no rows.
    """
    return _judged(docs, common_words, key, text, sample_docs)


def not_prose(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int | None = None) -> DataFrame:
    """(key, kind) of the documents that are no prose; each key once. As text_quality otherwise."""
    return _judged(docs, common_words, key, text, sample_docs, {}).filter("kind <> 'prose'").select(key, "kind").dropDuplicates([key])
