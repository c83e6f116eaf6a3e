"""One consistent form of texts that look the same."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import LOOKALIKES, usual
from .store import written

_CLASS = {c: group for group in LOOKALIKES for c in group}
#: A token: a run of Latin, Greek or Cyrillic letters with their accents.
_LETTER = "A-Za-zªºÀ-ÖØ-öø-ʯ̀-ϿЀ-ԯḀ-῿"
_TOKEN = re.compile(f"[{_LETTER}]+")
_ALIKE = "".join(g[0] for g in LOOKALIKES)
_ASCII_ALIKE = re.compile(f"(?<![A-Za-z])[{_ALIKE}]+(?![A-Za-z])")
_RAGGED = re.compile(r"[ ]+(?=\n|\Z)")
START, END = "^", "$"


def _script(ch: str) -> str:
    o = ord(ch)
    return "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "C" if 0x400 <= o < 0x530 else "L"


def _units(token: str) -> list[tuple[str, str]]:
    """Base letters with the accents on them."""
    out: list[tuple[str, str]] = []
    for ch in unicodedata.normalize("NFD", token):
        if unicodedata.combining(ch) and out:
            out[-1] = (out[-1][0], out[-1][1] + ch)
        else:
            out.append((ch, ""))
    return out


def letter_pairs(df: DataFrame, text: str) -> DataFrame:
    """Counts (a, b, n) of neighbouring letters in tokens of one script, over all texts.

    Each task counts its batch's tokens and sends only letter pairs: at most the square of the alphabets' sizes.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        total: Counter = Counter()
        for b in batches:
            tokens: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    tokens.update(_TOKEN.findall(t))
            for token, n in tokens.items():
                bases = [x for x, _ in _units(token)]
                if len(bases) > 1 and len({_script(x) for x in bases}) == 1:
                    for a, c in zip([START, *bases], [*bases, END]):
                        total[a, c] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], ["a", "b", "n"])

    return df.select(text).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi search of the best spelling of a token among its look-alikes.

    A path's score is the sum of smoothed log probabilities of letter pairs; a step between scripts costs `switch`. The
    lattice depends on the look of the token alone, so equal-looking tokens get one spelling.
    """

    def __init__(self, pairs: dict[tuple[str, str], int], switch: float = 25.0):
        self.pairs, self.switch, self.memo = pairs, switch, {}
        self.out = Counter()
        for (a, _), n in pairs.items():
            self.out[a] += n

    def _step(self, a: str, b: str) -> float:
        s = math.log((self.pairs.get((a, b), 0) + 0.1) / (self.out.get(a, 0) + 30.0))
        return s - self.switch if START != a and END != b and _script(a) != _script(b) else s

    def token(self, token: str) -> str:
        hit = self.memo.get(token)
        if hit is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            hit = self.memo[token] = self._decode(token)
        return hit

    def _decode(self, token: str) -> str:
        units = _units(token)
        paths = {START: (0.0, "")}
        for base, _ in units:
            step = {}
            for ch in _CLASS.get(base, base):
                step[ch] = max(((s + self._step(a, ch), p + ch) for a, (s, p) in paths.items()), key=lambda x: x[0])
            paths = step
        best = max(((s + self._step(a, END), p) for a, (s, p) in paths.items()), key=lambda x: x[0])[1]
        return unicodedata.normalize("NFC", "".join(c + m for c, (_, m) in zip(best, units)))

    def form(self, text: str) -> str:
        """The consistent form of a text, without blanks at line ends and around it."""
        text = usual(text)
        f = lambda m: self.token(m[0])
        text = _ASCII_ALIKE.sub(f, text) if text.isascii() else _TOKEN.sub(f, text)
        return _RAGGED.sub("", text).strip()


def _model(df: DataFrame, text: str) -> dict[tuple[str, str], int]:
    """Letter pairs on the driver: bounded by the alphabets, not by the data."""
    return {(r.a, r.b): r.n for r in letter_pairs(df, text).collect()}


def consistent_text(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """The table with a column of each text's consistent form.

    Compatibility normalisation to the usual form, deletion of ignorable characters, then a Viterbi search of each token's look-alike
    lattice under letter-pair scores counted over all texts of the table. Null gives null; blank gives ''. Rows stay as
    they are, repeated ones too, and other columns keep their names; a column named `out` is replaced.
    """
    pairs = _model(df, text)
    at = df.columns.index(text)
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterable[pa.RecordBatch]):
        decoder = Decoder(pairs)
        for b in batches:
            forms = pa.array([None if t is None else decoder.form(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), forms], [*kept, out])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(df.schema[c] for c in kept), StructField(out, StringType())])
    return df.mapInArrow(run, schema)


def look_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, raw) of each non-blank text: 128-bit digests of its consistent form and of itself; each key once."""
    pairs = _model(df, text)

    def run(batches: Iterable[pa.RecordBatch]):
        decoder = Decoder(pairs)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            ids, look, raw = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None and t and (f := decoder.form(t)):
                    ids.append(i), look.append(digest(f)), raw.append(digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], ["key", "look", "raw"])

    return df.select(F.col(key).cast("string"), text).mapInArrow(run, "key string, look binary, raw binary").dropDuplicates(["key"])


def look_classes(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, class_id, members, links) of every key with a non-blank text: the smallest key that looks the same, how many
    keys do, and how many of them are spelt otherwise. One row a key however large the class. As same_look_pairs."""
    keys = written(look_keys(df, key, text))
    spelt = keys.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("k"))
    looks = spelt.groupBy("look").agg(F.sum("m").alias("members"), F.min("k").alias("class_id"))
    counts = spelt.join(looks, "look").select("look", "raw", "class_id", "members", (F.col("members") - F.col("m")).alias("links"))
    return keys.join(counts, ["look", "raw"]).select(F.col("key").alias(key), "class_id", "members", "links")


def same_look_pairs(df: DataFrame, key: str = "chunk_id", text: str = "text", block: int = 5000) -> DataFrame:
    """Pairs (key_a, key_b), smaller first, of keys whose texts look the same but differ in code points.

    Keys meet by the digest of the consistent form, only in groups that hold more than one spelling; exact copies form
    no pairs among themselves. A group is cut into blocks of `block` keys on one side, so that a large one is spread
    over tasks. Null and blank texts and null keys have no rows; an empty table gives none.
    """
    keys = written(look_keys(df, key, text))
    groups = keys.groupBy("look").agg(F.min("raw").alias("r1"), F.max("raw").alias("r2"), F.count(F.lit(1)).alias("n")).filter("r1 <> r2")
    rows = keys.join(groups.select("look", F.ceil(F.col("n") / block).cast("long").alias("cuts")), "look")
    a = rows.select("look", F.pmod(F.xxhash64("key"), F.col("cuts")).alias("cut"), F.col("key").alias("a"), F.col("raw").alias("raw_a"))
    b = rows.select("look", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), F.col("key").alias("b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["look", "cut"]).filter((F.col("a") < F.col("b")) & (F.col("raw_a") != F.col("raw_b"))).select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
