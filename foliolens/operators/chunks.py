"""Sentences to overlapping chunks with page spans."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions.text import ABBREVIATIONS

_BREAK = re.compile(r"(?<=[.!?])[ \t\n\v\f\r]+(?=\S)")
_GUARD = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(re.escape(a) for a in ABBREVIATIONS)})\.\Z")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open extents of a cleaned text's sentences, without the blanks between."""
    spans, start = [], 0
    for m in _BREAK.finditer(text):
        opens = text[m.end()]
        if (unicodedata.category(opens) == "Lu" or opens in "\"'") and not _GUARD.search(text, max(0, m.start() - 20), m.start()):
            spans.append((start, m.start()))
            start = m.end()
    return [*spans, (start, len(text))] if start < len(text) else spans


def pack(text: str, target: int = 2000, overlap: int = 200) -> list[tuple[str, int, int]]:
    """(chunk, start, end): sentences joined up to target characters, each chunk led by the end of the one before.

    A sentence beyond the target is cut into windows that step back by the overlap. The lead counts toward the length
    when a chunk is closed, but a sentence always enters the chunk that it opened, so that chunks may exceed the target
    by the lead. What a long sentence leaves over stands as a chunk of its own before the next sentence or at the end;
    such a chunk's extent is that of the text's last characters.
    """
    if not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap below it")
    if not text.strip():
        return []
    out: list[tuple[str, int, int]] = []
    spans: list[tuple[int, int]] = []
    lead = ""

    def close() -> None:
        nonlocal lead
        body = " ".join([*([lead] if lead else []), *(text[a:b] for a, b in spans)])
        if spans:
            a, b = max(0, spans[0][0] - len(lead)), spans[-1][1]
        else:
            a, b = max(0, len(text) - len(lead)), len(text)
        out.append((body.strip("".join(map(chr, range(33)))), a, b))
        lead = body[-overlap:] if overlap else ""
        spans.clear()

    for a, b in sentence_spans(text):
        if b - a > target:
            if spans or lead:
                close()
            at = a
            while at < b:
                end = min(at + target, b)
                spans.append((at, end))
                close()
                at = max(end - overlap, at + 1) if overlap and end < b else end
            continue
        held = sum(y - x for x, y in spans) + max(0, len(spans) - 1)
        if (spans or lead) and held + bool(spans) + (b - a) + len(lead) > target:
            close()
        spans.append((a, b))
    if spans or lead:
        close()
    return out


def chunk_texts(docs: DataFrame, key: str, text: str, target: int = 2000, overlap: int = 200, offsets: str | None = None, invalid: str = "skip") -> DataFrame:
    """(doc_id, chunk_id, text, page_start, page_end) of cleaned texts, documents apart from each other.

    offsets names a column of arrays of (page, start, end); without it, or with null, pages are -1. Null and blank texts
    and null keys have no chunks. With invalid='raise' a null or blank key, a null text, or extents that do not end where the
    text does raise instead.
    """
    kept, body = F.col(key).isNotNull(), F.col(text)
    if invalid == "raise":
        last = F.element_at(offsets, -1)["end"] if offsets else F.lit(None)
        bad = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | F.col(text).isNull() | F.coalesce(last != F.length(text), F.lit(False))
        error = F.raise_error(F.concat(F.lit("invalid document "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        kept, body = F.lit(True), F.when(bad, error.cast("string")).otherwise(body)
    rows = docs.filter(kept).select(F.col(key).cast("string").alias("k"), body.alias("t"), (F.col(offsets) if offsets else F.lit(None).cast("array<struct<page:int,start:int,end:int>>")).alias("o"))

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            out = []
            for k, t, o in zip(*(b.column(i).to_pylist() for i in range(3))):
                starts = [x["start"] for x in o or ()]
                page = lambda i: o[max(0, bisect.bisect_right(starts, i) - 1)]["page"] if o else -1  # noqa: B023, E731
                for n, (body, a, e) in enumerate(pack(t or "", target, overlap)):
                    first, last = page(min(a, len(t) - 1)), page(max(e - 1, a))
                    name = f"{k}_{n:05d}" + (f"_p{first}-{last}" if first >= 1 and last >= 1 else "")
                    out.append((k, name, body, first, last))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "chunk_id", "text", "page_start", "page_end"])

    return rows.mapInArrow(run, "doc_id string, chunk_id string, text string, page_start int, page_end int")
