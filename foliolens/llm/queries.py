"""Queries on training text and vectors by problem number, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import leakage, lookalike, neighbours, packing, quality, scans, sentences

#: Most rows of short ids that are broadcast.
BROADCAST_ROWS = 2_000_000


def _table(spark, base, name):
    return spark.read.parquet(f"{base}/{name}.parquet")


def p1_found(spark, base):
    return scans.scan_defects(_table(spark, base, "chunks"), _table(spark, base, "doc_catalog"))


def p1_texts(spark, base):
    """Texts of scanned documents as running paragraphs."""
    return scans.repaired_texts(_table(spark, base, "chunks"), _table(spark, base, "doc_catalog"))


def p3_found(spark, base):
    return lookalike.same_look_pairs(_table(spark, base, "chunks"))


def p3_classes(spark, base):
    """Each chunk's class of equal look."""
    return lookalike.look_classes(_table(spark, base, "chunks"))


def p3_texts(spark, base):
    """The consistent form of each chunk's text."""
    chunks = _table(spark, base, "chunks").dropDuplicates(["chunk_id"])
    return lookalike.consistent_text(chunks.select("chunk_id", "text")).select("chunk_id", "form")


def _scans(spark, base):
    """Documents that were scanned from paper."""
    return _table(spark, base, "doc_catalog").filter("mime = 'image/tiff'").select(F.col("id").alias("doc_id")).distinct()


def p4_found(spark, base):
    return neighbours.nearest_pairs(_table(spark, base, "index_vectors"))


def p4_nearest(spark, base):
    """The five most similar chunks of every chunk."""
    return neighbours.nearest(_table(spark, base, "index_vectors"))


def _sized(df):
    """The table with a broadcast hint if it was counted to be small, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def p5_found(spark, base):
    chunks = _table(spark, base, "chunks").select("doc_id", "chunk_id", "text")
    return sentences.sentences(chunks.join(_sized(_scans(spark, base)), "doc_id", "left_anti"))


def p5_cover(spark, base):
    """Letters and digits of each chunk that lie in its sentences: all of them."""
    chunks = _table(spark, base, "chunks").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    within = F.regexp_replace(F.substring(F.col("text"), F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start")), r"[^\p{L}\p{N}]+", "")
    rows = p5_found(spark, base).join(chunks, "chunk_id").groupBy("chunk_id").agg(F.sum(F.length(within)).alias("letters"))
    return rows.filter("letters > 0")


P5_COVER = r"""
WITH c AS (SELECT DISTINCT doc_id, chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)
SELECT chunk_id, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS letters FROM c
WHERE (doc_id IS NULL OR doc_id NOT IN (SELECT id FROM doc_catalog WHERE mime = 'image/tiff' AND id IS NOT NULL)) AND length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) > 0"""


def p6_packing(spark, base):
    """Container and place of every text under every limit."""
    return packing.pack(_table(spark, base, "documents"), _table(spark, base, "pack_limits"))


def p6_fill(spark, base):
    """How full the containers of each limit are."""
    return packing.fill(p6_packing(spark, base), _table(spark, base, "pack_limits"))


def p6_rules(spark, base):
    """What the packing must keep under each limit: every text placed, no container overfull, nothing cut without need."""
    return packing.broken_rules(p6_packing(spark, base), _table(spark, base, "pack_limits"))


P6_RULES = "SELECT limit_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS cut FROM pack_limits"


def p7_found(spark, base):
    return leakage.leaks(_table(spark, base, "documents"), _table(spark, base, "eval_items"))


def p7_spans(spark, base):
    """What to remove from each document, in words."""
    return leakage.removal_spans(_table(spark, base, "documents"), _table(spark, base, "eval_items"))


def p8_found(spark, base):
    return quality.not_prose(_table(spark, base, "documents"), _table(spark, base, "common_words"))


def p8_counts(spark, base):
    """Statistics of each document's text by built-in expressions alone."""
    s = quality.text_statistics(_table(spark, base, "documents"), _table(spark, base, "common_words"))
    return s.select("doc_id", "words", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


_ALONE = "(SELECT list(DISTINCT lower(word)) FROM common_words WHERE lang NOT IN ('th', 'zh', 'ja', 'ko'))"
_INSIDE = "(SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) FROM (SELECT DISTINCT word FROM common_words WHERE lang IN ('th', 'zh', 'ja', 'ko')))"
P8_COUNTS = rf"""
WITH t AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\s\p{{Z}}\p{{Cc}}]+', '', 'g')) > 0) AS lines,
 length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS letters, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+(?:[''’-][\p{{L}}\p{{M}}]+)*') AS w,
 length(regexp_replace(text, '[\s\p{{Z}}\p{{Cc}}]+', '', 'g')) AS solid, length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}}\s\p{{Z}}\p{{Cc}}.,;:!?''"()\[\]«»“”„‘’…。、，！？；：「」『』（）।۔؟،؛–—-]+', '', 'g')) AS symbols
 FROM documents WHERE length(regexp_replace(text, '[\s\p{{Z}}\p{{Cc}}]+', '', 'g')) > 0),
c AS (SELECT t.*, length(array_to_string(list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(alone, x)), '')) + length(array_to_string(regexp_extract_all(text, {_INSIDE}), '')) AS common FROM t, (SELECT {_ALONE} AS alone))
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, round(coalesce(letters / nullif(len(w), 0), 0.0), 6) AS mean_word_length, round(symbols / solid, 6) AS symbol_ratio,
 round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？।؟۔:;,]["”»“’)\]」』]*\s*$'))) / len(lines), 6) AS punctuated_lines,
 round(least(1.0, coalesce(common / nullif(letters, 0), 0.0)), 6) AS common_words FROM c"""


def p8_stats(spark, base):
    """Statistics of each document's text, with its divergences from prose, lists, tables and junk."""
    return quality.text_quality(_table(spark, base, "documents"), _table(spark, base, "common_words"))


QUERIES = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_texts": p3_texts,
    "p4_found": p4_found,
    "p4_nearest": p4_nearest,
    "p5_found": p5_found,
    "p5_cover": p5_cover,
    "p6_packing": p6_packing,
    "p6_rules": p6_rules,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p8_found": p8_found,
    "p8_counts": p8_counts,
    "p8_stats": p8_stats,
}
SQL = {"p5_cover": P5_COVER, "p6_rules": P6_RULES, "p8_counts": P8_COUNTS}
