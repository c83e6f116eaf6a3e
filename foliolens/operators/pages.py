"""Pages of a document to one clean text with page extents, and windows of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.text import clean_page


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, clean, start, end): each page's part of the document's cleaned text, in characters, end exclusive.

    The parts in page order give the text that cleaning the joined pages would give: a blank run belongs to the page of
    its first blank, outer blanks go, pages without characters have no row. Null texts count as empty.
    """
    w = Window.partitionBy(doc).orderBy(page)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    c = pages.select(doc, page, F.coalesce(clean_page(F.col(text)), F.lit("")).alias("c"))
    before = F.last(F.when(F.length("c") > 0, F.right("c", F.lit(1))), ignorenulls=True).over(earlier)
    c = c.withColumn("before", before).withColumn("c", F.when(F.col("c").startswith(" ") & (F.coalesce("before", F.lit(" ")) == " "), F.substring("c", 2, 2**31 - 1)).otherwise(F.col("c")))
    final = F.max(F.when(F.length("c") > 0, F.col(page))).over(Window.partitionBy(doc))
    c = c.withColumn("final", final).withColumn("c", F.when((F.col(page) == F.col("final")) & F.col("c").endswith(" "), F.rtrim("c")).otherwise(F.col("c"))).filter(F.length("c") > 0)
    end = F.sum(F.length("c")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.select(doc, page, F.col("c").alias("clean"), (end - F.length("c")).alias("start"), end.alias("end"))


def windows(length, size: int, stride: int):
    """Starts of windows over a length: the last one reaches the end. Null or 0 gives an empty array."""
    n = F.greatest(F.ceil((length - size) / stride) + 1, F.lit(1))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: (i * stride).cast("int"))).otherwise(F.array().cast("array<int>"))


def pair_windows(query, passage, limit: int = 512, size: int = 480, stride: int = 430):
    """Starts of windows over a query followed by a passage, by their lengths: one window up to `limit`, else windows of `size`."""
    n = query + passage
    return F.when((n > 0) & (n <= limit), F.array(F.lit(0))).otherwise(windows(n, size, stride))


def hard_split(docs: DataFrame, key: str, text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, start, piece): texts longer than size in windows that overlap; shorter and null ones have no rows."""
    rows = docs.filter(F.length(text) > size)
    rows = rows.select(key, text, F.explode(windows(F.length(text), size, size - overlap)).alias("start"))
    return rows.select(key, "start", F.substring(text, F.col("start") + 1, F.lit(size)).alias("piece"))
