"""Citations, context and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.operators.intervals import checked, coalesced

#: What stands for an answer where no passage survives, and where the model says nothing.
NOTHING = "No relevant information found."
UNANSWERED = "<p><i>No answer could be generated.</i></p>"


def render_interval(lo, hi):
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))


def citations(periods: DataFrame, catalog: DataFrame, keys: list[str], doc: str = "doc_id", unknown: str = "skip") -> DataFrame:
    """(keys, citation): a document's title and its page periods, 'title p. 1-5, 7'; the title alone where all pages are null.

    A document that is not in the catalog has no row, or raises with unknown='raise'. A null title is 'untitled'.
    """
    spans = F.array_sort(F.collect_list(F.when(F.col("from_page").isNotNull(), F.struct("from_page", "to_page"))))
    lists = periods.groupBy(*keys).agg(F.array_join(F.transform(spans, lambda x: render_interval(x["from_page"], x["to_page"])), ", ").alias("pages"))
    titles = catalog.select(F.col("id").alias(doc), F.coalesce("title", F.lit("untitled")).alias("title"))
    rows = lists.join(titles, doc, "left" if unknown == "raise" else "inner")
    title = F.coalesce("title", F.raise_error(F.concat(F.lit("document not found: "), F.col(doc).cast("string"))).cast("string"))
    return rows.select(*keys, F.concat(title, F.when(F.col("pages") == "", "").otherwise(F.concat(F.lit(" p. "), "pages"))).alias("citation"))


def cited(hits: DataFrame, catalog: DataFrame, query: str = "query_id", unknown: str = "skip") -> DataFrame:
    """(query, doc_id, place, citation): the documents behind ranked hits, in the order in which they first come, with their continuous pages.

    hits: query, rank, doc_id, from_page, to_page; unknown pages (null or below 1) add none.
    """
    keys = [query, "doc_id"]
    docs = hits.groupBy(*keys).agg(F.min("rank").alias("first"))
    pages = coalesced(checked(hits), keys)
    rows = citations(docs.join(pages, keys, "left"), catalog, keys, unknown=unknown)
    place = F.row_number().over(Window.partitionBy(query).orderBy("first", "doc_id"))
    return docs.withColumn("place", place).drop("first").join(rows, keys)


def context(hits: DataFrame, query: str = "query_id", question: str = "query_text", text: str = "text") -> DataFrame:
    """(query, context): the hits' texts in rank order under a heading, then the question."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: F.concat(F.lit("- "), x[text], F.lit("\n"))), "")
    return hits.groupBy(query).agg(lines.alias("body"), F.any_value(question).alias("asked")).select(query, F.concat(F.lit("CONTEXT:\n"), "body", F.lit("\nQUESTION: "), "asked").alias("context"))


def escape_html(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_answer(questions: DataFrame, bodies: DataFrame, sources: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, answer): each question's body of an answer with its list of sources, or a fixed notice where it has no hits.

    bodies: query, body, what a chat model wrote; where it is null or blank, another notice stands without sources. Its
    further columns stay.
    sources: query, place, citation. Citations are escaped, bodies are HTML already.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "citation"))), lambda x: F.concat(F.lit("<li>"), escape_html(x["citation"]), F.lit("</li>\n")))
    lists = sources.groupBy(query).agg(F.concat(F.lit("<p>Sources:</p><ul>\n"), F.array_join(items, ""), F.lit("</ul>\n")).alias("list"))
    rows = questions.select(query).join(bodies.withColumn("has", F.lit(True)), query, "left").join(lists, query, "left")
    blank = F.length(F.trim(F.coalesce("body", F.lit("")))) == 0
    answer = F.when(F.col("has").isNull(), NOTHING).when(blank, UNANSWERED).otherwise(F.concat("body", F.coalesce("list", F.lit(""))))
    return rows.select(query, answer.alias("answer"), *(c for c in bodies.columns if c not in (query, "body")))
