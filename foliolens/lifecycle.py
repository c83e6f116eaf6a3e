"""Documents from upload to index and out again."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions.models import embedding, hashed_embedder
from foliolens.functions.text import nfc
from foliolens.operators import catalog as tables
from foliolens.operators.chunks import chunk_texts
from foliolens.operators.pages import page_offsets
from foliolens.sources.pages import extract_pages
from foliolens.sources.tables import file_extension, resolve_mime

CATALOG = "id string, title string, mime string, size_bytes long, chunks int, embed_model string, last_indexed_at timestamp, blob_path string, status string"


def save_uploads(files: DataFrame, folder: str) -> DataFrame:
    """Catalog rows of raw files (path, length, content) that are stored in a folder which all workers share.

    Each file goes to `<id><extension>` there, first under another name and then renamed, so that no half file is ever
    seen; the id is a digest of name and content, so that a task that runs again writes the same file. Null content has
    no row. The rows are QUEUED; write them before you go on, as reading them again stores again.
    """

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            rows = []
            for path, ext, content in zip(b["path"], b["ext"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                doc = hashlib.md5(name.encode() + b"\0" + content).hexdigest()
                target = os.path.join(folder, doc + ext)
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
                rows.append((doc, name, len(content), target))
            yield pd.DataFrame(rows, columns=["id", "title", "size_bytes", "blob_path"])

    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter("content is not null").select("path", file_extension(name).alias("ext"), "content").mapInPandas(run, "id string, title string, size_bytes long, blob_path string")
    return rows.select("id", "title", resolve_mime(F.lit(None).cast("string"), F.col("title")).alias("mime"), "size_bytes", F.lit(0).alias("chunks"), F.lit("").alias("embed_model"), F.lit(None).cast("timestamp").alias("last_indexed_at"), "blob_path", F.lit("QUEUED").alias("status"))


def pages_to_chunks(pages: DataFrame, target: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_id, text, page_start, page_end) of pages (doc_id, page, text): composed form, cleaning with page extents, chunks."""
    p = page_offsets(pages.withColumn("text", nfc(F.col("text"))))
    parts = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "page", "end", "clean"))).alias("x"))
    extents = F.transform("x", lambda y: F.struct(y["page"].cast("int").alias("page"), y["start"].cast("int").alias("start"), y["end"].cast("int").alias("end")))
    return chunk_texts(parts.select("doc_id", F.array_join("x.clean", "").alias("clean"), extents.alias("o")), "doc_id", "clean", target, overlap, "o")


def index_rows(chunks: DataFrame, make=hashed_embedder) -> DataFrame:
    """Chunks as rows of the index: doc_id, chunk_id, text, from_page, to_page, embedding."""
    return chunks.select("doc_id", "chunk_id", "text", F.col("page_start").alias("from_page"), F.col("page_end").alias("to_page"), embedding(F.col("text"), make).alias("embedding"))


def reindexed(catalog: DataFrame, chunks: DataFrame, model: str, now=None) -> DataFrame:
    """The catalog after its documents were cut into these chunks: numbers of chunks, model, time; INDEXED, or FAILED without any chunk."""
    n = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    done = F.col("n").isNotNull()
    stamp = F.current_timestamp() if now is None else now
    changed = {"chunks": F.coalesce("n", F.lit(0)), "embed_model": F.when(done, F.lit(model)).otherwise(F.col("embed_model")), "last_indexed_at": F.when(done, stamp).otherwise(F.col("last_indexed_at")), "status": F.when(done, "INDEXED").otherwise("FAILED")}
    return catalog.join(n, "id", "left").select(*(changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns))


def without_documents(ids: DataFrame, index: DataFrame, catalog: DataFrame, unknown: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Index and catalog without the documents of `ids` (id). With unknown='raise' an id that the catalog does not have is refused."""
    if unknown == "raise" and (missing := ids.join(catalog, "id", "left_anti").first()):
        raise ValueError(f"document not found: {missing.id}")
    return tables.delete(index, ids.withColumnRenamed("id", "doc_id"), "doc_id"), tables.delete(catalog, ids, "id")


class Library:
    """Stored files, index and catalog below one shared folder.

    The index lies in buckets of documents and only buckets that change are written again, in place of the old ones; the
    catalog is written last, so that a failed change leaves documents that it does not call INDEXED. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, make=hashed_embedder, model: str = "hashed-64", parse: Callable[[bytes], list[str]] | None = None):
        self.spark, self.folder, self.buckets, self.make, self.model, self.parse = spark, folder.rstrip("/"), buckets, make, model, parse

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{self.folder}/{name}") if os.path.isdir(f"{self.folder}/{name}") else self.spark.createDataFrame([], schema)

    def index(self) -> DataFrame:
        return self._read("index", "doc_id string, chunk_id string, text string, from_page int, to_page int, embedding array<float>, bucket int")

    def catalog(self) -> DataFrame:
        return self._read("catalog", CATALOG + ", bucket int")

    def _change(self, name: str, rows: DataFrame, key: str, gone: DataFrame | None = None) -> None:
        """Replaces in each bucket that is touched the rows of the keys of `rows` and of `gone`."""
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        old = self.index() if name == "index" else self.catalog()
        rows = rows.withColumn("bucket", bucket)
        keys = rows.select(key, "bucket") if gone is None else rows.select(key, "bucket").union(gone.select(key).withColumn("bucket", bucket))
        hit = sorted(r.bucket for r in keys.select("bucket").distinct().collect())  # as many as buckets at most
        if not hit:
            return
        kept = tables.delete(old.filter(F.col("bucket").isin(hit)), keys, key)
        place = f"{self.folder}/staged/{uuid.uuid4().hex}"
        kept.unionByName(rows.select(old.columns)).write.partitionBy("bucket").parquet(place)
        new = self.spark.read.schema(old.schema).parquet(place)
        full = {r.bucket for r in new.select("bucket").distinct().collect()}
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        self.spark.catalog.refreshByPath(f"{self.folder}/{name}")
        for b in set(hit) - full:  # buckets that are empty now
            for f in os.scandir(part) if os.path.isdir(part := f"{self.folder}/{name}/bucket={b}") else ():
                os.remove(f.path)

    def ingest(self, files: DataFrame) -> None:
        """Stores raw files, cuts and indexes them, and lists them. Files of the same name and content replace themselves."""
        os.makedirs(f"{self.folder}/files", exist_ok=True)
        self._change("catalog", save_uploads(files, f"{self.folder}/files"), "id")
        self.reindex(self.catalog().filter("status = 'QUEUED'").select("id"))

    def reindex(self, ids: DataFrame) -> None:
        """Cuts and embeds the stored files of these documents (id) anew. Files that cannot be read are FAILED."""
        todo = tables.lookup(self.catalog().drop("bucket"), "id", ids)
        raw = self.spark.read.format("binaryFile").load(f"{self.folder}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "content")
        own = todo.select(F.col("id"), F.element_at(F.split("blob_path", "/"), -1).alias("file"))
        named = raw.join(own, "file").select(F.concat(F.lit("/"), "id").alias("path"), "content")
        pages = extract_pages(named, *([self.parse] if self.parse else []), on_error="skip")
        place = f"{self.folder}/staged/{uuid.uuid4().hex}"
        index_rows(pages_to_chunks(pages), self.make).write.parquet(place)  # models run once
        rows = self.spark.read.parquet(place)
        self._change("index", rows, "doc_id", todo.select(F.col("id").alias("doc_id")))
        self._change("catalog", reindexed(todo, rows, self.model), "id")

    def delete(self, ids: DataFrame) -> None:
        """Removes documents (id): files, index, catalog. An id that is not listed is refused; a file that is gone already is not."""
        if missing := ids.join(self.catalog(), "id", "left_anti").first():
            raise ValueError(f"document not found: {missing.id}")

        def remove(batches: Iterable[pd.DataFrame]):
            for b in batches:
                for path in b["blob_path"].dropna():
                    if os.path.exists(path):
                        os.remove(path)
                yield pd.DataFrame({"n": [len(b)]})

        tables.lookup(self.catalog(), "id", ids).select("blob_path").mapInPandas(remove, "n long").agg(F.sum("n")).collect()
        self._change("index", self.index().drop("bucket").limit(0), "doc_id", ids.select(F.col("id").alias("doc_id")))
        self._change("catalog", self.catalog().drop("bucket").limit(0), "id", ids)
