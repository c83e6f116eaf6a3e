"""Table sources: Parquet tables, raw files and page tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 500 * 1024 * 1024
DEFAULT_MIME = "application/octet-stream"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The table written to the session's shared checkpoint folder and read from there: its work is done once.

    Only a session on this machine may have no folder set, as in tests, and gets a temporary one; on a cluster that raises.
    The tables stay until that folder is cleared.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Raw files below a path with their bytes; larger ones than max_bytes are left out before their content is read.

    Columns: path, modificationTime, length, content. No files: an empty table.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).filter(F.col("length") <= max_bytes)


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: re-sent rows are equal in all columns. Rows with a null key are left out."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])


def file_extension(name):
    """Extension of a file name from its last dot on, trimmed, in lower case; '' if there is none or the name is null."""
    return F.coalesce(F.lower(F.trim(F.regexp_extract(name, r"(\.[^.]*)$", 1))), F.lit(""))


#: Usual media types of file extensions.
MIME_OF = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".html": "text/html",
    ".tif": "image/tiff",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def resolve_mime(mime, name):
    """The stated type if not blank, else the one of the extension, else the default for unknown bytes."""
    ext = file_extension(name)
    known = F.coalesce(*[F.when(ext == e, F.lit(m)) for e, m in MIME_OF.items()])
    return F.coalesce(F.nullif(F.trim(mime), F.lit("")), known, F.lit(DEFAULT_MIME))
