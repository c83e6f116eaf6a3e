"""Files to pages: a pluggable page parser run over raw files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

PAGE_SCHEMA = "doc_id string, page int, text string"


def plain_text_pages(content: bytes) -> list[str]:
    """Pages of a plain text file, parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def extract_pages(files: DataFrame, parse: Callable[[bytes], list[str]] = plain_text_pages, on_error: str = "raise") -> DataFrame:
    """Rows (doc_id, page, text) of every page of every file, pages counted from 1.

    parse turns a file's bytes into its page texts; a PDF library can be plugged in here. A file that cannot be parsed
    raises, or has no rows with on_error='skip'. Null or empty content: one empty page.
    """

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    pages = parse(content if content is not None else b"")
                except Exception as error:
                    if on_error == "skip":
                        continue
                    raise ValueError(f"cannot read {path}") from error
                rows += [(path.rsplit("/", 1)[-1], i, t) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)
