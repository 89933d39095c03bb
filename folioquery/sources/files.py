"""Office files as a distributed source: one file a row, parsed in Arrow
functions; a file that cannot be parsed gives a row with its error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.text import file_format
from folioquery.functions.vectors import file_checksum

PARSED = "path string, block_id string, sequence int, page int, type string, content string, is_heading boolean, heading_level int, font_name string, font_size double, bold boolean, italic boolean, x double, y double, width double, height double, section string, page_count int, title string, author string, created string, modified string, list_type string, list_prefix string, error string"


def files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,docx}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def documents(found: DataFrame, source: str | None = None) -> DataFrame:
    """(document_id, name, original_path, format, size_bytes, checksum, source)
    of files or of rows (path, content)."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    kind = file_format(F.col("path"))
    sums = file_checksum(F.col("content"))
    return found.select(F.concat(F.lit("doc_"), F.substring(F.sha2(F.col("path"), 256), 1, 24)).alias("document_id"), name.alias("name"), F.col("path").alias("original_path"), kind.alias("format"), F.octet_length("content").cast("long").alias("size_bytes"), sums.alias("checksum"), (F.lit(source) if source else kind).alias("source"))


def parsed(found: DataFrame) -> DataFrame:
    """Blocks of every file of rows (path, content). Errors: unsupported format,
    encrypted, or what the parser said."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from folioquery.sources import docx, pdf

        names = [c.split()[0] for c in PARSED.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                try:
                    if ext not in ("pdf", "docx"):
                        raise ValueError("unsupported format")
                    rows = (pdf if ext == "pdf" else docx).blocks(bytes(content))
                    rows = rows or [{}]
                except Exception as e:  # noqa: BLE001 - any fault of a file is the file's
                    rows = [{"error": str(e) or type(e).__name__}]
                yield pd.DataFrame([{"path": path, **{n: r.get(n) for n in names[1:]}} for r in rows], columns=names).astype({n: "Int32" for n in ("sequence", "page", "heading_level", "page_count")})

    return found.select("path", "content").mapInPandas(run, PARSED)


def page_texts(blocks: DataFrame) -> DataFrame:
    """(path, page, text) of parsed rows: the contents of a page, one a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "content"))), lambda x: x["content"])
    return blocks.filter("error is null and content is not null").groupBy("path", "page").agg(F.array_join(lines, "\n").alias("text"))
