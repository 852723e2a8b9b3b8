"""Sinks: idempotent batch writers, messages, reports."""

from __future__ import annotations

import html
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A folder of the archive with more rows in one batch is written by several tasks.
ROWS_PER_FILE = 1_000_000
#: JSON lines are kept compressed.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def archive(df: DataFrame, path: str, batch_id: int) -> None:
    """Parquet by day and zone under the batch's own folder: a batch written again replaces what it wrote before. df is read twice.

    The rows of a folder come together before they are written, or every task would write a file into every folder; of micro-batches no adaptive plan
    divides what is too large for a task, so large folders are dealt out to several.
    """
    folder = ["sim_date", "grid_zone"]
    large = df.groupBy(*[F.col(c).alias("_" + c) for c in folder]).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files")).filter("_files > 1")  # few
    dealt = df.join(F.broadcast(large), [F.col(c).eqNullSafe(F.col("_" + c)) for c in folder], "left")
    rows = dealt.repartition(*folder, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce("_files", F.lit(1)))).select(*df.columns)
    rows.withColumn("archived_at", F.current_timestamp()).write.mode("overwrite").partitionBy(*folder).parquet(f"{path}/batch_id={batch_id}")


def append_messages(df: DataFrame, path: str, batch_id: int) -> None:
    """A log's JSON lines of one batch, replaced if the batch is written again. Every message must have a key."""
    keyed = df.select(F.when(F.col("key").isNull() | (F.col("key") == ""), F.raise_error(F.lit("a message without a key"))).otherwise(F.col("key")).alias("key"), "value")
    keyed.write.mode("overwrite").options(**PACKED).json(f"{path}/batch_id={batch_id}")


def append_records(df: DataFrame, path: str, batch_id: int) -> None:
    """Records of one batch as JSON lines, replaced if the batch is written again."""
    df.write.mode("overwrite").options(**PACKED).json(f"{path}/batch_id={batch_id}")


def drop_file(folder: str, name: str, data: bytes) -> Path:
    """A file that a watcher of the folder sees only whole."""
    handle, beside = tempfile.mkstemp(dir=folder, prefix=".")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    target = Path(folder) / name
    os.replace(beside, target)
    return target


def csv_report(df: DataFrame, path: str, by: str, then: str) -> None:
    """One ordered CSV file, greatest first, nulls last. For reports of a size that one file may have."""
    df.orderBy(F.col(by).desc_nulls_last(), F.col(then)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def html_report(df: DataFrame, title: str, by: Column, rows: int = 10) -> str:
    """The first rows as a table in HTML."""
    top = df.orderBy(by).limit(rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in top.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in top.collect())
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"
