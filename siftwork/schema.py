"""The chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = "path string, start_line int, end_line int, chunk_kind string, content string, name string, truncated boolean, mtime long, embedding array<float>, model string, folder string, chunk_ord int"
COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
#: Values of columns that older tables lack.
BACKFILL = {"name": "''", "truncated": "false", "mtime": "0L", "model": "''", "folder": "''", "chunk_ord": "0"}
#: A total order for ties.
TIES = ["path", "start_line", "chunk_ord"]


def backfill(df: DataFrame, *more: str) -> DataFrame:
    """df with the columns of CHUNKS, and `more`; missing ones of CHUNKS have their default."""
    for name, value in BACKFILL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(value))
    kinds = dict(x.split() for x in CHUNKS.split(", "))
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS], *more)
