"""Helpers shared by the training-data operators.

Conventions of every operator in this subpackage
* Only the named key and text columns are read, under internal names; other columns of
  the input travel inside one struct, ``doc``, so that no name can clash.
* A null text counts as empty. A null ``doc_id`` is carried as the largest long
  internally: such rows form one document that sorts after all others, and the
  id is null again in results.
* A row is identified by ``(doc_id, hash of text)``: rows that agree in both are
  interchangeable and get the same result; rows that share an id but not the
  text are decided by their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize, scratch  # noqa: F401  used through this module

NULL_ID = 9223372036854775807
#: White space of all contracts: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SEPARATOR = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_mb: int = 32) -> DataFrame:
    """A broadcast hint only where the counted rows prove the size."""
    return F.broadcast(df) if rows * row_bytes <= limit_mb << 20 else df


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for the row."""
    return F.transform(F.array(value), use)[0]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_id`` and ``_h``: the internal identity of a row."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"),
    ]


def carried(docs: DataFrame, columns: tuple[str, ...] | None = None) -> Column:
    """``doc``: the input's own columns (or those named), kept apart in a struct."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]).alias("doc")


def public_id(column: str = "_id") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, no other letter: ``lower`` where that is the same (pure ASCII),
    the much dearer ``translate`` elsewhere."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
