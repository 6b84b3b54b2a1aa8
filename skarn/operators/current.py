"""The current record of each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_instant(col: str | Column) -> Column:
    """ISO-8601 text with any offset as a point in time; null when missing, empty or not a time."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c).try_cast("timestamp")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def current_records(df: DataFrame, columns: list[str], key: str = "id", at: str = "crawled_at") -> DataFrame:
    """One row per ``key``: the row whose ``at`` is the latest point in time.

    A missing, empty or unreadable ``at`` is the oldest. Identical rows count once.
    Different rows with the same latest ``at``: the one with the larger row hash,
    so the result doesn't depend on the order of rows. Rows without a key have no
    record and are left out. Only ``key`` and ``columns`` come out.

    ``row_number() <= 1`` is pushed below the exchange as a group limit, so of a hot
    id only one row per input partition is shuffled.
    """
    columns = [c for c in columns if c != key]
    names = list(dict.fromkeys([key, at, *columns]))
    rows = df.select(*names).where(F.col(key).isNotNull())
    tie = F.xxhash64(*[F.col(c) for c in names if _hashable(df.schema[c].dataType)])
    kept = rows.select(F.struct(key, *columns).alias("_row"), F.col(key).alias("_key"), as_instant(at).alias("_at"), tie.alias("_tie"))
    w = Window.partitionBy("_key").orderBy(F.col("_at").desc_nulls_last(), F.col("_tie").desc())
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_row.*")
