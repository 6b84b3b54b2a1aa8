"""The change log: last write wins per id, accounting and compaction, as aggregates.

A log is ``(seq, op, id, doc)`` with ``op`` 'put' or 'delete'. Only per-id aggregates that combine before
the exchange are used, so an id that holds most of the log is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame) -> DataFrame:
    """``(id, doc, seq, born)`` of the live documents: the last put of each id that isn't deleted afterwards.

    ``born`` is the first put of the current life (after the last delete): it orders documents by arrival and survives updates.
    Entries without an id count for nothing.
    """
    log = log.where("id is not null")
    deleted = F.max(F.when(F.col("op") == "delete", F.col("seq")))
    ends = log.groupBy("id").agg(F.max_by(F.struct("op", "doc", "seq"), "seq").alias("_last"), deleted.alias("_deleted"), F.min(F.when(F.col("op") == "put", F.col("seq"))).alias("_first")).where("_last.op = 'put'")
    simple = ends.where("_deleted is null").select("id", "_last.doc", "_last.seq", F.col("_first").alias("born"))
    again = ends.where("_deleted is not null").select("id", "_deleted", F.col("_last.doc").alias("doc"), F.col("_last.seq").alias("seq"))
    lives = log.where("op = 'put'").select("id", F.col("seq").alias("_seq")).join(again.select("id", "_deleted"), "id").where("_seq > _deleted").groupBy("id").agg(F.min("_seq").alias("born"))
    return simple.unionByName(again.select("id", "doc", "seq").join(lives, "id"))


def last_ops(log: DataFrame) -> DataFrame:
    """``(id, op, doc, born, renewed)``: the last entry of each id, its first put after the last delete, and whether there was a delete."""
    log = log.where("id is not null")
    deleted = log.groupBy("id").agg(F.max_by(F.struct("op", "doc"), "seq").alias("_last"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_deleted"), F.min(F.when(F.col("op") == "put", F.col("seq"))).alias("_first"))
    lives = replay(log).select("id", "born")
    return deleted.join(lives, "id", "left").select("id", "_last.op", "_last.doc", "born", F.col("_deleted").isNotNull().alias("renewed"))


def accounting(log: DataFrame) -> DataFrame:
    """One row: entries, live documents and dead entries."""
    live = replay(log).agg(F.count(F.lit(1)).alias("live_documents"))
    return log.agg(F.count(F.lit(1)).alias("log_entries")).select("log_entries", live.scalar().alias("live_documents")).withColumn("dead_entries", F.greatest(F.col("log_entries") - F.col("live_documents"), F.lit(0)))


def should_compact(entries: int, live: int, ratio: float | None = 2.0, least: int = 64) -> bool:
    return ratio is not None and entries >= least and entries >= ratio * max(live, 1)


def compacted(log: DataFrame) -> DataFrame:
    """The shortest log with the same state: one put per live document, in order of arrival."""
    return replay(log).select(F.col("born").alias("seq"), F.lit("put").alias("op"), "id", "doc")


def dense_ids(df: DataFrame, order: str, name: str = "internal_id", start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in order of the unique column ``order``.

    Rows are ranged over partitions, numbered within each, and shifted by the sizes of the partitions before:
    one row per partition goes through the driver, and nothing is sorted in one task.
    """
    spark = df.sparkSession
    from skarn.session import written

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = {r._part: r.k for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("k")).collect()}
    shift, at = {}, start
    for p in sorted(sizes):
        shift[p], at = at, at + sizes[p]
    if not shift:
        return df.withColumn(name, F.lit(None).cast("long"))
    base = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("_part")]
    numbered = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + base
    return ranged.withColumn(name, numbered.cast("long")).drop("_part")
