"""Changes between full snapshots (problem 3).

What is kept of the last snapshot is an index: per id a 128-bit hash of the compared content
and nothing else, as one Parquet table bucketed by id. A new snapshot is hashed and aggregated
in one pass, probed against the kept index bucket by bucket (no exchange), and then takes its
place. A delivery costs one pass over its own rows, however many came before. The values
themselves are read again only for ids that changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators.current import as_instant
from skarn.session import scratch_path
from skarn.sources.files import delete, exists, read_text, replace_text

CHANGES = "crawl_id string, id string, change_kind string, old_h binary, new_h binary"


def _clean(c: Column) -> Column:
    """A compared text: outer spaces don't count and null equals empty."""
    return F.coalesce(F.trim(c.cast("string"), F.lit(" \t\r\n")), F.lit(""))


def content(df: DataFrame, fields: list[str], exact: list[str]) -> Column:
    """The compared content: in ``fields`` outer spaces don't count and null equals empty; ``exact`` is compared as it stands.

    Each part is written with its length, so that no two contents give the same text.
    """

    def part(text: Column) -> Column:
        return F.concat(F.length(text).cast("string"), F.lit(":"), text)

    whole = []
    for f in sorted([*fields, *exact]):
        c = F.col(f)
        if f in fields:
            whole.append(part(_clean(c)))
        elif isinstance(df.schema[f].dataType, T.ArrayType):
            whole.append(F.concat(F.coalesce(F.size(c), F.lit(-1)).cast("string"), F.lit("["), F.coalesce(F.concat_ws("", F.transform(c, lambda x: F.coalesce(part(x.cast("string")), F.lit("~")))), F.lit(""))))
        else:
            whole.append(F.coalesce(part(c.cast("string")), F.lit("~")))
    return F.concat(*whole)


def content_hash(df: DataFrame, fields: list[str], exact: list[str]) -> Column:
    return F.unhex(F.md5(content(df, fields, exact)))


def key_index(rows: DataFrame, fields: list[str], exact: list[str], by: tuple[str, ...] = (), key: str = "id", at: str = "crawled_at") -> DataFrame:
    """``(*by, id, h)``: of each id (in each snapshot, if ``by`` names its column) the hash of its latest row.

    Latest by ``at`` as a point in time, a missing one being the oldest; among rows with the
    same time the larger hash. The aggregate combines before the exchange, so that a hot id
    sends one row per task, and only hashes travel. Rows without an id are left out.
    """
    narrow = rows.where(F.col(key).isNotNull()).select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col(key).alias("_id"), F.unix_micros(as_instant(at)).alias("_at"), content_hash(rows, fields, exact).alias("_h"))
    latest = narrow.groupBy(*[f"_by_{c}" for c in by], "_id").agg(F.max(F.struct("_at", "_h")).alias("_m"))
    return latest.select(*[F.col(f"_by_{c}").alias(c) for c in by], F.col("_id").alias("id"), F.col("_m._h").alias("h"))


class SnapshotIndex:
    """The bucketed key-to-hash index of the last snapshot, kept in a folder: ``index.json`` names the version that counts.

    The number of buckets is fixed when the folder is made. A catalogue entry exists only while the index is probed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if exists(spark, f"{self.path}/index.json"):
            self.state = json.loads(read_text(spark, f"{self.path}/index.json"))
        else:
            self.state = {"snapshot": None, "version": None, "buckets": buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))}

    @property
    def snapshot(self) -> str | None:
        """The snapshot that is kept, None before the first."""
        return self.state["snapshot"]

    def _table(self, version: str) -> str:
        """A version as a catalogue table, through which Spark knows the buckets."""
        name = f"skarn_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (id STRING, h BINARY) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{version}'")
        return name

    def advance(self, fresh: DataFrame, snapshot: str, changes: str | None = None) -> DataFrame | None:
        """Compare ``fresh(id, h)``, of :func:`key_index`, with the kept index and keep it instead.

        The changes ``(crawl_id, id, change_kind, old_h, new_h)`` are written to the folder ``changes`` and read from there;
        the first snapshot has none. The new version is written beside the old one and only then named in ``index.json``; a delivery
        that fails before that can be repeated. The snapshot that is kept already isn't taken again.
        """
        if snapshot == self.snapshot:
            raise ValueError(f"snapshot {snapshot!r} is kept already")
        before, version = self.state["version"], f"v-{uuid.uuid4().hex}"
        new = self._table(version)
        old = self._table(before) if before else None
        try:
            n = self.state["buckets"]
            fresh.select("id", "h").repartition(n, "id").sortWithinPartitions("id").write.insertInto(new)
            out = None
            if old:
                where = changes or scratch_path(self.spark, "changes")
                probe(self.spark.table(old), self.spark.table(new), snapshot).write.mode("overwrite").parquet(where)
                out = self.spark.read.schema(CHANGES).parquet(where)
        finally:
            for t in (new, old):
                if t:
                    self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.state = self.state | {"snapshot": snapshot, "version": version}
        replace_text(self.spark, f"{self.path}/index.json", json.dumps(self.state))
        if before:
            delete(self.spark, f"{self.path}/{before}")
        return out


def probe(old: DataFrame, new: DataFrame, snapshot: str) -> DataFrame:
    """``(crawl_id, id, change_kind, old_h, new_h)`` from two indexes ``(id, h)``."""
    o, n = old.select("id", F.col("h").alias("old_h")), new.select("id", F.col("h").alias("new_h"))
    kind = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").when(F.col("old_h") != F.col("new_h"), "changed")
    return o.join(n, "id", "full_outer").select(F.lit(snapshot).alias("crawl_id"), "id", kind.alias("change_kind"), "old_h", "new_h").where("change_kind is not null")


def snapshot_changes(rows: DataFrame, order: list[str], fields: list[str], exact: list[str], snapshot: str = "crawl_id", key: str = "id", at: str = "crawled_at", index: SnapshotIndex | None = None) -> DataFrame:
    """The changes of each snapshot of ``order``, compared with the one before; the first is compared with what ``index`` keeps, if it keeps one.

    ``rows`` are hashed in one pass, whose result lies by snapshot; then the index advances from snapshot to snapshot. Late rows belong
    to the snapshot they name. Without an ``index`` one is kept for this call. No or one snapshot: no changes.
    """
    spark = rows.sparkSession
    if not order:
        return spark.createDataFrame([], CHANGES)
    index = index or SnapshotIndex(spark, scratch_path(spark, "snapshot-index"))
    hashed, out = scratch_path(spark, "snapshot-hashes"), scratch_path(spark, "changes")
    wanted = rows.where(F.col(snapshot).isin(order)).withColumn("_snapshot", F.col(snapshot))
    key_index(wanted, fields, exact, ("_snapshot",), key, at).write.partitionBy("_snapshot").parquet(hashed)
    known = spark.read.schema("id string, h binary, _snapshot string").parquet(hashed)
    for i, name in enumerate(order):
        index.advance(known.where(F.col("_snapshot") == name), name, f"{out}/step={i}")
    return spark.read.schema(CHANGES).option("basePath", out).parquet(f"{out}/step=*").select("crawl_id", "id", "change_kind", "old_h", "new_h") if exists(spark, out) else spark.createDataFrame([], CHANGES)


def changed_values(changes: DataFrame, rows: DataFrame, order: list[str], fields: list[str], exact: list[str], snapshot: str = "crawl_id", key: str = "id") -> DataFrame:
    """Old and new values of the changed ids only: ``crawl_id, id, field_name, old_value, new_value``.

    The ids that changed are joined to the rows before anything is hashed or compared, and of an id's rows in a snapshot
    those are taken whose hash is the index's, so that the values are those that were compared. ``fields`` come out without outer
    spaces and empty for null, ``exact`` ones as JSON text.
    """
    spark = rows.sparkSession
    steps = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "_before string, _after string")
    ids = changes.where("change_kind = 'changed'").join(F.broadcast(steps), F.col("crawl_id") == F.col("_after"))
    sides = F.array(*[F.struct(F.col(snap).alias("_snap"), F.col(h).alias("_h"), F.lit(side).alias("_side")) for snap, h, side in (("_before", "old_h", "old"), ("_after", "new_h", "new"))])
    asked = ids.select(F.col("id").alias("_id"), "_after", F.explode(sides).alias("_a")).select("_id", "_after", "_a.*")
    compared = rows.select(*dict.fromkeys([snapshot, key, *fields, *exact]))
    found = asked.join(compared, (F.col("_id") == compared[key]) & (F.col("_snap") == compared[snapshot])).where(content_hash(compared, fields, exact) == F.col("_h"))
    text = lambda c: _clean(F.col(c)) if c in fields else F.get_json_object(F.to_json(F.struct(F.col(c).alias("v"))), "$.v")
    body = F.array(*[F.struct(F.lit(c).alias("name"), text(c).alias("value")) for c in [*fields, *exact]])
    of = lambda side: F.max(F.when(F.col("_side") == side, body))
    both = found.groupBy("_after", "_id").agg(of("old").alias("_old"), of("new").alias("_new"))
    pairs = both.select("_after", "_id", F.explode(F.arrays_zip("_old", "_new")).alias("_p")).where("not (_p._old.value <=> _p._new.value)")
    return pairs.select(F.col("_after").alias("crawl_id"), F.col("_id").alias("id"), F.col("_p._old.name").alias("field_name"), F.col("_p._old.value").alias("old_value"), F.col("_p._new.value").alias("new_value"))
