"""A collection: a folder with a change log, its settings and the tables derived from it.

    meta.json            settings; on reopening they win over the arguments
    log/batch=NNN/       JSON lines {"op", "id", "doc", "batch", "n"}; appended, never changed
    tables/vNNN/         documents and index of the state after a batch

The tables follow the log: a refresh reads only the batches since, analyzes only the documents they
touch and takes everything else over. Readers keep the version they opened. A new version or a
compacted log is written beside the old one and then takes its place in ``meta.json``; what it
replaces is deleted by the next one, so that a reader who has just opened it can finish.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.analyzer import Analyzer
from skarn.operators import log as oplog
from skarn.operators.index import Index, build_index
from skarn.operators.ranking import Scorer, resolve, search, total_hits
from skarn.plans.schema import CollectionSchema
from skarn.session import written
from skarn.sources.files import delete, exists, list_names, read_text, replace_text

VERSION = 2
LINE = "op string, id string, doc string, batch long, n long"
LOG = "op string, id string, doc string, seq struct<batch: long, n: long>"


def _corrupt() -> Column:
    r = F.col("_r")
    return r.isNull() | r["n"].isNull() | ~F.coalesce(r["op"].isin("put", "delete"), F.lit(False))


@dataclass
class Results:
    """One page of hits ``(rank, id, score, stored fields)`` and the number of all hits."""

    hits: DataFrame
    total: int
    query: str
    scorer: str


@dataclass
class Collection:
    spark: SparkSession
    path: str
    schema: CollectionSchema
    analyzer: Analyzer
    name: str = "collection"
    read_only: bool = False
    compact_ratio: float | None = 2.0
    compact_least: int = 64
    _meta: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: CollectionSchema | None = None, analyzer: Analyzer | None = None, name: str = "collection", read_only: bool = False, compact_ratio: float | None = 2.0, compact_least: int = 64) -> "Collection":
        """Open a collection, or make one where there is none. Read-only opening changes nothing and needs an existing one."""
        path = path.rstrip("/")
        if exists(spark, f"{path}/meta.json"):
            meta = json.loads(read_text(spark, f"{path}/meta.json"))
            if meta.get("version") != VERSION:
                raise ValueError(f"unknown format version {meta.get('version')!r}")
            return cls(spark, path, CollectionSchema.from_dict(meta["schema"]), Analyzer.from_config(meta["analyzer"]), meta["name"], read_only, compact_ratio, compact_least, meta)
        if read_only:
            raise FileNotFoundError(path)
        if schema is None:
            raise ValueError("a new collection needs a schema")
        made = cls(spark, path, schema, analyzer or Analyzer(), name, read_only, compact_ratio, compact_least, {"batches": 0, "log": "log", "tables": None, "columns": None})
        made._save()
        return made

    def _save(self, **changes: object) -> None:
        self._meta |= {"version": VERSION, "name": self.name, "schema": self.schema.to_dict(), "analyzer": self.analyzer.config(), **changes}
        replace_text(self.spark, f"{self.path}/meta.json", json.dumps(self._meta, indent=1))

    def _may_write(self) -> None:
        if self.read_only:
            raise RuntimeError("the collection is open for reading only")

    def _append(self, ops: DataFrame) -> None:
        """One more batch; its rows keep their order by partition and row."""
        batch = self._meta["batches"]
        numbered = ops.withColumns({"batch": F.lit(batch).cast("long"), "n": F.monotonically_increasing_id()})
        numbered.write.mode("overwrite").json(f"{self.path}/{self._meta['log']}/batch={batch:09d}")
        self._save(batches=batch + 1)

    def add_many(self, docs: DataFrame) -> int:
        """Upsert a table of documents; later rows of one id win. Raises if an id is missing, before anything is written."""
        self._may_write()
        key = self.schema.id_field
        if docs.where(F.col(key).isNull()).limit(1).count():
            raise ValueError(f"documents without {key!r}")
        columns = self._meta["columns"] or {}
        self._meta["columns"] = columns | {f.name: f.dataType.simpleString() for f in docs.schema.fields}
        body = F.to_json(F.struct(*docs.columns))
        self._append(docs.select(F.lit("put").alias("op"), F.col(key).cast("string").alias("id"), body.alias("doc")))
        return docs.count()

    def add(self, document: dict) -> None:
        """Upsert one document; a field that is None and was never seen is text."""
        known = self._meta["columns"] or {}
        present = {k: v for k, v in document.items() if v is not None}
        row = self.spark.createDataFrame([present]) if present else self.spark.range(1).select()
        absent = [F.lit(None).cast(known.get(k, "string")).alias(k) for k in document if k not in present]
        self.add_many(row.select("*", *absent))

    def delete_many(self, ids: DataFrame) -> None:
        self._may_write()
        self._append(ids.select(F.lit("delete").alias("op"), F.col(self.schema.id_field).cast("string").alias("id"), F.lit(None).cast("string").alias("doc")))

    def delete(self, key: str) -> bool:
        self._may_write()
        if self.get(key) is None:
            return False
        self.delete_many(self.spark.createDataFrame([(key,)], f"{self.schema.id_field} string"))
        return True

    def log(self, since: int = 0) -> DataFrame:
        """The log as ``(op, id, doc, seq)`` from batch ``since`` on; a line that can't be read raises and names its file. See :meth:`corrupt_lines`."""
        folders = [f"{self.path}/{self._meta['log']}/{n}" for n in list_names(self.spark, f"{self.path}/{self._meta['log']}") if n.startswith("batch=") and int(n.partition("=")[2]) >= since]
        if not folders:
            return self.spark.createDataFrame([], LOG)
        raw = self.spark.read.text(folders).select("value", F.col("_metadata.file_path").alias("_file"))
        parsed = raw.where("trim(value) <> ''").withColumn("_r", F.from_json("value", LINE))
        said = F.raise_error(F.concat(F.lit("corrupt log line in "), F.col("_file"), F.lit(": "), F.left("value", F.lit(80))))
        checked = F.when(_corrupt(), said.cast(f"struct<{LINE.replace(' ', ':').replace(',:', ',')}>")).otherwise(F.col("_r"))
        return parsed.select(checked.alias("_r")).select("_r.op", "_r.id", "_r.doc", F.struct("_r.batch", "_r.n").alias("seq"))

    def corrupt_lines(self) -> DataFrame:
        """``(file, line, text)`` of the log lines that can't be read, counted from 1. Only the files that hold one are read whole."""
        raw = self.spark.read.text(f"{self.path}/{self._meta['log']}").select("value", F.col("_metadata.file_path").alias("file"))
        bad = raw.where("trim(value) <> ''").withColumn("_r", F.from_json("value", LINE)).where(_corrupt()).select("file").distinct()
        files = [r.file for r in bad.collect()]
        if not files:
            return self.spark.createDataFrame([], "file string, line int, text string")
        whole = self.spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
        return whole.where("trim(value) <> ''").withColumn("_r", F.from_json("value", LINE)).where(_corrupt()).select("file", (F.col("line") + 1).alias("line"), F.col("value").alias("text"))

    def _documents(self, bodies: DataFrame) -> DataFrame:
        columns = self._meta["columns"] or {f.name: "string" for f in self.schema.fields}
        kind = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        return bodies.select("internal_id", F.from_json("doc", kind).alias("_d")).select("internal_id", "_d.*")

    def documents(self) -> DataFrame:
        """The live documents with ``internal_id``, in the columns that were ever added, replayed from the whole log."""
        return self._documents(oplog.dense_ids(oplog.replay(self.log()), "born"))

    def refresh(self) -> "Collection":
        """Bring the tables to the state of the log: only the batches since the last time are read, and only the documents they name analyzed anew.

        An update keeps a document's internal id; a document that is new, or comes back after a delete, gets the next free one, in order of arrival.
        Ids are never given twice (``next_id`` in the settings).
        """
        self._may_write()
        batches, key = self._meta["batches"], self.schema.id_field
        target, before = f"tables/v{batches:09d}", self._meta["tables"]
        if self._meta.get("covered") == batches and before:
            return self
        try:
            fresh = written(oplog.last_ops(self.log(self._meta.get("covered") or 0)), "touched")
        except Exception as error:
            if lines := self.corrupt_lines().limit(10).collect():
                raise ValueError("; ".join(f"{r.file}: corrupt entry on line {r.line}" for r in lines)) from error
            raise
        old = self.spark.read.parquet(f"{self.path}/{before}/documents") if before else None
        known = old.select(F.col(key).cast("string").alias("id"), "internal_id") if old is not None else self.spark.createDataFrame([], "id string, internal_id long")
        touched = written(fresh.join(known, "id", "left"), "touched")
        puts = touched.where("op = 'put'")
        kept = puts.where("internal_id is not null and not renewed").select("internal_id", "doc")
        new = oplog.dense_ids(puts.where("internal_id is null or renewed").select("doc", "born"), "born", start=self._meta.get("next_id") or 0)
        added = written(kept.unionByName(new.select("internal_id", "doc")), "added")
        gone = touched.where("internal_id is not null").select(F.col("internal_id").alias("doc"))
        docs = self._documents(added)
        if old is not None:
            docs = old.join(gone.withColumnRenamed("doc", "internal_id"), "internal_id", "left_anti").unionByName(docs, allowMissingColumns=True)
        docs.write.mode("overwrite").parquet(f"{self.path}/{target}/documents")
        index = build_index(self._documents(added), self.schema, self.analyzer)
        if before:
            index = Index.read(self.spark, f"{self.path}/{before}/index", self.schema, self.analyzer).without(gone).joined(index)
        index.write(f"{self.path}/{target}/index")
        top = self.spark.read.parquet(f"{self.path}/{target}/documents").agg(F.max("internal_id")).first()[0]
        last = self._meta.get("replaced")
        self._save(tables=target, covered=batches, next_id=max(self._meta.get("next_id") or 0, 0 if top is None else top + 1), replaced=before)
        if last:
            delete(self.spark, f"{self.path}/{last}")
        return self

    def _current(self) -> None:
        if self._meta.get("covered") != self._meta["batches"] and not self.read_only:
            self.refresh()

    def stored(self) -> DataFrame:
        """The documents as last refreshed."""
        self._current()
        if not self._meta["tables"]:
            return self.documents()
        return self.spark.read.parquet(f"{self.path}/{self._meta['tables']}/documents")

    def index(self) -> Index:
        self._current()
        if not self._meta["tables"]:
            return build_index(self.documents(), self.schema, self.analyzer)
        return Index.read(self.spark, f"{self.path}/{self._meta['tables']}/index", self.schema, self.analyzer)

    def search(self, query: str, limit: int = 10, offset: int = 0, scorer: str | Scorer | None = None) -> Results:
        """One page of hits. The page is ranked first and only then joined to its documents."""
        resolve(scorer)
        index = self.index()
        hits = search(index, query, scorer, limit, offset)
        docs = self.stored()
        columns = [n for n in self.schema.names("stored") if n in docs.columns and n != self.schema.id_field]
        page = docs.join(F.broadcast(hits), docs["internal_id"] == hits["doc"]).select("rank", F.col(self.schema.id_field).alias("id"), "score", *columns).orderBy("rank")
        return Results(page, total_hits(index, query), query, scorer if isinstance(scorer, str) else "bm25" if scorer is None else "custom")

    def get(self, key: str) -> dict | None:
        row = self.stored().where(F.col(self.schema.id_field).cast("string") == key).first()
        return row.asDict(recursive=True) if row else None

    def by_internal_id(self, number: int) -> dict | None:
        row = self.stored().where(F.col("internal_id") == number).first()
        return row.asDict(recursive=True) if row else None

    def __contains__(self, key: str) -> bool:
        return not self.stored().where(F.col(self.schema.id_field).cast("string") == key).isEmpty()

    def __len__(self) -> int:
        return self.stored().count()

    def entries(self) -> tuple[int, int]:
        """Log entries and dead entries."""
        r = oplog.accounting(self.log()).first()
        return r.log_entries, r.dead_entries

    def should_compact(self) -> bool:
        n, dead = self.entries()
        return oplog.should_compact(n, n - dead, self.compact_ratio, self.compact_least)

    def compact(self) -> int:
        """Rewrite the log to its live puts; returns how many entries were dropped. The tables stay as they are."""
        self._may_write()
        self._current()
        n, dead = self.entries()
        old, new, batches = self._meta["log"], f"log-{self._meta['batches']:09d}", self._meta["batches"]
        live = oplog.compacted(self.log()).select("op", "id", "doc", "seq.*")
        live.write.mode("overwrite").json(f"{self.path}/{new}/batch=000000000")
        last = self._meta.get("replaced_log")
        self._save(log=new, batches=batches + 1, covered=batches + 1, replaced_log=old)
        if last:
            delete(self.spark, f"{self.path}/{last}")
        return dead

    def sync(self) -> bool:
        """Compact if it is due."""
        if not self.read_only and self.should_compact():
            self.compact()
            return True
        return False

    def close(self) -> None:
        if not self.read_only:
            self._save()
