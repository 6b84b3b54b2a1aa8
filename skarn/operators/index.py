"""The fielded inverted index as tables.

Positions, lengths and norms of a field are found within its row, so the postings are built
without an exchange; they carry length and norm, so that scoring joins no statistics per
document. A written index is ranged and sorted by term and holds its statistics beside it: a query
reads only the row groups that hold its terms, and neither counts documents nor sums lengths.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.analyzer import Analyzer
from skarn.functions.terms import runs
from skarn.plans.schema import CollectionSchema, field_texts
from skarn.session import written
from skarn.sources.files import exists, read_text, replace_text


def term_positions(terms: Column) -> Column:
    """Terms in order as ``array<struct<term, positions>>``, one entry per distinct term, in linear time after a sort."""
    pairs = F.array_sort(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    found = runs(pairs, lambda p: p["term"], lambda a, x, end: F.struct(F.get(a, x)["term"].alias("term"), F.transform(F.slice(a, x + 1, end - x), lambda p: p["pos"]).alias("positions")))
    return F.coalesce(found, F.array().cast("array<struct<term:string,positions:array<int>>>"))


@dataclass
class Index:
    """``postings(term, doc, field, tf, positions, length, norm)``, ``fields(doc, field, length, norm)``, ``docs(doc)``; all other statistics are derived, or read where a written index has them: ``terms(term, df)`` and the figures in ``known``."""

    postings: DataFrame
    fields: DataFrame
    docs: DataFrame
    schema: CollectionSchema
    analyzer: Analyzer
    terms: DataFrame | None = None
    known: dict | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def statistics(self) -> dict:
        """``documents``, all of them, also those without terms, and the ``totals`` of terms by field. One row per field."""
        if self.known is None:
            totals = {r.field: r.n for r in self.fields.groupBy("field").agg(F.sum("length").alias("n")).collect()}
            self.known = {"documents": self.docs.count(), "totals": totals}
        return self.known

    def document_count(self) -> int:
        return self.statistics()["documents"]

    def contains(self, doc: object) -> bool:
        return not self.docs.where(F.col("doc") == doc).isEmpty()

    def term_stats(self) -> DataFrame:
        """``(term, df)``: documents that hold the term in any field."""
        return self.terms if self.terms is not None else self.postings.groupBy("term").agg(F.count_distinct("doc").alias("df"))

    def field_stats(self) -> DataFrame:
        """``(field, total_length, average_length)``; the average is over all documents, also those that lack the field."""
        n = max(self.document_count(), 1)
        return self.fields.groupBy("field").agg(F.sum("length").alias("total_length")).withColumn("average_length", F.col("total_length") / F.lit(n))

    def average_lengths(self) -> dict[str, float]:
        figures = self.statistics()
        return {f: figures["totals"].get(f, 0) / max(figures["documents"], 1) for f in self.schema.weights()}

    def vocabulary_size(self) -> int:
        return self.terms.count() if self.terms is not None else self.postings.select(F.count_distinct("term")).first()[0]

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of the terms; the filter reaches the scan."""
        return self.postings.where(F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """The document frequencies of those of ``terms`` that occur."""
        rows = self.terms.where(F.col("term").isin(terms)) if self.terms is not None else self.lookup(terms).groupBy("term").agg(F.count_distinct("doc").alias("df"))
        return {r.term: r.df for r in rows.collect()}

    def document_frequency(self, term: str) -> int:
        return self.frequencies([term]).get(term, 0)

    def document_lengths(self) -> DataFrame:
        return self.fields.groupBy("doc").agg(F.sum("length").alias("length"))

    def terms_in_documents(self) -> DataFrame:
        return self.postings.select("doc", "term").distinct()

    def matching_all(self, terms: list[str]) -> DataFrame:
        """Documents that hold every term (distinct)."""
        wanted = sorted(set(terms))
        return self.lookup(wanted).groupBy("doc").agg(F.count_distinct("term").alias("k")).where(F.col("k") == len(wanted)).select("doc")

    def without(self, ids: DataFrame) -> "Index":
        """The index without the documents of ``ids(doc)``; statistics follow."""
        keep = lambda df: df.join(ids.select("doc").distinct(), "doc", "left_anti")
        return Index(keep(self.postings), keep(self.fields), keep(self.docs), self.schema, self.analyzer)

    def replaced_by(self, new: "Index") -> "Index":
        """Upsert: documents of ``new`` take the place of those with their ids."""
        return self.without(new.docs).joined(new)

    def joined(self, new: "Index") -> "Index":
        """Both indexes as one; their documents must differ."""
        return Index(self.postings.unionByName(new.postings), self.fields.unionByName(new.fields), self.docs.unionByName(new.docs), self.schema, self.analyzer)

    def write(self, path: str, partitions: int | None = None) -> "Index":
        """Write tables and figures under ``path`` and read them back. Only a complete index has its figures."""
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.spark.read.schema(self.postings.schema).parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.count_distinct("doc").alias("df")).repartitionByRange(max(1, n // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.fields.write.mode("overwrite").parquet(f"{path}/fields")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        plain = Index(*(self.spark.read.schema(df.schema).parquet(f"{path}/{t}") for t, df in (("postings", self.postings), ("fields", self.fields), ("docs", self.docs))), self.schema, self.analyzer)
        replace_text(self.spark, f"{path}/statistics.json", json.dumps(plain.statistics()))
        return Index.read(self.spark, path, self.schema, self.analyzer)

    @classmethod
    def read(cls, spark: SparkSession, path: str, schema: CollectionSchema, analyzer: Analyzer) -> "Index":
        if not exists(spark, f"{path}/statistics.json"):
            raise FileNotFoundError(f"no complete index under {path}")
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "fields", "docs")), schema, analyzer, spark.read.parquet(f"{path}/terms"), json.loads(read_text(spark, f"{path}/statistics.json")))


def build_index(docs: DataFrame, schema: CollectionSchema, analyzer: Analyzer, doc: str = "internal_id", keep: bool = False) -> Index:
    """The index of a table with one row per ``doc``. A null field is skipped, an empty one has length 0.

    With ``keep`` the analysis is written once to the shared folder, for an index that is read several times.
    """
    texts = field_texts(docs.where(F.col(doc).isNotNull()), schema, doc)
    analyzed = texts.select("doc", "field", analyzer.analyze(F.col("text")).alias("terms"))
    return _index(analyzed, docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc")), schema, analyzer, keep)


def index_from_terms(analyzed: DataFrame, schema: CollectionSchema, analyzer: Analyzer | None = None) -> Index:
    """The index of ``analyzed(doc, field, terms)``: texts that are already terms."""
    return _index(analyzed, analyzed.select("doc").distinct(), schema, analyzer or Analyzer())


def _index(analyzed: DataFrame, docs: DataFrame, schema: CollectionSchema, analyzer: Analyzer, keep: bool = False) -> Index:
    grouped = analyzed.select("doc", "field", F.size("terms").alias("length"), term_positions(F.col("terms")).alias("found"))
    norm = F.sqrt(F.aggregate("found", F.lit(0.0), lambda a, x: a + F.pow(1 + F.log10(F.size(x["positions"])), F.lit(2.0))))
    fields = grouped.select("doc", "field", "length", norm.alias("norm"), "found")
    if keep:
        fields = written(fields, "analysis")
    postings = fields.select("doc", "field", "length", "norm", F.explode("found").alias("_p")).select(
        F.col("_p.term").alias("term"), "doc", "field", F.size("_p.positions").alias("tf"), F.col("_p.positions").alias("positions"), "length", "norm")
    return Index(postings, fields.drop("found"), docs, schema, analyzer)
