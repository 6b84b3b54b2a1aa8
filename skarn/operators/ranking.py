"""Ranked retrieval over the index: BM25 and TF-IDF with coordination, one query or many.

A single query is analyzed on the driver: its terms become a pushed-down filter on the
postings and its document frequencies a literal map, so the plan is one filtered scan, one
aggregate and a top-k, without a join. Many queries are a table that is joined to the
postings by term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.index import Index


@dataclass(frozen=True)
class Inputs:
    """The columns a scorer sees for one posting of one query."""

    tf: Column
    qtf: Column
    df: Column
    n: Column
    length: Column
    average: Column
    norm: Column


@dataclass(frozen=True)
class Scorer:
    """What one posting adds to the score, and whether the sum is scaled by the share of the query's terms that the document holds."""

    part: Callable[[Inputs], Column]
    coordinated: bool = True
    options: dict = field(default_factory=dict)


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(k1: float = 1.2, b: float = 0.75, coordinated: bool = True) -> Scorer:
    """Saturating term frequency with length normalisation; how often the query holds a term doesn't count."""

    def part(x: Inputs) -> Column:
        return F.when(x.average > 0, bm25_idf(x.n, x.df) * x.tf * (k1 + 1) / (x.tf + k1 * (1 - b + b * x.length / x.average))).otherwise(0.0)

    return Scorer(part, coordinated, {"k1": k1, "b": b})


def tf_idf(coordinated: bool = True) -> Scorer:
    """Logarithmic tf normalised per field, times idf, times the query's logarithmic tf; the query side isn't normalised."""

    def part(x: Inputs) -> Column:
        return F.when(x.norm > 0, (1 + F.log10(x.qtf)) * F.log10(x.n / x.df) * (1 + F.log10(x.tf)) / x.norm).otherwise(0.0)

    return Scorer(part, coordinated)


SCORERS: dict[str, Callable[[], Scorer]] = {"bm25": bm25, "tf-idf": tf_idf}
DEFAULT_SCORER = "bm25"


def resolve(scorer: str | Scorer | None) -> Scorer:
    if isinstance(scorer, Scorer):
        return scorer
    name = scorer or DEFAULT_SCORER
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[name]()


def _literals(values: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key] if values else F.lit(0.0)


def _scored(rows: DataFrame, index: Index, scorer: Scorer, keys: list[str], qtf: Column, df: Column, found: Column) -> DataFrame:
    weights = _literals(index.schema.weights(), F.col("field"))
    x = Inputs(F.col("tf"), qtf, df, F.lit(index.document_count()), F.col("length"), _literals(index.average_lengths(), F.col("field")), F.col("norm"))
    summed = rows.withColumn("_part", F.coalesce(weights, F.lit(0.0)) * scorer.part(x)).withColumn("_found", found).groupBy(*keys, "doc").agg(F.sum("_part").alias("score"), F.count_distinct("term").alias("_held"), F.first("_found").alias("_found"))
    if scorer.coordinated:
        summed = summed.withColumn("score", F.when(F.col("_found") < 2, F.col("score")).otherwise(F.col("score") * F.col("_held") / F.col("_found")))
    return summed.select(*keys, "doc", F.round("score", 9).alias("score"))


def score(index: Index, query: str, scorer: str | Scorer | None = None) -> DataFrame:
    """``(doc, score)`` of every document that holds a term of the query, a score of 0 included. An empty query scores nothing."""
    scorer = resolve(scorer)
    bag = Counter(index.analyzer.analyze_text(query))
    rows = index.lookup(list(bag)) if bag else index.postings.limit(0)
    frequency = index.frequencies(list(bag)) if bag else {}
    term = F.col("term")
    return _scored(rows, index, scorer, [], _literals(dict(bag), term), _literals(frequency, term), F.lit(len(frequency)))


def search(index: Index, query: str, scorer: str | Scorer | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """``(rank, doc, score)`` of one page, by score and then document; the ranking is a top-k, not a sort of all hits."""
    page = score(index, query, scorer).orderBy(F.col("score").desc(), "doc").offset(offset).limit(limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc")) + F.lit(offset)).select("rank", "doc", "score")


def search_many(index: Index, queries: DataFrame, scorer: str | Scorer | None = None, k: int = 10) -> DataFrame:
    """``(query_id, rank, doc, score)``: the ``k`` best of each of ``queries(query_id, text)``.

    The queries' terms are joined to the postings by term; Spark picks the way by the size of the query side. A row
    per query and document is kept only until the group limit.
    """
    scorer = resolve(scorer)
    bags = queries.select("query_id", F.explode(index.analyzer.analyze(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    known = bags.join(index.term_stats(), "term").withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    scored = _scored(index.postings.join(known, "term"), index, scorer, ["query_id"], F.col("qtf"), F.col("df"), F.col("found"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def total_hits(index: Index, query: str) -> int:
    terms = sorted(set(index.analyzer.analyze_text(query)))
    return index.lookup(terms).select(F.count_distinct("doc")).first()[0] if terms else 0


def match_counts(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, any_term, all_terms)``: documents that hold at least one term, and all terms, of each query."""
    bags = queries.select("query_id", F.explode(F.array_distinct(index.analyzer.analyze(F.col("text")))).alias("term"))
    size = bags.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    held = index.postings.select("term", "doc").distinct().join(bags, "term").groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("_k"))
    return held.join(size, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("any_term"), F.count_if(F.col("_k") == F.col("_n")).alias("all_terms"))


def top_agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(query_id, agree)``: whether two rankings of :func:`search_many` have the same first hit."""
    first = lambda df, name: df.where("rank = 1").select("query_id", F.col("doc").alias(name))
    return first(one, "_a").join(first(other, "_b"), "query_id", "full_outer").select("query_id", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("agree"))


def explain_bm25(index: Index, term: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Every intermediate value of one term's score in each document and field."""
    rows = index.lookup([term])
    df = index.document_frequency(term)
    average = _literals(index.average_lengths(), F.col("field"))
    idf = bm25_idf(F.lit(index.document_count()), F.lit(df))
    ratio = F.col("length") / average
    denominator = F.col("tf") + k1 * (1 - b + b * ratio)
    return rows.select("doc", "field", "tf", "length", F.round(idf, 6).alias("idf"), F.round(ratio, 6).alias("ratio"), F.round(denominator, 6).alias("denominator"),
                       F.round(F.col("tf") * (k1 + 1) / denominator, 6).alias("saturation"), F.round(idf * F.col("tf") * (k1 + 1) / denominator, 6).alias("score"))


def idf_table(index: Index, frequencies: list[int]) -> DataFrame:
    """``(df, idf)``: what a term of so many documents weighs in this collection."""
    return index.spark.createDataFrame([(d,) for d in frequencies], "df long").withColumn("idf", F.round(bm25_idf(F.lit(index.document_count()), F.col("df")), 6))


def length_sweep(index: Index, term: str, bs: list[float], k1: float = 1.2) -> DataFrame:
    """``(doc, field, b, score)``: one term's score under several strengths of length normalisation."""
    one = None
    for b in bs:
        part = explain_bm25(index, term, k1, b).select("doc", "field", F.lit(float(b)).alias("b"), "score")
        one = part if one is None else one.unionByName(part)
    return one


def saturation_curve(index: Index, tfs: list[int], k1: float = 1.2) -> DataFrame:
    """``(tf, saturation)`` for a document of average length."""
    return index.spark.createDataFrame([(t,) for t in tfs], "tf int").withColumn("saturation", F.round(F.col("tf") * (k1 + 1) / (F.col("tf") + k1), 6))
