"""Document clustering: term vectors, k-means, naming, prediction, evaluation and projection."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.analyzer import Analyzer
from skarn.functions.terms import term_counts
from skarn.session import scratch_path, written
from skarn.sources.files import read_text, replace_text


@dataclass(frozen=True)
class Vocabulary:
    """The terms of the vectors in alphabetical order, with their idf. Bounded by ``max_features``."""

    terms: list[str]
    idf: list[float]


def document_terms(docs: DataFrame, analyzer: Analyzer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, term, tf)`` counted within the row."""
    counted = docs.select(F.col(key).alias("doc_id"), F.array_sort(analyzer.analyze(F.coalesce(F.col(text), F.lit("")))).alias("_t")).select("doc_id", F.explode(term_counts(F.col("_t"))).alias("_c"))
    return counted.select("doc_id", F.col("_c.term").alias("term"), F.col("_c.n").alias("tf"))


def features(terms: DataFrame, max_features: int = 5000, min_df: int = 2) -> DataFrame:
    """``(term, df, total)``: the ``max_features`` terms with the highest total count among those in at least ``min_df`` documents; ties go by term."""
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return counted.orderBy(F.col("total").desc(), "term").limit(max_features)


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def tfidf_weights(terms: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """``(doc_id, term, weight)``: sublinear tf times smooth idf, each document of length 1. ``chosen`` is bounded and broadcast."""
    raw = terms.join(F.broadcast(chosen.select("term", "df")), "term").select("doc_id", "term", ((1 + F.ln("tf")) * smooth_idf(F.lit(n), F.col("df"))).alias("w"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def fit_vocabulary(terms: DataFrame, n: int, max_features: int = 5000, min_df: int = 2) -> Vocabulary:
    rows = sorted((r.term, r.df) for r in features(terms, max_features, min_df).collect())
    return Vocabulary([t for t, _ in rows], [math.log((1 + n) / (1 + d)) + 1 for _, d in rows])


def sparse_rows(docs: DataFrame, vocabulary: Vocabulary, analyzer: Analyzer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the arrays ``ix`` and ``ws`` of its vector, of length 1, and ``matched_terms`` by falling weight. A document without known terms has empty arrays."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, i, w) for i, (t, w) in enumerate(zip(vocabulary.terms, vocabulary.idf))], "term string, at int, idf double"))
    terms = document_terms(docs, analyzer, key, text).join(table, "term").select("doc_id", "term", "at", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    rows = terms.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "w", "term"))).alias("e"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    by_weight = F.array_sort(F.transform("e", lambda x: F.struct((-x["w"]).alias("v"), x["term"].alias("t"))))
    rows = rows.select(F.col("doc_id").alias(key), F.transform("e", lambda x: x["at"]).alias("ix"), F.transform("e", lambda x: x["w"] / F.col("norm")).alias("ws"), F.transform(by_weight, lambda x: x["t"]).alias("matched_terms"))
    empty = {"ix": "array<int>", "ws": "array<double>", "matched_terms": "array<string>"}
    return docs.join(rows, key, "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()})


def vectorise(docs: DataFrame, vocabulary: Vocabulary, analyzer: Analyzer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`sparse_rows` as ML vectors in ``features``, as a written table: a sparse vector is stored as a struct, so rows are
    written as that struct and read as vectors, without a function call per row."""
    rows = sparse_rows(docs, vocabulary, analyzer, key, text)
    stored = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(vocabulary.terms)).alias("size"), F.col("ix").alias("indices"), F.col("ws").alias("values"))
    plain = rows.withColumn("features", stored).drop("ix", "ws")
    path = scratch_path(docs.sparkSession, "vectors")
    plain.write.parquet(path)
    schema = T.StructType([T.StructField("features", VectorUDT()) if f.name == "features" else f for f in plain.schema.fields])
    return docs.sparkSession.read.schema(schema).parquet(path)


def fit_kmeans(vectors: DataFrame, k: int, seed: int = 42, restarts: int = 10, most_iterations: int = 300, at_once: int = 4) -> KMeansModel:
    """The fit with the least cost of ``restarts`` distributed fits, of which ``at_once`` run side by side, so that the small jobs of their iterations overlap; of equal costs the first seed counts."""

    def fit(i: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + i, maxIter=most_iterations, tol=1e-4).fit(vectors)

    with ThreadPoolExecutor(at_once) as pool:
        return min(pool.map(fit, range(restarts)), key=lambda m: m.summary.trainingCost)


def majority_names(assigned: DataFrame, k: int, label: str = "label", order: str = "doc_id") -> dict[int, str]:
    """A name for each cluster: its most frequent label, the first met on a tie, ``cluster-i`` for none."""
    votes = assigned.where(F.col(label).isNotNull()).groupBy("cluster", label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy("cluster").orderBy(F.col("n").desc(), "first")
    named = {r.cluster: r.name for r in votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cluster", F.col(label).alias("name")).collect()}
    return {i: named.get(i, f"cluster-{i}") for i in range(k)}


def distance_to(vector: Column, centre: list[float]) -> Column:
    return F.sqrt(F.aggregate(F.arrays_zip(vector.alias("a"), F.array(*[F.lit(float(x)) for x in centre]).alias("b")), F.lit(0.0), lambda s, z: s + (z["a"] - z["b"]) * (z["a"] - z["b"])))


def margin(distances: Column) -> Column:
    """1 - nearest / second nearest; 0 with fewer than two distances or at distance 0."""
    d = F.array_sort(distances)
    return F.when((F.size(d) < 2) | (F.get(d, F.lit(1)) == 0), 0.0).otherwise(1 - F.get(d, F.lit(0)) / F.get(d, F.lit(1)))


@dataclass
class ClusterModel:
    """A fitted model: vocabulary, centres and names. All bounded by ``max_features * k``, so it is sent to the tasks."""

    vocabulary: Vocabulary
    centres: list[list[float]]
    names: dict[int, str]
    analyzer: Analyzer

    @classmethod
    def fit(cls, docs: DataFrame, k: int = 3, analyzer: Analyzer | None = None, max_features: int = 5000, min_df: int = 2, seed: int = 42, restarts: int = 10, label: str | None = "label") -> tuple["ClusterModel", DataFrame]:
        """Fit on ``docs(doc_id, text, label)``; also gives the documents with ``features`` and ``cluster``."""
        analyzer = analyzer or Analyzer()
        terms = written(document_terms(docs, analyzer), "terms")
        vocabulary = fit_vocabulary(terms, docs.count(), max_features, min_df)
        vectors = vectorise(docs, vocabulary, analyzer)
        km = fit_kmeans(vectors, k, seed, restarts)
        assigned = written(km.transform(vectors).withColumnRenamed("prediction", "cluster"), "assigned")
        names = majority_names(assigned, k, label) if label else {i: f"cluster-{i}" for i in range(k)}
        return cls(vocabulary, [list(map(float, c)) for c in km.clusterCenters()], names, analyzer), assigned

    def predict(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``(key, cluster_id, category, distances, margin, matched_terms, matched_term_count)`` of every document.

        ``distances`` is keyed by category; of two clusters with one name the later counts. Distances use |x - c|^2 = |x|^2 - 2xc + |c|^2 on the sparse vector.
        """
        centres = np.array(self.centres)
        squares = (centres ** 2).sum(axis=1)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def distances(ix: pd.Series, ws: pd.Series) -> pd.Series:
            out = []
            for i, w in zip(ix, ws):
                w = np.asarray(w, float)
                i = np.asarray(i, int)
                out.append(np.sqrt(np.maximum((w ** 2).sum() - 2 * centres[:, i] @ w + squares, 0)).tolist())
            return pd.Series(out)

        v = sparse_rows(docs, self.vocabulary, self.analyzer, key, text)
        d = v.select(key, "matched_terms", distances("ix", "ws").alias("d"))
        name = F.create_map(*[F.lit(x) for i, n in self.names.items() for x in (i, n)])
        nearest = (F.array_position("d", F.array_min("d")) - 1).cast("int")
        last: dict[str, int] = {n: i for i, n in self.names.items()}
        by_name = F.map_from_arrays(F.array(*[F.lit(n) for n in last]), F.array(*[F.get("d", F.lit(i)) for i in last.values()]))
        return d.select(key, nearest.alias("cluster_id"), name[nearest].alias("category"), by_name.alias("distances"), margin(F.map_values(by_name)).alias("margin"), F.slice("matched_terms", 1, 8).alias("matched_terms"), F.size("matched_terms").alias("matched_term_count"))

    def top_terms(self, n: int = 10, distinctive: bool = True) -> dict[int, list[str]]:
        """The terms by which each centre stands out from the mean of the others, or its heaviest."""
        out = {}
        for i, c in enumerate(self.centres):
            others = [x for j, x in enumerate(self.centres) if j != i]
            w = [x - (sum(o[t] for o in others) / len(others) if distinctive and others else 0.0) for t, x in enumerate(c)]
            out[i] = [self.vocabulary.terms[t] for t in sorted(range(len(w)), key=lambda t: (-w[t], self.vocabulary.terms[t]))[:n]]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        replace_text(spark, path, json.dumps({"kind": "cluster-model", "terms": self.vocabulary.terms, "idf": self.vocabulary.idf, "centres": self.centres, "names": self.names, "analyzer": self.analyzer.config()}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClusterModel":
        d = json.loads(read_text(spark, path))
        if d.get("kind") != "cluster-model":
            raise TypeError(f"{path} holds no cluster model")
        return cls(Vocabulary(d["terms"], d["idf"]), d["centres"], {int(k): v for k, v in d["names"].items()}, Analyzer.from_config(d["analyzer"]))


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row ``(ari, nmi, homogeneity, completeness, v_measure)`` from the contingency table, which is labels times clusters in size."""
    t = contingency(df, label, cluster)
    rows = t.groupBy("label").agg(F.sum("n").alias("a"))
    cols = t.groupBy("cluster").agg(F.sum("n").alias("b"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = t.agg(F.sum("n")).scalar()
    entropy = lambda c: -F.sum(F.col(c) / total * F.ln(F.col(c) / total))
    mutual = F.sum(F.col("n") / total * F.ln(F.col("n") * total / (F.col("a") * F.col("b"))))
    joined = t.join(F.broadcast(rows), "label").join(F.broadcast(cols), "cluster")
    one = df.sparkSession.range(1).select(
        t.agg(pairs("n")).scalar().alias("s"), rows.agg(pairs("a")).scalar().alias("sa"), cols.agg(pairs("b")).scalar().alias("sb"), (total * (total - 1) / 2).alias("p"),
        joined.agg(mutual).scalar().alias("mi"), rows.agg(entropy("a")).scalar().alias("ha"), cols.agg(entropy("b")).scalar().alias("hb"))
    expected = F.col("sa") * F.col("sb") / F.col("p")
    most = (F.col("sa") + F.col("sb")) / 2
    ratio = lambda x, y: F.when(F.abs(y) < 1e-15, 1.0).otherwise(x / y)
    h, c = ratio(F.col("mi"), F.col("ha")), ratio(F.col("mi"), F.col("hb"))
    ari = F.when(F.col("p") == 0, 1.0).otherwise(ratio(F.col("s") - expected, most - expected))
    v = F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c))
    return one.select(*[F.round(x, 6).alias(n) for x, n in ((ari, "ari"), (ratio(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), "nmi"), (h, "homogeneity"), (c, "completeness"), (v, "v_measure"))])


def accuracy(df: DataFrame, label: str = "label", predicted: str = "category") -> DataFrame:
    return df.agg(F.round(F.avg((F.col(label) == F.col(predicted)).cast("int")), 6).alias("accuracy"))


def confusion(df: DataFrame, categories: list[str], label: str = "label", predicted: str = "category") -> DataFrame:
    """One row per true category with a column for each predicted one; predictions outside are dropped."""
    return df.groupBy(F.col(label).alias("label")).pivot(predicted, categories).agg(F.count(F.lit(1))).na.fill(0).where(F.col("label").isin(categories))


def mistakes(df: DataFrame, label: str = "label", predicted: str = "category") -> DataFrame:
    """``(label, predicted, n)`` of what went wrong, most frequent first."""
    return df.where(F.col(label) != F.col(predicted)).groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label", "predicted")


def silhouette(vectors: DataFrame, cluster: str = "cluster", column: str = "features", squared: bool = True) -> float:
    """The mean silhouette by distances to cluster statistics, one pass and linear in rows; ``squared=False`` is the cosine form. NaN for fewer than two clusters.

    The pairwise Euclidean silhouette is :func:`exact_silhouette`.
    """
    if vectors.select(cluster).distinct().count() < 2:
        return float("nan")
    return ClusteringEvaluator(predictionCol=cluster, featuresCol=column, distanceMeasure="squaredEuclidean" if squared else "cosine").evaluate(vectors)


def _distance_sums(at: np.ndarray, of: np.ndarray, groups: int):  # noqa: ANN202
    """A function of vector and sums that adds the distances to the points ``at`` by their groups ``of``."""

    @F.pandas_udf("array<double>")
    def add(v: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([s + np.bincount(of, np.sqrt(((at - np.asarray(x, float)) ** 2).sum(axis=1)), groups) for x, s in zip(v, sums)])

    return add


def exact_silhouette(points: DataFrame, key: str, vector: str, cluster: str, most: int | None = None, block: int = 5000) -> DataFrame:
    """``(key, silhouette)`` with Euclidean distances between all pairs, for any number of points; quadratic in time.

    About ``block`` points at a time are sent to the tasks and compared with all points, whose sums of distances to each
    cluster are carried along as an array. Raises above ``most`` points if that is given.
    """
    rows = written(points.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).alias("v")).withColumn("_row", F.monotonically_increasing_id()), "points")
    sizes = {r.c: r.n for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    if most is not None and n > most:
        raise ValueError(f"more than {most} points; use silhouette()")
    groups = sorted(sizes)
    number = {g: i for i, g in enumerate(groups)}
    blocks = max(1, -(-n // block))
    done = rows.withColumn("_sums", F.array_repeat(F.lit(0.0), len(groups)))
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == i).select("c", "v").collect()
        if not part:
            continue
        at, of = np.array([r.v for r in part], float), np.array([number[r.c] for r in part])
        done = written(done.withColumn("_sums", _distance_sums(at, of, len(groups))("v", "_sums")), "distances")

    @F.pandas_udf("double")
    def one(c: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for own, s in zip(c, sums):
            if sizes[own] < 2 or len(groups) < 2:
                out.append(0.0)
                continue
            a = s[number[own]] / (sizes[own] - 1)
            b = min(s[number[g]] / sizes[g] for g in groups if g != own)
            out.append((b - a) / max(a, b) if max(a, b) else 0.0)
        return pd.Series(out)

    return done.select(F.col("k").alias(key), F.round(one("c", "_sums"), 6).alias("silhouette"))


def elbow(vectors: DataFrame, ks: range, seed: int = 42, restarts: int = 1, label: str | None = None) -> DataFrame:
    """``(k, inertia, silhouette, ari)`` for each k; every fit is distributed."""
    rows = []
    for k in ks:
        m = fit_kmeans(vectors, k, seed, restarts)
        done = m.transform(vectors)
        ari = agreement(done, label, "prediction").first().ari if label else None
        rows.append((k, float(m.summary.trainingCost), float(silhouette(done, "prediction")), ari))
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, ari double")


def project(vectors: DataFrame, key: str = "doc_id", column: str = "features") -> DataFrame:
    """``(key, x, y)``: the two main axes of the centred vectors, to four decimals. The sign of an axis is arbitrary."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=column, outputCol="_c").fit(vectors).transform(vectors)
    done = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("_a", vector_to_array("_p"))
    return done.select(key, F.round(F.get("_a", F.lit(0)), 4).alias("x"), F.round(F.get("_a", F.lit(1)), 4).alias("y"))


def label_means(points: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, at, value)``: the mean vector of each label in long form."""
    long = points.select(F.col(label).alias("label"), F.posexplode(vector).alias("at", "value"))
    return long.groupBy("label", "at").agg(F.avg(F.col("value").cast("double")).alias("value"))


def as_vectors(points: DataFrame, column: str) -> DataFrame:
    """An array column as an ML vector in ``features``."""
    return points.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def report(model: ClusterModel, assigned: DataFrame, label: str = "label", ks: range = range(2, 9)) -> dict:
    """What a fit is worth: sizes, names, distinctive terms, metrics, confusion, elbow. Every part is bounded by clusters and categories."""
    named = assigned.withColumn("category", F.create_map(*[F.lit(x) for i, n in model.names.items() for x in (i, n)])[F.col("cluster")])
    categories = sorted(r[0] for r in assigned.where(F.col(label).isNotNull()).select(label).distinct().collect())
    sizes = {r.cluster: r.n for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        "vocabulary_size": len(model.vocabulary.terms), "clusters": [{"id": i, "category": n, "size": sizes.get(i, 0), "terms": model.top_terms(12)[i]} for i, n in model.names.items()],
        "metrics": agreement(assigned, label).first().asDict() | accuracy(named, label).first().asDict() | {"silhouette": silhouette(assigned)},
        "confusion": [r.asDict() for r in confusion(named, categories, label).collect()], "elbow": [r.asDict() for r in elbow(assigned.select("features", label), ks, label=label).collect()],
    }
