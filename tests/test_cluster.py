import pytest
from pyspark.sql import functions as F

from skarn.functions.analyzer import Analyzer
from skarn.operators import cluster
from skarn.queries import queries

TOPICS = {"Economics": ["market shares fell on bank news", "inflation and interest rates rose", "the company reported profit growth"], "Entertainment": ["the film won an award", "the singer released an album", "actors praised the festival"], "Politics": ["ministers debated the election", "the party won the vote", "parliament passed the law"]}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i * 100 + k * 10 + n, f"{text} {n} {(label[:5].lower() + 'signal ') * 4}", label) for i, (label, texts) in enumerate(TOPICS.items()) for k, text in enumerate(texts) for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return docs, *cluster.ClusterModel.fit(docs, 3, min_df=1, restarts=3)


def test_fit_and_predict(spark, fitted):
    docs, model, assigned = fitted
    assert sorted(model.names.values()) == sorted(TOPICS)
    assert all(len(t) == 5 for t in model.top_terms(5).values())
    asked = spark.createDataFrame([(1, "econosignal market profit"), (2, "polit politsignal vote"), (3, None), (4, "zzz")], "doc_id long, text string")
    got = {r.doc_id: r for r in model.predict(asked).collect()}
    assert got[1].category == "Economics" and set(got[1].distances) == set(TOPICS) and 0 < got[1].margin < 1
    assert got[3].matched_term_count == 0 and got[4].matched_terms == [] and got[1].matched_term_count >= 2


def test_metrics(fitted):
    docs, model, assigned = fitted
    m = cluster.agreement(assigned).first()
    assert m.ari == 1.0 and m.v_measure == pytest.approx(m.nmi, abs=1e-6)
    r = cluster.report(model, assigned, ks=range(2, 4))
    assert sum(c["size"] for c in r["clusters"]) == 45 and r["metrics"]["accuracy"] == 1.0 and r["elbow"][0]["inertia"] >= r["elbow"][1]["inertia"]
    assert sum(v for row in r["confusion"] for k, v in row.items() if k != "label") == 45


def test_agreement_by_hand(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 1)], "label string, cluster int")
    m = cluster.agreement(df).first()
    assert m.ari == pytest.approx(0.324324, abs=1e-6)
    assert cluster.agreement(df.limit(0)).count() == 1
    one = cluster.agreement(df.withColumn("cluster", F.lit(0))).first()
    assert one.ari == 0.0 and one.completeness == 1.0


def test_save(spark, fitted, tmp_path):
    _, model, _ = fitted
    model.save(spark, f"file://{tmp_path}/m.json")
    assert cluster.ClusterModel.load(spark, f"file://{tmp_path}/m.json") == model
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(TypeError):
        cluster.ClusterModel.load(spark, f"file://{tmp_path}/x.json")


def test_projection_and_silhouette(spark, fitted):
    pts = spark.createDataFrame([(i, [float(i % 2 * 10), float(i)], i % 2) for i in range(8)], "k long, v array<double>, c int")
    exact = {r.k: r.silhouette for r in cluster.exact_silhouette(pts, "k", "v", "c").collect()}
    a, b = (2 + 4 + 6) / 3, sum((100 + d * d) ** 0.5 for d in (1, 3, 5, 7)) / 4
    assert exact[0] == pytest.approx((b - a) / b, abs=1e-6)
    with pytest.raises(ValueError):
        cluster.exact_silhouette(pts, "k", "v", "c", 5)
    xy = cluster.project(cluster.as_vectors(pts, "v"), "k").agg(F.abs(F.sum("x")), F.abs(F.sum("y"))).first()
    assert xy[0] < 0.01 and xy[1] < 0.01


def test_vocabulary(spark):
    terms = cluster.document_terms(spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, None)], "doc_id long, text string"), Analyzer(stem=False))
    assert [(r.term, r.df, r.total) for r in cluster.features(terms, 1, 1).collect()] == [("aa", 2, 3)]
    w = {(r.doc_id, r.term): r.weight for r in cluster.tfidf_weights(terms, cluster.features(terms, 10, 1), 3).collect()}
    assert w[1, "aa"] ** 2 + w[1, "bb"] ** 2 == pytest.approx(1.0)


def test_exact_silhouette_has_no_upper_limit(spark):
    pts = spark.range(5200).select(F.col("id").alias("k"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 2 * 10).cast("double")).alias("v"), (F.col("id") % 2).alias("c"))
    few = pts.where("k < 60")
    assert cluster.exact_silhouette(few, "k", "v", "c", block=13).orderBy("k").collect() == cluster.exact_silhouette(few, "k", "v", "c").orderBy("k").collect()
    assert cluster.exact_silhouette(pts, "k", "v", "c").where("silhouette > 0").count() == 5200


def test_registered_with_production_parameters(spark, tmp_path, monkeypatch):
    asked = []
    spark.createDataFrame([(i, [float(i % 3), float(i)], i % 3) for i in range(12)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"some words of text {i % 4}", "abcd"[i % 4]) for i in range(16)], "doc_id long, text string, category string").write.parquet(f"{tmp_path}/documents.parquet")
    fit = cluster.fit_kmeans
    monkeypatch.setattr(cluster, "fit_kmeans", lambda vectors, k, seed=42, restarts=10: asked.append((k, restarts)) or fit(vectors, k, seed, 1))
    assert [r.k for r in queries()["elbow_sweep"](spark, str(tmp_path)).collect()] == list(range(2, 9))
    queries()["kmeans_documents"](spark, str(tmp_path)).collect()
    assert asked == [(k, 10) for k in range(2, 9)] + [(4, 10)]
