import math
from collections import Counter

from pyspark.sql import functions as F

from skarn.llm.termstats import record_terms, term_frequencies, term_scores, top_terms

ROWS = [("a", "Sleep sleep well", "covid-19 don't 2020"), ("b", "sleep", None), ("c", None, ""), ("d", "well WELL well", "x " * 5000), ("e", "sleep", "the")]


def _docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id string, t string, u string").withColumns({c: F.lit(1) for c in ("term", "tf", "n", "records", "score", "length", "_key")})


def test_counts(spark):
    got = {(r.id, r.term): (r.tf, r.length) for r in record_terms(_docs(spark), ["t", "u"]).collect()}
    assert got == {("a", "sleep"): (2, 5), ("a", "well"): (1, 5), ("a", "covid-19"): (1, 5), ("a", "don't"): (1, 5), ("b", "sleep"): (1, 1), ("d", "well"): (3, 5003), ("d", "x"): (5000, 5003), ("e", "sleep"): (1, 2), ("e", "the"): (1, 2)}


def test_marks(spark):
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(_docs(spark), ["t", "u"]).collect()}
    assert got["sleep"] == (4, 3, "common") and got["x"] == (5000, 1, "rare") and got["well"] == (4, 2, "rare")
    assert term_frequencies(_docs(spark).limit(0), ["t"]).count() == 0
    border = spark.createDataFrame([(str(i), "w" if i < 3 else "") for i in range(15)], "id string, t string")
    assert term_frequencies(border, ["t"]).first().mark is None


def test_scores_against_brute_force(spark):
    texts = [f"{'common ' * (i % 3 + 1)} w{i % 7} w{i % 11} only{i}" for i in range(250)]
    docs = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "id string, t string")
    tf = {f"{i:03}": Counter(t.split()) for i, t in enumerate(texts)}
    df = Counter(w for c in tf.values() for w in c)
    plain = {(r.id, r.term): r.score for r in term_scores(docs, ["t"], k1=None, form="plain", least_records=2).collect()}
    assert plain == {(i, w): round(n * math.log(250 / df[w]), 6) for i, c in tf.items() for w, n in c.items() if df[w] > 1}
    mean = sum(map(Counter.total, tf.values())) / 250
    full = {(r.id, r.term): r.score for r in term_scores(docs, ["t"]).collect()}
    for (i, w), s in full.items():
        n = tf[i][w]
        assert abs(s - math.log(1 + (250 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * tf[i].total() / mean))) < 1e-5
    assert len(full) == sum(map(len, tf.values()))
    assert term_scores(docs.limit(0), ["t"]).count() == 0


def test_ties_go_by_term(spark):
    docs = spark.createDataFrame([("a", "d c b a"), ("b", "a b c d"), ("c", "z")], "id string, t string")
    got = top_terms(term_scores(docs, ["t"], k1=None, form="plain", least_records=2), 3)
    assert sorted((r.id, r.term) for r in got.collect()) == [(i, t) for i in "ab" for t in "abc"]
