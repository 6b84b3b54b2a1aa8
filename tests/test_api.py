import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skarn import api
from skarn.collection import Collection
from skarn.functions.analyzer import Analyzer
from skarn.functions import scalars
from skarn.operators.cluster import ClusterModel, Vocabulary
from skarn.plans.schema import PUBLICATIONS
from skarn.sources.archive import PUBLICATION
from skarn.sources.corpus import write_provenance
from skarn.sources.schedule import JobState, run_forever


@pytest.fixture(scope="module")
def publications(spark, tmp_path_factory):
    c = Collection.open(spark, f"file://{tmp_path_factory.mktemp('api')}/c", PUBLICATIONS, Analyzer(), "publications")
    rows = [("pub/1", "Diabetes prevention", "u", [("Alice Smith", ""), ("Bob Jones", None)], [], "A trial", "J", "2023", "", "", "2026-08-01T00:00:00Z"),
            ("pub/2", "Sleep of students", "u", [("Carol Lee", "x")], [], "", "J", "2022", "", "", "2026-08-02T00:00:00Z"),
            ("pub/3", "More on diabetes", "u", [("Alice Smith", "y")], [], None, "J", "2024", "", "", "2026-08-03T00:00:00Z")]
    c.add_many(spark.createDataFrame(rows, PUBLICATION))
    return c


def test_surface(publications):
    r = api.search(publications, "diabetes")
    assert {h["id"] for h in r["hits"]} == {"pub/1", "pub/3"} and r["total"] == 2
    assert api.search(publications, "")["total"] == 0 and api.health(publications) == {"status": "ok", "documents": 3} and api.score_ceiling(publications) == 7.0
    with pytest.raises(ValueError):
        api.search(publications, "x", limit=0)
    assert [p["id"] for p in api.publications(publications, 2)["publications"]] == ["pub/3", "pub/1"]
    a = api.author(publications, "Alice Smith")
    assert (a["publication_count"], a["co_author_count"], a["first_year"], a["last_year"], a["profile_url"]) == (2, 1, "2023", "2024", "y") and a["publications"][0]["id"] == "pub/3"
    with pytest.raises(KeyError):
        api.author(publications, "Alice")
    s = api.stats(publications)
    assert (s["document_count"], s["last_crawled_at"], s["scorers"]) == (3, "2026-08-03T00:00:00Z", ["bm25", "tf-idf"])
    assert api.documents(publications, "1", "1")["documents"][0]["id"] == "pub/2"
    assert api.documents(publications, contains="ALICE")["total"] == 2 and api.documents(publications, contains="learnings")["total"] == 0
    assert api.describe(publications)["log_entries"] == 3 and len(api.reload(publications)) == 3


def test_schedule(spark, tmp_path):
    state = JobState(spark, f"file://{tmp_path}/state.json")
    (tmp_path / "state.json").write_text("not json")
    assert state.read() == {} and state.is_due(60) and state.next_run(60) is None
    stop, seen = threading.Event(), []

    def job():
        seen.append(1)
        if len(seen) == 1:
            raise RuntimeError("once")
        stop.set()

    assert run_forever(job, state, 0.0, stop) == 2
    state.write(last_run="2026-01-01T00:00:00+05:45")
    at = datetime(2025, 12, 31, 18, 15, tzinfo=timezone.utc)
    assert state.seconds_until_due(60, at + timedelta(seconds=20)) == 40 and state.next_run(60) == at + timedelta(seconds=60) and state.read()["error"] == "once"


def test_service(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return ClusterModel(Vocabulary(["art", "bank"], [1.0, 1.0]), [[1.0, 0.0], [0.0, 1.0]], {0: "Arts", 1: "Money"}, Analyzer(stem=False))

    path = f"file://{tmp_path}/m.json"
    assert api.ClusterService(spark, path, build).classify("the bank")["category"] == "Money"
    assert api.ClusterService(spark, path, build).classify("art bank art")["category"] == "Arts" and built == [1]
    with pytest.raises(ValueError):
        api.ClusterService(spark, path, build).classify("")
    with pytest.raises(LookupError):
        api.ClusterService(spark, path, build).overview()
    other = f"file://{tmp_path}/n.json"
    assert api.ClusterService(spark, other, lambda: (build(), {"vocabulary_size": 2})).overview() == {"vocabulary_size": 2} == api.ClusterService(spark, other, build).overview()


def test_provenance_and_plots(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, label string")
    assert write_provenance(docs, docs.limit(0), ["a", "b"], "x.zip", f"file://{tmp_path}/p.json") == {"source": "x.zip", "seed": 42, "available": {"a": 2, "b": 1}, "sampled": {"a": 0, "b": 0}}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.scaled(F.lit(3.0), F.lit(1.0), F.lit(5.0), 100.0)) == 50.0 and one(scalars.scaled(F.lit(4.0), F.lit(4.0), F.lit(4.0), 10.0)) == 0.0
    assert one(scalars.metric_text(F.lit("accuracy"), F.lit(0.968))) == "96.8%" and one(scalars.misplaced(F.lit("a"), F.lit("b"))) is True


def test_code_is_shipped_once(spark):
    from skarn.session import ship_code

    ship_code(spark)
    first = list(spark.sparkContext._python_includes)
    ship_code(spark)
    assert spark.sparkContext._python_includes == first and "skarn.zip" in first
