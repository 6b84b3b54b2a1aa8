import math
import pytest
from pyspark.sql import functions as F

from skarn.functions.analyzer import Analyzer
from skarn.operators import browse, ranking
from skarn.operators.index import build_index, index_from_terms
from skarn.plans.schema import CollectionSchema, Field

SCHEMA = CollectionSchema((Field("id", indexed=False), Field("title", weight=3.0), Field("abstract")))


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(1, "title", ["machin", "learn", "diabet"]), (1, "abstract", ["machin", "learn"]), (2, "title", ["commun", "health"]), (2, "abstract", ["health", "outcom"]), (3, "title", ["deep", "learn"]), (3, "abstract", ["machin", "learn", "deep"])]
    return index_from_terms(spark.createDataFrame(rows, "doc long, field string, terms array<string>"), SCHEMA)


def test_index(spark, terms):
    p = {(r.field): r.positions for r in terms.lookup(["learn"]).where("doc = 3").collect()}
    assert p == {"title": [1], "abstract": [1]}
    assert [terms.document_frequency(t) for t in ("learn", "diabet", "absent")] == [2, 1, 0]
    assert terms.document_count() == 3 and terms.vocabulary_size() == 7
    assert {r.doc for r in terms.matching_all(["machin", "learn"]).collect()} == {1, 3}
    assert terms.average_lengths()["title"] == pytest.approx(7 / 3)
    new = index_from_terms(spark.createDataFrame([(1, "title", ["nutrit"]), (1, "abstract", [])], "doc long, field string, terms array<string>"), SCHEMA)
    up = terms.replaced_by(new)
    assert [up.document_frequency(t) for t in ("diabet", "nutrit")] == [0, 1] and up.document_count() == 3
    gone = terms.without(spark.createDataFrame([(3,)], "doc long"))
    assert gone.document_count() == 2 and gone.document_frequency("deep") == 0 and gone.average_lengths()["title"] == 2.5


def test_empty_index(spark):
    none = index_from_terms(spark.createDataFrame([], "doc long, field string, terms array<string>"), SCHEMA)
    assert none.average_lengths() == {"title": 0.0, "abstract": 0.0}
    assert ranking.search(none, "anything").count() == 0


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", "Diabetes prevention in adults", "A trial of diabetes prevention."),
            ("b", "Community health outcomes", "Diabetes is mentioned once here among many other topics including nutrition, exercise, housing and social care."),
            ("c", "Machine learning methods", "Neural networks and deep learning.")]
    return build_index(spark.createDataFrame(rows, "id string, title string, abstract string").cache(), SCHEMA, Analyzer(), "id")


@pytest.mark.parametrize("scorer", ["bm25", "tf-idf"])
def test_order_and_totals(small, scorer):
    hits = ranking.search(small, "diabetes", scorer).collect()
    assert [h.doc for h in hits] == ["a", "b"] and all(h.score > 0 for h in hits)
    assert ranking.search(small, "machine learning", scorer).first().doc == "c"
    assert {h.doc for h in ranking.search(small, "DIABETIC", scorer).collect()} == {"a", "b"}
    assert all(ranking.total_hits(small, q) == 0 for q in ("the of and", "", "unmatched"))
    whole = [h.doc for h in ranking.search(small, "diabetes health learning", scorer).collect()]
    assert [h.doc for o in (0, 2) for h in ranking.search(small, "diabetes health learning", scorer, 2, o).collect()] == whole and len(whole) == 3


def test_unknown_scorer(small):
    with pytest.raises(ValueError):
        ranking.search(small, "x", "nope")


def test_many_equals_one(spark, small):
    q = spark.createDataFrame([(1, "diabetes health"), (2, "learning"), (3, "the")], "query_id int, text string")
    many = {(r.query_id, r.rank): (r.doc, r.score) for r in ranking.search_many(small, q, k=5).collect()}
    for i, t in ((1, "diabetes health"), (2, "learning")):
        for r in ranking.search(small, t).collect():
            assert many[i, r["rank"]] == (r.doc, r.score)
    assert not [k for k in many if k[0] == 3]


def test_coverage_goldens(spark):
    one = CollectionSchema((Field("body"),))
    rows = [("both", "sleep students"), ("half", "sleep sleep sleep")] + [(f"filler{i}", "students seminar timetable campus") for i in range(8)]
    ix = build_index(spark.createDataFrame(rows, "id string, body string").cache(), one, Analyzer(), "id")
    raw = {r.doc: r.score for r in ranking.score(ix, "sleep students", ranking.bm25(coordinated=False)).collect()}
    assert (raw["both"], raw["half"], raw["filler0"]) == pytest.approx((2.005085, 2.426612, 0.141897), abs=1e-6)
    cov = {r.doc: r.score for r in ranking.score(ix, "sleep students unknownterm").collect()}
    assert (cov["both"], cov["half"], cov["filler0"]) == pytest.approx((2.005085, 1.213306, 0.070948), abs=1e-6)
    tf = {r.doc: r.score for r in ranking.score(ix, "sleep students", "tf-idf").collect()}
    assert (tf["both"], tf["half"], tf["filler0"]) == pytest.approx((0.526602, 0.349485, 0.011439), abs=1e-6)


def test_zero_idf_is_still_a_hit(spark):
    ix = build_index(spark.createDataFrame([("a", "health study"), ("b", "health study")], "id string, title string").cache(), SCHEMA, Analyzer(), "id")
    assert [r.score for r in ranking.search(ix, "health", "tf-idf").collect()] == [0.0, 0.0]
    assert all(r.score > 0 for r in ranking.search(ix, "health").collect())


def test_worked_example(spark):
    one = CollectionSchema((Field("body"),))
    rows = [(1, "body", ["diabet", "x", "y"]), (2, "body", ["diabet"] * 3 + ["x", "y"]), (3, "body", ["diabet"] + ["z"] * 7), (4, "body", ["q", "r", "s"])]
    ix = index_from_terms(spark.createDataFrame(rows, "doc long, field string, terms array<string>"), one)
    got = {r.doc: r for r in ranking.explain_bm25(ix, "diabet").collect()}
    assert got[1].idf == pytest.approx(0.356675, abs=1e-6)
    assert [got[i].score for i in (1, 2, 3)] == pytest.approx([0.419972, 0.554238, 0.278673], abs=1e-6)
    assert [r.saturation for r in ranking.saturation_curve(ix, [1, 2, 1000]).collect()] == pytest.approx([1.0, 1.375, 2.1974], abs=1e-4)
    assert [{r.doc: r.score for r in ranking.explain_bm25(ix, "diabet", b=b).collect()}[3] for b in (0.0, 1.0)] == pytest.approx([0.356675, 0.259739], abs=1e-6)


def test_written_index_prunes_by_term(spark, small, tmp_path):
    ix = small.write(str(tmp_path / "ix"), 2)
    assert "PushedFilters: [In(term" in ix.lookup(["diabet", "x"])._jdf.queryExecution().toString()
    assert [r.doc for r in ranking.search(ix, "diabetes").collect()] == ["a", "b"]


def test_field_texts(spark):
    s = CollectionSchema((Field("id", indexed=False), Field("authors"), Field("year"), Field("tags")))
    df = spark.sql("SELECT 1 AS id, array(named_struct('name', 'Alice', 'text', 'z'), named_struct('name', '', 'text', 'Bo')) AS authors, 2024 AS year, array('x1', null) AS tags UNION ALL SELECT 2, null, null, null")
    ix = build_index(df, s, Analyzer(stem=False), "id")
    assert {r.term for r in ix.postings.collect()} == {"alice", "bo", "2024", "x1", "none"} and ix.document_count() == 2


@pytest.fixture(scope="module")
def pubs(spark):
    a = "array<struct<name:string,profile_url:string>>"
    rows = [("pub/1", 0, "Diabetes prevention", [("Alice Smith", ""), ("Bob Jones", None)], "2023", "2026-08-01T00:00:00Z"), ("pub/2", 1, "Sleep", [("Carol Lee", "u")], "2022", "2026-08-02T00:00:00Z"), ("pub/3", 2, "More diabetes", [("Alice Smith", "v"), ("Alice Smith", "w")], "2024", "2026-08-03T00:00:00Z")]
    return spark.createDataFrame(rows, f"id string, internal_id long, title string, authors {a}, year string, crawled_at string")


def test_browse(pubs):
    assert [r.id for r in browse.newest(pubs, ["id"], 2).collect()] == ["pub/3", "pub/1"]
    assert [r.id for r in browse.newest(pubs, ["id"], 2, 2).collect()] == ["pub/2"]
    r = browse.author_rollups(pubs).where("name = 'Alice Smith'").first()
    assert (r.publication_count, r.co_author_count, r.profile_url, r.first_year, r.last_year) == (2, 1, "v", "2023", "2024")
    assert browse.by_author(pubs, "Alice").count() == 0
    assert browse.containing(pubs, "DIABETES", ["title"]).count() == 2 and browse.containing(pubs, "title", ["title"]).count() == 3
    assert browse.with_total(pubs).first().total == 3
    for bad in ((0, 0), (1000, 0), (10, -1)):
        with pytest.raises(ValueError):
            browse.check_window(*bad)
    assert browse.clamp_window("x", -4) == (20, 0) and browse.clamp_window(9999, "7") == (200, 7)


def test_schema_rules():
    for bad in (lambda: CollectionSchema((Field("x", weight=0),)), lambda: CollectionSchema((Field("a"), Field("x", False, False))), lambda: CollectionSchema((Field("a"), Field("a"))), lambda: CollectionSchema((Field("a", indexed=False),))):
        with pytest.raises(ValueError):
            bad()
    assert CollectionSchema.from_dict(SCHEMA.to_dict()) == SCHEMA and SCHEMA.weights() == {"title": 3.0, "abstract": 1.0}
    with pytest.raises(KeyError):
        SCHEMA.field("nope")


def test_describe(terms):
    rows = {r.field: r for r in browse.describe_fields(terms).collect()}
    assert rows["title"].average_length == 2.3 and rows["id"].average_length is None


def test_match_counts(spark, small):
    q = spark.createDataFrame([(1, "diabetes health")], "query_id int, text string")
    r = ranking.match_counts(small, q).first()
    assert (r.any_term, r.all_terms) == (2, 1)
    same = ranking.search_many(small, q, k=1)
    assert ranking.top_agreement(same, same).select(F.min("agree")).first()[0] is True


def test_a_kept_index_reads_only_its_terms(spark, small, tmp_path):
    kept = small.write(f"file://{tmp_path}/index")
    plan = kept.lookup(["diabetes", "health"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "In(term, [diabetes,health])" in plan
    scan = plan[plan.index("FileScan"):]
    assert "positions" in scan
    for scorer in ("bm25", "tf-idf"):
        assert ranking.search(kept, "diabetes health", scorer).collect() == ranking.search(small, "diabetes health", scorer).collect()
    assert kept.average_lengths() == small.average_lengths() and kept.vocabulary_size() == small.vocabulary_size() and kept.frequencies(["diabetes", "nope"]) == small.frequencies(["diabetes", "nope"])
    some = kept.docs.first().doc
    assert kept.contains(some) and not kept.without(kept.docs.where(F.col("doc") == some)).contains(some)
    with pytest.raises(FileNotFoundError):
        type(kept).read(spark, f"file://{tmp_path}/none", kept.schema, kept.analyzer)


def test_tables_of_one_term(spark, small):
    n = small.document_count()
    assert [round(r.idf, 4) for r in ranking.idf_table(small, [1, n]).collect()] == [round(math.log(1 + (n - d + 0.5) / (d + 0.5)), 4) for d in (1, n)]
    term = small.postings.agg(F.min("term")).first()[0]
    sweep = ranking.length_sweep(small, term, [0.0, 0.75])
    assert {r.b for r in sweep.collect()} == {0.0, 0.75} and sweep.where("b = 0.75").count() == ranking.explain_bm25(small, term).count()
