import pytest
from pyspark.sql import functions as F

from skarn.llm.canon import align, initials, map_to_canonical, match_values, readings

REFS = [(1, "institution", "Centre for Rural Care and Community Renewal", "CRCCR", None), (2, "institution", "University of Holbaford", None, "Holbaford"), (3, "institution", "Holbaford Business School", "HBS", "Holbaford"),
        (4, "institution", "Holthegrad Technical University", "HTU", "Holthegrad"), (5, "institution", "Harbour Tax Union", "HTU", None), (6, "institution", "Holbaford Institute of Public Health", None, "Holbaford"),
        (10, "journal", "Journal of Maternal Sociology", None, None), (11, "journal", "Tammerton Quarterly of Nursing", "TQN", None), (12, "journal", None, None, None)]
CASES = [("institution", "the centre for rural care ad community renewal", 1), ("institution", "crccr", 1), ("institution", "C.R.C.C.R.", 1), ("institution", "Holbaford, University of", 2), ("institution", "Holbaford University", 2),
         ("institution", "Universität Holbaford", 2), ("institution", "Department of Finance, Holbaford Business School", 3), ("institution", "Holbaford\tBusiness\tSchool.", 3), ("institution", "Holbafrd Business Schol, Holbaford", 3),
         ("institution", "Holbaford Bus. Sch.", 3), ("institution", "Technische Universität Holthegrad", 4), ("institution", "HTU", -1), ("institution", "Holbaford Inst. of Publ. Hlth", 6), ("institution", "University of Karvenwald", -1),
         ("institution", "Holbaford Football Club", -1), ("institution", "Holbaford", -1), ("institution", "-", -1), ("institution", "x" * 20000, -1), ("institution", "Journal of Maternal Sociology", -1),
         ("journal", "JOURNAL OF MATERNAL SOCIOLOGY", 10), ("journal", "Maternal Sociology, Journal of", 10), ("journal", "Journal of Maternal Socioolgy, vol. 13", 10), ("journal", "Journal of Maternal Sociology (Online)", 10),
         ("journal", "Tamm. Quart. Nurs.", 11), ("journal", "T. Q. N.", 11), ("journal", "Tammerton Qtly of Nursing 32(1)", 11), ("journal", "in press", -1), ("journal", "Journal", -1)]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(REFS, "ref_id long, kind string, name string, short_name string, place string")


def test_meanings(spark, refs):
    values = spark.createDataFrame([(k, v) for k, v, _ in CASES] * 2 + [("journal", None), ("journal", " \t"), (None, "x")], "kind string, value string")
    got = {(r.kind, r.value): (r.ref_id, r.n) for r in match_values(values, refs).collect()}
    assert {(k, v): got[k, v] for k, v, _ in CASES} == {(k, v): (i, 2) for k, v, i in CASES}
    assert ("journal", " \t") not in got and ("journal", None) not in got


def test_publications(spark, refs):
    rows = [("p1", "Journal of Maternal Sociology", ["University of Holbaford", "university of holbaford", None, ""]), ("p2", None, None), ("p3", "nothing known", []), ("p4", " ", ["Univrsity of Holbaford"] * 3)]
    pubs = spark.createDataFrame(rows, "id string, journal string, institutions array<string>").withColumns({c: F.lit(0) for c in ("kind", "value", "n", "ref_id")})
    got = {(r.publication_id, r.field_name, r.value_pos, r.ref_id) for r in map_to_canonical(pubs, refs).collect()}
    assert got == {("p1", "institutions", 1, 2), ("p3", "journal", 0, -1), *(("p4", "institutions", i, 2) for i in range(3))}
    assert map_to_canonical(pubs.limit(0), refs).count() == 0
    assert {r.ref_id for r in map_to_canonical(pubs, refs.limit(0)).collect()} == {-1}


def test_join_finds_what_a_full_comparison_finds(spark, refs):
    from skarn.llm.canon import THRESHOLDS, WORTH, check, ref_views, value_views

    names = [r[2] for r in REFS[:6]]
    typed = [n[:i] + n[i + 1:] for n in names for i in range(0, len(n), 3)] + ["Univ. of Holbaford", "HBS", "hbs", "Holb. Bus. Sch."]
    got = {r.value: r.ref_id for r in match_values(spark.createDataFrame([("institution", t) for t in typed], "kind string, value string"), refs).collect()}
    for t in typed:
        best = {}
        for reading, view, tokens in value_views(t):
            for i, _, n, short, _ in REFS[:6]:
                for other, right in ref_views(n, short):
                    a, b = set(tokens), set(right)
                    sim = len(a & b) / len(a | b)
                    if view == other and sim >= THRESHOLDS[view] and (c := check(reading, view, n, short)) is not None:
                        best[i] = min(round(c / 10 - sim * WORTH[view], 9), best.get(i, 9))
        low = [i for i in best if best[i] == min(best.values())]
        assert got[t] == (low[0] if len(low) == 1 else -1), t


def test_a_long_list(spark, refs):
    """The list is a table like the values: nothing of it but its trigrams goes through the driver."""
    many = spark.range(20_000).select((F.col("id") + 1000).alias("ref_id"), F.lit("institution").alias("kind"), F.concat(F.lit("College "), F.md5(F.col("id").cast("string"))).alias("name"), F.lit(None).cast("string").alias("short_name"), F.lit(None).cast("string").alias("place"))
    values = spark.createDataFrame([("institution", "univrsity of Holbaford"), ("institution", "College of Nowhere")], "kind string, value string")
    assert {r.value: r.ref_id for r in match_values(values, refs.unionByName(many)).collect()} == {"univrsity of Holbaford": 2, "College of Nowhere": -1}


def test_parts():
    assert initials("I. J. D. S.") == "ijds" and initials("school") == "school" and initials("a") is None
    assert align(["rural", "caer"], ["care", "rural"], 2) == 1 and align(["rural", "care", "an"], ["rural", "care"], 2) == 1 and align(["a"], ["b", "c"], 2) == 3
    assert "Royal College of Ostmiwald" in readings("Ostmiwald, Royal College of")


def test_address_of_many_parts(spark, refs):
    parts = ["Room 4", "Floor 2", "Block C", "Holbaford Business School", "12 Mill Lane", "Old Town", "HB2 7XY", "Holbaford"]
    assert set(parts) <= set(readings(", ".join(parts)))
    assert match_values(spark.createDataFrame([("institution", ", ".join(parts))], "kind string, value string"), refs).first().ref_id == 3
