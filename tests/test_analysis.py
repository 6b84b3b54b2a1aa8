import pytest
from pyspark.sql import functions as F

from skarn.functions import scalars
from skarn.functions.analyzer import Analyzer
from skarn.functions.porter import stem

PLAIN = {"stem": False, "remove_stopwords": False}
CASES = [
    ({**PLAIN}, "COVID-19, children's health.", ["covid-19", "covid", "19", "children's", "health"]),
    ({}, "children's health", ["children", "health"]),
    ({"split_compounds": False}, "yoga-based", ["yoga-bas"]),
    ({"stem": False}, "Retrieving the datasets", ["retrieving", "datasets"]),
    (PLAIN, "Retrieving the datasets", ["retrieving", "the", "datasets"]),
    (PLAIN, "health data health", ["health", "data", "health"]),
    ({}, "The Who", []), ({}, "", []), ({}, "--- ... !!!", []),
    ({"lowercase": False, "stem": False}, "Diabetes", ["iabetes"]),
]


@pytest.mark.parametrize("config, text, expected", CASES)
def test_analyzer_on_columns_and_driver(spark, config, text, expected):
    a = Analyzer(**config)
    assert a.analyze_text(text) == expected
    assert spark.createDataFrame([(text,)], "t string").select(a.analyze(F.col("t"))).first()[0] == expected
    assert Analyzer.from_config(a.config()) == a


def test_same_stem_for_forms():
    both = [Analyzer().analyze_text(t) for t in ("Retrieval of COVID-19 datasets", "Retrieving covid-19 data")]
    assert all({"retriev", "covid-19", "covid", "19"} <= set(x) for x in both)
    assert "ar" not in Analyzer().analyze_text("these are the results")


@pytest.mark.parametrize("word, expected", [("community", "commun"), ("communication", "commun"), ("diabetic", "diabet"), ("diabetes", "diabet"), ("alice", "alic"), ("machine", "machin"), ("nutrition", "nutrit"),
                                            ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
                                            ("happy", "happi"), ("sky", "sky"), ("dying", "die"), ("relational", "relat"), ("conditional", "condit"), ("electriciti", "electr"), ("adjustment", "adjust"), ("controll", "control"), ("probate", "probat"), ("rate", "rate")])
def test_stems(word, expected):
    assert stem(word) == expected


def _one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert [_one(spark, scalars.slugify(lit(x))) for x in ("Celine Brookes-Smith", "Lorna O'Doherty", "José García")] == ["celine-brookes-smith", "lorna-o-doherty", "jose-garcia"]
    assert [_one(spark, scalars.parse_interval(lit(x))) for x in ("1week", "100h", "2months", "1min", "5m", "x")] == [604800, 360000, 5184000, 60, None, None]
    assert [_one(spark, scalars.format_duration(lit(float(x)))) for x in (45, 180, 9000, 691200, -3)] == ["45s", "3.0 minutes", "2.5 hours", "8.0 days", "0s"]
    assert [_one(spark, scalars.fetch_outcome(lit(x).cast("int"))) for x in (200, 304, 404, None)] == ["ok", "unchanged", "error", "failed"]
    assert [_one(spark, scalars.year_of(lit(x))) for x in ("2024/03", "24", "n.d.", "")] == ["2024", "24", "", ""]
    assert _one(spark, scalars.same_host(lit("https://a.b:80/x"), lit("https://a.b/y"))) is False
    assert _one(spark, scalars.snippet(lit("x" * 279 + " yz"))) == "x" * 279 + "…"
    assert _one(spark, scalars.backoff_seconds(lit(2.0), lit(3), lit(5.0))) == 16.0
    assert [_one(spark, scalars.verdict(lit(m), lit(k))) for m, k in ((0.5, 0), (0.005, 3), (0.03, 3), (0.2, 3))] == ["no known terms", "too close to call", "a narrow call", "clear"]
    assert _one(spark, scalars.year_span(lit("2001"), lit("2003"))) == "2001–2003"
    assert _one(spark, scalars.bar_width(lit(1.0), lit(1.0), lit(3.0))) == 100.0
