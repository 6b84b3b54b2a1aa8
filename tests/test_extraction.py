import pytest
from pyspark.sql import functions as F

from skarn.functions.scalars import is_affiliated, slugify
from skarn.operators.frontier import changed_pages, crawl, reachable
from skarn.session import bucketed
from skarn.sources import html

BASE = "https://portal.example"
ORG, SLUG = f"{BASE}/en/organisations/centre/", "centre-for-care"


def publication(title="Diabetes prevention", authors=("Mary Stone", "External Person"), links=("mary-stone",), institutions=("Centre for Care (CC)",)):
    meta = [("title", title), ("journal_title", "Health Reports"), ("publication_date", "2024/03"), ("doi", "10.1/x")] + [("author", a) for a in authors] + [("author_institution", i) for i in institutions]
    return "<html><head>" + "".join(f'<meta name="citation_{k}" content="{v}">' for k, v in meta) + "</head><body>" + "".join(f'<a href="/en/persons/{x}/">p</a>' for x in links) + '<div class="textblock">A <b>study</b> of prevention.</div></body></html>'


def person(name="Mary Stone", papers=("one", "two"), member=True):
    return f"<html><body><h1>{name}</h1>" + (f'<a href="/en/organisations/{SLUG}/">o</a>' if member else "") + "".join(f'<a href="/en/publications/{p}/">x</a>' for p in papers) + \
        '<div class="textblock">A prize.</div><section class="person-profileinformation"><div class="rendering_profileinformationportal"><div class="textblock"><p>Researches things.</p></div></div></section></body></html>'


def parts(spark, page):
    return html.with_parts(spark.createDataFrame([(f"{BASE}/en/publications/one/", page)], "url string, html string"))


def test_publication(spark):
    r = html.pair_authors(html.publications(parts(spark, publication()), BASE)).first()
    assert (r.title, r.journal, r.year, r.doi, r.abstract) == ("Diabetes prevention", "Health Reports", "2024", "10.1/x", "A study of prevention.")
    assert [a.profile_url for a in r.authors] == [f"{BASE}/en/persons/mary-stone/", ""]
    assert html.publications(parts(spark, "<html><title>No</title></html>"), BASE).count() == 0
    assert html.publications(parts(spark, None), BASE).count() == 0


@pytest.mark.parametrize("authors, links, expected", [(["M Stone"], ["mary-stone"], ["mary-stone"]), (["J Smith"], ["jack-smith", "john-smith"], [""]), (["Ann Lee", "Ann Lee"], ["ann-lee"], ["ann-lee", ""]), (["A Lee", "Amy Lee"], ["amy-lee"], ["", "amy-lee"])])
def test_pairing(spark, authors, links, expected):
    r = html.pair_authors(html.publications(parts(spark, publication(authors=authors, links=links)), BASE)).first()
    assert [a.profile_url for a in r.authors] == [f"{BASE}/en/persons/{e}/" if e else "" for e in expected]


def test_person(spark):
    r = html.persons(parts(spark, person())).first()
    assert (r.name, r.biography) == ("Mary Stone", "Researches things.")
    assert html.persons(parts(spark, "<p>no heading")).count() == 0


def test_affiliation(spark):
    df = spark.createDataFrame([(["Centre for CARE (x)"],), (["Other"],), (None,)], "i array<string>")
    assert [r[0] for r in df.select(is_affiliated(F.col("i"), "Centre for Care")).collect()] == [True, False, False]


def pages(spark, d):
    rows = [(u, 304 if h is None else 200, h) for u, h in d.items()]
    return spark.createDataFrame(rows, "url string, status int, html string")


def run(spark, d, **kw):
    r = crawl(pages(spark, d), ORG, SLUG, BASE, "centre for care", **kw)
    return r, r.stats.first(), {x.id.rstrip("/").rsplit("/", 1)[1] for x in r.publications.collect()}


def u(kind, name):
    return f"{BASE}/en/{kind}/{name}/"


LINK = '<a href="/en/persons/mary-stone/">P</a>'
PAGES = {ORG: LINK, u("persons", "mary-stone"): person(), u("publications", "one"): publication(), u("publications", "two"): publication("Another", institutions=("Elsewhere",))}


def test_crawl(spark):
    r, s, kept = run(spark, PAGES)
    assert kept == {"one", "two"} and (s.members_found, s.publications_kept, s.members_seeded) == (1, 2, 1)
    assert r.persons.first().biography == "Researches things."
    assert run(spark, PAGES, require_affiliation=True)[2] == {"one"}
    assert run(spark, PAGES | {u("publications", "two"): None})[2] == {"one"}
    assert run(spark, {})[2] == set()


def test_coauthors_extend_the_frontier(spark):
    links = ("mary-stone", "ann-hill", "other-centre")
    d = PAGES | {u("publications", "one"): publication(links=links), u("persons", "ann-hill"): person("Ann", ("three",)), u("persons", "other-centre"): person("Other", ("four",), member=False), u("publications", "three"): publication("Third")}
    r, s, kept = run(spark, d)
    assert kept == {"one", "two", "three"} and (s.members_found, s.profiles_rejected) == (2, 1)
    assert r.visits.count() == r.visits.select("url").distinct().count()


def test_listing(spark):
    listing = {f"{ORG}publications/?page=0": '<a href="/en/publications/one/">1</a>', f"{ORG}publications/?page=2": '<a href="/en/publications/two/">2</a>', f"{ORG}persons/?page=0": LINK}
    assert run(spark, PAGES | listing)[2] == {"one"}  # page 1 is missing, so page 2 is never asked for, and "two" isn't listed


def test_reachable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None), ("x", "y")], "src string, dst string")
    assert {(r.url, r.depth) for r in reachable(e, spark.createDataFrame([("a",), (None,)], "url string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_robots_and_validators(spark):
    urls = spark.createDataFrame([(f"https://{h}/p/x",) for h in "abcd"], "url string")
    robots = spark.createDataFrame([("a", 404, None), ("b", 200, "User-agent: *\nDisallow: /p/\nCrawl-delay: 5"), ("c", 403, None)], "host string, status int, text string")
    assert {r.url[8]: (r.allowed, r.crawl_delay) for r in html.robots_verdicts(urls, robots, "bot").collect()} == {"a": (True, 2.0), "b": (False, 5.0), "c": (False, 2.0), "d": (False, 2.0)}
    s = "url string, html string, etag string"
    old = spark.createDataFrame([("a", "x", "1"), ("b", "x", "")], s)
    assert {r.url for r in changed_pages(old, spark.createDataFrame([("a", "y", "1"), ("b", "y", ""), ("c", "z", None)], s)).collect()} == {"b", "c"}


def test_slugs_of_any_alphabet(spark):
    names = {"Antonín Dvořák": "antonin-dvorak", "Shinzō Abe": "shinzo-abe", "Łukasz Żak": "ukasz-zak", " O’Neil, J. ": "oneil-j", "ﬁne ½": "fine-12", "李": "", None: None}
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", slugify(F.col("n")).alias("s")).collect()}
    assert got == names


def test_too_many_rounds(spark):
    chain = spark.range(30).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    seeds = spark.createDataFrame([("0",)], "url string")
    assert reachable(chain, seeds).agg(F.max("depth")).first()[0] == 30
    with pytest.raises(RuntimeError):
        reachable(chain, seeds, most_rounds=5)


def test_edges_are_not_shuffled_again(spark):
    edges = spark.range(2000).select(F.col("id").cast("string").alias("src"), (F.col("id") * 7 % 2000).cast("string").alias("dst"))
    with bucketed(edges, "src", "edges") as out:
        plan = out.join(out.select(F.col("dst").alias("src")).limit(1500).hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    scan = plan[:plan.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange hashpartitioning(src" not in scan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skarn_edges")]
