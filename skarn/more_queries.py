"""More queries of the core library: pages, archives, collections, prediction and display values, each over whole tables, and their SQL.

Pages and archives are made from the tables, written where the library keeps such things, and read back by the library.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn import queries as base
from skarn.collection import Collection
from skarn.functions import scalars
from skarn.functions.analyzer import Analyzer
from skarn.operators import cluster, frontier, ranking
from skarn.plans.schema import PUBLICATIONS, CollectionSchema, Field
from skarn.session import scratch_path, spread, written
from skarn.sources import archive, corpus, html
from skarn.sources.files import write_bytes
from skarn.streaming.changes import follow

Query = Callable[[SparkSession, str], DataFrame]
HOST = "https://pure.karvelin.example"
ORGANISATION = f"{HOST}/en/organisations/centre/"
#: Words and stems, as published with the stemming algorithm.
STEMS = dict(x.split() for x in """caresses caress|ponies poni|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|digitizer digit|vietnamization vietnam|predication predic|operator oper
feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|triplicate triplic|formative form|formalize formal|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun|activate activ|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|roll roll""".replace("\n", "|").split("|"))


def _attr(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _meta(name: str, c: Column) -> Column:
    return F.concat(F.lit(f'<meta name="citation_{name}" content="'), _attr(c), F.lit('">'))


def _each(array: str, make: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.coalesce(F.col(array), F.array().cast("array<string>")) if array == "institutions" else F.col(array), make), "")


def _publication_pages(spark: SparkSession, d: str) -> DataFrame:
    """``(url, html, status)``: a page for each publication; those without a year can't be read."""
    link = lambda a: F.when(a["profile_url"] != "", F.concat(F.lit('<a href="'), F.regexp_replace(_attr(a["profile_url"]), "-[0-9]+/$", "/"), F.lit('">p</a>'))).otherwise("")
    p = base._publications(spark, d)
    head = F.concat(_meta("title", F.col("title")), _meta("journal_title", F.col("journal")), _meta("publication_date", F.col("year")), _meta("doi", F.col("doi")), _meta("keywords", F.col("keywords")),
                    _each("authors", lambda a: _meta("author", a["name"])), _each("institutions", lambda i: _meta("author_institution", i)))
    body = F.concat(F.lit('<div class="textblock">'), _attr(F.col("abstract")), F.lit("</div>"), _each("authors", link))
    return p.select(F.col("id").alias("url"), F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>")).alias("html"), F.when(F.col("year").isNull(), 404).otherwise(200).alias("status"))


def _person_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each person; every second one, by the length of the id, links the organisation."""
    p = base.current_records(base._table(spark, d, "persons"), ["name", "biography"])
    org = F.when(F.length("id") % 2 == 0, F.lit(f'<a href="{ORGANISATION}">o</a>')).otherwise("")
    body = F.concat(F.lit("<h1>"), _attr(F.col("name")), F.lit("</h1>"), org, F.lit('<div class="rendering_profileinformationportal"><div class="textblock">'), _attr(F.col("biography")), F.lit("</div></div>"))
    return p.select(F.col("id").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"), F.lit(200).alias("status"))


def page_publications(spark: SparkSession, d: str) -> DataFrame:
    """Records read back from pages."""
    p = html.publications(html.with_parts(spread(_publication_pages(spark, d))), HOST)
    return p.select("id", "title", "journal", "year", "doi", "keywords", "abstract", F.array_join("institutions", "|").alias("institutions"), F.array_join("names", "|").alias("names"))


def page_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors paired with the profile links of their page."""
    p = html.pair_authors(html.publications(html.with_parts(spread(_publication_pages(spark, d))), HOST))
    return p.select("id", F.posexplode("authors").alias("pos", "a")).select("id", "pos", "a.name", "a.profile_url")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    p = html.with_parts(spread(_publication_pages(spark, d)))
    return p.select(F.col("url").alias("id"), F.explode(html.section_links(F.col("p.hrefs"), "persons", HOST)).alias("link"))


def page_persons(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(_person_pages(spark, d)).where(scalars.belongs_to(F.col("html"), "organisations/centre"))
    return html.persons(html.with_parts(pages)).select("id", "name", "biography")


def _crawl(spark: SparkSession, d: str) -> frontier.CrawlResult:
    pubs, people = written(_publication_pages(spark, d)), written(_person_pages(spark, d))
    listing = lambda df, n: df.agg(F.concat_ws("", F.collect_list(F.concat(F.lit('<a href="'), "url", F.lit('">x</a>')))).alias("html")).select(F.lit(f"{ORGANISATION}{n}/?page=0").alias("url"), "html", F.lit(200).alias("status"))
    home = spark.createDataFrame([(ORGANISATION, "<html><body>home</body></html>", 200)], "url string, html string, status int")
    pages = pubs.unionByName(people).unionByName(listing(pubs, "publications")).unionByName(listing(people, "persons")).unionByName(home)
    return frontier.crawl(pages, ORGANISATION, "organisations/centre", HOST, "Centre for Rural Care")


def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).stats


def crawl_publications(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).publications.select("id", "title")


def crawl_persons(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).persons.select("id", "name")


def robots(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("pure.karvelin.example", 200, "User-agent: *\nDisallow: /en/publications/a\nCrawl-delay: 5")], "host string, status int, text string")
    return html.robots_verdicts(base._publications(spark, d).select("url"), rules, "reader")


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, 200).when(k == 1, 304).when(k == 2, 404).when(k == 3, 503)
    return base._table(spark, d, "events").select("event_id", status.alias("status"), k.alias("attempt"), F.when(k == 3, F.col("value")).alias("retry_after"))


def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    wait = scalars.backoff_seconds(F.lit(2.0), F.col("attempt"), F.col("retry_after"))
    return _fetches(spark, d).select("event_id", scalars.fetch_outcome(F.col("status")).alias("outcome"), F.round(wait, 4).alias("wait"))


def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the last finished crawl that differ from the one before."""
    last = base._finished(spark, d)[-2:]
    page = lambda c: base._table(spark, d, "crawl_records").where(F.col("crawl_id") == c).select("url", F.coalesce("title", F.lit("")).alias("html"), F.lit("").alias("etag"))
    return frontier.changed_pages(page(last[0]), page(last[1])).select("url", "html")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """The crawl delays as texts, read back as seconds."""
    text = F.concat(F.format_string("%.1f", "crawl_delay"), F.lit(" hours"))
    return base._table(spark, d, "crawls").where("crawl_delay is not null").select("crawl_id", scalars.parse_interval(text, strict=True).alias("seconds"))


def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """Publications written to a crawl archive and read back from its latest run."""
    root = scratch_path(spark, "archive")
    pubs = base._publications(spark, d)
    people = base.current_records(base._table(spark, d, "persons"), ["name", "url", "biography", "crawled_at"])
    archive.write_crawl(pubs.limit(0), people, {"finished_at": "x"}, root, "2026-01-01-00-00-00-NPT")
    archive.write_crawl(pubs, people, {"finished_at": "y"}, root, "2026-01-02-00-00-00-NPT")
    return archive.latest(spark, root).records().select("id", "title", F.size("authors").alias("authors"), "year", "doi")


def archive_status(spark: SparkSession, d: str) -> DataFrame:
    """The counts of an archive with a run for publications and persons each."""
    root = scratch_path(spark, "archive")
    pubs = base._publications(spark, d)
    people = base.current_records(base._table(spark, d, "persons"), ["name", "url", "biography", "crawled_at"])
    archive.write_crawl(pubs, people.limit(0), {"finished_at": "a"}, root, "1")
    archive.write_crawl(pubs.limit(0), people, {"finished_at": "b"}, root, "2")
    return archive.status(spark, root)


def corpus_archive(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items (a fixed set) as a zip of texts in a folder per task, read back."""
    path = scratch_path(spark, "corpus") + ".zip"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for r in base._table(spark, d, "eval_items").collect():
            z.writestr(f"items/{(r.task or 'none').title()}/{r.item_id}.txt", r.text or "")
    write_bytes(spark, path, packed.getvalue())
    docs = corpus.read_archive(spark, path, {"reading": "Reading", "numeracy": "Numeracy"})
    return docs.groupBy("label").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))


EVENTS = CollectionSchema((Field("id", indexed=False), Field("event_type"), Field("props", indexed=False)))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = base._table(spark, d, "events").where("user_id is not null")
    return e.select(F.col("event_id"), F.col("user_id").cast("string").alias("id"), "event_type", "props")


def _kept(spark: SparkSession, d: str) -> Collection:
    """A collection of the users' last events, of which those that are not errors are deleted and the first ten thousand events come back."""
    c = Collection.open(spark, scratch_path(spark, "collection"), EVENTS, Analyzer(stem=False))
    e = written(_events(spark, d))
    c.add_many(e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("id", "event_type", "props"))
    c.refresh()
    c.delete_many(c.stored().where("event_type <> 'error'").select("id"))
    c.add_many(e.where("event_id % 7 = 0").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("id", "event_type", "props"))
    return c.refresh()


def collection_state(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).stored().select("id", "event_type", "props")


def collection_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the log before and after it is compacted, and the documents."""
    c = _kept(spark, d)
    before = c.entries()
    dropped = c.compact()
    after = c.entries()
    return spark.createDataFrame([(before[0], dropped, after[0], after[1], len(c))], "entries long, dropped long, entries_after long, dead_after long, documents long")


def collection_search(spark: SparkSession, d: str) -> DataFrame:
    """A page of hits of a collection that was built in two steps."""
    c = Collection.open(spark, scratch_path(spark, "collection"), PUBLICATIONS, base.PLAIN)
    docs = written(base._publications(spark, d).select("id", "title", "authors", "abstract", "journal", "year"))
    first = F.xxhash64("id") % 2 == 0
    c.add_many(docs.where(first))
    c.refresh()
    c.add_many(docs.where(~first))
    return c.search(base.QUERY).hits.select(F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def index_without(spark: SparkSession, d: str) -> DataFrame:
    """The document frequencies after the publications without a year were taken out of the index."""
    index = base._index(spark, d)
    return index.without(base._publications(spark, d).where("year is null").select(F.col("id").alias("doc"))).term_stats()


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The events' change log landed as files and followed as a stream into a collection."""
    land = scratch_path(spark, "landing")
    log = base._log(spark, d).where("id is not null").repartitionByRange(1, "seq").sortWithinPartitions("seq")
    body = F.when(F.col("op") == "put", F.to_json(F.struct("id", F.col("doc").alias("props"))))
    log.select("op", "id", body.alias("doc")).write.json(land)
    c = Collection.open(spark, scratch_path(spark, "collection"), EVENTS)
    c._meta["columns"] = {"id": "string", "props": "string"}
    follow(c, land, scratch_path(spark, "progress")).awaitTermination()
    return c.documents().select("id", "props")


def _model(spark: SparkSession, d: str) -> cluster.ClusterModel:
    """A model whose centres are the mean vectors of the labels: all its figures are bounded by labels and terms."""
    docs = base._labelled(spark, d)
    terms = written(base._terms(spark, d))
    n = docs.count()
    vocabulary = cluster.fit_vocabulary(terms, n)
    weights = cluster.tfidf_weights(terms, written(cluster.features(terms)), n)
    sizes = {r.label: r.n for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = weights.join(docs.select("doc_id", "label"), "doc_id").groupBy("label", "term").agg(F.sum("weight").alias("w")).collect()
    at = {t: i for i, t in enumerate(vocabulary.terms)}
    names = sorted(sizes)
    centres = [[0.0] * len(at) for _ in names]
    for r in sums:
        centres[names.index(r.label)][at[r.term]] = r.w / sizes[r.label]
    return cluster.ClusterModel(vocabulary, centres, dict(enumerate(names)), base.PLAIN)


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).predict(base._table(spark, d, "documents").select("doc_id", "text"))


def predict_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's nearest label, its margin and the terms it was told by."""
    near = F.array_min(F.map_values("distances"))
    return _predicted(spark, d).select("doc_id", "category", F.round(near, 5).alias("nearest"), F.round("margin", 5).alias("margin"), F.col("matched_term_count").cast("int").alias("matched"))


def predict_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).groupBy(scalars.verdict(F.round("margin", 6), F.col("matched_term_count")).alias("verdict")).agg(F.count(F.lit(1)).alias("documents"))


def _distances(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Every point's distances to the label means as an array ``d``, and the labels."""
    p, centres = base._points(spark, d)
    return p.withColumn("d", F.array(*[cluster.distance_to(F.col("v"), c) for c in centres.values()])), F.array(*[F.lit(str(k)) for k in centres])


def sorted_distances(spark: SparkSession, d: str) -> DataFrame:
    found, keys = _distances(spark, d)
    s = found.select("vec_id", F.explode(scalars.sorted_distances(F.map_from_arrays(keys, F.col("d")))).alias("e"))
    return s.select("vec_id", F.col("e.category").alias("category"), F.round("e.distance", 5).alias("distance"), F.round("e.gap", 5).alias("gap"))


def bar_widths(spark: SparkSession, d: str) -> DataFrame:
    """The bar of each point's own label among all its distances, and whether another label is nearer."""
    found, keys = _distances(spark, d)
    own = F.get("d", (F.array_position(keys, F.col("label").cast("string")) - 1).cast("int"))
    nearest = F.get(keys, (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    return found.select("vec_id", F.round(scalars.bar_width(own, F.array_min("d"), F.array_max("d")), 4).alias("width"), scalars.misplaced(nearest, F.col("label").cast("string")).alias("misplaced"))


def cluster_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The confusion matrix, a column per predicted label."""
    t = cluster.confusion(base._nearest(spark, d).select("label", F.concat(F.lit("c"), F.col("cluster")).alias("category"), F.concat(F.lit("c"), F.col("label")).alias("true")), [f"c{i}" for i in range(10)], "true")
    return t.select("label", *[F.col(f"c{i}") for i in range(10)])


def cluster_mistakes(spark: SparkSession, d: str) -> DataFrame:
    return cluster.mistakes(base._nearest(spark, d), "label", "cluster")


def metric_texts(spark: SparkSession, d: str) -> DataFrame:
    a = cluster.accuracy(base._nearest(spark, d), "label", "cluster").select(F.lit("accuracy").alias("name"), F.col("accuracy").alias("value"))
    b = base.cluster_agreement(spark, d).select(F.lit("ari").alias("name"), F.col("ari").alias("value"))
    return a.unionByName(b).select("name", scalars.metric_text(F.col("name"), F.col("value")).alias("text"))


def author_spans(spark: SparkSession, d: str) -> DataFrame:
    r = base.author_rollup(spark, d).where("first_year <> ''")
    return r.select("name", scalars.year_span(F.col("first_year"), F.col("last_year")).alias("span"))


def stem_pairs(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    return words.select("word", F.element_at(Analyzer(remove_stopwords=False).analyze(F.col("word")), 1).alias("stem"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return ranking.idf_table(base._index(spark, d), [1, 2, 5, 10, 100])


def length_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ranking.length_sweep(base._index(spark, d), "wellbeing", [0.0, 0.5, 1.0])


def scatter_places(spark: SparkSession, d: str) -> DataFrame:
    """Nearest distances as places in a plot of 100 units."""
    p = written(base._nearest(spark, d).select("vec_id", "nearest"))
    low, high = (p.agg(f("nearest")).scalar() for f in (F.min, F.max))
    return p.select("vec_id", F.round(scalars.scaled(F.col("nearest"), low, high, 100.0), 4).alias("place"))


_ALL = (page_publications, page_authors, page_links, page_persons, crawl_stats, crawl_publications, crawl_persons, robots, fetch_outcomes, changed_pages, intervals, archive_records, archive_status, corpus_archive, collection_state, collection_entries,
        collection_search, index_without, stream_replay, predict_documents, predict_verdicts, sorted_distances, bar_widths, cluster_pivot, cluster_mistakes, metric_texts, author_spans, stem_pairs, idf_table, length_sweep, scatter_places)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def _strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"


_PEOPLE = f"people AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {base._LATEST.format('id')} AS rn FROM persons) WHERE rn = 1)"
_PAIRS = f"""WITH {base._CUR}, a AS (SELECT id, unnest(authors) AS a, unnest(range(len(authors))) AS i FROM cur WHERE {_strip('title')} <> ''), n AS (SELECT id, {_strip('a.name')} AS name, i, {base._SLUG} AS slug FROM a WHERE {_strip('a.name')} <> ''),
    names AS (SELECT id, name, slug, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, left(string_split(slug, '-')[1], 1) AS ini, string_split(slug, '-')[-1] AS sur FROM n),
    links AS (SELECT DISTINCT id, regexp_extract(regexp_replace(a.profile_url, '-[0-9]+/$', '/'), '/en/persons/([^/"?#]+)', 1) AS slug FROM a WHERE a.profile_url <> ''),
    ex AS (SELECT id, slug, min(pos) AS pos FROM names WHERE (id, slug) IN (SELECT id, slug FROM links) GROUP BY ALL),
    le AS (SELECT id, slug, left(string_split(slug, '-')[1], 1) AS ini, string_split(slug, '-')[-1] AS sur FROM links WHERE (id, slug) NOT IN (SELECT id, slug FROM names)),
    un AS (SELECT id, ini, sur, any_value(slug) AS slug FROM le GROUP BY ALL HAVING count(*) = 1)"""
_CRAWLED = f"""WITH {base._CUR}, {_PEOPLE}, rd AS (SELECT * FROM cur WHERE year IS NOT NULL), m AS (SELECT *, length(id) % 2 = 0 AS member FROM people)"""
_EVENTS = """WITH e AS (SELECT event_id, user_id::VARCHAR AS id, event_type, props FROM events WHERE user_id IS NOT NULL), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1), g AS (SELECT id FROM l WHERE event_type <> 'error'),
    b AS (SELECT * FROM e WHERE event_id % 7 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1), s AS (SELECT * FROM b UNION ALL SELECT * FROM l WHERE id NOT IN (SELECT id FROM g) AND id NOT IN (SELECT id FROM b))"""
_MODEL = f"""{base._VEC}, ce AS (SELECT label, term, sum(weight) / (SELECT count(*) FROM lab x WHERE x.label = lab.label) AS c FROM vec JOIN lab USING (doc_id) GROUP BY label, term), sq AS (SELECT label, sum(c * c) AS q FROM ce GROUP BY label),
    words AS (SELECT doc_id, unnest({base._analyzed('text')}) AS term FROM documents), ar AS (SELECT doc_id, term, (1 + ln(count(*))) * (ln((1 + (SELECT count(*) FROM lab)) / (1 + any_value(df))::DOUBLE) + 1) AS w FROM words JOIN fe USING (term) GROUP BY doc_id, term),
    av AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM ar), mt AS (SELECT doc_id, count(*) AS matched FROM av GROUP BY doc_id),
    dots AS (SELECT doc_id, label, sum(w * c) AS dot FROM av JOIN ce USING (term) GROUP BY ALL),
    ds AS (SELECT d.doc_id, sq.label, coalesce(matched, 0) AS matched, sqrt(greatest(CASE WHEN matched IS NULL THEN 0 ELSE 1 END - 2 * coalesce(dot, 0) + q, 0)) AS d FROM documents d CROSS JOIN sq LEFT JOIN mt USING (doc_id) LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.label = sq.label),
    pr AS (SELECT doc_id, arg_min(label, d) AS category, any_value(matched) AS matched, list(d ORDER BY d) AS ds FROM ds GROUP BY doc_id), pm AS (SELECT *, ds[1] AS nearest, CASE WHEN ds[2] = 0 THEN 0 ELSE 1 - ds[1] / ds[2] END AS margin FROM pr)"""


def oracle_sql() -> dict[str, str]:
    clean = lambda c: f"{_strip(c)} AS {c}"
    names = lambda c: f"array_to_string(list_filter(list_transform({c}, lambda x: {_strip('x')}), lambda x: x <> ''), '|')"
    year = "CASE WHEN regexp_full_match(left(coalesce(year, ''), 4), '[0-9]+') THEN left(year, 4) ELSE '' END"
    listed = ", ".join(f"count(*) FILTER (cluster = {i}) AS c{i}" for i in range(10))
    part = "ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2 / (tf + 1.2 * (1 - b + b * (length / avg)))"
    return {
        "page_publications": f"WITH {base._CUR} SELECT id, {clean('title')}, {clean('journal')}, {year} AS year, {clean('doi')}, {clean('keywords')}, {clean('abstract')}, coalesce({names('institutions')}, '') AS institutions, {names('list_transform(authors, lambda a: a.name)')} AS names FROM cur WHERE {_strip('title')} <> ''",
        "page_authors": f"""{_PAIRS} SELECT names.id, names.pos::INTEGER AS pos, names.name, CASE WHEN coalesce(ex.slug, un.slug) IS NULL THEN '' ELSE '{HOST}/en/persons/' || coalesce(ex.slug, un.slug) || '/' END AS profile_url
            FROM names LEFT JOIN ex ON ex.id = names.id AND ex.slug = names.slug AND ex.pos = names.pos LEFT JOIN un ON ex.slug IS NULL AND un.id = names.id AND un.ini = names.ini AND un.sur = names.sur""",
        "page_links": f"WITH {base._CUR}, a AS (SELECT id, unnest(authors) AS a FROM cur) SELECT DISTINCT id, '{HOST}/en/persons/' || regexp_extract(regexp_replace(a.profile_url, '-[0-9]+/$', '/'), '/en/persons/([^/\"?#]+)', 1) || '/' AS link FROM a WHERE a.profile_url <> ''",
        "page_persons": f"WITH {_PEOPLE} SELECT id, {clean('name')}, {clean('biography')} FROM people WHERE length(id) % 2 = 0 AND {_strip('name')} <> ''",
        "crawl_stats": f"""{_CRAWLED} SELECT (SELECT count(*) FROM m) AS members_seeded, (SELECT count(*) FROM m WHERE member) AS members_found, (SELECT count(*) FROM m WHERE NOT member) AS profiles_rejected, count(*) AS publication_urls_seen, count(*) FILTER ({_strip('title')} <> '') AS publications_kept,
            count(*) FILTER ({_strip('title')} <> '' AND len(list_filter(institutions, lambda i: contains(lower(i), 'centre for rural care'))) > 0) AS affiliation_verified, count(*) FILTER ({_strip('title')} = '') AS skipped_unparseable,
            (SELECT count(*) FROM cur WHERE year IS NULL) + (SELECT count(DISTINCT l) FROM (SELECT regexp_replace(unnest(list_transform(authors, lambda a: a.profile_url)), '-[0-9]+/$', '/') AS l FROM rd WHERE {_strip('title')} <> '') WHERE l <> '' AND l NOT IN (SELECT id FROM people)) AS unreadable FROM rd""",
        "crawl_publications": f"{_CRAWLED} SELECT id, {clean('title')} FROM rd WHERE {_strip('title')} <> ''",
        "crawl_persons": f"{_CRAWLED} SELECT id, {clean('name')} FROM m WHERE member AND {_strip('name')} <> ''",
        "robots": f"WITH {base._CUR} SELECT url, NOT contains(url, '{HOST}/en/publications/a') AS allowed, 5.0::DOUBLE AS crawl_delay FROM cur",
        "fetch_outcomes": "SELECT event_id, (['ok', 'unchanged', 'error', 'error', 'failed'])[event_id % 5 + 1] AS outcome, round(CASE WHEN event_id % 5 = 3 THEN greatest(16.0::DOUBLE, coalesce(value, 0)) ELSE 2.0::DOUBLE * power(2, event_id % 5) END, 4) AS wait FROM events",
        "changed_pages": """WITH o AS (SELECT crawl_id, row_number() OVER (ORDER BY started_at DESC, crawl_id DESC) AS k FROM crawls WHERE finished_at IS NOT NULL), r AS (SELECT k, url, coalesce(title, '') AS html FROM crawl_records JOIN o USING (crawl_id) WHERE k <= 2)
            SELECT url, html FROM r WHERE k = 1 AND (url, html) NOT IN (SELECT url, html FROM r WHERE k = 2)""",
        "intervals": "SELECT crawl_id, round(crawl_delay, 1)::DOUBLE * 3600 AS seconds FROM crawls WHERE crawl_delay IS NOT NULL",
        "archive_records": f"WITH {base._CUR} SELECT id, title, len(authors)::INTEGER AS authors, year, doi FROM cur",
        "archive_status": f"WITH {base._CUR}, {_PEOPLE} SELECT '1' AS crawl_id, (SELECT count(*) FROM cur) AS publication_count, 0::BIGINT AS person_count, 'a' AS finished_at UNION ALL SELECT '2', 0, (SELECT count(*) FROM people), 'b'",
        "corpus_archive": "SELECT upper(left(task, 1)) || substr(task, 2) AS label, count(*) AS documents, sum(length(trim(text)))::BIGINT AS chars FROM eval_items WHERE task IN ('reading', 'numeracy') AND trim(text) <> '' GROUP BY ALL",
        "collection_state": f"{_EVENTS} SELECT id, event_type, props FROM s",
        "collection_entries": f"{_EVENTS}, c AS (SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM g) + (SELECT count(*) FROM e WHERE event_id % 7 = 0) AS n, (SELECT count(*) FROM s) AS live) SELECT n AS entries, n - live AS dropped, live AS entries_after, 0::BIGINT AS dead_after, live AS documents FROM c",
        "collection_search": f"{base._scores('bm25')} SELECT rank, round(score, 6) AS score FROM rk WHERE rank <= 10",
        "index_without": f"{base._INDEX} SELECT term, count(DISTINCT doc)::BIGINT AS df FROM po WHERE doc NOT IN (SELECT id FROM cur WHERE year IS NULL) GROUP BY term",
        "stream_replay": f"{base._LIVE} SELECT id, doc AS props FROM live",
        "predict_documents": f"{_MODEL} SELECT doc_id, category, round(nearest, 5) AS nearest, round(margin, 5) AS margin, matched::INTEGER AS matched FROM pm",
        "predict_verdicts": f"{_MODEL} SELECT CASE WHEN matched = 0 THEN 'no known terms' WHEN round(margin, 6) < 0.01 THEN 'too close to call' WHEN round(margin, 6) < 0.04 THEN 'a narrow call' ELSE 'clear' END AS verdict, count(*) AS documents FROM pm GROUP BY ALL",
        "sorted_distances": f"{base._POINTS} SELECT vec_id, cluster::VARCHAR AS category, round(d, 5) AS distance, round(d - min(d) OVER (PARTITION BY vec_id), 5) AS gap FROM di",
        "bar_widths": f"{base._POINTS}, s AS (SELECT vec_id, min(d) AS lo, max(d) AS hi, any_value(d) FILTER (label = cluster) AS own FROM di GROUP BY vec_id) SELECT vec_id, round(CASE WHEN hi = lo THEN 100 ELSE 25 + (hi - own) / (hi - lo) * 75 END, 4) AS width, cluster <> label AS misplaced FROM s JOIN na USING (vec_id)",
        "cluster_pivot": f"{base._POINTS} SELECT 'c' || label AS label, {listed} FROM na WHERE label BETWEEN 0 AND 9 GROUP BY ALL",
        "cluster_mistakes": f"{base._POINTS} SELECT label, cluster AS predicted, count(*) AS n FROM na WHERE label <> cluster GROUP BY ALL",
        "metric_texts": f"WITH x AS ({base.oracle_sql()['cluster_agreement']}), y AS ({base.oracle_sql()['cluster_accuracy']}) SELECT 'accuracy' AS name, printf('%.1f%%', accuracy * 100) AS text FROM y UNION ALL SELECT 'ari', printf('%.3f', ari) FROM x",
        "author_spans": f"WITH {base._CUR}, e AS (SELECT unnest(authors).name AS name, nullif(year, '') AS y FROM cur) SELECT name, CASE WHEN min(y) = max(y) THEN min(y) ELSE min(y) || '–' || max(y) END AS span FROM e WHERE name <> '' AND y IS NOT NULL GROUP BY name",
        "stem_pairs": "SELECT word, stem FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEMS.items()) + ") AS v(word, stem)",
        "idf_table": f"{base._INDEX} SELECT x::BIGINT AS df, round(ln(1 + (n.n - x + 0.5::DOUBLE) / (x + 0.5::DOUBLE)), 6) AS idf FROM n, (SELECT unnest([1, 2, 5, 10, 100]) AS x)",
        "length_sweep": f"{base._INDEX} SELECT po.doc, po.field, b, round({part}, 6) AS score FROM po JOIN df USING (term) JOIN fl ON fl.doc = po.doc AND fl.field = po.field JOIN av ON av.field = po.field, n, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS b) WHERE term = 'wellbeing'",
        "scatter_places": f"{base._POINTS} SELECT vec_id, round((nearest - min(nearest) OVER ()) / (max(nearest) OVER () - min(nearest) OVER ()) * 100, 4) AS place FROM na",
        "scorer_agreement": f"""WITH x AS ({base._scores('bm25', asked=base._QUESTIONS)} SELECT query_id, doc AS a FROM rk WHERE rank = 1), y AS ({base._scores('tf-idf', asked=base._QUESTIONS)} SELECT query_id, doc AS b FROM rk WHERE rank = 1)
            SELECT count(*) AS queries, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND a = b) AS agree FROM x FULL JOIN y USING (query_id)""",
    }
