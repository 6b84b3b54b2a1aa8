"""Queries of the core library, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import scalars
from skarn.functions.analyzer import STOPWORDS, Analyzer
from skarn.operators import browse, cluster, log, ranking
from skarn.operators.current import current_records
from skarn.operators.frontier import reachable
from skarn.operators.index import Index, build_index
from skarn.operators.snapshots import changed_values, snapshot_changes
from skarn.plans.schema import PUBLICATIONS
from skarn.session import scratch_path, spread, written
from skarn.sources.archive import search_documents, split_valid
from skarn.sources.corpus import balanced_sample, label_counts

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "search_bm25"
COMPARED = ["title", "abstract", "journal", "year", "doi", "keywords"]
QUERY = "digital support for mental health and wellbeing"
PLAIN = Analyzer(stem=False)
LABELS = ["Economics", "Entertainment", "Health", "Politics"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _finished(spark: SparkSession, d: str) -> list[str]:
    """The crawls that ended, in order of their start: one row a crawl."""
    rows = _table(spark, d, "crawls").where("finished_at is not null").orderBy("started_at", "crawl_id").select("crawl_id").collect()
    return [r.crawl_id for r in rows]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(_table(spark, d, "crawl_records"), _finished(spark, d), COMPARED, ["authors"]).select("crawl_id", "id", "change_kind")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """The fields that changed with their old and new values, as compared."""
    rows = _table(spark, d, "crawl_records")
    order = _finished(spark, d)
    return changed_values(snapshot_changes(rows, order, COMPARED, ["authors"]), rows, order, COMPARED, ["authors"])


def _publications(spark: SparkSession, d: str) -> DataFrame:
    return current_records(_table(spark, d, "publications"), ["title", "url", "authors", "institutions", "abstract", "journal", "year", "doi", "keywords", "crawled_at"])


def _index(spark: SparkSession, d: str, analyzer: Analyzer = PLAIN) -> Index:
    """The index of the current publications, written and read again as a service keeps it."""
    docs = written(spread(_publications(spark, d).select("id", "title", "authors", "abstract", "journal")), "documents")
    return build_index(docs, PUBLICATIONS, analyzer, "id", keep=True).write(scratch_path(spark, "index"))


def analyze_terms(spark: SparkSession, d: str) -> DataFrame:
    return _publications(spark, d).select("id", F.posexplode(PLAIN.analyze(F.col("abstract"))).alias("pos", "term"))


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    """The stemmed vocabulary of titles with its frequencies."""
    return _publications(spark, d).select(F.explode(Analyzer().analyze(F.col("title"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    p = build_index(_publications(spark, d), PUBLICATIONS, PLAIN, "id").postings
    return p.select("term", "doc", "field", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


def field_lengths(spark: SparkSession, d: str) -> DataFrame:
    return build_index(_publications(spark, d), PUBLICATIONS, PLAIN, "id").fields.select("doc", "field", "length", F.round("norm", 6).alias("norm"))


def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return build_index(_publications(spark, d), PUBLICATIONS, PLAIN, "id").document_lengths()


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return build_index(_publications(spark, d), PUBLICATIONS, PLAIN, "id").term_stats()


def average_lengths(spark: SparkSession, d: str) -> DataFrame:
    s = build_index(written(_publications(spark, d)), PUBLICATIONS, PLAIN, "id").field_stats()
    return s.select("field", "total_length", F.round("average_length", 6).alias("average_length"))


def vocabulary_size(spark: SparkSession, d: str) -> DataFrame:
    return build_index(_publications(spark, d), PUBLICATIONS, PLAIN, "id").postings.agg(F.count_distinct("term").alias("vocabulary_size"))


def terms_in_document(spark: SparkSession, d: str) -> DataFrame:
    return build_index(_publications(spark, d), PUBLICATIONS, PLAIN, "id").terms_in_documents().groupBy("doc").agg(F.count(F.lit(1)).alias("terms"))


def boolean_and(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).matching_all(["digital", "support"])


def _page(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("rank").cast("int").alias("rank"), "doc", F.round("score", 6).alias("score"))


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _page(ranking.search(_index(spark, d), QUERY))


def search_bm25_raw(spark: SparkSession, d: str) -> DataFrame:
    return ranking.score(_index(spark, d), QUERY, ranking.bm25(coordinated=False)).select("doc", F.round("score", 6).alias("score"))


def search_bm25_k1b(spark: SparkSession, d: str) -> DataFrame:
    return ranking.score(_index(spark, d), QUERY, ranking.bm25(0.9, 0.4)).select("doc", F.round("score", 6).alias("score"))


def search_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _page(ranking.search(_index(spark, d), QUERY, "tf-idf"))


def search_tfidf_raw(spark: SparkSession, d: str) -> DataFrame:
    return ranking.score(_index(spark, d), QUERY, ranking.tf_idf(coordinated=False)).select("doc", F.round("score", 6).alias("score"))


def search_page2(spark: SparkSession, d: str) -> DataFrame:
    return _page(ranking.search(_index(spark, d), QUERY, limit=10, offset=10))


def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _page(ranking.search(_index(spark, d, Analyzer()), QUERY))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The names of the canonical list as queries."""
    return _table(spark, d, "ref_names").select(F.col("ref_id").alias("query_id"), F.col("name").alias("text"))


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    hits = ranking.search_many(_index(spark, d), _questions(spark, d), k=5)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "doc", F.round("score", 6).alias("score"))


def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.match_counts(_index(spark, d), _questions(spark, d))


def scorer_agreement(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _index(spark, d), _questions(spark, d)
    both = ranking.top_agreement(ranking.search_many(index, asked, "bm25", 1), ranking.search_many(index, asked, "tf-idf", 1))
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if("agree").alias("agree"))


def bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    return ranking.explain_bm25(_index(spark, d), "wellbeing")


def bm25_saturation(spark: SparkSession, d: str) -> DataFrame:
    return ranking.saturation_curve(_index(spark, d), [1, 2, 3, 5, 10, 25, 100, 1000])


def browse_newest(spark: SparkSession, d: str) -> DataFrame:
    return browse.newest(_publications(spark, d), ["id", "title", "year"], 20, 20, "id")


def author_rollup(spark: SparkSession, d: str) -> DataFrame:
    return browse.author_rollups(_publications(spark, d), "id")


def author_listing(spark: SparkSession, d: str) -> DataFrame:
    return browse.by_author(_publications(spark, d), "Elizabeth Mitumvik", "id").select("id", "year")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = written(_publications(spark, d))
    return browse.corpus_stats(docs, build_index(docs, PUBLICATIONS, PLAIN, "id"))


def describe_fields(spark: SparkSession, d: str) -> DataFrame:
    return browse.describe_fields(build_index(written(_publications(spark, d)), PUBLICATIONS, PLAIN, "id"))


def substring_browse(spark: SparkSession, d: str) -> DataFrame:
    docs = _publications(spark, d)
    return browse.containing(docs, "WELLBEING", ["title", "abstract", "journal"]).select("id")


def export_documents(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = split_valid(search_documents(_publications(spark, d)), ["id", "title", "abstract"])
    return valid.select("id", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi")


def export_rejected(spark: SparkSession, d: str) -> DataFrame:
    _, bad = split_valid(search_documents(_publications(spark, d)), ["id", "title", "abstract"])
    return bad.select("id", "missing")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    names = _publications(spark, d).select("id", F.posexplode("authors").alias("pos", "a")).select("id", "pos", F.col("a.name").alias("name"))
    key = scalars.author_key(F.col("name"))
    return names.select("id", "pos", scalars.slugify(F.col("name")).alias("slug"), key["initial"].alias("initial"), key["surname"].alias("surname"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _publications(spark, d).select("id", scalars.url_slug(u).alias("slug"), scalars.is_publication_url(u).alias("is_publication"), scalars.same_host(u, F.lit("https://pure.karvelin.example/")).alias("same_host"), scalars.year_of(F.coalesce("year", F.lit(""))).alias("year"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _publications(spark, d).select("id", scalars.snippet(F.col("abstract")).alias("snippet"), scalars.example_title(F.col("title")).alias("short_title"))


def affiliated(spark: SparkSession, d: str) -> DataFrame:
    return _publications(spark, d).where(scalars.is_affiliated(F.col("institutions"), "Centre for Rural Care")).select("id")


def crawl_durations(spark: SparkSession, d: str) -> DataFrame:
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    due = scalars.seconds_until_due(F.col("started_at"), F.lit("2026-06-10 00:00:00").cast("timestamp"), scalars.parse_interval(F.lit("2 weeks")))
    return _table(spark, d, "crawls").select("crawl_id", scalars.crawl_id(F.col("started_at")).alias("made_id"), scalars.format_duration(seconds).alias("took"), due.alias("due_in"))


def latest_crawl(spark: SparkSession, d: str) -> DataFrame:
    done = _table(spark, d, "crawls").where("finished_at is not null").agg(F.max("crawl_id").alias("crawl_id"))
    return _table(spark, d, "crawl_records").join(F.broadcast(done), "crawl_id", "left_semi").groupBy("crawl_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids"))


def link_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What can be reached from the publications of one journal over links between publications and profiles, with the least number of steps."""
    pubs = written(_publications(spark, d).select("id", "journal", "authors"))
    links = pubs.select(F.col("id").alias("src"), F.explode(F.transform("authors", lambda a: a["profile_url"])).alias("dst")).where("dst <> ''")
    edges = written(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    return reachable(edges, pubs.where("journal = 'Journal of Maternal Sociology'").select(F.col("id").alias("url")))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change log: users are the documents, errors delete."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return _table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("doc"))


def log_replay(spark: SparkSession, d: str) -> DataFrame:
    return log.replay(_log(spark, d))


def log_accounting(spark: SparkSession, d: str) -> DataFrame:
    return log.accounting(_log(spark, d))


def log_compaction(spark: SparkSession, d: str) -> DataFrame:
    return log.compacted(_log(spark, d))


def internal_ids(spark: SparkSession, d: str) -> DataFrame:
    return log.dense_ids(log.replay(_log(spark, d)).select("id", "born"), "born").select("id", "internal_id")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").where("category is not null").select("doc_id", "text", F.col("category").alias("label"))


def corpus_sample(spark: SparkSession, d: str) -> DataFrame:
    return balanced_sample(_labelled(spark, d), 50).select("doc_id", "label")


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return label_counts(_labelled(spark, d), LABELS)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return cluster.document_terms(_labelled(spark, d), PLAIN)


def top_features(spark: SparkSession, d: str) -> DataFrame:
    return cluster.features(_terms(spark, d))


def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    terms = written(_terms(spark, d))
    n = _labelled(spark, d).count()
    return cluster.tfidf_weights(terms, written(cluster.features(terms)), n).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten terms by which the mean vector of each label stands out from the mean of the others."""
    terms = written(_terms(spark, d))
    docs = _labelled(spark, d)
    weights = cluster.tfidf_weights(terms, written(cluster.features(terms)), docs.count())
    sizes = F.broadcast(docs.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    sums = weights.join(docs.select("doc_id", "label"), "doc_id").groupBy("label", "term").agg(F.sum("weight").alias("s"))
    centre = sums.join(sizes, "label").select("label", "term", (F.col("s") / F.col("size")).alias("w"))
    others = (F.sum("w").over(Window.partitionBy("term")) - F.col("w")) / (docs.select("label").distinct().agg(F.count(F.lit(1))).scalar() - 1)
    w = Window.partitionBy("label").orderBy(F.col("gain").desc(), "term")
    return centre.withColumn("gain", F.round(F.col("w") - others, 6)).withColumn("k", F.row_number().over(w)).where("k <= 10").select("label", "term", "gain")


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, list[float]]]:
    """The embeddings and the mean of each label."""
    p = _table(spark, d, "embeddings").where("label is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    rows = cluster.label_means(p, "v", "label").orderBy("label", "at").collect()
    centres: dict[int, list[float]] = {}
    for r in rows:
        centres.setdefault(r.label, []).append(r.value)
    return p, centres


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    p, centres = _points(spark, d)
    found = p.withColumn("d", F.array(*[cluster.distance_to(F.col("v"), c) for c in centres.values()]))
    names = F.array(*[F.lit(k) for k in centres])
    return found.select("vec_id", "label", F.get(names, (F.array_position("d", F.array_min("d")) - 1).cast("int")).alias("cluster"), F.array_min("d").alias("nearest"), cluster.margin(F.col("d")).alias("margin"))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("vec_id", "cluster", F.round("nearest", 6).alias("nearest"), F.round("margin", 6).alias("margin"))


def inertia(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).groupBy("cluster").agg(F.round(F.sum(F.col("nearest") * F.col("nearest")), 4).alias("inertia"))


def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    return cluster.agreement(written(_nearest(spark, d).select("label", "cluster")))


def cluster_confusion(spark: SparkSession, d: str) -> DataFrame:
    return cluster.contingency(_nearest(spark, d), "label", "cluster").select(F.col("label").alias("label"), F.col("cluster").alias("predicted"), "n")


def cluster_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return cluster.accuracy(_nearest(spark, d), "label", "cluster")


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    names = cluster.majority_names(_nearest(spark, d), 10, "label", "vec_id")
    return spark.createDataFrame([(k, str(v)) for k, v in names.items()], "cluster int, name string")


def silhouette_exact(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _points(spark, d)
    return cluster.exact_silhouette(p, "vec_id", "v", "label")


def kmeans_documents(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all labelled documents with their sizes, names and agreement with the labels."""
    model, assigned = cluster.ClusterModel.fit(_labelled(spark, d), k=4, restarts=10)
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    name = F.create_map(*[F.lit(x) for i, n in model.names.items() for x in (i, n)])[F.col("cluster")]
    ari = cluster.agreement(assigned).first().ari
    return sizes.select("cluster", name.alias("category"), "size", F.lit(ari).alias("ari"))


def elbow_sweep(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _points(spark, d)
    return cluster.elbow(written(cluster.as_vectors(p, "v").select("features", "label")), range(2, 9), restarts=10, label="label")


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _points(spark, d)
    return cluster.project(cluster.as_vectors(p, "v"), "vec_id")


_ALL = (p3_found, p3_values, analyze_terms, stem_terms, postings, field_lengths, document_lengths, term_df, average_lengths, vocabulary_size, terms_in_document, boolean_and, search_bm25, search_bm25_raw, search_bm25_k1b, search_tfidf,
        search_tfidf_raw, search_page2, search_stemmed, search_batch, match_counts, scorer_agreement, bm25_explain, bm25_saturation, browse_newest, author_rollup, author_listing, corpus_stats, describe_fields, substring_browse,
        export_documents, export_rejected, slugs, url_parts, snippets, affiliated, crawl_durations, latest_crawl, link_frontier, log_replay, log_accounting, log_compaction, internal_ids, corpus_sample, corpus_counts, top_features,
        tfidf_vectors, distinctive_terms, nearest_centroid, inertia, cluster_agreement, cluster_confusion, cluster_accuracy, majority_vote, silhouette_exact, kmeans_documents, elbow_sweep, pca_2d)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


_LATEST = "row_number() OVER (PARTITION BY {0} ORDER BY try_cast(nullif(trim(crawled_at), '') AS TIMESTAMPTZ) DESC NULLS LAST)"
_NORMAL = ", ".join(f"trim(coalesce({c}, '')) AS {c}" for c in COMPARED)
_SNAPSHOTS = f"""WITH o AS (SELECT crawl_id, row_number() OVER (ORDER BY started_at, crawl_id) AS k FROM crawls WHERE finished_at IS NOT NULL),
    r AS (SELECT k, r.*, {_LATEST.format('k, id')} AS rn FROM crawl_records r JOIN o USING (crawl_id)),
    s AS (SELECT k, id, authors, {_NORMAL} FROM r WHERE rn = 1),
    c AS (SELECT coalesce(n.k, p.k + 1) AS k, coalesce(n.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
            WHEN n.authors IS DISTINCT FROM p.authors OR n.title <> p.title OR n.abstract <> p.abstract OR n.journal <> p.journal OR n.year <> p.year OR n.doi <> p.doi OR n.keywords <> p.keywords THEN 'changed' END AS change_kind,
            p AS p, n AS n
          FROM s n FULL JOIN s p ON n.id = p.id AND n.k = p.k + 1)"""
_MIDDLE = "FROM c JOIN o USING (k) WHERE c.change_kind IS NOT NULL AND k > 1"
_CUR = f"cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {_LATEST.format('id')} AS rn FROM publications) WHERE rn = 1)"
_STOPS = "['" + "', '".join(w.replace("'", "''") for w in STOPWORDS) + "']"


def _analyzed(text: str) -> str:
    return f"""list_filter(flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[''-][a-z0-9]+)*'), lambda x: CASE WHEN contains(x, '-') THEN list_concat([x], string_split(x, '-')) ELSE [x] END)), lambda x: length(x) >= 2 AND NOT list_contains({_STOPS}, x))"""


_INDEX = f"""WITH {_CUR},
    txt AS (SELECT id AS doc, 'title' AS field, 3.0::DOUBLE AS w, title AS t FROM cur UNION ALL SELECT id, 'authors', 2.0, array_to_string(list_transform(authors, lambda a: coalesce(a.name, '')), ' ') FROM cur
            UNION ALL SELECT id, 'abstract', 1.0, abstract FROM cur UNION ALL SELECT id, 'journal', 1.0, journal FROM cur),
    ana AS (SELECT doc, field, w, {_analyzed('t')} AS terms FROM txt WHERE t IS NOT NULL),
    tok AS (SELECT doc, field, w, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM ana),
    po AS (SELECT term, doc, field, w, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ' ') AS positions FROM tok GROUP BY ALL),
    fl AS (SELECT ana.doc, ana.field, len(any_value(terms)) AS length, coalesce(sqrt(sum(power(1 + log10(tf), 2))), 0) AS norm FROM ana LEFT JOIN po ON po.doc = ana.doc AND po.field = ana.field GROUP BY ana.doc, ana.field),
    n AS (SELECT count(*) AS n FROM cur), df AS (SELECT term, count(DISTINCT doc) AS df FROM po GROUP BY term),
    av AS (SELECT field, sum(length)::BIGINT AS total, sum(length) / (SELECT n FROM n) AS avg FROM fl GROUP BY field)"""


def _scores(scorer: str, coordinated: bool = True, k1: str = "1.2::DOUBLE", b: str = "0.75::DOUBLE", asked: str | None = None) -> str:
    """Scores of all hits of a query table ``q(query_id, text)``."""
    q = asked or f"SELECT 0 AS query_id, '{QUERY}' AS text"
    part = (f"ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / avg))" if scorer == "bm25" else "(1 + log10(qtf)) * log10(n.n / df) * (1 + log10(tf)) / norm")
    scale = "CASE WHEN any_value(found) < 2 THEN 1 ELSE count(DISTINCT term)::DOUBLE / any_value(found) END" if coordinated else "1"
    return f"""{_INDEX}, q AS ({q}), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_analyzed('text')}) AS term FROM q) GROUP BY ALL),
    qd AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS found FROM qt JOIN df USING (term)),
    sc AS (SELECT query_id, po.doc, round(sum(w * {part}) * {scale}, 9) AS score FROM qd JOIN po USING (term) JOIN fl ON fl.doc = po.doc AND fl.field = po.field JOIN av ON av.field = po.field, n GROUP BY query_id, po.doc),
    rk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM sc)"""


def _hits(scorer: str, low: int = 0, high: int = 10) -> str:
    return f"{_scores(scorer)} SELECT rank, doc, round(score, 6) AS score FROM rk WHERE rank > {low} AND rank <= {high}"


_QUESTIONS = "SELECT ref_id AS query_id, name AS text FROM ref_names"
_SLUG = "trim(regexp_replace(lower(regexp_replace(strip_accents(translate(a.name, '⁰¹²³⁴⁵⁶⁷⁸⁹\u00a0', '0123456789 ')), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"
_LOG = "WITH l AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, user_id::VARCHAR AS id, props AS doc FROM events WHERE user_id IS NOT NULL), "
_LIVE = f"""{_LOG} x AS (SELECT id, max(seq) AS last, coalesce(max(seq) FILTER (op = 'delete'), -1) AS gone FROM l GROUP BY id),
    live AS (SELECT l.id, any_value(l.doc) FILTER (l.seq = x.last) AS doc, max(x.last) AS seq, min(l.seq) FILTER (l.op = 'put' AND l.seq > x.gone) AS born FROM l JOIN x USING (id) WHERE x.last > x.gone GROUP BY l.id)"""
_LAB = "lab AS (SELECT doc_id, text, category AS label FROM documents WHERE category IS NOT NULL)"
_TF = f"""WITH {_LAB}, tt AS (SELECT doc_id, unnest({_analyzed('text')}) AS term FROM lab), tf AS (SELECT doc_id, term, count(*) AS tf FROM tt GROUP BY ALL),
    fe AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000)"""
_VEC = f"""{_TF}, wr AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM lab)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN fe USING (term)),
    vec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wr)"""
_POINTS = """WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS ax FROM embeddings WHERE label IS NOT NULL),
    ce AS (SELECT label AS cluster, ax, avg(x) AS c FROM p GROUP BY ALL), di AS (SELECT vec_id, label, cluster, sqrt(sum((x - c) * (x - c))) AS d FROM p JOIN ce USING (ax) GROUP BY ALL),
    ne AS (SELECT vec_id, label, cluster, d AS nearest, lead(d) OVER (PARTITION BY vec_id ORDER BY d) AS second, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS k FROM di),
    na AS (SELECT *, CASE WHEN second IS NULL OR second = 0 THEN 0 ELSE 1 - nearest / second END AS margin FROM ne WHERE k = 1)"""


def oracle_sql() -> dict[str, str]:
    texts = {f: (f"p.{f}", f"n.{f}") for f in COMPARED} | {"authors": ("to_json(p.authors)::VARCHAR", "to_json(n.authors)::VARCHAR")}
    values = " UNION ALL ".join(f"SELECT crawl_id, id, '{f}' AS field_name, {old} AS old_value, {new} AS new_value {_MIDDLE} AND change_kind = 'changed' AND {old} IS DISTINCT FROM {new}" for f, (old, new) in texts.items())
    year = "coalesce(year, '')"
    return {
        "p3_found": f"{_SNAPSHOTS} SELECT crawl_id, id, change_kind {_MIDDLE}",
        "p3_values": f"{_SNAPSHOTS} {values}",
        "analyze_terms": f"{_INDEX} SELECT doc AS id, pos::INTEGER AS pos, term FROM tok WHERE field = 'abstract'",
        "postings": f"{_INDEX} SELECT term, doc, field, tf::INTEGER AS tf, positions FROM po",
        "field_lengths": f"{_INDEX} SELECT doc, field, length::INTEGER AS length, round(norm, 6) AS norm FROM fl",
        "document_lengths": f"{_INDEX} SELECT doc, sum(length)::BIGINT AS length FROM fl GROUP BY doc",
        "term_df": f"{_INDEX} SELECT term, df::BIGINT AS df FROM df",
        "average_lengths": f"{_INDEX} SELECT field, total AS total_length, round(avg, 6) AS average_length FROM av",
        "vocabulary_size": f"{_INDEX} SELECT count(DISTINCT term) AS vocabulary_size FROM po",
        "terms_in_document": f"{_INDEX} SELECT doc, count(DISTINCT term) AS terms FROM po GROUP BY doc",
        "boolean_and": f"{_INDEX} SELECT doc FROM po WHERE term IN ('digital', 'support') GROUP BY doc HAVING count(DISTINCT term) = 2",
        "search_bm25": _hits("bm25"), "search_tfidf": _hits("tf-idf"), "search_page2": _hits("bm25", 10, 20),
        "search_bm25_raw": f"{_scores('bm25', False)} SELECT doc, round(score, 6) AS score FROM sc",
        "search_bm25_k1b": f"{_scores('bm25', True, '0.9::DOUBLE', '0.4::DOUBLE')} SELECT doc, round(score, 6) AS score FROM sc",
        "search_tfidf_raw": f"{_scores('tf-idf', False)} SELECT doc, round(score, 6) AS score FROM sc",
        "search_batch": f"{_scores('bm25', asked=_QUESTIONS)} SELECT query_id, rank, doc, round(score, 6) AS score FROM rk WHERE rank <= 5",
        "match_counts": f"""{_INDEX}, qt AS (SELECT DISTINCT ref_id AS query_id, unnest({_analyzed('name')}) AS term FROM ref_names), qn AS (SELECT query_id, count(*) AS c FROM qt GROUP BY ALL),
            h AS (SELECT query_id, doc, count(DISTINCT term) AS k FROM qt JOIN po USING (term) GROUP BY ALL) SELECT query_id, count(*) AS any_term, count(*) FILTER (k = c) AS all_terms FROM h JOIN qn USING (query_id) GROUP BY query_id""",
        "bm25_explain": f"""{_INDEX}, e AS (SELECT po.doc, po.field, tf, length, ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, length / avg AS ratio, tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * (length / avg)) AS den FROM po JOIN df USING (term) JOIN fl ON fl.doc = po.doc AND fl.field = po.field JOIN av ON av.field = po.field, n WHERE term = 'wellbeing')
            SELECT doc, field, tf::INTEGER AS tf, length::INTEGER AS length, round(idf, 6) AS idf, round(ratio, 6) AS ratio, round(den, 6) AS denominator, round(tf * 2.2::DOUBLE / den, 6) AS saturation, round(idf * tf * 2.2::DOUBLE / den, 6) AS score FROM e""",
        "bm25_saturation": "SELECT tf::INTEGER AS tf, round(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE), 6) AS saturation FROM (SELECT unnest([1, 2, 3, 5, 10, 25, 100, 1000]) AS tf)",
        "browse_newest": f"WITH {_CUR} SELECT id, title, year FROM cur ORDER BY {year} DESC, id LIMIT 20 OFFSET 20",
        "author_rollup": f"""WITH {_CUR}, e AS (SELECT id, {year} AS y, unnest(authors) AS a, authors FROM cur), f AS (SELECT id, y, a.name AS name, a.profile_url AS url, authors FROM e WHERE a.name <> ''),
            o AS (SELECT name, count(DISTINCT x) AS c FROM (SELECT name, unnest(list_transform(authors, lambda z: z.name)) AS x FROM f) WHERE x <> '' AND x <> name GROUP BY name)
            SELECT f.name, count(DISTINCT id) AS publication_count, coalesce(any_value(o.c), 0) AS co_author_count, coalesce(arg_min(url, id) FILTER (url <> ''), '') AS profile_url, coalesce(min(nullif(y, '')), '') AS first_year, coalesce(max(nullif(y, '')), '') AS last_year
            FROM f LEFT JOIN o ON o.name = f.name GROUP BY f.name""",
        "author_listing": f"WITH {_CUR} SELECT id, year FROM cur WHERE list_contains(list_transform(authors, lambda a: a.name), 'Elizabeth Mitumvik')",
        "corpus_stats": f"{_INDEX} SELECT (SELECT n FROM n) AS document_count, (SELECT count(DISTINCT term) FROM po) AS vocabulary_size, (SELECT max(nullif(crawled_at, '')) FROM cur) AS last_crawled_at",
        "describe_fields": f"""{_INDEX}, k AS (SELECT * FROM (VALUES ('id', false, true, 1.0), ('title', true, true, 3.0), ('authors', true, true, 2.0), ('abstract', true, true, 1.0), ('journal', true, true, 1.0), ('year', false, true, 1.0), ('url', false, true, 1.0), ('doi', false, true, 1.0), ('crawled_at', false, true, 1.0)) AS v(field, indexed, stored, weight))
            SELECT field, indexed, stored, weight::DOUBLE AS weight, round(avg, 1) AS average_length FROM k LEFT JOIN av USING (field)""",
        "substring_browse": f"WITH {_CUR} SELECT id FROM cur WHERE contains(lower(concat_ws(' ', id, title, abstract, journal)), 'wellbeing')",
        "export_documents": f"WITH {_CUR} SELECT regexp_extract(rtrim(id, '/'), '[^/]*$') AS id, title, array_to_string(list_transform(authors, lambda a: a.name), '; ') AS authors, try_cast(year AS INTEGER) AS year, doi FROM cur WHERE title <> '' AND abstract <> ''",
        "export_rejected": f"WITH {_CUR} SELECT regexp_extract(rtrim(id, '/'), '[^/]*$') AS id, CASE WHEN coalesce(title, '') = '' THEN 'title' ELSE 'abstract' END AS missing FROM cur WHERE coalesce(title, '') = '' OR coalesce(abstract, '') = ''",
        "slugs": f"WITH {_CUR}, e AS (SELECT id, unnest(authors) AS a, unnest(range(len(authors))) AS pos FROM cur), s AS (SELECT id, pos, {_SLUG} AS slug FROM e) SELECT id, pos::INTEGER AS pos, slug, left(string_split(slug, '-')[1], 1) AS initial, string_split(slug, '-')[-1] AS surname FROM s",
        "url_parts": f"WITH {_CUR} SELECT id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS slug, contains(url, '/en/publications/') AS is_publication, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) = 'pure.karvelin.example' AS same_host, CASE WHEN regexp_full_match(left(coalesce(year, ''), 4), '[0-9]+') THEN left(year, 4) ELSE '' END AS year FROM cur",
        "snippets": f"WITH {_CUR} SELECT id, CASE WHEN length(abstract) > 280 THEN rtrim(left(abstract, 280)) || '…' ELSE abstract END AS snippet, array_to_string(string_split(title, ' ')[1:4], ' ') || '…' AS short_title FROM cur",
        "affiliated": f"WITH {_CUR} SELECT id FROM cur WHERE len(list_filter(institutions, lambda i: contains(lower(i), 'centre for rural care'))) > 0",
        "crawl_durations": """WITH s AS (SELECT *, epoch_us(finished_at) / 1e6::DOUBLE - epoch_us(started_at) / 1e6::DOUBLE AS s FROM crawls) SELECT crawl_id, strftime(started_at::TIMESTAMPTZ AT TIME ZONE 'Asia/Kathmandu', '%Y-%m-%d-%H-%M-%S-NPT') AS made_id,
            CASE WHEN s < 60 THEN printf('%.0fs', s) WHEN s < 3600 THEN printf('%.1f minutes', s / 60) WHEN s < 86400 THEN printf('%.1f hours', s / 3600) ELSE printf('%.1f days', s / 86400) END AS took,
            greatest(1209600 - (epoch_us(TIMESTAMPTZ '2026-06-10 00:00:00+00') - epoch_us(started_at)) / 1e6::DOUBLE, 0)::DOUBLE AS due_in FROM s""",
        "latest_crawl": "SELECT crawl_id, count(*) AS records, count(DISTINCT id) AS ids FROM crawl_records WHERE crawl_id = (SELECT max(crawl_id) FROM crawls WHERE finished_at IS NOT NULL) GROUP BY crawl_id",
        "link_frontier": f"""WITH RECURSIVE {_CUR}, l AS (SELECT DISTINCT id AS src, dst FROM (SELECT id, unnest(list_transform(authors, lambda a: a.profile_url)) AS dst FROM cur) WHERE dst <> ''), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
            r AS (SELECT id AS url, 0 AS depth FROM cur WHERE journal = 'Journal of Maternal Sociology' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 14) SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY url""",
        "log_replay": f"{_LIVE} SELECT id, doc, seq, born FROM live",
        "log_accounting": f"{_LIVE} SELECT (SELECT count(*) FROM l) AS log_entries, (SELECT count(*) FROM live) AS live_documents, (SELECT count(*) FROM l) - (SELECT count(*) FROM live) AS dead_entries",
        "log_compaction": f"{_LIVE} SELECT born AS seq, 'put' AS op, id, doc FROM live",
        "internal_ids": f"{_LIVE} SELECT id, row_number() OVER (ORDER BY born) - 1 AS internal_id FROM live",
        "corpus_sample": f"WITH {_LAB} SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS k FROM lab) WHERE k <= 50",
        "corpus_counts": f"WITH {_LAB}, o AS (SELECT * FROM (VALUES (0, 'Economics'), (1, 'Entertainment'), (2, 'Health'), (3, 'Politics')) AS v(position, label)) SELECT position::INTEGER AS position, o.label, count(doc_id) AS documents FROM o LEFT JOIN lab ON lab.label = o.label GROUP BY ALL",
        "top_features": f"{_TF} SELECT term, df, total FROM fe",
        "tfidf_vectors": f"{_VEC} SELECT doc_id, term, round(weight, 6) AS weight FROM vec",
        "distinctive_terms": f"""{_VEC}, sz AS (SELECT label, count(*) AS c FROM lab GROUP BY label), ce AS (SELECT label, term, sum(weight) / any_value(c) AS w FROM vec JOIN lab USING (doc_id) JOIN sz USING (label) GROUP BY ALL),
            g AS (SELECT label, term, round(w - (sum(w) OVER (PARTITION BY term) - w) / ((SELECT count(*) FROM sz) - 1), 6) AS gain FROM ce) SELECT label, term, gain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, term) AS k FROM g) WHERE k <= 10""",
        "nearest_centroid": f"{_POINTS} SELECT vec_id, cluster, round(nearest, 6) AS nearest, round(margin, 6) AS margin FROM na",
        "inertia": f"{_POINTS} SELECT cluster, round(sum(nearest * nearest), 4) AS inertia FROM na GROUP BY cluster",
        "cluster_agreement": f"""{_POINTS}, t AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM na GROUP BY ALL), a AS (SELECT label, sum(n) AS a FROM t GROUP BY ALL), b AS (SELECT cluster, sum(n) AS b FROM t GROUP BY ALL), z AS (SELECT sum(n) AS n FROM t),
            m AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(a * (a - 1) / 2) FROM a) AS sa, (SELECT sum(b * (b - 1) / 2) FROM b) AS sb, z.n * (z.n - 1) / 2 AS p,
                (SELECT sum(t.n / z.n * ln(t.n * z.n / (a * b))) FROM t JOIN a USING (label) JOIN b USING (cluster)) AS mi, (SELECT -sum(a / z.n * ln(a / z.n)) FROM a) AS ha, (SELECT -sum(b / z.n * ln(b / z.n)) FROM b) AS hb FROM z)
            SELECT round((s - sa * sb / p) / ((sa + sb) / 2 - sa * sb / p), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM m""",
        "cluster_confusion": f"{_POINTS} SELECT label, cluster AS predicted, count(*) AS n FROM na GROUP BY ALL",
        "cluster_accuracy": f"{_POINTS} SELECT round(avg((label = cluster)::INTEGER), 6) AS accuracy FROM na",
        "majority_vote": f"{_POINTS}, v AS (SELECT cluster, label, count(*) AS n, min(vec_id) AS f FROM na GROUP BY ALL), r AS (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS k FROM v) SELECT i::INTEGER AS cluster, coalesce(label::VARCHAR, 'cluster-' || i) AS name FROM range(10) AS g(i) LEFT JOIN r ON r.cluster = i AND k = 1",
        "silhouette_exact": """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS c FROM p a CROSS JOIN p b GROUP BY ALL),
            x AS (SELECT vec_id, max(CASE WHEN other = label THEN s / nullif(c - 1, 0) END) AS a, min(CASE WHEN other <> label THEN s / c END) AS b FROM d GROUP BY vec_id) SELECT vec_id, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM x""",
    }
