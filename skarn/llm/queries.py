"""Queries of this package, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.canon import map_to_canonical
from skarn.llm.common import current, table
from skarn.llm.leaks import find_leaks, leak_report
from skarn.llm.markup import clean_texts, marked
from skarn.llm.mixing import mix_plan, reached, realise, source_name, token_counts
from skarn.llm.names import link_authors
from skarn.llm.neardup import NearDuplicates, near_duplicates
from skarn.llm.residue import find_residue, without_residue
from skarn.llm.termstats import term_frequencies, term_scores, top_terms
from skarn.session import written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return map_to_canonical(current(spark, d, "publications", ["journal", "institutions"]), table(spark, d, "ref_names"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that no entry is meant by: how many values of each field and in how many publications."""
    rows = p1_found(spark, d).where("ref_id = -1")
    return rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("values"), F.count_distinct("publication_id").alias("publications"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(written(current(spark, d, "publications", ["title", "abstract"]), "publications"), ["title", "abstract"])


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("term", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scores = term_scores(current(spark, d, "publications", ["title", "abstract", "keywords"]), ["title", "abstract", "keywords"], k1=None, form="plain", least_records=2)
    return top_terms(scores, 3).select(F.col("id").alias("publication_id"), "term")


def p4_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The ten most relevant terms of each publication with saturation and length normalisation."""
    scores = term_scores(current(spark, d, "publications", ["title", "abstract", "keywords"]), ["title", "abstract", "keywords"])
    return top_terms(scores, 10).select(F.col("id").alias("publication_id"), "term", "tf", "df", "score")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return link_authors(current(spark, d, "publications", ["authors"]), current(spark, d, "persons", ["name"]))


def _similar(spark: SparkSession, d: str) -> NearDuplicates:
    return near_duplicates(current(spark, d, "publications", ["title", "abstract"]), ["title", "abstract"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).pairs()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of similar publications: each record's class of equal texts, its number of links and its group."""
    return _similar(spark, d).groups()


def _pages(spark: SparkSession, d: str) -> DataFrame:
    host = lambda c: F.nullif(F.regexp_extract(F.col(c), r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    pubs = current(spark, d, "publications", ["abstract", "url"]).select(F.lit("publication").alias("kind"), "id", host("url").alias("host"), F.col("abstract").alias("text"))
    people = current(spark, d, "persons", ["biography", "url"]).select(F.lit("person").alias("kind"), "id", host("url").alias("host"), F.col("biography").alias("text"))
    return pubs.unionByName(people)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_texts(_pages(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return marked(_pages(spark, d)).where("marks > 0").select("record_kind", "record_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Passages that may differ by up to three characters."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=3)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(p8_found(spark, d), table(spark, d, "eval_items"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target shares and the shares that the mix reaches, measured on it."""
    counts = written(token_counts(table(spark, d, "documents")), "token-counts")
    return reached(counts, mix_plan(counts, table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mix_plan(written(token_counts(table(spark, d, "documents")), "token-counts"), table(spark, d, "mix_targets")).where("limited").select("source")


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix without weights: the sizes are tempered as flat as the allowed repeats let them be."""
    counts = written(token_counts(table(spark, d, "documents")), "token-counts")
    return reached(counts, mix_plan(counts, table(spark, d, "mix_targets"), weighted=False)).drop("target_share", "limited")


def p9_chars(spark: SparkSession, d: str) -> DataFrame:
    """The plan of the mix with sizes in characters."""
    docs = table(spark, d, "documents")
    counts = docs.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    plan = mix_plan(counts, table(spark, d, "mix_targets"))
    return plan.select("source", "size", F.round("target_share", 6).alias("target_share"), "limited", F.round("reached_share", 6).alias("planned_share"), F.round("repeats", 4).alias("repeats"), F.round("exponent", 6).alias("exponent"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: how often each document is taken."""
    counts = written(token_counts(table(spark, d, "documents")), "token-counts")
    return realise(counts, mix_plan(counts, table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).select("doc_id")


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each source: its documents without residue and their characters."""
    kept = without_residue(table(spark, d, "documents").select("doc_id", "text", "source"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))


def queries() -> dict[str, Query]:
    found = (p1_found, p1_unmatched, p2_found, p2_terms, p4_found, p4_relevance, p5_found, p6_found, p6_groups, p7_found, p7_clean, p8_found, p8_edited, p8_items, p9_found, p9_shares, p9_tempered, p9_chars, p9_mix, p10_found, p10_kept)
    return {f.__name__: f for f in found}


_CURRENT = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT id, title, abstract, keywords, row_number() OVER (PARTITION BY id ORDER BY try_cast(nullif(trim(crawled_at), '') AS TIMESTAMPTZ) DESC NULLS LAST) AS rn FROM publications) WHERE rn = 1)"""
_TOKEN = "'[a-z0-9]+(?:[''-][a-z0-9]+)*'"


def _words(fields: list[str]) -> str:
    lists = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), {_TOKEN})" for f in fields)
    return f"tok AS (SELECT id, term FROM (SELECT id, unnest(flatten([{lists}])) AS term FROM cur) WHERE regexp_matches(term, '[a-z]'))"


def _term_sql(columns: str, where: str) -> str:
    return f"""WITH {_CURRENT}, {_words(['title', 'abstract'])},
    n AS (SELECT count(*) AS n FROM cur),
    t AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records FROM tok GROUP BY term),
    m AS (SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 > n.n THEN 'common' END AS mark FROM t, n)
    SELECT {columns} FROM m {where}"""


def oracle_sql() -> dict[str, str]:
    fields = ["title", "abstract", "keywords"]
    base = f"""WITH {_CURRENT}, {_words(fields)}, n AS (SELECT count(*) AS n FROM cur),
    tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
    return {
        "p2_found": _term_sql("term, mark", "WHERE mark IS NOT NULL"),
        "p2_terms": _term_sql("term, occurrences, records, mark", ""),
        "p4_found": f"""{base}, s AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n.n / df), 6) DESC, term) AS k FROM tf JOIN df USING (term), n WHERE df >= 2)
    SELECT id AS publication_id, term FROM s WHERE k <= 3""",
        "p4_relevance": f"""{base}, len AS (SELECT id, sum(tf) AS len FROM tf GROUP BY id), a AS (SELECT (SELECT sum(tf) FROM tf) / n.n AS avg FROM n),
    s AS (SELECT id, term, tf, df, round(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a.avg)), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (id), n, a),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS k FROM s)
    SELECT id AS publication_id, term, tf::BIGINT AS tf, df::BIGINT AS df, score FROM k WHERE k <= 10""",
        "p6_found": f"{_SIMILAR} SELECT id_a, id_b FROM pairs",
        "p6_groups": f"""{_SIMILAR}, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
    r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), g AS (SELECT a AS id, min(b) AS group_id FROM r GROUP BY a),
    q AS (SELECT id, list(s ORDER BY s) AS q FROM s GROUP BY id), k AS (SELECT id, min(id) OVER (PARTITION BY q) AS class_id, count(*) OVER (PARTITION BY q) AS class_size FROM q), l AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
    SELECT id, class_id, class_size, coalesce(links, 0) AS links, group_id FROM k JOIN g USING (id) LEFT JOIN l USING (id)""",
        "p8_found": _LEAKS + " SELECT doc_id, item_id FROM found",
        "p9_found": f"{_MIX} SELECT source FROM m WHERE size * r < share * budget",
        "p9_chars": f"""{_MIX}, h AS (SELECT -sum(share * ln(share)) FILTER (share > 0) AS h FROM m),
    b AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL SELECT k + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END
          FROM (SELECT k, low, high, mid, -list_sum([q * ln(q) FOR q IN [x / list_sum(p) FOR x IN p]]) > (SELECT h FROM h) AS flat
                FROM (SELECT k, low, high, (low + high) / 2 AS mid, [power(z, (low + high) / 2) FOR z IN (SELECT list(size::DOUBLE) FROM m WHERE size > 0)] AS p FROM b WHERE k < 60))),
    ent AS (SELECT e, -list_sum([q * ln(q) FOR q IN [x / list_sum(p) FOR x IN p]]) AS v FROM (SELECT e, [power(z, e) FOR z IN (SELECT list(size::DOUBLE) FROM m WHERE size > 0)] AS p FROM (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS e))),
    ex AS (SELECT CASE WHEN (SELECT v FROM ent WHERE e = 0) <= h THEN 0 WHEN (SELECT v FROM ent WHERE e = 1) > h THEN 1 ELSE (SELECT high FROM b WHERE k = 60) END AS exponent FROM h),
    g AS (SELECT m.*, exponent, least(size * r, share * budget) AS base, size * r - least(size * r, share * budget) AS room, power(size::DOUBLE, exponent) AS t FROM m, ex),
    o AS (SELECT *, room / t AS mark FROM g WHERE room > 0 AND size > 0), rest AS (SELECT max(budget) - sum(base) AS rest FROM g),
    c AS (SELECT *, coalesce(sum(room) OVER (ORDER BY mark, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(t) OVER (ORDER BY mark, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM o),
    l AS (SELECT max((rest - filled) / after) AS level FROM c, rest), f AS (SELECT g.*, base + CASE WHEN room > 0 AND size > 0 THEN least(room, level * t) ELSE 0 END AS given FROM g, l)
    SELECT source, size, round(share, 6) AS target_share, size * r < share * budget AS limited, round(given / budget, 6) AS planned_share, round(CASE WHEN size > 0 THEN given / size ELSE 0 END, 4) AS repeats, round(exponent, 6) AS exponent FROM f""",
        "p8_items": _LEAKS + " SELECT e.item_id, e.task, count(f.doc_id)::BIGINT AS documents FROM eval_items e LEFT JOIN found f USING (item_id) GROUP BY ALL",
    }


_NAMED = "regexp_replace(lower(trim(source)), '[_\\s]', '-', 'g')"
_MIX = f"""WITH RECURSIVE t AS (SELECT {_NAMED} AS source, sum(weight) AS w, max(max_repeats) AS r FROM mix_targets GROUP BY ALL), d AS (SELECT {_NAMED} AS source, sum(length(text)) AS n FROM documents GROUP BY ALL),
    m AS (SELECT source, coalesce(n, 0)::BIGINT AS size, r, w / sum(w) OVER () AS share, (sum(coalesce(n, 0)) OVER ())::DOUBLE AS budget FROM t LEFT JOIN d USING (source))"""
_SIMILAR = f"""WITH RECURSIVE {_CURRENT}, w AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[a-z0-9]+') AS w FROM cur),
    s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
    c AS (SELECT id, count(*) AS c FROM s GROUP BY id), h AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
    pairs AS (SELECT id_a, id_b FROM h JOIN c x ON x.id = id_a JOIN c y ON y.id = id_b WHERE 2 * k >= x.c + y.c - k)"""
_LEAKS = r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) >= 10),
    dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
    found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))"""
