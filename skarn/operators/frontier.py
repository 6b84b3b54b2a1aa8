"""Traversal of a link graph over landed pages.

The pages are a table, not a network: each round joins a frontier of URLs to it and takes
what it hasn't visited. A round is one written step, so the plan doesn't grow with depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.scalars import fetch_outcome, is_affiliated, is_publication_url
from skarn.session import bucketed, written
from skarn.sources.html import pair_authors, persons, publications, section_links, with_parts

URLS = "url string"


def reachable(edges: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``(url, depth)`` of everything reachable from ``seeds(url)`` over ``edges(src, dst)``, with its least depth.

    The edges are bucketed by their source once, so that a round shuffles its frontier only. Each round writes its new URLs by depth;
    every ten rounds those before are merged into one table. Raises if URLs are left after ``most_rounds``.
    """
    frontier = written(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited = frontier
    with bucketed(edges.select("src", "dst").where("src is not null and dst is not null"), "src", "edges") as out:
        for depth in range(1, most_rounds + 1):
            if frontier.isEmpty():
                return visited
            fresh = out.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
            frontier = written(fresh.withColumn("depth", F.lit(depth)), "frontier")
            visited = visited.unionByName(frontier)
            if depth % 10 == 0:
                visited = written(visited, "visited")
    if not frontier.isEmpty():
        raise RuntimeError(f"more than {most_rounds} rounds")
    return visited


def listed(pages: DataFrame, organisation: str, section: str, base: str, most_pages: int = 5) -> DataFrame:
    """``(url, first_page)``: links of the numbered listing pages, up to the first that can't be read or adds nothing.

    A live page that can't be read is replaced by ``snapshot(section, page)`` html in the column ``saved``, where the table has one.
    """
    numbers = pages.sparkSession.range(most_pages).select(F.col("id").cast("int").alias("page"), F.concat(F.lit(f"{organisation.rstrip('/')}/{section}/?page="), F.col("id").cast("string")).alias("url"))
    live = F.when(fetch_outcome(F.col("status")) == "ok", F.col("html"))
    html = F.coalesce(live, F.col("saved")) if "saved" in pages.columns else live
    read = with_parts(numbers.join(pages, "url").select("page", "url", html.alias("html")).where("html is not null"))
    links = read.select("page", F.explode(section_links(F.col("p.hrefs"), section, base)).alias("url"))
    first = links.groupBy("url").agg(F.min("page").alias("first_page"))
    new = {r.first_page: r.k for r in first.groupBy("first_page").agg(F.count(F.lit(1)).alias("k")).collect()}
    stop = next((p for p in range(most_pages) if not new.get(p)), most_pages)
    return first.where(F.col("first_page") < stop)


@dataclass
class CrawlResult:
    publications: DataFrame
    persons: DataFrame
    visits: DataFrame
    stats: DataFrame


def crawl(pages: DataFrame, organisation: str, slug: str, base: str, affiliation: str = "", require_affiliation: bool = False, crawled_at: str = "", most_rounds: int = 1000, most_publications: int | None = None) -> CrawlResult:
    """The records reachable from an organisation's page within landed ``pages(url, status, html)``.

    Seeds are the organisation's listings, or the links of its own page where there is no listing. Every publication leads to the profiles it
    links and every member's profile (one that links the organisation) to the publications it lists. Where a listing exists, publications
    that only a profile lists are left out. Each URL is visited once; a page that is missing, unchanged or not 2xx gives nothing.
    With ``most_publications`` only so many publications are kept, those met first (by depth, then URL).
    """
    pages = pages.withColumn("outcome", fetch_outcome(F.col("status")))
    parsed = written(with_parts(pages.where("outcome = 'ok'").select("url", "html")).drop("html").dropDuplicates(["url"]), "pages")
    home = parsed.where(F.col("url") == organisation)

    def seeds(section: str) -> tuple[DataFrame, bool]:
        found = written(listed(pages, organisation, section, base).select("url"), "listing")
        own = home.limit(1).count() > 0
        if not own:
            return found.limit(0), False
        if found.limit(1).count():
            return found, True
        return home.select(F.explode(section_links(F.col("p.hrefs"), section, base)).alias("url")).distinct(), False

    listing, known = seeds("publications")
    members, _ = seeds("persons")
    listing = written(listing, "seeds")
    known = listing.limit(1).count() > 0
    member = F.exists("p.hrefs", lambda h: F.contains(h, F.lit(slug)))
    kind = is_publication_url(F.col("url"))
    out = F.when(kind, F.when(F.col("p.title") != "", section_links(F.col("p.hrefs"), "persons", base))).when(member, section_links(F.col("p.hrefs"), "publications", base))
    edges = written(parsed.select(F.col("url").alias("src"), F.explode(out).alias("dst")), "edges")
    if known:
        edges = edges.where(~is_publication_url(F.col("dst"))).unionByName(edges.where(is_publication_url(F.col("dst"))).join(listing.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst"))
    visits = reachable(edges, listing.unionByName(members.select("url")), most_rounds)
    read = written(parsed.join(visits, "url"), "read")
    all_pubs = pair_authors(publications(read.where(kind), base, crawled_at))
    affiliated = is_affiliated(F.col("institutions"), affiliation)
    kept = all_pubs.where(affiliated) if require_affiliation else all_pubs
    if most_publications is not None:
        kept = kept.join(visits.select(F.col("url").alias("id"), "depth"), "id").orderBy("depth", "id").limit(most_publications).select(*all_pubs.columns)
    profiles = read.where(~kind)
    people = persons(profiles.where(member), crawled_at)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar().alias(name)
    stats = pages.sparkSession.range(1).select(
        count(members, "members_seeded"), count(profiles.where(member), "members_found"), count(profiles.where(~member), "profiles_rejected"), count(read.where(kind), "publication_urls_seen"), count(kept, "publications_kept"),
        count(all_pubs.where(affiliated), "affiliation_verified"), count(read.where(kind & (F.col("p.title") == "")), "skipped_unparseable"), count(visits.join(parsed, "url", "left_anti"), "unreadable"))
    return CrawlResult(kept, people, visits, stats)


def changed_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of ``new(url, html, etag)`` whose validator, or else content, differs from ``old``; unchanged records can then be carried over."""
    mark = F.coalesce(F.when(F.col("etag") != "", F.col("etag")), F.md5("html"))
    before = old.select("url", mark.alias("_mark")).distinct()
    return new.withColumn("_mark", mark).join(before, ["url", "_mark"], "left_anti").drop("_mark")
