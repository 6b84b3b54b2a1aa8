"""Records from HTML pages: publications, persons and links.

Pages are parsed once per row in Arrow batches by a small tree builder over the standard
parser; everything after that (pairing of authors, years, filters) is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.terms import let
from skarn.functions.scalars import slug_key, slugify_all, url_slug, year_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Where a page keeps its abstract and its biography, in order of preference; a path is (tag, class) from outside in.
ABSTRACT = [[("div", "textblock")], [("div", "rendering_abstractportal")], [("div", "abstract")]]
BIOGRAPHY = [[("div", "rendering_profileinformationportal"), ("div", "textblock")], [("section", "person-profileinformation"), ("div", "textblock")]]
META = {"title": "citation_title", "journal": "citation_journal_title", "date": "citation_publication_date", "doi": "citation_doi", "keywords": "citation_keywords"}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: "Element | None" = None
    children: list["Element | str"] = field(default_factory=list)

    def walk(self):  # noqa: ANN201
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def texts(self) -> list[str]:
        """The texts inside in order, without scripts and styles, at any depth."""
        out: list[str] = []
        todo: list[Element | str] = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                if c.strip():
                    out.append(c.strip())
            elif c.tag not in ("script", "style"):
                todo += reversed(c.children)
        return out

    def has(self, tag: str, name: str) -> bool:
        return self.tag == tag and name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        e = Element(tag, known, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def first_text(root: Element, selectors: list[list[tuple[str, str]]]) -> str:
    """The text of the first element that a selector finds; the next selector is tried if it is empty."""
    for path in selectors:
        for e in root.walk():
            if not e.has(*path[-1]):
                continue
            outer, p = list(path[:-1]), e.parent
            while outer and p is not None:
                if p.has(*outer[-1]):
                    outer.pop()
                p = p.parent
            if not outer:
                if text := " ".join(e.texts()):
                    return text
                break
    return ""


def read_page(html: str | None) -> dict:
    root = parse(html or "")
    meta: dict[str, list[str]] = {}
    hrefs: list[str] = []
    heading: str | None = None
    for e in root.walk():
        if e.tag == "meta" and e.attrs.get("name") and e.attrs.get("content", "").strip():
            meta.setdefault(e.attrs["name"], []).append(e.attrs["content"].strip())
        elif e.tag == "a" and "href" in e.attrs:
            hrefs.append(e.attrs["href"].strip())
        elif e.tag == "h1" and heading is None:
            heading = "".join(e.texts())
    one = {k: (meta.get(name) or [""])[0] for k, name in META.items()}
    return one | {"authors": meta.get("citation_author", []), "institutions": meta.get("citation_author_institution", []), "abstract": first_text(root, ABSTRACT), "biography": first_text(root, BIOGRAPHY), "heading": heading or "", "hrefs": hrefs}


_LISTS = ("authors", "institutions", "hrefs")
PAGE = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in _LISTS else T.StringType()) for c in ("title", "journal", "date", "doi", "keywords", "authors", "institutions", "abstract", "biography", "heading", "hrefs")])


@F.pandas_udf(PAGE)
def page_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=PAGE.names)


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with the parts of each page in the struct ``p``."""
    return pages.withColumn("p", page_parts("html"))


def section_links(hrefs, section: str, base: str):  # noqa: ANN001, ANN201
    """Absolute links to pages of a section, distinct and sorted."""
    slugs = F.transform(hrefs, lambda h: F.regexp_extract(h, rf'/en/{section}/([^/"?#]+)', 1))
    kept = F.array_sort(F.array_distinct(F.filter(slugs, lambda s: s != "")))
    return F.transform(kept, lambda s: F.concat(F.lit(f"{base.rstrip('/')}/en/{section}/"), s, F.lit("/")))


def publications(parsed: DataFrame, base: str, crawled_at: str = "") -> DataFrame:
    """One row per publication page (a page that names a title), authors still unpaired: see :func:`pair_authors`."""
    return parsed.where("p.title <> ''").select(
        F.col("url").alias("id"), F.col("p.title").alias("title"), "url", F.col("p.authors").alias("names"), section_links(F.col("p.hrefs"), "persons", base).alias("profiles"), F.col("p.institutions").alias("institutions"),
        F.col("p.abstract").alias("abstract"), F.col("p.journal").alias("journal"), year_of(F.col("p.date")).alias("year"), F.col("p.doi").alias("doi"), F.col("p.keywords").alias("keywords"), F.lit(crawled_at).alias("crawled_at"))


def paired(names, profiles, name_slugs, link_slugs):  # noqa: ANN001, ANN201
    """Authors with their profile links as ``array<struct<name, profile_url>>``, within the row.

    First each link goes to the first author whose slug it bears. A link left over goes to the authors with its initial and
    surname, if no other link that is left has the same; else they get none.
    """
    links = F.transform(F.arrays_zip(profiles.alias("url"), link_slugs.alias("plain")), lambda x: F.struct(x["url"].alias("url"), url_slug(x["url"]).alias("slug"), slug_key(x["plain"]).alias("key")))
    marked = F.transform(F.arrays_zip(names.alias("name"), name_slugs.alias("slug")), lambda x, i: F.struct(x["name"].alias("name"), x["slug"].alias("slug"), slug_key(x["slug"]).alias("key"), i.alias("i")))

    def pair(m, k, all_links, left):  # noqa: ANN001, ANN202
        exact = F.filter(all_links, lambda x: x["slug"] == m["slug"])
        first = ~F.exists(k, lambda o: (o["slug"] == m["slug"]) & (o["i"] < m["i"]))
        fits = F.filter(left, lambda x: x["key"] == m["key"])
        url = F.when((F.size(exact) > 0) & first, F.element_at(exact, -1)["url"]).when(F.size(fits) == 1, F.get(fits, F.lit(0))["url"]).otherwise("")
        return F.struct(m["name"].alias("name"), url.alias("profile_url"))

    def body(k, x):  # noqa: ANN001, ANN202
        left = F.filter(x, lambda y: ~F.exists(k, lambda m: m["slug"] == y["slug"]))
        return let(left, lambda rest: F.transform(k, lambda m: pair(m, k, x, rest)))

    return let(marked, lambda k: let(links, lambda x: body(k, x)))


def pair_authors(pubs: DataFrame) -> DataFrame:
    """The records of :func:`publications` with ``authors`` in place of ``names`` and ``profiles``."""
    columns = ["id", "title", "url", "authors", "institutions", "abstract", "journal", "year", "doi", "keywords", "crawled_at"]
    slugs = pubs.withColumns({"_names": slugify_all("names"), "_links": slugify_all(F.transform("profiles", url_slug))})
    return slugs.withColumn("authors", paired(*[F.col(c) for c in ("names", "profiles", "_names", "_links")])).select(*columns)


def persons(parsed: DataFrame, crawled_at: str = "") -> DataFrame:
    """One row per page with a heading: name and biography."""
    return parsed.where("p.heading <> ''").select(F.col("url").alias("id"), F.col("p.heading").alias("name"), "url", F.col("p.biography").alias("biography"), F.lit(crawled_at).alias("crawled_at"))


def robots_verdicts(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``(url, allowed, crawl_delay)`` by ``robots(host, status, text)``.

    404 allows everything, a 2xx text is obeyed, anything else or no row allows nothing. The delay is at least half a second, two seconds if none is named.
    """
    from urllib.robotparser import RobotFileParser

    @F.pandas_udf("allowed boolean, crawl_delay double")
    def judge(url: pd.Series, status: pd.Series, text: pd.Series) -> pd.DataFrame:
        known: dict[tuple, RobotFileParser] = {}
        out = []
        for u, s, t in zip(url, status, text):
            if pd.isna(s) or not (s == 404 or 200 <= s < 300):
                out.append((False, 2.0))
                continue
            key = (int(s), t)
            if key not in known:
                known[key] = RobotFileParser()
                known[key].parse([] if s == 404 else (t or "").splitlines())
            delay = known[key].crawl_delay(agent)
            out.append((known[key].can_fetch(agent, u), 2.0 if delay is None else max(float(delay), 0.5)))
        return pd.DataFrame(out, columns=["allowed", "crawl_delay"])

    hosts = urls.select("url", F.parse_url("url", F.lit("AUTHORITY")).alias("host")).join(robots, "host", "left")
    return hosts.select("url", judge("url", F.col("status").cast("double"), "text").alias("_v")).select("url", "_v.*")
