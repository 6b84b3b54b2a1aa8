"""The crawl archive: one folder per run with JSON lines of publications and persons and a manifest.

A run is written under ``.partial`` and renamed when complete, so a run without manifest was
interrupted and is never listed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.sources.files import delete, exists, list_names, read_text, rename, replace_text

PUBLICATION = "id string, title string, url string, authors array<struct<name: string, profile_url: string>>, institutions array<string>, abstract string, journal string, year string, doi string, keywords string, crawled_at string"
PERSON = "id string, name string, url string, biography string, crawled_at string"


def new_crawl_id(now: datetime | None = None) -> str:
    """A sortable id: the local time of the run."""
    zone = ZoneInfo("Asia/Kathmandu")
    return (now.astimezone(zone) if now else datetime.now(zone)).strftime("%Y-%m-%d-%H-%M-%S-NPT")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


@dataclass
class Crawl:
    spark: SparkSession
    path: str
    crawl_id: str

    def manifest(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifest.json"))

    def records(self) -> DataFrame:
        return read_json_lines(self.spark, f"{self.path}/publications.jsonl", PUBLICATION)

    def people(self) -> DataFrame:
        return read_json_lines(self.spark, f"{self.path}/persons.jsonl", PERSON)

    @property
    def publication_count(self) -> int:
        return int(self.manifest().get("publications") or 0)

    @property
    def person_count(self) -> int:
        return int(self.manifest().get("people") or 0)


def write_crawl(records: DataFrame, people: DataFrame, manifest: dict, root: str, crawl_id: str | None = None) -> Crawl:
    """Write one run. What the caller's manifest says wins over what is computed. Rows are counted while they are written."""
    from pyspark.sql import Observation

    spark = records.sparkSession
    crawl_id = crawl_id or new_crawl_id()
    final, partial = f"{root}/{crawl_id}", f"{root}/{crawl_id}.partial"
    delete(spark, partial)
    counts = {}
    for name, df in (("publication", records), ("person", people)):
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{partial}/{name}s.jsonl")
        counts[{"publication": "publications", "person": "people"}[name]] = seen.get["n"]
    replace_text(spark, f"{partial}/manifest.json", json.dumps({"crawl_id": crawl_id, "format_version": 1, **counts, **manifest}, indent=1))
    rename(spark, partial, final)
    return Crawl(spark, final, crawl_id)


def all_crawls(spark: SparkSession, root: str) -> list[Crawl]:
    """The finished runs, oldest first."""
    return [Crawl(spark, f"{root}/{n}", n) for n in list_names(spark, root) if not n.endswith(".partial") and exists(spark, f"{root}/{n}/manifest.json")]


def latest(spark: SparkSession, root: str) -> Crawl | None:
    found = all_crawls(spark, root)
    return found[-1] if found else None


def load(spark: SparkSession, root: str, crawl_id: str) -> Crawl:
    for c in all_crawls(spark, root):
        if c.crawl_id == crawl_id:
            return c
    raise FileNotFoundError(f"no finished crawl {crawl_id!r} under {root}")


def status(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished run with its counts."""
    rows = [(c.crawl_id, c.publication_count, c.person_count, c.manifest().get("finished_at")) for c in all_crawls(spark, root)]
    return spark.createDataFrame(rows, "crawl_id string, publication_count long, person_count long, finished_at string")


def search_documents(records: DataFrame) -> DataFrame:
    """Records as another search engine takes them: slug as id, author names alone, the year as a number if it is one."""
    slug = F.element_at(F.split(F.rtrim("id", F.lit("/")), "/"), -1)
    return records.select(slug.alias("id"), "title", F.transform("authors", lambda a: a["name"]).alias("authors"), "abstract", "journal", F.col("year").try_cast("int").alias("year"), "url", "doi")


def split_valid(docs: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may be imported, and the others with the first field they lack."""
    missing = F.coalesce(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required])
    marked = docs.withColumn("missing", missing)
    return marked.where("missing is null").drop("missing"), marked.where("missing is not null")
