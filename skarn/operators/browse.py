"""Browsing stored documents: newest first, one author's record, statistics, substring filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.index import Index


def _year(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def newest(docs: DataFrame, columns: list[str], limit: int = 20, offset: int = 0, order: str = "internal_id") -> DataFrame:
    """A page of documents by year, descending as text, then by arrival."""
    return docs.orderBy(_year(F.col("year")).desc(), order).offset(offset).limit(limit).select(*columns)


def check_window(limit: int, offset: int, most: int = 100) -> None:
    """Raise unless 1 <= limit <= most and offset >= 0."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1..{most} and offset not negative")


def clamp_window(limit: object, offset: object, default: int = 20, most: int = 200) -> tuple[int, int]:
    """A page window from what was typed: garbage becomes the default, negatives 0, limits at most ``most``."""

    def number(x: object, otherwise: int) -> int:
        try:
            return max(int(str(x)), 0)
        except ValueError:
            return otherwise

    return min(number(limit, default), most), number(offset, 0)


def author_rollups(docs: DataFrame, order: str = "internal_id") -> DataFrame:
    """One row per author name: publications, distinct co-authors, first known profile by arrival, first and last year.

    Names are matched exactly and empty ones left out; a publication counts once per author. All aggregates combine before the exchange;
    co-authors are counted as distinct pairs, so a frequent author isn't collected in one task.
    """
    entries = docs.select(F.col(order).alias("_doc"), _year(F.col("year")).alias("_year"), F.posexplode("authors").alias("_pos", "_a"), "authors").select("_doc", "_year", "_pos", F.col("_a.name").alias("name"), F.col("_a.profile_url").alias("_url"), "authors").where("name <> ''")
    url = F.when(F.col("_url") != "", F.col("_url"))
    year = F.when(F.col("_year") != "", F.col("_year"))
    main = entries.groupBy("name").agg(F.count_distinct("_doc").alias("publication_count"), F.min_by(url, F.when(url.isNotNull(), F.struct("_doc", "_pos"))).alias("profile_url"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    others = entries.select("name", F.explode(F.transform("authors", lambda a: a["name"])).alias("_o")).where("_o <> '' and _o <> name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("co_author_count"))
    return main.join(others, "name", "left").select("name", "publication_count", F.coalesce("co_author_count", F.lit(0)).cast("long").alias("co_author_count"), F.coalesce("profile_url", F.lit("")).alias("profile_url"), F.coalesce("first_year", F.lit("")).alias("first_year"), F.coalesce("last_year", F.lit("")).alias("last_year"))


def by_author(docs: DataFrame, name: str, order: str = "internal_id") -> DataFrame:
    """The documents of one author, newest first."""
    return docs.where(F.exists("authors", lambda a: a["name"] == name)).orderBy(_year(F.col("year")).desc(), order)


def corpus_stats(docs: DataFrame, index: Index) -> DataFrame:
    """One row: documents, vocabulary and the latest crawl as text."""
    one = docs.agg(F.count(F.lit(1)).alias("document_count"), F.max(F.when(F.col("crawled_at") != "", F.col("crawled_at"))).alias("last_crawled_at"))
    vocabulary = index.postings.agg(F.count_distinct("term").alias("vocabulary_size"))
    return one.select("document_count", vocabulary.scalar().alias("vocabulary_size"), "last_crawled_at")


def describe_fields(index: Index) -> DataFrame:
    """One row per field of the schema with its mean length to one decimal; null where it isn't indexed."""
    spark = index.spark
    known = spark.createDataFrame([(f.name, f.indexed, f.stored, float(f.weight)) for f in index.schema.fields], "field string, indexed boolean, stored boolean, weight double")
    stats = index.field_stats().select("field", F.bround("average_length", 1).alias("average_length"))
    joined = known.join(F.broadcast(stats), "field", "left")
    return joined.withColumn("average_length", F.when(F.col("indexed"), F.coalesce("average_length", F.lit(0.0))))


def containing(docs: DataFrame, needle: str, columns: list[str], key: str = "id") -> DataFrame:
    """Documents whose id and fields, written as JSON, hold ``needle``, ignoring letter case; names of fields are searched too."""
    body = F.concat_ws(" ", F.col(key), F.to_json(F.struct(*columns)))
    return docs.where(F.contains(F.lower(body), F.lit(needle.lower())))


def page(docs: DataFrame, columns: list[str], limit: int, offset: int, order: str = "internal_id") -> DataFrame:
    return docs.orderBy(order).offset(offset).limit(limit).select(*columns)


def with_total(docs: DataFrame) -> DataFrame:
    """Every row with the number of all rows."""
    return docs.withColumn("total", docs.agg(F.count(F.lit(1))).scalar())
