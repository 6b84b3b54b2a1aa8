"""Frequency of every distinct term (problem 2) and how distinctive a term is per record (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.terms import term_counts, terms
from skarn.session import written


def record_terms(records: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``(key, term, tf, length)``: one row per distinct term of a record over ``fields`` together.

    ``length`` is the number of all terms of the record. Counted within the row, so
    nothing is shuffled. Null and empty fields hold no term.
    """
    every = F.array_sort(F.concat(*[terms(F.col(f).cast("string")) for f in fields]))
    counted = records.select(F.col(key).alias("_key"), every.alias("_terms")).select("_key", F.size("_terms").alias("length"), F.explode(term_counts(F.col("_terms"))).alias("_c"))
    return counted.select(F.col("_key").alias(key), F.col("_c.term").alias("term"), F.col("_c.n").alias("tf"), "length")


def term_frequencies(records: DataFrame, fields: list[str], key: str = "id", rare_most: int = 2, common_over: float = 0.2, total: int | None = None) -> DataFrame:
    """``(term, occurrences, records, mark)`` over all of ``records`` (one row per record).

    ``mark`` is 'rare' for terms in at most ``rare_most`` records, 'common' for those in more than ``common_over``
    of all records, else null; a term that is both is 'rare'. Counts are combined by hash in
    each task before the exchange, so a term that is in every record sends one row per task.
    No records: no rows.
    """
    n = F.lit(records.count() if total is None else total)
    counted = record_terms(records, fields, key).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") <= rare_most, "rare").when(F.col("records") / n > common_over, "common")
    return counted.withColumn("mark", mark)


def idf(df: Column, n: Column, form: str) -> Column:
    """``plain``: ln(N / df). ``probabilistic``: ln(1 + (N - df + 0.5) / (df + 0.5))."""
    if form == "plain":
        return F.ln(n / df)
    if form == "probabilistic":
        return F.ln(1 + (n - df + 0.5) / (df + 0.5))
    raise ValueError(f"unknown idf form {form!r}")


def term_scores(records: DataFrame, fields: list[str], key: str = "id", k1: float | None = 1.2, b: float = 0.75, form: str = "probabilistic", least_records: int = 1) -> DataFrame:
    """``(key, term, tf, df, score)``: relevance weight of each term in each record.

    ``score = idf(df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length))``;
    ``k1=None`` is the limit without saturation and length, ``idf * tf``. Terms held by
    fewer than ``least_records`` records get no row. Scores are rounded to six decimals.

    Texts are cut into terms once; the counts by record are a written table. The frequencies of terms held by more than a hundredth of all records are broadcast:
    there can't be more of them than a hundred times the mean number of terms in a record.
    The others are shuffled by term, and none of them is hot.
    """
    records = written(records.select(key, *fields), "records")
    n = records.count()
    rows = written(record_terms(records, fields, key), "record-terms")
    counts = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_tf")), "df")
    kept = counts.where(F.col("df") >= least_records)
    hot = F.broadcast(kept.where(F.col("df") > n / 100).select("term", "df"))
    tail = kept.where(F.col("df") <= n / 100).select("term", "df")
    columns = [key, "term", "tf"]
    if k1 is None:
        weight = F.col("tf") * idf(F.col("df"), F.lit(n), form)
    else:
        columns.append("length")
        mean = (counts.agg(F.sum("_tf")).first()[0] or 1) / max(n, 1)
        weight = idf(F.col("df"), F.lit(n), form) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    rows = rows.select(*columns)
    joined = rows.join(hot, "term").select(*columns, "df").unionByName(rows.join(hot, "term", "left_anti").join(tail, "term").select(*columns, "df"))
    return joined.select(key, "term", F.col("tf").cast("long").alias("tf"), "df", F.round(weight, 6).alias("score"))


def top_terms(scores: DataFrame, n: int = 3, key: str = "id") -> DataFrame:
    """The ``n`` terms of each record with the highest scores; equal scores go by term, ascending."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term"))
    return scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
