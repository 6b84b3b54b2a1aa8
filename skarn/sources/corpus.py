"""A labelled corpus: a zip of text files in one folder per label, or a table; balanced samples of it."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.sources.files import replace_text

# Folders of the archive and what they are called.
FOLDERS = {"business": "Economics", "entertainment": "Entertainment", "politics": "Politics"}


def read_archive(spark: SparkSession, path: str, folders: dict[str, str] = FOLDERS) -> DataFrame:
    """``(doc_id, text, label)`` of the texts at ``*/<folder>/*.txt``, in the order of their names; unreadable bytes are replaced and empty texts dropped.

    Each archive is read by one task, several archives by as many.
    """

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        parts = name.split("/")
                        if len(parts) == 3 and parts[2].endswith(".txt") and parts[1].lower() in folders:
                            text = z.read(name).decode("utf-8", "replace").strip()
                            if text:
                                rows.append((f"{where}#{name}", text, folders[parts[1].lower()]))
                yield pd.DataFrame(rows, columns=["doc_id", "text", "label"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "doc_id string, text string, label string")


def balanced_sample(docs: DataFrame, per_label: int | None, label: str = "label", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``per_label`` documents of each label, in a fixed pseudo-random order; all of them for None. Rows without a label are left out.

    The group limit is taken before the exchange, so a large label sends no more than ``per_label`` rows per task.
    """
    known = docs.where(F.col(label).isNotNull())
    if per_label is None:
        return known
    w = Window.partitionBy(label).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key)
    return known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_n")


def label_counts(docs: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """``(label, documents)`` in the order of ``labels``, zero where there are none."""
    spark = docs.sparkSession
    order = spark.createDataFrame(list(enumerate(labels)), f"position int, {label} string")
    n = docs.groupBy(label).agg(F.count(F.lit(1)).alias("documents"))
    return order.join(F.broadcast(n.where(F.col(label).isin(labels))), label, "left").select("position", label, F.coalesce("documents", F.lit(0)).alias("documents")).orderBy("position")


def write_provenance(available: DataFrame, sampled: DataFrame, labels: list[str], source: str, path: str, seed: int = 42) -> dict:
    """Write where a corpus comes from and how many texts of each label there are and were taken; returns what is written."""
    counts = lambda df: {r.label: r.documents for r in label_counts(df, labels).collect()}
    said = {"source": source, "seed": seed, "available": counts(available), "sampled": counts(sampled)}
    replace_text(available.sparkSession, path, json.dumps(said, indent=1))
    return said
