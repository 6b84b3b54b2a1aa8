"""The read-only surface of a collection and a cluster model, as functions that give plain values."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skarn.collection import Collection
from skarn.operators import browse
from skarn.operators.cluster import ClusterModel
from skarn.operators.ranking import SCORERS
from skarn.sources.files import exists, read_text, replace_text

LISTED = ["id", "title", "authors", "abstract", "journal", "year", "url", "doi"]


def _rows(df) -> list[dict]:  # noqa: ANN001
    """At most one page of rows."""
    return [r.asDict(recursive=True) for r in df.collect()]


def search(collection: Collection, q: str = "", limit: int = 10, offset: int = 0, scorer: str = "bm25") -> dict:
    browse.check_window(limit, offset)
    began = time.perf_counter()
    r = collection.search(q, limit, offset, scorer)
    return {"hits": _rows(r.hits), "total": r.total, "query": q, "scorer": scorer, "limit": limit, "offset": offset, "elapsed_ms": (time.perf_counter() - began) * 1000}


def publications(collection: Collection, limit: int = 20, offset: int = 0) -> dict:
    browse.check_window(limit, offset)
    docs = collection.stored()
    return {"publications": _rows(browse.newest(docs, [c for c in LISTED if c in docs.columns], limit, offset)), "total": docs.count(), "limit": limit, "offset": offset}


def author(collection: Collection, name: str) -> dict:
    """One author's record; KeyError if nobody bears exactly that name."""
    docs = collection.stored()
    own = docs.where(F.exists("authors", lambda a: a["name"] == name))
    found = browse.author_rollups(own).where(F.col("name") == name).first()
    if found is None:
        raise KeyError(name)
    return found.asDict() | {"publications": _rows(browse.by_author(own, name).select(*[c for c in LISTED if c in docs.columns]))}


def stats(collection: Collection) -> dict:
    return browse.corpus_stats(collection.stored(), collection.index()).first().asDict() | {"scorers": sorted(SCORERS)}


def describe(collection: Collection) -> dict:
    index = collection.index()
    entries, dead = collection.entries()
    return {"name": collection.name, "document_count": index.document_count(), "vocabulary_size": index.vocabulary_size(), "log_entries": entries, "dead_entries": dead, "fields": _rows(browse.describe_fields(index)), "analyzer": collection.analyzer.config()}


def documents(collection: Collection, limit: object = 20, offset: object = 0, contains: str = "") -> dict:
    """A page of stored documents in order of arrival, those that hold ``contains`` anywhere."""
    limit, offset = browse.clamp_window(limit, offset)
    docs = collection.stored()
    fields = [c for c in docs.columns if c != "internal_id"]
    found = browse.containing(docs, contains, fields, collection.schema.id_field) if contains else docs
    return {"documents": _rows(browse.page(found, docs.columns, limit, offset)), "total": found.count(), "limit": limit, "offset": offset}


def reload(collection: Collection) -> Collection:
    """The same collection as it is now."""
    return Collection.open(collection.spark, collection.path, read_only=collection.read_only)


def classify(collection_or_spark, model: ClusterModel, text: str) -> dict:  # noqa: ANN001
    """The cluster of one text of 1 to 20,000 characters."""
    if not 1 <= len(text) <= 20_000:
        raise ValueError("the text must have 1 to 20,000 characters")
    spark = getattr(collection_or_spark, "spark", collection_or_spark)
    return model.predict(spark.createDataFrame([(0, text)], "doc_id long, text string")).drop("doc_id").first().asDict(recursive=True)


def health(collection: Collection) -> dict:
    """Whether the collection can be read, and how many documents it has."""
    return {"status": "ok", "documents": len(collection)}


def score_ceiling(collection: Collection) -> float:
    """The sum of the field weights: what the display scales scores by. Not a true upper bound, as idf and the query's weight are left out."""
    return float(sum(collection.schema.weights().values()))


class ClusterService:
    """A cluster model that is loaded, or built and saved, when it is first asked for; safe for several threads.

    ``build`` gives the model, or the model and its report, which is then kept beside it for :meth:`overview`.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[], ClusterModel | tuple[ClusterModel, dict]]) -> None:
        self.spark, self.path, self.build = spark, path, build
        self._lock = threading.Lock()
        self._model: ClusterModel | None = None

    def model(self) -> ClusterModel:
        if self._model is None:
            with self._lock:
                if self._model is None:
                    if exists(self.spark, self.path):
                        self._model = ClusterModel.load(self.spark, self.path)
                    else:
                        built = self.build()
                        model, report = built if isinstance(built, tuple) else (built, None)
                        if report is not None:
                            replace_text(self.spark, self.path + ".report", json.dumps(report))
                        model.save(self.spark, self.path)
                        self._model = model
        return self._model

    def overview(self) -> dict:
        """What the fit is worth, as reported when it was built: sizes, names, terms, metrics, confusion, elbow. LookupError if no report was kept."""
        self.model()
        if not exists(self.spark, self.path + ".report"):
            raise LookupError("the model was built without a report")
        return json.loads(read_text(self.spark, self.path + ".report"))

    def classify(self, text: str) -> dict:
        return classify(self.spark, self.model(), text)
