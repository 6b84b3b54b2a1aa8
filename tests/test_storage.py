import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skarn.collection import Collection
from skarn.functions.analyzer import Analyzer
from skarn.operators import log
from skarn.operators.index import build_index
from skarn.operators.current import current_records
from skarn.operators.snapshots import SnapshotIndex, changed_values, key_index, snapshot_changes
from skarn.plans.schema import CollectionSchema, Field
from skarn.queries import p3_values
from skarn.session import lookup_join, written
from skarn.sources import archive, corpus
from skarn.sources.files import exists, replace_text
from skarn.streaming.changes import follow

SCHEMA = CollectionSchema((Field("id", indexed=False), Field("title", weight=3.0), Field("abstract", stored=False), Field("url", indexed=False)))
LOG = "seq long, op string, id string, doc string"


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_replay(spark):
    rows = [(0, "put", "a", "1"), (1, "put", "b", "2"), (2, "put", "a", "3"), (3, "delete", "b", None), (4, "put", "b", "5"), (5, "put", "c", "6"), (6, "delete", "c", None), (7, "put", None, "x")]
    df = _log(spark, rows)
    assert {(r.id, r.doc, r.born) for r in log.replay(df).collect()} == {("a", "3", 0), ("b", "5", 4)}
    assert {(r.id, r.doc) for r in log.replay(log.compacted(df)).collect()} == {("a", "3"), ("b", "5")}
    assert tuple(log.accounting(df).first()) == (8, 2, 6)
    assert {r.id: r.internal_id for r in log.dense_ids(log.replay(df), "born").collect()} == {"a": 0, "b": 1}
    assert log.replay(_log(spark, [])).count() == 0
    assert not log.should_compact(11, 1) and log.should_compact(64, 1) and not log.should_compact(100, 1, None)


def test_collection(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    c = Collection.open(spark, path, SCHEMA, Analyzer(), compact_least=4)
    docs = spark.createDataFrame([("p1", "Diabetes prevention", "A trial", "u1"), ("p2", "Sleep of students", "Hidden words", "u2")], "id string, title string, abstract string, url string")
    assert c.add_many(docs) == 2
    r = c.search("hidden")
    assert r.total == 1 and [(h.id, set(h.asDict())) for h in r.hits.collect()] == [("p2", {"rank", "id", "score", "title", "url"})]
    first = c.stored().where("id = 'p2'").first().internal_id
    c.add({"id": "p2", "title": "Sleep again", "abstract": None, "url": "u3"})
    assert c.get("p2")["title"] == "Sleep again" and c.stored().where("id = 'p2'").first().internal_id == first
    assert c.search("hidden").total == 0
    assert c.delete("p1") and not c.delete("p1") and len(c) == 1
    assert c.entries() == (4, 3) and c.should_compact() and c.sync() and c.entries() == (1, 0)
    again = Collection.open(spark, path, read_only=True)
    assert again.schema == SCHEMA and again.analyzer == c.analyzer
    with pytest.raises(RuntimeError):
        again.add({"id": "x", "title": "t"})
    with pytest.raises(ValueError):
        c.search("x", scorer="nope")
    with pytest.raises(ValueError):
        c.add_many(spark.createDataFrame([(None, "t")], "id string, title string"))
    with pytest.raises(FileNotFoundError):
        Collection.open(spark, f"file://{tmp_path}/none", read_only=True)


def test_bad_files(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    c = Collection.open(spark, path, SCHEMA)
    c.add({"id": "a", "title": "t"})
    replace_text(spark, f"{path}/log/batch=000000001/x.json", '{"op":"put","id":"b","do')
    replace_text(spark, f"{path}/log/batch=000000001/y.json", '{"op":"put","id":"c","doc":"{}","batch":1,"n":0}\n\n{"op":"move","id":"d","batch":1,"n":1}\n')
    with pytest.raises(Exception, match="corrupt log line"):
        c.log().collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in c.corrupt_lines().collect()) == [("x.json", 1), ("y.json", 3)]
    c._meta["batches"] = 2
    with pytest.raises(ValueError, match="y.json: corrupt entry on line 3"):
        c.refresh()
    meta = json.loads((tmp_path / "c/meta.json").read_text()) | {"version": 99}
    replace_text(spark, f"{path}/meta.json", json.dumps(meta))
    with pytest.raises(ValueError):
        Collection.open(spark, path)


def test_stream(spark, tmp_path):
    c = Collection.open(spark, f"file://{tmp_path}/c", SCHEMA)
    c._meta["columns"] = {"id": "string", "title": "string"}
    land = tmp_path / "land"
    land.mkdir()
    for i, ops in enumerate([[("put", "a", "one"), ("put", "b", "two")], [("put", "a", "three"), ("delete", "b", None)]]):
        (land / f"{i}.json").write_text("\n".join(json.dumps({"op": o, "id": k, "doc": json.dumps({"id": k, "title": t}) if t else None}) for o, k, t in ops))
        follow(c, f"file://{land}", f"file://{tmp_path}/cp").awaitTermination()
    assert [(r.id, r.title) for r in c.documents().collect()] == [("a", "three")]


def test_current_records(spark):
    rows = [("a", "x", "2026-01-01T00:00:00+05:45"), ("a", "y", "2025-12-31T20:00:00Z"), ("a", "y", "2025-12-31T20:00:00Z"), ("b", "p", None), ("b", "q", " "), ("c", "r", "junk"), ("c", "s", "2020-01-01T00:00:00Z"), (None, "t", None)]
    df = spark.createDataFrame(rows, "id string, v string, crawled_at string").withColumn("_n", F.lit(1)).withColumn("_row", F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1))))
    got = {r.id: r.v for r in current_records(df, ["v", "_row"]).collect()}
    assert got["a"] == "y" and got["c"] == "s" and got["b"] in "pq" and len(got) == 3
    assert current_records(df.limit(0), ["v"]).count() == 0


def test_lookup_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    t = written(spark.createDataFrame([("hot", 50, "H"), ("a", 1, "A")], "k string, n long, name string"))
    assert lookup_join(left, t, ["k"], "n", share=0.5).groupBy("name").count().orderBy("name").collect() == [("A", 1), ("H", 50)]
    assert lookup_join(left, t, ["k"], "n", "left", share=0.5).count() == 53


FIELDS = ["title", "doi"]
ROW = "crawl_id string, id string, title string, doi string, authors array<string>, crawled_at string, url string"


def test_snapshots(spark):
    rows = [("1", "same", "t", None, ["a"], None, "u"), ("2", "same", " t ", "", ["a"], None, "other"),
            ("1", "authors", "t", None, ["a", "b"], None, "u"), ("2", "authors", "t", None, ["ab"], None, "u"),
            ("1", "null", "t", None, None, None, "u"), ("2", "null", "t", None, [None], None, "u"),
            ("1", "gone", "t", None, ["a"], None, "u"), ("2", "new", "t", None, ["a"], None, "u"),
            ("1", "late", "old", None, ["a"], "2026-01-01T00:00:00Z", "u"), ("1", "late", "new", None, ["a"], "2026-01-01T09:00:00+05:45", "u"), ("2", "late", "new", None, ["a"], None, "u"), ("2", "late", "new", None, ["a"], None, "u"),
            ("x", "same", "zzz", None, ["a"], None, "u"), ("2", None, "t", None, ["a"], None, "u")]
    df = spark.createDataFrame(rows, ROW).withColumn("h", F.lit(1)).withColumn("snapshot", F.lit(2))
    got = snapshot_changes(df, ["1", "2"], FIELDS, ["authors"])
    assert {(r.id, r.change_kind) for r in got.collect()} == {("authors", "changed"), ("null", "changed"), ("gone", "removed"), ("new", "added")}
    assert {r.crawl_id for r in got.collect()} == {"2"}
    back = snapshot_changes(df, ["2", "1"], FIELDS, ["authors"])
    assert {(r.id, r.change_kind) for r in back.collect()} == {("authors", "changed"), ("null", "changed"), ("gone", "added"), ("new", "removed")}
    assert snapshot_changes(df, ["1"], FIELDS, ["authors"]).count() == 0 and snapshot_changes(df.limit(0), ["1", "2"], FIELDS, ["authors"]).count() == 0
    values = changed_values(got, df, ["1", "2"], FIELDS, ["authors"]).collect()
    assert {(r.id, r.field_name, r.old_value, r.new_value) for r in values} == {("authors", "authors", '["a","b"]', '["ab"]'), ("null", "authors", None, "[null]")}


def test_kept_index(spark, tmp_path):
    """One delivery after the other, each by a new object; a tie in time and outer blanks beside a real change."""
    row = lambda *r: spark.createDataFrame(list(r), ROW)
    first = row(("1", "tie", "b", "x", [], None, "u"), ("1", "tie", "a", "x", [], None, "u"), ("1", "blank", " t ", "x", [], None, "u"), ("1", "gone", "t", "x", [], None, "u"))
    second = row(("2", "tie", "c", "x", [], None, "u"), ("2", "tie", "d", "x", [], None, "u"), ("2", "blank", "t", "y", [], None, "u"), ("2", "fresh", "t", None, [], None, "u"))
    path = f"file://{tmp_path}/index"
    assert SnapshotIndex(spark, path).advance(key_index(first, FIELDS, ["authors"]), "1") is None
    got = SnapshotIndex(spark, path).advance(key_index(second, FIELDS, ["authors"]), "2")
    assert {(r.crawl_id, r.id, r.change_kind) for r in got.collect()} == {("2", "tie", "changed"), ("2", "blank", "changed"), ("2", "gone", "removed"), ("2", "fresh", "added")}
    kept = SnapshotIndex(spark, path)
    assert kept.snapshot == "2" and len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 1
    with pytest.raises(ValueError):
        kept.advance(key_index(second, FIELDS, ["authors"]), "2")
    values = {(r.id, r.field_name): (r.old_value, r.new_value) for r in changed_values(got, first.unionByName(second), ["1", "2"], FIELDS, ["authors"]).collect()}
    assert set(values) == {("tie", "title"), ("blank", "doi")} and values["blank", "doi"] == ("x", "y") and values["tie", "title"][0] in "ab" and values["tie", "title"][1] in "cd"
    again = kept.advance(key_index(second.limit(0), FIELDS, ["authors"]), "3")
    assert {r.change_kind for r in again.collect()} == {"removed"} and again.count() == 3 and kept.advance(key_index(second, FIELDS, ["authors"]), "4").count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skarn_index")]


def test_archive(spark, tmp_path):
    root = f"file://{tmp_path}/crawls"
    recs = spark.createDataFrame([("https://h/en/publications/x-1/", "T", "u", [("A B", "")], ["I"], "", "J", "2020", "", "", "")], archive.PUBLICATION)
    people = spark.createDataFrame([], archive.PERSON)
    assert archive.latest(spark, root) is None
    archive.write_crawl(recs, people, {"finished_at": "z"}, root, "2026-01-01")
    archive.write_crawl(recs, people, {"publications": 7}, root, "2026-02-01")
    replace_text(spark, f"{root}/2026-03-01/publications.jsonl/p.json", "")
    assert [c.crawl_id for c in archive.all_crawls(spark, root)] == ["2026-01-01", "2026-02-01"]
    assert archive.latest(spark, root).publication_count == 7 and archive.load(spark, root, "2026-01-01").records().collect() == recs.collect()
    assert archive.load(spark, root, "2026-01-01").people().count() == 0 and not exists(spark, f"{root}/2026-01-01.partial")
    with pytest.raises(FileNotFoundError):
        archive.load(spark, root, "2026-03-01")
    assert [(r.crawl_id, r.publication_count) for r in archive.status(spark, root).collect()] == [("2026-01-01", 1), ("2026-02-01", 7)]
    good, bad = archive.split_valid(archive.search_documents(recs), ["id", "abstract"])
    assert good.count() == 0 and bad.first().missing == "abstract" and bad.first().id == "x-1" and bad.first().year == 2020
    assert archive.new_crawl_id().endswith("-NPT")


def test_corpus(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for i in range(5):
            z.writestr(f"news/business/{i}.txt", f"text {i}")
            z.writestr(f"news/sport/{i}.txt", "no label")
        z.writestr("news/politics/1.txt", b"caf\xe9")
        z.writestr("news/politics/2.txt", "  ")
        z.writestr("top.txt", "x")
    docs = corpus.read_archive(spark, f"file://{tmp_path}/c.zip")
    assert sorted((r.label, r.text) for r in docs.collect())[-1] == ("Politics", "caf�") and docs.count() == 6
    assert corpus.balanced_sample(docs, 2).count() == 3 and corpus.balanced_sample(docs, None).count() == 6
    assert [(r.label, r.documents) for r in corpus.label_counts(docs, ["Economics", "Entertainment", "Politics"]).collect()] == [("Economics", 5), ("Entertainment", 0), ("Politics", 1)]


def test_values_of_every_compared_field(spark, tmp_path):
    spark.createDataFrame([("1", datetime(2026, 1, 1), datetime(2026, 1, 2)), ("2", datetime(2026, 2, 1), datetime(2026, 2, 2))], "crawl_id string, started_at timestamp, finished_at timestamp").write.parquet(f"{tmp_path}/crawls.parquet")
    base = {"title": "t", "abstract": "a", "journal": "j", "year": "2020", "doi": "d", "keywords": "k", "authors": ["A B"]}
    other = {f: ["A B", "C D"] if f == "authors" else "new" for f in base}
    rows = [(c, f, *(base | ({f: other[f]} if c == "2" else {})).values(), None) for f in base for c in "12"]
    spark.createDataFrame(rows, "crawl_id string, id string, title string, abstract string, journal string, year string, doi string, keywords string, authors array<string>, crawled_at string").write.parquet(f"{tmp_path}/crawl_records.parquet")
    got = {(r.id, r.field_name, r.old_value, r.new_value) for r in p3_values(spark, str(tmp_path)).collect()}
    assert got == {(f, f, *(json.dumps(x[f], separators=(",", ":")) if f == "authors" else x[f] for x in (base, other))) for f in base}


def test_tables_follow_the_log(spark, tmp_path):
    """An update analyzes only what it names; ids are kept by updates and never given twice."""
    c = Collection.open(spark, f"file://{tmp_path}/c", SCHEMA, Analyzer(stem=False), compact_ratio=None)
    docs = lambda rows: spark.createDataFrame(rows, "id string, title string, abstract string, url string")
    c.add_many(docs([(f"p{i}", f"common word{i}", "text", "u") for i in range(6)]))
    ids = {r.id: r.internal_id for r in c.stored().collect()}
    assert sorted(ids.values()) == list(range(6)) and "p3" in c and c.by_internal_id(ids["p3"])["id"] == "p3"
    c.add_many(docs([("p1", "renewed title", "text", "v"), ("q", "common late", None, "u")]))
    c.delete("p5")
    c.delete("p0")
    c.add_many(docs([("p0", "common back", "text", "u")]))
    now = {r.id: r.internal_id for r in c.stored().collect()}
    assert now == {**{f"p{i}": ids[f"p{i}"] for i in (1, 2, 3, 4)}, "q": 6, "p0": 7} and "p5" not in c and c.by_internal_id(ids["p5"]) is None
    rebuilt = build_index(c.stored(), c.schema, c.analyzer)
    for kept, made in ((c.index().postings, rebuilt.postings), (c.index().fields, rebuilt.fields), (c.index().docs, rebuilt.docs), (c.index().terms, rebuilt.term_stats())):
        assert sorted(map(str, kept.select(*sorted(kept.columns)).collect())) == sorted(map(str, made.select(*sorted(kept.columns)).collect()))
    assert c.search("common").total == 5 and c.search("renewed").total == 1
    c.delete("p0")
    assert c.compact() > 0 and c.search("common").total == 4 and c.entries() == (5, 0)
    c.add_many(docs([("r", "common again", "text", "u")]))
    assert Collection.open(spark, f"file://{tmp_path}/c").stored().where("id = 'r'").first().internal_id == 8


def test_many_partitions_keep_their_order(spark, tmp_path):
    c = Collection.open(spark, f"file://{tmp_path}/c", SCHEMA)
    c._append(spark.range(0, 600, 1, 600).select(F.lit("put").alias("op"), F.col("id").cast("string").alias("id"), F.lit("{}").alias("doc")))
    order = [int(r.id) for r in c.log().orderBy("seq").select("id").collect()]
    assert order == list(range(600))


def test_manifest_of_an_older_archive(spark, tmp_path):
    (tmp_path / "2026-01-01-00-00-00-NPT").mkdir()
    (tmp_path / "2026-01-01-00-00-00-NPT/manifest.json").write_text(json.dumps({"format_version": 1, "crawl_id": "2026-01-01-00-00-00-NPT", "publications": 92, "people": 117, "finished_at": "z", "fetcher": {"crawl_delay": 5.0}}))
    r = archive.status(spark, f"file://{tmp_path}").first()
    assert (r.publication_count, r.person_count) == (92, 117)
