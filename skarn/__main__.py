"""``python -m skarn index|search|cluster|status``: the batch jobs."""

from __future__ import annotations

import argparse
import json
import os

from skarn import api
from skarn.collection import Collection
from skarn.functions.analyzer import Analyzer
from skarn.operators.cluster import ClusterModel, report
from skarn.plans.schema import PUBLICATIONS
from skarn.session import local_session
from skarn.sources import archive, corpus
from skarn.sources.files import delete, replace_text


def main(argv: list[str] | None = None) -> None:
    data, out = os.environ.get("SKARN_DATA_DIR", "data"), os.environ.get("SKARN_OUTPUT_DIR", "output")
    p = argparse.ArgumentParser("skarn")
    sub = p.add_subparsers(dest="job", required=True)
    index = sub.add_parser("index", help="build a collection from an archived crawl")
    index.add_argument("--crawl")
    index.add_argument("--append", action="store_true")
    find = sub.add_parser("search", help="one page of hits")
    find.add_argument("query")
    find.add_argument("--scorer", default="bm25")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--offset", type=int, default=0)
    for job in (index, find):
        job.add_argument("--index-dir", default=f"{data}/index")
    fit = sub.add_parser("cluster", help="fit and evaluate a cluster model on a corpus archive")
    fit.add_argument("archive")
    fit.add_argument("--per-category", type=int, default=200)
    fit.add_argument("--all", action="store_true")
    fit.add_argument("--output-dir", default=out)
    status = sub.add_parser("status", help="the finished crawls")
    for job in (index, status):
        job.add_argument("--crawls-dir", default=f"{data}/crawls")
    a = p.parse_args(argv)
    spark = local_session()
    if a.job == "status":
        archive.status(spark, a.crawls_dir).show(100, False)
    elif a.job == "search":
        print(json.dumps(api.search(Collection.open(spark, a.index_dir, read_only=True), a.query, a.limit, a.offset, a.scorer), indent=1))
    elif a.job == "index":
        run = archive.load(spark, a.crawls_dir, a.crawl) if a.crawl else archive.latest(spark, a.crawls_dir)
        if run is None:
            raise SystemExit(f"no finished crawl under {a.crawls_dir}")
        if not a.append:
            delete(spark, a.index_dir)
        c = Collection.open(spark, a.index_dir, PUBLICATIONS, Analyzer(), "publications")
        print(c.add_many(run.records()), "documents from", run.crawl_id)
        c.refresh().close()
    else:
        docs = corpus.balanced_sample(corpus.read_archive(spark, a.archive), None if a.all else a.per_category)
        model, assigned = ClusterModel.fit(docs)
        model.save(spark, f"{a.output_dir}/model.json")
        replace_text(spark, f"{a.output_dir}/report.json", json.dumps(report(model, assigned), indent=1))


if __name__ == "__main__":
    main()
