"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. A source gets its share of the weights, or, where that is more than its allowed
repeats give, all that they give. What such limited sources leave over is mixed by temperature: the sizes are raised to an
exponent, which is bisected until the tempered shares have the entropy of the target weights, and the rest goes to the other
sources by these shares, again up to their limits. Without weights the whole mix is tempered that way.
The amounts are realised as whole passes over each source and a last, partial pass that
takes hash-permuted blocks of documents up to the budget, without sorting any source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def source_name(c: Column) -> Column:
    """Trimmed, lower case, ``_`` and blanks read as ``-``; null stays null."""
    return F.regexp_replace(F.lower(F.trim(c, F.lit(" \t\r\n"))), "[_\\s]", "-")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id") -> DataFrame:
    """``(doc_id, source, tokens)`` of whole texts; a null or empty text has 0 tokens. Special tokens' strings are ordinary text.

    ``tokenizer``: a vocabulary file that the driver reads and sends to the tasks; a few megabytes by nature.
    """
    held = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), source_name(F.col("source").cast("string")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(held.value)
        t.encode_special_tokens = True
        for batch in batches:
            texts = batch["text"].to_pylist()
            n: list[int] = []
            for at in range(0, len(texts), 500):
                n += [len(e.ids) for e in t.encode_batch(texts[at:at + 500], add_special_tokens=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": pa.array(n, pa.int64())})

    return docs.mapInArrow(count, "doc_id long, source string, tokens long")


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares in proportion to size ** exponent; a source of size 0 has share 0. 1 keeps the sizes' shares, 0 makes all equal."""
    raised = {s: (n ** exponent if n > 0 else 0.0) for s, n in sizes.items()}
    total = sum(raised.values())
    return {s: (x / total if total else 0.0) for s, x in raised.items()}


def bisect_exponent(sizes: dict[str, float], target_entropy: float | None = None, repeats: dict[str, float] | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] at which the tempered shares reach ``target_entropy``, or the smallest at which no source is repeated more than ``repeats``.

    Entropy falls as the exponent rises, and so does the repetition of the smallest source
    (per unit of size), so bisection is safe. A target outside what is reachable gives the nearer end.
    """
    total = sum(sizes.values())
    budget = total if budget is None else budget

    def too_flat(e: float) -> bool:
        shares = tempered(sizes, e)
        if target_entropy is not None:
            return entropy(list(shares.values())) > target_entropy
        return any(shares[s] * budget > sizes[s] * (repeats or {}).get(s, 1) * (1 + 1e-12) for s in sizes if sizes[s] > 0)

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    if too_flat(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def poured(amount: float, shares: dict[str, float], room: dict[str, float]) -> dict[str, float]:
    """``amount`` divided by ``shares``, each part at most its ``room``; what one can't take goes to the others, until all are full."""
    given = {s: 0.0 for s in shares}
    open_, left = {s for s in shares if shares[s] > 0 and room[s] > 0}, amount
    while open_ and left > 0:
        w = sum(shares[s] for s in open_)
        full = {s for s in open_ if room[s] <= left * shares[s] / w}
        for s in full or open_:
            given[s] = room[s] if full else left * shares[s] / w
        if not full:
            break
        left -= sum(room[s] for s in full)
        open_ -= full
    return given


def plan_mix(sizes: dict[str, int], weights: dict[str, float] | None, repeats: dict[str, int], target_entropy: float | None = None) -> list[dict]:
    """What each source gives to a mix whose budget is the size of all listed sources together.

    Every source gets its share of the weights times the budget, at most its size times its allowed repeats; it is ``limited`` where it gets less.
    The rest of the budget goes to sources below their limit by the tempered shares ``size ** exponent``, the exponent being bisected to the entropy of the
    weights (or ``target_entropy``). With ``weights=None`` everything is the rest, and without a target entropy the exponent is the smallest that keeps all repeats.
    """
    listed = sorted(repeats)
    budget = float(sum(sizes.get(s, 0) for s in listed))
    total = sum((weights or {}).values())
    target = {s: (weights[s] / total if weights and total else 0.0) for s in listed}
    limit = {s: float(sizes.get(s, 0) * repeats[s]) for s in listed}
    size = {s: float(sizes.get(s, 0)) for s in listed}
    wanted = target_entropy if target_entropy is not None or weights is None else entropy(list(target.values()))
    exponent = bisect_exponent(size, wanted, repeats, budget)
    given = {s: min(limit[s], target[s] * budget) for s in listed}
    limited = {s: given[s] < target[s] * budget for s in listed}
    shares = tempered(size, exponent)
    if not weights or total:
        more = poured(budget - sum(given.values()), shares, {s: limit[s] - given[s] for s in listed})
        given = {s: given[s] + more[s] for s in listed}
    return [{
        "source": s, "size": sizes.get(s, 0), "target_share": target[s], "limited": limited[s],
        "tokens": int(round(given[s])), "reached_share": given[s] / budget if budget else 0.0,
        "repeats": given[s] / size[s] if size[s] else 0.0, "exponent": exponent,
    } for s in listed]


PLAN = "source string, size long, target_share double, limited boolean, tokens long, reached_share double, repeats double, exponent double"


def mix_plan(counts: DataFrame, targets: DataFrame, weighted: bool = True) -> DataFrame:
    """One row per target source: size, target and planned share, repeats. ``counts``: ``(doc_id, source, tokens)``, as of :func:`token_counts` or in another unit.
    ``weighted=False`` leaves the weights out: the mix is tempered as far as the allowed repeats go.

    Sources are few by nature: one row each of sizes goes to the driver. Target rows with the same name after
    normalising are added up (the larger ``max_repeats`` holds); null weights count as 0, null repeats as 1.
    """
    spark = counts.sparkSession
    want = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    asked = {r.source: (float(r.w), int(r.r)) for r in want.collect()}
    sizes = {r.source: int(r.n) for r in counts.where(F.col("source").isin(list(asked))).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    rows = plan_mix(sizes, {s: w for s, (w, _) in asked.items()} if weighted else None, {s: r for s, (_, r) in asked.items()})
    return spark.createDataFrame([tuple(r.values()) for r in rows], PLAN)


def realise(counts: DataFrame, plan: DataFrame, blocks: int = 256, seed: int = 0) -> DataFrame:
    """``(source, doc_id, tokens, copies)``: how often each document is taken; 0 copies are left out.

    ``floor(repeats)`` whole passes take every document. The last pass takes the source's documents in a
    hash-permuted order up to the tokens that are left: first whole blocks (of ``blocks`` by hash, whose
    sizes are one row each), then within the block that holds the limit document by document, leaving out
    only those that don't fit in what is left. So no source is sorted as a whole.
    """
    where = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks))
    p = plan.select("source", F.col("tokens").alias("_want"), F.when(F.col("size") > 0, F.floor(F.col("tokens") / F.col("size"))).otherwise(0).alias("_full"), (F.when(F.col("size") > 0, F.col("tokens") - F.floor(F.col("tokens") / F.col("size")) * F.col("size")).otherwise(0)).alias("_rest"))
    docs = counts.join(F.broadcast(p), "source").withColumn("_block", where)
    sums = docs.groupBy("source", "_block").agg(F.sum("tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "_block", before.alias("_before"), "_n")
    placed = docs.join(F.broadcast(starts), ["source", "_block"])
    inside = placed.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_n") > F.col("_rest")))
    kept = ["source", "doc_id", "tokens", "_full", "_last"]
    ordered = inside.withColumns({"_last": F.col("_rest") - F.col("_before"), "_order": F.xxhash64(F.lit(seed + 1), "doc_id")}).repartition("source").sortWithinPartitions("source", "_order", "doc_id").select(*kept)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}
        for batch in batches:
            last: list[int] = []
            for source, tokens, room in zip(*(batch[c].to_pylist() for c in ("source", "tokens", "_last"))):
                room = left.get(source, room)
                fits = tokens <= room
                left[source] = room - tokens if fits else room
                last.append(int(fits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(last, pa.int64())], names=kept)

    cut = ordered.mapInArrow(fill, "source string, doc_id long, tokens long, _full long, _last long")
    whole = placed.where(~((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_n") > F.col("_rest")))).withColumn("_last", (F.col("_before") + F.col("_n") <= F.col("_rest")).cast("long"))
    taken = whole.select(*kept).unionByName(cut).withColumn("copies", (F.col("_full") + F.col("_last")).cast("long"))
    return taken.where("copies > 0").select("source", "doc_id", "tokens", "copies")


def reached(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``tokens``, ``reached_share`` (of the whole mix) and ``repeats`` as measured on the mix of :func:`realise`."""
    spark = counts.sparkSession
    got = {r.source: int(r.n) for r in realise(counts, plan).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    rows = [r.asDict() for r in plan.collect()]
    whole = sum(got.values())
    for r in rows:
        n = got.get(r["source"], 0)
        r |= {"tokens": n, "reached_share": n / whole if whole else 0.0, "repeats": n / r["size"] if r["size"] else 0.0}
    return spark.createDataFrame([tuple(r.values()) for r in rows], PLAN)
