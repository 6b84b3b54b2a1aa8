"""Evaluation texts leaking into training text (problem 8).

Every run of ``window`` consecutive words of a test item is a passage. A passage with an
error budget of k edits is cut into k + 1 pieces: a copy with at most k edits keeps at
least one piece unchanged. One automaton finds all pieces of all passages in a single
scan of each whole document; each hit is verified with a bit-parallel edit distance.
The items are a stated, fixed set, sent to the tasks in blocks of bounded size; the
documents are never shuffled, so no document, source or item can become a hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, ignoring letter case."""
    return _WORD.findall(text.lower()) if text else []


def myers(pattern: str, text: str) -> int:
    """Least edits (insert, delete, substitute) between ``pattern`` and any substring of ``text``: Myers' bit vectors, of any length."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | ~(d0 | up) & full, up & d0
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
        hp, hn = hp << 1, hn << 1
        up, down = (hn | ~(d0 | hp)) & full, hp & d0 & full
        best = min(best, score)
    return best


def passages(text: str | None, window: int) -> set[str]:
    """All runs of ``window`` consecutive words, each as `` w1 w2 ... `` with outer spaces."""
    w = words(text)
    return {f" {' '.join(w[i:i + window])} " for i in range(len(w) - window + 1)}


def pieces(passage: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces of nearly equal length, with their offsets."""
    n, k = len(passage), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, passage[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Finder:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, edits: int) -> None:
        self.edits = edits
        owners: dict[str, set[int]] = {}
        for item, text in items:
            for p in passages(text, window):
                owners.setdefault(p, set()).add(item)
        found: dict[str, list[tuple[int, str, tuple[int, ...]]]] = {}
        for p, own in owners.items():
            for at, piece in pieces(p, edits):
                found.setdefault(piece, []).append((at, p, tuple(sorted(own))))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def items_in(self, text: str | None) -> set[int]:
        hits: set[int] = set()
        if self.empty or not text:
            return hits
        line = f" {' '.join(words(text))} "
        for end, (length, where) in self.automaton.iter(line):
            for at, passage, own in where:
                if hits.issuperset(own):
                    continue
                start = end + 1 - length - at
                around = line[max(0, start - self.edits):max(0, start + len(passage) + self.edits)]
                if myers(passage, around) <= self.edits:
                    hits.update(own)
        return hits


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 10, edits: int = 0, doc_key: str = "doc_id", item_key: str = "item_id", block_chars: int = 2_000_000) -> DataFrame:
    """``(doc_id, item_id)``: the documents that hold ``window`` consecutive words of an item, with at most ``edits`` character edits.

    Each pair comes once. Items of fewer than ``window`` words, null and empty texts give none; an item
    text may stand under several ids, each of which is reported. The items are read in blocks of
    ``block_chars`` characters and each block is matched against all documents.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks: list[list[tuple[int, str]]] = []
    size = 0
    for r in items.select(F.col(item_key).cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        if not blocks or size > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.t))
        size += len(r.t)
    schema = "doc_id long, item_id long"
    out = spark.createDataFrame([], schema)
    for block in blocks:

        def scan(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, window, edits)
            for batch in batches:
                d, i = [], []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    for item in finder.items_in(text):
                        d.append(doc)
                        i.append(item)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "item_id": pa.array(i, pa.int64())})

        out = out.unionByName(docs.mapInArrow(scan, schema))
    return out.distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, task, documents)``: every item with the number of documents that hold it, 0 included."""
    n = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "task").join(n, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
