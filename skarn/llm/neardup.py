"""Near-duplicate records with small edits (problem 6).

A record's fingerprint is a row of bits: the signs of the summed hashes of its distinct words,
longer words counting more. The bits are cut into segments of 23. The binary Golay code
[23,12,7] is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A segment
is decoded to the codewords near it, the likely errors first: the bits whose sums lie closest
to zero are the ones that a small edit turns, so a codeword costs the sums of the bits in which
it differs. A table joins two segments; a record is filed in each table under its ``kept``
cheapest pairs of codeword indices, the nearest pair always among them.

By pigeonhole, the errors of two records are shared out over the tables: with fewer differing
bits than tables, one table has none and the records meet there. With more, they meet in a table
whose errors are few or fall on weak bits, with the recall that the README gives. Records that
share a key and whose sketches (further bits) aren't far apart are verified by the exact Jaccard
similarity of their word sequences.

Two things keep that small on disk. With each key travel the number of sequences and a row of bits
that says of which hashes a record has an odd number: two records differ in at least as many sequences
as their rows in bits, so pairs that can't be similar end where they meet, and no other does. And keys
are filed in rounds, a few tables at a time; a round keeps its pairs and nothing else. Keys with the same
first codeword travel as one row.

Records with equal sets of sequences are one class, filed and joined once, by their representative.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.session import lookup_join, spread, tidy, written

#: Fixed value: generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_WORDS = re.compile(r"[a-z0-9]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _syndrome(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""
    error = np.zeros(2048, np.int32)
    for n in range(4):
        for bits in combinations(range(23), n):
            e = sum(1 << i for i in bits)
            error[_syndrome(e)] = e
    low = np.array([_syndrome(x) for x in range(4096)], np.int32)
    high = np.array([_syndrome(x << 12) for x in range(2048)], np.int32)
    return low, high, error


def golay_error(v: np.ndarray) -> np.ndarray:
    """The bits, at most 3, in which each 23-bit word differs from its codeword."""
    low, high, error = _tables()
    return error[low[v & 4095] ^ high[v >> 12]]


def golay_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (v ^ golay_error(v)) >> 11


def near_codewords(sums: np.ndarray, flips: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments of 23 sums (last axis) the indices of up to ``most`` codewords and their costs, cheapest first (a very large one marks a gap), and the index of the nearest one.

    Codewords are those that the word decodes to when any of its ``flips`` weakest bits are turned; the cost is the sum of the
    weights of the bits in which word and codeword differ.
    """
    weak = np.abs(sums).astype(np.int32)
    word = ((sums > 0).astype(np.float32) @ (1 << np.arange(23)).astype(np.float32)).astype(np.int32)
    turned = (1 << np.argpartition(weak, flips, axis=-1)[..., :flips]).astype(np.float32)
    patterns = (np.arange(1 << flips)[:, None] >> np.arange(flips) & 1).astype(np.float32)
    flip = (turned @ patterns.T).astype(np.int32)
    error = golay_error(word[..., None] ^ flip) ^ flip
    cost = np.zeros(error.shape, np.int32)
    for b in range(23):
        cost += (error >> b & 1) * weak[..., b, None]
    index = (word[..., None] ^ error) >> 11
    both = np.sort(cost.astype(np.int64) << 12 | index, axis=-1)
    both[..., 1:][both[..., 1:] == both[..., :-1]] = _GAP << 12
    both = np.sort(both, axis=-1)[..., :most]
    return both & 4095, both >> 12, index[..., 0]


_GAP = 1 << 40


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bits of the sketch that travels with each key.
SKETCH = 128
#: Bits of the row of odd hashes that travels with each key.
ODD = 256
#: Keys filed in one round, or those of one table if it has more.
ROUND = 15_000_000
#: Rows of whole keys that are compared together.
TOGETHER = 100_000
#: Rows of the lists of records up to which they are broadcast.
FEW = 1_000_000


class _Known(dict):
    """Words by number, with hash, weight and signs kept in ``store``."""

    def __init__(self, store: "Fingerprints") -> None:
        super().__init__()
        self.store = store

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.store.learn(n, word)
        return n


class Fingerprints:
    """Word-sequence sets, keys and sketches of texts, a block of texts at a time."""

    def __init__(self, tables: int = 12, joined: int = 2, kept: int = 12, flips: int = 5, shingle: int = 3, most_words: int = 50_000) -> None:
        self.tables, self.joined, self.kept, self.flips, self.shingle, self.most_words = tables, joined, kept, flips, shingle, most_words
        self.width = SKETCH + tables * joined * 23
        longs = -(-self.width // 64)
        self.seeds = _spread(np.arange(1, longs + 1, dtype=np.uint64) * _MIX)
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self)
        self.hashes, self.signs = np.zeros(1024, np.uint64), np.zeros((1024, self.width), np.int8)

    def learn(self, n: int, word: str) -> None:
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
        h = self.hashes[n] = np.uint64(xxhash.xxh64_intdigest(word))
        bits = np.unpackbits(_spread(self.seeds ^ h).view(np.uint8))[:self.width]
        self.signs[n] = (bits.astype(np.int8) * 2 - 1) * np.int8(max(min(len(word), 8) - 1, 1))

    def words(self, text: str) -> np.ndarray:
        """The numbers of the words in order."""
        return np.array(list(map(self.known.__getitem__, _WORDS.findall(text.lower()))), np.int32)

    def sequences(self, words: np.ndarray) -> np.ndarray:
        """The distinct runs of ``shingle`` words as sorted 64-bit hashes."""
        n = len(words) - self.shingle + 1
        if n < 1:
            return np.empty(0, np.int64)
        h = self.hashes[words]
        with np.errstate(over="ignore"):
            x = np.zeros(n, np.uint64)
            for i in range(self.shingle):
                x = _spread(x * np.uint64(31) + h[i:i + n] + np.uint64(i))
        return np.unique(x.view(np.int64))

    def sequence_sets(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """:meth:`sequences` of many texts at once."""
        lengths = np.array([len(w) for w in texts])
        ends = np.cumsum(lengths)
        n = int(lengths.sum()) - self.shingle + 1
        if n < 1:
            return [np.empty(0, np.int64) for _ in texts]
        h = self.hashes[np.concatenate(texts)]
        with np.errstate(over="ignore"):
            x = np.zeros(n, np.uint64)
            for i in range(self.shingle):
                x = _spread(x * np.uint64(31) + h[i:i + n] + np.uint64(i))
        x = x.view(np.int64)
        spans = [slice(a, max(b - self.shingle + 1, a)) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
        for own in spans:
            x[own].sort()
        new = np.concatenate([[True], x[1:] != x[:-1]])
        new[[own.start for own in spans if own.start < n]] = True
        return [x[own][new[own]] for own in spans]

    def sums(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row of sums per text, none of which is empty."""
        distinct = [np.unique(w) for w in texts]
        total = np.empty((len(texts), self.width), np.int32)
        for i, d in enumerate(distinct):
            self.signs[d].sum(axis=0, dtype=np.int32, out=total[i])
        return total

    def sketches(self, sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums[:, :SKETCH] > 0, axis=1)

    def odd(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each set of sequences the row of bits, set where an odd number of them has that hash."""
        at = np.repeat(np.arange(len(sets)) * ODD, [len(s) for s in sets]) + (np.concatenate(sets) & (ODD - 1))
        return np.packbits(np.bincount(at, minlength=len(sets) * ODD).reshape(-1, ODD) & 1, axis=1)

    def keys(self, sums: np.ndarray) -> np.ndarray:
        """The nearest key and the ``kept`` cheapest ones for each table, -1 for gaps and repeats: table number and codeword indices side by side."""
        n = len(sums)
        index, cost, at = near_codewords(sums[:, SKETCH:].reshape(n, self.tables, self.joined, 23), self.flips, 8)
        key = np.broadcast_to(np.arange(self.tables, dtype=np.int64)[:, None], (n, self.tables, 1))
        nearest, total = key.copy(), np.zeros(key.shape, np.int64)
        for j in range(self.joined):
            nearest = nearest << 12 | at[:, :, j, None]
            total = (total[..., :, None] + cost[:, :, j, None, :]).reshape(n, self.tables, -1)
            key = (key[..., :, None] << 12 | index[:, :, j, None, :]).reshape(n, self.tables, -1)
            if total.shape[-1] > self.kept:
                best = np.argpartition(total, self.kept - 1, axis=-1)[..., :self.kept]
                total, key = np.take_along_axis(total, best, -1), np.take_along_axis(key, best, -1)
        key = np.where((total < _GAP) & (key != nearest), key, -1)
        return np.concatenate([nearest, key], axis=-1).reshape(n, -1)


def _texts(records: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``doc, id, text``: the records that have a key, numbered. Whole texts; null fields are empty."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    asked = spread(records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), text.alias("text")))
    return asked.select(F.monotonically_increasing_id().alias("doc"), "id", "text")


def _key(joined: int) -> type:
    """The type that holds a key."""
    return np.int32 if joined < 3 else np.int64


def _rest(joined: int) -> tuple[int, type]:
    """The bits of a key behind its table and first codeword, and the type that holds them."""
    low = 12 * (joined - 1)
    return low, np.uint16 if low <= 16 else np.uint64


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Values side by side as a column of binaries of so many values each."""
    ends = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _filings(keys: np.ndarray, many: np.ndarray, joined: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of rows with so ``many`` keys of a table each, in order, the filings: row, table with first codeword, and the rests of all keys that begin with these."""
    low, kind = _rest(joined)
    row, first = np.repeat(np.arange(len(many)), many), keys >> low
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1])])[:len(keys)])
    return row[at], first[at].astype(np.int32), _binary((keys & (1 << low) - 1).astype(kind), np.diff(np.append(at, len(keys))))


def features(texts: DataFrame, least_words: int = 20, block: int = 256, **settings: int) -> DataFrame:
    """Of ``texts(doc, id, text)``, one row per text with at least ``least_words`` words: two hashes of its set of sequences and their number, sketch and odd hashes side by side, and the keys of each table side by side."""
    tables = Fingerprints(**settings).tables
    names = ["doc", "id", "h1", "h2", "n", "bits", *(f"k{t}" for t in range(tables))]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprints(**settings)
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                if len(fp.known) > fp.most_words:
                    fp.forget()
                found = [(d, i, w) for d, i, w in zip(part["doc"].to_pylist(), part["id"].to_pylist(), map(fp.words, part["text"].to_pylist())) if len(w) >= max(least_words, fp.shingle)]
                if not found:
                    continue
                sums = fp.sums([w for _, _, w in found])
                sets = fp.sequence_sets([w for _, _, w in found])
                bodies = [s.tobytes() for s in sets]
                keys = np.sort(fp.keys(sums).reshape(len(found), tables, -1), axis=-1)
                bits = np.concatenate([fp.sketches(sums), fp.odd(sets)], axis=1)
                columns = [pa.array([d for d, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.string()), *(pa.array([xxhash.xxh64_intdigest(b, seed) - 2**63 for b in bodies], pa.int64()) for seed in (0, 1)),
                           pa.array([len(s) for s in sets], pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary())]
                columns += [_binary(of[of >= 0].astype(_key(fp.joined)), (of >= 0).sum(axis=1)) for of in (keys[:, t] for t in range(tables))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ["long", "string", "long", "long", "int", "binary", *["binary"] * tables]
    return texts.mapInArrow(make, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def sequences(texts: DataFrame, shingle: int) -> DataFrame:
    """``doc, id, sequences``: the sets of word sequences of ``texts(doc, id, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprints(shingle=shingle)
        for batch in batches:
            if len(fp.known) > fp.most_words:
                fp.forget()
            if len(batch):
                sets = [fp.sequences(fp.words(t)) for t in batch["text"].to_pylist()]
                ends = pa.array(np.cumsum([0] + [len(x) for x in sets], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["id"], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["doc", "id", "sequences"])

    return texts.mapInArrow(make, "doc long, id string, sequences array<long>")


@dataclass
class NearDuplicates:
    """What was found: ``close(id, rep, size)``, one row per record that is similar to another, with the smallest id of its class and
    the size of that; ``links(rep_a, rep_b)``, rep_a < rep_b, the pairs of similar classes; ``takers(id)``, all records that take part. All are written tables."""

    close: DataFrame
    links: DataFrame
    takers: DataFrame

    def pairs(self, block: int = 1000) -> DataFrame:
        """``(id_a, id_b)``, id_a < id_b: every pair of similar records, those inside classes of any size included.

        A class is cut into blocks of about ``block`` members, and blocks are paired with blocks, so that no task holds a whole class.
        """
        blocks = F.ceil(F.col("size") / block).cast("int")
        cut = self.close.select("id", "rep", "size", blocks.alias("k"), F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).cast("int").alias("at"))
        own = cut.where("size > 1")
        inside = own.select(F.col("id").alias("x"), "rep", "at", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("to")).join(own.select(F.col("id").alias("y"), "rep", F.col("at").alias("to")), ["rep", "to"]).where("x < y").select("x", "y")
        sizes = self.close.where("id = rep").select("rep", "size")
        both = self.links.join(sizes.select(F.col("rep").alias("rep_a"), blocks.alias("ka")), "rep_a").join(sizes.select(F.col("rep").alias("rep_b"), blocks.alias("kb")), "rep_b")
        steps = both.select("rep_a", "rep_b", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("at_a"), "kb").select("rep_a", "rep_b", "at_a", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("at_b"))
        one, two = (cut.select(F.col("rep").alias(f"rep_{s}"), F.col("at").alias(f"at_{s}"), F.col("id").alias(n)) for s, n in (("a", "x"), ("b", "y")))
        across = steps.join(one, ["rep_a", "at_a"]).join(two, ["rep_b", "at_b"]).select("x", "y")
        return inside.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``(id, class_id, class_size, links, group_id)``: one row per record that takes part.

        ``class_id``: the smallest id with the same set of sequences; ``links``: how many other records are similar to it;
        ``group_id``: the smallest id that is reached over links.
        """
        ends = self.links.unionByName(self.links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
        sizes = self.close.where("id = rep").select("rep", "size")
        near = ends.join(sizes.select(F.col("rep").alias("rep_b"), "size"), "rep_b").groupBy(F.col("rep_a").alias("rep")).agg(F.sum("size").alias("near"))
        roots = components(self.links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))).withColumnRenamed("node", "rep")
        of = written(sizes.join(near, "rep", "left").join(roots, "rep", "left"), "classes")
        rows = lookup_join(self.close, of.select("rep", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "rep").alias("root"), F.col("size").alias("_rows")), ["rep"], "_rows")
        alone = self.takers.join(self.close.select("id"), "id", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"), F.col("id").alias("group_id"))
        return rows.select("id", F.col("rep").alias("class_id"), F.col("size").alias("class_size"), (F.col("size") - 1 + F.col("near")).alias("links"), F.col("root").alias("group_id")).unionByName(alone)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of the connected component of every node of ``edges(a, b)``.

    Each round, every node takes the least root of itself and its neighbours, then the root of that root; a round is a written
    table, and the number of rounds grows with the logarithm of the longest path.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = written(roots.join(seen, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("before")), "roots")
        jumped = lower.join(lower.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.least("root", "next").alias("root"), "before")
        jumped = written(jumped, "roots")
        moved = jumped.where("root <> before").limit(1).count()
        roots = jumped.select("node", "root")
        if not moved:
            return roots


def near_duplicates(records: DataFrame, fields: list[str], least: float = 0.5, shingle: int = 3, least_words: int = 20, tables: int = 12, joined: int = 2, kept: int = 12, most_bits: int = 48, key: str = "id") -> NearDuplicates:
    """The records whose sets of distinct ``shingle``-word sequences have Jaccard similarity >= ``least``, as classes and links.

    One row per ``key`` is expected; null keys, null and short texts take no part. Every link is exact; one is missed if no table
    files both records under a common key or if their sketches differ in more than ``most_bits`` of 128 bits (see the README for
    the recall of scattered and of block edits). ``joined`` segments make a key: each one more makes keys 4096 times finer, for larger collections.
    """
    with tidy(records.sparkSession):
        texts = written(_texts(records, fields, key), "texts", compression="zstd")
        prints = written(features(texts, least_words, tables=tables, joined=joined, kept=kept, shingle=shingle), "fingerprints", compression="zstd")
        classes = written(prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"), "classes")
        copied = written(lookup_join(prints.select("doc", "id", "h1", "h2"), classes.withColumn("n", F.col("size")), ["h1", "h2"], "n").select("doc", "id", "rep", "size"), "copied")
        reps = prints.join(_few(copied.where("id <> rep").select("doc")), "doc", "left_anti")
        rounds = [written(_met(reps, of, joined, least, most_bits), "candidates") for of in _rounds(prints.count() * (kept + 1), tables)]
        candidates = written(reduce(DataFrame.unionByName, rounds).distinct(), "candidates") if len(rounds) > 1 else rounds[0]
        asked = written(candidates.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct(), "asked")
        sets = written(sequences(texts.join(_few(asked), "doc").select("doc", "id", "text"), shingle), "sequences")
        one, two = (sets.select(F.col("doc").alias(f"doc_{x}"), F.col("id").alias(f"id_{x}"), F.col("sequences").alias(f"q_{x}")) for x in "ab")
        common = F.size(F.array_intersect("q_a", "q_b"))
        alike = common / (F.size("q_a") + F.size("q_b") - common) >= least
        links = written(candidates.join(one, "doc_a").join(two, "doc_b").where(alike).select(F.least("id_a", "id_b").alias("rep_a"), F.greatest("id_a", "id_b").alias("rep_b")), "links")
        single = links.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct().join(copied, "id", "left_anti")
        close = written(copied.select("id", "rep", "size").unionByName(single.select("id", F.col("id").alias("rep"), F.lit(1).cast("long").alias("size"))), "close")
    return NearDuplicates(close, links, prints.select("id"))


def _few(docs: DataFrame) -> DataFrame:
    """A written list of records, broadcast unless it is long."""
    return F.broadcast(docs) if docs.count() <= FEW else docs


def _rounds(keys: int, tables: int) -> list[list[int]]:
    """The rounds in which ``tables`` of ``keys`` keys each are filed."""
    at_once = max(1, ROUND // max(keys, 1))
    return [list(range(t, min(t + at_once, tables))) for t in range(0, tables, at_once)]


def _met(reps: DataFrame, tables: list[int], joined: int, least: float, most_bits: int) -> DataFrame:
    """``(doc_a, doc_b)``: the records that meet under a key of ``tables`` and may be similar."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            doc, n, bits = batch["doc"].to_numpy(), batch["n"].to_numpy(), _bytes(batch["bits"])[0].reshape(len(batch), -1)
            each = [_bytes(batch[f"k{t}"]) for t in tables]
            keys = np.concatenate([np.ascontiguousarray(x).view(_key(joined)) for x, _ in each])
            many = np.array([np.diff(ends, prepend=0) for _, ends in each]) // keys.itemsize
            if len(tables) > 1:  # side by side, rows of one record pack well
                keys = keys[np.argsort(np.repeat(np.tile(np.arange(len(batch)), len(tables)), many.ravel()), kind="stable")]
            row, first, rest = _filings(keys, many.sum(axis=0), joined)
            columns = [pa.array(doc[row]), pa.array(n[row]), _binary(bits[row], np.full(len(row), bits.shape[1])), pa.array(first), rest]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "bits", "key", "rest"])

    filed = reps.select("doc", "n", "bits", *[f"k{t}" for t in tables]).mapInArrow(file, "doc long, n int, bits binary, key int, rest binary")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, n, bits, key, at in _whole_keys(batches, joined):
            for i, j in meeting(key, at, n, bits, least, most_bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j]))], names=["doc_a", "doc_b"])

    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(pair, "doc_a long, doc_b long").distinct()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value ends."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]), ends[1:] - ends[0]


def _whole_keys(batches: Iterator[pa.RecordBatch], joined: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Doc, n and bits of many rows at a time, then their whole keys in order, and the row of each key; ``batches`` are in order of ``key``, and its rows stay together."""
    low, kind = _rest(joined)

    def out(key: np.ndarray, doc: np.ndarray, n: np.ndarray, bits: np.ndarray, many: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.repeat(np.arange(len(key)), many)
        whole = key[at].astype(np.int64) << low | rest.astype(np.int64)
        order = np.argsort(whole, kind="stable")
        return doc, n, bits, whole[order], at[order]

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        bits, (rest, ends) = _bytes(batch["bits"])[0], _bytes(batch["rest"])
        size = np.dtype(kind).itemsize
        held.append((*(batch[c].to_numpy() for c in ("key", "doc", "n")), np.ascontiguousarray(bits).view(np.uint64).reshape(len(batch), -1), np.diff(ends, prepend=0) // size, np.ascontiguousarray(rest).view(kind)))
        rows += len(batch)
        if rows >= TOGETHER and held[0][0][0] != held[-1][0][-1]:
            of = [np.concatenate(x) for x in zip(*held)]
            end = int(np.searchsorted(of[0], of[0][-1]))
            behind = int(of[4][:end].sum())
            yield out(*(x[:end] for x in of[:5]), of[5][:behind])
            held = [(*(x[end:] for x in of[:5]), of[5][behind:])]
            rows -= end
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def meeting(key: np.ndarray, at: np.ndarray, n: np.ndarray, bits: np.ndarray, least: float, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows with a common key that may be similar: sketches at most ``most_bits`` apart, and no more odd hashes or sequences on one side only than similar records have.

    ``key`` is in order, ``at`` has the row of each. Records with a and b sequences of which c are common have a + b - 2 c on one side only; similar ones at most (a + b) (1 - least) / (1 + least).
    """
    ends = np.searchsorted(key, key, side="right")
    columns = np.ascontiguousarray(bits.T)
    cut = SKETCH // 64
    n = n.astype(np.int64)
    i = np.flatnonzero(ends - np.arange(len(key)) > 1)
    step, held, found = 1, 0, []
    while len(i):
        x, y = at[i], at[i + step]
        most = (n[x] + n[y]) * ((1 - least) / (1 + least)) + 1e-6
        near = np.abs(n[x] - n[y]) <= most
        x, y, most = x[near], y[near], most[near]
        for part, limit in ((range(cut, len(columns)), None), (range(cut), most_bits)):
            apart = np.zeros(len(x), np.int64)
            for c in part:
                apart += np.bitwise_count(columns[c][x] ^ columns[c][y])
                near = apart <= (most if limit is None else limit)
                x, y, most, apart = x[near], y[near], most[near], apart[near]
        found.append((x, y))
        held += len(x)
        step += 1
        i = i[i + step < ends[i]]
        if held and (held > TOGETHER or not len(i)):
            x, y = (np.concatenate(z) for z in zip(*found))
            x, y = np.divmod(np.unique(np.minimum(x, y) * len(n) + np.maximum(x, y)), len(n))
            yield x, y
            held, found = 0, []
