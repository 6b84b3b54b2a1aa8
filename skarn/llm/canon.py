"""Mapping of freely typed values to a canonical list (problem 1).

A prefix-filter set-similarity join. Every distinct value has a few readings (whole, its
comma parts, parts swapped), and each reading is a set of tokens in up to three views:
character trigrams of its words, prefixes of its words (for abbreviations) and its initials
(for short names). Tokens are ordered by global rarity; only the rare prefixes of the sets
are joined, with length and positional filters, and Jaccard is then computed exactly. Of
the entries that an edit alignment lets pass, the most similar one is kept.

Both sides are tables, and Spark chooses how to join them. What the driver holds and sends is the order of the tokens:
trigrams of letters and digits and three-letter prefixes, which are bounded by the alphabet, not by the list.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import fold, osa, squash
from skarn.session import lookup_join, spread, written

#: Least Jaccard similarity by view.
THRESHOLDS = {"grams": 0.45, "prefixes": 1.0, "initials": 1.0}
#: What an equal set of a view is worth beside an equal set of trigrams.
WORTH = {"grams": 1.0, "prefixes": 0.7, "initials": 0.5}
# Words that don't distinguish names, and usual short or foreign forms of words.
MINOR = frozenset("of the and for in on at de der des du la le les und et y & a an to".split())
SHORT = dict(x.split("=") for x in """jnl=journal jrnl=journal hlth=health hosp=hospital inst=institute coll=college univ=university dept=department natl=national intl=international ctr=centre center=centre cntr=centre sch=school tech=technical gen=general
qtly=quarterly quart=quarterly bus=business assn=association soc=society mgmt=management technische=technical technisches=technical universitat=university universite=university universidad=university universita=university universiteit=university institut=institute instituto=institute zentrum=centre
centro=centre hopital=hospital krankenhaus=hospital klinikum=hospital schule=school ecole=school escuela=school zeitschrift=journal revue=review revista=review tecnica=technical technique=technical medizin=medicine nationales=national national=national konigliches=royal""".split())
_SPLIT = re.compile(r"\s*[,;:]\s+|\s+[-–—|/]\s+|\s*;\s*")
_TAIL = re.compile(r"\s*(?:\b(?:vol(?:ume)?|no|nr|issue)\b\.?\s*)?\d+\s*(?:\(\d+(?:[-–]\d+)?\))?\s*$|\s*\bissn\b.*$|\s*\((?:online|print|[^()]{1,30})\)\s*$|\s*\[[^\[\]]*\]\s*$", re.I)
_INITIALS = re.compile(r"^(?:[A-Za-z][.\s]*){2,}$")
_WORD = re.compile(r"[a-z0-9&]+(?:'[a-z]+)?")


@lru_cache(maxsize=50_000)
def name_words(text: str) -> list[str]:
    """Lower-case words without accents, minor words left out."""
    return [w for w in _WORD.findall(fold(text).lower()) if w not in MINOR]


def readings(value: str) -> list[str]:
    """What a typed value may stand for: itself, without its tail, its parts, and two parts swapped."""
    whole = squash(value.replace(" ", " ")).strip(" .;,*")
    out = [whole]
    cut = whole
    while (shorter := _TAIL.sub("", cut).strip(" .;,:")) != cut and shorter:
        cut = shorter
        out.append(cut)
    parts = [p for p in (x.strip(" .;,") for x in _SPLIT.split(cut)) if p]
    if len(parts) > 1:
        out += parts
        if len(parts) == 2:
            out.append(f"{parts[1]} {parts[0]}")
        else:
            out += [f"{a}, {b}" for a, b in zip(parts, parts[1:])]
    return list(dict.fromkeys(x for x in out if x))


@lru_cache(maxsize=50_000)
def token_sets(text: str) -> dict[str, list[str]]:
    """The token sets of one reading or entry name, by view."""
    words = name_words(text)
    out: dict[str, list[str]] = {}
    grams = {f"{p[i:i + 3]}" for w in words for p in (f"^{w}$",) for i in range(len(p) - 2)}
    if grams:
        out["grams"] = sorted(grams)
    full = [SHORT.get(w, w) for w in words]
    heads = sorted({w[:3] for w in full})
    if len(heads) > 1:
        out["prefixes"] = heads
    return out


def initials(text: str) -> str | None:
    """The letters of a value that looks like a short name."""
    if _INITIALS.match(text):
        letters = re.sub(r"[^a-z]", "", fold(text).lower())
        if len(letters) >= 2 and (len(letters) <= 8 or text.isupper()):
            return letters
    return None


def align(words: list[str], target: list[str], most: int) -> int:
    """Least total edits that turn ``words`` into ``target`` in any order; ``most + 1`` when there are more. Left-over words must be misspelt minor words."""
    left, missing = list(words), []
    for t in target:
        if t in left:
            left.remove(t)
        else:
            missing.append(t)
    total = 0
    if len(missing) > most or len(left) < len(missing):
        return most + 1
    for t in missing:
        allowed = min(most - total, 2 if len(t) > 4 else 1)
        best, at = allowed + 1, -1
        for i, w in enumerate(left):
            d = osa(w, t, allowed)
            if d < best:
                best, at = d, i
        if at < 0:
            return most + 1
        total += best
        del left[at]
    for w in left:
        d = min(osa(w, m, 1) for m in ("of", "the", "and", "for")) if len(w) <= 4 else most + 1
        total += d if d <= 1 else most + 1
    return min(total, most + 1)


@lru_cache(maxsize=200_000)
def check(reading: str, view: str, name: str, short: str | None, most: int = 2) -> float | None:
    """The cost of reading ``reading`` as the entry ``name``: edits, more for abbreviations; None when it can't be meant."""
    if view == "initials":
        letters = initials(reading)
        if letters and short and letters == re.sub(r"[^a-z]", "", fold(short).lower()):
            return 1.0
        return 1.5 if letters and not short and letters == "".join(w[0] for w in name_words(name)) else None
    words, target = name_words(reading), name_words(name)
    if view == "prefixes":
        if len(words) != len(target):
            return None
        expanded = [SHORT.get(w, w) for w in words]
        ordered = all(len(w) >= 3 and t.startswith(w) for w, t in zip(expanded, target))
        swapped = sorted(expanded) == sorted(target)
        return 0.5 if ordered or swapped else None
    d = align(words, target, most)
    if d:
        low, whole = fold(reading).lower(), fold(name).lower()
        d = min(d, osa(low, whole, most), osa(low.removeprefix("the "), whole, most), osa(" ".join(words), " ".join(target), most))
    return float(d) if d <= most else None


def ref_views(name: str, short: str | None) -> Iterator[tuple[str, list[str]]]:
    """The token sets of an entry; its initials are those of its short name if it has one."""
    yield from token_sets(name).items()
    yield "initials", [re.sub(r"[^a-z]", "", fold(short).lower()) if short else "".join(w[0] for w in name_words(name))]


def value_views(value: str) -> Iterator[tuple[str, str, list[str]]]:
    for r in readings(value):
        for view, tokens in token_sets(r).items():
            yield r, view, tokens
        if letters := initials(r):
            yield r, "initials", [letters]


def _ranked(rank: dict[tuple[str, str, str], int], kind: str, view: str, tokens: list[str]) -> list[int]:
    """The tokens known to the list, rarest first; initials are compared as a whole and have no order."""
    if view == "initials":
        return [xxhash.xxh64_intdigest(t) - 2**63 for t in tokens]
    return sorted(rank[kind, view, t] for t in tokens if (kind, view, t) in rank)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate(kinds.items())})


_TEXT, _NUMBERS = pa.string(), pa.list_(pa.int64())


def match_values(values: DataFrame, refs: DataFrame, most_edits: int = 2) -> DataFrame:
    """``(kind, value, n, ref_id)``: one row per distinct value of ``values(kind, value)`` with the number of its rows.

    ``ref_id`` is the entry meant: the one with the highest Jaccard similarity (times :data:`WORTH`, less a tenth for each edit) among
    those that the value may be read as with at most ``most_edits`` edits; -1 if none is or if two fit equally well.
    Null and blank values have no row. Equal names under two ids count as two entries that fit equally well.
    ``refs``: ``ref_id, kind, name, short_name``, of any size. The result is a written table.
    """
    spark = values.sparkSession
    entries = refs.select(F.col("ref_id").cast("long").alias("ref_id"), "kind", "name", "short_name").where("ref_id is not null and kind is not null and name is not null").distinct()
    distinct = written(spread(values.select("kind", F.col("value").cast("string").alias("value")).where("value rlike '[^\\\\s\\\\u00a0]'").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))), "values")

    def list_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(kind, view, t) for kind, name in zip(batch["kind"].to_pylist(), batch["name"].to_pylist()) for view, tokens in token_sets(name).items() for t in tokens}
            yield _batch(sorted(found), {"k": _TEXT, "v": _TEXT, "t": _TEXT})

    known = {tuple(r) for r in entries.mapInArrow(list_tokens, "k string, v string, t string").distinct().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for kind, value in zip(batch["kind"].to_pylist(), batch["value"].to_pylist()):
                for _, view, tokens in value_views(value):
                    for t in tokens:
                        key = (kind, view, t)
                        if key in known:
                            total[key] = total.get(key, 0) + 1
        yield _batch([(*k, n) for k, n in total.items()], {"k": _TEXT, "v": _TEXT, "t": _TEXT, "n": pa.int64()})

    counts = {(r.k, r.v, r.t): r.n for r in distinct.select("kind", "value").mapInArrow(count, "k string, v string, t string, n long").groupBy("k", "v", "t").agg(F.sum("n").alias("n")).collect()}
    rank = {key: i for i, key in enumerate(sorted(known, key=lambda x: (counts.get(x, 0), x)))}

    def ref_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, kind, name, short in zip(*(batch[c].to_pylist() for c in ("ref_id", "kind", "name", "short_name"))):
                for view, tokens in ref_views(name, short):
                    ranks = _ranked(rank, kind, view, tokens)
                    for at, x in enumerate(ranks[:len(ranks) - math.ceil(THRESHOLDS[view] * len(ranks)) + 1]):
                        rows.append((kind, view, x, at, len(ranks), ref, name, short, ranks))
            yield _batch(rows, {"kind": _TEXT, "view": _TEXT, "token": pa.int64(), "r_at": pa.int32(), "r_size": pa.int32(), "ref_id": pa.int64(), "name": _TEXT, "short": _TEXT, "r_ranks": _NUMBERS})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, value in zip(batch["kind"].to_pylist(), batch["value"].to_pylist()):
                for r, view, tokens in value_views(value):
                    ranks = _ranked(rank, kind, view, tokens)
                    if ranks:
                        rows.append((kind, value, r, view, len(tokens), len(tokens) - len(ranks), ranks))
            yield _batch(rows, {"kind": _TEXT, "value": _TEXT, "reading": _TEXT, "view": _TEXT, "size": pa.int32(), "unknown": pa.int32(), "ranks": _NUMBERS})

    right = written(entries.mapInArrow(ref_prefixes, "kind string, view string, token long, r_at int, r_size int, ref_id long, name string, short string, r_ranks array<long>"), "list-prefixes")
    limit = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])[F.col("view")]
    prefix = F.col("size") - F.ceil(limit * F.col("size")) + 1 - F.col("unknown")
    left = distinct.select("kind", "value").mapInArrow(sets, "kind string, value string, reading string, view string, size int, unknown int, ranks array<long>").withColumn("_t", limit)
    left = left.select("*", F.posexplode(F.slice("ranks", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("_p", "token")).withColumn("l_at", F.col("_p") + F.col("unknown"))
    need = F.ceil(F.col("_t") / (1 + F.col("_t")) * (F.col("size") + F.col("r_size")) - 1e-9)
    bound = 1 + F.least(F.col("size") - F.col("l_at") - 1, F.col("r_size") - F.col("r_at") - 1)
    paired = left.join(right, ["kind", "view", "token"]).where((F.col("r_size") >= F.col("_t") * F.col("size") - 1e-9) & (F.col("size") >= F.col("_t") * F.col("r_size") - 1e-9) & (bound >= need))
    common = F.size(F.array_intersect("ranks", "r_ranks"))
    alike = paired.withColumn("alike", common / (F.col("size") + F.col("r_size") - common)).where(F.col("alike") >= F.col("_t") - 1e-9)
    similar = spread(alike.select("kind", "value", "reading", "view", "ref_id", "name", "short", "alike").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, value, reading, view, ref, name, short, sim in zip(*(batch[c].to_pylist() for c in ("kind", "value", "reading", "view", "ref_id", "name", "short", "alike"))):
                cost = check(reading, view, name, short, most_edits)
                if cost is not None:
                    rows.append((kind, value, ref, round(cost / 10 - sim * WORTH[view], 9)))
            yield _batch(rows, {"kind": _TEXT, "value": _TEXT, "ref_id": pa.int64(), "far": pa.float64()})

    passed = similar.mapInArrow(verify, "kind string, value string, ref_id long, far double").groupBy("kind", "value", "ref_id").agg(F.min("far").alias("far"))
    best = passed.withColumn("_k", F.rank().over(Window.partitionBy("kind", "value").orderBy("far"))).where("_k = 1").groupBy("kind", "value").agg(F.when(F.count(F.lit(1)) == 1, F.min("ref_id")).otherwise(-1).alias("ref_id"))
    return written(distinct.join(best, ["kind", "value"], "left").select("kind", "value", "n", F.coalesce("ref_id", F.lit(-1)).cast("long").alias("ref_id")), "matched")


def publication_values(publications: DataFrame) -> DataFrame:
    """``(publication_id, kind, value_pos, value)``: the journal and every institution of each publication."""
    journal = F.array(F.struct(F.lit("journal").alias("kind"), F.lit(0).alias("value_pos"), F.col("journal").alias("value")))
    places = F.transform(F.coalesce("institutions", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("institution").alias("kind"), i.alias("value_pos"), x.alias("value")))
    return publications.select(F.col("id").alias("publication_id"), F.explode(F.concat(journal, places)).alias("_v")).select("publication_id", "_v.*")


def map_to_canonical(publications: DataFrame, refs: DataFrame, most_edits: int = 2) -> DataFrame:
    """``(publication_id, field_name, value_pos, ref_id)``: one row per value that isn't blank and isn't an entry's name as it stands."""
    names = refs.select("kind", F.col("name").alias("value")).where("name is not null").distinct()
    values = publication_values(publications).where("value rlike '[^\\\\s\\\\u00a0]'").join(names, ["kind", "value"], "left_anti")
    values = written(values.select("publication_id", "kind", "value_pos", "value"), "typed-values")
    matched = match_values(values, refs, most_edits)
    rows = lookup_join(values, matched, ["kind", "value"], "n")
    return rows.select("publication_id", F.when(F.col("kind") == "journal", "journal").otherwise("institutions").alias("field_name"), F.col("value_pos").cast("int").alias("value_pos"), "ref_id")
