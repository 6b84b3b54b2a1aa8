import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import pyarrow as pa

from skarn.llm import neardup
from skarn.llm.neardup import SKETCH, Fingerprints, components, golay_index, meeting, near_codewords, near_duplicates


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 300)
    base = golay_index(v)
    nearest = {}
    for n in range(4):
        for c in combinations(range(23), n):
            e = sum(1 << i for i in c)
            nearest.setdefault(int(golay_index(np.array([e]))[0]), set()).add(n)
    assert nearest == {0: {0, 1, 2, 3}}
    assert base.min() >= 0 and base.max() < 4096


def test_near_codewords():
    rng = np.random.default_rng(1)
    sums = rng.integers(-20, 21, (50, 23)) * 2 + 1
    word = (sums > 0) @ (1 << np.arange(23))
    index, cost, nearest = near_codewords(sums, 5, 6)
    assert (nearest == golay_index(word)).all()
    for i in range(50):
        assert len(set(index[i].tolist())) == 6 and (np.diff(cost[i]) >= 0).all()


def test_fewer_errors_than_tables_always_meet():
    rng = np.random.default_rng(2)
    fp = Fingerprints()
    a = rng.integers(-30, 31, (300, fp.width)) * 2 + 1
    b = (rng.integers(0, 31, a.shape) * 2 + 1) * np.sign(a)
    for row in b:
        row[SKETCH + rng.choice(fp.width - SKETCH, fp.tables - 1, replace=False)] *= -1
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(fp.keys(a), fp.keys(b)))


def test_three_segments_to_a_key():
    fp = Fingerprints(tables=4, joined=3, kept=10)
    words = [fp.words(" ".join(f"w{i * k}" for i in range(40))) for k in (1, 1, 7)]
    x, y, z = (set(k.tolist()) for k in fp.keys(fp.sums(words)))
    assert x == y and 40 <= len(x - {-1}) <= 44 and not x & z


def _sets(rows):
    out = {}
    for i, t, a in rows:
        import re

        w = re.findall("[a-z0-9]+", f"{t or ''} {a or ''}".lower())
        if len(w) >= 20:
            out[i] = {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
    return out


def _brute(rows):
    s = _sets(rows)
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.5}


def _corpus(n=220):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(25, 120))]
        rows.append((f"{i}a", "Title", " ".join(w)))
        for v in range(rng.choice([0, 0, 1, 3])):
            u = list(w)
            for _ in range(max(1, len(u) // rng.choice([9, 12, 20, 40]))):
                k = rng.randrange(len(u))
                u[k:k + 1] = rng.choice([[], [word()], [u[k], word()]])
            rows.append((f"{i}{'bcd'[v]}", "title", " ".join(u).upper()))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, abstract string").withColumns({c: F.lit(0) for c in ("doc", "key", "rep", "n", "text")})


def test_recall_and_exactness(spark):
    rows = _corpus()
    true = _brute(rows)
    got = [tuple(r) for r in near_duplicates(_frame(spark, rows), ["title", "abstract"]).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= true
    assert len(true) > 100 and len(set(got)) >= 0.99 * len(true)


def test_copies_nulls_and_short_texts(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [("a", "T", text), ("b", "t.", text), ("c", None, f"t {text}"), ("d", "T", None), ("e", None, None), ("f", "", "short " * 19), (None, "T", text), ("g", "long", "y " * 20000)]
    got = {tuple(r) for r in near_duplicates(_frame(spark, rows), ["title", "abstract"]).pairs().collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert near_duplicates(_frame(spark, rows).limit(0), ["title", "abstract"]).pairs().count() == 0 and near_duplicates(_frame(spark, rows).limit(0), ["title", "abstract"]).groups().count() == 0


def test_classes_of_any_size_keep_all_links(spark):
    text = [f"x{i}" for i in range(40)]
    near = " ".join(text[:-1] + ["other"])
    rows = [(f"c{i:02}", "T", " ".join(text)) for i in range(65)] + [("n", "T", near), ("m", "T", near), ("z", "T", " ".join(f"y{i}" for i in range(40)))]
    found = near_duplicates(_frame(spark, rows), ["title", "abstract"])
    for block in (7, 1000):
        got = [tuple(r) for r in found.pairs(block).collect()]
        assert len(got) == len(set(got)) == 67 * 66 // 2 and set(got) == set(combinations(sorted([f"c{i:02}" for i in range(65)] + ["n", "m"]), 2))
    groups = {r.id: tuple(r)[1:] for r in found.groups().collect()}
    assert groups["c07"] == ("c00", 65, 66, "c00") and groups["n"] == ("m", 2, 66, "c00") and groups["z"] == ("z", 1, 0, "z") and len(groups) == 68


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("a", "b"), ("c", "b"), ("d", "d")]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert roots == {f"{i:03}": "000" for i in range(41)} | {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_recall_of_block_edits():
    """Half of a text cut off, or a third replaced: similarity 0.5 to 0.6."""
    rng = random.Random(5)
    fp = Fingerprints()
    for cut in (True, False):
        pairs = []
        while len(pairs) < 300:
            a = [f"{rng.choice('abcdefgh') * rng.randint(1, 6)}{rng.randint(0, 900)}" for _ in range(rng.randint(60, 120))]
            k = int(len(a) * (rng.uniform(0.4, 0.5) if cut else rng.uniform(0.24, 0.33)))
            at = rng.randrange(len(a) - k)
            b = a[:-k] if cut else a[:at] + [f"new{rng.randint(0, 900)}" for i in range(k)] + a[at + k:]
            x, y = (fp.words(" ".join(w)) for w in (a, b))
            s, t = (set(fp.sequences(w).tolist()) for w in (x, y))
            if 0.5 <= len(s & t) / len(s | t) < 0.6:
                pairs.append((x, y))
        one, two = (fp.sums([p[i] for p in pairs]) for i in (0, 1))
        apart = ((one[:, :SKETCH] > 0) != (two[:, :SKETCH] > 0)).sum(axis=1)
        found = sum(bool(set(x.tolist()) & set(y.tolist()) - {-1}) and d <= 48 for x, y, d in zip(fp.keys(one), fp.keys(two), apart))
        assert found >= 0.9 * len(pairs)


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _shuffled(spark):
    return sum(x.totalShuffleWrite() for x in _each(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


def test_pairs_that_only_meet_take_no_disk(spark):
    """Texts of the same words in other order have the same keys and sketches, and nothing in common."""
    rng = random.Random(6)
    words = [f"x{i}" for i in range(60)]
    rows = [(f"{i:03}", "T", " ".join(rng.sample(words, 60))) for i in range(300)]
    rows.append(("near", "T", rows[0][2] + " more"))
    before = _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = near_duplicates(_frame(spark, rows), ["title", "abstract"])
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _shuffled(spark) - before < 1_000_000
    assert [tuple(r) for r in found.pairs().collect()] == [("000", "near")]
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = sum(f.length() for f in _each(files.getAllFiles()) if f.getName().startswith("shuffle_"))
    assert left < 1_000_000


def test_rounds_find_the_same(spark, monkeypatch):
    rows = _corpus(90)
    once = {tuple(r) for r in near_duplicates(_frame(spark, rows), ["title", "abstract"]).pairs().collect()}
    monkeypatch.setattr(neardup, "ROUND", 5000)
    monkeypatch.setattr(neardup, "FEW", 0)
    again = [tuple(r) for r in near_duplicates(_frame(spark, rows), ["title", "abstract"]).pairs().collect()]
    assert len(again) == len(set(again)) and set(again) == once and len(neardup._rounds(len(rows) * 13, 12)) > 3


def test_similar_sets_differ_in_few_odd_hashes():
    rng = np.random.default_rng(3)
    fp = Fingerprints()
    for _ in range(200):
        pool = rng.integers(-2**62, 2**62, rng.integers(2, 400))
        a, b = (np.unique(rng.choice(pool, rng.integers(1, len(pool)))) for _ in range(2))
        odd = fp.odd([a, b])
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_meeting_is_sharing_a_key(monkeypatch):
    rng = random.Random(8)
    for joined, kept in ((2, 12), (3, 10)):
        fp = Fingerprints(tables=4, joined=joined, kept=kept)
        base = [f"w{i}" for i in range(60)]
        words = [fp.words(" ".join(rng.sample(base, 45))) for _ in range(120)]
        keys = np.sort(fp.keys(fp.sums(words)).reshape(len(words), 4, -1), axis=-1)
        true = {(i, j) for i, j in combinations(range(len(words)), 2) if {*keys[i].ravel().tolist()} & {*keys[j].ravel().tolist()} - {-1}}
        filed = [neardup._filings(of[of >= 0], (of >= 0).sum(axis=1), joined) for of in (keys[:, t] for t in range(4))]
        rows = [(first, row, 45, bytes(48), rest) for x in filed for row, first, rest in zip(x[0].tolist(), x[1].tolist(), x[2].to_pylist())]
        rows.sort(key=lambda r: r[0])
        assert len(rows) < (keys >= 0).sum()
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at:at + 50]], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["key", "doc", "n", "bits", "rest"]) for at in range(0, len(rows), 50)]
        monkeypatch.setattr(neardup, "TOGETHER", 100)
        got = set()
        for doc, n, bits, key, at in neardup._whole_keys(iter(batches), joined):
            for i, j in meeting(key, at, n, bits, 0.0, 128):
                got |= {(min(x), max(x)) for x in zip(doc[i].tolist(), doc[j].tolist())}
        assert got == true and len(true) > 20


def test_sequences_of_many_texts():
    fp = Fingerprints()
    words = [fp.words(x) for x in ("a b c a b c a b", "one two", "", "y " * 30, "p q r s")]
    assert [s.tolist() for s in fp.sequence_sets(words)] == [fp.sequences(w).tolist() for w in words]
