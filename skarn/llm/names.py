"""Variant spellings of names typed by people (problem 5).

A typed name is read into given name, middle initial and surname in every order it may be
written in. Distinct surnames live in a metric space under Levenshtein distance: pivots cut
the space into cells, every known surname belongs to the cell of its nearest pivot, and a
typed surname is sent to each cell that, by the triangle inequality, may hold a surname within
the radius. Cells are cut further by the distance to their pivot. The radius join inside
a cell is exact; given names are then compared, and a unique best person is the one meant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import fold, osa, squash
from skarn.session import lookup_join, spread, written

# Titles and degrees, and usual short forms of given names with the names they stand for.
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame lord lady rev revd hon assoc associate asst assistant emeritus phd dphil msc bsc ba ma mba mphil md mbbs rn rgn frcp frcs facs fmedsci jr sr esq ing dipl ceng bmbs dds dnp edd mph mres llb llm cpsychol".split())
NICKNAMES = {k: v.split() for k, v in (x.split("=") for x in """abby=abigail|abbie=abigail|gail=abigail|alex=alexander alexandra|al=alexander alan albert|sandy=alexander alexandra sandra|andy=andrew|drew=andrew|tony=anthony|ant=anthony|ben=benjamin|benny=benjamin|benji=benjamin
charlie=charles charlotte|chuck=charles|chas=charles|chris=christopher christina christian|kit=christopher|topher=christopher|dan=daniel|danny=daniel|deb=deborah|debbie=deborah|debby=deborah|dima=dmitri|mitya=dmitri|dora=dorothea|dot=dorothea dorothy|dorothy=dorothea|thea=dorothea|dolly=dorothea dorothy
ed=edward edwin|eddie=edward|ted=edward theodore|teddy=edward theodore|ned=edward|ellie=eleanor|nell=eleanor|nora=eleanor|ella=eleanor|liz=elizabeth|lizzie=elizabeth|beth=elizabeth|betty=elizabeth|eliza=elizabeth|libby=elizabeth|betsy=elizabeth|bess=elizabeth|lisa=elizabeth
frank=francisco francis franklin|paco=francisco|pancho=francisco|cisco=francisco|fred=frederick alfred|freddie=frederick|freddy=frederick|rick=frederick richard eric|gabby=gabrielle|gaby=gabrielle|gabi=gabrielle|gab=gabrielle|gem=gemma|bella=isabella|izzy=isabella|isa=isabella|belle=isabella
jim=james|jimmy=james|jamie=james|jen=jennifer|jenny=jennifer|jenna=jennifer|jon=jonathan|jonny=jonathan|nathan=jonathan nathaniel|pepe=jose|joe=joseph|joey=joseph|kate=katherine|katie=katherine|kathy=katherine|kath=katherine|kitty=katherine|kat=katherine|katy=katherine|kay=katherine
maggie=margaret|meg=margaret|peggy=margaret|margie=margaret|madge=margaret|greta=margaret|rita=margaret|matt=matthew|matty=matthew|max=maximilian maxwell|maxim=maximilian|mike=michael|mick=michael|mickey=michael|mikey=michael|nick=nicholas|nicky=nicholas|nico=nicholas
pat=patricia patrick|patty=patricia|patti=patricia|trish=patricia|tricia=patricia|becky=rebecca|becca=rebecca|bec=rebecca|rich=richard|richie=richard|dick=richard|ricky=richard|rob=robert|bob=robert|bobby=robert|robbie=robert|bert=robert albert herbert|sam=samuel samantha|sammy=samuel
steph=stephanie|steffi=stephanie|stevie=stephanie stephen|sue=susan|susie=susan|suzy=susan|suzie=susan|tess=theresa|tessa=theresa|terry=theresa terence|terri=theresa|tessie=theresa|tom=thomas|tommy=thomas|tim=timothy|timmy=timothy|vicky=victoria|vicki=victoria|vic=victoria victor|tori=victoria
bill=william|will=william|billy=william|willy=william|liam=william|willie=william|zach=zachary|zack=zachary|zac=zachary|zak=zachary|greg=gregory|jeff=jeffrey|ken=kenneth|larry=laurence|len=leonard|ron=ronald|don=donald|doug=douglas|phil=philip|ray=raymond|steve=stephen steven|dave=david|pete=peter""".replace("\n", "|").split("|"))}
#: Of each full name the initials of its short forms.
_SHORT_INITIALS: dict[str, str] = {}
for _short, _full in NICKNAMES.items():
    for _name in _full:
        _SHORT_INITIALS[_name] = _SHORT_INITIALS.get(_name, "") + _short[0]
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-Þ][a-zà-öø-ÿ])")
_SIGNS = re.compile(r"[*†‡§¶#¹²³⁰-⁹₀-₉\d]|\([^()]*\)|\[[^\[\]]*\]")


def _letters(word: str) -> str:
    return re.sub(r"[^a-z]", "", fold(word).lower())


def _initials(word: str) -> str | None:
    """The letters of a word that can only be initials: 'J.', 'J', 'TC', 'J.-P.'."""
    bare = re.sub(r"[.\-]", "", word)
    if len(bare) == 1 and bare.isalpha():
        return _letters(bare) or None
    if len(bare) <= 3 and bare.isalpha() and (bare.isupper() and "." in word or bare.isupper() and len(bare) == 2):
        return _letters(bare) or None
    return None


def readings(name: str | None) -> list[tuple[str, str, str]]:
    """``(given, middle initials, surname)`` in every way ``name`` may be read; ``given`` is one letter if only an initial is typed.
    The initial of a middle name typed in full is followed by ``+``, as it may be half a surname instead.

    Signs, titles and degrees are left out, accents and letter case don't count, two surnames are written as one word.
    A name of which no given name or no surname is left has no reading.
    """
    if not name:
        return []
    text = squash(_SIGNS.sub(" ", name.replace(" ", " ").replace("’", "'")))
    text = re.sub(r"\s+[-–]\s+", "-", text)
    parts = [p.strip() for p in text.split(",")]

    def clean(part: str) -> list[str]:
        return [w for w in part.split() if w.strip(".") and re.sub(r"[.']", "", fold(w)).lower() not in TITLES]

    kept = [c for c in (clean(p) for p in parts) if c]
    if not kept:
        return []

    def given(words: list[str]) -> tuple[str, str] | None:
        first = words[0] if words else ""
        ini = _initials(first)
        rest = "".join(_initials(w) or _letters(w)[:1] + "+" for w in words[1:])
        if ini:
            return ini[0], ini[1:] + rest
        g = _letters(first)
        return (g, rest) if g else None

    def surname(words: list[str]) -> str:
        return "".join(_letters(w) for w in words)

    def read(front: list[str], last: list[str]) -> None:
        g, s = given(front), surname(last)
        if g and len(s) > 1 and not (len(last) == 1 and _initials(last[0]) and len(s) < 3):
            out.append((g[0], g[1], s))

    out: list[tuple[str, str, str]] = []
    if len(kept) > 1:
        read(kept[1], kept[0])
        return out
    words = kept[0]
    if len(words) < 2:
        pieces = _CAMEL.split(words[0])
        return out if len(pieces) < 2 else readings(" ".join(pieces))
    tail = len(words)
    while tail > 1 and _initials(words[tail - 1]):
        tail -= 1
    if tail < len(words):
        read(words[tail:], words[:tail])
        return out
    shouted = [len(_letters(w)) > 2 and w.upper() == w for w in words]
    if shouted[0] and not all(x or _initials(w) for x, w in zip(shouted, words)):
        n = shouted.index(False)
        read(words[n:], words[:n])
        return out
    read(words[:-1], words[-1:])
    if len(words) > 2 and not _initials(words[-2]):
        read(words[:-2], words[-2:])
    if len(words) == 2 and not _initials(words[0]):
        read(words[1:], words[:1])
    return list(dict.fromkeys(out))


def clipped(short: str, full: str) -> float | None:
    """The cost of one name as a written-short form of the other: half an edit for its first three to five letters (Geo, Benj), more than an edit
    for up to four letters of it in order, the first and the last among them (Wm, Chas, Robt); None if it is neither."""
    if not 2 <= len(short) < len(full):
        return None
    if 3 <= len(short) <= 5 and full.startswith(short):
        return 0.5
    letters = iter(full)
    return 1.25 if len(short) <= min(4, len(full) - 2) and short[0] == full[0] and short[-1] == full[-1] and all(c in letters for c in short) else None


def given_cost(typed: str, known: str, most: int) -> float:
    """Edits between two given names, 0 for initials and short forms that fit, half an edit for the initial of a short form, :func:`clipped` for forms written short; ``most + 1`` if they don't fit."""
    if typed == known:
        return 0
    if len(typed) == 1 or len(known) == 1:
        if typed[0] == known[0]:
            return 0
        short, full = (typed, known) if len(typed) == 1 else (known, typed)
        return 0.5 if len(full) > 1 and short in _SHORT_INITIALS.get(full, "") else most + 1
    a, b = NICKNAMES.get(typed, []), NICKNAMES.get(known, [])
    if known in a or typed in b or set(a) & set(b):
        return 0
    edits = min(osa(x, y, most) for x in [typed, *a] for y in [known, *b])
    short = clipped(typed, known) or clipped(known, typed)
    return edits if short is None or edits <= short else short


def name_cost(g: str, s: str, kg: str, ks: str, most: int) -> float | None:
    """Edits between two names, at most ``most`` in each part; more than one part is misspelt only in names long enough to bear it (given name 4 letters, surname 5). None if they don't fit."""
    d = osa(s, ks, most)
    if d > most:
        return None
    e = given_cost(g, kg, most)
    if e > max(most, 1.25) or d and e >= 0.5 and not (e == 1 and len(g) >= 4 and len(kg) >= 4 and len(ks) >= 5):
        return None
    return d + e


@lru_cache(maxsize=100_000)
def given_keys(given: str, typed: bool) -> tuple[str, ...]:
    """Keys of which two given names that may fit by :func:`given_cost` share one: the typed one's and the known one's.

    One edit leaves the first two letters, the last two or the first and the last as they were, but in names of up to four letters perhaps only one of them;
    short forms and what they stand for are filed alike. Initials meet full names only, so that frequent initials pair no full names.
    """
    if len(given) == 1:
        return (f"{'i' if typed else 'j'}{given}", f"={given}")
    out = {f"j{given[0]}"} if typed else {f"i{given[0]}", *(f"i{c}" for c in _SHORT_INITIALS.get(given, ""))}
    if typed:
        out |= {f"j{c}" for c in _SHORT_INITIALS.get(given, "")}
    for x in (given, *NICKNAMES.get(given, ())):
        out |= {f"^{x[:2]}", f"{x[-2:]}$", f"-{x[0]}{x[-1]}"}
        if len(x) <= 4:
            out |= {f"^{x[0]}", f"{x[-1]}$", "".join(sorted(x))}
    return tuple(sorted(out))


def _forms(df: DataFrame, typed: bool) -> DataFrame:
    """``df(name)`` with its readings ``g, m, s`` and the keys ``e`` of the given name."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *r, given_keys(r[0], typed)) for n in batch["name"].to_pylist() for r in readings(n)]
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in rows], pa.list_(pa.string()) if c == "e" else pa.string()) for i, c in enumerate(("name", "g", "m", "s", "e"))})

    return df.mapInArrow(make, "name string, g string, m string, s string, e array<string>")


def metric_join(left: DataFrame, right: DataFrame, radius: int = 2, pivots: int = 64, most_pivots: int = 1024) -> DataFrame:
    """``(a, b)``: all pairs of distinct strings of ``left(s)`` and ``right(s)`` within Levenshtein distance ``radius``. Exact.

    ``pivots`` pivots, or half the square root of the number of right strings up to ``most_pivots``, are right strings with the smallest hashes. Each right string x
    lies in the cell of its nearest pivot p, ring d(x, p). A left string q may meet x only if d(q, p) <= d(q, nearest pivot of q) + 2 radius and
    |d(q, p) - d(x, p)| <= radius, so it is sent to those cells and rings alone. Distances to the pivots are column expressions, without a cross join.
    """
    spark = left.sparkSession
    left, right = (written(x.select("s").where("s is not null").distinct(), "strings") for x in (left, right))
    n = right.count()
    if not n:
        return spark.createDataFrame([], "a string, b string")
    wanted = min(max(pivots, int(n ** 0.5 / 2)), most_pivots)
    chosen = [r.s for r in right.orderBy(F.xxhash64("s"), "s").limit(wanted).collect()]

    def placed(df: DataFrame) -> DataFrame:
        return spread(df).withColumn("d", F.transform(F.array(*[F.lit(p) for p in chosen]), lambda p: F.levenshtein(F.col("s"), p)))

    home = placed(right).withColumn("cell", F.array_position("d", F.array_min("d")).cast("int")).select(F.col("s").alias("b"), "cell", F.array_min("d").alias("ring"))
    home = written(home, "cells")
    reach = {r.cell: r.far for r in home.groupBy("cell").agg(F.max("ring").alias("far")).collect()}
    far = F.array(*[F.lit(reach.get(i + 1, -10**6)) for i in range(len(chosen))])
    near = F.array_min("d") + 2 * radius
    cells = F.filter(F.transform(F.arrays_zip(F.col("d"), far.alias("far")), lambda x, i: F.struct((i + 1).alias("cell"), x["d"].alias("d"), x["far"].alias("far"))), lambda x: (x["d"] <= F.col("near")) & (x["d"] <= x["far"] + radius))
    sent = placed(left).withColumn("near", near).select(F.col("s").alias("a"), F.explode(cells).alias("c"))
    rings = F.explode(F.sequence(F.greatest(F.lit(0), F.col("c.d") - radius), F.least(F.col("c.d") + radius, F.col("c.far"))))
    sent = sent.where(F.greatest(F.lit(0), F.col("c.d") - radius) <= F.least(F.col("c.d") + radius, F.col("c.far"))).select("a", F.col("c.cell").alias("cell"), rings.alias("ring"))
    return sent.join(home, ["cell", "ring"]).where((F.abs(F.length("a") - F.length("b")) <= radius) & (F.levenshtein("a", "b", radius).between(0, radius))).select("a", "b")


def link_names(names: DataFrame, persons: DataFrame, most_edits: int = 1, radius: int = 2, pivots: int = 64) -> DataFrame:
    """``(name, n, person_id)``: the distinct typed ``names(name)`` that mean exactly one of ``persons(id, name)``.

    A name means a person if its surname and its given name are the person's up to ``most_edits`` edits in each (a swap
    of neighbours is one, so the metric radius is 2; see :func:`name_cost`), the given name being typed in full, as an initial or as a short form,
    and no middle initials contradict. Fewer edits, then an agreeing middle initial, fit better; if the best fit is shared by two persons, the name
    means none. Persons whose names read alike are never told apart. Null or unreadable names mean nobody.
    """
    typed = written(spread(names.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))), "typed-names")
    known = persons.where("id is not null and name is not null").select("id", "name").distinct()
    forms = written(_forms(typed.select("name"), True), "typed-forms")
    people = _forms(spread(known.select("name").distinct()), False).join(known, "name").groupBy("g", "m", "s").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("id"), F.first("e").alias("e"))
    people = written(people, "known-forms")
    near = written(metric_join(forms.select("s"), people.select("s"), radius, pivots), "near-surnames")
    distinct = forms.groupBy("g", "m", "s").agg(F.first("e").alias("e"))
    a = distinct.join(near, F.col("s") == F.col("a")).select("g", "m", "s", "b", F.col("e").alias("keys"), F.explode("e").alias("key"))
    b = people.select(F.col("g").alias("kg"), F.col("m").alias("km"), F.col("s").alias("b"), "ids", "id", F.col("e").alias("known_keys"), F.explode("e").alias("key"))
    once = F.array_min(F.array_intersect("keys", "known_keys")) == F.col("key")
    pairs = spread(a.join(b, ["b", "key"]).where(once).select("g", "m", "s", "kg", "km", "b", "ids", "id"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, m, s, kg, km, b, ids, person in zip(*(batch[c].to_pylist() for c in ("g", "m", "s", "kg", "km", "b", "ids", "id"))):
                if m and km and m[0] != km[0]:
                    continue
                d = name_cost(g, s, kg, b, most_edits)
                if d is not None:
                    rows.append((g, m, s, int(6 * d) + (not (m and km)) + (m.endswith("+") and not km), ids, person))
            kinds = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in rows], k) for i, (c, k) in enumerate(zip(("g", "m", "s", "cost", "ids", "id"), kinds))})

    fits = pairs.mapInArrow(judge, "g string, m string, s string, cost int, ids long, id string")
    of_name = forms.join(fits, ["g", "m", "s"]).select("name", "cost", "ids", "id")
    best = of_name.withColumn("_k", F.rank().over(Window.partitionBy("name").orderBy("cost"))).where("_k = 1")
    one = best.groupBy("name").agg(F.count_distinct("id").alias("k"), F.max("ids").alias("ids"), F.min("id").alias("person_id")).where("k = 1 and ids = 1")
    return written(typed.join(one, "name").select("name", "n", "person_id"), "linked-names")


def unlinked_authors(publications: DataFrame) -> DataFrame:
    """``(publication_id, author_pos, name)`` of the author entries without a profile."""
    entries = publications.select(F.col("id").alias("publication_id"), F.posexplode("authors").alias("author_pos", "_a"))
    return entries.where("_a.profile_url is null or _a.profile_url = ''").select("publication_id", "author_pos", F.col("_a.name").alias("name"))


def link_authors(publications: DataFrame, persons: DataFrame, most_edits: int = 1, radius: int = 2, pivots: int = 64) -> DataFrame:
    """``(publication_id, author_pos, person_id)``: one row per author entry without a profile whose name means exactly one person."""
    entries = written(unlinked_authors(publications), "author-entries")
    linked = link_names(entries.select("name"), persons, most_edits, radius, pivots)
    return lookup_join(entries, linked, ["name"], "n").select("publication_id", F.col("author_pos").cast("int").alias("author_pos"), "person_id")
