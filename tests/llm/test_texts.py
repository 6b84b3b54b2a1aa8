import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.llm.leaks import find_leaks, leak_report, myers, pieces
from skarn.llm.mixing import PLAN as MIX, bisect_exponent, entropy, mix_plan, plan_mix, reached, realise, tempered, token_counts
from skarn.llm.residue import Detector, find_residue, without_residue

def _semi(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=14))
def test_bit_parallel_distance(p, t):
    assert myers(p, t) == _semi(p, t)


@given(st.text(min_size=1, max_size=40), st.integers(0, 5))
def test_pieces_cover(p, k):
    assert "".join(x for _, x in pieces(p, k)) == p and len(pieces(p, k)) <= k + 1


def _case(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve", "t"), (2, "Too short to count", "t"), (3, "one two three four five six seven eight nine ten and other words", "t"), (4, None, "t"), (5, "zero " * 12, None)]
    docs = [(10, "Before. ONE, two-three four; five six seven eight nine TEN! after"), (11, "one two three four five six seven eight nine"), (12, "two three four five six seven eight nine ten eleven"), (13, None), (14, ""), (15, "w " * 9000 + "zero\nzero " * 6),
            (16, "one two three four five sx seven eight nine tenn"), (17, "xone two three four five six seven eight nine ten"), (10, "Before. one two three four five six seven eight nine ten")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string, task string")


@pytest.mark.parametrize("block", [1, 10**6])
def test_leaks(spark, block):
    docs, items = _case(spark)
    got = find_leaks(docs, items, block_chars=block)
    assert {tuple(r) for r in got.collect()} == {(10, 1), (10, 3), (12, 1), (15, 5)} and got.count() == 4
    assert {(16, 1), (16, 3), (17, 1), (10, 1)} <= {tuple(r) for r in find_leaks(docs, items, edits=2, block_chars=block).collect()}
    assert {r.item_id: r.documents for r in leak_report(got, items).collect()} == {1: 2, 2: 0, 3: 1, 4: 0, 5: 1}
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(3)
    item = " ".join(f"word{i}" for i in range(10))
    texts = []
    for i in range(60):
        t = list(item)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("abc")
        texts.append((i, "pre " + "".join(t) + " post"))
    items = spark.createDataFrame([(1, item, "t")], "item_id long, text string, task string")
    got = {r.doc_id for r in find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), items, edits=3).collect()}
    assert got == {i for i, t in texts if _semi(f" {item} ", f" {t} ") <= 3}


def test_exponent():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    for want in (0.5, 0.8, 1.05):
        assert entropy(list(tempered(sizes, bisect_exponent(sizes, want)).values())) == pytest.approx(want, abs=1e-9) or want < entropy(list(tempered(sizes, 1).values()))
    e = bisect_exponent(sizes, repeats={s: 2.0 for s in sizes})
    shares = tempered(sizes, e)
    assert all(shares[s] * 1110 <= 2 * sizes[s] * (1 + 1e-9) for s in sizes) and any(shares[s] * 1110 > 1.999 * sizes[s] for s in sizes)
    assert tempered({}, 1) == {} and tempered({"a": 0.0}, 0)["a"] == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 10**6), st.floats(0, 100), st.integers(1, 5)), max_size=6))
def test_plan(case):
    sizes, weights, repeats = ({s: x[i] for s, x in case.items()} for i in range(3))
    for w in (weights, None):
        rows = plan_mix(sizes, w, repeats)
        budget = sum(n for n, _, _ in case.values())
        total = sum(weights.values())
        assert sum(r["tokens"] for r in rows) <= budget + len(rows)
        if w is None or total:
            full = all(r["tokens"] >= case[r["source"]][0] * case[r["source"]][2] - 1 for r in rows)
            assert full or sum(r["tokens"] for r in rows) >= budget - len(rows)
        for r in rows:
            n, _, k = case[r["source"]]
            assert r["tokens"] <= n * k + 1 and r["limited"] == (n * k < r["target_share"] * budget) and (r["limited"] or r["tokens"] >= int(r["target_share"] * budget) - 1)


def test_the_exponent_makes_the_mix(monkeypatch):
    """What limited sources leave over is mixed by the bisected temperature, and so is a mix without weights."""
    from skarn.llm import mixing

    sizes, weights, repeats = {"a": 100_000, "b": 20_000, "c": 1000}, {"a": 2.0, "b": 1.0, "c": 7.0}, {"a": 5, "b": 5, "c": 2}
    rows = {r["source"]: r for r in plan_mix(sizes, weights, repeats)}
    rest = 121_000 - 2000 - 0.3 * 121_000
    shares = tempered({s: float(sizes[s]) for s in "ab"}, rows["a"]["exponent"])
    assert rows["c"]["limited"] and rows["c"]["tokens"] == 2000 and 0 < rows["a"]["exponent"] < 1
    assert entropy(list(tempered({s: float(n) for s, n in sizes.items()}, rows["a"]["exponent"]).values())) == pytest.approx(entropy([0.2, 0.1, 0.7]))
    assert [rows[s]["tokens"] for s in "ab"] == [round(t * 121_000 + shares[s] * rest) for s, t in zip("ab", (0.2, 0.1))]
    alone = {r["source"]: r["repeats"] for r in plan_mix(sizes, None, repeats)}
    assert alone["c"] == pytest.approx(2) and alone["a"] < alone["b"] < alone["c"]
    for e in (0.0, 1.0):
        monkeypatch.setattr(mixing, "bisect_exponent", lambda *_, e=e: e)
        assert {r["source"]: r["tokens"] for r in plan_mix(sizes, weights, repeats)} != {s: r["tokens"] for s, r in rows.items()}
        assert {r["source"]: r["repeats"] for r in plan_mix(sizes, None, repeats)} != alone


def test_mix(spark):
    docs = [(i, f"Some words of text {i} " * (i % 4 + 1), s) for i, s in enumerate([" Big_Source", "big-source", "BIG SOURCE"] * 60 + ["small"] * 10 + [None, "other"])] + [(900, None, "small"), (901, "", "small")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"tokens": F.lit(0), "copies": F.lit(0)})
    targets = spark.createDataFrame([("Big source", 1.0, 2), ("small", 1.0, 3), ("absent", 2.0, 1), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    counts = token_counts(d).cache()
    plan = {r.source: r for r in mix_plan(counts, targets).collect()}
    assert set(plan) == {"big-source", "small", "absent"} and plan["absent"].limited and plan["small"].limited and not plan["big-source"].limited
    assert plan["small"].repeats == 3 and plan["absent"].tokens == 0
    mix = realise(counts, mix_plan(counts, targets), blocks=8)
    got = {r.source: (r.t, r.most) for r in mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("most")).collect()}
    assert got["small"] == (plan["small"].tokens, 3) and got["big-source"][1] <= 2 and 0 <= plan["big-source"].tokens - got["big-source"][0] < 60
    assert mix_plan(counts.limit(0), targets).count() == 3 and realise(counts.limit(0), mix_plan(counts.limit(0), targets)).count() == 0 and mix_plan(counts, targets.limit(0)).count() == 0


RESIDUE = {"placeholder": ["Dear {{name}},", "About {{ pub_year }} more", "In #{city} we", "By ${org}.", "is <%= page.heading %> here", "<<first_name>> said", "on @@event_date@@ we", "%%title%%", "__summary__ of it", "XXX_CITY_XXX", "[INSERT AUTHOR NAME HERE]", "[Your project]", "{contact_email}", "{% city %}", "[[pub_year]]"],
           "filler": ["Fine words. Lorem ipsum dolor sit amet consectetur sed."], "error": ["404 Not Found", "Error 503: Service temporarily unavailable. Please try again later.", "Fine words.\n\nError 410 – gone", "The page you requested cannot be displayed.", "Accès refusé. Référence 7.", "Seite nicht gefunden (404).", "La página solicitada no existe – código 404.", "Session expired. Log in again to see this content.", "Traceback (most recent call last):\n  File \"view.py\", line 3"],
           "script": ["Please enable JavaScript to continue using this site.", "Veuillez activer JavaScript pour afficher cette page.", "Bitte aktivieren Sie Skripte in Ihrem Browser ein.", "Debe habilitar los scripts para continuar.", "Your browser has scripts switched off."],
           "stand-in": ["TODO: add text here", "TBD - summary to follow", "Content goes here.", "Click to edit this text", "Replace this paragraph with your own words."]}
CLEAN = ["Many leaflets still told people to switch on JavaScript before booking.", "Designers pasted lorem ipsum text into early mock-ups, and staff found it confusing.", "Access denied was the phrase carers heard most at the front desk.", "An internal server error lost one day of diary entries, later restored.",
         "The set {a, b, c} and the pair [first, second] were scored by hand.", "Curly braces such as {x} stood for unknown amounts.", "Prices were quoted as $40 and %50 by mistake.", "The team counted how often a 404 page greeted readers of the portal.", "Define wool grading in your own words.", "It is gone.", "", None, "x " * 50000]


#: Held out: written after the word lists, in other words than the tables use.
HELD_OUT = ["Access to this resource on the server is denied!", "We couldn't find that page", "Error 502 - Proxy Error: the upstream host sent an invalid reply.", "Insert abstract here", "Dear {{ user.name|default('x') }}, welcome", "Curabitur pretium tincidunt lacus, nulla gravida orci a odio, nullam varius turpis et commodo pharetra.",
            "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium", "HTTP Error 500: Internal Server Error", "The requested URL was not found on this server.", "Your session has timed out. Please sign in to continue.", "Sorry, this file is no longer available.",
            "JavaScript is disabled in your browser.", "This site requires JavaScript to work properly.", "Cookies must be enabled to continue.", "Add a title", "Type your text here", "TODO: write summary", "Diese Seite konnte nicht gefunden werden.", "Die Verbindung zur Datenbank ist fehlgeschlagen.",
            "JavaScript muss aktiviert sein.", "Hier steht eine Zusammenfassung", "Cette page n'existe plus.", "Impossible de charger le contenu demandé.", "JavaScript est requis pour utiliser ce site.", "Saisir le titre ici", "No se encontró la página solicitada.", "Se ha producido un error en el servidor. Inténtelo más tarde.",
            "Este sitio requiere JavaScript.", "Insertar resumen aquí", "Fatal error: connection refused", "{% block content %}", "Welcome to ${site.title}", "502 Bad Gateway", "This page is under construction", "Are you a robot? Please verify you are human.", "Exception: null pointer", "Page not available (error 410)", "Servicio no disponible",
            "Your IP address has been blocked.", "Bitte melden Sie sich an, um diesen Inhalt zu sehen."]
HELD_CLEAN = ["Patients said the record does not exist. We asked again a month later and entered what they told us.", "We compared three browsers. Scripts and cookies. All were cleared before each session of the trial.", "Access to dental care was denied to a third of the families we visited last winter.",
              "The server at the restaurant brought the wrong order, and nobody complained.", "Missing values were replaced by the median of the ward.", "Children were asked to write a summary of the story in their own words and to add a title.", "Das Projekt wurde nicht verlängert, weil die Mittel fehlten.", "Le service de cardiologie n'est pas ouvert la nuit.",
              "El acceso a la vivienda fue denegado a muchas familias jóvenes.", "Errors in the dose were found in nine of forty charts.", "Lorem ipsum was the only text designers had in the first draft of the leaflet.", "Staphylococcus aureus and Escherichia coli were cultured from both wounds.", "The committee could not find a quorum and met again on Friday.",
              "In 404 households the page of the diary for that week was empty.", "The bridge is under construction until spring, so buses take the old road.", "The form used {a, b} for pairs and [insert] keys were worn out.", "Connection to nature was lower among teenagers, who spent the evenings online.", "Nurses must enable patients to decide for themselves.",
              "A request for asylum is refused in half of the cases, the court found.", "Gateway drugs are discussed again in many schools.", "No content was censored in the archive of the newspaper.", "The host was not available for interview, but sent a reply by letter.", "Session three was missing from the minutes, and the chair has expired his term.",
              "JavaScript courses for older adults were popular with widowed men.", "Text here and there was crossed out by the editor.", "What follows is a description of the content of the section on wages."]


def test_held_out_residue():
    d = Detector()
    found = [t for t in HELD_OUT if d.kind(t)]
    wrong = [t for t in HELD_CLEAN if d.kind(t)]
    print("missed", [t for t in HELD_OUT if t not in found], "wrong", wrong)
    assert len(found) >= 0.9 * len(HELD_OUT) and len(found) >= 0.9 * (len(found) + len(wrong))


def test_residue_kinds():
    d = Detector()
    for kind, texts in RESIDUE.items():
        assert [(t, d.kind(t)) for t in texts] == [(t, kind) for t in texts]
    assert [t for t in CLEAN if d.kind(t)] == []


def test_residue_table(spark):
    texts = [t for x in RESIDUE.values() for t in x] + CLEAN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("own"))
    assert {r.doc_id for r in find_residue(docs).collect()} == set(range(len(texts) - len(CLEAN)))
    kept = without_residue(docs)
    assert kept.columns == docs.columns and kept.count() == len(CLEAN) and find_residue(docs.limit(0)).count() == 0


def test_shares_are_measured_and_only_what_does_not_fit_is_skipped(spark):
    counts = spark.createDataFrame([(i, "a", 10) for i in range(50)] + [(99, "a", 400)], "doc_id long, source string, tokens long")
    for want in (100, 250, 390):
        plan = spark.createDataFrame([("a", 900, 1.0, True, want, want / 900, want / 900, 1.0)], MIX)
        for seed in range(3):
            assert realise(counts, plan, blocks=1, seed=seed).agg(F.sum("tokens")).first()[0] == want
    plan = spark.createDataFrame([("a", 900, 1.0, True, 105, 105 / 900, 105 / 900, 1.0)], MIX)
    got = reached(counts, plan).first()
    mix = realise(counts, plan).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert got.tokens == mix and mix < 105 and got.reached_share == 1 and got.repeats == mix / 900
