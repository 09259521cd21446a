"""Container filling, leaked passages and languages against brute force and held-out texts."""

import random

import numpy as np
import pytest

from attestry.llm import languages as lg
from attestry.llm import leaks as lk
from attestry.llm import packing as pk

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, declared string, seg int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, "clash", 0) for i, t, lang, source in rows], DOCS)


# --- containers ---------------------------------------------------------------------------------------------------


def fewest(sizes, cap):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= sizes[i]:
                go(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_packing_is_whole_and_near_the_optimum():
    rng = random.Random(3)
    extra = 0
    for _ in range(40):
        cap = rng.choice([10, 17, 30])
        sizes = np.array([rng.randrange(1, cap + 1) for _ in range(9)])
        bins = pk.pack(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(9)) and all(sizes[b].sum() <= cap for b in bins)
        assert pk.least_bins(sizes, cap) <= (best := fewest(sizes.tolist(), cap)) <= len(bins)
        extra += len(bins) - best
    assert extra <= 1


def test_local_search_empties_containers():
    sizes, cap = np.array([6, 5, 5, 4]), 10
    loose = [[0], [1], [2, 3]]
    assert len(pk.local_search(sizes, loose, cap)) == 2  # 5 takes the place of 4, then 4 joins 6
    assert len(pk.local_search(np.array([8, 1, 1, 6, 2, 2]), [[0], [1, 2], [3, 4], [5]], cap)) == 2
    squares = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert squares(pk.local_search(sizes, loose, cap)) > squares(loose)


def test_the_search_frees_containers_and_only_raises_squares():
    rng = random.Random(4)
    for cap in (64, 500):
        sizes = np.array([rng.choice([rng.randrange(1, cap + 1), rng.randrange(1, cap // 4)]) for _ in range(1500)])
        start = pk.cheap_fill(sizes, cap)
        got = pk.local_search(sizes, start, cap)
        squares = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
        assert sorted(i for b in got for i in b) == list(range(1500)) and all(sizes[b].sum() <= cap for b in got)
        assert squares(got) > squares(start)
        assert len(start) * 0.9 > len(got) and len(got) <= pk.least_bins(sizes, cap) * 1.01 + 1
    assert len(pk.local_search(np.full(500, 6), pk.cheap_fill(np.full(500, 6), 10), 10)) == 500


def test_rounds_over_groups_end(spark):
    d = docs(spark, [(i, "word " * 30, "en", "s") for i in range(200)])
    n = pk.token_counts(d).first()["n_tokens"]
    windows = spark.createDataFrame([(1, n + n // 2), (2, 3 * n)], "window_id bigint, capacity_tokens int")
    got = {r["window_id"]: (r["start_containers"], r["n_containers"]) for r in pk.waste(pk.fill_containers(d, windows, group_items=16)).collect()}
    assert got[1] == (200, 200) and got[2][1] == 67 and got[2][0] > 67


def test_containers_hold_whole_texts(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randrange(0, 60), "en", "s") for i in range(300)] + [(900, None, None, None), (901, "", None, None), (902, "long " * 500, "en", "s")]
    windows = spark.createDataFrame([(1, 32), (2, 200), (3, None), (4, 0)], "window_id bigint, capacity_tokens int")
    d = docs(spark, rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in pk.token_counts(d).collect()}
    placed = pk.fill_containers(d, windows, group_items=64).collect()
    assert {r["window_id"] for r in placed} == {1, 2} and counts[900] == counts[901] == 0
    for w, cap in ((1, 32), (2, 200)):
        own = [r for r in placed if r["window_id"] == w]
        by_doc, by_box = {}, {}
        for r in own:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_box.setdefault(r["container"], []).append(r["n_tokens"])
        assert {k: sum(r["n_tokens"] for r in v) for k, v in by_doc.items()} == {k: v for k, v in counts.items() if v}
        assert all(len(v) == 1 for k, v in by_doc.items() if counts[k] <= cap) and all(sum(v) <= cap for v in by_box.values())
        assert len(by_box) <= sum(counts.values()) / cap * 1.06 + 3
    assert all(r["least_containers"] <= r["n_containers"] for r in pk.waste(pk.fill_containers(d, windows)).collect())
    assert pk.fill_containers(d.where("false"), windows).count() == 0
    assert pk.fill_containers(d, windows.where("false")).count() == 0


# --- leaks --------------------------------------------------------------------------------------------------------

WORDS = [f"w{c}{v}" for c in "bcdfgh" for v in "aeiou"]


def brute(rows, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [lk.words(t)] for i in range(len(w) - n + 1)}
    held = {i: grams(t) for i, t in items}
    return {(d, i) for d, t, *_ in rows for i, g in held.items() if grams(t) & g}


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    rows = []
    for i in range(150):
        base = [rng.choice(WORDS) for _ in range(40)]
        if i % 3 == 0:
            w = lk.words(items[i % 12][1])
            k, at = rng.choice([8, 11, 12, 13, 20]), rng.randrange(0, 10)
            base[5:5] = w[at : at + k]
        rows.append((i, rng.choice([" ", ", ", "\n> ", " - "]).join(x.upper() if i % 2 else x for x in base), "en", None))
    rows += [(900, None, None, None), (901, "", None, None), (902, items[0][1] + " x" * 50_000, None, None)]
    d = docs(spark, rows)
    it = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, doc_id int")
    got = lk.leaks(d, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute([(a, b) for a, b, *_ in rows], items, 12)
    texts, held = {a: b for a, b, *_ in rows}, dict(items)
    for r in got:
        text, item = lk.words(texts[r["doc_id"]]), lk.words(held[r["item_id"]])
        assert text[r["doc_at"] : r["doc_at"] + r["n_words"]] == item[r["item_at"] : r["item_at"] + r["n_words"]] and r["n_words"] >= 12
    assert lk.leaks(d.where("false"), it).count() == 0 and lk.leaks(d, it.where("false")).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"k{i}x{j}" for j in range(20))) for i in range(6)], "item_id bigint, text string")
    d = docs(spark, [(i, " ".join(f"k{i % 6}x{j}" for j in range(3, 17)), None, None) for i in range(12)])
    want = {(i, i % 6) for i in range(12)}
    monkeypatch.setattr(lk, "BLOCK_CHARS", 200)
    assert {(r["doc_id"], r["item_id"]) for r in lk.leaks(d, items).collect()} == want


def test_a_word_repeated_and_a_passage_in_a_third_of_all(spark):
    items = spark.createDataFrame([(1, "la " * 30)], "item_id bigint, text string")
    d = docs(spark, [(i, "la " * (11 + i % 3), None, None) for i in range(90)])
    assert {r["doc_id"] for r in lk.leaks(d, items).collect()} == {i for i in range(90) if i % 3}


def test_shingles_are_ranked_by_all_documents(spark, monkeypatch):
    ranked, choose = [], lk.ItemIndex.choose

    def spy(index, frequency):
        choose(index, frequency)
        ranked.append((index, frequency))

    monkeypatch.setattr(lk.ItemIndex, "choose", spy)
    item = [f"q{j}" for j in range(12)]
    # all of 45,000 documents hold the item's first ten words, every third twice; one holds the last eleven
    base = f"repeat(concat({' '.join(item[:10])!r}, ' , '), if(id % 3 = 0, 2, 1))"
    d = spark.range(45_000).selectExpr("id AS doc_id", f"if(id = 7, {' '.join(item[1:])!r}, {base}) AS text")
    d = d.unionByName(spark.createDataFrame([(None, None), (1, ""), (None, " ".join(item))], "doc_id bigint, text string"))
    items = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id bigint, text string")
    assert [(r["doc_id"], r["n_words"]) for r in lk.leaks(d, items).collect()] == [(None, 12)]
    index, frequency = ranked[-1]
    ids = np.array([index.word_ids[w] for w in item], np.uint32)
    places = np.searchsorted(index.keys, lk.shingle_keys(ids)[1]).tolist()
    assert [frequency[k] for k in places] == [45_000, *[45_001] * 5, 2, 2]
    assert index.entries[:, 1].tolist() in ([6], [7])


# --- languages ----------------------------------------------------------------------------------------------------

STOCK = {
    "de": ["Der Vorstand hat den Bericht am Montag geprüft und für richtig befunden.", "Wir konnten nicht bestätigen, ob die Firma noch für den Kunden arbeitet.", "Die meldende Person bestreitet das Eigentum an den Anteilen der Stiftung."],
    "en": ["The board checked the report on Monday and found that it was right.", "We could not confirm whether the company still works for the customer.", "The reporting person does not claim ownership of the shares of the trust."],
    "es": ["El consejo revisó el informe el lunes y encontró que era correcto.", "No pudimos confirmar si la empresa todavía trabaja para el cliente.", "La persona declarante niega ser dueña de las acciones del fideicomiso."],
    "fr": ["Le conseil a vérifié le rapport lundi et il a trouvé que tout était juste.", "Nous n'avons pas pu confirmer que la société travaille encore pour le client.", "Le déclarant n'est pas le propriétaire des actions de la fiducie."],
    "sv": ["Styrelsen granskade rapporten på måndagen och fann att den var riktig.", "Vi kunde inte bekräfta om bolaget fortfarande arbetar för kunden.", "Den rapporterande personen är inte ägare till aktierna i stiftelsen."],
}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        k = rng.choice([*STOCK])
        label = k if i % 10 else rng.choice([*STOCK])
        rows.append((i, " ".join(rng.choice(STOCK[k]) for _ in range(4)), rng.choice([label, label.upper(), f"{label}-XX", lg.NAMES[label][0]]), f"feed-{i % 5}.{k}"))
    return rows


def test_spelling_of_labels(spark):
    d = docs(spark, [(1, "", "EN-us", None), (2, "", "Swedish", None), (3, "", "und", None), (4, "", None, None), (5, "", "klingon", None), (6, "", "  ", None), (7, "", "fra", None)])
    got = d.select("doc_id", lg.declared_language("lang").alias("k"), lg.no_label("lang").alias("m")).orderBy("doc_id").collect()
    assert [(r["k"], r["m"]) for r in got] == [("en", False), ("sv", False), (None, True), (None, True), (None, False), (None, True), ("fr", False)]


def test_held_out_texts(spark, corpus):
    d = docs(spark, corpus + [
        (1000, STOCK["de"][0], None, None), (1001, " ".join(STOCK["en"]), "de", "feed-1.de"), (1002, STOCK["fr"][1] + "\n\n" + STOCK["es"][1], "fr", "feed-1.fr"), (1003, " ".join(STOCK["sv"]).upper(), "sv", "feed-1.sv"),
        (1004, STOCK["en"][0] + " („Technik“, ACME INC)", "en", "feed-1.en"), (1005, STOCK["fr"][0].replace("é", "e"), "und", "x"), (1006, None, "en", "x"), (1007, "", None, None), (1008, "12 34 !!", "en", None), (1009, (" ".join(STOCK["de"]) + " ") * 400, "DE", "y"),
    ])
    segs = lg.segments(d)
    found = {(r["doc_id"], r["lang"]) for r in lg.unsound(segs).collect() if r["doc_id"] >= 1000}
    assert found == {(1000, "de"), (1001, "en"), (1002, "fr"), (1002, "es"), (1005, "fr")}
    seg = sorted((r["seg"], r["lang"], r["confidence"] > 0.95) for r in segs.where("doc_id = 1002").collect())
    assert seg == [(0, "fr", True), (1, "es", True)]
    per = {r["doc_id"]: (r["lang"], r["label"]) for r in lg.documents(segs).collect()}
    assert per[1001] == ("en", "wrong") and per[1003] == ("sv", "right") and per[1000] == ("de", "missing") and len(per) == 310


def test_wrong_labels_wash_out(corpus):
    model = lg.fit([(lg.sentence_words(t), [*STOCK][i // 10 % len(STOCK)] if i % 10 == 0 else s.split(".")[1]) for i, t, _, s in corpus])
    for k, texts in STOCK.items():
        scores, known = model.score([lg.unit_words(x) for x in texts])
        assert all(lg.LANGS[j] == k for j in scores.argmax(axis=1)) and (known >= 2).all()


def test_a_small_language_does_not_claim_what_passages_speak_of():
    rng = random.Random(6)
    nouns = [f"{a}{b}{c}" for a in ("ob", "jig", "kil", "lant", "ferr") for b in ("ar", "en", "ist", "om") for c in "aeiou"]
    passages = [f"The {a} checked the {b} and found that {c} was right and the {d} does not claim ownership of the {e}." for a, b, c, d, e in (rng.sample(nouns, 5) for _ in range(60))]
    sample = [(" ".join(rng.choice(STOCK["en"]) for _ in range(4)), "en") for _ in range(4000)]
    sample += [(" ".join(rng.choice(STOCK["sv"]) for _ in range(4)) + (" " + rng.choice(passages) if i % 4 == 0 else ""), "sv") for i in range(600)]
    model = lg.fit([(lg.sentence_words(t), k) for t, k in sample])
    assert all(lg.LANGS[j] == "en" for j in model.score([lg.unit_words(x) for x in passages])[0].argmax(axis=1))
    assert all(lg.LANGS[j] == "sv" for j in model.score([lg.unit_words(x) for x in STOCK["sv"]])[0].argmax(axis=1))


def test_sources_are_smoothed(spark):
    ready = lg.prepared(docs(spark, [(i, "x", "de", "hot.de") for i in range(200)] + [(300 + i, "x", "fr", "a.de") for i in range(2)] + [(400, "x", None, None)]))
    shares = {r["__source"]: np.exp(r["share"]) for r in lg.host_shares(ready).collect()}
    de, fr = lg.LANGS.index("de"), lg.LANGS.index("fr")
    assert shares["hot.de"][de] > 0.9 and shares["a.de"][de] > shares["a.de"][fr] > shares["hot.de"][fr] and all(abs(s.sum() - 1) < 1e-9 for s in shares.values())


def test_empty_corpus(spark):
    segs = lg.segments(docs(spark, []))
    assert segs.count() == 0 and lg.unsound(segs).count() == 0


def test_sentences():
    text = "Am 23. März kam Q. Smith. Dann ging er! Ja?\nNeu"
    assert [text[a:b].strip() for a, b in lg.units(text)] == ["Am 23. März kam Q. Smith.", "Dann ging er!", "Ja?", "Neu"]
    assert lg.unit_words("Er („Technik“) ging") == ["er", "ging"]


def test_a_change_of_language_inside_a_unit(spark, corpus):
    cut_off = lambda k, i: STOCK[k][i].rstrip(".")
    run_on = lambda k: ", ".join(x.rstrip(".") for x in STOCK[k] * 2)
    d = docs(spark, corpus + [(1000, cut_off("en", 0) + "… " + STOCK["de"][1], "de", "feed-1.de"), (1001, run_on("de") + " vom 26. " + run_on("en").upper(), "de", "feed-1.de"), (1002, run_on("fr") + " " + run_on("es"), "fr", "feed-1.fr"), (1003, STOCK["de"][0] + " „The Company“ " + STOCK["de"][1], "de", "feed-1.de")])
    segs = lg.segments(d).where("doc_id >= 1000")
    found = {(r["doc_id"], r["lang"]) for r in lg.unsound(segs).collect()}
    assert found == {(1000, "de"), (1000, "en"), (1001, "de"), (1001, "en"), (1002, "fr"), (1002, "es")}
    for doc, text, *_ in d.where("doc_id >= 1000").collect():
        own = sorted((r["start"], r["stop"]) for r in segs.where(f"doc_id = {doc}").collect())
        assert own[0][0] == 0 and own[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(own[:-1], own[1:], strict=True))
