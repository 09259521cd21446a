"""Satellites: versions, corrections, ties, late loads, views and as-of lookups."""

import datetime as dt

from attestry.operators import history as h

SCHEMA = "person bigint, period date, filed date, acc string, issuer bigint, extra string"


def day(n):
    return dt.date(2020, 1, n) if n else None


def frame(spark, rows):
    return spark.createDataFrame([(p, day(t), day(f), a, i, "x") for p, t, f, a, i in rows], SCHEMA)


def versions(spark, rows, least=1):
    snap = h.latest_per_period(frame(spark, rows), "person", "period", ["filed", "acc", "issuer"], ["issuer"])
    view = h.history_view(h.satellite(snap, "person", "period", ["issuer"]), "person", least)
    return sorted((r["person"], r["valid_from"].day, r["valid_to"].day if r["valid_to"] else None, r["issuer"]) for r in view.collect())


def test_versions_returns_and_corrections(spark):
    rows = [(1, 1, 1, "a", 10), (1, 2, 2, "a", 10), (1, 3, 3, "a", 20), (1, 4, 4, "a", 10), (1, 3, 5, "b", 30), (1, 3, 5, "a", 40), (2, 9, 9, "z", 5)]
    assert versions(spark, rows) == [(1, 1, 3, 10), (1, 3, 4, 30), (1, 4, None, 10), (2, 9, None, 5)]
    assert versions(spark, rows, 2) == [(1, 1, 3, 10), (1, 3, 4, 30), (1, 4, None, 10)]


def test_ties_go_to_the_larger_issuer_and_nulls_lose(spark):
    assert versions(spark, [(1, 1, 2, "a", 3), (1, 1, 2, "a", 7), (1, 1, None, "z", 9)]) == [(1, 1, None, 7)]


def test_nulls_repeats_and_empty(spark):
    assert versions(spark, [(None, 1, 1, "a", 1), (1, None, 1, "a", 1)]) == []
    assert versions(spark, [(1, 1, 1, "a", 1)] * 4) == [(1, 1, None, 1)]
    assert versions(spark, []) == []


def test_null_is_a_value_of_its_own(spark):
    snap = spark.createDataFrame([(1, day(1), None, "a"), (1, day(2), "", "a"), (1, day(3), "", "a"), (1, day(4), None, "a")], "person bigint, period date, t string, u string")
    assert h.satellite(snap, "person", "period", ["t", "u"]).count() == 3


def test_append_adds_what_a_rebuild_has(spark):
    first, later = [(1, 1, 1, "a", 10), (1, 2, 2, "a", 10), (2, 1, 1, "a", 1)], [(1, 5, 5, "a", 10), (1, 6, 6, "a", 20), (3, 6, 6, "a", 9)]
    snap = lambda rows: h.latest_per_period(frame(spark, rows), "person", "period", ["filed", "acc", "issuer"], ["issuer"])
    stored = h.satellite(snap(first), "person", "period", ["issuer"])
    grown = stored.unionByName(h.append(stored, snap(later), "person", "period", ["issuer"]))
    key = lambda df: sorted((r["person"], r["valid_from"], r["issuer"]) for r in df.collect())
    assert key(grown) == key(h.satellite(snap(first + later), "person", "period", ["issuer"]))


def test_change_rates_split_attributes(spark):
    snap = spark.createDataFrame([(1, day(i), 5, i) for i in range(1, 11)], "person bigint, period date, slow int, fast int")
    rates = {r["attribute"]: r["change_rate"] for r in h.change_rates(snap, "person", "period", ["slow", "fast"]).collect()}
    assert rates == {"slow": 0.0, "fast": 1.0}
    assert h.split_by_rate(list(rates.items())) == [["slow"], ["fast"]]
    assert {r["change_rate"] for r in h.change_rates(snap.where("false"), "person", "period", ["slow"]).collect()} == {0.0}


def test_as_of(spark):
    view = h.history_view(h.satellite(h.latest_per_period(frame(spark, [(1, 3, 3, "a", 10), (1, 6, 6, "a", 20)]), "person", "period", ["filed"], ["issuer"]), "person", "period", ["issuer"]), "person")
    facts = spark.createDataFrame([(i, 1, day(i), "keep") for i in (1, 3, 5, 6, 20)] + [(99, 2, day(5), "keep")], "id bigint, who bigint, at date, issuer string")
    got = {r["id"]: r["then"] for r in h.as_of(facts, "who", "at", view, "person", {"issuer": "then"}).collect()}
    assert got == {1: None, 3: 10, 5: 10, 6: 20, 20: 20, 99: None}


def test_batches_give_the_full_build(spark):
    import random

    rng = random.Random(4)
    rows = [(p, rng.randrange(1, 28), rng.randrange(1, 28), rng.choice("abc"), rng.randrange(3)) for p in range(40) for _ in range(rng.randrange(1, 12))]
    snap = h.latest_per_period(frame(spark, rows), "person", "period", ["filed", "acc", "issuer"], ["issuer"])
    key = lambda df: sorted((r["person"], r["valid_from"], r["issuer"], r["hash_diff"]) for r in df.collect())
    full = key(h.satellite(snap, "person", "period", ["issuer"]))
    for edges in ([], [day(9)], [day(5), day(6), day(20)], [day(1)]):
        assert key(h.load(snap, "person", "period", ["issuer"], edges)) == full
    assert key(h.load(snap.where("false"), "person", "period", ["issuer"], [day(9)])) == []


def test_a_satellite_is_narrowed(spark):
    snap = spark.createDataFrame([(1, day(1), 5, "a"), (1, day(2), 5, "b"), (1, day(3), 6, "b"), (1, day(4), 6, None)], "person bigint, period date, issuer bigint, extra string")
    both = h.satellite(snap, "person", "period", ["issuer", "extra"])
    assert both.count() == 4
    assert [(r["valid_from"].day, r["issuer"]) for r in h.narrowed(both, "person", ["issuer"]).orderBy("valid_from").collect()] == [(1, 5), (3, 6)]
