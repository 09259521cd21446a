"""Formatting-hidden copies, components and grouped splits against brute force, with degenerate inputs."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attestry.llm import near_copies as nc
from attestry.llm import splits
from attestry.llm.components import components
from attestry.llm.queries_records import record_parts

SCHEMA = "row_id bigint, accession string, person_cik string, person_name_raw string, issuer_cik string, issuer_name_raw string, issuer_ticker string, role_class array<string>, title_raw string, title_class string, period date, filed date, loaded_at timestamp, h int, n_rows string"
D = dt.date(2020, 1, 1)


def record(i, **v):
    base = {"accession": "1-2", "person_cik": "7", "person_name_raw": "DOE JANE", "issuer_cik": "9", "issuer_name_raw": "Acme, Inc.", "issuer_ticker": "ACM", "role_class": ["A", "B"], "title_raw": "C.E.O.", "title_class": "CEO", "period": D, "filed": D} | v
    return (i, *[base[c.split()[0]] for c in SCHEMA.split(", ")[1:12]], dt.datetime(2020, 1, 1), 0, "x")


def copies(spark, rows):
    return sorted((r["__keep"], r["__row"]) for r in nc.collapse(spark.createDataFrame(rows, SCHEMA), record_parts(), "row_id")[1].collect())


def test_what_is_a_copy(spark):
    rows = [record(1), record(2, person_name_raw="jane  Doe."), record(3, person_cik="0007 ", issuer_name_raw="ACME INC"), record(4, role_class=["B", "A"]), record(5, title_raw="C E O"), record(6, person_name_raw="DOE JANE X"), record(7, filed=None), record(8, filed=None), record(9, issuer_ticker=None), record(10, issuer_ticker=""), record(11, accession="12")]
    assert copies(spark, rows) == [(1, 2), (1, 3), (1, 4), (1, 11), (7, 8)]


def test_counts_and_singletons(spark):
    df = spark.createDataFrame([record(1), record(2), record(3, title_raw="x"), record(4, person_name_raw=None), record(5, role_class=None), record(6, role_class=None)], SCHEMA)
    assert sorted((r["__keep"], r["n_rows"]) for r in nc.collapse(df, record_parts(), "row_id")[0].collect()) == [(1, 2), (3, 1), (4, 1), (5, 2)]
    records, none = nc.collapse(df.where("false"), record_parts(), "row_id")
    assert records.count() == 0 and none.count() == 0


def test_hot_group_and_long_texts_against_brute_force(spark):
    rng = random.Random(1)
    rows = [record(i, person_name_raw=rng.choice(["A B", "b. a", "c", "C'", "d" * 5000, "D" * 5000]) if i % 3 else "HOT one", title_raw=str(i % 7 if i % 3 else 0)) for i in range(900)]
    canon = lambda r: (tuple(sorted("".join(c for c in r[3].lower() if c not in ".'").split())), r[8])
    groups = defaultdict(list)
    for r in rows:
        groups[canon(r)].append(r[0])
    assert copies(spark, rows) == sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


def test_blocks_of_the_hash_space_give_the_same(spark, monkeypatch):
    rows = [record(i, title_raw=str(i % 150)) for i in range(400)]
    want = copies(spark, rows)
    monkeypatch.setattr(nc, "FILTER_BYTES", 256)
    assert copies(spark, rows) == want and len(want) == 250
    records, _ = nc.collapse(spark.createDataFrame(rows, SCHEMA), record_parts(), "row_id")
    assert records.count() == 150 and records.groupBy().sum("n_rows").first()[0] == 400
    flagged = nc.possible_repeats(spark.createDataFrame(rows, SCHEMA), record_parts(), "row_id")
    assert flagged.count() == 400 and "Exchange" not in flagged._jdf.queryExecution().executedPlan().toString()


def test_a_filter_never_misses_a_repeat(spark, monkeypatch):
    monkeypatch.setattr(nc, "SHARD_BYTES", 64)
    df = spark.range(5000).select((F.col("id") % 4000).alias("h")).select(F.xxhash64("h").alias("h")).repartition(6)
    packed, bits = nc.repeat_filter(df, 5000)
    flagged = df.withColumn("m", nc._maybe(packed, bits, spark)("h"))
    repeated = df.groupBy("h").count().where("count > 1").select("h")
    assert flagged.join(repeated, "h", "left_semi").where("NOT m").count() == 0
    assert flagged.where("NOT m").count() > 2000


def union_find(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 300)
    links = {"random": [(rng.choice(ids), rng.choice(ids)) for _ in range(160)], "chain": list(zip(ids[:-1], ids[1:], strict=True)), "star": [(ids[0], x) for x in ids[1:]], "none": []}[kind]
    df = spark.createDataFrame([*links, *links[:5], (3, 3), (None, 4)], "a bigint, b bigint")
    assert {r["node"]: r["label"] for r in components(df).collect()} == union_find([(a, b) for a, b in links if a != b])


SHARES = [("hillclimb", 15), ("test", 15), ("train", 70)]


def test_quotas_and_allocation_are_whole():
    assert sum(splits.quotas(10, [15, 15, 70])) == 10 and splits.quotas(0, [1]) == [0]
    rng = random.Random(6)
    bundles = [(s, lb, rng.randrange(1, 60)) for s in (1, 2, 3, 5, 40) for lb in ("A", "B")]
    plan = splits.allocate(bundles, [15, 15, 70])
    assert all(sum(plan[s, lb]) == n for s, lb, n in bundles)
    total = sum(s * n for s, _, n in bundles)
    got = [sum(s * plan[s, lb][j] for s, lb, _ in bundles) for j in range(3)]
    assert all(abs(g - total * p / 100) <= 40 for g, p in zip(got, (15, 15, 70), strict=True))


def assigned(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, person bigint, acc string, lb string, size string")
    return {r["row_id"]: r["split"] for r in splits.assign(df, "row_id", "person", "acc", "lb", SHARES).collect()}


def test_related_rows_share_a_split(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(600)]) if i % 50 == 0 else rng.randrange(600), rng.choice([None, f"a{rng.randrange(4000)}"]), rng.choice(["A", "B", None])) for i in range(3000)]
    got = assigned(spark, rows)
    assert len(got) == 3000
    for of in (1, 2):
        seen = defaultdict(set)
        for r in rows:
            if r[of] is not None:
                seen[r[of]].add(got[r[0]])
        assert all(len(s) == 1 for s in seen.values())


def test_shares_are_met_and_repeat(spark):
    rows = [(i, 100_000 + i // 3, None, "AB"[i % 2]) for i in range(4000)]
    a, b = assigned(spark, rows), assigned(spark, rows[::-1])
    share = Counter(a.values())
    assert a == b and abs(share["train"] - 2800) <= 6 and abs(share["test"] - 600) <= 6


def test_bundles_of_several_labels_meet_every_quota():
    rng = random.Random(7)
    bundles, profiles = [], {}
    for s in (1, 2, 3, 4, 7, 11, 30):
        for x in "ABC":
            n = rng.randrange(1, 40)
            own = dict.fromkeys("ABC", 0)
            for _ in range(n * s):
                own[rng.choice("ABC")] += 1
            bundles.append((s, x, n))
            profiles[s, x] = own
    plan = splits.allocate(bundles, [15, 15, 70], profiles)
    assert all(sum(plan[s, x]) == n and min(plan[s, x]) >= 0 for s, x, n in bundles)
    got = [sum(s * plan[s, x][j] for s, x, _ in bundles) for j in range(3)]
    assert all(abs(g - q) <= 2 for g, q in zip(got, splits.quotas(sum(got), [15, 15, 70]), strict=True))
    for lb in "ABC":
        own = [sum(profiles[s, x][lb] * plan[s, x][j] / n for s, x, n in bundles) for j in range(3)]
        assert all(abs(g - q) <= 30 for g, q in zip(own, splits.quotas(round(sum(own)), [15, 15, 70]), strict=True))


def test_labels_are_shared_out_within_a_component(spark):
    rng = random.Random(10)
    rows, i = [], 0
    for person in range(1500):
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((i, person, None, rng.choice("AAABBC")))
            i += 1
    got = assigned(spark, rows)
    for lb in "ABC":
        by = Counter(got[r[0]] for r in rows if r[3] == lb)
        n = sum(by.values())
        assert all(abs(by[s] - n * p / 100) <= 20 for s, p in SHARES)
    by = Counter(got.values())
    assert all(abs(by[s] - len(rows) * p / 100) <= 2 for s, p in SHARES)


def test_giant_component_and_empty_table(spark):
    got = assigned(spark, [(i, 1, None, "A") for i in range(50)] + [(100 + i, 1000 + i, None, "A") for i in range(50)])
    assert len({got[i] for i in range(50)}) == 1
    assert assigned(spark, []) == {}
