"""Orphans: validity in time, reasons, the cascade to a fixpoint, degenerate inputs."""

import datetime as dt

from pyspark.sql import functions as F

from attestry.functions.keys import digits
from attestry.operators.orphans import Edge, Graph, Node, direct_orphans, orphan_cascade, orphan_report


def at(day):
    return dt.datetime(2020, 1, day) if day else None


CHILD, PARENT = "id bigint, acc string, at timestamp_ntz, kind string", "acc string, a timestamp_ntz, w timestamp_ntz, kind string"


def graph(spark, children, parents):
    c = spark.createDataFrame([(i, a, at(t), "x") for i, a, t in children], CHILD)
    p = spark.createDataFrame([(a, at(f), at(u), "y") for a, f, u in parents], PARENT)
    nodes = {"c": Node("c", c, "id", F.lit("q"), "at"), "p": Node("p", p, "acc", F.lit("q"))}
    return Graph(nodes, [Edge("c", digits("acc"), "p", digits("acc"), ("a", "w"))])


def found(spark, children, parents):
    return {(int(r["row_id"]), r["reason"]) for r in orphan_cascade(graph(spark, children, parents)).collect()}


def test_reasons(spark):
    parents = [("1-1", 5, None), ("2", 5, 10), ("2", 12, 15), ("3", 9, None), ("3", 2, 4)]
    children = [(1, "11", 5), (2, "11", 4), (3, "9", 5), (4, None, 5), (5, " ", 5), (6, "2", 10), (7, "2", 13), (8, "2", 9), (9, "3", 5), (10, "3", 9), (11, "3", 3), (12, "2", 20)]
    want = {(2, "came_later"), (3, "never_came"), (4, "no_key"), (5, "no_key"), (6, "withdrawn"), (9, "withdrawn"), (12, "withdrawn")}
    assert found(spark, children, parents) == want


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    parents = [(str(rng.randrange(12)), (a := rng.randrange(1, 20)), rng.choice([None, a, min(28, a + rng.randrange(0, 8))])) for _ in range(60)]
    children = [(i, rng.choice([None, *map(str, range(14))]), rng.randrange(1, 28)) for i in range(200)]
    live = {i for i, k, t in children if any(k == a and f <= t and (u is None or u > t) for a, f, u in parents)}
    assert {i for i, _ in found(spark, children, parents)} == {i for i, _, _ in children} - live


def test_repeats_and_empty_tables(spark):
    assert found(spark, [], [("1", 1, None)]) == set()
    assert found(spark, [(1, "1", 1), (2, None, 1)], []) == {(1, "never_came"), (2, "no_key")}
    assert found(spark, [(1, "1", 1)], [("1", 1, None)] * 3) == set()
    assert found(spark, [(1, "1", None), (2, "2", None)], [("1", 9, None)]) == {(1, "no_time"), (2, "never_came")}


def test_hot_key(spark):
    parents = [("7", d, d + 1) for d in range(1, 27)]
    children = [(i, "7", 1 + i % 27) for i in range(2700)]
    assert {i for i, _ in found(spark, children, parents)} == {i for i in range(2700) if 1 + i % 27 == 27}


def test_cascade_reports_direct_and_inherited(spark):
    a = spark.createDataFrame([(1, "k1"), (2, "gone")], "id bigint, up string")
    b = spark.createDataFrame([(10, 1), (20, 2), (30, 99)], "id bigint, up bigint")
    c = spark.createDataFrame([(100, 20), (200, 10), (300, 30)], "id bigint, up bigint")
    root = spark.createDataFrame([("k1",)], "id string")
    node = lambda n, df: Node(n, df, "id", F.lit("2020q1"))
    s = lambda x: F.col(x).cast("string")
    g = Graph({"root": node("root", root), "a": node("a", a), "b": node("b", b), "c": node("c", c)}, [Edge("c", s("up"), "b", s("id")), Edge("b", s("up"), "a", s("id")), Edge("a", s("up"), "root", s("id"))])
    got = {(r["table_name"], r["row_id"], r["kind"]) for r in orphan_cascade(g).collect()}
    assert got == {("a", "2", "direct"), ("b", "30", "direct"), ("b", "20", "inherited"), ("c", "100", "inherited"), ("c", "300", "inherited")}
    assert {(r["table_name"], r["kind"]): r["n_rows"] for r in orphan_report(orphan_cascade(g)).collect()} == {("a", "direct"): 1, ("b", "direct"): 1, ("b", "inherited"): 1, ("c", "inherited"): 2}


def test_cycle_reaches_a_fixpoint(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 77), (5, 4), (6, 5)], "id bigint, up bigint").withColumn("up", F.coalesce("up", "id"))
    g = Graph({"t": Node("t", t, "id", F.lit("q"))}, [Edge("t", F.col("up").cast("string"), "t", F.col("id").cast("string"))])
    assert g.depth() is None
    assert {(r["row_id"], r["kind"]) for r in orphan_cascade(g).collect()} == {("4", "direct"), ("5", "inherited"), ("6", "inherited")}


def test_direct_edge_without_validity(spark):
    g = graph(spark, [(1, "1", 1), (2, "2", 1)], [("1", 5, 6)])
    e = Edge("c", digits("acc"), "p", digits("acc"))
    assert {r["row_id"] for r in direct_orphans(g, e).collect()} == {"2"}


def test_an_end_in_the_far_future_costs_no_more(spark):
    child = spark.createDataFrame([(i, str(i % 300), at(1 + i % 20), "x") for i in range(3000)], CHILD)
    parent = spark.createDataFrame([(str(i), at(10), dt.datetime(9999, 12, 31), "y") for i in range(300)], PARENT)
    nodes = {"c": Node("c", child, "id", F.lit("q"), "at"), "p": Node("p", parent, "acc", F.lit("q"))}
    g = Graph(nodes, [Edge("c", digits("acc"), "p", digits("acc"), ("a", "w"))])
    got = {(int(r["row_id"]), r["reason"]) for r in orphan_cascade(g).collect()}
    assert got == {(i, "came_later") for i in range(3000) if 1 + i % 20 < 10}


def test_a_deep_chain_has_a_flat_plan(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, up string")
    nodes, edges = {}, []
    for k in range(6):
        nodes[f"t{k}"] = Node(f"t{k}", t([(f"{k}-{i}", f"{k - 1}-{i}") for i in range(4 if k else 3)]), "id", F.lit("q"))
        if k:
            edges.append(Edge(f"t{k}", F.col("up"), f"t{k - 1}", F.col("id")))
    found = orphan_cascade(Graph(nodes, edges))
    assert {(r["table_name"], r["row_id"], r["kind"]) for r in found.collect()} == {("t1", "1-3", "direct"), *{(f"t{k}", f"{k}-3", "inherited") for k in range(2, 6)}}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
