"""References to records that do not exist: direct orphans by validity in time, then a fixpoint cascade down the
foreign-key graph by semi-joins, so that children of orphaned records are reported as inherited orphans."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import cut, release


@dataclass(frozen=True)
class Node:
    """A table of the graph. id: its unique bigint or string id. period: what reports group by. at: when the row came,
    for references to records with a validity."""

    name: str
    df: DataFrame
    id: str
    period: Column
    at: str | None = None


@dataclass(frozen=True)
class Edge:
    """child's key refers to parent's key. valid: the parent's (from, until) columns; until NULL: never ended."""

    child: str
    child_key: Column
    parent: str
    parent_key: Column
    valid: tuple[str, str] | None = None


@dataclass
class Graph:
    nodes: dict[str, Node]
    edges: list[Edge] = field(default_factory=list)

    def depth(self) -> int | None:
        """Edges on the longest path; None if there is a cycle."""
        left, level = list(self.edges), 0
        below = {e.child for e in left}
        while left:
            ready = {e.parent for e in left} - below
            rest = [e for e in left if e.parent not in ready]
            if len(rest) == len(left):
                return None
            left, below, level = rest, {e.child for e in rest}, level + 1
        return level


SCHEMA = "table_name string, row_id string, parent string, kind string, reason string, quarter string"


#: Days of the spans of time in which records with an end meet the rows of their key.
SPAN_DAYS = 30


def _span_of(at: Column) -> Column:
    return F.floor(F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date")) / SPAN_DAYS)


def _rows(node: Node, df: DataFrame, parent: str, kind: str, reason: Column) -> DataFrame:
    return df.select(F.lit(node.name).alias("table_name"), F.col("__id").cast("string").alias("row_id"), F.lit(parent).alias("parent"), F.lit(kind).alias("kind"), reason.alias("reason"), F.col("__period").alias("quarter"))


def _children(node: Node, key: Column) -> DataFrame:
    return node.df.select(F.col(node.id).alias("__id"), node.period.alias("__period"), (F.col(node.at) if node.at else F.lit(None).cast("timestamp_ntz")).alias("__at"), key.alias("__key"))


def direct_orphans(graph: Graph, edge: Edge) -> DataFrame:
    """Rows of edge.child whose key has no record in edge.parent that is live when the row came.

    Reasons: no_key, never_came, no_time, came_later, withdrawn. Records without an end are folded to one row per key before the
    join, so a key that holds a third of either table moves once; only records with an end are compared as intervals with
    rows that no other record keeps, by key and span of time, which parts a key that is hot on both sides; spans outside the
    time in which rows came are left out, so an end in the far future costs no more than one at the last row. For a row
    whose own time is NULL no record is live. Repeated rows of either side change nothing.
    """
    child, parent = graph.nodes[edge.child], graph.nodes[edge.parent]
    rows = _children(child, edge.child_key)
    bare = _rows(child, rows.where(F.col("__key").isNull()), edge.parent, "direct", F.lit("no_key"))
    rows = rows.where(F.col("__key").isNotNull())
    if not edge.valid or not child.at:
        keys = parent.df.select(edge.parent_key.alias("__key")).where(F.col("__key").isNotNull()).distinct()
        return bare.unionByName(_rows(child, rows.join(keys, "__key", "left_anti"), edge.parent, "direct", F.lit("never_came")))
    start, end = edge.valid
    records = parent.df.select(edge.parent_key.alias("__key"), F.col(start).alias("__from"), F.col(end).alias("__until")).where(F.col("__key").isNotNull())
    folded = records.groupBy("__key").agg(F.min("__from").alias("__first"), F.min(F.when(F.col("__until").isNull(), F.col("__from"))).alias("__for_good"))
    ended = records.where(F.col("__until") > F.col("__from")).groupBy("__key", "__from").agg(F.max("__until").alias("__until")).withColumnRenamed("__key", "__k")
    seen = rows.join(folded, "__key", "left")
    open_ = seen.where(~F.coalesce(F.col("__for_good") <= F.col("__at"), F.lit(False)))
    seen_at = rows.agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))  # one row
    bounded = ended.crossJoin(F.broadcast(seen_at)).where((F.col("__until") > F.col("__lo")) & (F.col("__from") <= F.col("__hi")))
    spans = bounded.withColumn("__s", F.explode(F.sequence(_span_of(F.greatest("__from", "__lo")), _span_of(F.least("__until", "__hi")))))
    gone = open_.withColumn("__span", _span_of(F.col("__at"))).join(spans, (F.col("__key") == F.col("__k")) & (F.col("__span") == F.col("__s")) & (F.col("__from") <= F.col("__at")) & (F.col("__until") > F.col("__at")), "left_anti")
    reason = F.when(F.col("__first").isNull(), "never_came").when(F.col("__at").isNull(), "no_time").when(F.col("__first") > F.col("__at"), "came_later").otherwise("withdrawn")
    return bare.unionByName(_rows(child, gone, edge.parent, "direct", reason))


def _alive_keys(graph: Graph, edge: Edge, orphans: DataFrame) -> DataFrame:
    """Keys of edge.parent that some row holds which is no orphan so far."""
    parent = graph.nodes[edge.parent]
    ids = orphans.where(F.col("table_name") == edge.parent).select(F.col("row_id").alias("__o")).distinct()
    held = parent.df.select(F.col(parent.id).cast("string").alias("__o"), edge.parent_key.alias("__key")).where(F.col("__key").isNotNull())
    return held.join(ids, "__o", "left_anti").select("__key").distinct()


def inherited_orphans(graph: Graph, edge: Edge, orphans: DataFrame) -> DataFrame:
    """Rows of edge.child, not orphans so far, all of whose records in edge.parent are orphans."""
    child = graph.nodes[edge.child]
    known = orphans.where(F.col("table_name") == edge.child).select(F.col("row_id").alias("__id")).distinct()
    rows = _children(child, edge.child_key).where(F.col("__key").isNotNull()).withColumn("__id", F.col("__id").cast("string"))
    lost = rows.join(_alive_keys(graph, edge, orphans), "__key", "left_anti").join(known, "__id", "left_anti")
    return _rows(child, lost, edge.parent, "inherited", F.lit("orphaned_parent"))


def orphan_cascade(graph: Graph) -> DataFrame:
    """Every orphan of the graph, direct ones first, then those inherited level by level until nothing is added.

    One row per row and reference that fails, columns as SCHEMA. Every round is written to the shared folder and the next
    reads what was written, so plans grow with the number of edges and not with a power of the depth. An acyclic graph takes
    its edges once, parents before children; a graph with a cycle is iterated until a round adds nothing. Empty tables give no rows; a parent table that is empty orphans every keyed child. Keys are
    read through the edges' expressions, ids as text; other columns, whatever their names, are not read.
    """
    found = cut(reduce(DataFrame.unionByName, (direct_orphans(graph, e) for e in graph.edges)))
    if graph.depth() is not None:
        for e in _by_level(graph):  # parents before children: one pass is the fixpoint
            if any(x.child == e.parent for x in graph.edges):
                found = found.unionByName(cut(inherited_orphans(graph, e, found)))
        return found
    while True:
        new = cut(reduce(DataFrame.unionByName, (inherited_orphans(graph, e, found) for e in graph.edges)).dropDuplicates(["table_name", "row_id"]))
        if new.isEmpty():
            release(new)
            return found
        found, old = cut(found.unionByName(new)), found
        release(old)
        release(new)


def _by_level(graph: Graph) -> list[Edge]:
    out, left = [], list(graph.edges)
    while left:
        waiting = {e.child for e in left}
        ready = [e for e in left if e.parent not in waiting]
        out += ready
        left = [e for e in left if e not in ready]
    return out


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, reason, kind and quarter; the counts are folded before the shuffle."""
    return found.groupBy("table_name", "parent", "kind", "reason", "quarter").agg(F.count(F.lit(1)).alias("n_rows"))
