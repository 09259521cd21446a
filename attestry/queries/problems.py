"""Queries of the general problems 1, 3 and 4."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.keys import digits, number
from attestry.functions.dates import quarter_label
from attestry.operators import history, orphans, rejects
from attestry.queries import Registry, sqlparts
from attestry.queries.fixtures import answers
from attestry.session import cut, table

REG = Registry()

# --- 1: references to records that do not exist -------------------------------------------------------------------


def filing_graph(spark: SparkSession, d: str) -> orphans.Graph:
    """submission <- attested_tuple <- task, and submission <- reporting_owner. A task has no loading time: its record
    counts as known if any row holds its accession."""
    sub, att, own, task = (table(spark, d, t) for t in ("submission", "attested_tuple", "reporting_owner", "task"))
    nodes = [
        orphans.Node("submission", sub, "sub_id", quarter_label("arrived_at")),
        orphans.Node("attested_tuple", att, "row_id", quarter_label("loaded_at"), "loaded_at"),
        orphans.Node("reporting_owner", own, "owner_id", quarter_label("loaded_at"), "loaded_at"),
        orphans.Node("task", task, "task_id", quarter_label("truth_filed")),
    ]
    live = ("arrived_at", "withdrawn_at")
    edges = [
        orphans.Edge("attested_tuple", digits("accession"), "submission", digits("accession_number"), live),
        orphans.Edge("reporting_owner", digits("accession_number"), "submission", digits("accession_number"), live),
        orphans.Edge("task", digits("truth_accession"), "attested_tuple", digits("accession")),
    ]
    return orphans.Graph({n.name: n for n in nodes}, edges)


_P1_SQL = r"""
WITH sub AS (SELECT nullif(regexp_replace(accession_number, '[^0-9]', '', 'g'), '') AS k, arrived_at, withdrawn_at FROM submission),
refs AS (
  SELECT 'attested_tuple' AS table_name, row_id, nullif(regexp_replace(accession, '[^0-9]', '', 'g'), '') AS k, loaded_at FROM attested_tuple
  UNION ALL
  SELECT 'reporting_owner', owner_id, nullif(regexp_replace(accession_number, '[^0-9]', '', 'g'), ''), loaded_at FROM reporting_owner),
hit AS (
  SELECT r.table_name, r.row_id, count(s.k) AS n, min(s.arrived_at) AS first_at,
    count(*) FILTER (WHERE s.arrived_at <= r.loaded_at AND (s.withdrawn_at IS NULL OR s.withdrawn_at > r.loaded_at)) AS n_live
  FROM refs r LEFT JOIN sub s ON r.k = s.k GROUP BY ALL),
orphan AS (
  SELECT r.table_name, r.row_id, r.k, r.loaded_at, CASE WHEN r.k IS NULL THEN 'no_key' WHEN h.n = 0 THEN 'never_came' WHEN r.loaded_at IS NULL THEN 'no_time' WHEN h.first_at > r.loaded_at THEN 'came_later' ELSE 'withdrawn' END AS reason
  FROM refs r JOIN hit h USING (table_name, row_id) WHERE h.n_live = 0)
"""


@REG.add("p1_found", _P1_SQL + "SELECT table_name, row_id FROM orphan")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_cascade(filing_graph(spark, d))
    rows = found.where((F.col("kind") == "direct") & F.col("table_name").isin("attested_tuple", "reporting_owner"))
    return rows.select("table_name", F.col("row_id").cast("bigint").alias("row_id"))


@REG.add(
    "p1_report",
    _P1_SQL
    + r""",
task_refs AS (SELECT task_id, truth_filed, nullif(regexp_replace(truth_accession, '[^0-9]', '', 'g'), '') AS k FROM task),
held AS (SELECT r.k, count(*) AS n, count(*) FILTER (WHERE o.row_id IS NULL) AS n_alive
  FROM refs r LEFT JOIN orphan o ON o.table_name = r.table_name AND o.row_id = r.row_id WHERE r.table_name = 'attested_tuple' AND r.k IS NOT NULL GROUP BY r.k),
all_rows AS (
  SELECT table_name, 'submission' AS parent, 'direct' AS kind, reason, year(loaded_at) || 'q' || quarter(loaded_at) AS quarter FROM orphan
  UNION ALL
  SELECT 'task', 'attested_tuple', CASE WHEN t.k IS NULL OR h.k IS NULL THEN 'direct' ELSE 'inherited' END,
    CASE WHEN t.k IS NULL THEN 'no_key' WHEN h.k IS NULL THEN 'never_came' ELSE 'orphaned_parent' END, year(truth_filed) || 'q' || quarter(truth_filed)
  FROM task_refs t LEFT JOIN held h ON t.k = h.k WHERE coalesce(h.n_alive, 0) = 0)
SELECT table_name, parent, kind, reason, quarter, count(*) AS n_rows FROM all_rows GROUP BY ALL
""",
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_cascade(filing_graph(spark, d)))


@REG.add(
    "p1_chain",
    _P1_SQL
    + r""",
held AS (SELECT r.k, count(*) FILTER (WHERE o.row_id IS NULL) AS n_alive
  FROM refs r LEFT JOIN orphan o ON o.table_name = r.table_name AND o.row_id = r.row_id WHERE r.table_name = 'attested_tuple' AND r.k IS NOT NULL GROUP BY r.k),
lost AS (SELECT t.task_id, t.truth_filed, CASE WHEN nullif(regexp_replace(t.truth_accession, '[^0-9]', '', 'g'), '') IS NULL THEN 'no_key' WHEN h.k IS NULL THEN 'never_came' ELSE 'orphaned_parent' END AS reason
  FROM task t LEFT JOIN held h ON nullif(regexp_replace(t.truth_accession, '[^0-9]', '', 'g'), '') = h.k WHERE coalesce(h.n_alive, 0) = 0),
arms AS (SELECT task_id, truth_filed, unnest(['alpha', 'beta', 'gamma']) AS arm FROM lost),
all_rows AS (
  SELECT table_name, 'submission' AS parent, 'direct' AS kind, reason FROM orphan
  UNION ALL SELECT 'task', 'attested_tuple', CASE WHEN reason = 'orphaned_parent' THEN 'inherited' ELSE 'direct' END, reason FROM lost
  UNION ALL SELECT 'answer', 'task', 'inherited', 'orphaned_parent' FROM arms
  UNION ALL SELECT 'verdict', 'answer', 'inherited', 'orphaned_parent' FROM arms)
SELECT table_name, parent, kind, reason, count(*) AS n_rows FROM all_rows GROUP BY ALL
""",
)
def p1_chain(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over five levels: submission, attested_tuple, task, the arms' answers to it, and the verdicts on those."""
    graph = filing_graph(spark, d)
    key = F.concat_ws("|", "task_id", "arm")
    arms = answers(spark, d).select("task_id", key.alias("answer_id"), "truth_filed")
    for name, df, own, parent, ref in (("answer", arms, "answer_id", "task", "task_id"), ("verdict", arms.select("answer_id", F.concat("answer_id", F.lit("|v")).alias("verdict_id"), "truth_filed"), "verdict_id", "answer", "answer_id")):
        graph.nodes[name] = orphans.Node(name, df, own, quarter_label("truth_filed"))
        graph.edges.append(orphans.Edge(name, F.col(ref), parent, F.col(ref)))
    found = orphans.orphan_report(orphans.orphan_cascade(graph))
    return found.groupBy("table_name", "parent", "kind", "reason").agg(F.sum("n_rows").alias("n_rows"))


# --- 3: history of changing attributes ----------------------------------------------------------------------------

#: Attributes of a person that filings state, and the periods at which the satellites are loaded: before, between, after.
ATTRIBUTES, LOADS = ["issuer_cik", "title_class", "roles"], [dt.date(2020, 1, 1)]
EMPLOYER, TITLE = ["issuer_cik"], ["title_class", "roles"]


def person_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One row per person and period: the row that counts there."""
    a = table(spark, d, "attested_tuple")
    rows = a.select(number("person_cik").alias("person_cik"), number("issuer_cik").alias("issuer_cik"), "period", "filed", digits("accession").alias("acc"), "title_class", F.array_join(F.array_sort("role_class"), ",").alias("roles"))
    rows = rows.where(F.col("issuer_cik").isNotNull())
    return history.latest_per_period(rows, "person_cik", "period", ["filed", "acc", "issuer_cik"], ["issuer_cik", "title_class", "roles"])


def satellite_of(spark: SparkSession, d: str, attrs: list[str]) -> DataFrame:
    """A person's versions of some attributes. The snapshots are written once; the rates at which their attributes change
    part these into satellites, which are loaded batch by batch; attributes that share one with others are narrowed to
    those asked for."""
    snaps = cut(person_snapshots(spark, d))
    rates = [(r["attribute"], r["change_rate"]) for r in history.change_rates(snaps, "person_cik", "period", ATTRIBUTES).collect()]  # a row per attribute
    groups = [g for g in history.split_by_rate(rates) if set(g) & set(attrs)]
    if len(groups) > 1:
        return history.satellite(snaps, "person_cik", "period", attrs)  # asked across satellites
    sat = history.load(snaps, "person_cik", "period", groups[0], LOADS)
    return sat if sorted(groups[0]) == sorted(attrs) else history.narrowed(sat, "person_cik", attrs)


def employer_view(spark: SparkSession, d: str, versions_from: int = 1) -> DataFrame:
    return history.history_view(satellite_of(spark, d, EMPLOYER), "person_cik", versions_from)


_P3_SQL = r"""
WITH rows_ AS (SELECT try_cast(trim(person_cik) AS BIGINT) AS person_cik, try_cast(trim(issuer_cik) AS BIGINT) AS issuer_cik, period, filed,
    nullif(regexp_replace(accession, '[^0-9]', '', 'g'), '') AS acc FROM attested_tuple),
best AS (SELECT person_cik, period, issuer_cik FROM rows_ WHERE person_cik IS NOT NULL AND issuer_cik IS NOT NULL AND period IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY person_cik, period ORDER BY filed DESC NULLS LAST, acc DESC NULLS LAST, issuer_cik DESC) = 1),
ver AS (SELECT person_cik, issuer_cik, period AS valid_from FROM best QUALIFY lag(issuer_cik) OVER (PARTITION BY person_cik ORDER BY period) IS DISTINCT FROM issuer_cik),
hist AS (SELECT *, lead(valid_from) OVER (PARTITION BY person_cik ORDER BY valid_from) AS valid_to, count(*) OVER (PARTITION BY person_cik) AS n FROM ver)
"""


@REG.add("p3_found", _P3_SQL + "SELECT person_cik, issuer_cik, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM hist WHERE n >= 2")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    view = employer_view(spark, d, versions_from=2)
    return view.select("person_cik", "issuer_cik", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@REG.add("p3_history", _P3_SQL + "SELECT person_cik, issuer_cik, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to FROM hist")
def p3_history(spark: SparkSession, d: str) -> DataFrame:
    view = employer_view(spark, d)
    return view.select("person_cik", "issuer_cik", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("valid_from", "valid_to")])


_SNAP_SQL = r"""
WITH snap AS (SELECT try_cast(trim(person_cik) AS BIGINT) AS person_cik, period, try_cast(trim(issuer_cik) AS BIGINT) AS issuer_cik, title_class, array_to_string(list_sort(role_class), ',') AS roles FROM attested_tuple
  WHERE try_cast(trim(person_cik) AS BIGINT) IS NOT NULL AND try_cast(trim(issuer_cik) AS BIGINT) IS NOT NULL AND period IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY try_cast(trim(person_cik) AS BIGINT), period ORDER BY filed DESC NULLS LAST, nullif(regexp_replace(accession, '[^0-9]', '', 'g'), '') DESC NULLS LAST, try_cast(trim(issuer_cik) AS BIGINT) DESC, title_class DESC NULLS LAST, array_to_string(list_sort(role_class), ',') DESC NULLS LAST) = 1)
"""


@REG.add(
    "p3_titles",
    _SNAP_SQL
    + r""", lagged AS (SELECT *, row_number() OVER w AS rn, lag(title_class) OVER w AS t0, lag(roles) OVER w AS r0 FROM snap WINDOW w AS (PARTITION BY person_cik ORDER BY period)),
ver AS (SELECT * FROM lagged WHERE rn = 1 OR t0 IS DISTINCT FROM title_class OR r0 IS DISTINCT FROM roles)
SELECT person_cik, title_class, roles, strftime(period, '%Y-%m-%d') AS valid_from, strftime(lead(period) OVER (PARTITION BY person_cik ORDER BY period), '%Y-%m-%d') AS valid_to FROM ver""",
)
def p3_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title class and roles, with ends."""
    view = history.history_view(satellite_of(spark, d, TITLE), "person_cik")
    return view.select("person_cik", *TITLE, *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("valid_from", "valid_to")])


@REG.add(
    "p3_change_rates",
    _SNAP_SQL
    + r""", steps AS (SELECT row_number() OVER w AS rn, lag(issuer_cik) OVER w IS DISTINCT FROM issuer_cik AS i, lag(title_class) OVER w IS DISTINCT FROM title_class AS t, lag(roles) OVER w IS DISTINCT FROM roles AS r FROM snap WINDOW w AS (PARTITION BY person_cik ORDER BY period)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE i) AS i, count(*) FILTER (WHERE t) AS t, count(*) FILTER (WHERE r) AS r FROM steps WHERE rn > 1),
each AS (SELECT 'issuer_cik' AS attribute, n, i AS c FROM n UNION ALL SELECT 'title_class', n, t FROM n UNION ALL SELECT 'roles', n, r FROM n)
SELECT attribute, n AS n_steps, c AS n_changes, coalesce(round(c::DOUBLE / nullif(n, 0), 6), 0.0) AS change_rate FROM each""",
)
def p3_change_rates(spark: SparkSession, d: str) -> DataFrame:
    return history.change_rates(person_snapshots(spark, d), "person_cik", "period", EMPLOYER + TITLE)


@REG.add(
    "p3_task_truth",
    _P3_SQL
    + r"""
SELECT t.task_id, CAST(h.issuer_cik AS VARCHAR) AS history_issuer_cik, coalesce(h.issuer_cik = try_cast(trim(t.truth_issuer_cik) AS BIGINT), false) AS agrees
FROM task t LEFT JOIN hist h ON try_cast(trim(t.person_cik) AS BIGINT) = h.person_cik AND h.valid_from <= t.target_date AND (h.valid_to IS NULL OR t.target_date < h.valid_to)
""",
)
def p3_task_truth(spark: SparkSession, d: str) -> DataFrame:
    """The employer that the history gives each task at its date, and whether the task's stored truth still agrees."""
    view = employer_view(spark, d)
    tasks = table(spark, d, "task").select("task_id", number("person_cik").alias("__p"), "target_date", number("truth_issuer_cik").alias("__truth"))
    got = history.as_of(tasks, "__p", "target_date", view, "person_cik", {"issuer_cik": "history_issuer_cik"})
    return got.select("task_id", F.col("history_issuer_cik").cast("string").alias("history_issuer_cik"), F.coalesce(F.col("history_issuer_cik") == F.col("__truth"), F.lit(False)).alias("agrees"))


# --- 4: rows that fail to parse -----------------------------------------------------------------------------------

_BAD_DATE = r"""(
  CASE WHEN regexp_full_match({0}, '[0-9]{{1,2}}-[A-Za-z]{{3}}-[0-9]{{4}}') THEN try_strptime({0}, '%d-%b-%Y') IS NULL
       WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime({0}, '%Y-%m-%d') IS NULL
       WHEN regexp_full_match({0}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({0}, '%m/%d/%Y') IS NULL
       WHEN regexp_full_match({0}, '[0-9]{{1,2}}[A-Za-z]{{3}}[0-9]{{4}}') THEN try_strptime(regexp_replace({0}, '^([0-9]+)([A-Za-z]+)([0-9]+)$', '\1-\2-\3'), '%d-%b-%Y') IS NULL
       WHEN regexp_full_match({0}, '[0-9]{{8}}') THEN try_strptime({0}, '%Y%m%d') IS NULL
       ELSE true END)"""

_P4_SQL = (
    r"""
WITH lines AS (SELECT line_id, archive, member_file, chr(9) || regexp_replace(coalesce(raw_text, ''), '\r$', '') AS t FROM raw_line WHERE line_no <> 1 OR line_no IS NULL),
cut AS (SELECT *, regexp_extract_all(t, '\t("(?:[^"]|"")*"|[^\t]*)', 1) AS f FROM lines),
judged AS (SELECT *, (length(array_to_string(f, chr(9))) + 1 <> length(t) OR len(list_filter(f, lambda x: x[1] = '"' AND NOT regexp_full_match(x, '"(?:[^"]|"")*"'))) > 0) AS bad_quote FROM cut),
plain AS (SELECT line_id, archive, member_file, bad_quote, NOT bad_quote AND len(f) <> CASE WHEN member_file = 'SUBMISSION.tsv' THEN 14 ELSE 13 END AS bad_count,
  [CASE WHEN x[1] = '"' AND NOT bad_quote THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN f] AS f FROM judged),
ok AS (SELECT *, trim(f[2]) AS f2, trim(f[3]) AS f3, f[4] AS f4 FROM plain WHERE NOT bad_quote AND NOT bad_count),
reasons AS (
  SELECT line_id, archive, member_file, 'quoting' AS reason FROM plain WHERE bad_quote
  UNION ALL SELECT line_id, archive, member_file, 'column_count' FROM plain WHERE bad_count
  UNION ALL SELECT line_id, archive, member_file, 'unparseable_date' FROM ok WHERE member_file = 'SUBMISSION.tsv' AND ("""
    + _BAD_DATE.format("f2")
    + " OR "
    + _BAD_DATE.format("f3")
    + r""")
  UNION ALL SELECT line_id, archive, member_file, 'bad_person_cik' FROM ok WHERE member_file = 'REPORTINGOWNER.tsv' AND NOT regexp_full_match(f2, '[0-9]+')
  UNION ALL SELECT line_id, archive, member_file, 'unknown_relationship_token' FROM ok WHERE member_file = 'REPORTINGOWNER.tsv' AND trim(f4) <> ''
    AND len(list_filter(string_split(f4, ','), lambda x: lower(regexp_replace(x, '[\s-]', '', 'g')) IN ('director', 'officer', 'tenpercentowner', 'other'))) = 0)
"""
)


@REG.add("p4_found", _P4_SQL + "SELECT line_id, reason FROM reasons")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejects(rejects.parse_lines(table(spark, d, "raw_line"))).select("line_id", "reason")


@REG.add(
    "p4_reject_counts",
    _P4_SQL
    + r"""
SELECT l.archive, l.member_file, count(DISTINCT l.line_id) AS input_rows, count(DISTINCT l.line_id) - count(DISTINCT r.line_id) AS loaded, count(DISTINCT r.line_id) AS rejected,
  count(*) FILTER (WHERE reason = 'quoting') AS quoting, count(*) FILTER (WHERE reason = 'column_count') AS column_count, count(*) FILTER (WHERE reason = 'unparseable_date') AS unparseable_date,
  count(*) FILTER (WHERE reason = 'bad_person_cik') AS bad_person_cik, count(*) FILTER (WHERE reason = 'unknown_relationship_token') AS unknown_relationship_token
FROM lines l LEFT JOIN reasons r ON l.line_id = r.line_id GROUP BY ALL""",
)
def p4_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return rejects.reject_counts(rejects.parse_lines(table(spark, d, "raw_line")))


def _loaded_sql(member: str) -> str:
    """The valid rows of a member file under its column names, typed fields in their canonical form."""
    columns = rejects.LAYOUTS[member.upper()].columns
    form = {"filing_date": "strftime({0}, '%Y-%m-%d')", "period_of_report": "strftime({0}, '%Y-%m-%d')", "rptownercik": "trim({0})"}
    each = [form.get(c, "{0}").format(sqlparts.date(f"f[{i}]") if "date" in c and c in form or c == "period_of_report" else f"f[{i}]") + f" AS {c}" for i, c in enumerate(columns, 1)]
    return _P4_SQL + f"SELECT line_id, archive, {', '.join(each)} FROM ok WHERE member_file = '{member}' AND line_id NOT IN (SELECT line_id FROM reasons)"


@REG.add("p4_loaded_submissions", _loaded_sql("SUBMISSION.tsv"))
def p4_loaded_submissions(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loadable(rejects.parse_lines(table(spark, d, "raw_line")), "SUBMISSION.tsv")


@REG.add("p4_loaded_owners", _loaded_sql("REPORTINGOWNER.tsv"))
def p4_loaded_owners(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loadable(rejects.parse_lines(table(spark, d, "raw_line")), "REPORTINGOWNER.tsv")
