"""Queries over the corpus: ingest, normal forms, collisions, tasks, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import names
from attestry.functions.answers import arm_requests, employment_prompt, pii
from attestry.functions.dates import parse_date
from attestry.functions.keys import sha_key
from attestry.functions.titles import title_class
from attestry.operators import collision, ingest, sampling, splitting, tasks as task_ops
from attestry.queries import Registry, sqlparts as q
from attestry.queries.fixtures import TASKS_SQL, people, tasks
from attestry.session import table

REG = Registry()
FLOOR = (2006, 3)  # later than the rule's own floor, so that the rule fires on these tables

# --- ingest -------------------------------------------------------------------------------------------------------

_ROLE_TOKENS = r"list_transform(string_split(coalesce(rptowner_relationship, ''), ','), lambda t: lower(regexp_replace(t, '[\s-]', '', 'g')))"
_ROLES = f"list_sort(list_distinct(list_filter(list_transform({_ROLE_TOKENS}, lambda t: CASE t WHEN 'director' THEN 'DIRECTOR' WHEN 'officer' THEN 'OFFICER' WHEN 'tenpercentowner' THEN 'TEN_PERCENT_OWNER' WHEN 'other' THEN 'OTHER' END), lambda r: r IS NOT NULL)))"
JUDGED_SQL = f"""
sub AS (SELECT {q.digits('accession_number')} AS k, max_by(struct_pack(p := period_of_report, f := filing_date, i := issuercik, n := issuername, s := issuertradingsymbol), struct_pack(a := arrived_at, b := sub_id)) AS s
  FROM submission WHERE {q.digits('accession_number')} IS NOT NULL GROUP BY 1),
own AS (SELECT *, {q.digits('accession_number')} AS k, {_ROLES} AS roles, trim(rptownercik) AS cik, trim(coalesce(rptowner_title, '')) AS title FROM reporting_owner),
dated AS (SELECT own.*, sub.k IS NOT NULL AS joined, {q.date('sub.s.p')} AS period, {q.date('sub.s.f')} AS filed, trim(sub.s.i) AS issuer_cik, {q.title_class('title')} AS tclass FROM own LEFT JOIN sub ON own.k = sub.k),
judged AS (SELECT *, CASE WHEN NOT joined THEN 'unjoined_accession'
  WHEN NOT (list_contains(roles, 'OFFICER') OR list_contains(roles, 'DIRECTOR')) THEN CASE WHEN roles = ['TEN_PERCENT_OWNER'] THEN 'ten_percent_owner_only' ELSE 'no_officer_or_director' END
  WHEN NOT coalesce(regexp_full_match(cik, '[0-9]+'), false) THEN 'bad_person_cik' WHEN period IS NULL OR filed IS NULL THEN 'unparseable_date' WHEN period > filed THEN 'period_after_filed'
  WHEN (year(filed), quarter(filed)) < ({FLOOR[0]}, {FLOOR[1]}) THEN 'quarter_before_2003q3' ELSE 'kept' END AS disposition FROM dated)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judged(table(spark, d, "reporting_owner"), table(spark, d, "submission"), FLOOR)


_DROP_SQL = ", ".join(f"count(*) FILTER (WHERE disposition = '{x}') AS {x}" for x in ingest.DROPS)


@REG.add(
    "exclusion_counts",
    f"WITH {JUDGED_SQL} SELECT archive, count(*) AS input_rows, count(*) FILTER (WHERE disposition = 'kept') AS kept, {_DROP_SQL}, "
    "count(*) FILTER (WHERE disposition <> 'unjoined_accession' AND len(roles) = 0 AND trim(coalesce(rptowner_relationship, '')) <> '') AS unknown_relationship_token, "
    "count(*) FILTER (WHERE disposition = 'kept' AND tclass = 'UNKNOWN') AS title_unknown FROM judged GROUP BY archive",
)
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    """Owner rows per archive by the rule that kept or dropped them; fails if they do not add up."""
    return ingest.reconciles(ingest.exclusion_counts(judged(spark, d), ["archive"]))


@REG.add("attested_rows", f"WITH {JUDGED_SQL} SELECT owner_id, trim(cik) AS person_cik, issuer_cik, array_to_string(roles, ',') AS roles, tclass AS title_class, strftime(period, '%Y-%m-%d') AS period, strftime(filed, '%Y-%m-%d') AS filed FROM judged WHERE disposition = 'kept'")
def attested_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.attested(judged(spark, d))
    return rows.select("owner_id", "person_cik", "issuer_cik", F.array_join("role_class", ",").alias("roles"), "title_class", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("period", "filed")])


@REG.add("stored_counts_agree", "SELECT archive, input_rows, kept + no_officer_or_director + ten_percent_owner_only + bad_person_cik + unparseable_date + period_after_filed + quarter_before_2003q3 + unjoined_accession = input_rows AS agrees FROM exclusion_counts")
def stored_counts_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether the stored counters reconcile."""
    c = table(spark, d, "exclusion_counts")
    return c.select("archive", "input_rows", (F.col("kept") + sum((F.col(x) for x in ingest.DROPS), F.lit(0)) == F.col("input_rows")).alias("agrees"))


@REG.add("quarter_range", "SELECT archive, input_rows FROM exclusion_counts WHERE archive BETWEEN '2010q2' AND '2012q3'")
def quarter_range(spark: SparkSession, d: str) -> DataFrame:
    """An inclusive range of quarters, compared as (year, quarter)."""
    c = table(spark, d, "exclusion_counts")
    at = F.struct(F.substring("archive", 1, 4).cast("int").alias("y"), F.substring("archive", 6, 1).cast("int").alias("q"))
    low, high = (F.struct(F.lit(y).alias("y"), F.lit(n).alias("q")) for y, n in ((2010, 2), (2012, 3)))
    return c.where((at >= low) & (at <= high)).select("archive", "input_rows")


@REG.add("last_submission", f"SELECT {q.digits('accession_number')} AS acc, max_by(sub_id, struct_pack(a := arrived_at, b := sub_id)) AS sub_id, count(*) AS n FROM submission WHERE {q.digits('accession_number')} IS NOT NULL GROUP BY 1")
def last_submission(spark: SparkSession, d: str) -> DataFrame:
    from attestry.functions.keys import digits

    s = table(spark, d, "submission").select("arrived_at", "sub_id", "accession_number")
    n = s.where(digits("accession_number").isNotNull()).groupBy(digits("accession_number").alias("acc")).agg(F.max(F.struct("arrived_at", "sub_id")).alias("l"), F.count(F.lit(1)).alias("n"))
    return n.select("acc", "l.sub_id", "n")


@REG.add("relationships", f"SELECT owner_id, array_to_string({_ROLES}, ',') AS roles FROM reporting_owner")
def relationships(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reporting_owner").select("owner_id", F.array_join(ingest.roles("rptowner_relationship"), ",").alias("roles"))


@REG.add("parsed_dates", f"SELECT sub_id, strftime({q.date('filing_date')}, '%Y-%m-%d') AS filed, strftime({q.date('period_of_report')}, '%Y-%m-%d') AS period FROM submission")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submission").select("sub_id", F.date_format(parse_date("filing_date"), "yyyy-MM-dd").alias("filed"), F.date_format(parse_date("period_of_report"), "yyyy-MM-dd").alias("period"))


@REG.add("contact_columns_dropped", "SELECT owner_id, archive, rptownername FROM reporting_owner")
def contact_columns_dropped(spark: SparkSession, d: str) -> DataFrame:
    from attestry.functions.answers import forbidden_fields

    out = table(spark, d, "reporting_owner").drop(*ingest.CONTACT_COLUMNS).select("owner_id", "archive", "rptownername")
    if bad := forbidden_fields(out.schema):
        raise ValueError(f"contact fields: {bad}")
    return out


# --- normal forms -------------------------------------------------------------------------------------------------


@REG.add("person_forms", f"SELECT row_id, {q.strict('person_name_raw')} AS strict_form, {q.presented('person_name_raw')} AS presented_form FROM attested_tuple")
def person_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", names.strict_name("person_name_raw").alias("strict_form"), names.presented_name("person_name_raw").alias("presented_form"))


@REG.add("company_forms", f"SELECT row_id, {q.company('issuer_name_raw')} AS company FROM attested_tuple")
def company_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", names.company_name("issuer_name_raw").alias("company"))


_QT = f"list_filter(string_split({q.fold('person_name_raw')}, ' '), lambda t: length(t) > 1 AND t NOT IN ({q.words(names.SUFFIXES)}))"
_CAP = "array_to_string(list_transform({0}, lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@REG.add(
    "query_names",
    f"""WITH t AS (SELECT task_id, coalesce({_QT}, []) AS t FROM task),
c AS (SELECT task_id, t, len(t) AS n, coalesce(list_position(list_transform(t, lambda w: w NOT IN ({q.words(names.PARTICLES)})), true), 0) AS f FROM t),
e AS (SELECT *, greatest(1, least(CASE WHEN f > 0 THEN f ELSE n END, n - 1)) AS cut FROM c)
SELECT task_id, CASE WHEN n < 2 THEN {_CAP.format('t')} ELSE {_CAP.format('list_concat(t[cut + 1:cut + 1], t[1:cut])')} END AS query_name FROM e""",
)
def query_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task").select("task_id", names.query_name("person_name_raw").alias("query_name"))


@REG.add("entities", rf"SELECT row_id, coalesce(regexp_matches(person_name_raw, '{names.ENTITY}'), false) AS is_entity FROM attested_tuple")
def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", names.is_entity("person_name_raw").alias("is_entity"))


@REG.add("title_classes", f"SELECT row_id, {q.title_class('title_raw')} AS title_class FROM attested_tuple")
def title_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", title_class("title_raw").alias("title_class"))


def _company_filter(x: str) -> str:
    kept = rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{names.FILTER}', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s&-]', ' ', 'g'), '\s+', ' ', 'g'))"
    titled = f"array_to_string(list_transform(string_split(lower({kept}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return rf"coalesce(CASE WHEN {kept} = '' THEN {x} WHEN regexp_matches({kept}, '\p{{L}}') AND {kept} = upper({kept}) THEN {titled} ELSE {kept} END, '')"


@REG.add("company_filters", f"SELECT row_id, {_company_filter('issuer_name_raw')} AS company FROM attested_tuple")
def company_filters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attested_tuple").select("row_id", names.company_filter("issuer_name_raw").alias("company"))


@REG.add("shown_names", f"SELECT task_id, array_to_string(list_transform(string_split({q.presented('person_name_raw')}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown FROM task")
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task").select("task_id", names.shown_name("person_name_raw").alias("shown"))


@REG.add("page_titles", rf"""WITH t AS (SELECT task_id, person_name_raw || ' - ' || anchor_title_class || CASE WHEN collision_degree % 2 = 0 THEN '' ELSE ' - ' || anchor_issuer_name END || ' | LinkedIn' AS t FROM task),
c AS (SELECT task_id, {q.strip("regexp_replace(t, '(?i)" + names.SITES + "', '')")} AS t FROM t),
p AS (SELECT task_id, t, list_filter(list_transform(string_split(t, ' - '), lambda x: {q.strip('x')}), lambda x: x <> '') AS p FROM c)
SELECT task_id, CASE WHEN len(p) >= 2 THEN p[1] ELSE nullif(t, '') END AS person, CASE WHEN len(p) >= 3 THEN p[3] END AS employer, CASE WHEN len(p) >= 2 THEN p[2] END AS role FROM p""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task")
    title = F.concat("person_name_raw", F.lit(" - "), "anchor_title_class", F.when(F.col("collision_degree") % 2 == 0, "").otherwise(F.concat(F.lit(" - "), F.col("anchor_issuer_name"))), F.lit(" | LinkedIn"))
    return t.select("task_id", names.page_title(title).alias("p")).select("task_id", "p.*")


@REG.add("title_heads", rf"SELECT task_id, nullif(regexp_extract({q.strip("person_name_raw || ', ' || anchor_title_class || ' at ' || anchor_issuer_name")}, '^(.*?)(?:[\s\p{{Z}}]*[,|¦][\s\p{{Z}}]*|[\s\p{{Z}}]+-[\s\p{{Z}}]+|$)', 1), '') AS head FROM task")
def title_heads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task")
    return t.select("task_id", names.name_in_title(F.concat("person_name_raw", F.lit(", "), "anchor_title_class", F.lit(" at "), "anchor_issuer_name")).alias("head"))


@REG.add("signatures", f"""WITH {q.PEOPLE} SELECT row_id, sha256('person=' || person_cik || '|issuer=' || issuer_cik || '|roles=' || coalesce(array_to_string(list_sort(role_class), ','), '') || '|title=' || title_class || '|period=' || strftime(period, '%Y-%m-%d')) AS signature
FROM people WHERE person_cik IS NOT NULL AND issuer_cik IS NOT NULL AND role_class IS NOT NULL AND title_class IS NOT NULL AND period IS NOT NULL""")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d).where("person_cik IS NOT NULL AND issuer_cik IS NOT NULL AND role_class IS NOT NULL AND title_class IS NOT NULL AND period IS NOT NULL")
    text = lambda c: F.col(c).cast("string")
    return p.select("row_id", splitting.signature(text("person_cik"), text("issuer_cik"), F.col("role_class"), F.col("title_class"), F.col("period")).alias("signature"))


@REG.add("prompts", "SELECT task_id, person_name_raw || ' was an officer or director at ' || anchor_issuer_name || ' as of ' || strftime(anchor_date, '%Y-%m-%d') || '. What organisation are they at most recently, and in what role? Answer for their latest known position.' AS prompt FROM task")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task").select("task_id", employment_prompt(F.col("person_name_raw"), F.col("anchor_issuer_name"), F.col("anchor_date")).alias("prompt"))


_WHO = f"CASE WHEN n < 2 THEN {_CAP.format('t')} ELSE {_CAP.format('list_concat(t[cut + 1:cut + 1], t[1:cut])')} END"
_TAIL = "'. What organisation are they at most recently, and in what role? Answer for their latest known position. Give your confidence as a number between 0 and 1.'"


@REG.add(
    "arm_requests",
    f"""WITH t AS (SELECT *, coalesce({_QT}, []) AS t, {_company_filter('anchor_issuer_name')} AS firm FROM task),
c AS (SELECT *, len(t) AS n, coalesce(list_position(list_transform(t, lambda w: w NOT IN ({q.words(names.PARTICLES)})), true), 0) AS f FROM t),
e AS (SELECT *, greatest(1, least(CASE WHEN f > 0 THEN f ELSE n END, n - 1)) AS cut FROM c), w AS (SELECT *, {_WHO} AS who FROM e)
SELECT task_id, 'name_only' AS arm, who || {_TAIL} AS request FROM w
UNION ALL SELECT task_id, 'anchor_freetext', who || ', who previously worked at ' || firm || {_TAIL} FROM w
UNION ALL SELECT task_id, 'full_context', who || ' was an officer or director at ' || anchor_issuer_name || ' as of ' || strftime(anchor_date, '%Y-%m-%d') || ', with the role ' || anchor_title_class || {_TAIL} FROM w
UNION ALL SELECT task_id, 'index_name_only', to_json({{'query': who}})::VARCHAR FROM w
UNION ALL SELECT task_id, 'index_company_filter', to_json({{'query': who, 'filters': {{'company': firm}}}})::VARCHAR FROM w
UNION ALL SELECT task_id, 'index_bare', to_json({{'query': trim(who || ' ' || firm)}})::VARCHAR FROM w""",
)
def arm_requests_(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task")
    each = [F.struct(F.lit(k).alias("arm"), v.alias("request")) for k, v in arm_requests("person_name_raw", "anchor_issuer_name", "anchor_date", "anchor_title_class").items()]
    return t.select("task_id", F.explode(F.array(*each)).alias("r")).select("task_id", "r.*")


@REG.add("pii_scan", r"SELECT kind, count(*) AS n_docs, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}')) AS n_pii FROM documents GROUP BY kind")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(pii(F.col("text"))).alias("n_pii"))


# --- collisions ---------------------------------------------------------------------------------------------------

_INDEX = f"{q.PEOPLE}, strict_ix AS (SELECT DISTINCT {q.strict('person_name_raw')} AS name, person_cik AS cik FROM people WHERE person_cik IS NOT NULL), presented_ix AS (SELECT DISTINCT {q.presented('person_name_raw')} AS name, person_cik AS cik FROM people WHERE person_cik IS NOT NULL), issuers AS (SELECT DISTINCT person_cik AS cik, issuer_cik AS issuer FROM people WHERE person_cik IS NOT NULL AND issuer_cik IS NOT NULL)"


@REG.add("strict_degrees", f"WITH {_INDEX} SELECT name, count(*) AS degree FROM strict_ix WHERE name <> '' GROUP BY name")
def strict_degrees(spark: SparkSession, d: str) -> DataFrame:
    return collision.degrees(collision.strict_index(people(spark, d)))


@REG.add("presented_degrees", f"WITH {_INDEX} SELECT name, count(*) AS degree FROM presented_ix WHERE name <> '' GROUP BY name")
def presented_degrees(spark: SparkSession, d: str) -> DataFrame:
    return collision.degrees(collision.presented_index(people(spark, d)))


@REG.add("issuers_per_person", f"WITH {_INDEX} SELECT cik, count(*) AS n_issuers FROM issuers GROUP BY cik")
def issuers_per_person(spark: SparkSession, d: str) -> DataFrame:
    return collision.issuers_of(people(spark, d)).groupBy("cik").agg(F.count(F.lit(1)).alias("n_issuers"))


@REG.add("issuer_index", f"WITH {q.PEOPLE} SELECT {q.company('issuer_name_raw')} AS company, count(DISTINCT issuer_cik) AS n_issuers, min(issuer_cik) AS least FROM people WHERE issuer_cik IS NOT NULL GROUP BY 1 HAVING company <> ''")
def issuer_index(spark: SparkSession, d: str) -> DataFrame:
    return collision.issuer_index(people(spark, d)).groupBy("company").agg(F.count(F.lit(1)).alias("n_issuers"), F.min("issuer").alias("least"))


_DEG = f"{_INDEX}, deg AS (SELECT p.row_id, p.person_cik, coalesce(a.n, 0) AS collision_degree, coalesce(b.n, 0) AS strict_degree FROM people p LEFT JOIN (SELECT name, count(*) AS n FROM presented_ix WHERE name <> '' GROUP BY name) a ON a.name = {q.presented('p.person_name_raw')} LEFT JOIN (SELECT name, count(*) AS n FROM strict_ix WHERE name <> '' GROUP BY name) b ON b.name = {q.strict('p.person_name_raw')})"


@REG.add("row_degrees", f"WITH {_DEG} SELECT row_id, collision_degree, strict_degree, {q.band('collision_degree')} AS band FROM deg")
def row_degrees(spark: SparkSession, d: str) -> DataFrame:
    return collision.with_degrees(people(spark, d)).select("row_id", "collision_degree", "strict_degree", "band")


@REG.add("band_histogram", f"WITH {_DEG} SELECT {q.band('collision_degree')} AS band, count(*) AS n_rows FROM deg GROUP BY 1")
def band_histogram(spark: SparkSession, d: str) -> DataFrame:
    return collision.with_degrees(people(spark, d)).groupBy("band").agg(F.count(F.lit(1)).alias("n_rows"))


@REG.add(
    "contamination_bound",
    f"""WITH {_INDEX}, coll AS (SELECT name FROM strict_ix WHERE name <> '' GROUP BY name HAVING count(*) > 1),
pairs AS (SELECT DISTINCT a.name, a.cik AS a, b.cik AS b FROM strict_ix a JOIN strict_ix b ON a.name = b.name AND a.cik < b.cik JOIN issuers x ON x.cik = a.cik JOIN issuers y ON y.cik = b.cik AND x.issuer = y.issuer WHERE a.name <> '')
SELECT (SELECT count(*) FROM coll) AS colliding_names, count(DISTINCT name) AS suspect_names, count(*) AS suspect_pairs, coalesce(round(count(DISTINCT name)::DOUBLE / nullif((SELECT count(*) FROM coll), 0), 6), 0.0) AS suspect_name_rate FROM pairs""",
)
def contamination_bound(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    return collision.contamination_bound(collision.strict_index(p), collision.issuers_of(p))


@REG.add(
    "duplication_rates",
    f"""WITH {q.PEOPLE}, f AS (SELECT person_cik, issuer_cik, period, count(*) AS n FROM people GROUP BY ALL), r AS (SELECT person_cik, issuer_cik, sum(n) AS n, count(*) AS facts FROM f GROUP BY ALL)
SELECT round((sum(n) - sum(facts))::DOUBLE / sum(n), 6) AS repeat_filing_rate, round((sum(facts) - count(*))::DOUBLE / sum(n), 6) AS near_duplicate_rate FROM r""",
)
def duplication_rates(spark: SparkSession, d: str) -> DataFrame:
    return collision.duplication_rates(people(spark, d))


@REG.add("corpus_stats", f"WITH {q.PEOPLE} SELECT count(*) AS n_rows, count(DISTINCT person_cik) AS n_persons, count(DISTINCT issuer_cik) AS n_issuers, round(avg(CASE WHEN title_class = 'UNKNOWN' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS unknown_title_rate FROM people")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of distinct keys by folds of their own, which Spark would else expand row by row."""
    p = people(spark, d)
    one = p.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.when(F.col("title_class") == "UNKNOWN", 1.0).otherwise(0.0)), 6).alias("unknown_title_rate"))
    n = lambda c, a: p.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias(a))
    return one.crossJoin(F.broadcast(n("person_cik", "n_persons"))).crossJoin(F.broadcast(n("issuer_cik", "n_issuers"))).select("n_rows", "n_persons", "n_issuers", "unknown_title_rate")  # one row each


# --- tasks --------------------------------------------------------------------------------------------------------

_MOVERS = f"""{q.PEOPLE}, known AS (SELECT *, row_number() OVER (PARTITION BY person_cik ORDER BY period, filed NULLS FIRST, acc NULLS FIRST, issuer_cik, row_id) AS rn FROM people WHERE person_cik IS NOT NULL AND issuer_cik IS NOT NULL AND period IS NOT NULL),
a AS (SELECT * FROM known WHERE rn = 1),
l AS (SELECT k.person_cik, max(k.period) AS last_p FROM known k JOIN a ON a.person_cik = k.person_cik AND a.issuer_cik = k.issuer_cik GROUP BY 1),
t AS (SELECT k.* FROM known k JOIN a USING (person_cik) JOIN l USING (person_cik) WHERE k.issuer_cik <> a.issuer_cik AND k.period - a.period >= 180 AND k.period > l.last_p QUALIFY row_number() OVER (PARTITION BY k.person_cik ORDER BY k.rn) = 1),
z AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY person_cik ORDER BY rn DESC) = 1),
built AS (SELECT substr(sha256(a.person_cik || '|' || a.issuer_cik || '|' || t.issuer_cik || '|' || strftime(t.period, '%Y-%m-%d')), 1, 16) AS task_id, a.person_cik, a.person_name_raw, a.issuer_cik AS anchor_issuer_cik, t.issuer_cik AS truth_issuer_cik, t.acc AS truth_accession,
  t.period AS target, t.filed AS truth_filed, t.issuer_cik = z.issuer_cik AS last_employer, z.filed AS last_filed FROM a JOIN t USING (person_cik) JOIN z USING (person_cik))"""


def built_tasks(spark: SparkSession, d: str) -> DataFrame:
    return task_ops.as_tasks(task_ops.movers(people(spark, d)))


@REG.add("built_tasks", f"WITH {_MOVERS} SELECT task_id, person_cik, anchor_issuer_cik, truth_issuer_cik, truth_accession, strftime(target, '%Y-%m-%d') AS target_date, last_employer AS target_is_last_employer FROM built")
def built_tasks_(spark: SparkSession, d: str) -> DataFrame:
    return built_tasks(spark, d).select("task_id", "person_cik", "anchor_issuer_cik", "truth_issuer_cik", "truth_accession", F.date_format("target_date", "yyyy-MM-dd").alias("target_date"), "target_is_last_employer")


@REG.add("task_stats", f"WITH {_MOVERS} SELECT (SELECT count(DISTINCT person_cik) FROM people) AS people_total, count(*) AS n_tasks, round(count(*)::DOUBLE / (SELECT count(DISTINCT person_cik) FROM people), 6) AS retained_fraction FROM built")
def task_stats(spark: SparkSession, d: str) -> DataFrame:
    total = people(spark, d).where("person_cik IS NOT NULL").select("person_cik").distinct().agg(F.count(F.lit(1)).alias("people_total"))
    n = built_tasks(spark, d).agg(F.count(F.lit(1)).alias("n_tasks"))
    return total.crossJoin(F.broadcast(n)).withColumn("retained_fraction", F.coalesce(F.round(F.try_divide(F.col("n_tasks").cast("double"), F.col("people_total").cast("double")), 6), F.lit(0.0)))  # one row each


@REG.add(
    "restricted_tasks",
    rf"WITH {_MOVERS} SELECT task_id, date '2026-06-30' - truth_filed AS elapsed_days FROM built WHERE last_employer AND date '2026-06-30' - last_filed <= 3652.5 AND NOT coalesce(regexp_matches(person_name_raw, '{names.ENTITY}'), false)",
)
def restricted_tasks(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2026-06-30").cast("date")
    kept = task_ops.restricted(built_tasks(spark, d), as_of, 3652.5, names.is_entity("person_name_raw"))
    return kept.select("task_id", task_ops.elapsed_days(as_of, F.col("truth_filed")).cast("bigint").alias("elapsed_days"))


@REG.add("task_bands", f"WITH {TASKS_SQL} SELECT {q.band('collision_degree')} AS band, count(*) AS n_tasks FROM tasks GROUP BY 1")
def task_bands(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).groupBy(collision.band(F.col("collision_degree")).alias("band")).agg(F.count(F.lit(1)).alias("n_tasks"))


# --- splits -------------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN {0} < 15 THEN 'test' WHEN {0} < 30 THEN 'hillclimb' ELSE 'train' END"
_BP = f"({q.hex_int('sha256(' + chr(39) + '11|' + chr(39) + ' || person_cik)')} % 100)"


@REG.add("person_splits", f"WITH {q.PEOPLE} SELECT split, count(*) AS n_rows, count(DISTINCT person_cik) AS n_persons FROM (SELECT *, {_SPLIT.format(_BP)} AS split FROM people WHERE person_cik IS NOT NULL) GROUP BY split")
def person_splits(spark: SparkSession, d: str) -> DataFrame:
    """Rows and persons per split; persons are counted after they are folded to one row each."""
    per = people(spark, d).where("person_cik IS NOT NULL").groupBy("person_cik").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(splitting.split(F.col("person_cik")).alias("split")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_persons"))


@REG.add("train_task_splits", f"SELECT task_id, CASE WHEN b < 6 THEN 'train' WHEN b < 8 THEN 'hillclimb' ELSE 'test' END AS split FROM (SELECT task_id, {q.hex_int('task_id')} % 10 AS b FROM task)")
def train_task_splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task").select("task_id", splitting.task_split(F.col("task_id")).alias("split"))


@REG.add("leak_by_person", f"WITH {q.PEOPLE}, s AS (SELECT person_cik, {_SPLIT.format(_BP)} AS split FROM people WHERE person_cik IS NOT NULL) SELECT coalesce(round(avg(CASE WHEN person_cik IN (SELECT person_cik FROM s WHERE split = 'train') THEN 1.0 ELSE 0.0 END)::DOUBLE, 6), 0.0) AS leak_rate FROM s WHERE split <> 'train'")
def leak_by_person(spark: SparkSession, d: str) -> DataFrame:
    """What a split by person leaks between persons: nothing."""
    p = people(spark, d).where("person_cik IS NOT NULL").withColumn("split", splitting.split(F.col("person_cik")))
    return splitting.leak_rate(p.where("split = 'train'"), p.where("split <> 'train'"), "person_cik")


_BR = f"({q.hex_int('sha256(' + chr(39) + '11|' + chr(39) + ' || row_id)')} % 100)"


@REG.add("leak_by_row", f"WITH {q.PEOPLE}, s AS (SELECT person_cik, {_SPLIT.format(_BR)} AS split FROM people WHERE person_cik IS NOT NULL) SELECT coalesce(round(avg(CASE WHEN person_cik IN (SELECT person_cik FROM s WHERE split = 'train') THEN 1.0 ELSE 0.0 END)::DOUBLE, 6), 0.0) AS leak_rate FROM s WHERE split <> 'train'")
def leak_by_row(spark: SparkSession, d: str) -> DataFrame:
    """What a split by row leaks: the probe's other side, which must not be 0."""
    p = people(spark, d).where("person_cik IS NOT NULL").withColumn("split", splitting.split(F.col("row_id")))
    return splitting.leak_rate(p.where("split = 'train'"), p.where("split <> 'train'"), "person_cik")


# --- sinks' shapes ------------------------------------------------------------------------------------------------


@REG.add("public_rows", f"WITH {_DEG} SELECT d.row_id, sha256('public-salt|' || {q.strict('a.person_name_raw')}) AS name_hash, d.collision_degree, d.strict_degree, {q.band('d.collision_degree')} AS band FROM deg d JOIN attested_tuple a USING (row_id)")
def public_rows(spark: SparkSession, d: str) -> DataFrame:
    """The pointer form that may be published: no names, a salted hash in their place."""
    rows = collision.with_degrees(people(spark, d))
    return rows.select("row_id", splitting.name_hash("public-salt", names.strict_name("person_name_raw")).alias("name_hash"), "collision_degree", "strict_degree", "band")


@REG.add("resolution_lists", f"WITH {_INDEX}, c AS (SELECT name, cik, (row_number() OVER (PARTITION BY name ORDER BY cik) - 1) // 50 AS chunk FROM (SELECT DISTINCT name, cik FROM presented_ix WHERE name <> '')) SELECT name, array_to_string(list_sort(list(cik)), ',') AS ciks FROM c GROUP BY name, chunk")
def resolution_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its sorted ids, in list form; a name of more than fifty ids has a row for every fifty of them."""
    ix = collision.presented_index(people(spark, d)).where("name <> ''")
    chunk = F.floor((F.row_number().over(Window.partitionBy("name").orderBy("cik")) - 1) / 50)  # a hot name's sort may spill
    return ix.select("name", "cik", chunk.alias("chunk")).groupBy("name", "chunk").agg(F.array_join(F.array_sort(F.collect_set("cik")).cast("array<string>"), ",").alias("ciks")).select("name", "ciks")


@REG.add("task_ids", f"WITH {TASKS_SQL} SELECT task_id, sha256(person_cik || '|' || anchor_issuer_cik || '|' || truth_issuer_cik || '|' || strftime(target_date, '%Y-%m-%d'))[1:16] AS rebuilt FROM tasks")
def task_ids(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).select("task_id", task_ops.task_id(F.col("person_cik"), F.col("anchor_issuer_cik"), F.col("truth_issuer_cik"), F.col("target_date")).alias("rebuilt"))


@REG.add("task_sample", "SELECT task_id FROM task ORDER BY sha256('11|' || task_id), task_id LIMIT 50")
def task_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty tasks by hash order; the size is the operator's parameter."""
    return sampling.sample(table(spark, d, "task").select("task_id"), "task_id", 50)


_STRATA = "{0} r AS (SELECT task_id, s, row_number() OVER (PARTITION BY s ORDER BY sha256('11|' || task_id), task_id) AS rn FROM x) SELECT task_id, s AS stratum FROM r WHERE rn <= greatest(1, 60 // (SELECT count(DISTINCT s) FROM x))"


@REG.add("band_sample", _STRATA.format(f"WITH {TASKS_SQL}, x AS (SELECT task_id, {q.band('collision_degree')} AS s FROM tasks),"))
def band_sample(spark: SparkSession, d: str) -> DataFrame:
    x = tasks(spark, d).select("task_id", collision.band(F.col("collision_degree")).alias("stratum"))
    return sampling.stratified(x, "task_id", "stratum", 60)


_ELAPSED = "CASE WHEN e < 90 THEN 0 WHEN e < 365 THEN 1 WHEN e < 1095 THEN 2 WHEN e < 2555 THEN 3 ELSE 4 END"


@REG.add("elapsed_sample", _STRATA.format(f"WITH x AS (SELECT task_id, {_ELAPSED} AS s FROM (SELECT task_id, date '2026-06-30' - truth_filed AS e FROM task)),"))
def elapsed_sample(spark: SparkSession, d: str) -> DataFrame:
    e = F.date_diff(F.lit("2026-06-30").cast("date"), F.col("truth_filed"))
    s = F.when(e < 90, 0).when(e < 365, 1).when(e < 1095, 2).when(e < 2555, 3).otherwise(4)
    return sampling.stratified(table(spark, d, "task").select("task_id", s.alias("stratum")), "task_id", "stratum", 60)


@REG.add("shuffled_arms", "SELECT task_id, arm, row_number() OVER (ORDER BY sha256('11|' || task_id || '|' || arm), task_id, arm) AS place FROM (SELECT task_id, unnest(['alpha', 'beta', 'gamma']) AS arm FROM (SELECT task_id FROM task ORDER BY sha256('11|' || task_id), task_id LIMIT 50))")
def shuffled_arms(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a sample in hash order, arms interleaved; the sample's size bounds the sort."""
    from pyspark.sql import Window

    calls = task_sample(spark, d).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ("alpha", "beta", "gamma")])))
    return calls.withColumn("place", F.row_number().over(Window.orderBy(sampling.draw(11, F.col("task_id"), F.col("arm")), "task_id", "arm")))


@REG.add("request_digests", "SELECT task_id, sha256('alpha|answer|' || person_name_raw || '|2026-06') AS digest FROM task")
def request_digests(spark: SparkSession, d: str) -> DataFrame:
    """Keys of requests; a task without a name has no request and no key."""
    key = sha_key(F.lit("alpha"), F.lit("answer"), F.col("person_name_raw"), F.lit("2026-06"))
    return table(spark, d, "task").select("task_id", F.when(F.col("person_name_raw").isNotNull(), key).alias("digest"))
