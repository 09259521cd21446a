"""Ingest, collisions, tasks and splits on small populations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestry.operators import collision, ingest, splitting, tasks

SUB = "sub_id bigint, arrived_at timestamp, accession_number string, filing_date string, period_of_report string, issuercik string, issuername string, issuertradingsymbol string"
OWN = "owner_id bigint, archive string, accession_number string, rptownercik string, rptownername string, rptowner_relationship string, rptowner_title string, rptowner_city string"
T = dt.datetime(2020, 1, 1)


def filings(spark):
    subs = [("a1", "10-MAR-2010", "09-MAR-2010"), ("a2", "bad", "09-MAR-2010"), ("a3", "10-MAR-2010", "11-MAR-2010"), ("a4", "10-MAR-2001", "09-MAR-2001")]
    s = spark.createDataFrame([(i, T, f"000{i}", f, p, "7", "Acme", "ACM") for i, (_, f, p) in enumerate(subs, 1)] + [(9, T + dt.timedelta(1), "0001", "12-MAR-2010", "09-MAR-2010", "8", "Late", "L")], SUB)
    rows = [("0001", "5", "Director", "CEO"), ("0001", "6", "TenPercentOwner", ""), ("0001", "7", "Other", ""), ("0001", "x", "Officer", ""), ("0002", "8", "Officer", ""), ("0003", "8", "Officer", ""), ("0004", "8", "Officer", ""), ("0099", "8", "Officer", ""), (None, "8", "Officer", ""), ("00-01", "9", "Wizard", None), ("0001", "10", "Director,Officer", "boss")]
    o = spark.createDataFrame([(i, "q", a, c, f"N{i}", r, t, "town") for i, (a, c, r, t) in enumerate(rows)], OWN)
    return ingest.judged(o, s)


def test_every_rule_fires_and_counts_reconcile(spark):
    c = ingest.reconciles(ingest.exclusion_counts(filings(spark), ["archive"])).first().asDict()
    assert c == {"archive": "q", "input_rows": 11, "kept": 2, "unjoined_accession": 2, "ten_percent_owner_only": 1, "no_officer_or_director": 2, "bad_person_cik": 1, "unparseable_date": 1, "period_after_filed": 1, "quarter_before_2003q3": 1, "unknown_relationship_token": 1, "title_unknown": 1}


def test_last_arrival_wins_and_contacts_are_gone(spark):
    rows = filings(spark)
    assert {r["issuer_name_raw"] for r in ingest.attested(rows).collect()} == {"Late"}
    assert not set(rows.columns) & set(ingest.CONTACT_COLUMNS)


def test_counts_that_do_not_add_up_fail(spark):
    c = ingest.exclusion_counts(filings(spark), ["archive"]).withColumn("kept", F.lit(5))
    with pytest.raises(Exception, match="add up"):
        ingest.reconciles(c).collect()


PEOPLE = "row_id bigint, person_cik bigint, person_name_raw string, issuer_cik bigint, issuer_name_raw string, title_class string, period date, filed date, acc string"


def people(spark, rows):
    return spark.createDataFrame([(i, p, n, c, f"I{c}", "CEO", d, d, str(i)) for i, (p, n, c, d) in enumerate(rows)], PEOPLE)


def day(n):
    return dt.date(2010, 1, 1) + dt.timedelta(n)


def test_degrees_and_contamination(spark):
    p = people(spark, [(1, "SMITH JOHN", 5, day(0)), (2, "JOHN SMITH", 5, day(0)), (3, "Smith, John Q", 6, day(0)), (4, "", 6, day(0)), (4, None, 6, day(0))])
    got = {r["row_id"]: (r["collision_degree"], r["strict_degree"], r["band"]) for r in collision.with_degrees(p).collect()}
    assert got == {0: (3, 2, "low"), 1: (3, 2, "low"), 2: (3, 1, "low"), 3: (0, 0, "unique"), 4: (0, 0, "unique")}
    bound = collision.contamination_bound(collision.strict_index(p), collision.issuers_of(p)).first()
    assert tuple(bound) == (1, 1, 1, 1.0)
    empty = collision.contamination_bound(collision.strict_index(p.where("false")), collision.issuers_of(p.where("false"))).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_duplication(spark):
    p = people(spark, [(1, "a", 5, day(0)), (1, "a", 5, day(0)), (1, "a", 5, day(9)), (1, "a", 6, day(9))])
    assert tuple(collision.duplication_rates(p).first()) == (0.25, 0.25)
    assert tuple(collision.duplication_rates(p.where("false")).first()) == (0.0, 0.0)


def test_moves(spark):
    rows = [(1, "a", 5, day(0)), (1, "a", 6, day(19)), (1, "a", 6, day(200)), (2, "b", 5, day(0)), (2, "b", 5, day(400)), (2, "b", 6, day(300)), (3, "c", 5, day(0)), (4, "d", 5, day(0)), (4, "d", 7, day(181)), (4, "d", 8, day(190)), (None, "e", 1, day(0)), (5, "f", None, day(0))]
    got = {r["person_cik"]: (r["anchor_issuer_cik"], r["truth_issuer_cik"], (r["target_date"] - day(0)).days, r["target_is_last_employer"]) for r in tasks.as_tasks(tasks.movers(people(spark, rows))).collect()}
    assert got == {1: (5, 6, 200, True), 4: (5, 7, 181, False)}  # 2 sat on both boards


def test_splits_and_leaks(spark):
    p = people(spark, [(i % 400, "x", 1, day(i)) for i in range(2000)]).withColumn("s", splitting.split(F.col("person_cik")))
    assert splitting.leak_rate(p.where("s = 'train'"), p.where("s <> 'train'"), "person_cik").first()[0] == 0.0
    assert splitting.leak_rate(p, p, "person_cik").first()[0] == 1.0
    assert splitting.leak_rate(p, p.where("false"), "person_cik").first()[0] == 0.0
    share = {r["s"]: r["count"] / 2000 for r in p.groupBy("s").count().collect()}
    assert abs(share["train"] - 0.7) < 0.08
    with pytest.raises(ValueError):
        splitting.name_hash("", F.lit("x"))


def test_resolution_lists_hold_every_name(spark, monkeypatch):
    from attestry.queries import corpus

    ids = [("hot", i) for i in range(120)] + [("one", 500), ("two", 501), ("two", 502)]
    monkeypatch.setattr(corpus, "people", lambda spark, d: None)
    monkeypatch.setattr(collision, "presented_index", lambda rows: spark.createDataFrame(ids, "name string, cik bigint"))
    got = [(r["name"], [int(x) for x in r["ciks"].split(",")]) for r in corpus.resolution_lists(spark, "").collect()]
    assert sorted((n, c) for n, cs in got for c in cs) == sorted(ids) and max(len(cs) for _, cs in got) == 50 and ("two", [501, 502]) in got
