"""Archives, paged sources, sinks, streams, the corpus plan and the registry."""

import zipfile

import pytest

import __spark_entry__ as entry
from attestry.plans.corpus import build
from attestry.sources import archives, stores
from attestry.sources.pages import PagedSource
from tests.test_rejects import GOOD, own, sub


def pager(cursor):
    pages = {"*": ([(1, "a"), (2, "b")], "n"), "n": ([(3, "c")], None)}
    return pages[cursor]


def archive(folder):
    with zipfile.ZipFile(folder / "2024q3.zip", "w") as z:
        z.writestr("x/submission.TSV", "\n".join(["HEAD", sub(accession_number="01", issuercik="7", issuername="Acme", **GOOD), sub(accession_number="02", issuercik="8", issuername="Beta", filing_date="x", period_of_report="y")]))
        z.writestr("ReportingOwner.tsv", "\r\n".join(["HEAD", own(accession_number="01", rptownercik="5", rptownername="A B", rptowner_relationship="Director"), own(accession_number="09", rptownercik="6", rptowner_relationship="Officer")]))


def test_archive_to_corpus(spark, tmp_path):
    archive(tmp_path)
    c = build(spark, str(tmp_path))
    assert {r["reason"] for r in c.rejected.collect()} == {"unparseable_date"}
    assert [(r["person_cik"], r["issuer_name_raw"]) for r in c.attested.collect()] == [("5", "Acme")]
    counts = c.counts.first()
    assert (counts["input_rows"], counts["kept"], counts["unjoined_accession"]) == (2, 1, 1)
    assert c.tasks.count() == 0


def test_a_missing_member_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("SUBMISSION.tsv", "x")
    with pytest.raises(Exception, match="REPORTINGOWNER"):
        archives.archive_lines(spark, str(tmp_path)).collect()


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged").schema("id bigint, name string").option("pager", "tests.test_feeds:pager")
    assert sorted(r["id"] for r in read.load().collect()) == [1, 2, 3]
    assert read.option("most", "2").load().count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a bigint, phone string")
    with pytest.raises(ValueError):
        stores.write_parquet(df, str(tmp_path / "p"))
    stores.write_parquet(spark.range(10), str(tmp_path / "p"), rows_per_file=3)
    assert len(list((tmp_path / "p").glob("*.parquet"))) >= 4 and spark.read.parquet(str(tmp_path / "p")).count() == 10
    stores.write_report(spark.range(2), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.json"))) == 1


def test_registry():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) > 90
    for n in ("p1_found", "p3_found", "p4_found"):
        assert n in sqls


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "kept" in df.columns


def echo(action, request):
    return f"{action}:{request}"


def test_providers_refuse_without_a_transport(spark):
    from attestry.sources.providers import NotConfigured, Provider, ask

    rows = spark.createDataFrame([(1, "q"), (2, None)], "id bigint, request string")
    with pytest.raises(NotConfigured):
        ask(rows, Provider("p", (("answer", 0.005),)), "answer")
    with pytest.raises(ValueError):
        ask(rows, Provider("p", (("answer", 0.005),), echo), "other")
    assert {r["id"]: r["body"] for r in ask(rows, Provider("p", (("answer", 0.005),), echo), "answer").collect()} == {1: "answer:q", 2: None}
