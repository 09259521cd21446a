"""Reject parsing: structure before values, every reason, degenerate lines."""

import pytest

from attestry.operators import rejects as r

S, O = r.LAYOUTS["SUBMISSION.TSV"], r.LAYOUTS["REPORTINGOWNER.TSV"]


def sub(**v):
    return "\t".join(v.get(c, "") for c in S.columns)


def own(**v):
    return "\t".join(v.get(c, "") for c in O.columns)


GOOD = {"filing_date": "29-AUG-2024", "period_of_report": "2024-8-1"}


@pytest.mark.parametrize(
    ("line", "reasons"),
    [
        (sub(**GOOD), []), (sub(**GOOD) + "\r", []), (sub(**GOOD, remarks='"a\tb"'), []), (sub(**GOOD, remarks='"a ""b"""'), []), (sub(**GOOD, remarks='say "x"'), []), (sub(**GOOD, remarks='""'), []),
        (sub(**GOOD, remarks='"open'), ["quoting"]), (sub(**GOOD, remarks='"a" b'), ["quoting"]), (sub(**GOOD, remarks='"a""'), ["quoting"]), (sub(**GOOD) + "\tx", ["column_count"]), ("", ["column_count"]), (None, ["column_count"]),
        (sub(filing_date="31-FEB-2020", period_of_report=" 20240101 "), ["unparseable_date"]), (sub(filing_date="", period_of_report=""), ["unparseable_date"]), (sub(**GOOD, remarks="a\rb\nc"), []),
    ],
)
def test_submission_lines(line, reasons):
    fields, got = r.parse_record(line, S)
    assert got == reasons and (fields is None) == bool(reasons)


@pytest.mark.parametrize(
    ("values", "reasons"),
    [
        ({"rptownercik": " 123 ", "rptowner_relationship": "Director , Ten Percent-Owner"}, []), ({"rptownercik": "12a"}, ["bad_person_cik"]), ({"rptownercik": "１２"}, ["bad_person_cik"]),
        ({"rptownercik": "", "rptowner_relationship": "Trustee"}, ["bad_person_cik", "unknown_relationship_token"]), ({"rptownercik": "1", "rptowner_relationship": "Trustee,Officer"}, []), ({"rptownercik": "1", "rptowner_relationship": " , "}, ["unknown_relationship_token"]),
    ],
)
def test_owner_lines(values, reasons):
    assert r.parse_record(own(**values), O)[1] == reasons


def test_text_is_kept_whole():
    fields, _ = r.parse_record(sub(**GOOD, remarks='"tab\tand ""quote"" and\nline"', issuername="x" * 300_000), S)
    assert fields[12] == 'tab\tand "quote" and\nline' and len(fields[10]) == 300_000
    assert r.parse_record("x", None) == (None, ["column_count"])


def test_assemble_is_quote_aware():
    records = lambda text: list(r.assemble(text.split("\n") if text else []))
    assert records('a\tb\n"x\ny"\tz\nlast') == ["a\tb", '"x\ny"\tz', "last"]
    assert records('it"s\nfine') == ['it"s', "fine"]
    assert records('"a""\n"\n\nb') == ['"a""\n"', "", "b"]
    assert records("") == []


def test_an_unclosed_quote_costs_one_record(monkeypatch):
    good = [sub(**GOOD, issuername=f"n{i}", remarks='"a\tb"' if i % 3 else "") for i in range(1000)]
    whole = sub(**GOOD, remarks='"two\nlines"')
    lines = ["HEADER", sub(**GOOD, remarks='"open'), *good[:500], *whole.split("\n"), *good[500:], sub(**GOOD, remarks='"open')]
    want = ["HEADER", lines[1], *good[:500], whole, *good[500:], lines[-1]]
    assert list(r.assemble(iter(lines), S)) == want
    assert [r.parse_record(x, S)[1] for x in want if x != "HEADER"].count(["quoting"]) == 2
    monkeypatch.setattr(r, "LOOK_AHEAD", 3)
    assert list(r.assemble(['"a', "b" * 9, 'c"'])) == ['"a', "b" * 9, 'c"']


def test_frames_add_up(spark):
    rows = [(1, "A", "SUBMISSION.tsv", 1, "HEADER", 0), (2, "A", "SUBMISSION.tsv", 2, sub(**GOOD), 0), (3, "A", "SUBMISSION.tsv", 3, "x", 0), (4, "A", "REPORTINGOWNER.tsv", 2, own(rptownercik="x", rptowner_relationship="y"), 0), (5, None, "other.txt", None, "z", 0), (6, "A", None, 9, None, 0)]
    lines = spark.createDataFrame(rows, "line_id bigint, archive string, member_file string, line_no int, raw_text string, reasons int")
    parsed = r.parse_lines(lines)
    assert sorted((x["line_id"], x["reason"]) for x in r.rejects(parsed).collect()) == [(3, "column_count"), (4, "bad_person_cik"), (4, "unknown_relationship_token"), (5, "column_count"), (6, "column_count")]
    assert all(x["input_rows"] == x["loaded"] + x["rejected"] for x in r.reject_counts(parsed).collect())
    loaded = r.loadable(parsed, "SUBMISSION.tsv").collect()
    assert [(x["line_id"], x["filing_date"]) for x in loaded] == [(2, "2024-08-29")]
    assert r.parse_lines(lines.where("false")).count() == 0
