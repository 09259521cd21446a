"""Normal forms, titles, dates, keys and intervals."""

import json
import math

import pytest
from pyspark.sql import functions as F

from attestry.functions import answers, names, stats
from attestry.functions.dates import parse_date
from attestry.functions.keys import digits, number
from attestry.functions.titles import title_class
from attestry.operators.simulate import LinearPolicy


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "strict", "presented"),
    [
        ("O'BRIEN JOHN A", "a john obrien", "john obrien"), ("Smith, John Jr.", "john smith", "john smith"), ("SMITH JOHN V", "john smith v", "john smith"),
        ("José Núñez", "josé núñez", "josé núñez"), ("SMITH-JONES ANN M.D.", "ann smithjones", "ann smithjones"), ("", "", ""), (None, "", ""), (" Doe\tJane ", "doe jane", "doe jane"),
    ],
)
def test_person_forms(spark, raw, strict, presented):
    x = F.lit(raw).cast("string")
    assert one(spark, names.strict_name(x)) == strict
    assert one(spark, names.presented_name(x)) == presented


@pytest.mark.parametrize(("raw", "form"), [("Microsoft Corporation", "microsoft"), ("The Group Inc", "the group inc"), ("A.C. Foods & Co", "ac foods"), (None, "")])
def test_company_form(spark, raw, form):
    assert one(spark, names.company_name(F.lit(raw).cast("string"))) == form


@pytest.mark.parametrize(("raw", "asked"), [("REYES GEORGE", "George Reyes"), ("Van Dorn Kristin Lea", "Kristin Van Dorn"), ("KELLY NIMA P JR", "Nima Kelly"), ("MADONNA", "Madonna"), ("VAN DER", "Der Van"), (None, "")])
def test_query_name(spark, raw, asked):
    assert one(spark, names.query_name(F.lit(raw).cast("string"))) == asked


@pytest.mark.parametrize(("raw", "entity"), [("Acme Holdings", True), ("Northern V L.P.", True), ("HOLDING FRANK B JR", False), ("TRUST MARTIN", False), ("Foo Inc.", True), (None, False)])
def test_entity(spark, raw, entity):
    assert one(spark, names.is_entity(F.lit(raw).cast("string"))) is entity


@pytest.mark.parametrize(
    ("raw", "cls"),
    [
        ("President and CEO", "CEO"), ("C.E.O.", "CEO"), ("Chief Exec. Officer", "CEO"), ("Senior Vice President", "OFFICER_OTHER"), ("President", "PRESIDENT"), ("Vice Chairman", "OFFICER_OTHER"),
        ("Chairman of the Board", "CHAIR"), ("Chair, Audit Committee", "UNKNOWN"), ("General Counsel", "GC_LEGAL"), ("Chief Investment Officer", "OFFICER_OTHER"), ("CTO", "CTO_CIO"), ("Treasurer", "OFFICER_OTHER"),
        ("Founder", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("Principal Financial and Accounting Officer", "CFO"), ("chief operating officer", "COO"),
    ],
)
def test_title_class(spark, raw, cls):
    assert one(spark, title_class(F.lit(raw).cast("string"))) == cls


@pytest.mark.parametrize(("raw", "day"), [("23-APR-2024", "2024-04-23"), ("2-jun-2024", "2024-06-02"), ("2024-4-3", "2024-04-03"), ("4/3/2024", "2024-04-03"), ("23APR2024", "2024-04-23"), (" 20240403 ", "2024-04-03"), ("31-FEB-2020", None), ("see remarks", None), ("", None), (None, None), ("23-APR-24", None)])
def test_parse_date(spark, raw, day):
    got = one(spark, parse_date(F.lit(raw).cast("string")))
    assert (got.isoformat() if got else None) == day


def test_keys(spark):
    assert one(spark, digits(F.lit(" 0001-23-4 "))) == "0001234"
    assert one(spark, digits(F.lit("  "))) is None and one(spark, digits(F.lit("n/a"))) is None
    assert one(spark, number(F.lit("0000012 "))) == 12
    assert one(spark, number(F.lit("1e3"))) is None and one(spark, number(F.lit(None).cast("string"))) is None


def test_wilson_golden(spark):
    w = one(spark, stats.wilson(F.lit(3), F.lit(50)))
    assert math.isclose(w["lo"], 0.0206154, abs_tol=1e-6) and math.isclose(w["hi"], 0.1621712, abs_tol=1e-6)
    empty = one(spark, stats.wilson(F.lit(0), F.lit(0)))
    assert (empty["point"], empty["lo"], empty["hi"], empty["n"]) == (None, 0.0, 1.0, 0)


@pytest.mark.parametrize(("half", "n"), [(0.14, 25), (0.10, 49), (0.07, 100), (0.05, 196), (0.035, 400)])
def test_required_n(spark, half, n):
    assert one(spark, stats.required_n(F.lit(0.15), F.lit(half))) == n


def test_affordable_is_float_safe(spark):
    assert one(spark, stats.affordable_n(F.lit(0.3), F.lit(0.1))) == 3


def test_page_titles_and_filters(spark):
    assert tuple(one(spark, names.page_title(F.lit("Ada B - CEO - Acme | LinkedIn")))) == ("Ada B", "Acme", "CEO")
    assert tuple(one(spark, names.page_title(F.lit("Ada B - CEO")))) == ("Ada B", None, "CEO")
    assert tuple(one(spark, names.page_title(F.lit("Ada B")))) == ("Ada B", None, None)
    assert one(spark, names.company_filter(F.lit("GOOGLE INC."))) == "Google"
    assert one(spark, names.company_filter(F.lit("Inc"))) == "Inc"
    assert one(spark, names.name_in_title(F.lit("Geoff B, CEO at T"))) == "Geoff B"


def test_answer_parsing(spark):
    prose = '{"answer": "She works there."}'
    assert one(spark, answers.parse_answer(F.lit(prose))) is None
    got = one(spark, answers.parse_answer(F.lit('{"answer": "{\\"person_name\\": \\"A\\", \\"organisation\\": \\"\\", \\"confidence\\": 7}"}')))
    assert (got["person_name"], got["employer_name"], got["confidence"]) == ("A", None, 1.0)
    assert tuple(one(spark, answers.parse_verdict(F.lit('{"answer": "{\\"affirms\\": true, \\"confidence\\": 0.25}"}')))) == (True, 0.25)
    assert tuple(one(spark, answers.parse_verdict(F.lit('{"answer": "{\\"affirms\\": \\"true\\", \\"confidence\\": 0.25}"}')))) == (None, 0.0)
    assert tuple(one(spark, answers.parse_verdict(F.lit(prose)))) == (None, 0.0)
    assert [r["rank"] for r in one(spark, answers.parse_search(F.lit('{"data": {"results": [{"title": "A, B"}, {"title": "C - D"}]}}')))] == [0, 1]
    assert tuple(one(spark, answers.spend_reported(F.lit('{"meta": {"credits_charged": 0}}'), "$.meta.credits_charged", 0.01, 0.5))) == (0.0, "reported")


def test_every_contact_key_goes(spark):
    keys = "email work_email personal_email emails phone mobile_phone phone_number phones address street street1 street2 city postal_code zip linkedin_url linkedin twitter x_url github_url facebook social socials profile_url url urls evidence_links date_of_birth dob age".split()
    more = ["home_address", "Employer_Phone_Number", "EMAIL2", "birthplace", "postal", "URL"]
    assert all(answers.is_contact(k) for k in keys + more)
    assert not any(answers.is_contact(k) for k in ("name", "title", "company", "organisation", "page", "label", "start_date"))
    body = json.dumps({k: "SENTINEL" for k in keys + more} | {"kept": [{k: "SENTINEL" for k in keys} | {"n": 1}]})
    assert one(spark, answers.strip_contact_json(F.lit(body))) == '{"kept": [{"n": 1}]}'
    df = spark.range(1).select(*[F.lit("x").alias(k) for k in keys], F.struct(*[F.lit("x").alias(k) for k in keys]).alias("deep"))
    assert answers.forbidden_fields(df.schema) == [*keys, *[f"deep.{k}" for k in keys]]
    mapped = spark.range(1).select(F.create_map(*[F.lit(x) for k in [*keys, "kept"] for x in (k, "v")]).alias("m"))
    assert mapped.select(answers.without_contact(mapped.schema["m"].dataType, F.col("m")).alias("m")).first()["m"] == {"kept": "v"}


def test_contact_fields_go(spark):
    df = spark.sql("SELECT named_struct('email', 'x', 'deep', array(named_struct('home_phone', 1, 'kept', 2))) AS s")
    kept = df.select(answers.without_contact(df.schema["s"].dataType, F.col("s")).alias("s"))
    assert kept.first()["s"].asDict(True) == {"deep": [{"kept": 2}]}
    assert answers.forbidden_fields(df.schema) == ["s.email", "s.deep.home_phone"]
    assert answers.forbidden_fields(kept.schema) == []
    assert one(spark, answers.strip_contact_json(F.lit('{"a": 1, "Email": 2, "b": [{"postal_x": 1}]}'))) == '{"a": 1, "b": [{}]}'
    assert one(spark, answers.strip_contact_json(F.lit("no json"))) is None


def test_pii_and_billing(spark):
    assert one(spark, answers.pii(F.lit("write to a.b@c.org"))) and one(spark, answers.pii(F.lit("call (555) 123-4567"))) and not one(spark, answers.pii(F.lit("123,456 shares")))
    assert one(spark, answers.billing_provider(F.lit("fast_full"), ("fast", "fast_full"))) == "fast_full"
    assert one(spark, answers.billing_provider(F.lit("fastest"), ("fast",))) == "fastest"


def test_policy_learns_what_it_is_shown():
    p = LinearPolicy()
    for _ in range(50):
        p.learn([1.0] + [0.0] * 9, 3, 1.0, 0.5)
    assert p.pick([1.0] + [0.0] * 9) == 3 and abs(sum(p.shares([1.0] + [0.0] * 9)) - 1) < 1e-9
