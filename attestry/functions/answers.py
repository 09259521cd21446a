"""Provider answers: requests, parsed replies, spend, contact fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.names import company_filter, name_in_title, query_name

# Contact keys, substrings that mark one, and the question that requests end with.
CONTACT_KEYS = frozenset(
    "email work_email personal_email emails phone mobile_phone phone_number phones address street street1 street2 city postal_code zip "
    "linkedin_url linkedin twitter x_url github_url facebook social socials profile_url url urls evidence_links date_of_birth dob age".split()
)
CONTACT_PARTS = ("email", "phone", "address", "postal", "birth")
QUESTION = "What organisation are they at most recently, and in what role? Answer for their latest known position."
CONFIDENCE = " Give your confidence as a number between 0 and 1."


def employment_prompt(name: Column, employer: Column, at: Column) -> Column:
    """The task as asked, in its fixed wording; the anchor's title is withheld, as titles outlast a move."""
    return F.concat(name, F.lit(" was an officer or director at "), employer, F.lit(" as of "), F.date_format(at, "yyyy-MM-dd"), F.lit(f". {QUESTION}"))


def expertise_prompt(name: Column, institution: Column, topic: Column) -> Column:
    return F.concat(F.lit("Has "), name, F.lit(" of "), institution, F.lit(" published research in "), topic, F.lit("? Answer yes or no."), F.lit(CONFIDENCE))


def arm_requests(name: str, employer: str, at: str, title_class: str) -> dict[str, Column]:
    """The arms of rising disclosure, as request text or JSON."""
    who, firm = query_name(name), company_filter(employer)
    tail = F.lit(f". {QUESTION}{CONFIDENCE}")
    return {
        "name_only": F.concat(who, tail),
        "anchor_freetext": F.concat(who, F.lit(", who previously worked at "), firm, tail),
        "full_context": F.concat(who, F.lit(" was an officer or director at "), F.col(employer), F.lit(" as of "), F.date_format(at, "yyyy-MM-dd"), F.lit(", with the role "), F.col(title_class), tail),
        "index_name_only": F.to_json(F.struct(who.alias("query"))),
        "index_company_filter": F.to_json(F.struct(who.alias("query"), F.struct(firm.alias("company")).alias("filters"))),
        "index_bare": F.to_json(F.struct(F.trim(F.concat_ws(" ", who, firm)).alias("query"))),
    }


def clamped(c: Column) -> Column:
    """A stated confidence within [0, 1]; none or no number is 0."""
    return F.coalesce(F.least(F.greatest(c.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def parse_answer(body: Column) -> Column:
    """struct of a structured reply, whose answer is an object or a JSON text of one; NULL for prose."""
    raw = F.coalesce(F.get_json_object(body, "$.answer"), F.lit(""))
    inner = F.from_json(raw, "person_name string, organisation string, role string, confidence string")
    ok = raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull()
    return F.when(ok, F.struct(F.nullif(inner["person_name"], F.lit("")).alias("person_name"), F.nullif(inner["organisation"], F.lit("")).alias("employer_name"), F.nullif(inner["role"], F.lit("")).alias("title_text"), clamped(inner["confidence"]).alias("confidence"), F.lit(0).alias("rank")))


def parse_verdict(body: Column) -> Column:
    """struct(affirms, confidence); affirms is NULL unless the reply holds a JSON boolean."""
    raw = F.coalesce(F.get_json_object(body, "$.answer"), F.lit(""))
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.try_variant_get(value, "$.affirms", "variant"))
    affirms = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$.affirms", "boolean"))
    return F.struct(affirms.alias("affirms"), F.when(affirms.isNotNull(), clamped(F.try_variant_get(value, "$.confidence", "string"))).otherwise(F.lit(0.0)).alias("confidence"))


def parse_search(body: Column) -> Column:
    """Array of result rows, of either envelope, with rank."""
    result = "array<struct<title string, score double, person: struct<title string, company string, resolution_source string, identity_verified boolean>>>".replace("title string", "title: string").replace("score double", "score: double").replace("company string", "company: string").replace("resolution_source string", "resolution_source: string").replace("identity_verified boolean", "identity_verified: boolean")
    inner, outer = F.from_json(F.get_json_object(body, "$.data.results"), result), F.from_json(F.get_json_object(body, "$.results"), result)
    rows = F.coalesce(F.when(F.size(inner) > 0, inner), outer, F.array().cast(result))
    return F.transform(rows, lambda r, i: F.struct(name_in_title(r["title"]).alias("person_name"), r["person"]["company"].alias("employer_name"), r["person"]["title"].alias("title_text"), F.coalesce(r["score"], F.lit(0.0)).alias("confidence"), i.alias("rank")))


def spend_reported(body: Column, path: str, unit_usd: float, fallback_usd: float) -> Column:
    """struct(usd, unit): the reply's own figure times a unit's price, else the list price, marked as an estimate."""
    said = F.get_json_object(body, path).try_cast("double")
    return F.struct(F.coalesce(said * unit_usd, F.lit(fallback_usd)).alias("usd"), F.when(said.isNotNull(), "reported").otherwise("list_price_estimate").alias("unit"))


def is_contact(key: str) -> bool:
    key = key.lower()
    return key in CONTACT_KEYS or any(p in key for p in CONTACT_PARTS)


def without_contact(dtype: T.DataType, c: Column) -> Column:
    """A typed value rebuilt without contact fields, at any depth; stays in the JVM."""
    if isinstance(dtype, T.StructType):
        kept = [without_contact(f.dataType, c[f.name]).alias(f.name) for f in dtype.fields if not is_contact(f.name)]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: without_contact(dtype.elementType, x))
    if isinstance(dtype, T.MapType):
        plain = F.map_filter(c, lambda k, _: ~F.lower(k).isin(*CONTACT_KEYS) & ~F.lower(k).rlike("|".join(CONTACT_PARTS)))
        return F.transform_values(plain, lambda _, v: without_contact(dtype.valueType, v))
    return c


def _stripped(value: object) -> object:
    if isinstance(value, dict):
        return {k: _stripped(v) for k, v in value.items() if not is_contact(str(k))}
    return [_stripped(v) for v in value] if isinstance(value, list) else value


def strip_contact_json(c: Column) -> Column:
    """JSON text without contact keys, for bodies of no fixed shape; text that is no JSON becomes NULL."""

    @F.pandas_udf(T.StringType())
    def strip(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(_stripped(json.loads(t)), sort_keys=True, ensure_ascii=False) if t is not None else None
            except ValueError:
                return None

        return s.map(one)

    return strip(c)


def forbidden_fields(schema: T.StructType, prefix: str = "") -> list[str]:
    """Names of contact fields anywhere in a schema: a sink refuses a frame that has one."""
    out: list[str] = []
    for f in schema.fields:
        if is_contact(f.name):
            out.append(prefix + f.name)
        inner = f.dataType
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.StructType):
            out += forbidden_fields(inner, f"{prefix}{f.name}.")
    return out


def pii(text: Column) -> Column:
    """Whether a text holds what looks like an e-mail address or a telephone number."""
    return F.coalesce(text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), F.lit(False))


def billing_provider(arm: Column, known: tuple[str, ...]) -> Column:
    """The provider that an arm's calls are billed to: the longest known name that the arm is or begins with."""
    names = sorted(known, key=len, reverse=True)
    out = arm
    for k in reversed(names):
        out = F.when((arm == k) | arm.startswith(k + "_"), k).otherwise(out)
    return out
