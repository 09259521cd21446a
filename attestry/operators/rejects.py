"""Rows that fail to parse: records are assembled quote-aware, each is parsed by Python's strict csv reader, structural
exceptions are caught there, and only then do typed constructors look at the fields."""

from __future__ import annotations

import csv
import datetime as dt
import re
import sys
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Month names of the date formats, and the relationship tokens that are known.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
KNOWN_RELATIONS = frozenset({"director", "officer", "tenpercentowner", "other"})

#: Line ends inside a record are text; the csv reader must not see them as such.
_SHIELD, _UNSHIELD = str.maketrans("\r\n\x00", ""), str.maketrans("", "\r\n\x00")
_SHAPES = tuple(re.compile(p, re.ASCII) for p in (r"(?P<d>\d{1,2})-(?P<b>[A-Za-z]{3})-(?P<y>\d{4})", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})", r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})", r"(?P<d>\d{1,2})(?P<b>[A-Za-z]{3})(?P<y>\d{4})", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"))


csv.field_size_limit(sys.maxsize)  # fields are parsed whole, however long


class BadField(ValueError):
    """A typed constructor's refusal; its text is the reason."""


def date_field(value: str) -> str:
    text = value.strip()
    for shape in _SHAPES:
        if m := shape.fullmatch(text):
            part = m.groupdict()
            month = MONTHS.get(part["b"].lower(), 0) if part.get("b") else int(part["m"])
            try:
                return dt.date(int(part["y"]), month, int(part["d"])).isoformat()
            except ValueError:
                continue
    raise BadField("unparseable_date")


def person_field(value: str) -> str:
    if not re.fullmatch("[0-9]+", value.strip()):
        raise BadField("bad_person_cik")
    return value.strip()


def relation_field(value: str) -> str:
    tokens = ["".join(ch for ch in t if not ch.isspace() and ch != "-").lower() for t in value.split(",")]
    if value.strip() and not KNOWN_RELATIONS.intersection(tokens):
        raise BadField("unknown_relationship_token")
    return value


@dataclass(frozen=True)
class Layout:
    """Columns of a member file, and the typed constructor of each that has one."""

    columns: tuple[str, ...]
    typed: tuple[tuple[str, Callable[[str], str]], ...] = ()


#: The two member files' columns.
LAYOUTS = {
    "SUBMISSION.TSV": Layout(tuple("accession_number filing_date period_of_report date_of_orig_sub no_securities_owned not_subject_sec16 form3_holdings_reported form4_trans_reported document_type issuercik issuername issuertradingsymbol remarks aff10b5one".split()), (("filing_date", date_field), ("period_of_report", date_field))),
    "REPORTINGOWNER.TSV": Layout(tuple("accession_number rptownercik rptownername rptowner_relationship rptowner_title rptowner_txt rptowner_street1 rptowner_street2 rptowner_city rptowner_state rptowner_zipcode rptowner_state_desc file_number".split()), (("rptownercik", person_field), ("rptowner_relationship", relation_field))),
}


#: Characters of following lines in which a quoted field that is open at a line's end may close.
LOOK_AHEAD = 1 << 20


def _open_at_end(line: str, inside: bool, delimiter: str = "\t") -> bool:
    """Whether a quoted field is open where the line ends. A quote opens a field only at the field's start, and two of them
    stand for one. inside: whether the line begins in such a field."""
    pos = 0
    while True:
        if not inside:
            if line[pos : pos + 1] != '"':
                pos = line.find(delimiter, pos) + 1
                if not pos:
                    return False
                continue
            pos += 1
        while (end := line.find('"', pos)) >= 0 and line[end + 1 : end + 2] == '"':
            pos = end + 2
        if end < 0:
            return True
        inside = False
        pos = line.find(delimiter, end) + 1
        if not pos:
            return False


def assemble(lines: Iterable[str], layout: Layout | None = None) -> Iterator[str]:
    """The records of a member's lines, which come without their ends: a line end inside a quoted field belongs to the
    record.

    Lines are read as they are needed. If a field is open at a line's end, following lines join the record until one
    closes it; the whole counts only if it parses, with the layout's number of fields if there is one. Else the first line
    is a record by itself, which parsing will reject, and assembly goes on with the next: an unclosed quote costs one
    line. A field may not close later than LOOK_AHEAD characters on.
    """
    source, waiting = iter(lines), deque()
    while True:
        first = waiting.popleft() if waiting else next(source, None)
        if first is None:
            return
        if '"' not in first or not _open_at_end(first, False):
            yield first
            continue
        joined, size, closed = [first], 0, False
        used = 0
        while not closed and size <= LOOK_AHEAD:
            if used == len(waiting):
                line = next(source, None)
                if line is None:
                    break
                waiting.append(line)
            line = waiting[used]
            used += 1
            size += len(line) + 1
            joined.append(line)
            closed = not _open_at_end(line, True)
        record = "\n".join(joined)
        if closed and (fields := _split(record.removesuffix("\r"))) is not None and (layout is None or len(fields) == len(layout.columns)):
            for _ in range(used):
                waiting.popleft()
            yield record
        else:
            yield first


def _split(line: str) -> list[str] | None:
    """The fields of a record, None if its quoting is broken; line ends inside are shielded."""
    try:
        return next(csv.reader([line.translate(_SHIELD)], delimiter="\t", quotechar='"', doublequote=True, strict=True), [""])
    except csv.Error:
        return None


def parse_record(line: str | None, layout: Layout | None) -> tuple[list[str] | None, list[str]]:
    """Fields and no reason, or no fields and every reason. A NULL line counts as an empty one; a line of a member file
    without a layout has no column count that fits."""
    line = (line or "").removesuffix("\r")
    if (fields := _split(line)) is None:
        return None, ["quoting"]
    if line == "":
        fields = [""]
    if not layout or len(fields) != len(layout.columns):
        return None, ["column_count"]
    if any(c in line for c in "\r\n\x00"):
        fields = [f.translate(_UNSHIELD) for f in fields]
    reasons: list[str] = []
    for name, make in layout.typed:
        at = layout.columns.index(name)
        try:
            fields[at] = make(fields[at])
        except BadField as e:
            if str(e) not in reasons:
                reasons.append(str(e))
    return (None, reasons) if reasons else (fields, [])


PARSED = "line_id bigint, archive string, member_file string, fields array<string>, reasons array<string>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Each line but headers (line_no 1) with its fields, or the reasons for its rejection (PARSED).

    lines: line_id, archive, member_file, line_no, raw_text; other columns are not read. A raw_text is assembled as the
    one line of a member, so a field that is open at its end is broken there. One pass over the partitions, no shuffle. Very long lines are parsed whole; empty input gives no rows; repeated lines are parsed one by one.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            layouts = [LAYOUTS.get((m or "").strip().upper()) for m in b["member_file"]]
            got = [parse_record(record, lay) for t, lay in zip(b["raw_text"], layouts, strict=True) for record in assemble([t or ""], lay)]
            yield pd.DataFrame({"line_id": b["line_id"], "archive": b["archive"], "member_file": b["member_file"], "fields": [g[0] for g in got], "reasons": [g[1] for g in got]})

    rows = lines.where(F.coalesce(F.col("line_no") != 1, F.lit(True))).select("line_id", "archive", "member_file", "raw_text")
    return rows.mapInPandas(run, PARSED)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("reasons") > 0).select("line_id", "archive", "member_file", F.explode("reasons").alias("reason"))


def loadable(parsed: DataFrame, member_file: str) -> DataFrame:
    """The valid rows of one member file under their column names, dates as yyyy-MM-dd text."""
    columns = LAYOUTS[member_file.upper()].columns
    rows = parsed.where((F.size("reasons") == 0) & (F.upper(F.trim("member_file")) == member_file.upper()))
    return rows.select("line_id", "archive", *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Per archive and member file: lines, loadable rows, rejected lines and lines per reason. loaded + rejected = input."""
    has = lambda r: F.count_if(F.array_contains("reasons", r)).alias(r)
    reasons = ("quoting", "column_count", "unparseable_date", "bad_person_cik", "unknown_relationship_token")
    return parsed.groupBy("archive", "member_file").agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(F.size("reasons") == 0).alias("loaded"), F.count_if(F.size("reasons") > 0).alias("rejected"), *[has(r) for r in reasons])
