"""Quarterly archives: finding them on a landing page, and reading the members of their zip files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.rejects import LAYOUTS, assemble

#: Characters of an archive's member that become one batch.
BATCH_LINES = 20_000


def quarters(pages: DataFrame, html: str = "html") -> DataFrame:
    """(year, quarter, url) of every archive that pages link to, one per quarter, in order; the first link of a quarter
    on its page stays."""
    found = pages.select(F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*?((?:19|20)\d{2})q([1-4])[^"]*\.zip)"'), F.lit(1))).alias("at", "url"))
    year, quarter = F.regexp_extract("url", r"((?:19|20)\d{2})q([1-4])", 1).cast("int"), F.regexp_extract("url", r"((?:19|20)\d{2})q([1-4])", 2).cast("int")
    first = found.groupBy(year.alias("year"), quarter.alias("quarter")).agg(F.min(F.struct("at", "url")).alias("m"))
    return first.select("year", "quarter", "m.url").orderBy("year", "quarter")


def in_range(at: Column, low: tuple[int, int], high: tuple[int, int]) -> Column:
    """Whether a (year, quarter) struct lies within an inclusive range."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("year"), F.lit(p[1]).alias("quarter"))
    return (at >= pair(low)) & (at <= pair(high))


LINES = "archive string, member_file string, line_no int, raw_text string"


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """The records of the members of zip archives as lines, as reject parsing wants them: archive, member_file, line_no,
    raw_text. A record with a line end inside quotes stays whole; bytes that are no UTF-8 are replaced. Members are streamed.

    Archives are read one per task from the file system they lie on; a member is found by its name's end, any case."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member, layout in LAYOUTS.items():
                        name = next((n for n in z.namelist() if n.upper().endswith(member)), None)
                        if name is None:
                            raise FileNotFoundError(f"{member} not in {file}")
                        rows: list[tuple[str, str, int, str]] = []
                        with io.TextIOWrapper(z.open(name), encoding="utf-8", errors="replace", newline="\n") as f:
                            for i, record in enumerate(assemble((x.removesuffix("\n").removesuffix("\r") for x in f), layout), 1):
                                rows.append((file.rsplit("/", 1)[-1], member.replace("TSV", "tsv"), i, record))
                                if len(rows) == BATCH_LINES:
                                    yield pd.DataFrame(rows, columns=["archive", "member_file", "line_no", "raw_text"])
                                    rows = []
                        yield pd.DataFrame(rows, columns=["archive", "member_file", "line_no", "raw_text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINES)
