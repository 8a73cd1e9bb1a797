"""Report sinks: JSON lines, one JSON report object, CSV with a totals row.

Report objects and CSV files leave as ordered lines of text: the part files, read one after the other, are the
document, whatever its size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.functions.scalars import display_time, iso_millis
from tokentide.session import stage

def _times(df: DataFrame, render) -> DataFrame:
    return df.select(
        *[render(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema]
    )


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row, times as UTC milliseconds."""
    _times(df, iso_millis).write.mode(mode).json(path)


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Report rows, then the totals row; columns the totals lack are null."""
    return rows.unionByName(totals, allowMissingColumns=True)


def _document(head: str, rows: DataFrame, tail: DataFrame, between: str = "") -> DataFrame:
    """Lines (`text`) in order: a first line, the rows' `text`, and `tail`'s; `between` separates rows."""
    numbered = stage(rows.withColumn("n", F.monotonically_increasing_id()), "report")
    first = numbered.agg(F.min("n")).first()[0]
    lead = F.when(F.col("n") == F.lit(first), "").otherwise(between)
    spark = rows.sparkSession
    top = spark.createDataFrame([(-1, head)], "n long, text string")
    last = F.lit((1 << 63) - 1).alias("n")
    body = numbered.select("n", F.concat(lead, "text").alias("text"))
    return top.unionByName(body).unionByName(tail.select(last, "text")).orderBy("n").select("text")


def csv_lines(rows: DataFrame, totals: DataFrame | None = None, tz: str | None = None) -> DataFrame:
    """CSV as lines: one header, the rows in order, the totals row last; cells are quoted only where needed."""
    shown = _times(rows if totals is None else with_totals(rows, totals.limit(0)), lambda c: display_time(c, tz))
    line = lambda df: df.select(F.to_csv(F.struct(*shown.columns), {"escape": '"'}).alias("text"))
    if totals is None:
        end = line(shown).limit(0)
    else:
        end = line(_times(with_totals(rows.limit(0), totals), lambda c: display_time(c, tz)))
    return _document(",".join(shown.columns), line(shown), end)


def write_csv(rows: DataFrame, path: str, totals: DataFrame | None = None, tz: str | None = None, mode: str = "error") -> None:
    """`csv_lines` as text files, times shown in local time."""
    csv_lines(rows, totals, tz).write.mode(mode).text(path)


def report_json(rows: DataFrame, totals: DataFrame | None = None, name: str = "rows", **fields) -> DataFrame:
    """The whole report as lines of one JSON object: fixed fields, rows in order, totals."""
    keep = {"ignoreNullFields": "false"}
    head = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v)}, " for k, v in fields.items()) + f"{json.dumps(name)}: ["
    text = _times(rows, iso_millis)
    body = text.select(F.to_json(F.struct(*text.columns), keep).alias("text"))
    if totals is None:
        end = rows.sparkSession.createDataFrame([("]}",)], "text string")
    else:
        one = _times(totals, iso_millis)
        end = one.select(F.concat(F.lit('], "totals": '), F.to_json(F.struct(*one.columns), keep), F.lit("}")).alias("text"))
    return _document(head, body, end, ", ")


def write_report(rows: DataFrame, path: str, totals: DataFrame | None = None, name: str = "rows", mode: str = "error", **fields) -> None:
    """`report_json` as text files."""
    report_json(rows, totals, name, **fields).write.mode(mode).text(path)
