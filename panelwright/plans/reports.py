"""Report tables as ledgers: appended as JSON lines and as CSV, read back with a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.base import query, table
from panelwright.sources import tables as S

_REPORT = "symbol string, day timestamp_ntz, events bigint, total double, largest double, remark string"


def _daily(e: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    made = e.groupBy(F.col("event_type").alias("symbol"), day).agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.max(F.when(F.col("value") > 20, F.col("value"))).alias("largest"))
    return made.withColumn("remark", F.when(F.col("events") % 3 != 0, F.concat(F.col("symbol"), F.lit(', "'), F.col("events").cast("string"), F.lit('" events;\nsee \\log'))))


@query(
    "s_report_ledger",
    r"""SELECT *, CASE WHEN events % 3 <> 0 THEN concat(symbol, ', "', events, '" events;', chr(10), 'see \log') END AS remark FROM (
  SELECT event_type AS symbol, date_trunc('day', ts) AS day, count(*) AS events, sum(value) AS total, max(CASE WHEN value > 20 THEN value END) AS largest FROM (SELECT event_type, events.ts AS ts, value FROM events) GROUP BY 1, 2)""",
    "total largest",
)
def s_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily reports appended as JSON lines in three loads, read back, appended as CSV in two, and read back; missing values, quotes, commas and line ends stay."""
    e = table(spark, sf_dir, "events")
    first, then = (F.expr(f"TIMESTAMP_NTZ '2024-01-{d} 00:00:00'") for d in ("08", "19"))
    notes, sheets = S.shared_folder(spark, "notes"), S.shared_folder(spark, "sheets")
    for part in (F.col("ts") < first, (F.col("ts") >= first) & (F.col("ts") < then), F.col("ts") >= then):
        S.write_report(_daily(e.where(part)), notes, "json")
    back = S.read_report(spark, notes, _REPORT, "json")
    for odd in (0, 1):
        S.write_report(back.where(F.col("events") % 2 == odd), sheets, "csv")
    return S.read_report(spark, sheets, _REPORT, "csv")
