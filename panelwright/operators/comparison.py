"""Comparing panels and labels, input support, eligibility differences, keyword search, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.pointwise import div, finite


def compare_fields(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], rtol: float = 1e-12, atol: float = 1e-15) -> DataFrame:
    """Per field over common keys: finite counts, equal, within tolerance, beyond, largest differences."""
    both = a.select(*keys, *[finite(F.col(f)).alias(f"a_{f}") for f in fields]).join(b.select(*keys, *[finite(F.col(f)).alias(f"b_{f}") for f in fields]), keys)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("x"), F.col(f"b_{f}").alias("y")) for f in fields])).alias("e")).select("e.*")
    gap = F.abs(F.col("x") - F.col("y"))
    near = gap <= atol + rtol * F.abs("y")
    return long.groupBy("field").agg(
        F.count("*").alias("cells"), F.count("x").alias("finite_a"), F.count("y").alias("finite_b"), F.count_if(F.col("x") == F.col("y")).alias("equal"),
        F.count_if(near & (F.col("x") != F.col("y"))).alias("within"), F.count_if(~near).alias("beyond"), F.max(gap).alias("max_abs"), F.max(div(gap, F.abs("y"))).alias("max_rel"),
    )


def compare_labels(a: DataFrame, b: DataFrame, least: int = 20) -> DataFrame:
    """Per horizon: mismatched validity, common cells, times with enough of them, different values."""
    keys = ["horizon", "ts", "symbol"]
    both = a.select(*keys, F.col("forward_return").alias("x")).join(b.select(*keys, F.col("forward_return").alias("y")), keys, "full")
    common = F.col("x").isNotNull() & F.col("y").isNotNull()
    at = both.groupBy("horizon", "ts").agg(F.count_if(F.col("x").isNotNull() != F.col("y").isNotNull()).alias("mismatched"), F.count_if(common).alias("common"), F.count_if(common & (F.abs(F.col("x") - F.col("y")) > 1e-12)).alias("different"))
    return at.groupBy("horizon").agg(F.sum("mismatched").alias("mismatched"), F.sum("common").alias("common"), F.count_if(F.col("common") >= least).alias("full_times"), F.sum("different").alias("different"))


def input_support(panel: DataFrame, fields: list[str], least: int = 20) -> DataFrame:
    """Cells in which all fields are finite: totals, times with enough, fewest and most at a time."""
    ok = F.col("eligible")
    for f in fields:
        ok = ok & finite(F.col(f)).isNotNull()
    at = panel.groupBy("ts").agg(F.count_if(ok).alias("n"))
    return at.agg(F.sum("n").alias("cells"), F.count_if(F.col("n") >= least).alias("full_times"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def labelled_support(labels: DataFrame, fields: list[str], least: int = 20) -> DataFrame:
    """Per horizon: eligible cells, those with a label, with all inputs, with both, and times with at least ``least`` of the last."""
    inputs = F.lit(True)
    for f in fields:
        inputs = inputs & finite(F.col(f)).isNotNull()
    label = F.col("forward_return").isNotNull()
    at = labels.where("eligible").groupBy("horizon", "ts").agg(F.count("*").alias("n"), F.count_if(label).alias("l"), F.count_if(inputs).alias("i"), F.count_if(inputs & label).alias("b"))
    return at.groupBy("horizon").agg(F.sum("n").alias("eligible"), F.sum("l").alias("labelled"), F.sum("i").alias("with_inputs"), F.sum("b").alias("with_both"), F.count_if(F.col("b") >= least).alias("full_times"))


def universe_differences(old: DataFrame, new: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Per symbol with differing eligibility: how many times each way, the first and last, beside its declared end."""
    both = old.select("ts", "symbol", F.col("eligible").alias("x")).join(new.select("ts", "symbol", F.col("eligible").alias("y")), ["ts", "symbol"], "full")
    differ = both.withColumns({"x": F.coalesce("x", F.lit(False)), "y": F.coalesce("y", F.lit(False))}).where("x <> y")
    return differ.groupBy("symbol").agg(F.count_if("x").alias("only_old"), F.count_if("y").alias("only_new"), F.min("ts").alias("first"), F.max("ts").alias("last")).join(lifecycle, "symbol", "left")


def members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per time: eligible symbols of the old universe, the new one and both."""
    both = old.select("ts", "symbol", F.col("eligible").alias("x")).join(new.select("ts", "symbol", F.col("eligible").alias("y")), ["ts", "symbol"], "full")
    return both.groupBy("ts").agg(F.count_if("x").alias("old"), F.count_if("y").alias("new"), F.count_if(F.coalesce(F.col("x") & F.col("y"), F.lit(False))).alias("common"))


def search(rows: DataFrame, terms: list[str], text: str, by: str, most: int = 20) -> DataFrame:
    """The rows that hold most of the distinct terms (case-folded), a top-k report; ``truncated`` tells that there were more."""
    folded = F.lower(F.col(text))
    score = sum((F.coalesce(folded.contains(t), F.lit(False)).cast("int") for t in dict.fromkeys(map(str.lower, terms))), F.lit(0))
    hits = rows.select(by, score.alias("score")).where("score > 0")
    top = hits.orderBy(F.desc("score"), by).limit(most)
    return top.join(F.broadcast(hits.agg((F.count("*") > most).alias("truncated"))))


def digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, and order-free sum and xor of 60 bits of each row's MD5 over its columns as strings, for detecting changes."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns if c not in keys])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
