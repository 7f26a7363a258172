"""One-pass table profiles and their comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import col

from .events import event, union

#: Thresholds that a detector uses unless told otherwise.
ROW_DROP, NULL_SPIKE, SIGMAS, MIN_COUNT = 0.20, 0.10, 3.0, 5
IGNORED = ("_extracted_at",)
#: Aggregates per pass: beyond this many columns a table is profiled in slices, to stay within code generation.
SLICE = 40

PROFILE = "table_name string, column_name string, row_count long, null_count long, null_ratio double, min_value double, max_value double, mean double, stddev double, value_count long"


def profile(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Long-form profile: rows, nulls and their ratio, and min, max, mean, sample deviation and count of the numeric values.

    One aggregation over all columns, then turned to a row per column. Values
    that do not cast to a finite double count as non-numeric; the null ratio of an empty table is 0.
    """
    wanted = [c for c in columns or df.columns if c not in IGNORED]
    parts = [_slice(df, name, wanted[i: i + SLICE]) for i in range(0, len(wanted), SLICE)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _slice(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    exprs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        value = col(c).cast("string").try_cast("double")
        value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        exprs += [F.count_if(col(c).isNull()).alias(f"nulls{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
                  F.avg(value).alias(f"mean{i}"), F.stddev(value).alias(f"sd{i}"), F.count(value).alias(f"cnt{i}")]
    wide = df.select(*[col(c) for c in columns]).agg(*exprs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"nulls{i}").alias("null_count"), F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"),
        F.col(f"mean{i}").alias("mean"), F.col(f"sd{i}").alias("stddev"), F.col(f"cnt{i}").alias("value_count")) for i, c in enumerate(columns)]))
    ratio = F.when(F.col("n") > 0, F.col("r.null_count") / F.col("n")).otherwise(0.0)
    return wide.select("n", rows.alias("r")).select(
        F.lit(name).alias("table_name"), "r.column_name", F.col("n").alias("row_count"), "r.null_count", ratio.alias("null_ratio"),
        "r.min_value", "r.max_value", "r.mean", "r.stddev", "r.value_count")


PARTIAL = "table_name string, column_name string, period string, row_count long, null_count long, value_count long, min_value double, max_value double, mean double, squares double"


def partials(df: DataFrame, name: str, period: Column, columns: list[str]) -> DataFrame:
    """Profiles by period (``PARTIAL``) that :func:`merged` puts together; ``squares`` are the squared distances from the period's mean.

    One aggregation, a row per period and column. Rows without a period are the period null.
    """
    exprs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        value = col(c).cast("string").try_cast("double")
        value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        exprs.append(F.struct(F.lit(c).alias("column_name"), F.count_if(col(c).isNull()).alias("null_count"), F.count(value).alias("value_count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                              F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("squares")).alias(f"c{i}"))
    wide = df.groupBy(period.cast("string").alias("period")).agg(*exprs)
    rows = wide.select("period", "n", F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("r"))
    return rows.select(F.lit(name).alias("table_name"), "r.column_name", "period", F.col("n").alias("row_count"), "r.null_count", "r.value_count", "r.min_value", "r.max_value", "r.mean", "r.squares")


def merged(parts: DataFrame) -> DataFrame:
    """The profile (``PROFILE``) of all periods of ``parts`` together.

    Squares add up to those around the common mean: each period's own, and its count
    times the squared distance of its mean, so nothing cancels out.
    """
    keys = ["table_name", "column_name"]
    total = parts.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        (F.sum(F.col("mean") * F.col("value_count")) / F.nullif(F.sum("value_count"), F.lit(0))).alias("mean"), F.sum("value_count").alias("value_count"))
    centre = total.select(*keys, F.col("mean").alias("_mean"))
    apart = F.col("squares") + F.col("value_count") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2))
    spread = parts.join(centre, keys).groupBy(*keys).agg(F.sum(apart).alias("_squares"))
    deviation = F.when(F.col("value_count") > 1, F.sqrt(F.col("_squares") / (F.col("value_count") - 1)))
    ratio = F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(0.0)
    return total.join(spread, keys).select("table_name", "column_name", "row_count", "null_count", ratio.alias("null_ratio"), "min_value", "max_value", "mean", deviation.alias("stddev"), "value_count")


def extended(stored: DataFrame, df: DataFrame, name: str, period: Column, columns: list[str]) -> DataFrame:
    """``stored`` partials and those of the periods of ``df`` that it lacks. Only rows of these are aggregated; where ``period`` is a partition column, only they are read.

    Periods are taken to be closed: what is stored of one is not looked at again.
    """
    known = [r.period for r in stored.filter(F.col("table_name") == name).select("period").distinct().collect()]  # as many as there are periods
    text = period.cast("string")
    old = F.coalesce(text.isin([k for k in known if k is not None]), F.lit(False)) if known else F.lit(False)
    if None in known:
        old = old | text.isNull()
    return stored.unionByName(partials(df.filter(~old), name, period, columns))


def drift(previous: DataFrame, current: DataFrame, row_drop: float = ROW_DROP, null_spike: float = NULL_SPIKE,
          sigmas: float = SIGMAS, min_count: int = MIN_COUNT) -> DataFrame:
    """Events where the current profile departs from the previous one.

    Row drops once per table; null spikes per column; values beyond ``sigmas``
    deviations where the baseline has ``min_count`` values and a spread, and
    else a minimum that turned negative. Tables and columns that only one of
    the two has give no event; an empty baseline gives none at all.
    """
    keys = ["table_name", "column_name"]
    old = previous.select(*keys, *[F.col(c).alias(f"old_{c}") for c in previous.columns if c not in keys])
    both = current.join(old, keys)
    tables = both.groupBy("table_name").agg(F.max("row_count").alias("row_count"), F.max("old_row_count").alias("old_row_count"))
    share = (F.col("old_row_count") - F.col("row_count")) / F.col("old_row_count")
    drops = event(tables.filter((F.col("old_row_count") > 0) & (share > row_drop)), "row_count_drop", "error", "table_name", None,
                  F.col("old_row_count"), F.col("row_count"), drop_ratio=share)
    spike = F.col("null_ratio") - F.col("old_null_ratio")
    spikes = event(both.filter(spike > null_spike), "null_ratio_spike", "warning", "table_name", "column_name", F.col("old_null_ratio"), F.col("null_ratio"), delta=spike)
    ranged = both.filter("min_value is not null and max_value is not null and old_min_value is not null")
    usable = F.coalesce((F.col("old_value_count") >= min_count) & (F.col("old_stddev") > 0), F.lit(False))
    reach = F.col("old_stddev") * sigmas
    beyond = (F.col("min_value") < F.col("old_mean") - reach) | (F.col("max_value") > F.col("old_mean") + reach)
    flipped = (F.col("old_min_value") >= 0) & (F.col("min_value") < 0)
    method = F.when(usable & beyond, "sigma").when(~usable & flipped, "sign_flip")
    breaches = event(ranged.withColumn("method", method).filter("method is not null"), "value_range_breach", "error", "table_name", "column_name",
                     F.concat_ws("..", F.col("old_min_value"), F.col("old_max_value")), F.concat_ws("..", F.col("min_value"), F.col("max_value")), method=F.col("method"))
    return union(drops, spikes, breaches)
