"""Projections, filters and summaries of labelled peptide tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COMPOSITION_FEATURES
from ..functions.features import feature_label, scaled_position
from ..plans.storage import stored
from .quantiles import exact_quantiles


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_values(df: DataFrame, column: str, values: set) -> None:
    """The column's distinct values must be exactly these."""
    found = {r[0] for r in df.select(column).distinct().limit(len(values) + 1).collect()}
    if found != values:
        raise ValueError(f"{column} must have exactly the values {sorted(values)}")


def limited(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, or an error if it has more rows than allowed."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"at most {rows} rows are allowed")
    return df


def preview(df: DataFrame, names: Iterable[str], order: Iterable[str], rows: int = 25) -> DataFrame:
    """The named columns that exist, the first rows by order."""
    return df.orderBy(*order).select([c for c in names if c in df.columns]).limit(rows)


def search(df: DataFrame, query: str, topic: str | None = None) -> DataFrame:
    """Rows of a topic (None: all) with the query, trimmed and case-insensitive, as a plain substring of any column."""
    out = df if topic is None else df.filter(F.col("topic") == topic)
    q = query.strip().lower()
    return out.filter(F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), lambda c: F.contains(F.lower(c), F.lit(q)))) if q else out


def class_name(label: Column) -> Column:
    # Display names of the labels.
    return F.when(label == 1, "AMP").when(label == 0, "Putative non-AMP")


def dataset_header(df: DataFrame) -> DataFrame:
    """rows, unique sequences, median and extreme length, prevalence. df is read several times."""
    n = F.length("sequence")
    median = exact_quantiles(df.select(n.alias("size")), "size", (), (0.5,)).select(F.col("q")[0]).scalar()  # null of an empty table
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sequence").alias("unique_sequences"), median.alias("median_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(F.col("label").try_cast("double")).alias("prevalence"))


def split_profile(df: DataFrame) -> DataFrame:
    """Per split records, unique sequences, amps and rate, joined with the split's group count."""
    profile = df.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("sequence").alias("unique_sequences"), F.sum("label").alias("amps"), F.avg("label").alias("positive_rate"))
    return profile.join(df.groupBy("split").agg(F.count_distinct("split_group").alias("groups")), "split", "left")


def contingency(df: DataFrame, rows: str = "split", columns: str = "label") -> DataFrame:
    return df.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))


def contingency_pivot(df: DataFrame) -> DataFrame:
    return df.groupBy("split").pivot("label", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"0": "label_0", "1": "label_1"})


def conflicts(df: DataFrame) -> DataFrame:
    """Sequences with several labels."""
    return df.groupBy("sequence").agg(F.count_distinct("label").alias("n_labels")).filter("n_labels > 1")


def leaking_groups(df: DataFrame) -> DataFrame:
    """Groups in several splits."""
    return df.groupBy("split_group").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def class_summary(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(label, feature, median, mean, std) with three decimals. The named columns are written once and read several times."""
    long = stored(df.select("label", *names)).unpivot(["label"], list(names), "feature", "value")
    moments = long.groupBy("label", "feature").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_samp("value"), 3).alias("std"))
    medians = exact_quantiles(long, "value", ("label", "feature"), (0.5,)).select(F.col("label").alias("__label"), F.col("feature").alias("__feature"), F.round(F.col("q")[0], 3).alias("median"))
    met = moments.join(medians, moments["label"].eqNullSafe(medians["__label"]) & (moments["feature"] == medians["__feature"]), "left")
    return met.select("label", "feature", "median", "mean", "std")


def distribution_summary(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(feature, q05, median, q95, amp_median, non_amp_median), exact and interpolated. The named columns are written once."""
    long = stored(df.select("label", *names)).unpivot(["label"], list(names), "feature", "value")
    every = exact_quantiles(long, "value", ("feature",), (0.05, 0.5, 0.95))
    classes = exact_quantiles(long.filter(F.col("label").isin(0, 1)), "value", ("feature", "label"), (0.5,))
    medians = classes.groupBy("feature").agg(*(F.max(F.when(F.col("label") == y, F.col("q")[0])).alias(c) for y, c in ((1, "amp_median"), (0, "non_amp_median"))))
    return every.join(medians, "feature", "left").select("feature", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "amp_median", "non_amp_median")


def scaled_positions(df: DataFrame, names: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """The kept columns, and for each named one a value's place between the column's 5 % and 95 % quantiles. df is read several times."""
    names = list(names)
    found = exact_quantiles(df.unpivot([], names, "feature", "value"), "value", ("feature",), (0.05, 0.95))
    q = {r.feature: r.q for r in found.collect()}  # one row a feature
    nothing = [None, None]
    return df.select(*keep, *(scaled_position(F.col(n), *(F.lit(x).cast("double") for x in q.get(n, nothing))).alias(n) for n in names))


def filled_with_medians(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with nulls and NaN of the named columns replaced by the column's exact median; a column without values stays null.

    df is read several times.
    """
    names = list(names)
    present = df.select(*(F.when(~F.isnan(n), F.col(n).cast("double")).alias(n) for n in names)).unpivot([], names, "feature", "value")
    medians = {r.feature: r.q[0] for r in exact_quantiles(present, "value", ("feature",), (0.5,)).collect()}  # one row a column
    return df.withColumns({n: F.coalesce(F.when(~F.isnan(n), F.col(n).cast("double")), F.lit(medians.get(n)).cast("double")) for n in names})


def composition_difference(df: DataFrame, top: int | None = 12) -> DataFrame:
    """(residue, difference of mean composition between the labels), the largest by absolute value."""
    means = df.agg(*(F.avg(F.when(F.col("label") == 1, F.col(c))).alias(f"{c}_1") for c in COMPOSITION_FEATURES), *(F.avg(F.when(F.col("label") == 0, F.col(c))).alias(f"{c}_0") for c in COMPOSITION_FEATURES))
    each = means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(f"{c}_1") - F.col(f"{c}_0")).alias("difference")) for c in COMPOSITION_FEATURES))).alias("x")).select("x.*")
    each = each.select(feature_label(F.col("feature")).alias("residue"), "difference")
    return each if top is None else each.orderBy(F.abs("difference").desc(), "residue").limit(top)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: str | None = None) -> DataFrame:
    """(by, bin, n, share): equal bins over [low, high], the last one closed; share within by."""
    place = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    each = df.filter(F.col(value).between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return each.select("bin", "n", (F.col("n") / each.agg(F.sum("n")).scalar()).alias("share"))
    total = each.groupBy(by).agg(F.sum("n").alias("total"))
    return each.join(total, by).select(by, "bin", "n", (F.col("n") / F.col("total")).alias("share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def feature_integrity(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row: rows, rows with a value that isn't finite, wrong lengths, compositions that don't add up to 1."""
    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    any_bad, total = F.lit(False), F.lit(0.0)
    for c in names:
        any_bad = any_bad | bad(F.col(c))
    for c in COMPOSITION_FEATURES:
        total = total + F.col(c)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_bad).alias("not_finite"), F.count_if(F.col("length") != F.length("sequence")).alias("wrong_length"), F.count_if(F.abs(total - 1) > 1e-8).alias("wrong_composition"))
