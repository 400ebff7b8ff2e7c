"""Composition features: formulas to element ratios, joined with properties, to weighted statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import DESCRIPTORS, ELEMENTS

STATS = ("WAM", "WGM", "WEM", "WSD")


def compositions(df: DataFrame, key: str, formula: str) -> DataFrame:
    """(key, symbol, ratio): repeated symbols add up, a missing amount is 1, group multipliers don't count. Unknown symbols and formulas without an element raise."""
    text = F.translate(F.coalesce(F.col(formula), F.lit("")), "_-", "++")
    token = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]*\d*\.?\d*"), F.lit(0))
    some = F.when(F.size(token) > 0, token).otherwise(F.raise_error(F.concat(F.lit("no element in formula '"), F.coalesce(F.col(formula), F.lit("")), F.lit("'"))).cast("array<string>"))
    rows = df.select(F.col(key), F.explode(some).alias("t")).select(key, F.regexp_extract("t", r"^[A-Z][a-z]*", 0).alias("symbol"), F.regexp_extract("t", r"[0-9.]+$", 0).alias("n"))
    known = F.col("symbol").isin(list(ELEMENTS))
    rows = rows.select(key, F.when(known, F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("unknown element "), "symbol"))).alias("symbol"), F.when(F.col("n").isin("", "."), 1.0).otherwise(F.col("n").try_cast("double")).alias("n"))
    return rows.groupBy(key, "symbol").agg(F.sum("n").alias("ratio"))


def dense(composition: DataFrame, key: str, symbols: list[str] | None = None) -> DataFrame:
    """One column an element."""
    return composition.groupBy(key).pivot("symbol", symbols or ELEMENTS).agg(F.first("ratio")).na.fill(0.0)


def statistics(composition: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """(key, descriptor_id, WAM, WGM, WEM, WSD) over the elements present.

    WAM divides by the sum of the properties, WSD's centre is the mean of ratio times property: legacy
    definitions that are kept. A property that is missing or not finite counts as 0. One shuffle: the property table is of fixed size, that of
    the elements, and broadcast as one array of (descriptor, value) a symbol.
    """
    v, r = F.col("value"), F.col("ratio")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)
    known = properties.filter("value is not null").withColumn("value", finite)
    wanted = known.select("descriptor_id").distinct()
    symbols = known.select("symbol").unionByName(composition.sparkSession.createDataFrame([(s,) for s in ELEMENTS], "symbol string")).distinct()
    full = symbols.crossJoin(F.broadcast(wanted)).join(known, ["symbol", "descriptor_id"], "left")  # elements by descriptors: a few thousand rows
    own = full.groupBy("symbol").agg(F.collect_list(F.struct("descriptor_id", F.coalesce(v, F.lit(0.0)).alias("value"))).alias("own"))
    rows = composition.filter("ratio != 0").join(F.broadcast(own), "symbol").select(key, "ratio", F.inline("own"))
    some = v != 0
    one = rows.groupBy(key, "descriptor_id").agg(
        F.sum(F.when(some, r * v)).alias("rv"),
        F.sum(F.when(some, v)).alias("sv"),
        F.sum(F.when(some & (v > 0), r * F.ln(F.when(v > 0, v)))).alias("rl"),
        F.sum(F.when(some & (v > 0), r)).alias("rp"),
        F.collect_list(F.struct(r.alias("r"), v.alias("v"))).alias("all"),
    )
    # A row's elements are at most the known ones, so the list is small.
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["r"] * x["v"])
    plain = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["v"])
    weight = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["r"])
    one = one.withColumns({"total": total, "plain": plain, "weight": weight}).withColumn("centre", F.col("total") / F.size("all"))
    part = lambda x: x["r"] * x["v"] / F.col("total")
    entropy = F.aggregate("all", F.lit(0.0), lambda s, x: s - F.when(part(x) > 0, part(x) * F.log2(F.when(part(x) > 0, part(x)))).otherwise(0.0))
    spread = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["r"] * (x["v"] - F.col("centre")) * (x["v"] - F.col("centre")))
    return one.select(
        key,
        "descriptor_id",
        F.coalesce(F.try_divide("rv", "sv"), F.lit(0.0)).alias("WAM"),
        F.coalesce(F.exp(F.try_divide("rl", "rp")), F.lit(0.0)).alias("WGM"),
        F.when((F.col("plain") == 0) | (F.col("total") == 0), 0.0).otherwise(entropy).alias("WEM"),
        F.coalesce(F.sqrt(F.try_divide(spread, F.col("weight"))), F.lit(0.0)).alias("WSD"),
    )


def wide(df: DataFrame, stats: DataFrame, key: str, temperature: str, descriptors: list[int] | None = None) -> DataFrame:
    """T{descriptor}{stat}: statistics 1 to 4, and 5 to 8 their product with the temperature. Descriptors without data are 0."""
    numbers = descriptors or range(1, len(DESCRIPTORS) + 1)
    by = {d: F.max(F.when(F.col("descriptor_id") == d, F.struct(*STATS))).alias(f"d{d}") for d in numbers}
    rows = df.select(key, F.col(temperature).cast("double").alias("_t")).join(stats.groupBy(key).agg(*by.values()), key, "left")
    out = [F.col(key)]
    for d in numbers:
        for s, name in enumerate(STATS, 1):
            value = F.coalesce(F.col(f"d{d}.{name}"), F.lit(0.0))
            out += [value.alias(f"T{d:02d}{s:02d}"), (value * F.col("_t")).alias(f"T{d:02d}{s + 4:02d}")]
    columns = rows.select(*out)
    return columns.select(key, *sorted(c for c in columns.columns if c != key))


def scale_params(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """One row of an offset and a width for each column; NaN counts as missing, a width of 0 as 1."""
    clean = lambda c: F.nanvl(F.col(c), F.lit(None))
    if kind == "minmax":
        parts = [x for c in columns for x in (F.min(clean(c)).alias(f"{c}_o"), (F.max(clean(c)) - F.min(clean(c))).alias(f"{c}_w"))]
    else:
        parts = [x for c in columns for x in (F.avg(clean(c)).alias(f"{c}_o"), F.stddev_pop(clean(c)).alias(f"{c}_w"))]
    return df.agg(*parts)


def scaled(df: DataFrame, columns: list[str], params: DataFrame) -> DataFrame:
    """The columns less offset, by width. params is one row."""
    own = df.join(F.broadcast(params))
    return own.select(*[((F.col(c) - F.col(f"{c}_o")) / F.coalesce(F.nullif(F.col(f"{c}_w"), F.lit(0.0)), F.lit(1.0))).alias(c) if c in columns else F.col(c) for c in df.columns])


def correlations(df: DataFrame, array: str) -> DataFrame:
    """(i, j, r): absolute Pearson correlations of an array column's places over the rows that have both; null where one is constant.

    A first pass takes a mean of each place, a second sums products of what the values are above it, so large values don't
    cancel out. NaN, infinite and missing values count as missing. Tasks sum outer products of their rows, so only d * d sums a task are shuffled.
    """

    def filled(batch: pa.RecordBatch) -> np.ndarray:
        rows = [[np.nan if v is None else v for v in r] for r in batch.column(0).to_pylist() if r is not None]
        x = np.full((len(rows), max(map(len, rows), default=0)), np.nan)
        for k, r in enumerate(rows):
            x[k, : len(r)] = r
        return np.where(np.isfinite(x), x, np.nan)

    each = df.select(F.posexplode(array).alias("i", "x")).filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    centre = {r["i"]: r["m"] for r in each.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By pair of places, over the rows with both: their number, and the sums of x, x * x, y, y * y and x * y."""
        total = None
        for batch in batches:
            x = filled(batch)
            if not x.size:
                continue
            x = x - np.array([centre.get(k, 0.0) for k in range(x.shape[1])])
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            new = np.stack([here.T @ here, x.T @ here, (x * x).T @ here, here.T @ x, here.T @ (x * x), x.T @ x])
            if total is not None and total.shape != new.shape:
                size = max(total.shape[1], new.shape[1])
                total, new = (np.pad(a, ((0, 0), (0, size - a.shape[1]), (0, size - a.shape[1]))) for a in (total, new))
            total = new if total is None else total + new
        if total is not None:
            i, j = np.indices(total.shape[1:])
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, *total)], ["i", "j", "n", "x", "xx", "y", "yy", "xy"])

    sums = df.select(array).mapInArrow(summed, "i long, j long, n double, x double, xx double, y double, yy double, xy double").groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "x", "xx", "y", "yy", "xy")])
    c = F.col
    spread = lambda s, q: F.greatest(c(q) - c(s) * c(s) / c("n"), F.lit(0.0))
    # What rounding leaves of a constant's spread is no spread.
    real = lambda s, q: F.when(spread(s, q) > 1e-12 * c(q), spread(s, q)).otherwise(0.0)
    r = F.abs(F.try_divide(c("xy") - c("x") * c("y") / c("n"), F.sqrt(real("x", "xx") * real("y", "yy"))))
    return sums.filter("n > 0").select("i", "j", r.alias("r"))


def finite_columns(df: DataFrame, columns: list[str]) -> list[str]:
    told = df.agg(*[F.bool_and(F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))).alias(c) for c in columns]).first()
    return [c for c in columns if told[c]]


def greedy(ranked: list[str], r: dict[tuple[str, str], float | None], limit: int = 10, cutoff: float = 0.95) -> list[str]:
    """Features in order of importance whose correlation with all chosen ones is under the cutoff; then, if too few, in order regardless."""
    chosen: list[str] = []
    for f in ranked:
        if len(chosen) < limit and all(r.get((f, c)) is not None and r[f, c] < cutoff for c in chosen):
            chosen.append(f)
    return chosen + [f for f in ranked if f not in chosen][: max(0, limit - len(chosen))]


def normalized_importance(df: DataFrame, value: str) -> DataFrame:
    """weight: the share of the sum, alike for all if that isn't positive."""
    total = df.agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    return df.join(F.broadcast(total)).withColumn("weight", F.when(F.col("_s") > 0, F.col(value) / F.col("_s")).otherwise(1.0 / F.col("_n"))).drop("_s", "_n")


def single_dopant(formula, hosts: list[str]):  # noqa: ANN001, ANN201
    """The one element that isn't a host; null for none or several."""
    from ..functions.text import elements_of

    rest = F.array_except(elements_of(formula), F.array(*[F.lit(h) for h in hosts]))
    return F.when(F.size(rest) == 1, F.element_at(rest, 1))
