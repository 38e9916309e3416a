"""Tables of runs: summaries over seeds, curves, grids, names, orderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarize_by_seed(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per group: distinct seeds, mean and population deviation of non-empty numbers."""
    value = {m: F.expr(f"try_cast(`{m}` as double)") for m in metrics}
    aggs = [x for m in metrics for x in (F.avg(value[m]).alias(f"{m}_mean"), F.stddev_pop(value[m]).alias(f"{m}_std"))]
    return runs.groupBy(*keys).agg(F.countDistinct("seed").alias("n_seeds"), *aggs)


def average_curves(history: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and step that all its seeds have: mean elapsed time and stress."""
    seeds = history.groupBy(*keys).agg(F.countDistinct("seed").alias("all_seeds"))
    steps = history.groupBy(*keys, "step").agg(F.countDistinct("seed").alias("n_seeds"), F.avg("elapsed").alias("elapsed"), F.avg("stress").alias("stress"))
    return steps.join(seeds, keys).where("n_seeds = all_seeds").drop("all_seeds")


def last_rows(history: DataFrame, keys: list[str], order: str = "step") -> DataFrame:
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def grid(tables: list[DataFrame]) -> DataFrame:
    """All combinations of a few small tables of settings."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), tables)


def iteration_of(name: Column) -> Column:
    """The number of the first token i<digits>, or -1."""
    found = F.regexp_extract(name, r"(?:^|_)i(\d+)(?:_|\.|$)", 1)
    return F.when(found != "", found.cast("int")).otherwise(-1)


def alpha_tag(alpha: Column) -> Column:
    """a<value> with p for the point; whole numbers without decimals."""
    whole = alpha == F.floor(alpha)
    return F.concat(F.lit("a"), F.when(whole, F.floor(alpha).cast("string")).otherwise(F.translate(alpha.cast("string"), "-.", "mp")))


def percent_code(share: Column) -> Column:
    return F.format_string("%03d", F.round(100 * share).cast("int"))


def categorical_codes(labels: DataFrame, column: str = "label") -> DataFrame:
    """0-based codes of the sorted distinct labels; the dense rank runs over distinct labels only."""
    codes = labels.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    return labels.join(F.broadcast(codes), column, "left")


def finite_rescaled(df: DataFrame, column: str, name: str) -> DataFrame:
    """Min-max over known finite values, 0 where all are equal, NULL stays."""
    known = F.when(~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), F.col(column))
    box = df.agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (known - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(known.isNotNull(), 0.0))
    return df.join(F.broadcast(box)).withColumn(name, scaled).drop("_lo", "_hi")


def combined_time(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Mean of the known values of a row, NULL without any."""
    known = F.filter(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]), lambda x: x.isNotNull())
    return df.withColumn(name, F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)))


def relabelled(df: DataFrame, names: dict[str, str], column: str = "label") -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def restricted(df: DataFrame, keep: list | None = None, drop: list | None = None, column: str = "label") -> DataFrame:
    if keep is not None:
        df = df.where(F.col(column).isin(keep))
    return df if drop is None else df.where(~F.col(column).isin(drop))


def layout_is_stable(embedding: DataFrame, bound: float = 1e3) -> DataFrame:
    """One row: whether all coordinates are known and finite, and magnitudes and spans within the bound."""
    flat = embedding.select(F.posexplode_outer("y").alias("axis", "c"))
    bad = F.col("c").isNull() | F.isnan("c") | (F.abs("c") == F.lit(float("inf")))
    axes = flat.groupBy("axis").agg(F.count_if(bad).alias("bad"), F.max(F.abs("c")).alias("most"), (F.max("c") - F.min("c")).alias("span"))
    return axes.agg(((F.sum("bad") == 0) & (F.max("most") <= bound) & (F.max("span") <= bound)).alias("stable"))


def require_same_keys(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    if not a.join(b, key, "left_anti").isEmpty() or not b.join(a, key, "left_anti").isEmpty():
        raise ValueError("the tables do not have the same keys")
