"""Reports over manifests, feature tables and results, and their orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggs import stacked


def breakdown(df: DataFrame, label: str, **distinct: str) -> DataFrame:
    """Rows of each class, and how many different values each named column has in it."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_samples"), *(F.countDistinct(c).alias(n) for n, c in distinct.items()))


def best_per_config(df: DataFrame, config: str, score: str) -> DataFrame:
    """config, best score, rank: the highest first, ties by name."""
    best = df.groupBy(config).agg(F.max(score).alias("best"))
    return ranked(best, [F.desc("best"), F.col(config)])


def ranked(report: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """A report, a row for each class or group, with its places in an order."""
    return report.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def histogram(df: DataFrame, table: str, column: str) -> DataFrame:
    """table, item, n for each value of the column."""
    return df.groupBy(F.concat_ws(":", F.lit(column), F.coalesce(F.col(column).cast("string"), F.lit("null"))).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table"), "item", "n")


def feature_summary(tables: Mapping[str, DataFrame], status: Mapping[str, str]) -> DataFrame:
    """table, item, n: rows of each table, and the histogram of its status column if it has one."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit("rows").alias("item"), "n") for name, t in tables.items()]
    parts += [histogram(tables[name], name, column) for name, column in status.items()]
    return reduce(DataFrame.unionByName, parts)


def memberships(df: DataFrame, ident: str, group: str) -> DataFrame:
    """ident, n_groups, groups (sorted, comma-joined) of each id."""
    found = F.array_sort(F.collect_set(F.col(group).cast("string")))
    return df.groupBy(ident).agg(F.countDistinct(group).alias("n_groups"), F.array_join(found, ",").alias("groups"))


def overlap_totals(df: DataFrame, ident: str, group: str) -> DataFrame:
    """One row: ids, those in one group, those in several, and the most groups of an id."""
    each = df.groupBy(ident).agg(F.countDistinct(group).alias("g"))
    return each.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("g") == 1).alias("n_single"), F.count_if(F.col("g") > 1).alias("n_overlap"), F.max("g").alias("most_groups"))


def first_and_more(df: DataFrame, order: Sequence[Column], shown: Column, most: int) -> DataFrame:
    """line, text: the first rows of an order, and "... and M more" if there are more."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = df.select(*order[:0], shown.alias("text"), *(o.alias(f"o{i}") for i, o in enumerate(order))).orderBy(*(f"o{i}" for i in range(len(order)))).limit(most)
    lines = top.select(F.row_number().over(Window.orderBy(*(f"o{i}" for i in range(len(order))))).cast("long").alias("line"), "text")
    more = total.where(F.col("total") > most).select(F.lit(most + 1).cast("long").alias("line"), F.concat(F.lit("... and "), F.col("total") - most, F.lit(" more")).alias("text"))
    return lines.unionByName(more)


def non_zero(pairs: DataFrame, count: str, names: Sequence[str]) -> DataFrame:
    """Pairs with a count, the largest first, with their place."""
    return ranked(pairs.where(F.col(count) > 0), [F.desc(count), *map(F.col, names)])


def custom_order(column: str, order: Sequence[str]) -> Column:
    """A sort key: the place in a given order, unknown values after it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))


def natural(column: str) -> list[Column]:
    """Sort keys of text ids: by their first number, then as text; ids without digits last."""
    number = F.try_to_number(F.regexp_extract(F.col(column), "[0-9]+", 0), F.lit("9" * 18)).cast("long")
    return [number.asc_nulls_last(), F.col(column).asc_nulls_last()]


def finite_stats(df: DataFrame, key: str, values: str, prefix: str) -> DataFrame:
    """key with prefix_mean, _std (population), _min, _max over the finite items of an array; null if there is none."""
    x = F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(key, x.alias("x"))
    n = F.size("x")
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v))
    rows = rows.withColumn("m", F.try_divide(total(lambda v: v), n))
    var = F.try_divide(total(lambda v: (v - F.col("m")) * (v - F.col("m"))), n)
    return rows.select(key, F.col("m").alias(f"{prefix}_mean"), F.sqrt(var).alias(f"{prefix}_std"), F.array_min("x").alias(f"{prefix}_min"), F.array_max("x").alias(f"{prefix}_max"))


def mean_delta(df: DataFrame, group: str, with_: Column, without: Column) -> DataFrame:
    """group, delta: mean difference of two scores."""
    return df.groupBy(group).agg(F.avg(with_ - without).alias("delta"))


def shape_report(tables: Mapping[str, DataFrame], not_features: Sequence[str]) -> DataFrame:
    """table, n_rows, n_columns, n_features, error: columns that aren't keys, statuses or errors count as features; a table that can't be read says why."""
    parts = []
    for name, df in tables.items():
        features = [c for c in df.columns if c not in not_features and not c.endswith(("_status", "_error"))]
        one = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(one.select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(len(features)).cast("long").alias("n_features")))
    return reduce(DataFrame.unionByName, parts)


def token_stats(df: DataFrame, token: str, wanted: str, speaker: str, label: Column) -> DataFrame:
    """label, n, n_speakers of one token's rows; the filter reaches the scan."""
    return df.where(F.col(token) == wanted).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(speaker).alias("n_speakers"))


def ordered_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns first, as far as they exist, then the rest as it was."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *(c for c in df.columns if c not in head))


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Columns of numbers that aren't excluded: an allow-list by type, so name every label."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, kind in df.dtypes if kind.startswith(kinds) and c not in exclude]


def prefix_groups(df: DataFrame, separator: str = "_") -> DataFrame:
    """prefix, n, columns (sorted, comma-joined) of a table's column names."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.split(separator)[0], []).append(c)
    return df.sparkSession.createDataFrame([(p, len(c), ",".join(sorted(c))) for p, c in sorted(groups.items())], "prefix string, n long, columns string")


def healthy_mask(df: DataFrame, class_column: str, flag: str = "is_healthy", healthy: str = "healthy") -> Column:
    """The flag where the table has it and it isn't null, else whether the class says healthy; null classes are not healthy."""
    by_class = F.coalesce(F.lower(F.trim(F.col(class_column).cast("string"))) == healthy, F.lit(False))
    if flag not in df.columns:
        return by_class
    said = F.lower(F.col(flag).cast("string"))
    return F.when(said.isin("true", "1"), F.lit(True)).when(said.isin("false", "0"), F.lit(False)).otherwise(by_class)


def sample_status(df: DataFrame, path: Column, exists: Column, load_error: Column, families: Mapping[str, Column]) -> DataFrame:
    """df with core_status, core_error, and a status of each family.

    The path comes first, then the file, then the load; families count only
    after these. The core is ok if all families are, else partial_failure with
    the families' states joined by " | ".
    """
    before = F.when(F.coalesce(F.trim(path), F.lit("")) == "", "missing_wav_path").when(~F.coalesce(exists, F.lit(False)), "missing_wav_file").when(load_error.isNotNull(), "audio_load_failed")
    each = {name: F.coalesce(before, state) for name, state in families.items()}
    bad = F.concat_ws(" | ", *(F.when(state != "ok", F.concat(F.lit(f"{name}:"), state)) for name, state in families.items()))
    core = F.coalesce(before, F.when(bad == "", "ok").otherwise("partial_failure"))
    error = F.when(core == "audio_load_failed", load_error).when(core == "partial_failure", bad)
    return df.select("*", core.alias("core_status"), error.alias("core_error"), *(s.alias(f"{name}_status") for name, s in each.items()))


def one_hot(df: DataFrame, column: str, categories: Sequence[str], fill: str) -> DataFrame:
    """A 0/1 column for each category; null counts as fill, unknown values are 0 everywhere."""
    value = F.coalesce(F.col(column), F.lit(fill))
    return df.select("*", *((value == c).cast("int").alias(f"{column}_{i}") for i, c in enumerate(categories)))


def yeo_johnson(x: Column, power: float) -> Column:
    """The power transform that takes numbers of both signs."""
    up = F.ln(x + 1) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.ln(1 - x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_power(df: DataFrame, column: str, powers: Sequence[float]) -> DataFrame:
    """power, likelihood of each candidate, in one pass of sums; the greatest is the estimate."""
    x = F.col(column).cast("double")
    sign = F.avg(F.signum(x) * F.ln(F.abs(x) + 1))
    one = df.agg(sign.alias("jacobian"), *(F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(powers)))
    return stacked(one, {str(p): [-F.ln(F.col(f"v{i}")) / 2 + (p - 1) * F.col("jacobian")] for i, p in enumerate(powers)}, ("power", "likelihood")).withColumn("power", F.col("power").cast("double"))


def mutual_information(df: DataFrame, label: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """column, mi in nats between a class and each column cut into bins of equal width, from counts."""
    ends = df.agg(*(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"e_{c}") for c in columns))
    row = df.crossJoin(F.broadcast(ends))  # one row
    place = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"e_{c}.lo")) / (F.col(f"e_{c}.hi") - F.col(f"e_{c}.lo")) * bins).cast("int"))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), place(c).alias("bin")) for c in columns))
    cells = row.select(F.col(label).alias("label"), F.explode(pairs).alias("p")).groupBy("p.column", "p.bin", "label").agg(F.count(F.lit(1)).alias("n"))
    of_bin, of_label, of_all = (Window.partitionBy("column", *more) for more in (["bin"], ["label"], []))
    n, total = F.col("n"), F.sum("n").over(of_all)
    part = n / total * F.ln(n * total / (F.sum("n").over(of_bin) * F.sum("n").over(of_label)))
    return cells.select("column", part.alias("part")).groupBy("column").agg(F.sum("part").alias("mi"))
