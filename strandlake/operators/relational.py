"""Relational operators whose null, order and duplicate rules differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a table given as a mapping is broadcast.
SMALL_ROWS = 100_000


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself; raises where a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def not_in(c: Column, values: Sequence) -> Column:
    """True also for null, which is in no list."""
    return ~F.coalesce(c.isin(list(values)), F.lit(False))


def not_like(c: Column, pattern: str) -> Column:
    """True where the pattern isn't found, and for null."""
    return ~F.coalesce(c.rlike(pattern), F.lit(False))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the order given; null keys are equal.

    An aggregate of the least row, summed up before the shuffle, so a frequent key is no hot task.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in rest]).alias("row"))
    first = df.groupBy(*keys).agg(F.min(row).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.row.{c}").alias(c) for c in df.columns])


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all common columns in which null equals null and duplicates multiply."""
    common = [c for c in left.columns if c in right.columns]
    r = right.select([F.col(c).alias(f"_r_{c}") for c in right.columns])
    on = F.lit(True)
    for c in common:
        on &= left[c].eqNullSafe(r[f"_r_{c}"])
    more = [F.col(f"_r_{c}").alias(c) for c in right.columns if c not in common]
    return left.join(r, on, "inner").select(*[left[c] for c in left.columns], *more)


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str) -> DataFrame:
    """A column from a table with unique keys; null where the key is missing."""
    found = table.select(F.col(table_key).alias("_k"), F.col(value).alias(name))
    return df.join(found, F.col(key) == F.col("_k"), "left").drop("_k")


def repair_values(df: DataFrame, column: str, repairs: Mapping[str, str | None]) -> DataFrame:
    """Exact values replaced, also by null; others stay."""
    if len(repairs) > SMALL_ROWS:
        raise ValueError("repairs are a table of that size: join it")
    if not repairs:
        return df
    table = df.sparkSession.createDataFrame(list(repairs.items()), "_old string, _new string").withColumn("_hit", F.lit(True))
    joined = df.join(F.broadcast(table), F.col(column) == F.col("_old"), "left")  # at most SMALL_ROWS rows
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(df.columns)


def surrogate_ids(df: DataFrame, key: str, prefix: str, order: Sequence[str], name: str = "surrogate_id") -> DataFrame:
    """A row for each key, numbered ``prefix1, prefix2, ...`` by first appearance.

    Keys are dealt out by ranges of their first place; each range is numbered from the rows before it.
    """
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_at"))
    return dense_numbers(first, "_at", "_n").select(key, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias(name))


def dense_numbers(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers 1, 2, ... in the order of a column of different values, without sorting in one task.

    The rows are written once in sorted range partitions, each row with its place there; a partition
    starts from the rows of those before. They are shuffled and sorted once.
    """
    from ..store import materialize

    row = (1 << 33) - 1  # monotonically_increasing_id has the partition above 33 bits of the row's place in it
    placed = materialize(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_at_row", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    base = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_base"))  # a row for each partition
    return placed.join(F.broadcast(base), part == F.col("_part")).withColumn(name, F.col("_base") + F.col("_at_row").bitwiseAND(row) + 1).drop("_at_row", "_part", "_base")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value that isn't null, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def ambiguities(df: DataFrame, key: str, value: str, more_than: int = 0) -> DataFrame:
    """Of each key that isn't null: its different values, sorted, and their number."""
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return sets.withColumn("n_values", F.size("values").cast("long")).where(F.col("n_values") > more_than)


def first_seen_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of each key in order of first appearance, null among them; keys with several only."""
    seen = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    lists = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_all"))
    return lists.where(F.size("_all") > 1).select(key, F.col(f"_all.{value}").alias("values"))


def best_undirected(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """The highest-scored row of each unordered pair; of equal ones the least (a, b)."""
    rest = F.struct(*df.columns)
    best = df.groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")).agg(F.min_by(rest, F.struct(-F.col(score), a, b)).alias("_best"))
    return best.select("_best.*")


def endpoints(df: DataFrame, pairs: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Each group of columns as rows of its own, with ``side`` 0, 1, ...: one pass over the input."""
    sides = [F.struct(F.lit(i).alias("side"), *[F.col(c).alias(n) for c, n in zip(p, names, strict=True)]) for i, p in enumerate(pairs)]
    return df.select(F.explode(F.array(*sides)).alias("e")).select("e.*")


def issue_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each issue over several issue columns."""
    issues = F.explode(F.array_compact(F.array(*[F.col(c) for c in columns])))
    return df.select(issues.alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def first_examples(df: DataFrame, group: str, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first rows of each group, with their ``place``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.where(F.col(group).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def union_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of the tables by name, the first of each key kept; earlier tables win."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_table", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_first(out, keys, ["_table", *order]).drop("_table")


def without_known(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that aren't among those done, for resuming; null keys are never done."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def point_updates(df: DataFrame, ordinal: str, column: str, updates: Mapping[int, str | None]) -> DataFrame:
    """Values at given rows replaced, also by null."""
    if len(updates) > SMALL_ROWS:
        raise ValueError("updates are a table of that size: join it")
    if not updates:
        return df
    table = df.sparkSession.createDataFrame(list(updates.items()), "_row long, _new string").withColumn("_hit", F.lit(True))
    joined = df.join(F.broadcast(table), F.col(ordinal) == F.col("_row"), "left")  # at most SMALL_ROWS rows
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(df.columns)
