"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets an exponential key ``-ln(u) / weight``; ``u`` is a hash of its id and text and
``weight`` its quality weight. A source's target is met by complete epochs over all its documents
first; the fraction that is left is the prefix, in order of keys, whose words come nearest to it.

The order is never made by sorting a source in one task. A source of n documents has about
sqrt(n) buckets of keys with about sqrt(n) documents each, whatever its weights: a key's bucket is its
place in the distribution that the source's numbers of documents by weight give. The words of
buckets are summed before the shuffle and prefix-summed; only the one bucket of each source in
which the budget ends is sorted. What it yields is one cut key a source, so selection is a comparison without a shuffle, however hot
a source is.

Defined cases: null and empty texts have size 0; the null source is a source, the last; repeated
rows have equal keys and are counted, so that as many of them are taken as come nearest to the target
(where the cut parts such copies of one row, those copies alone are numbered in one task); a very
long text is taken whole or not, as comes nearer to the target; sources without words have target 0; an empty table gives an empty result; columns
named like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

#: Rows of the table of sources up to which it is broadcast; a row is below 200 bytes but for the name.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_weight(text: Column, size: Column) -> Column:
    """Quality weight 0.25 to 1: how near the mean length of a word with its space is to 6 characters."""
    mean = F.coalesce(F.try_divide(F.length(text).cast("double"), size.cast("double")), F.lit(0.0))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.abs(mean - 6.0) / 12.0)


def with_keys(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``_h`` (hash of id and text), ``_w`` (weight) and ``_key``."""
    text = F.col(text_col)
    sized = docs.withColumn("size", size_of(text))
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("#"), F.coalesce(F.md5(text), F.lit(""))))
    u = (F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return sized.withColumn("_h", h).withColumn("_w", default_weight(text, F.col("size")) if weight is None else weight).withColumn("_key", -F.log(u) / F.col("_w"))


def source_targets(keyed: DataFrame, source_col: str, cycle: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """A row for each source: size, number of documents, weight and target.

    Weights repeat over the sources in order of code points, null last. A target stops at ``cap``
    times the source's size; the excess goes to the others by weight until none is above its cap:
    in order of cap over weight, a source is full while its part of what is left exceeds its cap.
    """
    stats = keyed.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("_source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    everything = Window.partitionBy()
    caps = stats.withColumn("weight", weight).withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("_source"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = caps.withColumn("level", (F.col("budget") - before) / rest)
    full = F.col("level") * F.col("weight") >= F.col("cap")
    open_level = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(full, F.col("cap")).otherwise(open_level * F.col("weight"))
    return level.withColumn("target", target).select("_source", "source_size", "n_docs", "weight", "target")


def source_cuts(keyed: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The targets, with complete ``epochs`` and the bucket and last key of the fraction."""
    plan = source_targets(keyed, source_col, cycle, share, cap)
    plan = plan.join(weight_levels(keyed, source_col), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    plan = materialize(
        plan.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("n_buckets", F.ceil(F.sqrt(F.col("n_docs").cast("double")))), "targets"
    )
    placed = _with_plan(keyed.select(F.col(source_col).alias("_s"), "size", "_key", "_h"), "_s", plan)
    bucket = _bucket()
    sums = placed.groupBy("_source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    until = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket"))  # a row for each bucket
    ends = sums.withColumn("until", until).where(F.col("until") > F.col("left")).groupBy("_source").agg(F.min_by(F.struct("bucket", (F.col("until") - F.col("words")).alias("start")), "bucket").alias("end"))
    ends = materialize(ends.select(F.col("_source").alias("_of"), F.col("end.bucket").alias("cut_bucket"), F.col("end.start").alias("cut_start")), "ends")
    within = _hinted(placed, ends, F.col("_source").eqNullSafe(F.col("_of")) & (bucket == F.col("cut_bucket")), "inner")
    alike = within.groupBy("_source", "_key", "_h").agg(*[F.first(c).alias(c) for c in ("size", "left", "cut_start")], F.count(F.lit(1)).alias("copies"))
    in_order = Window.partitionBy("_source").orderBy("_key", "_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one bucket of a source
    room = F.col("left") - F.col("cut_start") - F.sum(F.col("size") * F.col("copies")).over(in_order) + F.col("size") * F.col("copies")
    fit = F.when(F.col("size") > 0, F.floor(F.try_divide(2 * room + F.col("size"), 2 * F.col("size")))).otherwise(F.when(room >= 0, F.col("copies")).otherwise(0))
    taken = alike.withColumn("fit", F.least(fit, "copies")).where(F.col("fit") > 0)
    last = taken.groupBy("_source").agg(F.max(F.struct("_key", "_h", "fit", "copies")).alias("last"))
    last = last.select(F.col("_source").alias("_at"), F.struct("last._key", "last._h").alias("cut"), F.col("last.fit").alias("cut_fit"), F.col("last.copies").alias("cut_copies"))
    cuts = plan.join(ends, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    return materialize(cuts.join(last, F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at"), "cuts")


def weight_levels(keyed: DataFrame, source_col: str) -> DataFrame:
    """A row for each source: ``levels``, the shares of its documents by weight, in steps of a quarter of a power of 2."""
    step = F.floor(F.log2("_w") * 4)
    counts = keyed.groupBy(F.col(source_col).alias("_s"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    one = F.struct(F.pow(F.lit(2.0), (F.col("step") + 0.5) / 4).alias("rate"), F.col("n").cast("double").alias("n"))
    return counts.groupBy("_s").agg(F.array_sort(F.collect_list(one)).alias("levels"))  # as many entries as there are steps


def _bucket() -> Column:
    """Grows with the key, and is of about even frequency: weights of rate r have keys up to k with probability 1 - exp(-r k)."""
    below = F.aggregate("levels", F.lit(0.0), lambda s, x: s + x["n"] * (F.lit(1.0) - F.exp(-F.col("_key") * x["rate"])))
    return F.floor(below / F.col("n_docs") * F.col("n_buckets"))


def _hinted(rows: DataFrame, few: DataFrame, on: Column, how: str) -> DataFrame:
    """Join with a table of sources: broadcast below a checked number of rows, else as the planner sees fit."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_SOURCES else few, on, how)


def _with_plan(rows: DataFrame, source_col: str, plan: DataFrame) -> DataFrame:
    return _hinted(rows, plan, F.col(source_col).eqNullSafe(F.col("_source")), "inner")


def apply_cuts(keyed: DataFrame, cuts: DataFrame, source_col: str = "source") -> DataFrame:
    """``keyed`` with ``source_size``, ``target``, ``times`` (copies that the mix takes) and ``taken`` (their words)."""
    rows = keyed.drop("source_size", "target", "times", "taken")
    placed = _with_plan(rows, source_col, cuts)
    few = F.lit(False)
    if not cuts.where("cut_fit < cut_copies").isEmpty():
        parted = F.coalesce((_bucket() == F.col("cut_bucket")) & (F.struct("_key", "_h") == F.col("cut")) & (F.col("cut_fit") < F.col("cut_copies")), F.lit(False))
        place = F.row_number().over(Window.partitionBy("_source").orderBy("_h"))  # copies of one row
        placed = placed.where(~parted).withColumn("_few", F.lit(False)).unionByName(placed.where(parted).withColumn("_few", place > F.col("cut_fit")))
        few = F.col("_few")
    inside = F.when(F.col("cut_bucket").isNull(), F.col("left") > 0).otherwise(
        (_bucket() < F.col("cut_bucket")) | (_bucket() == F.col("cut_bucket")) & F.coalesce(F.struct("_key", "_h") <= F.col("cut"), F.lit(False))
    )
    times = F.col("epochs") + F.when(inside & ~few, 1).otherwise(0)
    kept = [F.col(c) for c in rows.columns if c not in ("_key", "_h", "_w")]
    return placed.withColumn("times", times.cast("long")).select(*kept, "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **plan) -> DataFrame:
    """``docs`` with what the mix takes of each; no more than the keys is stored or shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_from"), F.col(text_col).alias("_text"))
    keyed = with_keys(whole, "_text", "_id").drop("_text", "_id")
    stored = materialize(keyed.drop("_row"), "keys")
    mixed = apply_cuts(keyed, source_cuts(stored, "_from", **plan), "_from")
    new = ["size", "source_size", "target", "times", "taken"]
    return mixed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in new], *new)
