"""Group-aware stratified splits and long-tail resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the grid over [0, 1) that leads draws to buckets.
CELLS = 4096


def unit(*columns) -> Column:
    """A number in [0, 1) from a hash of the columns: the same for the same values anywhere."""
    key = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.left(F.md5(key), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def make_splits(df: DataFrame, group: str, labels: str, fractions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """group, split: no group is in two splits, and rare labels reach every split.

    Groups are placed from the rarest label to the commonest, in hash order among equals. Within a label each group takes
    the split whose share of the label's rows ends nearest: running counts replace a greedy fold on the driver, so groups
    are never collected. A label's groups form one window; their running count needs only (label, n).
    """
    fractions = {k: v for k, v in (fractions or {"train": 0.8, "val": 0.2}).items()}
    total = sum(fractions.values())
    if total <= 0:
        raise ValueError("split fractions must sum to a positive number")
    shares = [(k, v / total) for k, v in fractions.items() if v > 0]
    per_label = df.select(F.col(group).alias("group"), F.explode_outer(labels).alias("label"))
    totals = per_label.groupBy("label").agg(F.count("*").alias("label_rows"))
    sizes = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    rarest = per_label.join(totals, "label").groupBy("group").agg(F.min(F.struct("label_rows", "label")).alias("r"))
    placed = sizes.join(rarest, "group", "left").select("group", "n", F.coalesce("r.label", F.lit("")).alias("label"), unit("group", F.lit(seed)).alias("u"))
    bucket = F.floor(F.col("u") * 1024).cast("int")
    placed = placed.withColumn("b", bucket)
    before = Window.partitionBy("label").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("label")
    offsets = placed.groupBy("label", "b").agg(F.sum("n").alias("m"))
    offsets = offsets.select("label", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.sum("m").over(whole).alias("all"))
    inside = Window.partitionBy("label", "b").orderBy("u", "group").rowsBetween(Window.unboundedPreceding, 0)
    middle = (F.sum("n").over(inside) + F.col("m0") - F.col("n") / 2.0) / F.col("all")
    at = placed.join(offsets, ["label", "b"]).withColumn("at", middle)
    choice = F.lit(shares[-1][0])
    for i in range(len(shares) - 2, -1, -1):
        choice = F.when(F.col("at") < sum(share for _, share in shares[: i + 1]), F.lit(shares[i][0])).otherwise(choice)
    return at.select("group", choice.alias("split"))


def label_counts(df: DataFrame, labels: str, names: list[str] | None = None) -> DataFrame:
    """label, n; with names also the labels without rows."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    if names is None:
        return counts
    dim = df.sparkSession.createDataFrame([(x,) for x in names], "label string")
    return dim.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def repeat_factors(df: DataFrame, id_: str, labels: str, threshold: float = 0.05, most: float = 8.0) -> DataFrame:
    """id, factor: the largest over a row's labels of sqrt(threshold / frequency), within 1 and ``most``; 1 without labels."""
    n = df.count()
    counts = label_counts(df, labels).select("label", F.greatest(F.lit(1.0), F.least(F.lit(most), F.sqrt(threshold / (F.col("n") / F.lit(float(max(1, n))))))).alias("f"))
    rows = df.select(F.col(id_).alias("id"), F.explode_outer(labels).alias("label")).join(counts, "label", "left")
    return rows.groupBy("id").agg(F.coalesce(F.max("f"), F.lit(1.0)).alias("factor"))


def draw_repeats(factors: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """id, copy: every row floor(factor) times, and once more with the fraction's chance; another epoch draws anew."""
    whole = F.floor("factor")
    extra = (unit("id", F.lit(seed), F.lit(epoch)) < F.col("factor") - whole).cast("long")
    return factors.select("id", F.explode(F.sequence(F.lit(1).cast("long"), whole + extra)).alias("copy"))


def build_sampler(df: DataFrame, id_: str, labels: str, balanced: bool = True, multilabel: bool = True, seed: int = 0, epoch: int = 0) -> DataFrame | None:
    """id, copy or draw: the epoch's rows by the sampler that the task calls for; None, for all rows once, if not balanced.

    Several labels a row: repeats by the rarest of them. One label a row: as many weighted draws as there are rows.
    """
    if not balanced:
        return None
    if multilabel:
        return draw_repeats(repeat_factors(df, id_, labels), seed, epoch)
    return draw_weighted(class_balanced_weights(df, id_, labels), df.count(), seed * 1_000_003 + epoch)


def class_balanced_weights(df: DataFrame, id_: str, labels: str) -> DataFrame:
    """id, weight: mean over a row's labels of 1 / count, 1 without labels, divided by their sum."""
    counts = label_counts(df, labels)
    rows = df.select(F.col(id_).alias("id"), F.explode_outer(labels).alias("label")).join(counts, "label", "left")
    raw = rows.groupBy("id").agg(F.coalesce(F.avg(F.when(F.col("n") > 0, 1.0 / F.col("n"))), F.lit(1.0)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("id", (F.col("raw") / F.col("total")).alias("weight"))


def draw_weighted(weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """draw, id: n draws with replacement, by each row's share of the line.

    Rows get consecutive stretches of [0, 1) by two-level running sums. A draw finds its bucket of rows through the cells of
    an even grid, and its row as the last one that begins before it, in one ordered pass over the bucket.
    """
    rows = weights.withColumn("b", F.floor(unit("id") * 1024).cast("int"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("b").agg(F.sum("weight").alias("m")).select("b", F.coalesce(F.sum("m").over(before), F.lit(0.0)).alias("m0"), "m")
    inside = Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.join(F.broadcast(offsets), "b").withColumn("high", F.sum("weight").over(inside) + F.col("m0")).withColumn("low", F.col("high") - F.col("weight"))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), unit("id", F.lit(seed)).alias("u"))
    cell = lambda x: F.floor(x * CELLS).cast("int")
    stretch = offsets.select("b", "m0", (F.col("m0") + F.col("m")).alias("m1"))
    stretch = stretch.withColumn("cell", F.explode(F.sequence(cell(F.col("m0")), cell(F.col("m1")))))
    dealt = draws.withColumn("cell", cell(F.col("u"))).join(F.broadcast(stretch), "cell").where((F.col("u") >= F.col("m0")) & (F.col("u") < F.col("m1")))
    none = F.lit(None)
    points = line.select("b", F.col("low").alias("at"), F.lit(0).alias("kind"), "id", none.cast("long").alias("draw"))
    points = points.unionByName(dealt.select("b", F.col("u").alias("at"), F.lit(1).alias("kind"), none.cast(weights.schema["id"].dataType).alias("id"), "draw"))
    so_far = Window.partitionBy("b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("id", F.last("id", ignorenulls=True).over(so_far)).where("kind = 1").select("draw", "id")
