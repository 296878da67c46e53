"""Ranking and classification metrics over long rows (key..., id, score double, target int).

Undefined values are NULL, never NaN. Ranks over a whole class are taken in two levels, so no class is one task: rows are
sorted into ranges of score and id, which also cut rows of one score, and range offsets are running sums over small rows.
AUC, F1 and thresholds need only the counts of each distinct score, which are summed before any shuffle and written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import small
from spanloom.storage import saved

BUCKETS = 4096


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(df: DataFrame, row: list[str], logit: str, out: str = "score") -> DataFrame:
    """Adds the softmax of a row's logits, stable by subtracting their maximum."""
    whole = Window.partitionBy(*row)
    shifted = df.withColumn("__e", F.exp(F.col(logit) - F.max(logit).over(whole)))
    return shifted.withColumn(out, F.col("__e") / F.sum("__e").over(whole)).drop("__e")


def divide(a: Column, b: Column, otherwise=0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def bucket_of(score: str) -> Column:
    """Buckets that fall as the score rises: four fifths of them even over 0 to 1, the others for what lies outside."""
    x = F.col(score)
    line = F.when(x < 0, 0.125 * x / (1.0 - x)).when(x > 1, 1.0 + 0.125 * (1.0 - 1.0 / F.greatest(x, F.lit(1.0)))).otherwise(x)
    return F.floor((1.125 - line) / 1.25 * BUCKETS).cast("int")


def ranked(df: DataFrame, key: list[str], score: str, id_: str, target: str) -> DataFrame:
    """Adds rank (1 = highest score, ties by id) and hits (targets at this rank or better), per key."""
    ranges = df.repartitionByRange(*[F.col(k) for k in key], F.col(score).desc(), F.col(id_)).withColumn("__b", F.spark_partition_id())
    rows = saved(ranges, "ranges")
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key, "__b").agg(F.count("*").alias("__n"), F.sum(target).alias("__p"))
    offsets = offsets.select(*key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("__p0"))
    inside = Window.partitionBy(*key, "__b").orderBy(F.col(score).desc(), id_)
    return (
        rows.join(offsets, [*key, "__b"])
        .withColumn("rank", F.row_number().over(inside) + F.col("__n0"))
        .withColumn("hits", F.sum(target).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__p0"))
        .drop("__b", "__n0", "__p0")
    )


def average_precision(df: DataFrame, key: list[str], score: str = "score", id_: str = "id", target: str = "target") -> DataFrame:
    """key, ap: mean over positives of the precision at their rank; NULL without positives."""
    return ranked(df, key, score, id_, target).groupBy(*key).agg(F.avg(F.when(F.col(target) == 1, F.col("hits") / F.col("rank"))).alias("ap"))


def by_score(df: DataFrame, key: list[str], score: str, target: str) -> DataFrame:
    """key, score, n, pos of every distinct score: what AUC and thresholds need, summed before any shuffle."""
    return df.groupBy(*key, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("pos"))


def cumulative(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of by_score rows: adds n_above and pos_above, the counts at strictly higher scores."""
    sized = rows.withColumn("__b", bucket_of("score"))
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy(*key, "__b").agg(F.sum("n").alias("__n"), F.sum("pos").alias("__p"))
    offsets = offsets.select(*key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("__p0"))
    inside = Window.partitionBy(*key, "__b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.join(offsets, [*key, "__b"])
        .withColumn("n_above", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("__n0"))
        .withColumn("pos_above", F.coalesce(F.sum("pos").over(inside), F.lit(0)) + F.col("__p0"))
        .drop("__b", "__n0", "__p0")
    )


def roc_auc(df: DataFrame, key: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """key, auc: share of positive-negative pairs in order, ties half; NULL with one class only."""
    return auc_of(by_score(df, key, score, target), key)


def auc_of(counts: DataFrame, key: list[str]) -> DataFrame:
    """roc_auc from by_score rows."""
    rows = cumulative(counts, key)
    neg = F.col("n") - F.col("pos")
    wins = F.sum(neg * F.col("pos_above") + neg * F.col("pos") * 0.5)
    return rows.groupBy(*key).agg(F.when(F.sum("pos") * F.sum(neg) > 0, wins / (F.sum("pos") * F.sum(neg))).alias("auc"))


def prf1(df: DataFrame, key: list[str], predicted: str = "predicted", target: str = "target") -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1; 0 where a ratio is undefined."""
    p, t = F.col(predicted) == 1, F.col(target) == 1
    return with_ratios(df.groupBy(*key).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")))


def with_ratios(counted: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    return counted.withColumns(
        {
            "precision": divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def exact_match(df: DataFrame, row: list[str], predicted: str = "predicted", target: str = "target") -> DataFrame:
    """exact_match: the share of rows whose classes are all predicted right."""
    return df.groupBy(*row).agg(F.bool_and(F.col(predicted) == F.col(target)).alias("__ok")).agg(F.avg(F.col("__ok").cast("int")).alias("exact_match"))


def confusion(df: DataFrame, labels: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """truth, predicted, n for every pair of the label space (column name ``name``), zeros included."""
    grid = labels.select(F.col("name").alias(truth)).crossJoin(labels.select(F.col("name").alias(predicted)))
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return grid.join(counts, [truth, predicted], "left").select(truth, predicted, F.coalesce("n", F.lit(0)).alias("n"))


def multiclass(df: DataFrame, row: list[str], logit: str = "logit", class_: str = "class", truth: str = "truth", k: int = 5) -> DataFrame:
    """One row per input row: truth, predicted (highest logit, ties to the least class), in_top_k."""
    order = Window.partitionBy(*row).orderBy(F.col(logit).desc(), class_)
    ranks = df.withColumn("__r", F.row_number().over(order))
    return ranks.groupBy(*row).agg(
        F.first(truth).alias("truth"),
        F.max(F.when(F.col("__r") == 1, F.col(class_))).alias("predicted"),
        F.max((F.col(class_).eqNullSafe(F.col(truth)) & (F.col("__r") <= k)).cast("int")).alias("in_top_k"),
    )


def quantiles(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """Of cumulative() rows: key, q int, value: n evenly spaced quantiles from 0 to 1, with linear interpolation.

    Every distinct score yields the few quantiles whose neighbouring ranks it holds; no class's scores meet in one task.
    """
    total = rows.groupBy(*key).agg(F.sum("n").alias("__N"))
    sized = rows.join(total, key).withColumn("__hi", F.col("__N") - F.col("n_above")).withColumn("__lo", F.col("__hi") - F.col("n"))
    last = F.greatest(F.lit(1.0), (F.col("__N") - 1).cast("double"))
    place = lambda q: (q / float(n - 1)) * (F.col("__N") - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("__lo") - 1) * (n - 1) / last).cast("int") - 1)
    end = F.least(F.lit(n - 1), F.ceil(F.col("__hi") * (n - 1) / last).cast("int") + 1)
    held = lambda rank: (rank >= F.col("__lo")) & (rank < F.col("__hi"))
    near = sized.select(*key, "score", "__lo", "__hi", "__N", F.explode(F.sequence(F.least(first, end), end)).alias("q"))
    below, above = F.floor(place(F.col("q"))), F.ceil(place(F.col("q")))
    found = near.withColumn("a", F.when(held(below), F.col("score"))).withColumn("b", F.when(held(above), F.col("score"))).where("a IS NOT NULL OR b IS NOT NULL")
    both = found.withColumn("f", place(F.col("q")) - below).groupBy(*key, "q").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.first("f").alias("f"))
    return both.select(*key, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("value"))


def tune_thresholds(df: DataFrame, key: list[str], score: str = "score", target: str = "target", default: float = 0.5, min_positives: int = 8, most: int = 256) -> DataFrame:
    """key, threshold, f1: see thresholds_of."""
    return thresholds_of(saved(by_score(df, key, score, target), "by_score"), key, default, min_positives, most)


def thresholds_of(scores: DataFrame, key: list[str], default: float = 0.5, min_positives: int = 8, most: int = 256) -> DataFrame:
    """by_score rows -> key, threshold, f1: the median of the thresholds with the best F1, taken midway between distinct
    rounded scores.

    Above ``most`` distinct scores the candidates lie between ``most`` quantiles. Keys with fewer than ``min_positives``
    positives, or with a best F1 of 0, keep the default. Each key's candidates are at most ``most`` + 1 rows; everything
    else is a sum over buckets of scores. The rows are read several times, so they should be a written table.
    """
    totals = scores.groupBy(*key).agg(F.sum("pos").alias("__pos"))
    distinct = scores.select(*key, F.round("score", 6).alias("o")).distinct()
    counted = distinct.groupBy(*key).agg(F.count("*").alias("__d"))
    few = distinct.join(counted.where(F.col("__d") <= most).select(*key), key, "left_semi")
    many = scores.join(counted.where(F.col("__d") > most).select(*key), key, "left_semi")
    many = quantiles(cumulative(many, key), key, most).select(*key, F.col("value").alias("o")).distinct()
    line = Window.partitionBy(*key).orderBy("o")
    edges = few.unionByName(many).withColumn("__next", F.lead("o").over(line)).withColumn("__first", F.row_number().over(line) == 1)
    middle = (F.col("o") + F.coalesce("__next", F.col("o") + 1e-3)) / 2.0
    lowest = (F.col("o") - 1e-3 + F.col("o")) / 2.0
    candidates = saved(edges.select(*key, F.explode(F.when(F.col("__first"), F.array(lowest, middle)).otherwise(F.array(middle))).alias("score")), "candidates")
    zero = F.lit(0).cast("long")
    both = scores.withColumn("__c", F.lit(0)).unionByName(candidates.select(*key, "score", zero.alias("n"), zero.alias("pos"), F.lit(1).alias("__c")))
    both = both.groupBy(*key, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("__c").alias("__c"))
    tried = cumulative(both, key).where("__c = 1").join(totals, key)
    scored = tried.withColumn("f1", divide(2.0 * (F.col("pos_above") + F.col("pos")), F.col("n_above") + F.col("n") + F.col("__pos")))
    best = scored.withColumn("__best", F.max("f1").over(Window.partitionBy(*key)))
    fitted = best.where((F.col("__pos") >= min_positives) & (F.col("__best") > 0) & (F.col("f1") >= F.col("__best") - 1e-9))
    fitted = fitted.groupBy(*key).agg(F.percentile("score", F.lit(0.5)).alias("threshold"), F.max("f1").alias("f1"))
    return totals.select(*key).join(fitted, key, "left").select(*key, F.coalesce("threshold", F.lit(default)).alias("threshold"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def evaluate_multilabel(df: DataFrame, key: str = "class", row: str = "id", logit: str = "logit", target: str = "target", threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(per class: ap, auc, precision, recall, f1, support, thresh; one row of map, macro and micro metrics, exact match)."""
    scored = saved(df.select(key, row, sigmoid(F.col(logit)).alias("score"), F.col(target).cast("int").alias("target")), "scored")
    counts = saved(by_score(scored, [key], "score", "target"), "by_score")
    if threshold is None:
        limits = saved(thresholds_of(counts, [key]).select(key, "threshold"), "thresholds")
    else:
        limits = counts.select(key).distinct().withColumn("threshold", F.lit(float(threshold)))
    limit = small(limits)
    cut = counts.join(limit, key).withColumn("over", F.col("score") >= F.col("threshold"))
    sums = [F.sum(F.when(F.col("over"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("over"), F.col("n") - F.col("pos")).otherwise(0)).alias("fp")]
    sums += [F.sum(F.when(F.col("over"), 0).otherwise(F.col("pos"))).alias("fn"), F.sum("pos").alias("support"), F.first("threshold").alias("thresh")]
    each = saved(cut.groupBy(key).agg(*sums).join(average_precision(scored, [key], id_=row), key).join(auc_of(counts, [key]), key), "each")
    per = with_ratios(each).select(key, "ap", "auc", "precision", "recall", "f1", "support", "thresh")
    macro = per.agg(F.avg("ap").alias("map"), F.coalesce(F.avg(F.when(F.col("ap").isNotNull(), F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    micro = with_ratios(each.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    micro = micro.select(F.col("f1").alias("micro_f1"), F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"))
    predicted = scored.join(limit, key).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return per, macro.crossJoin(micro).crossJoin(exact_match(predicted, [row]))


def table(per: DataFrame, key: str = "class", sort: str | None = None, most: int = 1000) -> str:
    """Per-class metrics as a text of fixed columns, at most ``most`` classes; undefined values read n/a."""
    columns = [c for c in per.columns if c != key]
    rows = per.orderBy(*[x for x in (sort, key) if x]).limit(most).collect()
    shown = lambda x: "n/a" if x is None else str(x) if isinstance(x, (int, str)) else f"{x:.4f}"
    cells = [[str(r[key]), *(shown(r[c]) for c in columns)] for r in rows]
    widths = [max(len(x) for x in column) + 2 for column in zip([key, *columns], *cells, strict=True)]
    line = lambda row: row[0].ljust(widths[0]) + "".join(x.rjust(w) for x, w in zip(row[1:], widths[1:], strict=True))
    return "\n".join([line([key, *columns]), "-" * sum(widths), *map(line, cells)])


def format_confusion(counts: DataFrame, most: int = 100) -> str:
    """confusion()'s rows as a square text, truth down and prediction across, for at most ``most`` labels."""
    rows = counts.limit(most * most).collect()
    names = sorted({r[0] for r in rows})
    n = {(r[0], r[1]): r[2] for r in rows}
    width = max([len(str(x)) for x in [*names, *n.values()]], default=1) + 2
    lines = ["".ljust(width) + "".join(str(x).rjust(width) for x in names)]
    return "\n".join(lines + [str(a).ljust(width) + "".join(str(n.get((a, b), 0)).rjust(width) for b in names) for a in names])


def evaluate_multiclass(df: DataFrame, row: str = "id", class_: str = "class", logit: str = "logit", truth: str = "truth", tune: bool = True) -> tuple[DataFrame, DataFrame]:
    """(per class: precision, recall, f1, ap, support, thresh; one row of balanced accuracy, top1, top5, macro F1, map)."""
    found = multiclass(df, [row], logit, class_, truth)
    scored = softmax(df, [row], logit).select(row, class_, "score", (F.col(class_) == F.col(truth)).cast("int").alias("target"))
    scored = saved(scored, "scored")
    names = df.select(class_).distinct()
    n = names.count()
    truths = found.groupBy(F.col("truth").alias(class_)).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("tp"))
    chosen = found.groupBy(F.col("predicted").alias(class_)).agg(F.count("*").alias("chosen"))
    per = names.join(truths, class_, "left").join(chosen, class_, "left").na.fill(0, ["support", "tp", "chosen"])
    per = per.withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).withColumn("precision", divide(F.col("tp"), F.col("chosen")))
    both = F.coalesce("recall", F.lit(0.0)) + F.col("precision")
    per = per.withColumn("f1", F.when((F.col("support") > 0) & (both > 0), 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(0.0))
    per = per.join(average_precision(scored, [class_], id_=row), class_)
    limits = tune_thresholds(scored, [class_], default=1.0 / n) if tune else names.withColumn("threshold", F.lit(1.0 / n))
    per = per.join(limits.select(class_, F.col("threshold").alias("thresh")), class_).select(class_, "precision", "recall", "f1", "ap", "support", "thresh")
    total = found.agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("top1"), F.avg("in_top_k").alias("top5"))
    macro = per.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("balanced_accuracy"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), F.avg("ap").alias("map")
    )
    return per, total.crossJoin(macro)
