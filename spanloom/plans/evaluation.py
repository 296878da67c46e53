"""Queries on scores and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import metrics as m
from spanloom.plans.bindings import LOGITS, SCORED, class_logits, scored_documents
from spanloom.plans.registry import register


def scores(spark, sf_dir):
    return scored_documents(spark, sf_dir).withColumn("score", m.sigmoid(F.col("logit")))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@register("sigmoid_scores", f"WITH {SCORED} SELECT id, class, round(score, 9) AS score FROM sc")
def sigmoid_scores(spark, sf_dir):
    return rounded(scores(spark, sf_dir), "score").select("id", "class", "score")


@register(
    "softmax_scores",
    f"""WITH {LOGITS}, e AS (SELECT id, class, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM lo)
    SELECT id, CAST(class AS INT) AS class, round(e / sum(e) OVER (PARTITION BY id), 9) AS score FROM e""",
)
def softmax_scores(spark, sf_dir):
    return rounded(m.softmax(class_logits(spark, sf_dir), ["id"], "logit"), "score").select("id", "class", "score")


AP = """r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, id) AS rank, sum(target) OVER (PARTITION BY class ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS hits FROM sc),
ap AS (SELECT class, avg(CASE WHEN target = 1 THEN CAST(hits AS DOUBLE) / rank END) AS ap FROM r GROUP BY class)"""
AUC = """rk AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2e0 AS ar FROM sc),
auc AS (SELECT class, (sum(CASE WHEN target = 1 THEN ar END) - sum(target) * (sum(target) + 1) / 2e0) / (sum(target) * (count(*) - sum(target))) AS auc FROM rk GROUP BY class)"""


@register("average_precision", f"WITH {SCORED}, {AP} SELECT class, round(ap, 9) AS ap FROM ap")
def average_precision(spark, sf_dir):
    return rounded(m.average_precision(scores(spark, sf_dir), ["class"]), "ap")


@register("roc_auc", f"WITH {SCORED}, {AUC} SELECT class, round(auc, 9) AS auc FROM auc")
def roc_auc(spark, sf_dir):
    return rounded(m.roc_auc(scores(spark, sf_dir), ["class"]), "auc")


PRF = """c AS (SELECT class, count(*) FILTER (score >= th AND target = 1) AS tp, count(*) FILTER (score >= th AND target = 0) AS fp, count(*) FILTER (score < th AND target = 1) AS fn, sum(target) AS support FROM th JOIN sc USING (class) GROUP BY class),
prf AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1 FROM c)"""
HALF = "th AS (SELECT DISTINCT class, 0.5e0 AS th FROM sc)"


def predicted(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("prf1", f"WITH {SCORED}, {HALF}, {PRF} SELECT class, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM prf")
def prf1(spark, sf_dir):
    return rounded(m.prf1(predicted(spark, sf_dir), ["class"]), "precision", "recall", "f1")


@register(
    "micro_f1",
    f"""WITH {SCORED}, {HALF}, {PRF}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM prf)
    SELECT tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 9) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s""",
)
def micro_f1(spark, sf_dir):
    return rounded(m.prf1(predicted(spark, sf_dir), []), "precision", "recall", "f1")


EXACT = "ex AS (SELECT avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS exact_match FROM (SELECT id, bool_and((score >= th) = (target = 1)) AS ok FROM sc JOIN th USING (class) GROUP BY id))"


@register("exact_match", f"WITH {SCORED}, {HALF}, {EXACT} SELECT round(exact_match, 9) AS exact_match FROM ex")
def exact_match(spark, sf_dir):
    return rounded(m.exact_match(predicted(spark, sf_dir), ["id"]), "exact_match")


TOP = f"""{LOGITS}, rr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, class) AS r FROM lo),
tp AS (SELECT id, any_value(truth) AS truth, CAST(max(CASE WHEN r = 1 THEN class END) AS INT) AS predicted, max(CASE WHEN r <= 5 AND class = truth THEN 1 ELSE 0 END) AS in5 FROM rr GROUP BY id)"""


@register(
    "confusion_matrix",
    f"""WITH {TOP}, g AS (SELECT CAST(a AS INT) AS truth, CAST(b AS INT) AS predicted FROM range(0, 10) x(a), range(0, 10) y(b))
    SELECT g.truth, g.predicted, count(tp.id) AS n FROM g LEFT JOIN tp ON g.truth = tp.truth AND g.predicted = tp.predicted GROUP BY ALL""",
)
def confusion_matrix(spark, sf_dir):
    labels = spark.range(10).select(F.col("id").cast("int").alias("name"))
    return m.confusion(m.multiclass(class_logits(spark, sf_dir), ["id"]), labels)


@register("topk_accuracy", f"WITH {TOP} SELECT round(avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0e0 END), 9) AS top1, round(avg(CAST(in5 AS DOUBLE)), 9) AS top5 FROM tp")
def topk_accuracy(spark, sf_dir):
    found = m.multiclass(class_logits(spark, sf_dir), ["id"])
    return found.agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("int")), 9).alias("top1"), F.round(F.avg("in_top_k"), 9).alias("top5"))


@register(
    "balanced_accuracy",
    f"WITH {TOP} SELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT truth, avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0e0 END) AS r FROM tp GROUP BY truth)",
)
def balanced_accuracy(spark, sf_dir):
    return rounded(m.evaluate_multiclass(class_logits(spark, sf_dir), tune=False)[1].select("balanced_accuracy"), "balanced_accuracy")


def tuned(src: str, default: str, positives: int = 8) -> str:
    return f"""ro AS (SELECT DISTINCT class, round(score, 6) AS o FROM {src}), nd AS (SELECT class, count(*) AS d FROM ro GROUP BY class),
qs AS (SELECT class, unnest(quantile_cont(score, [i / 255e0 for i in range(0, 256)])) AS o FROM {src} GROUP BY class),
ob AS (SELECT ro.class, o FROM ro JOIN nd USING (class) WHERE d <= 256 UNION ALL SELECT DISTINCT qs.class, o FROM qs JOIN nd USING (class) WHERE d > 256),
ca AS (SELECT class, (o + coalesce(lead(o) OVER (PARTITION BY class ORDER BY o), o + 1e-3)) / 2e0 AS t FROM ob UNION ALL SELECT class, (min(o) - 1e-3 + min(o)) / 2e0 FROM ob GROUP BY class),
po AS (SELECT class, sum(target) AS pos FROM {src} GROUP BY class),
fs AS (SELECT ca.class, t, pos, 2e0 * sum(CASE WHEN score >= t THEN target ELSE 0 END) / (sum(CASE WHEN score >= t THEN 1 ELSE 0 END) + pos) AS f1
  FROM ca JOIN po USING (class) JOIN {src} s ON s.class = ca.class GROUP BY ca.class, t, pos),
be AS (SELECT class, max(f1) AS best FROM fs GROUP BY class),
tu AS (SELECT class, quantile_cont(t, 0.5e0) AS threshold, max(f1) AS f1 FROM fs JOIN be USING (class) WHERE pos >= {positives} AND best > 0 AND f1 >= best - 1e-9 GROUP BY class),
tt AS (SELECT po.class, coalesce(threshold, {default}) AS threshold, coalesce(f1, 0e0) AS f1 FROM po LEFT JOIN tu USING (class))"""


@register("tune_thresholds", f"WITH {SCORED}, {tuned('sc', '0.5e0')} SELECT class, round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM tt")
def tune_thresholds(spark, sf_dir):
    return rounded(m.tune_thresholds(scores(spark, sf_dir), ["class"]), "threshold", "f1")


TUNED = f"{SCORED}, {tuned('sc', '0.5e0')}, th AS (SELECT class, threshold AS th FROM tt)"


@register(
    "evaluate_multilabel",
    f"""WITH {TUNED}, {AP}, {AUC}, {PRF} SELECT class, round(ap, 9) AS ap, round(auc, 9) AS auc, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
    CAST(support AS BIGINT) AS support, round(th, 9) AS thresh FROM prf JOIN ap USING (class) JOIN auc USING (class) JOIN th USING (class)""",
)
def evaluate_multilabel(spark, sf_dir):
    return rounded(m.evaluate_multilabel(scored_documents(spark, sf_dir))[0], "ap", "auc", "precision", "recall", "f1", "thresh")


@register(
    "evaluate_multilabel_summary",
    f"""WITH {TUNED}, {AP}, {PRF}, {EXACT}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM prf)
    SELECT round((SELECT avg(ap) FROM ap), 9) AS map, round((SELECT avg(f1) FROM prf JOIN ap USING (class) WHERE ap IS NOT NULL), 9) AS macro_f1, round(2e0 * tp / (2 * tp + fp + fn), 9) AS micro_f1,
    round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS micro_precision, round(CAST(tp AS DOUBLE) / (tp + fn), 9) AS micro_recall, round(exact_match, 9) AS exact_match FROM s, ex""",
)
def evaluate_multilabel_summary(spark, sf_dir):
    return rounded(m.evaluate_multilabel(scored_documents(spark, sf_dir))[1], "map", "macro_f1", "micro_f1", "micro_precision", "micro_recall", "exact_match")


@register(
    "evaluate_multiclass",
    f"""WITH {TOP}, e AS (SELECT id, class, truth, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM lo),
    sc AS (SELECT id, class, e / sum(e) OVER (PARTITION BY id) AS score, CASE WHEN class = truth THEN 1 ELSE 0 END AS target FROM e), {AP},
    s AS (SELECT class, (SELECT count(*) FROM tp WHERE truth = class) AS support, (SELECT count(*) FROM tp WHERE predicted = class) AS chosen, (SELECT count(*) FROM tp WHERE predicted = class AND truth = class) AS hit
      FROM (SELECT DISTINCT class FROM lo)),
    p AS (SELECT class, support, CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support END AS recall, CASE WHEN chosen > 0 THEN CAST(hit AS DOUBLE) / chosen ELSE 0e0 END AS precision FROM s)
    SELECT CAST(class AS INT) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall,
    round(CASE WHEN support > 0 AND precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END, 9) AS f1, round(ap, 9) AS ap, support, 0.1e0 AS thresh FROM p JOIN ap USING (class)""",
)
def evaluate_multiclass(spark, sf_dir):
    return rounded(m.evaluate_multiclass(class_logits(spark, sf_dir), tune=False)[0], "precision", "recall", "f1", "ap")
