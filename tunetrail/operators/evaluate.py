"""Scores, coefficient tables and explanations of models."""

from functools import reduce
from math import pi

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from tunetrail.functions.text import strip_prefix
from tunetrail.functions.values import skip_or_listen


def classification_metrics(df, label="skipped", prediction="prediction"):
    """Precision, recall, F1 and support of both classes, their averages, and accuracy.

    One aggregate counts the four (label, prediction) cells; the rest is arithmetic on it.
    """
    y, p = F.col(label), F.col(prediction)
    cells = df.where(y.isNotNull() & p.isNotNull()).agg(*[
        F.count_if((y == a) & (p == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    for c, o in ((0, 1), (1, 0)):
        hit = F.col(f"n{c}{c}")
        cells = cells.withColumns({
            f"s{c}": hit + F.col(f"n{c}{o}"),
            f"p{c}": ratio(hit, hit + F.col(f"n{o}{c}")),
            f"r{c}": ratio(hit, hit + F.col(f"n{c}{o}"))})
        cells = cells.withColumn(f"f{c}", ratio(2 * F.col(f"p{c}") * F.col(f"r{c}"), F.col(f"p{c}") + F.col(f"r{c}")))
    macro = lambda m: (F.col(f"{m}0") + F.col(f"{m}1")) / 2
    weighted = lambda m: ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), n)
    accuracy = ratio(F.col("n00") + F.col("n11"), n)
    row = lambda name, pr, re, f1, s: F.struct(
        F.lit(name).alias("class"), F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"),
        F.round(f1, 6).alias("f1"), s.cast("bigint").alias("support"))
    return cells.select(F.inline(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", accuracy, accuracy, accuracy, n),
        row("macro avg", macro("p"), macro("r"), macro("f"), n),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), n))))


def roc_auc(df, label="skipped", score="score"):
    """Exact area under the ROC curve as a one-row table, lazily; NULL without both classes.

    Equal scores are merged into counts of both classes. Ranges of the score (65536 of its arc
    tangent at most) carry the negatives before them, so scores are put in order within their range
    only. The area is the share of (positive, negative) pairs in the right order, ties half, summed exactly.
    """
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    merged = (df.where(y.isNotNull() & s.isNotNull()).groupBy(s.alias("_score"))
              .agg(F.count_if(y > 0.5).alias("_pos"), F.count_if(~(y > 0.5)).alias("_neg"))
              .withColumn("_range", F.when(F.isnan("_score"), 65536).otherwise(F.floor((F.atan("_score") / pi + 0.5) * 65536))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = merged.groupBy("_range").agg(F.sum("_neg").alias("_n")).select(
        F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    placed = merged.withColumn("_below", below).join(ranges, F.col("_range") == F.col("_at"))
    exact = lambda c: c.cast("decimal(19,0)")
    halves = exact(F.col("_pos")) * exact(2 * (F.col("_base") + F.col("_below")) + F.col("_neg"))
    totals = placed.agg(F.sum(halves).cast("double").alias("h"), F.sum("_pos").cast("double").alias("p"),
                        F.sum("_neg").cast("double").alias("n"))
    return totals.select(F.try_divide(F.col("h"), 2 * F.col("p") * F.col("n")).alias("auc"))


def effects(coefficients):
    """Rows (feature, coefficient) with size and direction of the effect."""
    return coefficients.withColumns({"abs_coefficient": F.abs("coefficient"),
                                     "category": skip_or_listen(F.col("coefficient"))})


def model_coefficients(spark, model, names):
    rows = [(name, float(c)) for name, c in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def coefficient_table(spark, model, names, n=None):
    """Coefficients by size of effect."""
    table = effects(model_coefficients(spark, model, names)).orderBy(F.desc("abs_coefficient"), "feature")
    return table if n is None else table.limit(n)


def wordcloud_table(spark, model, names):
    """Words with a non-zero coefficient: word, importance, coefficient, category."""
    return word_effects(model_coefficients(spark, model, names))


def word_effects(coefficients):
    """The word table of (feature, coefficient) rows; words are features without their prefix."""
    return (effects(coefficients).where("coefficient != 0")
            .select(strip_prefix(F.col("feature"), "lyric_").alias("word"),
                    F.col("abs_coefficient").alias("importance"), "coefficient", "category")
            .orderBy(F.desc("importance"), "word"))


def importance_table(spark, model, names, n=None):
    """Feature importances of a tree model, largest first."""
    rows = [(name, float(v)) for name, v in zip(names, model.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table if n is None else table.limit(n)


def tree_rules(model, names):
    """Split rules of a tree as text, with feature names."""
    text = model.toDebugString
    for i in reversed(range(len(names))):
        text = text.replace(f"feature {i} ", f"{names[i]} ")
    return text


def confident_skips(scored, threshold=0.85, n=3, label="target", probability="probability", key="play_id"):
    """Correct skip predictions above the threshold, most confident first."""
    return (scored.withColumn("confidence", vector_to_array(probability)[1])
            .where((F.col("confidence") > threshold) & (F.col(label) == 1))
            .orderBy(F.desc("confidence"), key).limit(n))


def explain_windows(windows, features, genre="primary_genre", key="play_id"):
    """Per window, step and feature: the value and its place between the window's min and max.

    Steps are labelled t-n … t-1; the target is play t. A feature constant over the window
    has intensity 0.5. Everything happens inside the row.
    """
    def cells(step, at):
        names = [F.lit(f) for f in features]
        return F.array(*[F.struct(
            F.concat(F.lit("t-"), (F.size("seq") - at).cast("string")).alias("step"),
            step[genre].alias("genre"), name.alias("feature"),
            step[f].cast("double").alias("value"),
            F.array_min(F.transform("seq", lambda s: s[f].cast("double"))).alias("low"),
            F.array_max(F.transform("seq", lambda s: s[f].cast("double"))).alias("high"))
            for f, name in zip(features, names)])

    long = windows.select(key, F.inline(F.flatten(F.transform("seq", cells))))
    spread = F.col("high") - F.col("low")
    return long.select(key, "step", "genre", "feature", "value",
                       F.when(spread == 0, 0.5).otherwise((F.col("value") - F.col("low")) / spread).alias("intensity"))


def compare_models(reports):
    """{model name: classification_metrics table} → (model, metric, value) for the skip class."""
    parts = []
    for name, report in reports.items():
        wide = report.agg(
            F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("Accuracy"),
            F.max(F.when(F.col("class") == "1", F.col("recall"))).alias("Recall"),
            F.max(F.when(F.col("class") == "1", F.col("precision"))).alias("Precision"),
            F.max(F.when(F.col("class") == "1", F.col("f1"))).alias("F1"))
        parts.append(wide.withColumn("model", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts).unpivot(
        "model", ["Accuracy", "Recall", "Precision", "F1"], "metric", "value")
