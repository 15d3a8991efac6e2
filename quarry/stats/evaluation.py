"""Evaluation of predictions: two classes, regression, bias by bucket.

Everything is one pass of aggregates, or counts by distinct score with running totals by ranges; only
figures of bounded number reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running
from ..plans.quantiles import quantiles


def _scored(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("y")).dropna()


def cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tp, fp) of each distinct score from the highest; tp and fp are running totals."""
    by = _scored(df, label, score).groupBy("score").agg(F.sum(F.col("y")).cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    return running(by, [-F.col("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def auc_ks(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: total, positive, negative, auc (ties count half), ks, and the best f1 over thresholds."""
    rows = cumulative(df, label, score)
    ends = rows.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    # the area: each negative counts the positives above it, and half of those with its score
    out = rows.crossJoin(F.broadcast(ends)).agg(  # one row
        F.first("p").alias("positive"), F.first("n").alias("negative"),
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.first("p") / F.first("n")).alias("auc"),
        F.max(F.abs(F.col("tp") / F.col("p") - F.col("fp") / F.col("n"))).alias("ks"),
        F.max(2 * F.col("tp") / (F.col("p") + F.col("tp") + F.col("fp"))).alias("f1"),
    )
    return out.select((F.col("positive") + F.col("negative")).alias("total"), "positive", "negative", "auc", "ks", "f1")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr)."""
    rows = cumulative(df, label, score)
    ends = rows.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    return rows.crossJoin(F.broadcast(ends)).select(F.col("score").alias("threshold"), (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))


def bin_edges(df: DataFrame, score: str, buckets: int, frequent: bool) -> list[float]:
    if frequent:
        return quantiles(df, {score: F.col(score).cast("double")}, [i / buckets for i in range(buckets + 1)])[score]
    low, high = df.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    return [low + (high - low) * i / buckets for i in range(buckets + 1)]


def bin_table(df: DataFrame, label: str, score: str, buckets: int = 10, frequent: bool = True, least: int = 0) -> list[dict]:
    """Bins from the highest score: counts, rates, and figures of all scores from the bin's start on.

    Bins are [a, b), the last one closed; empty ones have zeros and leave the running totals alone. A
    bin of under ``least`` rows tells its edges only, its other figures are None; it counts in the running totals.
    """
    rows = _scored(df, label, score)
    edges = bin_edges(rows, "score", buckets, frequent)
    number = reduce(lambda a, i: F.when(F.col("score") >= edges[i], F.lit(i)).otherwise(a), range(1, buckets), F.lit(0))
    held = {r["b"]: r for r in rows.groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.avg("score").alias("mean")).collect()}
    total, positive = sum(r["n"] for r in held.values()), sum(r["p"] for r in held.values())
    out, tp, fp = [], 0.0, 0.0
    for b in reversed(range(buckets)):
        r = held.get(b)
        n, p, mean = (r["n"], r["p"], r["mean"]) if r else (0, 0.0, 0.0)
        tp, fp = tp + p, fp + n - p
        recall, fpr = tp / positive if positive else 0.0, fp / (total - positive) if total > positive else 0.0
        precision = tp / (tp + fp) if tp + fp else 0.0
        out.append(
            {
                "start": edges[b], "end": edges[b + 1], "total": n, "positive": p, "negative": n - p, "positive_rate": p / n if n else 0.0, "mean_score": mean,
                "cumulative_total": tp + fp, "cumulative_positive": tp, "cumulative_negative": fp, "precision": precision, "recall": recall, "fpr": fpr, "ks": abs(recall - fpr),
                "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "lift": precision / (positive / total) if positive else 0.0, "share": n / total if total else 0.0,
            }
        )
        if n < least:
            out[-1] |= dict.fromkeys(out[-1].keys() - {"start", "end"})
    return out


def head_table(df: DataFrame, label: str, score: str, rates: tuple[float, ...] = (0.001, 0.005, 0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """Precision, recall and threshold at the lowest score whose false-positive rate is at most each of ``rates``."""
    rows = cumulative(df, label, score)
    ends = rows.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("rate", F.explode(F.array(*(F.lit(r) for r in rates)))).filter(F.col("fp") / F.col("n") <= F.col("rate"))
    best = rows.groupBy("rate").agg(F.min_by(F.struct("score", "tp", "fp", "p"), "score").alias("b"))
    return best.select("rate", F.col("b.score").alias("threshold"), (F.col("b.tp") / (F.col("b.tp") + F.col("b.fp"))).alias("precision"), (F.col("b.tp") / F.col("b.p")).alias("recall"))


def regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: rss, tss, r2, mse, rmse, mae, mape, the means, and mean and variance of the residuals."""
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("f")).dropna()
    e = F.col("y") - F.col("f")
    n = F.count(F.lit(1))
    out = rows.agg(F.sum(e * e).alias("rss"), (F.var_pop("y") * n).alias("tss"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col("y") != 0, F.abs(e / F.when(F.col("y") != 0, F.col("y"))))).alias("mape"), F.avg("y").alias("y_mean"), F.avg("f").alias("prediction_mean"), F.avg(e).alias("residual_mean"), F.var_pop(e).alias("residual_var"), n.alias("n"))
    return out.select("rss", "tss", (1 - F.col("rss") / F.col("tss")).alias("r2"), (F.col("rss") / F.col("n")).alias("mse"), F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), "mae", "mape", "y_mean", "prediction_mean", "residual_mean", "residual_var")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, start, n): equal widths between minimum and maximum, the last bin closed."""
    rows = df.select(value.cast("double").alias("x")).dropna()
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    number = F.when(F.col("b") == F.col("a"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")) * bins))).cast("int")
    return rows.groupBy(number.alias("bin")).agg((F.first("a") + (F.first("b") - F.first("a")) * F.first(number) / bins).alias("start"), F.count(F.lit(1)).alias("n"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int) -> DataFrame:
    return histogram(df, F.col(label) - F.col(prediction), bins)


def prediction_bias(df: DataFrame, label: str, prediction: str, buckets: int = 10, method: str = "equal_width", least: int = 0) -> DataFrame:
    """(bucket, n, avg_prediction, avg_label, bias, isna); a bucket of under ``least`` rows tells no figures."""
    rows = df.select(F.col(prediction).cast("double").alias("f"), F.col(label).cast("double").alias("y")).dropna()
    if method == "equal_width":
        ends = rows.agg(F.min("f").alias("a"), F.max("f").alias("b"))
        rows = rows.crossJoin(F.broadcast(ends))
        number = F.when(F.col("b") == F.col("a"), F.lit(0)).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("f") - F.col("a")) / F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")) * buckets)))
    else:
        n = rows.count()
        size = max(1, -(-n // buckets))
        rows = running(rows.withColumn("one", F.lit(1)), [F.col("f"), F.col("y")], {"at": F.col("one")})
        number = F.floor((F.col("at") - 1) / size)
    held = rows.groupBy(number.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("p"), F.avg("y").alias("l"))
    held = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left")
    told = F.coalesce(F.col("n"), F.lit(0)) >= max(1, least)
    return held.select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *(F.when(told, c).alias(a) for c, a in ((F.col("p"), "avg_prediction"), (F.col("l"), "avg_label"), (F.col("p") - F.col("l"), "bias"))), (~told).alias("isna"))
