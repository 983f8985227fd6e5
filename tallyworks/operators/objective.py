"""Loss arithmetic over arrays: token counts, weighted cross-entropy, window normalizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import IGNORED


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def language_tokens(labels: Column, weights: Column | None = None) -> Column:
    """Targets that count: labels from the second on that aren't ignored, or the sum of their weights, which must be finite and positive."""
    rest = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    counted = F.transform(rest, lambda x, i: F.when(x != IGNORED, F.lit(1.0) if weights is None else positive(F.get(weights, i + 1).cast("double"), "a token's weight")).otherwise(0.0))
    return _sum(counted)


def token_losses(logits: Column, labels: Column) -> Column:
    """Negative log-likelihood of each next token; null where it is ignored."""

    def one(scores: Column, i: Column) -> Column:
        target = F.get(labels, i + 1)
        top = F.array_max(scores)
        log_sum = top + F.log(_sum(F.transform(scores, lambda s: F.exp((s - top).cast("double")))))
        return F.when(target != IGNORED, log_sum - F.get(scores, target))

    return F.transform(F.slice(logits, F.lit(1), F.greatest(F.size(logits) - 1, F.lit(0))), one)


def language_loss(df: DataFrame, weighted: bool = False) -> DataFrame:
    """Adds numerator and denominator of the (weighted) mean loss of each row's logits and labels."""
    df = df.withColumn("__nll", token_losses(F.col("logits"), F.col("labels")))
    weight = (lambda i: F.get("weights", i + 1).cast("double")) if weighted else (lambda i: F.lit(1.0))
    return df.withColumns({
        "numerator": _sum(F.transform("__nll", lambda x, i: F.coalesce(x * weight(i), F.lit(0.0)))),
        "denominator": language_tokens(F.col("labels"), F.col("weights") if weighted else None),
    }).drop("__nll")


def positive(value: Column, what: str) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(ok, value).otherwise(F.raise_error(F.lit(f"{what} must be finite and positive")).cast("double"))


def normalizers(df: DataFrame, *by: str) -> DataFrame:
    """Denominators summed over windows of batches."""
    return df.groupBy(*by).agg(F.sum("denominator").alias("normalizer"))


def mean_losses(df: DataFrame, *by: str) -> DataFrame:
    """Exact means from additive parts: numerators over denominators, divided last."""
    return df.groupBy(*by).agg((F.sum("numerator") / positive(F.sum("denominator"), "the normalizer")).alias("loss"))


def logged_means(steps: DataFrame, logs: DataFrame, *by: str) -> DataFrame:
    """(``by``, step, loss): the mean at each log, over what has come since the log before; means start anew at each log.

    ``steps`` has by, step (a number), numerator and denominator, ``logs`` by and step; a log closes its own step. Steps after the
    last log are in no mean, a log without steps since the one before is an error, as a zero denominator is. The number of logs before a step says
    which segment it belongs to; it comes from counted ranges, so a run of any length is spread over tasks.
    """
    from .splits import sum_before

    rows = steps.select(*by, F.col("step").cast("long").alias("step"), "numerator", "denominator", F.lit(0).cast("long").alias("log"))
    marks = logs.select(*by, F.col("step").cast("long").alias("step")).distinct()
    rows = rows.unionByName(marks.withColumns({"numerator": F.lit(0.0), "denominator": F.lit(0.0), "log": F.lit(1).cast("long")}))
    segments = sum_before(rows, "step", "log", *by)
    sums = segments.groupBy(*by, "__before").agg(F.max(F.when(F.col("log") == 1, F.col("step"))).alias("step"), F.sum("numerator").alias("n"), F.sum("denominator").alias("d"))
    return sums.where("step IS NOT NULL").select(*by, "step", (F.col("n") / positive(F.col("d"), "the normalizer of a log")).alias("loss"))


def objective(losses: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """Weighted sum of the active losses (loss, value) by the losses table (loss, weight)."""
    return losses.join(weights.select("loss", "weight"), "loss").groupBy(*by).agg(F.sum(F.col("weight") * F.col("value")).alias("objective"))


def due(epoch: Column, every: int, last: Column) -> Column:
    """Whether something that comes every so many epochs, and at the end, is due."""
    return (F.floor(epoch) % every == 0) | last


def objective_report(losses: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """The objective beside a map of each active loss's own, unweighted value."""
    own = F.map_from_entries(F.array_sort(F.collect_list(F.struct("loss", "value")))).alias("losses")  # as many as there are kinds of loss
    return losses.join(weights.select("loss", "weight"), "loss").groupBy(*by).agg(F.sum(F.col("weight") * F.col("value")).alias("objective"), own)


def evaluation_normalizers(df: DataFrame, *by: str) -> DataFrame:
    """``normalizers`` of which none may be zero."""
    return normalizers(df, *by).withColumn("normalizer", positive(F.col("normalizer"), "the normalizer"))


def epoch_number(epoch: Column, begun: bool = False) -> Column:
    """Epochs that are complete, or that have begun."""
    return (F.ceil(epoch) if begun else F.floor(epoch)).cast("int")
