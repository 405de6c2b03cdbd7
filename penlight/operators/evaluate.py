"""Evaluation: confusion counts, threshold sweeps, policy choices, percentile thresholds, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from penlight.functions.tables import written
from penlight.operators.penday import with_rates
from penlight.operators.quantiles import at_ranks, one_row, with_percentiles
from penlight.operators.series import confirm_runs


def counted(df: DataFrame, hit: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """n, n_alerts, tp, fn, fp, tn and rates by keys."""
    return with_rates(df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_alerts"), F.count_if(hit & truth).alias("tp"), F.count_if(~hit & truth).alias("fn"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & ~truth).alias("tn")))


def confusion(df: DataFrame, feature: str, threshold: float, sign: str, above: bool = True) -> DataFrame:
    """Rows with a null feature or sign do not count."""
    hit = F.col(feature) >= threshold if above else F.col(feature) <= threshold
    return counted(df.where(F.col(feature).isNotNull() & F.col(sign).isNotNull()), hit, F.col(sign))


def rule_confusion(df: DataFrame, rules: Mapping[str, Column], sign: str) -> DataFrame:
    """Combined rules (null is no hit) as long rows, one aggregation."""
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in rules.items()])
    long = df.where(F.col(sign).isNotNull()).select(sign, F.explode(hits).alias("h")).select(sign, "h.*")
    return counted(long, F.col("hit"), F.col(sign), ["rule"])


def sweep(df: DataFrame, pairs: Sequence[tuple[str, str]], thresholds: Sequence[float], above: bool = True) -> DataFrame:
    """Confusion of (score, sign) pairs at every threshold.

    Rows are counted once by score value and sign; only those counts meet the
    thresholds, so the cross product is of distinct values, not of rows.
    """
    long = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(g).alias("sign"), F.col(s).cast("double").alias("value"), F.col(g).alias("truth")) for s, g in pairs])
    held = df.select(F.explode(long).alias("x")).select("x.*").where("value is not null and truth is not null").groupBy("score", "sign", "value", "truth").agg(F.count("*").alias("k"))
    each = held.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return summed(each, above, ["score", "sign", "threshold"])


def summed(each: DataFrame, above: bool, keys: Sequence[str]) -> DataFrame:
    hit = F.col("value") >= F.col("threshold") if above else F.col("value") <= F.col("threshold")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    truth = F.col("truth")
    return with_rates(each.groupBy(*keys).agg(F.sum("k").alias("n"), part(hit).alias("n_alerts"), part(hit & truth).alias("tp"), part(~hit & truth).alias("fn"), part(hit & ~truth).alias("fp"), part(~hit & ~truth).alias("tn")))


def percentile_sweep(df: DataFrame, feature: str, sign: str, percentiles: Sequence[float], configured: float, above: bool = True) -> DataFrame:
    """A sweep over percentiles of the feature and the configured value."""
    known = df.where(F.col(feature).isNotNull() & F.col(sign).isNotNull())
    rows = known.groupBy(F.col(feature).cast("double").alias("value"), F.col(sign).alias("truth")).agg(F.count("*").alias("k"))
    cuts = one_row(known, [feature], percentiles).select(F.array_distinct(F.array_append(feature, F.lit(configured))).alias("cuts"))
    # One row of some ten thresholds.
    return summed(rows.join(F.broadcast(cuts)).withColumn("threshold", F.explode("cuts")), above, ["threshold"])


def best_rows(swept: DataFrame) -> DataFrame:
    """Of each score and sign the threshold of best F1, then precision, then sensitivity, then the smallest."""
    order = F.struct("f1", "precision", "sensitivity", -F.col("threshold"))
    best = swept.where("f1 is not null").groupBy("score", "sign").agg(F.max_by(F.struct("threshold", "n", "n_alerts", "f1", "precision", "sensitivity"), order).alias("b"))
    return best.select("score", "sign", "b.*")


def threshold_choices(swept: DataFrame) -> DataFrame:
    """Three policies from one sweep: best F1; sensitive (0.9 or more); precise (0.45 precision and 0.95 specificity). Where no threshold qualifies, the best F1 stands in."""
    order = F.struct("f1", "precision", -F.col("threshold"))
    sensitive, precise = F.col("sensitivity") >= 0.9, (F.col("precision") >= 0.45) & (F.col("specificity") >= 0.95)
    best = lambda cond: F.max_by("threshold", F.when(cond, order))
    found = swept.agg(best(F.lit(True)).alias("balanced"), best(sensitive).alias("_s"), best(precise).alias("_p"))
    one = found.select("balanced", F.coalesce("_s", "balanced").alias("screening"), F.coalesce("_p", "balanced").alias("high_confidence"))
    return one.unpivot([], ["balanced", "screening", "high_confidence"], "policy", "threshold")


def alert_burden(df: DataFrame, temperature: str, sign: str, policies: Mapping[str, float]) -> DataFrame:
    """Confusion and alerts per observed day for temperature policies, all in one aggregation."""
    p = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(float(t)).alias("threshold")) for n, t in policies.items()])
    long = df.where(F.col(temperature).isNotNull() & F.col(sign).isNotNull()).withColumn("_p", F.explode(p)).select("*", "_p.*")
    hit, truth = F.col(temperature) >= F.col("threshold"), F.col(sign)
    rows = long.groupBy("policy", "threshold").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_alerts"), F.count_if(hit & truth).alias("tp"), F.count_if(~hit & truth).alias("fn"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & ~truth).alias("tn"),
        F.count_distinct("date").alias("days"), F.count_distinct(F.when(hit, F.col("date"))).alias("alert_days"),
    )
    return with_rates(rows).withColumns({"alerts_per_day": F.try_divide(F.col("n_alerts"), F.col("days")), "false_alerts_per_day": F.try_divide(F.col("fp"), F.col("days")), "alerts_per_100": F.try_divide(100 * F.col("n_alerts"), F.col("n"))})


def percentile_thresholds(windows: DataFrame, percentiles: Sequence[float], keys: Sequence[str], order: Sequence[str], required: int = 3, error: str = "error") -> DataFrame:
    """For each percentile of the errors: threshold, windows above it, windows in confirmed runs."""
    cuts = one_row(windows, [error], [*(p / 100 for p in percentiles), 0.5]).select(F.col(error).alias("c"))
    named = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col("c")[i].alias("threshold"), F.col("c")[len(percentiles)].alias("median_error")) for i, p in enumerate(percentiles)])
    pairs = cuts.where("c is not null").select(F.explode(named).alias("x")).select("x.*")
    # A row for each percentile.
    rows = windows.join(F.broadcast(pairs)).withColumn("raw", F.col(error) > F.col("threshold"))
    done = confirm_runs(rows, "raw", ["percentile", *keys], order, required)
    return done.groupBy("percentile", "threshold").agg(F.count("*").alias("windows"), F.count_if("raw").alias("raw"), F.count_if("confirmed").alias("confirmed"), F.min(error).alias("min_error"), F.first("median_error").alias("median_error"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def detected(windows: DataFrame, fit_on: Column, percentile: float, keys: Sequence[str], order: Sequence[str], required: int = 3, error: str = "error") -> DataFrame:
    """Windows with threshold (a percentile of the windows to fit on), raw_anomaly and confirmed_anomaly."""
    cut = one_row(windows.where(fit_on), [error], [percentile / 100]).select(F.col(error)[0].alias("threshold"))
    # One row.
    rows = windows.join(F.broadcast(cut)).withColumn("raw_anomaly", F.col(error) > F.col("threshold"))
    return confirm_runs(rows, "raw_anomaly", keys, order, required, "confirmed_anomaly")


def detection_summary(rows: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("windows"), F.avg(error).alias("mean_error"), F.count_if("raw_anomaly").alias("raw"), F.count_if("confirmed_anomaly").alias("confirmed"), F.avg(F.col("raw_anomaly").cast("double")).alias("raw_rate"), F.avg(F.col("confirmed_anomaly").cast("double")).alias("confirmed_rate"))


def bootstrap_percentile(errors: DataFrame, percentile: float, replicates: int = 2000, ci: float = 0.9, seed: int = 42, error: str = "error") -> DataFrame:
    """Percentile of the errors with the interval of its bootstrap: the percentile of every sample of n errors, drawn with replacement.

    Only the ranks next to the percentile are drawn. The r-th smallest of n draws lies where
    the r-th smallest of n uniform numbers does, which is Beta-distributed, and the one after
    it follows from it; so a replicate costs two numbers, at any number of errors, and the
    errors are read for the values at those ranks alone. One error or none has no interval.
    """
    rows = errors.where(F.col(error).isNotNull() & ~F.isnan(error))
    n = rows.count()
    names = "threshold double, ci_low double, ci_high double, median double, replicates long, n_samples long, relative_width double"
    point = one_row(rows, [error], [percentile / 100]).select(F.col(error)[0].alias("threshold"))
    if n < 2:
        one = point.select("threshold", F.col("threshold").alias("ci_low"), F.col("threshold").alias("ci_high"), F.col("threshold").alias("median"), F.lit(0).cast("long").alias("replicates"), F.lit(n).cast("long").alias("n_samples"), F.lit(0.0).alias("relative_width"))
        return one.to(StructType.fromDDL(names))
    position = (n - 1) * percentile / 100
    rank, weight = int(position), position - int(position)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                u = rng.beta(rank + 1, n - rank)
                after = 1 - (1 - u) * rng.random() ** (1 / (n - rank - 1)) if rank + 1 < n else u
                out += [(i, 0, min(int(u * n), n - 1)), (i, 1, min(int(after * n), n - 1))]
            yield pd.DataFrame(out, columns=["replicate", "side", "rank"])

    drawn = written(errors.sparkSession.range(replicates).mapInPandas(draw, "replicate long, side int, rank long"), "ranks")
    first, last = drawn.agg(F.min("rank"), F.max("rank")).head()
    found = at_ranks(rows, error, drawn, first, last, n).groupBy("replicate").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    low, high = (1 - ci) / 2, 1 - (1 - ci) / 2
    # A row for each replicate.
    spread = found.select((F.col("a") + weight * (F.col("b") - F.col("a"))).alias("t")).agg(F.percentile("t", F.array(F.lit(low), F.lit(high), F.lit(0.5))).alias("q"), F.count("*").alias("replicates"))
    out = point.join(F.broadcast(spread)).select("threshold", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.col("q")[2].alias("median"), "replicates", F.lit(n).cast("long").alias("n_samples"))
    return out.withColumn("relative_width", F.try_divide(F.col("ci_high") - F.col("ci_low"), F.col("threshold"))).to(StructType.fromDDL(names))


def histogram(errors: DataFrame, bins: int = 12, error: str = "error") -> DataFrame:
    """Equal bins from the smallest to the largest value, the last one closed."""
    ends = errors.agg(F.min(error).alias("a"), F.max(error).alias("b"))
    # One row of ends.
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(error) - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return errors.where(F.col(error).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def group_shift(df: DataFrame, columns: Sequence[str], group: Column) -> DataFrame:
    """Means of columns where the group holds and where not, difference and relative change."""
    means = df.agg(*[F.struct(F.avg(F.when(group, F.col(c))).alias("inside"), F.avg(F.when(~group, F.col(c))).alias("outside")).alias(c) for c in columns])
    long = means.unpivot([], list(columns), "feature", "m").select("feature", "m.*")
    return long.withColumns({"difference": F.col("inside") - F.col("outside"), "relative_change": F.try_divide(F.col("inside") - F.col("outside"), F.col("outside"))})


def distribution(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max of columns, as rows."""
    long = df.unpivot(list(keys), list(columns), "feature", "value").where("value is not null")
    stats = long.groupBy(*keys, "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = F.col("quantiles")
    return with_percentiles(stats, df, columns, [0.25, 0.5, 0.75], keys).select(*keys, "feature", "n", "mean", "std", "min", q[0].alias("p25"), q[1].alias("median"), q[2].alias("p75"), "max")


def compatibility(left: DataFrame, right: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Distributions of features of two sources, by a map of left to right names: mean, population std, median, 90th percentile, ratio of means."""
    def stats(df: DataFrame, names: Sequence[str], side: str) -> DataFrame:
        known = [c for c in names if c in df.columns]
        long = df.select(*[F.col(c).cast("double") for c in known]).unpivot([], known, "feature", "value").where("value is not null")
        stats = long.groupBy("feature").agg(*[f.alias(f"{side}_{n}") for n, f in (("n", F.count("*")), ("mean", F.avg("value")), ("std", F.stddev_pop("value")))])
        return with_percentiles(stats, df, known, [0.5, 0.9]).withColumns({f"{side}_p50": F.col("quantiles")[0], f"{side}_p90": F.col("quantiles")[1]}).drop("quantiles")

    names = F.create_map(*[x for a, b in mapping.items() for x in (F.lit(a), F.lit(b))])
    a = stats(left, list(mapping), "left").withColumn("right_feature", F.element_at(names, F.col("feature")))
    b = stats(right, list(mapping.values()), "right").withColumnRenamed("feature", "right_feature")
    # A row for each feature; the estimate of rows made by unpivot says nothing.
    return a.join(b.hint("merge"), "right_feature").withColumn("mean_ratio", F.try_divide(F.col("right_mean"), F.col("left_mean")))


def compatibility_decision(found: DataFrame, enough: int = 10, some: int = 5) -> DataFrame:
    n = F.count("*")
    return found.agg(n.alias("shared_features"), F.when(n >= enough, "compatible").when(n >= some, "partly_compatible").otherwise("not_compatible").alias("decision"))
