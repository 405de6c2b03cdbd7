"""Pen-days: feeding, climate and health rollups, rule scores, alert policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlight.operators.rules import BONUS, SEVERITY

KEYS = ("experiment", "pen_id", "date")
# Thresholds of the pen-day rules, temperature policies and alert levels.
THRESHOLDS = {"feed_drop": -1.5, "co2_high": 2984.0, "nh3_high": 29.0, "barn_temp_high": 31.6, "humidity_high": 75.0}
TEMPERATURES = (("high_confidence", 31.6), ("balanced", 30.4), ("screening", 28.7))
LEVELS = ("cctv_focus", "caution", "observe", "normal")
OBSERVE, CAUTION, FOCUS = 0.3, 0.6, 0.9
RULES = (("feed_drop", "feed_zscore", "<=", "medium"), ("co2_high", "co2_max", ">=", "low"), ("nh3_high", "ammonia_max", ">=", "low"), ("barn_temp_high", "temperature_max", ">=", "medium"), ("humidity_high", "humidity_max", ">=", "low"))


def feeding_day(visits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records, valid visits, ghost and filling visits, intake, means of valid visits, active animals, intake per animal."""
    valid = (F.col("tattoo") == "ok") & (F.col("intake") > 0)
    active = F.count_distinct(F.when(valid, F.col("pig")))
    return visits.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.count_if(valid).alias("valid_visits"),
        F.count_if(F.col("tattoo") == "GHOST").alias("ghost_visits"),
        F.count_if(F.col("tattoo") == "FILLING").alias("filling_visits"),
        F.sum(F.when(valid, F.col("intake"))).alias("feed_intake"),
        F.avg(F.when(valid, F.col("duration"))).alias("mean_duration"),
        active.alias("active_pigs"),
        F.count_distinct("station").alias("stations"),
        F.try_divide(F.sum(F.when(valid, F.col("intake"))), active).alias("intake_per_pig"),
    )


def feeding_hour(visits: DataFrame, keys: Sequence[str] = ("experiment", "pen_id")) -> DataFrame:
    hour = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("visited_at").cast("timestamp")) / 3600) * 3600).cast("timestamp_ntz")
    return visits.withColumn("datetime", hour).groupBy(*keys, "datetime").agg(F.sum("intake").alias("feed_intake"), F.count("*").alias("visits"))


def station_pens(registrations: DataFrame) -> DataFrame:
    """Registered animals of each station and pen."""
    return registrations.groupBy("experiment", "station", "pen_id").agg(F.count("*").alias("registered_pigs"))


def with_pens(rows: DataFrame, pens: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows with the pens of their station; a station of several pens multiplies them. The map is sent to all tasks up to `most` rows."""
    small = pens.limit(most + 1).count() <= most
    return rows.join(F.broadcast(pens) if small else pens, ["experiment", "station"], "left")


def climate_day(readings: DataFrame, measures: Mapping[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, maximum and minimum of each measure, as columns. measures: text found in `label` -> name."""
    name = F.lit(None).cast("string")
    for text, measure in reversed(measures.items()):
        name = F.when(F.contains(F.lower("label"), F.lit(text)), measure).otherwise(name)
    known = list(dict.fromkeys(measures.values()))
    rows = readings.withColumn("measure", name).where("measure is not null")
    return rows.groupBy(*keys).pivot("measure", known).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))


def health_day(health: DataFrame, signs: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, animals, and sums and maxima of signs; a sum over nulls alone is null."""
    return health.groupBy(*keys).agg(F.count("*").alias("health_rows"), F.count_distinct("pig").alias("health_pigs"), *[x for s in signs for x in (F.sum(s).alias(f"{s}_sum"), F.max(s).alias(f"{s}_max"))])


def pen_days(feeding: DataFrame, climate: DataFrame, health: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return feeding.join(climate, list(keys), "full_outer").join(health, list(keys), "full_outer")


def date_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("date").cast("long"), "month": F.month("date").cast("long"), "is_jan_to_may": F.month("date").between(1, 5)})


def availability(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, pens, first and last day, and days with each column, by year and month."""
    return date_parts(df).groupBy("year", "month").agg(F.count("*").alias("rows"), F.count_distinct("experiment", "pen_id").alias("pens"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *[F.count(c).alias(f"{c}_days") for c in columns])


def signs(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Flags of sign groups, and any_signs; null counts as none."""
    found = {n: reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns]) > 0 for n, columns in groups.items()}
    return df.withColumns(found | {"any_signs": reduce(lambda a, b: a | b, found.values())})


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("pen_label", F.when(F.coalesce("health_rows", F.lit(0)) == 0, "unobserved").when(F.col("any_signs"), "symptomatic").otherwise("normal"))


def observed(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("health_rows", F.lit(0)) > 0)


def rule_scores(df: DataFrame, thresholds: Mapping[str, float | None] = THRESHOLDS) -> DataFrame:
    """Five rule flags, management, environment and total scores with bonus, and the reasons in rule order."""
    flags = {}
    for rule, column, op, _ in RULES:
        limit = thresholds.get(rule)
        known = limit is not None and column in df.columns
        flags[rule] = F.coalesce(F.col(column) <= limit if op == "<=" else F.col(column) >= limit, F.lit(False)) if known else F.lit(False)
    out = df.withColumns({f"rule_{r}": c for r, c in flags.items()})
    on = {r: F.col(f"rule_{r}") for r in flags}
    weight = {r: F.when(on[r], SEVERITY[s]).otherwise(0.0) for r, _, _, s in RULES}
    total = lambda rules: reduce(lambda a, b: a + b, [weight[r] for r in rules])
    count = lambda rules: reduce(lambda a, b: a + b, [on[r].cast("long") for r in rules])
    bonus = lambda rules: BONUS * F.greatest(count(rules) - 1, F.lit(0))
    climate, every = [r for r in flags if r != "feed_drop"], list(flags)
    return out.withColumns(
        {
            "management_score": weight["feed_drop"],
            "environment_score": total(climate) + bonus(climate),
            "rule_triggered_count": count(every),
            "rule_score": total(every) + bonus(every),
            "feed_env_score": weight["feed_drop"] + total(climate) + bonus(climate),
            "rule_reasons": F.array_join(F.array_compact(F.array(*[F.when(on[r], F.lit(r)) for r in every])), ","),
        }
    )


def temperature_policy(temperature: Column) -> Column:
    out = F.lit("normal")
    for name, limit in reversed(TEMPERATURES):
        out = F.when(temperature >= limit, name).otherwise(out)
    return F.when(temperature.isNull() | F.isnan(temperature), "not_available").otherwise(out)


def alert_level(df: DataFrame) -> DataFrame:
    """Rank and level from scores; what the precision policy does not confirm is only observed."""
    score, climate = F.coalesce("rule_score", F.lit(0.0)), F.coalesce("environment_score", F.lit(0.0))
    sure = F.coalesce("precision_alert", F.lit(True)) if "precision_alert" in df.columns else F.lit(True)
    level = F.when((score >= OBSERVE) & ~sure, "observe").when((score >= FOCUS) | (climate >= FOCUS), "cctv_focus").when(score >= CAUTION, "caution").when(score >= OBSERVE, "observe").otherwise("normal")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
    return df.withColumns({"policy_rank": rank, "policy_level": level, "temperature_policy": temperature_policy(F.col("temperature_max"))})


def level_summary(df: DataFrame, label: str) -> DataFrame:
    """Pen-days and label rate of every level, those without rows too."""
    spine = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LEVELS, 1)], "policy_rank long, policy_level string")
    counted = df.groupBy("policy_level").agg(F.count("*").alias("n"), F.count_if(label).alias("k"))
    # Four rows on the left.
    return spine.join(counted, "policy_level", "left").select("policy_rank", "policy_level", F.coalesce("n", F.lit(0)).alias("pen_days"), F.coalesce("k", F.lit(0)).alias("labelled"), F.try_divide(F.col("k"), F.col("n")).alias("label_rate"))


def precision_frame(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = KEYS, limit: float = OBSERVE) -> DataFrame:
    """Two scored configurations side by side: alerts, added alerts, reasons of the candidate."""
    left = baseline.select(*keys, (F.col("rule_score") >= limit).alias("baseline_alert"))
    right = candidate.select(*keys, (F.col("rule_score") >= limit).alias("candidate_alert"), F.col("rule_score").alias("candidate_score"), F.col("rule_reasons").alias("reasons"), "any_signs")
    joined = left.join(right, list(keys))
    count = F.size(F.filter(F.split("reasons", ","), lambda x: x != ""))
    return joined.withColumns({"added_alert": F.col("candidate_alert") & ~F.col("baseline_alert"), "reason_count": count.cast("long"), "is_jan_to_may": F.month("date").between(1, 5)})


def recent_context(df: DataFrame, keys: Sequence[str] = ("experiment", "pen_id"), days: int = 14) -> DataFrame:
    """recent_any: an earlier alert of the pen at most `days` before; recent_same_reason: one that shares a reason."""
    ordered = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("candidate_alert"), F.col("date")), True).over(ordered)
    near = lambda d: F.coalesce(F.datediff("date", d) <= days, F.lit(False))
    each = df.select(*keys, "date", "candidate_alert", F.explode(F.array_distinct(F.filter(F.split("reasons", ","), lambda x: x != ""))).alias("reason"))
    by_reason = Window.partitionBy(*keys, "reason").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    same = each.withColumn("_last", F.last(F.when(F.col("candidate_alert"), F.col("date")), True).over(by_reason)).groupBy(*keys, "date").agg(F.bool_or(near(F.col("_last"))).alias("_same"))
    return df.withColumn("recent_any", near(last)).join(same.hint("merge"), [*keys, "date"], "left").withColumn("recent_same_reason", F.coalesce("_same", F.lit(False))).drop("_same")


def policy_masks() -> dict[str, Column]:
    """Named alert policies over a precision frame with recent context."""
    base, added, score = F.col("baseline_alert"), F.col("added_alert"), F.col("candidate_score")
    several = F.col("reason_count") >= 2
    only = lambda x: F.col("reasons") == x
    triple, pair, nh3, co2 = only("co2_high,nh3_high,humidity_high"), only("nh3_high,humidity_high"), only("nh3_high"), only("co2_high")
    recent, same = F.col("recent_any"), F.col("recent_same_reason")
    return {
        "baseline_only": base,
        "recall_candidate_all": F.col("candidate_alert"),
        "added_score_0_6": base | (added & (score >= 0.6)),
        "added_env_cooccurrence": base | (added & several),
        "added_high_match_reasons": base | (added & (triple | nh3 | co2)),
        "added_nh3_or_triple_env": base | (added & (triple | pair | nh3)),
        "added_recent_any_14d": base | (added & recent),
        "added_recent_same_reason_14d": base | (added & same),
        "added_cooccurrence_or_recent_same_reason": base | (added & (several | same)),
    }


def policy_metrics(frame: DataFrame) -> DataFrame:
    """Counts and rates of every policy over all pen-days and over January to May: masks as long rows, one aggregation."""
    masks = F.array(*[F.struct(F.lit(n).alias("policy"), m.alias("on")) for n, m in policy_masks().items()])
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_jan_to_may"), "jan_may")))
    long = frame.withColumn("_m", F.explode(masks)).withColumn("scope", F.explode(scopes)).select("*", "_m.policy", "_m.on")
    truth, on, added = F.col("any_signs"), F.col("on"), F.col("added_alert")
    counted = long.groupBy("policy", "scope").agg(
        F.count("*").alias("n"), F.count_if(on).alias("n_alerts"), F.count_if(on & truth).alias("tp"), F.count_if(~on & truth).alias("fn"), F.count_if(on & ~truth).alias("fp"), F.count_if(~on & ~truth).alias("tn"),
        F.count_if(added & on).alias("added_kept"), F.count_if(added & ~on).alias("added_dropped"), F.count_if(added & on & truth).alias("_k"), F.count_if(added & ~on & truth).alias("_d"),
    )
    return with_rates(counted).withColumns({"added_kept_match_rate": F.try_divide(F.col("_k"), F.col("added_kept")), "added_dropped_match_rate": F.try_divide(F.col("_d"), F.col("added_dropped"))}).drop("_k", "_d")


def with_rates(df: DataFrame) -> DataFrame:
    """sensitivity, specificity, precision and f1 of tp, fn, fp, tn; null where undefined."""
    sensitivity, precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    f1 = F.when((sensitivity > 0) & (precision > 0), 2 * sensitivity * precision / (sensitivity + precision))
    return df.withColumns({"sensitivity": sensitivity, "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), "precision": precision, "f1": f1})


def recommended_policy(metrics: DataFrame) -> DataFrame:
    """The policy that loses no sensitivity against the baseline and has the best F1, else the baseline."""
    full = metrics.where("scope = 'all'")
    base = full.where("policy = 'baseline_only'").select(F.col("sensitivity").alias("_s"), F.col("precision").alias("_p"), F.col("n_alerts").alias("_n"))
    # One row of the baseline.
    joined = full.join(F.broadcast(base))
    fit = (~F.col("policy").isin("baseline_only", "recall_candidate_all")) & (F.col("sensitivity") >= F.col("_s"))
    ranked = joined.where(fit | (F.col("policy") == "baseline_only"))
    return ranked.orderBy(fit.desc(), F.desc("f1"), (F.col("precision") - F.col("_p")).desc(), (F.col("sensitivity") - F.col("_s")).desc(), F.col("n_alerts") - F.col("_n"), "policy").limit(1).drop("_s", "_p", "_n")


def added_reasons(frame: DataFrame) -> DataFrame:
    counted = frame.where("added_alert").groupBy("reasons").agg(F.count("*").alias("added_alerts"), F.count_if("any_signs").alias("matched"), F.count_if("recent_any").alias("recent_any"), F.count_if("recent_same_reason").alias("recent_same_reason"))
    return counted.withColumns({"match_rate": F.col("matched") / F.col("added_alerts"), "recent_same_reason_rate": F.col("recent_same_reason") / F.col("added_alerts")})


def as_alerts(policy: DataFrame) -> DataFrame:
    """Alerting pen-days in the schema of alert tracks; a day ends one second before the next."""
    named = lambda rules, category: F.when(F.arrays_overlap(F.split("rule_reasons", ","), F.array(*[F.lit(r) for r in rules])), category)
    rows = policy.where("policy_level <> 'normal'")
    tiers = F.when(F.col("policy_level") == "cctv_focus", "high").when(F.col("policy_level") == "caution", "medium").otherwise("normal")
    start = F.col("date").cast("timestamp_ntz")
    return rows.select(
        F.lit("pen_day").alias("track"), F.col("experiment").cast("string").alias("source_dataset"), F.concat_ws(":", F.lit("pen"), F.col("experiment").cast("string"), "pen_id").alias("chamber_id"),
        start.alias("start_datetime"), (start + F.expr("INTERVAL '86399' SECOND")).alias("end_datetime"), F.col("rule_score").alias("track_score"), "management_score", "environment_score",
        F.concat_ws(",", named(["feed_drop"], "management"), named(["co2_high", "nh3_high", "barn_temp_high", "humidity_high"], "environment")).alias("alert_category"),
        tiers.alias("tier"), F.concat_ws(": ", "policy_level", "rule_reasons").alias("reason"), "temperature_policy",
    )


def hourly_worst(hours: DataFrame, value: str, keys: Sequence[str] = ("experiment", "pen_id")) -> DataFrame:
    """Smallest hourly z-score of each day, from a frame with <value>_zscore_3d."""
    return hours.groupBy(*keys, F.col("datetime").cast("date").alias("date")).agg(F.min(f"{value}_zscore_3d").alias(f"{value}_min_zscore_3d"))
