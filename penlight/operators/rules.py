"""Declarative rules: a rule table compiled to column expressions, scores, combination with a model.

A rule is a mapping with id, severity, category and either feature, agg, op, threshold or
all_of (a list of such conditions).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, bonus, caps and thresholds of scores.
SEVERITY = {"high": 1.0, "medium": 0.6, "low": 0.3}
BONUS = 0.3
MODEL_WEIGHT, MODEL_CAP = 0.5, 2.0
TIERS = (("high", 1.5), ("medium", 0.8))
CATEGORY_LIMITS = {"disease": 0.8, "management": 0.6, "environment": 0.8}
REFERENCE_BARN = 26.0
LEAST_PAIRS = 10

RULES_SCHEMA = (
    "combine string, rules array<struct<id:string,feature:string,agg:string,op:string,threshold:double,severity:string,category:string,note:string,"
    "all_of:array<struct<feature:string,agg:string,op:string,threshold:double>>>>"
)


def condition(rule: Mapping, columns: Sequence[str]) -> Column:
    """One comparison; null and NaN never hit. Unknown aggregations, operators and features are errors before anything runs."""
    if rule.get("agg", "mean") not in ("mean", "max", "min"):
        raise ValueError(f"rule {rule['id']}: unknown aggregation {rule['agg']}")
    name = f"{rule['feature']}__w{rule.get('agg', 'mean')}"
    if name not in columns:
        raise KeyError(f"rule {rule['id']}: unknown feature {rule['feature']} (no column {name})")
    value, limit = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(float(rule["threshold"]))
    if rule["op"] not in (">=", "<="):
        raise ValueError(f"rule {rule['id']}: unknown operator {rule['op']}")
    return F.coalesce(value >= limit if rule["op"] == ">=" else value <= limit, F.lit(False))


def hit(rule: Mapping, columns: Sequence[str]) -> Column:
    if rule.get("all_of"):
        return reduce(lambda a, b: a & b, [condition({**c, "id": rule["id"]}, columns) for c in rule["all_of"]])
    return condition(rule, columns)


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values, F.lit(0.0))


def scores(hits: Mapping[str, Column], rules: Sequence[Mapping]) -> dict[str, Column]:
    """Columns of score, count and reasons over hit columns by rule id."""
    weight = lambda r: F.when(hits[r["id"]], SEVERITY.get(r.get("severity", "medium"), SEVERITY["medium"])).otherwise(0.0)
    kind = lambda r: r.get("category", "disease") if r.get("category", "disease") in CATEGORY_LIMITS else "disease"
    bonus = lambda n: BONUS * F.greatest(n - 1, F.lit(0))
    count = lambda some: reduce(lambda a, b: a + b, [hits[r["id"]].cast("int") for r in some], F.lit(0))
    listed = lambda some: F.array_join(F.array_compact(F.array(*[F.when(hits[r["id"]], F.lit(r["id"])) for r in some])), ",") if some else F.lit("")
    out = {"rule_reasons": listed(rules), "rule_triggered_count": count(rules).cast("long"), "rule_severity_sum": total([weight(r) for r in rules]), "rule_co_occurrence_bonus": bonus(count(rules))}
    out["rule_score"] = total([weight(r) for r in rules]) + bonus(count(rules))
    for category, limit in CATEGORY_LIMITS.items():
        some = [r for r in rules if kind(r) == category]
        score = total([weight(r) for r in some]) + bonus(count(some))
        out |= {f"{category}_rule_score": score, f"{category}_rule_reasons": listed(some), f"{category}_rule_anomaly": score >= limit}
    out["rule_observation"] = count(rules) > 0
    out["rule_anomaly"] = reduce(lambda a, b: a | b, [out[f"{c}_rule_anomaly"] for c in CATEGORY_LIMITS])
    return out


def evaluate(windows: DataFrame, rules: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """Keys, a hit flag for each rule, and the scores: one projection for hits and one for scores."""
    flags = windows.select(*keys, *[hit(r, windows.columns).alias(f"rule_{r['id']}") for r in rules])
    found = scores({r["id"]: F.col(f"rule_{r['id']}") for r in rules}, rules)
    return flags.select("*", *[c.alias(n) for n, c in found.items()])


def tier(score: Column) -> Column:
    return F.when(score >= TIERS[0][1], TIERS[0][0]).when(score >= TIERS[1][1], TIERS[1][0]).otherwise("normal")


def combine(rules: DataFrame, detection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule scores with a model's windows: capped model share, disease score and tier, alerts and reasons."""
    joined = rules.join(detection.select(*keys, "reconstruction_error", "threshold", "confirmed_anomaly"), list(keys), "left")
    ratio = F.try_divide(F.col("reconstruction_error"), F.col("threshold"))
    ratio = F.when(ratio > MODEL_CAP, MODEL_CAP).otherwise(ratio)  # null stays null, unlike with least()
    part = joined.withColumns({"model_anomaly": F.coalesce("confirmed_anomaly", F.lit(False)), "model_component": F.coalesce(MODEL_WEIGHT * ratio, F.lit(0.0))})
    disease = part["model_anomaly"] | F.col("disease_rule_anomaly")
    alerts = {"disease": disease, "management": F.col("management_rule_anomaly"), "environment": F.col("environment_rule_anomaly")}
    said = F.concat_ws(" | ", *[F.when(F.col(f"{c}_rule_reasons") != "", F.concat(F.lit(f"{c}: "), F.col(f"{c}_rule_reasons"))) for c in CATEGORY_LIMITS])
    return part.withColumns(
        {
            "final_alert": F.col("model_anomaly") | F.col("rule_anomaly"),
            "rule_component": F.col("disease_rule_score"),
            "disease_score": F.col("model_component") + F.col("disease_rule_score"),
            "disease_tier": tier(F.col("model_component") + F.col("disease_rule_score")),
            "management_score": F.col("management_rule_score"),
            "environment_score": F.col("environment_rule_score"),
            **{f"{c}_alert": a for c, a in alerts.items()},
            "alert_category": F.concat_ws(",", *[F.when(a, c) for c, a in alerts.items()]),
            "primary_reason": F.concat_ws(" + ", F.when(F.col("model_anomaly"), "model reconstruction error above threshold"), F.when(F.col("rule_anomaly"), F.concat(F.lit("rule: "), said))),
        }
    )


def barn_correction(df: DataFrame, body: str, barn: str, reference: float = REFERENCE_BARN) -> DataFrame:
    """One row: slope, intercept, pearson_corr and n_rows of body on barn temperature; slope 0 for fewer than ten pairs."""
    pairs = df.where(F.col(body).isNotNull() & F.col(barn).isNotNull())
    few = F.count("*") < LEAST_PAIRS
    return pairs.agg(
        F.when(few, 0.0).otherwise(F.coalesce(F.regr_slope(body, barn), F.lit(0.0))).alias("slope"),
        F.coalesce(F.when(few, F.avg(body)).otherwise(F.regr_intercept(body, barn)), F.lit(0.0)).alias("intercept"),
        F.when(few, 0.0).otherwise(F.coalesce(F.corr(body, barn), F.lit(0.0))).alias("pearson_corr"),
        F.count("*").alias("n_rows"),
        F.lit(reference).alias("reference_barn_temp"),
    )


def corrected(df: DataFrame, fit: DataFrame, body: str, barn: str) -> DataFrame:
    """Adds <body>_corrected: what is left of body temperature without the barn's part."""
    # One row of coefficients.
    value = F.col(body) - F.col("slope") * (F.col(barn) - F.col("reference_barn_temp"))
    return df.join(F.broadcast(fit)).withColumn(f"{body}_corrected", value).select(*df.columns, f"{body}_corrected")


def rule_rows(config: DataFrame) -> DataFrame:
    """One row for each rule of configuration documents."""
    rule = config.select(F.explode("rules").alias("r")).select("r.*")
    return rule.select(F.col("id").alias("rule_id"), "category", "severity", "feature", "agg", "op", "threshold", "all_of", F.coalesce(F.size("all_of") > 0, F.lit(False)).alias("is_composite"), "note")


def override(rules: Sequence[Mapping], overrides: Mapping[str, float]) -> list[dict]:
    """Rules with other thresholds; an id that no rule has is an error."""
    unknown = set(overrides) - {r["id"] for r in rules}
    if unknown:
        raise KeyError(f"unknown rule ids: {', '.join(sorted(unknown))}")
    return [{**r, "threshold": overrides[r["id"]]} if r["id"] in overrides else dict(r) for r in rules]


def parsed_overrides(text: str) -> dict[str, float]:
    """co2_high=1100,nh3_high=12 as a mapping."""
    return {k.strip(): float(v) for k, v in (part.split("=", 1) for part in text.split(",") if part.strip())}


def experiments(windows: DataFrame, rules: Sequence[Mapping], variants: Mapping[str, Mapping[str, float]], keys: Sequence[str]) -> DataFrame:
    """A row for each variant: windows and alerts by category, and their change against the variant `baseline`.

    All variants are expressions over one pass of the windows.
    """
    def measures(name: str, overrides: Mapping[str, float]) -> list[Column]:
        some = override(rules, overrides)
        found = scores({r["id"]: hit(r, windows.columns) for r in some}, some)
        counted = {"rule_observation": found["rule_observation"], "rule_anomaly": found["rule_anomaly"]} | {f"{c}_alert": found[f"{c}_rule_anomaly"] for c in CATEGORY_LIMITS}
        return [F.struct(F.count("*").alias("windows"), *[F.count_if(c).alias(n) for n, c in counted.items()], F.avg(found["disease_rule_score"]).alias("mean_disease_score"), F.max(found["disease_rule_score"]).alias("max_disease_score")).alias(name)]

    one = windows.agg(*[m for name, o in variants.items() for m in measures(name, o)])
    long = one.unpivot([], list(variants), "experiment", "m").select("experiment", "m.*")
    base = long.where("experiment = 'baseline'")
    counts = ["rule_observation", "rule_anomaly", "disease_alert", "management_alert", "environment_alert"]
    # One row of the baseline.
    joined = long.join(F.broadcast(base.select(*[F.col(c).alias(f"_{c}") for c in counts])))
    delta = joined.withColumns({f"{c}_delta": F.col(c) - F.col(f"_{c}") for c in counts}).drop(*[f"_{c}" for c in counts])
    advice = (
        F.when(F.col("experiment") == "baseline", "baseline")
        .when(F.col("disease_alert_delta") < 0, "reject_disease_loss")
        .when((F.col("environment_alert_delta") < 0) & (F.col("disease_alert_delta") == 0), "candidate_environment_tightening")
        .when(F.col("rule_anomaly_delta") == 0, "no_alert_change")
        .otherwise("review_manually")
    )
    return delta.withColumn("experiment_recommendation", advice)
