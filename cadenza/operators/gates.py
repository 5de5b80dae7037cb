"""Promotion gates over metric history, and corpus licence policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(metrics: DataFrame) -> DataFrame:
    """(label, dataset, metric, value): the newest value of each metric."""
    return metrics.groupBy("label", "dataset", "metric").agg(F.max_by("value", "created").alias("value"))


def latest_shared(metrics: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """The newest dataset that both labels were measured on: (dataset, created); empty if there is none."""
    by = metrics.filter(F.col("label").isin(candidate, baseline)).groupBy("dataset").agg(
        F.countDistinct("label").alias("labels"), F.max("created").alias("created")
    )
    return by.filter("labels = 2").agg(F.max_by("dataset", "created").alias("dataset"), F.max("created").alias("created")).filter("dataset is not null")


def lift(least: float):
    """Relative gain of at least so much; over a zero baseline any positive value is enough."""

    def gate(new: Column, old: Column) -> Column:
        return F.when(old == 0, new > 0).otherwise((new - old) / old >= least)

    return gate


def regression(most: float):
    """A relative loss of at most so much."""

    def gate(new: Column, old: Column) -> Column:
        return F.when(old == 0, new >= 0).otherwise((old - new) / old <= most)

    return gate


def floor(least: float):
    def gate(new: Column, old: Column) -> Column:
        return new >= least

    return gate


#: Name, metric and rule of each gate.
GATES = [
    ("ndcg_lift", "ndcg", lift(0.05)),
    ("recall_lift", "recall", lift(0.03)),
    ("cold_regression", "cold", regression(0.02)),
    ("coverage_floor", "coverage", floor(0.30)),
]


def judge(metrics: DataFrame, baseline: str, gates=GATES) -> DataFrame:
    """(label, dataset, gate, passed, promoted) of all other labels against a baseline; a missing metric fails."""
    values = latest(metrics)
    new = values.filter(F.col("label") != baseline).groupBy("label", "dataset").pivot("metric", [m for _, m, _ in gates]).agg(F.first("value"))
    old = values.filter(F.col("label") == baseline).groupBy("dataset").pivot("metric", [m for _, m, _ in gates]).agg(F.first("value"))
    old = old.select("dataset", *[F.col(m).alias(f"old_{m}") for _, m, _ in gates])
    both = new.join(old, "dataset", "left")
    checks = [F.struct(F.lit(n).alias("gate"), F.coalesce(g(F.col(m), F.col(f"old_{m}")), F.lit(False)).alias("passed")) for n, m, g in gates]
    both = both.withColumn("checks", F.array(*checks))
    both = both.withColumn("promoted", F.forall("checks", lambda c: c["passed"]))
    return both.select("label", "dataset", F.inline("checks"), "promoted")


def transition(state: Column, all_passed: Column, action: Column) -> Column:
    """The next state of a promotion: checks move pending and blocked ones, approval needs passed checks again."""
    open_ = state.isin("pending", "blocked")
    return (
        F.when(open_ & (action == "check"), F.when(all_passed, "pending").otherwise("blocked"))
        .when(open_ & (action == "approve"), F.when(all_passed, "approved").otherwise("blocked"))
        .when(open_ & (action == "reject"), "rejected")
        .otherwise(state)
    )


# Licence classes.
CLASSES = {"production": ("cc0", "cc-by", "public-domain"), "research": ("cc-by-nc", "cc-by-nc-sa")}


def decision(license_: Column, envs: Column, mode: str) -> Column:
    """Struct (allowed, reason, class) of a row: anything missing or unknown is refused."""
    kind = F.when(F.lower(license_).isin(*CLASSES["production"]), "production").when(F.lower(license_).isin(*CLASSES["research"]), "research")
    wanted = ["production", "research"] if mode == "both" else [mode]
    listed = F.lit(True)
    for m in wanted:
        listed = listed & F.array_contains(F.split(envs, ","), m)
    fits = (kind == "production") if mode in ("production", "both") else F.lit(True)
    reason = (
        F.when(license_.isNull() | (F.trim(license_) == ""), "missing_license")
        .when(envs.isNull() | (F.trim(envs) == ""), "missing_environment")
        .when(kind.isNull(), "unknown_license")
        .when(~fits, "license_class")
        .when(~listed, "environment")
        .otherwise("allowed")
    )
    return F.struct((reason == "allowed").alias("allowed"), reason.alias("reason"), F.coalesce(kind, F.lit("unknown")).alias("license_class"))


def decide(manifest: DataFrame, mode: str) -> DataFrame:
    return manifest.select("doc_id", F.lit(mode).alias("mode"), decision(F.col("license"), F.col("envs"), mode).alias("verdict")).select("doc_id", "mode", "verdict.*")


def eligible(manifest: DataFrame, mode: str) -> DataFrame:
    """The rows a mode may use, as a filter."""
    classes = CLASSES["production"] if mode in ("production", "both") else CLASSES["production"] + CLASSES["research"]
    modes = ["production", "research"] if mode == "both" else [mode]
    out = manifest.filter(F.lower("license").isin(*classes))
    for m in modes:
        out = out.filter(F.array_contains(F.split("envs", ","), m))
    return out


# Classes of sources.
SOURCES = {"musicbrainz": "production_approved", "listenbrainz": "production_approved"}


def _classified(source: Column, sources: dict[str, str], fail_closed: bool) -> Column:
    out = F.lit("blocked" if fail_closed else "research_only")
    for name, kind in sources.items():
        out = F.when(source == name, kind).otherwise(out)
    return out


def decide_by_source(manifest: DataFrame, mode: str, fail_closed: bool = True, sources: dict[str, str] = SOURCES) -> DataFrame:
    """manifest (source, license, allowed_envs, …) with allowed, reason and classification by the class of the source.

    mode is production, research or both; allowed_envs names one environment, or both. A missing licence or environment
    (null or empty) is refused, as is an unknown source where fail_closed; mode both asks for no environment.
    """
    source, envs = F.coalesce("source", F.lit("")), F.col("allowed_envs")
    kind = _classified(source, sources, fail_closed)
    named = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    # The reasons.
    reason = (
        F.when(F.coalesce("license", F.lit("")) == "", "missing license metadata")
        .when(F.coalesce(envs, F.lit("")) == "", "missing allowed_envs")
        .when(kind == "blocked", named("source '", source, "' not approved"))
    )
    if mode == "production":
        reason = reason.when(kind != "production_approved", named("source '", source, "' not production_approved"))
    if mode in ("production", "research"):
        reason = reason.when(~envs.isin(mode, "both"), named("row env '", envs, f"' excludes {mode}"))
    reason = reason.otherwise("compliant")
    missing = reason.isin("missing license metadata", "missing allowed_envs")
    return manifest.withColumns(
        {"allowed": reason == "compliant", "reason": reason, "classification": F.when(missing, "blocked").otherwise(kind)}
    )


def eligible_by_source(manifest: DataFrame, mode: str, fail_closed: bool = True, sources: dict[str, str] = SOURCES) -> DataFrame:
    """The rows a mode may use, as filters that reach the scan; mode both takes every row with a licence."""
    out = manifest.filter(F.coalesce("license", F.lit("")) != "")
    if mode == "production":
        out = out.filter(F.col("source").isin([s for s, c in sources.items() if c == "production_approved"]))
    elif mode == "research" and fail_closed:
        out = out.filter(F.col("source").isin(list(sources)))
    return out if mode == "both" else out.filter(F.col("allowed_envs").isin(mode, "both"))


def promotable(manifest: DataFrame) -> DataFrame:
    """One row: rows, those not approved for production, research-only ones, and whether none stands in the way."""
    d = decision(F.col("license"), F.col("envs"), "production")
    only = F.col("envs") == "research"
    out = manifest.agg(F.count("*").alias("rows"), F.count_if(~d["allowed"]).alias("not_approved"), F.count_if(only).alias("research_only"))
    return out.withColumn("promotable", (F.col("not_approved") == 0) & (F.col("research_only") == 0))
