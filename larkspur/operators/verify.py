"""Verification maths: conformal thresholds, behaviour clusters, oscillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import invocation_hash
from larkspur.operators.order import nth_smallest


def conformal_threshold(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row (n, rank, quantile, valid): the ceil((n + 1) * (1 - alpha))-th smallest score, null if there are too few."""
    n = scores.agg(F.count("score").alias("n")).withColumn("rank", F.ceil((F.col("n") + 1) * (1.0 - alpha)))
    at = nth_smallest(scores, "score", n.select(F.col("rank").alias("n"))).select(F.col("value").alias("quantile"))
    return n.join(at, how="left").select("n", "rank", "quantile", (F.col("quantile").isNotNull()).alias("valid"))  # one row each


def decide(score: Column, quantile: Column) -> Column:
    """Whether a score passes: uncalibrated without a quantile, else within bound or exceeding."""
    return F.when(quantile.isNull(), "uncalibrated").when(score <= quantile, "within bound").otherwise("exceeds")


def clusters(rows: DataFrame) -> DataFrame:
    """(profile, members, mass, dominant, unanimous) of (id, behaviour): equal behaviour is one cluster."""
    groups = rows.groupBy(F.sha2(F.col("behaviour"), 256).alias("profile")).agg(F.count("*").alias("members"), F.min("id").alias("first"))
    total = groups.agg(F.sum("members").alias("all"), F.max_by("profile", F.struct(F.col("members"), -F.col("first"))).alias("top"), F.count("*").alias("kinds"))
    return groups.join(F.broadcast(total)).select("profile", "members", F.round(F.col("members") / F.col("all"), 4).alias("mass"), (F.col("profile") == F.col("top")).alias("dominant"), (F.col("kinds") == 1).alias("unanimous"))  # one row


def oscillation(history: DataFrame, epsilon: int = 5) -> DataFrame:
    """Per (run, step, text): distance to the step before, whether that stalls, whether the text is that of two before, and the reason to halt."""
    w = Window.partitionBy("run").orderBy("step")
    before, two = F.lag("text", 1).over(w), F.trim(F.lag("text", 2).over(w))
    out = history.withColumn("distance", F.levenshtein("text", before).cast("long"))
    out = out.withColumn("stalled", F.coalesce(F.col("distance") < epsilon, F.lit(False))).withColumn("repeats", F.coalesce(F.trim("text") == two, F.lit(False)))
    reason = F.when(F.col("distance").isNull(), "insufficient history").when(F.col("stalled"), "near-identical resubmission").when(F.col("repeats"), "A-B-A alternation").otherwise("progressing")
    return out.withColumn("reason", reason).withColumn("halt", F.col("stalled") | F.col("repeats"))


def receipt(tool: Column, payload: Column, exit_code: Column, excerpt: Column) -> Column:
    """What proves a tool's run: bound to its exact input by a hash."""
    return F.struct(tool.alias("tool"), invocation_hash(payload).alias("invocation_hash"), exit_code.alias("exit_code"), F.left(excerpt, F.lit(2000)).alias("stdout_excerpt"))


# Methods of verification by how well they ground a claim.
TIERS = {"code_execution": 1, "functional_clustering": 1, "symbolic_prover": 1, "static_parse": 2, "schema_validation": 2, "internal_doc_grounding": 3, "web_grounding": 3, "self_consistency": 4, "heuristic": 4, "blocked_by_premise": 5}
REPORT_VERDICTS = ["PASSED", "FAILED", "NEEDS_REPAIR", "ESCALATED"]
CLAIM_STATUS = ["VERIFIED", "REFUTED", "UNVERIFIABLE"]
CRITICALITY = ["blocking", "major", "minor", "informational"]


def report_violations(reports: DataFrame) -> DataFrame:
    """(report_id, violations, forced_verdict) of reports (report_id, verdict, confidence_score, passed_check, claims_without_receipt, claims).

    A claim has claim_id, status, criticality, method, tier and receipt (null if none).
    Values outside their lists are schema violations; no claim is verified without a
    receipt, no blocking one by a method of tier 4 or more, a tier is its method's, and a
    report passes only with verified claims, receipts and a passed check.
    """
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    which = lambda keep: F.array_join(F.transform(F.filter("claims", keep), lambda c: c["claim_id"]), ", ")
    none, passed = F.col("claims_without_receipt") > 0, F.col("verdict") == "PASSED"
    verified = lambda c: c["status"] == "VERIFIED"
    rules = [
        ("verdict is none", F.when(~F.coalesce(F.col("verdict").isin(*REPORT_VERDICTS), F.lit(False)), F.col("report_id").cast("string"))),
        ("confidence is not 0 to 1", F.when(~F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False)), F.col("report_id").cast("string"))),
        ("status, criticality or method is none", which(lambda c: ~F.coalesce(c["status"].isin(*CLAIM_STATUS) & c["criticality"].isin(*CRITICALITY) & c["method"].isin(*TIERS), F.lit(False)))),
        ("verified without receipt", which(lambda c: verified(c) & c["receipt"].isNull())),
        ("blocking claim verified on tier 4 or more", which(lambda c: verified(c) & (c["criticality"] == "blocking") & (F.coalesce(F.try_element_at(tier, c["method"]), F.lit(4)) >= 4))),
        ("tier does not match method", which(lambda c: ~c["tier"].eqNullSafe(F.try_element_at(tier, c["method"])))),
        ("passed with claims not verified", F.when(passed, which(lambda c: (c["criticality"] != "informational") & ~verified(c)))),
        ("passed without a passed check", F.when(passed & ~F.coalesce("passed_check", F.lit(False)), F.col("report_id").cast("string"))),
        ("passed with missing receipts", F.when(passed & none, F.col("report_id").cast("string"))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(who, F.lit("")) != "", F.concat(F.lit(f"{rule}: "), who)) for rule, who in rules]), lambda v: v.isNotNull())
    return reports.select("report_id", found.alias("violations")).withColumn("forced_verdict", F.when(F.size("violations") > 0, "ESCALATED"))
