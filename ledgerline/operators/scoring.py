"""Scores, grades and gates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fact_score(verified: Column, agreement: Column, witness: Column, identity: Column, evidenced: Column, count: Column, ratio: Column) -> Column:
    """0 to 100: the first rule that holds, cut by the share of grounded fields, half to even."""
    base = (
        F.when(~verified, 25).when(agreement == "disagree", 50).when(witness, F.when(identity, 95).otherwise(90)).when(agreement == "agree", F.when(identity, 95).otherwise(90)).when(~evidenced, 50).when(identity, 90).when(count >= 2, 75).otherwise(50)
    )
    return F.when(ratio < 1, F.bround(base * (0.5 + 0.5 * ratio))).otherwise(base).cast("int")


def gate_score(existence: Column, path: Column) -> Column:
    return F.least(F.coalesce(existence, F.lit(0)), F.coalesce(path, F.lit(0)))


def gate_action(score: Column, auto: int = 90, flag: int = 75, approval: int = 50, allow_below: bool = False) -> Column:
    return F.when(score >= auto, "auto").when(score >= flag, "flag").when(score >= approval, "needs_approval").otherwise("needs_approval" if allow_below else "blocked")


def grade(evidenced: Column, verified: Column, agrees: Column, corroborated: Column, grounded: Column, fields_grounded: Column) -> Column:
    """E2 to E4; fields_grounded may be null: unknown."""
    return F.when(~evidenced | ~verified, "E4").when(agrees | corroborated, "E2").when(grounded & F.coalesce(fields_grounded, F.lit(True)), "E3").otherwise("E4")


def selected(action: Column, approved: Column, approve_all: bool = False) -> Column:
    """Whether an entry is applied: all but blocked ones that need no approval or have it; with approve_all only approved ones."""
    return (action != "blocked") & (approved if approve_all else action.isin("auto", "flag") | approved)
