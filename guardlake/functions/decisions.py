"""Decision and severity orders. Three precedence orders exist and differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highest first.
RESULT_ORDER = ("block", "deny", "ask", "warn", "context", "info", "allow")
SESSION_ORDER = ("block", "deny", "ask", "allow")
ENGINE_RANK = {"deny": 4, "block": 4, "ask": 3, "allow": 2}
SEVERITY_RANK = {"LOW": 10, "MEDIUM": 20, "HIGH": 30, "CRITICAL": 40}
ENFORCEMENT, ADVISORY = ("deny", "block"), ("ask", "warn", "context", "info")


def ranked(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def severity_rank(severity: Column, unknown: str = "MEDIUM") -> Column:
    """The CLI takes an unknown severity as MEDIUM, the dashboard as LOW."""
    return ranked(F.upper(severity), SEVERITY_RANK, SEVERITY_RANK[unknown])


def result_rank(decision: Column) -> Column:
    """7 for block down to 1 for allow, 0 for none."""
    return ranked(decision, {d: len(RESULT_ORDER) - i for i, d in enumerate(RESULT_ORDER)}, 0)


def first_of(present: Column, order: tuple[str, ...], empty: str = "allow") -> Column:
    """The first decision of ``order`` in an array, else ``empty``."""
    out = F.lit(empty)
    for d in reversed(order):
        out = F.when(F.array_contains(present, d), d).otherwise(out)
    return out


def engine_decision(findings: Column) -> Column:
    """Of structs (decision, severity), in order: the decision of the highest engine rank, ties by severity, then the first."""
    indexed = F.transform(findings, lambda x, i: F.struct(
        ranked(x["decision"], ENGINE_RANK, 0).alias("a"), severity_rank(x["severity"]).alias("b"), (-i).alias("c"), x["decision"].alias("d")))
    return F.array_max(indexed)["d"]


def is_in(decision: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(decision.isin(*names), F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
