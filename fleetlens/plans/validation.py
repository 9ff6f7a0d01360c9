"""Profile validation as one plan: resolve -> audit -> status and routed issues."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.profiles import audit_profiles, audit_status, resolve_profiles, route_issues


def validate(deploy: DataFrame, profiles: DataFrame, aliases: DataFrame, minimums: DataFrame) -> dict[str, DataFrame]:
    """Frames: ``resolved``, ``rejects``, ``issues``, ``errors``, ``warnings`` and ``status``
    (per deployment: error and warning counts, failed when any error)."""
    resolved, rejects = resolve_profiles(profiles, deploy, aliases)
    issues = audit_profiles(profiles, deploy, aliases, minimums)
    errors, warnings = route_issues(issues)
    return {
        "resolved": resolved,
        "rejects": rejects,
        "issues": issues,
        "errors": errors,
        "warnings": warnings,
        "status": audit_status(issues, deploy),
    }
