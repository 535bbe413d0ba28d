"""Classification ladders: ordered (test value, result) pairs, first hit wins.

The pairs below are fixed values; the three builders turn any such list into one CASE expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substring of the rule name -> label, in order of precedence.
ALERT_TYPE = [("SMALL_THEN_LARGE", "FRAUD_TRANSACTION"), ("INSIDER_EXFIL", "INSIDER_THREAT")]
SEVERITY = [("INSIDER_EXFIL", "CRITICAL"), ("SMALL_THEN_LARGE", "HIGH")]
ALERT_CATEGORY = [("FRAUD", "Financial Fraud"), ("INSIDER", "Insider Threat")]

# Severity -> text or number.
BUSINESS_IMPACT = [
    ("CRITICAL", "High - Immediate Response Required"),
    ("HIGH", "Medium - Investigation Needed"),
]
SEVERITY_SCORE = [("CRITICAL", 10), ("HIGH", 7), ("MEDIUM", 4)]
SEVERITY_WEIGHT = [("CRITICAL", 3), ("HIGH", 2), ("MEDIUM", 1)]

# Lower bound (exclusive) -> label, highest first.
PATTERN_INTENSITY = [(10, "HIGH_SPIKE"), (5, "MODERATE_SPIKE")]
THREAT_TREND = [(2.0, "🔴 HIGH RISK"), (1.0, "🟡 MEDIUM RISK")]

# Fixed values: (lower bound of alerts, severities it applies to or None for any, label).
THREAT_LEVEL = [
    (10, ("CRITICAL",), "SEVERE"),
    (5, ("HIGH", "CRITICAL"), "HIGH"),
    (2, None, "MODERATE"),
]


def _ladder(rungs: Sequence[tuple[Column, object]], default: object) -> Column:
    """``CASE WHEN … END`` over (condition, result); a NULL condition falls through."""
    result = F.lit(default)
    for condition, value in reversed(rungs):
        result = F.when(condition, F.lit(value)).otherwise(result)
    return result


def by_substring(text: Column, pairs: Sequence[tuple[str, object]], default: object) -> Column:
    return _ladder([(text.contains(part), value) for part, value in pairs], default)


def by_value(column: Column, pairs: Sequence[tuple[object, object]], default: object) -> Column:
    return _ladder([(column == key, value) for key, value in pairs], default)


def above(column: Column, pairs: Sequence[tuple[float, object]], default: object) -> Column:
    return _ladder([(column > bound, value) for bound, value in pairs], default)


def threat_level(alerts: Column, severity: Column, levels=THREAT_LEVEL) -> Column:
    rungs = []
    for bound, severities, label in levels:
        hit = alerts > bound
        rungs.append((hit if severities is None else hit & severity.isin(*severities), label))
    return _ladder(rungs, "LOW")
