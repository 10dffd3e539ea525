"""Number formats and message texts. Templates are fixed values of the product."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Message templates.
HEALTHY = "✅ Healthy"
ISSUES = "🚨 %d Issues"
UP, DOWN = "📈", "📉"
PROJECTION = (
    "**%s Projection:** The %s stochastic model predicts a **%.1f%% %s**."
)
ACTION_REQUIRED = "\n\n **Action Required:** Significant volume shift detected."
STABLE_STATUS = "\n\n **Status:** Operations expected to remain stable."
NO_INSIGHT = "Insufficient data for insight."
HIGH_LOAD = (
    "⚠️ **High Load Alert:** Peak volume (%d) requires significant staffing"
    " (%d operators)."
)
STABLE_LOAD = "✅ **Stable Load:** Projected peak of %d/day is within current capacity."
RATIO = "ℹ️ **Insight:** Ratio: %.1f biometric updates per enrolment."
HIGHEST_RISK = "Flagged **%s** as highest risk due to statistical variance."


def thousands(col: Column) -> Column:
    """``1,234,567`` without decimals."""
    return F.format_number(col, 0)


def percent(col: Column) -> Column:
    """``1.2%``."""
    return F.format_string("%.1f%%", col)


def risk_status(issues: Column) -> Column:
    return F.when(issues == 0, F.lit(HEALTHY)).otherwise(F.format_string(ISSUES, issues))


def growth_percent(start: Column, end: Column) -> Column:
    """Percent change, 0 unless the start is positive."""
    return F.when(start > 0, (end - start) / F.when(start > 0, start) * 100.0).otherwise(F.lit(0.0))


def projection_insight(change: Column, model: Column) -> Column:
    """Text for a percent change; NULL change means there is nothing to say."""
    up = change > 0
    text = F.concat(
        F.format_string(
            PROJECTION,
            F.when(up, UP).otherwise(DOWN),
            model,
            F.abs(change),
            F.when(up, "Growth").otherwise("Decline"),
        ),
        F.when(F.abs(change) > 10, ACTION_REQUIRED).otherwise(STABLE_STATUS),
    )
    return F.when(change.isNull(), NO_INSIGHT).otherwise(text)
