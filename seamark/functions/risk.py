"""Weighted indicators of vessels and companies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the vessel score; the last two of a pair are the most that a count is taken for.
VESSEL_WEIGHTS = {
    "sanctioned": 4.0,
    "owner_sanctioned": 3.0,
    "gap_last_day": 2.0,
    "gaps_last_month": (0.2, 5),
    "transfer": 2.5,
    "dark_transfer": 3.0,
    "risky_port": 1.5,
    "risky_flag": 1.0,
    "flag_changes": (0.5, 3),
    "owner_unknown": 1.0,
    "cartel_route": 2.5,
    "near_sanctioned": 1.5,
}
MOST_RISK = 10.0
# The weights of the indicators of a shell company; an unknown headcount counts half.
SHELL_WEIGHTS = {
    "opaque_jurisdiction": 2.0,
    "formation_agent": 2.0,
    "no_owner": 2.0,
    "no_staff": 1.0,
    "nominee": 1.0,
    "shared_address": 1.0,
    "young": 1.0,
    "no_activity": 1.0,
    "overdue": 1.0,
    "generic_name": 0.5,
    "agent_directs": 0.5,
    "po_box": 0.5,
}


def weighted_sum(weights: Mapping[str, float | tuple[float, int]], indicators: Mapping[str, Column]) -> Column:
    """The sum of the weights of the indicators that hold. A weight with a limit counts so many times at most.

    An indicator that is missing or null does not hold; a name without a weight is an error.
    """
    unknown = set(indicators) - set(weights)
    if unknown:
        raise KeyError(f"no weight for {sorted(unknown)}")
    score = F.lit(0.0)
    for name, value in indicators.items():
        weight = weights[name]
        if isinstance(weight, tuple):
            score = score + weight[0] * F.greatest(F.lit(0), F.least(F.coalesce(value, F.lit(0)), F.lit(weight[1])))
        else:
            score = score + F.when(value, weight).otherwise(0.0)
    return score


def vessel_risk(indicators: Mapping[str, Column]) -> Column:
    """From 0 to 10: the weighted indicators of a vessel."""
    return F.least(F.lit(MOST_RISK), F.round(weighted_sum(VESSEL_WEIGHTS, indicators), 2))


def shell_points(indicators: Mapping[str, Column], staff: Column) -> Column:
    """From 0 to 13.5: the weighted indicators of a company, with half a point of ``no_staff`` if ``staff`` is unknown."""
    known = {**indicators, "no_staff": staff == 0}
    return F.round(weighted_sum(SHELL_WEIGHTS, known) + F.when(staff.isNull(), SHELL_WEIGHTS["no_staff"] / 2).otherwise(0.0), 2)
