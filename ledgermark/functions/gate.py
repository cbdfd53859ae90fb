"""The posting gate: a threshold that rises with the amount at stake."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    base: float = 0.85
    slope: float = 0.02
    cap: float = 0.995
    reference_minor: int = 10_000
    review_all: bool = False
    version: str = "1"

    def __post_init__(self):
        if not (0 <= self.base <= self.cap <= 1 and self.slope >= 0 and self.reference_minor > 0):
            raise ValueError("the policy needs 0 <= base <= cap <= 1, slope >= 0 and a positive reference")


#: Why there is no confidence. Only the first is a failure of blocking.
ABSENT = ("no_candidates", "unscorable", "grouped", "no_support", "model_error", "no_ranker")


def threshold(amount_minor: Column, policy: Policy = Policy()) -> Column:
    size = F.greatest(F.abs(amount_minor), F.lit(policy.reference_minor)) / F.lit(float(policy.reference_minor))
    return F.least(F.greatest(F.lit(policy.base) + F.lit(policy.slope) * F.log10(size), F.lit(policy.base)), F.lit(policy.cap))


def gate(confidence: Column, amount_minor: Column, absent: Column, policy: Policy = Policy()) -> Column:
    """``post``, ``queue`` or ``no_candidate``; a confidence outside [0, 1] raises."""
    bad = (confidence < 0) | (confidence > 1) | F.isnan(confidence)
    scored = F.lit("queue") if policy.review_all else F.when(confidence >= threshold(amount_minor, policy), "post").otherwise("queue")
    return F.when(confidence.isNull(), F.when(absent == "no_candidates", "no_candidate").otherwise("queue")).when(bad, F.raise_error(F.lit("confidence must be in [0, 1]")).cast("string")).otherwise(scored)
