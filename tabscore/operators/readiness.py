"""Readiness index: five parts, of which only the accuracy part is measured."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.scalars import clip, round_half_even
from tabscore.operators.models import BOOSTED, BOOSTED_ALT


@dataclass(frozen=True)
class Profile:
    """Parts that are set by hand; ``interpretability`` may differ by model."""

    interpretability: dict[str, int] = field(default_factory=dict)
    other_interpretability: int = 3
    fairness: int = 3
    scalability: int = 4
    data_quality: int = 4

    def interpretability_of(self, model: Column) -> Column:
        out = F.lit(self.other_interpretability)
        for name, v in self.interpretability.items():
            out = F.when(model == name, F.lit(v)).otherwise(out)
        return out


# The hand-set parts of each pipeline. The two boosted profiles stand for the two boosting libraries.
BOOSTED_FIRST = Profile({BOOSTED: 4, "XGBoost": 4})
UNIFORM = Profile()
TREES_FIRST = Profile({"RandomForest": 4, BOOSTED: 4, BOOSTED_ALT: 4, "XGBoost": 4, "LightGBM": 4})


def r2_part(r2: Column) -> Column:
    return round_half_even(clip(r2 * 5.0, 0.0, 5.0), 2)


def share_part(share: Column) -> Column:
    return share * 5.0


def rounded_share_part(share: Column) -> Column:
    return round_half_even(share * 5.0, 2)


def readiness(metrics: DataFrame, accuracy_part: Column, profile: Profile, keys: list[str], model: str = "model") -> DataFrame:
    """One row per model with the five parts and their sum."""
    parts = [
        profile.interpretability_of(F.col(model)).alias("interpretability"),
        F.lit(profile.fairness).alias("fairness"),
        F.lit(profile.scalability).alias("scalability"),
        accuracy_part.alias("accuracy"),
        F.lit(profile.data_quality).alias("data_quality"),
    ]
    rows = metrics.select(*keys, *parts)
    total = (
        F.col("interpretability") + F.col("fairness") + F.col("scalability") + F.col("accuracy") + F.col("data_quality")
    )
    return rows.withColumn("total_score", total)
