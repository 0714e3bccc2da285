"""Scores of items as Spark expressions; ``now`` is always given."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of content types in the heat score.
HEAT_TYPES = {
    "model_release": 1.0,
    "product_release": 0.9,
    "api_update": 0.8,
    "security": 0.8,
    "open_source": 0.6,
    "business": 0.55,
    "policy": 0.5,
    "research": 0.45,
    "tutorial": 0.3,
    "opinion": 0.25,
}
# Weights of content types in the selection score.
SELECTION_TYPES = {
    "model_release": 1.0,
    "product_release": 0.95,
    "api_update": 0.9,
    "research": 0.8,
    "open_source": 0.75,
    "security": 0.9,
    "policy": 0.7,
    "business": 0.65,
    "tutorial": 0.6,
    "opinion": 0.45,
}
HEAT_TIERS = {"primary": 30.0, "expert": 18.0, "secondary": 12.0}
SELECTION_TIERS = {"primary": 1.0, "expert": 0.85, "secondary": 0.7, "community": 0.5}


def looked_up(col: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[col], F.lit(default))


def hours_before(now: Column, at: Column) -> Column:
    return (now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 3600.0


def heat(age: Column, tier: Column, content_type: Column, quality: Column, sources: Column) -> Column:
    """Half-life of 18 hours; a quality of 0 counts as 50, as a missing one does."""
    decay = F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / 18.0))
    good = F.when(quality.isNull() | (quality == 0), 50.0).otherwise(quality) * 0.15
    base = looked_up(tier, HEAT_TIERS, 6.0) + F.log1p(F.greatest(sources - 1, F.lit(0))) * 20.0 + good
    return F.round(decay * looked_up(content_type, HEAT_TYPES, 0.35) * base, 3)


def selection(age: Column, tier: Column, content_type: Column, quality: Column, chars: Column, sources: Column) -> Column:
    return F.round(
        0.34 * F.coalesce(quality, F.lit(50.0))
        + 0.17 * looked_up(tier, SELECTION_TIERS, 0.5) * 100
        + 0.17 * looked_up(content_type, SELECTION_TYPES, 0.6) * 100
        + 0.09 * F.greatest(F.lit(0.0), 100.0 - age / 72.0 * 100.0)
        + 0.08 * F.least(chars / 4000.0, F.lit(1.0)) * 100
        + 0.15 * F.least(F.log1p(F.greatest(sources - 1, F.lit(0))) / math.log(4), F.lit(1.0)) * 100,
        2,
    )


# What is said of an item for each factor of its selection score, in the order in which equal factors are named.
REASONS = {"quality": "内容质量高", "source_tier": "一手/权威来源", "content_type": "属于关键变更类型", "freshness": "发布时间新", "body_depth": "正文信息量充足", "corroboration": "多家独立信源报道"}


def selection_reasons(age: Column, tier: Column, content_type: Column, quality: Column, chars: Column, sources: Column, most: int = 3) -> Column:
    """The labels of the ``most`` greatest factors of the selection score, each of 0 to 100, without those of 0."""
    factors = {
        "quality": F.coalesce(quality, F.lit(50.0)),
        "source_tier": looked_up(tier, SELECTION_TIERS, 0.5) * 100,
        "content_type": looked_up(content_type, SELECTION_TYPES, 0.6) * 100,
        "freshness": F.greatest(F.lit(0.0), 100.0 - age / 72.0 * 100.0),
        "body_depth": F.least(chars / 4000.0, F.lit(1.0)) * 100,
        "corroboration": F.least(F.log1p(F.greatest(sources - 1, F.lit(0))) / math.log(4), F.lit(1.0)) * 100,
    }
    ranked = F.array_sort(F.array(*[F.struct((-factors[name]).alias("v"), F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (name, label) in enumerate(REASONS.items())]))
    return F.array_join(F.transform(F.filter(F.slice(ranked, 1, most), lambda f: f["v"] < 0), lambda f: f["label"]), "、")


def gate_quality(accepted: Column, chars: Column, density: Column) -> Column:
    found = 0.5 + 0.5 * F.least(chars / 4000.0, F.lit(1.0)) - F.greatest(density - 0.1, F.lit(0.0))
    return F.when(accepted, F.greatest(F.lit(0.0), F.least(F.lit(0.9999), found))).otherwise(0.0)


def time_proximity(hours: Column) -> Column:
    return F.when(hours.isNull(), 0.5).when(hours >= 72, 0.0).otherwise(1 - hours / 72.0)
