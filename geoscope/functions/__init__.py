from geoscope.functions.scalars import (
    NO_FAMILY,
    clamp,
    class_group,
    confidence_tier,
    fall_code,
    log_transform,
    number,
    probability_band,
    reliability_tier,
    share,
)

__all__ = [
    "NO_FAMILY",
    "clamp",
    "class_group",
    "confidence_tier",
    "fall_code",
    "log_transform",
    "number",
    "probability_band",
    "reliability_tier",
    "share",
]
