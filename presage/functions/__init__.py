from .scalars import (
    clip, code_name, float_grid, guarded_ratio, hash_order, max_abs_zscore, or_zero, sigmoid,
)
from .times import day_bucket, days, floor_to, hour_bucket, minutes_between, wall_micros

__all__ = [
    "clip", "code_name", "day_bucket", "days", "float_grid", "floor_to", "guarded_ratio",
    "hash_order", "hour_bucket", "max_abs_zscore", "minutes_between", "or_zero", "sigmoid", "wall_micros",
]
