"""End-to-end jobs: from trace tables to stored windows, splits and scores."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from presage.config import ENTITY, TASK_FEATURES, TASK_LABEL, SplitConfig
from presage.operators.split import TimeSplit, time_split
from presage.session import staged


def stored_split(windows: DataFrame, features: Sequence[str] = TASK_FEATURES, label: str = TASK_LABEL,
                 keys: Sequence[str] = (*ENTITY, "window_start"), config: SplitConfig = SplitConfig(),
                 balance: bool = True) -> TimeSplit:
    """A time split over stored windows; the (small, undersampled) train side is stored
    too, as iterative fits read it again and again."""
    split = time_split(staged(windows, "windows"), features, label, keys, config, balance)
    return TimeSplit(staged(split.train, "train"), split.test, split.cutoff, split.medians)
