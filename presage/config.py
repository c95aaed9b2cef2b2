"""Fixed vocabularies and the window configuration shared by every job."""

from dataclasses import dataclass

US_PER_MIN = 60_000_000
US_PER_HOUR = 60 * US_PER_MIN
US_PER_DAY = 24 * US_PER_HOUR

ENTITY = ("job_id", "task_index")

# Event codes of the trace.
TASK_EVENT_NAMES = {
    0: "SUBMIT", 1: "SCHEDULE", 2: "EVICT", 3: "FAIL", 4: "FINISH",
    5: "KILL", 6: "LOST", 7: "UPDATE_PENDING", 8: "UPDATE_RUNNING",
}
MACHINE_EVENT_NAMES = {0: "ADD", 1: "REMOVE", 2: "UPDATE"}
SUBMIT, EVICT, FAIL, KILL, LOST = 0, 2, 3, 5, 6
ADD, REMOVE = 0, 1

# Feature names, in the order models see them.
TASK_FEATURES = (
    "n_samples", "cpu_mean", "cpu_std", "cpu_max",
    "mem_mean", "mem_std", "mem_max", "mem_peak_mean",
    "disk_io_mean", "assigned_mem_mean",
    "cpu_request", "memory_request", "disk_space_request",
    "scheduling_class", "priority",
    "mem_usage_ratio", "cpu_usage_ratio",
)
MACHINE_FEATURES = (
    "n_samples", "n_tasks",
    "cpu_sum", "cpu_mean", "cpu_std", "cpu_max",
    "mem_sum", "mem_mean", "mem_std", "mem_max",
    "disk_io_mean", "cpus", "memory",
    "cpu_utilization", "mem_utilization", "churn_events",
)
ZSCORE_FEATURES = ("cpu_mean", "cpu_max", "mem_mean", "mem_max", "mem_peak_mean", "disk_io_mean")
FEATURE_GROUPS = {
    "cpu": ("cpu_mean", "cpu_std", "cpu_max", "cpu_request", "cpu_usage_ratio"),
    "memory": ("mem_mean", "mem_std", "mem_max", "mem_peak_mean", "assigned_mem_mean",
               "memory_request", "mem_usage_ratio"),
    "disk": ("disk_io_mean", "disk_space_request"),
    "scheduling": ("scheduling_class", "priority", "n_samples"),
}
TASK_LABEL = "label_fail_soon"
MACHINE_LABEL = "label_remove_soon"

# The order and display words of the compared models; their keys are our own.
MODEL_LABELS = {
    "zscore_anomaly_baseline": "Z-score (unsupervised)",
    "logreg_baseline": "Logistic Regression",
    "boosted_trees": "Boosted trees",
    "boosted_trees_tuned": "Boosted trees (tuned)",
    "sequence_net": "Sequence network",
}


@dataclass(frozen=True)
class WindowConfig:
    """Tumbling width, label horizon (both in microseconds) and the sample floor."""

    window_us: int = 30 * US_PER_MIN
    horizon_us: int = 30 * US_PER_MIN
    min_samples: int = 2


@dataclass(frozen=True)
class SplitConfig:
    """Time split and class balance of the training side."""

    test_frac: float = 0.2
    negative_ratio: float = 20.0
    embargo_us: int = 0
    seed: int = 42


def check_feature_groups(groups=FEATURE_GROUPS, features=TASK_FEATURES):
    """The groups must cover the features and not overlap."""
    named = [c for group in groups.values() for c in group]
    off = set(named) ^ set(features)
    if off or len(named) != len(set(named)):
        raise ValueError(f"feature groups do not partition the features: {sorted(off) or 'overlap'}")
