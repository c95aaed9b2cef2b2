"""Typed schemas of the five trace tables. Files carry no header, so order matters."""

from pyspark.sql.types import StructType

# Column names and types of the trace tables.
TABLES = {
    "task_events": (
        "time long, missing_info byte, job_id long, task_index long, machine_id long, "
        "event_type byte, user string, scheduling_class byte, priority byte, "
        "cpu_request float, memory_request float, disk_space_request float, "
        "different_machines_restriction byte"
    ),
    "job_events": (
        "time long, missing_info byte, job_id long, event_type byte, user string, "
        "scheduling_class byte, job_name string, logical_job_name string"
    ),
    "machine_events": (
        "time long, machine_id long, event_type byte, platform_id string, cpus float, memory float"
    ),
    "machine_attributes": (
        "time long, machine_id long, attribute_name string, attribute_value string, "
        "attribute_deleted byte"
    ),
    "task_usage": (
        "start_time long, end_time long, job_id long, task_index long, machine_id long, "
        "cpu_rate float, canonical_memory_usage float, assigned_memory_usage float, "
        "unmapped_page_cache float, total_page_cache float, maximum_memory_usage float, "
        "disk_io_time float, local_disk_space_usage float, maximum_cpu_rate float, "
        "maximum_disk_io_time float, cpi float, mai float, sample_portion float, "
        "aggregation_type byte, sampled_cpu_usage float"
    ),
}


def table_schema(name: str) -> StructType:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; choices: {sorted(TABLES)}")
    return StructType.fromDDL(TABLES[name])
