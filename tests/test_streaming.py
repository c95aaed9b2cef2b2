import os
import subprocess
import sys

from pyspark.sql import functions as F

from presage.config import US_PER_HOUR, US_PER_MIN, WindowConfig
from presage.operators.windows import task_aggregates, usage_windows
from presage.session import new_path
from presage.streaming import jobs

W = 30 * US_PER_MIN
USAGE = (
    "job_id long, task_index long, start_time long, cpu_rate double, canonical_memory_usage double, "
    "maximum_memory_usage double, disk_io_time double, assigned_memory_usage double"
)


def usage_row(job, minute, cpu=0.1):
    return (job, 0, minute * US_PER_MIN, cpu, 0.2, 0.3, 0.1, 0.2)


def feed(spark, path, *batches, schema=USAGE):
    """One file per batch, read one per trigger."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream):
    spark = stream.sparkSession
    table, state = new_path(spark, "out"), new_path(spark, "state")
    jobs.run_to_table(stream, table, state).awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def test_windows_equal_batch_and_late_rows_are_dropped(spark):
    first = [usage_row(1, m, 0.1 * m) for m in range(0, 60, 5)]
    second = [usage_row(1, m) for m in range(120, 180, 5)]
    late = [usage_row(1, 2, 99.0)] + [usage_row(2, m) for m in range(240, 300, 10)]
    got = drain(jobs.stream_windows(feed(spark, new_path(spark, "in"), first, second, late), W, 2, "10 minutes"))
    on_time = spark.createDataFrame(first + second + late[1:], USAGE)
    want = usage_windows(on_time, ["job_id", "task_index"], W, task_aggregates(), 2)
    closed = want.where(F.col("window_end") <= 290 * US_PER_MIN - 10 * US_PER_MIN)
    columns = ["job_id", "window_start", "window_end", "n_samples", *[F.round(c, 9) for c in ("cpu_mean", "cpu_std", "cpu_max")]]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, closed.select(*columns).collect()))
    assert got.count() == 5 and got.agg(F.max("cpu_max")).first()[0] < 99.0


def test_alerts(spark):
    stream = feed(spark, new_path(spark, "in"), [usage_row(1, m, float(m)) for m in range(0, 200, 5)],
                  [usage_row(2, 600 + m) for m in range(0, 60, 5)])
    windows = jobs.stream_windows(stream, W, 2, "10 minutes")
    table = new_path(spark, "alerts")
    jobs.run_alerts(windows, lambda df: df.withColumn("score", F.col("cpu_max")), 80.0, table, new_path(spark, "state")).awaitTermination()
    alerts = spark.read.parquet(table)
    assert sorted(r["window_end"] for r in alerts.collect()) == [k * W for k in (3, 4, 5, 6, 7)]


ALERTS = "job_id long, task_index long, window_end long"
SECOND = 1_000_000


def alerts_at(*rows):
    return [(job, 0, t * SECOND) for job, t in rows]


def test_first_alert_is_told_once_and_corrected_by_late_rows(spark):
    source, out, state = (new_path(spark, x) for x in ("in", "first", "state"))

    def run(stream):
        jobs.run_to_table(jobs.first_alerts(stream, delay="100 seconds"), out, state).awaitTermination()
        return sorted((r["job_id"], r["first_alert_time"] // SECOND) for r in spark.read.schema("job_id long, task_index long, first_alert_time long").parquet(out).collect())

    stream = feed(spark, source, alerts_at((1, 500), (2, 520)), alerts_at((1, 450), (3, 560)), schema=ALERTS)  # 1 comes again, late
    assert run(stream) == [(1, 450)]  # the watermark is at 460
    # started again from its checkpoint: 2 and 3 are still held, 1 has been told
    stream = feed(spark, source, alerts_at((1, 470), (1, 900), (2, 800)), alerts_at((1, 950), (2, 300), (4, 990)), schema=ALERTS)
    told = run(stream)
    assert told == [(1, 450), (2, 520), (3, 560)]
    held = jobs.still_held(spark.read.schema(ALERTS).parquet(source), spark.read.schema("job_id long, task_index long, first_alert_time long").parquet(out))
    assert [(r["job_id"], r["first_alert_time"] // SECOND) for r in held.collect()] == [(4, 990)]


def test_a_silent_entity_is_forgotten(spark):
    source, out, state = (new_path(spark, x) for x in ("in", "first", "state"))
    stream = feed(spark, source, alerts_at((1, 100)), alerts_at((2, 300)), alerts_at((1, 350), (2, 1000)), alerts_at((2, 5000)), alerts_at((1, 5100)), alerts_at((2, 9000)), schema=ALERTS)
    jobs.run_to_table(jobs.first_alerts(stream, delay="10 seconds", keep="1000 seconds"), out, state).awaitTermination()
    got = sorted((r["job_id"], r["first_alert_time"] // SECOND) for r in spark.read.parquet(out).collect())
    assert got[:3] == [(1, 100), (1, 5100), (2, 300)]


def test_alerts_of_an_empty_stream(spark):
    source, out, state = (new_path(spark, x) for x in ("in", "first", "state"))
    spark.createDataFrame([], ALERTS).write.parquet(source)
    stream = jobs.first_alerts(spark.readStream.schema(ALERTS).parquet(source))
    jobs.run_to_table(stream, out, state).awaitTermination()
    assert spark.read.schema(stream.schema).parquet(out).count() == 0


PLAIN_SESSION = '''
import sys

sys.path.insert(0, sys.argv[1])  # the driver alone finds the package
from pyspark.sql import SparkSession
from presage.session import new_path
from presage.streaming import jobs

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
schema = "job_id long, task_index long, window_end long"
rows = [(1, 0, 500), (1, 0, 450), (None, 0, 400), (None, 0, None), (None, None, 9000), (5, 5, None), (2, 0, 9100)]
at = lambda t: None if t is None else t * 1_000_000
source, out, state = (new_path(spark, x) for x in ("in", "first", "state"))
spark.createDataFrame([(j, i, at(t)) for j, i, t in rows], schema).write.parquet(source)
stream = jobs.first_alerts(spark.readStream.schema(schema).parquet(source), delay="100 seconds")
jobs.run_to_table(stream, out, state).awaitTermination()
told = spark.read.schema(stream.schema).parquet(out)
held = jobs.still_held(spark.read.parquet(source), told)
print("FOUND", [sorted(map(str, (tuple(r) for r in df.collect()))) for df in (told, held)])
'''


def test_first_alerts_of_a_session_with_defaults(tmp_path):
    """No state store is set, workers don't find the package, and keys or times are NULL."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PLAIN_SESSION, os.getcwd()], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    found = next((x for x in done.stdout.splitlines() if x.startswith("FOUND")), done.stderr[-2000:])
    told, held = [(1, 0, 450 * SECOND), (None, 0, 400 * SECOND)], [(2, 0, 9100 * SECOND), (5, 5, None), (None, None, 9000 * SECOND)]
    assert found == f"FOUND {[sorted(map(str, x)) for x in (told, held)]}"


def test_late_samples_reach_closed_windows(spark):
    from presage.operators.merging import state_features, window_states

    first = [usage_row(1, m, 0.1 * m) for m in range(0, 60, 5)]
    second = [usage_row(2, m) for m in range(900, 960, 5)]
    late = [usage_row(1, 2, 99.0), usage_row(1, 33, 7.0)]  # long after the watermark would have closed them
    table, state = new_path(spark, "states"), new_path(spark, "state")
    jobs.run_window_states(feed(spark, new_path(spark, "in"), first, second, late), W, table, state).awaitTermination()
    schema = window_states(spark.createDataFrame([], USAGE), W).schema
    got = state_features(jobs.read_window_states(spark, table, schema), W, 2)
    want = usage_windows(spark.createDataFrame(first + second + late, USAGE), ["job_id", "task_index"], W, task_aggregates(), 2)
    columns = ["job_id", "window_start", "window_end", "n_samples", *[F.round(c, 9) for c in ("cpu_mean", "cpu_std", "cpu_max", "mem_std")]]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_labels(spark):
    usage = [usage_row(j, m) for j in (1, 2, 3) for m in range(0, 120, 5)] + [usage_row(9, 1000 + m) for m in (0, 5)]
    fails = [
        (1, 0, 2 * W), (1, 0, 3 * W), (1, 0, 3 * W + 7),  # on the edge, next edge, past it
        (2, 0, 30 * W), (9, 0, 1005 * US_PER_MIN),
    ]
    schema = "job_id long, task_index long, time long"
    closed = jobs.stream_windows(feed(spark, new_path(spark, "in"), usage), W, 2, "10 minutes")
    failed = feed(spark, new_path(spark, "in"), fails, schema=schema)
    joined = jobs.stream_labels(closed.select("job_id", "task_index", "window_start", "window_end", "closed_at"),
                                failed, W, W, "10 minutes")
    got = {(r["job_id"], r["window_end"]): r["fail_time"] for r in drain(joined).collect()}
    # (end, end + W]: a failure exactly at a window's end belongs to the window before it.
    assert got[1, W] == 2 * W and got[1, 2 * W] == 3 * W and got[1, 3 * W] == 3 * W + 7
    assert got[2, 2 * W] is None and got[3, 4 * W] is None
