"""Plain SQL for the catalog's queries, written against the driver's tables.

Windows, joins and rankings are spelled the straightforward way here (global
sorts, correlated pairs); agreement with the catalog is the correctness check.
"""

# Fixed values, written out here so that a wrong one in the package shows.
HOUR = 3_600_000_000
DAY = 24 * HOUR
TASK_FEATURES = (
    "n_samples", "cpu_mean", "cpu_std", "cpu_max", "mem_mean", "mem_std", "mem_max", "mem_peak_mean", "disk_io_mean",
    "assigned_mem_mean", "cpu_request", "memory_request", "disk_space_request", "scheduling_class", "priority",
    "mem_usage_ratio", "cpu_usage_ratio",
)
ZSCORE_FEATURES = ("cpu_mean", "cpu_max", "mem_mean", "mem_max", "mem_peak_mean", "disk_io_mean")
MODEL_LABELS = {
    "zscore_anomaly_baseline": "Z-score (unsupervised)", "logreg_baseline": "Logistic Regression",
    "boosted_trees": "Boosted trees", "boosted_trees_tuned": "Boosted trees (tuned)", "sequence_net": "Sequence network",
}
# 0.05 to 0.95 by 0.05 and 1.0 to 8.0 by 0.25, as doubles add up.
PROBABILITY_GRID = tuple(0.05 + i * 0.05 for i in range(19))
ZSCORE_GRID = tuple(1.0 + i * 0.25 for i in range(29))
E = "job_id, task_index"

TRACE = """
ev AS (
  SELECT CAST(user_id // 10 AS BIGINT) AS job_id, user_id % 10 AS task_index, user_id % 20 AS machine_id,
         epoch_us(ts) AS time, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
), task_usage AS (
  SELECT job_id, task_index, machine_id, time AS start_time, time + 300000000 AS end_time, value AS cpu_rate,
         k AS canonical_memory_usage, k * 1.25 AS maximum_memory_usage, value * 0.1 AS disk_io_time,
         k * 1.1 AS assigned_memory_usage
  FROM ev WHERE kind IN ('click', 'view', 'purchase')
), task_events AS (
  SELECT job_id, task_index, machine_id, time,
         CASE WHEN kind = 'signup' THEN 0 WHEN value >= 100 THEN 3 WHEN CAST(k AS INT) % 3 = 0 THEN 2
              WHEN CAST(k AS INT) % 3 = 1 THEN 5 ELSE 6 END AS event_type,
         value AS cpu_request, k AS memory_request, value * 0.01 AS disk_space_request,
         CAST(k AS INT) % 4 AS scheduling_class, CAST(k AS INT) % 12 AS priority
  FROM ev WHERE kind IN ('signup', 'error')
), machine_events AS (
  SELECT machine_id, time, CASE WHEN kind = 'signup' THEN 0 WHEN value >= 250 THEN 1 ELSE 2 END AS event_type,
         value AS cpus, k AS memory
  FROM ev WHERE kind = 'signup' OR (kind = 'error' AND value >= 200)
)"""

_ATTRS = "cpu_request, memory_request, disk_space_request, scheduling_class, priority"
_ATTR_ORDER = ", ".join(f"{a} NULLS FIRST" for a in _ATTRS.split(", "))

PROFILES = f"""
submit AS (
  SELECT {E}, {_ATTRS} FROM (
    SELECT *, row_number() OVER (PARTITION BY {E} ORDER BY time NULLS FIRST, {_ATTR_ORDER}) AS rn
    FROM task_events WHERE event_type = 0) WHERE rn = 1
), fails AS (
  SELECT {E}, min(time) AS fail_time FROM task_events WHERE event_type = 3 GROUP BY {E}
), capacity AS (
  SELECT machine_id, cpus, memory FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY time NULLS FIRST, cpus NULLS FIRST, memory NULLS FIRST) AS rn
    FROM machine_events WHERE event_type = 0) WHERE rn = 1
), removes AS (
  SELECT machine_id, min(time) AS remove_time FROM machine_events WHERE event_type = 1 GROUP BY machine_id
)"""


def task_windows(window=DAY, horizon=DAY, by_machine=False, zero=False, name="w"):
    keys = E + (", machine_id" if by_machine else "")
    missing = "0.0" if zero else "NULL"

    def request(c):
        return f"coalesce(s.{c}, 0.0) AS {c}" if zero else f"s.{c}"

    return f"""
{name} AS (
  SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, window_start, window_start + {window} AS window_end,
         n_samples, cpu_mean, cpu_std, cpu_max, mem_mean, mem_std, mem_max, mem_peak_mean, disk_io_mean, assigned_mem_mean,
         {request('cpu_request')}, {request('memory_request')}, {request('disk_space_request')},
         s.scheduling_class, s.priority, f.fail_time,
         CASE WHEN f.fail_time > window_start + {window} AND f.fail_time <= window_start + {window + horizon} THEN 1 ELSE 0 END AS label_fail_soon,
         CASE WHEN s.memory_request > 0 THEN mem_mean / s.memory_request ELSE {missing} END AS mem_usage_ratio,
         CASE WHEN s.cpu_request > 0 THEN cpu_mean / s.cpu_request ELSE {missing} END AS cpu_usage_ratio
  FROM (
    SELECT {keys}, start_time // {window} * {window} AS window_start, count(*) AS n_samples,
           avg(cpu_rate) AS cpu_mean, coalesce(stddev_samp(cpu_rate), 0.0) AS cpu_std, max(cpu_rate) AS cpu_max,
           avg(canonical_memory_usage) AS mem_mean, coalesce(stddev_samp(canonical_memory_usage), 0.0) AS mem_std,
           max(canonical_memory_usage) AS mem_max, avg(maximum_memory_usage) AS mem_peak_mean,
           avg(disk_io_time) AS disk_io_mean, avg(assigned_memory_usage) AS assigned_mem_mean
    FROM task_usage GROUP BY {keys}, start_time // {window} * {window} HAVING count(*) >= 2) g
  JOIN submit s ON g.job_id = s.job_id AND g.task_index = s.task_index
  LEFT JOIN fails f ON g.job_id = f.job_id AND g.task_index = f.task_index
)"""


def nearest(source, column, q, name):
    return f"""
{name} AS (
  SELECT {column} AS v FROM (
    SELECT {column}, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {source})
  WHERE rn = 1 + CAST(round((n - 1) * CAST({q} AS DOUBLE)) AS BIGINT)
)"""


_KEY_HASH = "md5(concat_ws('|', '42', {}))"
_WINDOW_HASH = _KEY_HASH.format("job_id, task_index, window_start")


def _imputed(side, columns):
    fills = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM raw_train)) AS {c}" for c in columns
    )
    return f"SELECT * REPLACE ({fills}) FROM raw_{side}"


def daily_split(ratio=20.0):
    return f"""{TRACE}, {PROFILES}, {task_windows()}, {nearest('w', 'window_end', 0.8, 'cutoff')},
raw_train AS (SELECT * FROM w WHERE window_end <= (SELECT v FROM cutoff)),
raw_test AS (SELECT * FROM w WHERE window_end > (SELECT v FROM cutoff)),
full_train AS ({_imputed('train', TASK_FEATURES)}),
test AS ({_imputed('test', TASK_FEATURES)}),
negatives AS (
  SELECT *, row_number() OVER (ORDER BY {_WINDOW_HASH}, job_id, task_index, window_start) AS rn
  FROM full_train WHERE label_fail_soon = 0),
train AS (
  SELECT * FROM full_train WHERE label_fail_soon = 1
  UNION ALL
  SELECT * EXCLUDE (rn) FROM negatives
  WHERE rn <= (SELECT floor(count(*) * {ratio}) FROM full_train WHERE label_fail_soon = 1))"""


def normal(source):
    fields = ", ".join(
        f"avg({c}) AS {c}_mu, CASE WHEN stddev_pop({c}) = 0 THEN 1e-6 ELSE stddev_pop({c}) END AS {c}_sigma"
        for c in ZSCORE_FEATURES
    )
    return f"normal AS (SELECT {fields} FROM {source} WHERE label_fail_soon = 0)"


ZSCORE = "greatest(" + ", ".join(f"abs(({c} - {c}_mu) / {c}_sigma)" for c in ZSCORE_FEATURES) + ")"


def scored_windows():
    return f"""{TRACE}, {PROFILES}, {task_windows(by_machine=True, zero=True)}, {nearest('w', 'window_end', 0.8, 'cutoff')},
fitted AS (SELECT * FROM w WHERE window_end <= (SELECT v FROM cutoff)), {normal('fitted')},
scored AS (SELECT w.*, {ZSCORE} AS score FROM w, normal WHERE window_end > (SELECT v FROM cutoff))"""


def risk():
    return f"""{scored_windows()},
risky AS (SELECT *, 1.0 / (1.0 + exp(-(score - 2.0))) AS predicted_risk FROM scored),
series AS (
  SELECT machine_id, window_start, window_end, sum(cpu_mean) AS cpu_sum, sum(mem_mean) AS mem_sum, count(*) AS n_tasks,
         max(predicted_risk) AS max_predicted_risk, max(label_fail_soon) AS any_fail_soon
  FROM risky GROUP BY machine_id, window_start, window_end),
markers AS (
  SELECT DISTINCT machine_id, job_id, task_index, fail_time AS time, 'task_fail' AS event FROM risky WHERE fail_time IS NOT NULL
  UNION ALL
  SELECT machine_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), time, 'machine_remove' FROM machine_events WHERE event_type = 1)"""


PRF = """CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS "precision",
         CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1"""
PRF_FLOATS = ("precision", "recall", "f1")
METRIC_FLOATS = (*PRF_FLOATS, "roc_auc", "pr_auc")


def evaluate(source, label, score, threshold, by=None, strict=False, name="report"):
    """CTEs ending in one with every metric of a scored relation."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    op = ">" if strict else ">="
    return f"""
{name}_per AS (
  SELECT {g}{score} AS s, CAST(count_if({label} = 1) AS BIGINT) AS pos, CAST(count_if({label} <> 1) AS BIGINT) AS neg
  FROM {source} WHERE {score} IS NOT NULL GROUP BY {g}{score}),
{name}_run AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY s DESC) AS tp_run, sum(pos + neg) OVER ({part}ORDER BY s DESC) AS n_run,
         coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM {name}_per),
{name}_agg AS (
  SELECT {g}CAST(coalesce(sum(pos) FILTER (s {op} {threshold}), 0) AS BIGINT) AS tp,
         CAST(coalesce(sum(neg) FILTER (s {op} {threshold}), 0) AS BIGINT) AS fp,
         CAST(coalesce(sum(pos) FILTER (NOT s {op} {threshold}), 0) AS BIGINT) AS fn,
         CAST(coalesce(sum(neg) FILTER (NOT s {op} {threshold}), 0) AS BIGINT) AS tn,
         CAST(coalesce(sum(pos + neg), 0) AS BIGINT) AS n_test, CAST(coalesce(sum(pos), 0) AS BIGINT) AS n_positive,
         sum(pos * (neg_below + neg / 2.0)) AS pairs, sum(pos * tp_run / CAST(n_run AS DOUBLE)) AS steps
  FROM {name}_run {group}),
{name} AS (
  SELECT {g}tp, fp, fn, tn, n_test, n_positive, {PRF},
         CASE WHEN n_positive > 0 AND n_test > n_positive THEN pairs / (CAST(n_positive AS DOUBLE) * (n_test - n_positive)) END AS roc_auc,
         CASE WHEN n_positive > 0 AND n_test > n_positive THEN steps / n_positive END AS pr_auc
  FROM {name}_agg)"""


def sweep(source, label, score, grid, strict=False, name="sweep"):
    points = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in grid)
    op = ">" if strict else ">="
    return f"""
{name} AS (
  SELECT threshold, tp, fp, fn, {PRF} FROM (
    SELECT t.threshold, CAST(count_if({label} = 1 AND {score} {op} t.threshold) AS BIGINT) AS tp,
           CAST(count_if({label} <> 1 AND {score} {op} t.threshold) AS BIGINT) AS fp,
           CAST(count_if({label} = 1 AND NOT {score} {op} t.threshold) AS BIGINT) AS fn
    FROM (SELECT unnest([{points}]) AS threshold) t, {source} GROUP BY t.threshold))"""


DISCOUNT = """
lines AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10 AS score, l_extendedprice AS price,
         epoch_us(l_shipdate) AS window_end, l_linestatus
  FROM lineitem)"""


def shaped(body, floats=()):
    """Final SELECT with the catalog's rounding on the float columns."""
    if not floats:
        return body
    swaps = ", ".join(f'CAST(round(CAST("{c}" AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "{c}"' for c in floats)
    head, _, tail = body.rpartition("\n--final\n")
    return f"{head}\nSELECT * REPLACE ({swaps}) FROM (\n{tail}\n)"


def sql(ctes, final, floats=()):
    prefix = f"WITH {ctes}" if ctes else ""
    return shaped(f"{prefix}\n--final\n{final}", floats) if floats else f"{prefix}\n{final}"


WINDOW_FLOATS = (
    "cpu_mean", "cpu_std", "cpu_max", "mem_mean", "mem_std", "mem_max", "mem_peak_mean", "disk_io_mean",
    "assigned_mem_mean", "cpu_request", "memory_request", "disk_space_request", "mem_usage_ratio", "cpu_usage_ratio",
)


def _profile(spark_tables):
    parts = []
    for table, columns in spark_tables.items():
        for c in columns:
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count(\"{c}\") AS n_null, "
                f"100.0 * (count(*) - count(\"{c}\")) / CAST(nullif(count(*), 0) AS DOUBLE) AS null_pct FROM {table}"
            )
    return " UNION ALL ".join(parts)


# Columns of the driver tables.
PROFILED_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def _histogram(source, column, bins, name):
    return f"""
{name}_span AS (
  SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
  FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source}) WHERE v IS NOT NULL),
{name}_n AS (
  SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins}.0::DOUBLE)) AS INT), {bins - 1}) AS bin, count(*) AS n
  FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source}), {name}_span WHERE v IS NOT NULL GROUP BY 1),
{name} AS (
  SELECT CAST(b.i AS INT) AS bin, lo + b.i * ((hi - lo) / {bins}.0::DOUBLE) AS bin_start,
         lo + (b.i + 1) * ((hi - lo) / {bins}.0::DOUBLE) AS bin_end, coalesce(n, 0) AS n
  FROM range({bins}) b(i) CROSS JOIN {name}_span LEFT JOIN {name}_n ON {name}_n.bin = b.i)"""


def _named(column, names):
    return "CASE " + " ".join(f"WHEN {column} = {c} THEN '{n}'" for c, n in names.items()) + " END"


def _sequence(gap):
    columns, joins = [], ""
    for c in TASK_FEATURES:
        for step in range(6):
            back = 5 - step
            value = f"p{step}.{c}" if gap else f"lag(w.{c}, {back}) OVER e"
            columns.append(f"coalesce(CAST({value} AS DOUBLE), 0.0) AS {c}__t{step}")
    if gap:
        joins = " ".join(
            f"LEFT JOIN w p{step} ON p{step}.job_id = w.job_id AND p{step}.task_index = w.task_index "
            f"AND p{step}.window_start = w.window_start - {(5 - step) * DAY}" for step in range(6)
        )
    seen = (
        f"count(*) OVER (PARTITION BY w.job_id, w.task_index ORDER BY w.window_start RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW)"
        if gap else "least(row_number() OVER e, 6)"
    )
    return sql(
        f"{TRACE}, {PROFILES}, {task_windows()}",
        f"SELECT w.job_id, w.task_index, w.window_start, {seen} AS n_seen, {', '.join(columns)} FROM w {joins} "
        "WINDOW e AS (PARTITION BY w.job_id, w.task_index ORDER BY w.window_start)",
        [f"{c}__t{s}" for c in TASK_FEATURES for s in range(6)],
    )


_REQUEST = f"""
requested AS (
  SELECT {E}, memory_request, cpu_request FROM (
    SELECT *, row_number() OVER (PARTITION BY {E} ORDER BY time, memory_request, cpu_request) AS rn
    FROM task_events WHERE event_type = 0 AND memory_request > 0) WHERE rn = 1),
peaks AS (
  SELECT {E}, max(canonical_memory_usage) AS peak_mem_used, max(cpu_rate) AS peak_cpu_used FROM task_usage GROUP BY {E}),
ratios AS (
  SELECT *, CASE WHEN peak_mem_used IS NOT NULL THEN least(greatest(peak_mem_used / memory_request, 0.0), 3.0) END AS mem_ratio
  FROM requested JOIN peaks USING ({E}))"""

_ALERTS = f"""
alerts AS (
  SELECT {E}, first_alert_time, fail_time, (fail_time - first_alert_time) / 6e7 AS lead_time_min FROM (
    SELECT {E}, min(window_end) FILTER (score >= 1.5 AND window_end < fail_time) AS first_alert_time,
           min(fail_time) AS fail_time
    FROM scored
    WHERE ({E}) IN (SELECT ({E}) FROM scored WHERE label_fail_soon = 1)
    GROUP BY {E}))"""

_CLOSED = f"""
closed AS (
  SELECT {E}, start_time // {DAY} * {DAY} AS window_start, start_time // {DAY} * {DAY} + {DAY} AS window_end,
         count(*) AS n_samples,
         avg(cpu_rate) AS cpu_mean, coalesce(stddev_samp(cpu_rate), 0.0) AS cpu_std, max(cpu_rate) AS cpu_max,
         avg(canonical_memory_usage) AS mem_mean, coalesce(stddev_samp(canonical_memory_usage), 0.0) AS mem_std,
         max(canonical_memory_usage) AS mem_max, avg(maximum_memory_usage) AS mem_peak_mean,
         avg(disk_io_time) AS disk_io_mean, avg(assigned_memory_usage) AS assigned_mem_mean
  FROM task_usage GROUP BY {E}, start_time // {DAY} HAVING count(*) >= 2)"""


def oracle() -> dict[str, str]:
    grouped_metrics = "SELECT * FROM report"
    out = {}
    out["table_profile"] = sql("", _profile(PROFILED_COLUMNS), ["null_pct"])
    out["feature_manifest"] = sql(
        f"{TRACE}, {PROFILES}, {task_windows()}",
        f"""SELECT count(*) AS n_rows, count(DISTINCT ({E})) AS n_entities, CAST(sum(label_fail_soon) AS BIGINT) AS n_positive,
            min(window_end) AS window_end_min, max(window_end) AS window_end_max,
            CASE WHEN count(*) > 0 THEN sum(label_fail_soon) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS positive_rate FROM w""",
        ["positive_rate"],
    )
    out["manifest_upsert"] = sql(
        """cur AS (SELECT o_custkey, count(*) AS n_rows, max(o_totalprice) AS top_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
inc AS (SELECT o_custkey, count(*) AS n_rows, max(o_totalprice) AS top_price FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1)""",
        "SELECT * FROM inc UNION ALL SELECT * FROM cur WHERE o_custkey NOT IN (SELECT o_custkey FROM inc)",
        ["top_price"],
    )
    out["csv_ingest"] = sql(
        TRACE,
        f"""SELECT {E}, count(*) AS n_rows, count(*) FILTER (task_index <> 3) AS n_end_time, CAST(0 AS BIGINT) AS n_cpi,
            max(start_time) AS last_start, max(canonical_memory_usage) AS mem_max
            FROM task_usage GROUP BY {E}""",
        ["mem_max"],
    )
    held = {
        "task_usage": ("task_usage", "start_time end_time job_id task_index machine_id cpu_rate canonical_memory_usage maximum_memory_usage disk_io_time assigned_memory_usage"),
        "task_events": ("task_events", "time job_id task_index machine_id event_type cpu_request memory_request disk_space_request scheduling_class priority"),
        "machine_events": ("machine_events", "time machine_id event_type cpus memory"),
        "job_events": ("(SELECT * FROM task_events WHERE task_index = 0)", "time job_id event_type"),
        "machine_attributes": ("task_usage", "time machine_id attribute_name attribute_value"),
    }
    names = {  # Fixed values: columns of the trace.
        "task_usage": "start_time end_time job_id task_index machine_id cpu_rate canonical_memory_usage assigned_memory_usage unmapped_page_cache total_page_cache maximum_memory_usage disk_io_time local_disk_space_usage maximum_cpu_rate maximum_disk_io_time cpi mai sample_portion aggregation_type sampled_cpu_usage",
        "task_events": "time missing_info job_id task_index machine_id event_type user scheduling_class priority cpu_request memory_request disk_space_request different_machines_restriction",
        "machine_events": "time machine_id event_type platform_id cpus memory",
        "job_events": "time missing_info job_id event_type user scheduling_class job_name logical_job_name",
        "machine_attributes": "time machine_id attribute_name attribute_value attribute_deleted",
    }
    out["ingest_manifest"] = sql(
        TRACE,
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, {'0::BIGINT' if c in held[name][1].split() else 'count(*)'} AS n_null, "
            f"{'0.0' if c in held[name][1].split() else '100.0'}::DOUBLE AS null_pct FROM {held[name][0]}"
            for name in names for c in names[name].split()
        ) + " UNION ALL SELECT 'retired', 'job_id', 1, 1, 100.0",
        ["null_pct"],
    )
    out["feature_job"] = out["feature_manifest"]
    out["file_profile"] = "SELECT count(*) > 0 AS has_files, count(*) > 0 AS has_size FROM lineitem"
    confused = ", ".join(
        f"CAST(count_if({c}) AS BIGINT) AS {n}" for n, c in (
            ("tp", "label = 1 AND score >= t"), ("fp", "label = 0 AND score >= t"), ("fn", "label = 1 AND score < t"), ("tn", "label = 0 AND score < t"))
    )
    out["registry_json"] = sql(
        DISCOUNT, f"SELECT model, {confused} FROM lines, (VALUES ('a', 0.7::DOUBLE), ('b', 0.5::DOUBLE)) r(model, t) GROUP BY model")
    out["shuffled_chunks"] = """SELECT count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
        count(DISTINCT o_custkey) AS n_entities, 16::BIGINT AS n_chunks FROM orders"""
    out["shard_selection"] = sql(
        f"{TRACE}, s AS (SELECT start_time, (start_time // {HOUR}) % 500 AS shard FROM task_usage)",
        " UNION ALL ".join(
            f"SELECT '{pick}' AS pick, count(*) AS n_rows, min(start_time) AS first_start FROM s WHERE {cond}"
            for pick, cond in {
                "continuous": "shard <= 172", "snapshots": "shard > 172", "range": "shard BETWEEN 10 AND 40",
                "spaced": "shard % 25 = 0 AND shard // 25 < 20",
            }.items()
        ),
    )
    out["trace_overview"] = sql(
        TRACE,
        f"""SELECT (max(time) - min(time)) / 8.64e10 AS span_days, count(DISTINCT job_id) AS n_jobs,
            count(DISTINCT ({E})) AS n_tasks, (SELECT count(DISTINCT machine_id) FROM machine_events) AS n_machines
            FROM task_events""",
        ["span_days"],
    )
    task_names = {0: "SUBMIT", 2: "EVICT", 3: "FAIL", 5: "KILL", 6: "LOST"}
    machine_names = {0: "ADD", 1: "REMOVE", 2: "UPDATE"}
    out["event_type_distribution"] = sql(
        TRACE,
        f"""SELECT 'task' AS log, event_type, count(*) AS n, {_named('event_type', task_names)} AS event_name FROM task_events GROUP BY event_type
            UNION ALL SELECT 'machine', event_type, count(*), {_named('event_type', machine_names)} FROM machine_events GROUP BY event_type""",
    )
    out["usage_by_hour"] = sql(
        TRACE,
        f"""SELECT CAST(floor(start_time / 3.6e9) AS INT) AS hour_bucket, sum(cpu_rate) AS cpu_rate_sum,
            sum(canonical_memory_usage) AS mem_sum, count(*) AS n_samples FROM task_usage GROUP BY 1""",
        ["cpu_rate_sum", "mem_sum"],
    )
    daily = "SELECT CAST(floor(time / 8.64e10) AS INT) AS day, event_type, count(*) AS n FROM task_events WHERE event_type IN (2, 3, 6) GROUP BY 1, 2"
    out["failures_per_day"] = sql(TRACE, daily)
    out["failure_lines"] = sql(
        f"{TRACE}, d AS ({daily})",
        """SELECT day, CAST(coalesce(sum(n) FILTER (event_type = 2), 0) AS BIGINT) AS evict,
           CAST(coalesce(sum(n) FILTER (event_type = 3), 0) AS BIGINT) AS fail,
           CAST(coalesce(sum(n) FILTER (event_type = 6), 0) AS BIGINT) AS lost FROM d GROUP BY day""",
    )
    quantile_ctes = ", ".join(
        nearest("task_usage", c, q, f"{c}_{n}")
        for c in ("cpu_rate", "canonical_memory_usage") for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))
    )
    out["usage_quantiles"] = sql(
        f"{TRACE}, {quantile_ctes}",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, " + ", ".join(f"(SELECT v FROM {c}_{n}) AS {n}" for n in ("p50", "p90", "p99"))
            for c in ("cpu_rate", "canonical_memory_usage")
        ),
        ["p50", "p90", "p99"],
    )
    out["price_quantiles"] = sql(
        "",
        """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50,
           quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY 1""",
        ["p25", "p50", "p75", "p999"],
    )
    out["usage_histogram"] = sql(
        f"{TRACE}, {_histogram('task_usage', 'cpu_rate', 100, 'hc')}, {_histogram('task_usage', 'canonical_memory_usage', 100, 'hm')}",
        "SELECT 'cpu_rate' AS feature, * FROM hc UNION ALL SELECT 'canonical_memory_usage', * FROM hm",
        ["bin_start", "bin_end"],
    )
    keyed = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate_us, l_extendedprice_s"
    out["usage_sample"] = sql(
        """k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS l_shipdate_us,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice_s FROM lineitem)""",
        f"SELECT * FROM k ORDER BY {_KEY_HASH.format(keyed)}, {keyed} LIMIT 2000",
    )
    out["exhaustion_pattern"] = sql(
        f"""{TRACE},
failed AS (
  SELECT {E}, machine_id, time, memory_request FROM task_events
  WHERE event_type = 3 AND machine_id IS NOT NULL AND memory_request > 0),
seen AS (
  SELECT f.job_id, f.task_index, f.machine_id, f.time AS fail_time, f.memory_request, count(*) AS n_samples,
         arg_min(u.canonical_memory_usage, u.start_time) AS first_mem, arg_max(u.canonical_memory_usage, u.start_time) AS last_mem
  FROM failed f JOIN task_usage u
    ON u.job_id = f.job_id AND u.task_index = f.task_index AND u.machine_id = f.machine_id AND u.end_time <= f.time
  GROUP BY ALL)""",
        """SELECT * FROM seen WHERE n_samples >= 8 AND last_mem / memory_request > 0.8
           AND last_mem / memory_request > first_mem / memory_request * 1.3""",
        ["memory_request", "first_mem", "last_mem"],
    )
    out["load_before_removal"] = sql(
        f"""{TRACE},
removed AS (SELECT DISTINCT machine_id, time AS remove_time FROM machine_events WHERE event_type = 1 AND machine_id IS NOT NULL),
points AS (SELECT machine_id, start_time, sum(cpu_rate) AS cpu_rate_sum, count(*) AS n_tasks FROM task_usage GROUP BY 1, 2),
pairs AS (
  SELECT r.machine_id, remove_time, start_time, cpu_rate_sum, n_tasks, count(*) OVER (PARTITION BY r.machine_id, remove_time) AS n_points
  FROM removed r JOIN points p ON p.machine_id = r.machine_id AND start_time BETWEEN remove_time - {3 * DAY} AND remove_time)""",
        "SELECT * REPLACE (CAST(n_points AS BIGINT) AS n_points) FROM pairs WHERE n_points >= 30",
        ["cpu_rate_sum"],
    )
    request_floats = ["memory_request", "cpu_request", "peak_mem_used", "peak_cpu_used", "mem_ratio"]
    out["request_vs_peak"] = sql(f"{TRACE}, {_REQUEST}", "SELECT * FROM ratios", request_floats)
    out["provisioning_histogram"] = sql(
        f"{TRACE}, {_REQUEST}, {_histogram('ratios', 'mem_ratio', 100, 'h')}", "SELECT * FROM h", ["bin_start", "bin_end"]
    )
    out["pct_over_request"] = sql(
        f"{TRACE}, {_REQUEST}", "SELECT 100.0 * count_if(mem_ratio > 1.0) / CAST(nullif(count(*), 0) AS DOUBLE) AS pct_over FROM ratios", ["pct_over"]
    )

    out["first_event_attributes"] = sql(
        f"{TRACE}, {PROFILES}", f"SELECT * FROM submit LEFT JOIN fails USING ({E})",
        ["cpu_request", "memory_request", "disk_space_request"],
    )
    out["machine_profiles"] = sql(
        f"{TRACE}, {PROFILES}", "SELECT * FROM capacity FULL JOIN removes USING (machine_id)", ["cpus", "memory"]
    )
    churn = f"SELECT machine_id, time // {6 * HOUR} * {6 * HOUR} AS window_start, count(*) AS churn_events FROM task_events WHERE machine_id IS NOT NULL AND event_type IN (2, 3, 5) GROUP BY 1, 2"
    out["machine_churn"] = sql(TRACE, churn)
    out["task_window_features"] = sql(f"{TRACE}, {PROFILES}, {task_windows()}", "SELECT * FROM w", WINDOW_FLOATS)
    out["window_mismatch"] = sql(
        f"{TRACE}, {PROFILES}, {task_windows(DAY, 2 * DAY)}",
        f"SELECT {E}, window_start, window_end, n_samples, fail_time, label_fail_soon FROM w",
    )
    out["task_windows_by_machine"] = sql(
        f"{TRACE}, {PROFILES}, {task_windows(by_machine=True, zero=True)}", "SELECT * FROM w", WINDOW_FLOATS
    )
    w6 = 6 * HOUR
    machines = f"""{TRACE}, {PROFILES}, churn AS ({churn}),
g AS (
  SELECT machine_id, start_time // {w6} * {w6} AS window_start, start_time // {w6} * {w6} + {w6} AS window_end, count(*) AS n_samples,
         count(DISTINCT ({E})) AS n_tasks, sum(cpu_rate) AS cpu_sum, avg(cpu_rate) AS cpu_mean,
         coalesce(stddev_samp(cpu_rate), 0.0) AS cpu_std, max(cpu_rate) AS cpu_max, sum(canonical_memory_usage) AS mem_sum,
         avg(canonical_memory_usage) AS mem_mean, coalesce(stddev_samp(canonical_memory_usage), 0.0) AS mem_std,
         max(canonical_memory_usage) AS mem_max, avg(disk_io_time) AS disk_io_mean
  FROM task_usage GROUP BY machine_id, start_time // {w6} HAVING count(*) >= 2),
m AS (
  SELECT g.*, c.cpus, c.memory, r.remove_time, coalesce(h.churn_events, 0) AS churn_events,
         CASE WHEN c.cpus > 0 THEN cpu_sum / c.cpus ELSE 0.0 END AS cpu_utilization,
         CASE WHEN c.memory > 0 THEN mem_sum / c.memory ELSE 0.0 END AS mem_utilization,
         CASE WHEN r.remove_time > window_end AND r.remove_time <= window_end + {w6} THEN 1 ELSE 0 END AS label_remove_soon
  FROM g LEFT JOIN capacity c USING (machine_id) LEFT JOIN removes r USING (machine_id)
       LEFT JOIN churn h USING (machine_id, window_start))"""
    out["machine_window_features"] = sql(
        machines, "SELECT * FROM m",
        ["cpu_sum", "cpu_mean", "cpu_std", "cpu_max", "mem_sum", "mem_mean", "mem_std", "mem_max", "disk_io_mean",
         "cpus", "memory", "cpu_utilization", "mem_utilization"],
    )
    out["machine_gbt_scores"] = sql(
        f"{machines}, {nearest('m', 'window_end', 0.8, 'cutoff')}",
        "SELECT machine_id, window_start, label_remove_soon, true AS valid FROM m WHERE window_end > (SELECT v FROM cutoff)",
    )
    out["machine_gbt_report"] = sql(
        f"{machines}, {nearest('m', 'window_end', 0.8, 'cutoff')}",
        """SELECT 'machine_trees' AS model, count(*) AS n_test, CAST(sum(label_remove_soon) AS BIGINT) AS n_positive, true AS adds_up,
           true AS ranked FROM m WHERE window_end > (SELECT v FROM cutoff)""",
    )
    for name in ("logreg_scores", "gbt_scores", "sequence_net_scores"):
        out[name] = sql(daily_split(), f"SELECT {E}, window_start, label_fail_soon, true AS valid FROM test")
    out["logreg_coefficients"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS flat" for c in TASK_FEATURES)
    sizes = "count(*) AS n_test, CAST(sum(label_fail_soon) AS BIGINT) AS n_positive"
    out["gbt_report"] = sql(daily_split(), f"SELECT 'boosted_trees' AS model, {sizes}, true AS adds_up, true AS ranked FROM test")
    out["gbt_planted"] = sql(
        daily_split(), "SELECT count(*) AS n_test, count(*) FILTER (cpu_max > 60 AND n_samples > 5) AS n_positive, true AS found FROM test")
    by_span = f"""{TRACE}, first AS (SELECT min(start_time) // {DAY} AS d0 FROM task_usage),
spans AS (SELECT span, d0 + a AS a, d0 + b AS b FROM (VALUES ('first week', 0, 6), ('days 4 to 10', 3, 9), ('all', 0, 100000)) s(span, a, b), first),
u AS (SELECT *, start_time // {DAY} AS day FROM task_usage)"""
    out["quantiles_by_span"] = sql(
        by_span, " UNION ALL ".join(
            f"""SELECT span, '{c}' AS feature, count({c}) AS n, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.99) AS p99
                FROM u JOIN spans ON day BETWEEN a AND b WHERE {c} IS NOT NULL GROUP BY span""" for c in ("cpu_rate", "canonical_memory_usage")),
        ["p50", "p90", "p99"])
    out["distinct_by_span"] = sql(
        by_span, " UNION ALL ".join(
            f"SELECT span, '{what}' AS what, count(DISTINCT {c}) AS n_exact, true AS within FROM u JOIN spans ON day BETWEEN a AND b GROUP BY span"
            for what, c in (("jobs", "job_id"), ("tasks", f"({E})"), ("machines", "machine_id"))))
    shard = f"CASE start_time // {HOUR} % 5 WHEN 0 THEN 0 WHEN 1 THEN 17 WHEN 2 THEN 172 WHEN 3 THEN 173 ELSE 400 END"
    out["ingest_increment"] = sql(
        f"""{TRACE}, raw AS (SELECT *, {shard} AS shard FROM task_usage),
last AS (SELECT * FROM raw WHERE shard <> 172 OR job_id % 2 = 0)""",
        """SELECT 'run 1' AS what, 4::BIGINT AS n_files, count(*) AS n_rows, NULL::BIGINT AS n_jobs FROM raw WHERE shard <> 17
           UNION ALL SELECT 'run 2', 0, 0, NULL
           UNION ALL SELECT 'run 3', 1, count(*), NULL FROM raw WHERE shard = 17
           UNION ALL SELECT 'run 4', 1, count(*), NULL FROM raw WHERE shard = 172 AND job_id % 2 = 0
           UNION ALL SELECT 'task_usage', 3, count(*), count(DISTINCT job_id) FROM last WHERE shard <= 172
           UNION ALL SELECT 'task_usage_snapshots', 2, count(*), count(DISTINCT job_id) FROM last WHERE shard > 172""")
    out["risk_series_fitted"] = sql(
        f"{TRACE}, {PROFILES}, {task_windows(by_machine=True)}",
        """SELECT machine_id, window_start, sum(cpu_mean) AS cpu_sum, count(*) AS n_tasks, max(label_fail_soon) AS any_fail_soon, true AS valid,
           true AS agrees FROM w GROUP BY machine_id, window_start""", ["cpu_sum"])
    out["gbt_drift"] = sql(
        f"""{daily_split()}, span AS (SELECT min(window_end) AS lo, max(window_end) AS hi FROM test),
binned AS (SELECT *, CAST(least(floor((window_end - lo) / ((hi - lo) / 3.0::DOUBLE)), 2) + 1 AS INT) AS bin FROM test, span)""",
        f"""SELECT bin, {sizes}, min(window_end) / 8.64e10 AS first_day, max(window_end) / 8.64e10 AS last_day, true AS adds_up, true AS ranked,
            true AS right_verdict FROM binned GROUP BY bin""", ["first_day", "last_day"])
    out["importances_planted"] = "SELECT unnest(['cpu_max', 'mem_max']) AS feature, true AS matters"
    out["logreg_planted"] = "SELECT 'mem_peak_mean' AS feature, true AS positive"
    out["ablation_planted"] = "SELECT 'memory' AS best, true AS found, true AS near_full"
    out["cv_planted"] = "SELECT 3::BIGINT AS n_trials, true AS found, true AS steady, true AS weak_is_last, true AS best_can_learn"
    out["machine_gbt_planted"] = sql(
        f"{machines}, {nearest('m', 'window_end', 0.8, 'cutoff')}",
        "SELECT count(*) AS n_test, count(*) FILTER (cpu_max > 80 AND n_tasks > 3) AS n_positive, true AS found FROM m WHERE window_end > (SELECT v FROM cutoff)")
    out["sequence_net_report"] = sql(
        daily_split(), f"SELECT 'sequence_net' AS model, {sizes}, true AS adds_up, true AS ranked, true AS tuned FROM test")
    out["sequence_net_planted"] = sql(
        f"{daily_split()}, seq AS (SELECT window_end, lag(cpu_mean) OVER (PARTITION BY {E} ORDER BY window_start) AS before FROM w)",
        "SELECT count(*) AS n_test, count(*) FILTER (before > 60) AS n_positive, true AS found FROM seq WHERE window_end > (SELECT v FROM cutoff)")
    out["gbt_lead_time"] = sql(
        daily_split(),
        f"""SELECT count(DISTINCT ({E})) FILTER (label_fail_soon = 1) AS n_failures, true AS bounded, count(*) AS n_binned,
            CAST(sum(label_fail_soon) AS BIGINT) AS n_positive FROM test""",
    )
    out["model_roundtrip"] = sql(daily_split(), "SELECT count(*) AS n, 0::BIGINT AS n_different, true AS same_facts FROM test")
    out["cv_trials"] = sql(
        daily_split(), "SELECT CAST(t AS INT) AS trial, true AS valid, (SELECT count(*) FROM test) AS n_test FROM range(1, 13) r(t)")
    group_sizes = {"cpu": 5, "memory": 7, "disk": 2, "scheduling": 3, "all features": 17}
    out["ablation"] = sql(
        daily_split(),
        f"""SELECT feature_group, CAST(n_features AS INT) AS n_features, n_test, n_positive, true AS adds_up, true AS ranked,
            true AS best_is_a_group, true AS rated
            FROM (VALUES {', '.join(str(x) for x in group_sizes.items())}) g(feature_group, n_features), (SELECT {sizes} FROM test)""",
    )
    out["forward_label_next"] = sql(
        f"{TRACE}, {PROFILES}, {task_windows(DAY, 2 * DAY)}",
        f"""SELECT {E}, window_start, window_end, next_time, CASE WHEN next_time IS NOT NULL THEN 1 ELSE 0 END AS label_next FROM (
            SELECT w.job_id, w.task_index, window_start, window_end, min(f.time) AS next_time
            FROM w LEFT JOIN (SELECT * FROM task_events WHERE event_type = 3) f
              ON f.job_id = w.job_id AND f.task_index = w.task_index AND f.time > window_end AND f.time <= window_end + {2 * DAY}
            GROUP BY ALL)""",
    )
    for name, test in (("failing_entities", "EXISTS"), ("healthy_entities", "NOT EXISTS")):
        out[name] = sql(
            TRACE,
            f"""SELECT {E}, count(*) AS n FROM task_usage u WHERE {test} (
                SELECT 1 FROM task_events e WHERE e.event_type = 3 AND e.job_id = u.job_id AND e.task_index = u.task_index)
                GROUP BY {E}""",
        )
    out["lag_sequence"] = _sequence(False)
    out["lag_sequence_gap_aware"] = _sequence(True)
    entity_hash = _KEY_HASH.format("job_id, task_index")
    out["entity_subset"] = sql(
        f"""{TRACE}, {PROFILES}, {task_windows()},
e AS (SELECT {E}, max(label_fail_soon) AS any_pos FROM w GROUP BY {E}),
others AS (SELECT {E}, row_number() OVER (ORDER BY {entity_hash}, {E}) AS rn FROM e WHERE any_pos = 0),
keep AS (
  SELECT {E} FROM e WHERE any_pos = 1
  UNION ALL SELECT {E} FROM others WHERE rn <= 10 * (SELECT count(*) FROM e WHERE any_pos = 1))""",
        f"SELECT {E}, window_start, label_fail_soon FROM w JOIN keep USING ({E})",
    )

    out["time_split_stats"] = sql(
        daily_split(),
        " UNION ALL ".join(
            f"""SELECT '{side}' AS side, count(*) AS n_rows, CAST(sum(label_fail_soon) AS BIGINT) AS n_positive,
                min(window_end) AS first_end, max(window_end) AS last_end, (SELECT v FROM cutoff) AS cutoff FROM {side} HAVING count(*) > 0"""
            for side in ("train", "test")
        ),
    )
    out["median_impute"] = sql(
        """l AS (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN l_extendedprice END AS price,
        CASE WHEN l_tax > 0 THEN l_quantity END AS quantity FROM lineitem)""",
        """SELECT l_returnflag, count(*) AS n, avg(coalesce(price, (SELECT median(price) FROM l))) AS price_mean,
           avg(coalesce(quantity, (SELECT median(quantity) FROM l))) AS quantity_mean FROM l GROUP BY 1""",
        ["price_mean", "quantity_mean"],
    )
    out["undersample"] = sql(daily_split(5.0), f"SELECT {E}, window_start, label_fail_soon FROM train")
    out["embargoed_split"] = sql(
        f"{TRACE}, {PROFILES}, {task_windows()}, {nearest('w', 'window_end', 0.8, 'cutoff')}",
        f"""SELECT count(*) AS n_train, max(window_end) AS last_end,
            (SELECT count(*) FROM w WHERE window_end > (SELECT v FROM cutoff)) AS n_test
            FROM w WHERE window_end <= (SELECT v FROM cutoff) - {DAY}""",
    )
    order_hash = _KEY_HASH.format("o_orderkey")
    ranked = f"row_number() OVER (PARTITION BY o_orderstatus ORDER BY {order_hash}, o_orderkey)"
    out["stratified_folds"] = f"SELECT o_orderkey, o_orderstatus, CAST({ranked} % 3 AS INT) AS fold FROM orders"
    out["stratified_holdout"] = (
        f"SELECT o_orderkey, o_orderstatus, {ranked} <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.1::DOUBLE) AS is_validation FROM orders"
    )
    out["random_holdout"] = f"""
SELECT o_orderstatus, is_validation, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (
  SELECT *, CAST(concat('0x', substr({order_hash}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.1::DOUBLE AS is_validation FROM orders)
GROUP BY 1, 2"""
    out["balanced_weights"] = sql(
        """l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
c AS (SELECT label, count(*) AS n, (SELECT count(*) FROM l) / (2.0::DOUBLE * count(*)) AS weight FROM l GROUP BY label)""",
        "SELECT label, n, weight, weight AS weight_max FROM c", ["weight", "weight_max"],
    )

    stat_names = [f"{c}_{s}" for c in ZSCORE_FEATURES for s in ("mu", "sigma")]
    out["zscore_stats"] = sql(f"{daily_split()}, {normal('train')}", "SELECT * FROM normal", stat_names)
    out["zscore_scores"] = sql(
        f"{daily_split()}, {normal('train')}",
        f"SELECT {E}, window_start, label_fail_soon, {ZSCORE} AS score FROM test, normal", ["score"],
    )
    z_train = f"{daily_split()}, {normal('train')}, ztrain AS (SELECT label_fail_soon, {ZSCORE} AS score FROM train, normal)"
    z_sweep = sweep("ztrain", "label_fail_soon", "score", ZSCORE_GRID, strict=True)
    out["zscore_sweep"] = sql(f"{z_train}, {z_sweep}", "SELECT * FROM sweep", ["threshold", *PRF_FLOATS])
    best = "(SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)"
    out["zscore_report"] = sql(
        f"""{z_train}, {z_sweep}, ztest AS (SELECT label_fail_soon, {ZSCORE} AS score FROM test, normal), best AS (SELECT {best} AS t),
{evaluate('ztest', 'label_fail_soon', 'score', '(SELECT t FROM best)', strict=True)}""",
        "SELECT 'zscore_anomaly_baseline' AS model, *, (SELECT t FROM best) AS threshold FROM report",
        [*METRIC_FLOATS, "threshold"],
    )
    out["confusion_metrics"] = sql(
        f"""{DISCOUNT}, c AS (
  SELECT l_linestatus, CAST(count_if(label = 1 AND score >= 0.5) AS BIGINT) AS tp, CAST(count_if(label = 0 AND score >= 0.5) AS BIGINT) AS fp,
         CAST(count_if(label = 1 AND score < 0.5) AS BIGINT) AS fn, CAST(count_if(label = 0 AND score < 0.5) AS BIGINT) AS tn,
         count(*) AS n_test, CAST(count_if(label = 1) AS BIGINT) AS n_positive FROM lines GROUP BY 1)""",
        f"SELECT *, {PRF} FROM c", PRF_FLOATS,
    )
    out["ranking_metrics"] = sql(f"{DISCOUNT}, {evaluate('lines', 'label', 'score', '0.5')}", grouped_metrics, METRIC_FLOATS)
    out["ranking_metrics_by_group"] = sql(
        f"{DISCOUNT}, {evaluate('lines', 'label', 'price', '50000.0', by='l_linestatus')}", grouped_metrics, METRIC_FLOATS
    )
    out["toxic_length_metrics"] = sql(
        f"""scored AS (SELECT toxic, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)),
{evaluate('scored', 'toxic', 'score', '1000.0')}""",
        grouped_metrics, METRIC_FLOATS,
    )
    p_sweep = sweep("lines", "label", "score", PROBABILITY_GRID)
    out["threshold_sweep"] = sql(f"{DISCOUNT}, {p_sweep}", "SELECT * FROM sweep", ["threshold", *PRF_FLOATS])
    out["best_threshold"] = sql(
        f"{DISCOUNT}, {p_sweep}", "SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1", ["threshold", *PRF_FLOATS]
    )

    out["lead_time_alerts"] = sql(f"{scored_windows()}, {_ALERTS}", "SELECT * FROM alerts", ["lead_time_min"])
    out["lead_time_summary"] = sql(
        f"{scored_windows()}, {_ALERTS}",
        """SELECT count(*) AS n_failures, count(lead_time_min) AS n_detected, avg(lead_time_min) AS mean_min,
           min(lead_time_min) AS min_min, max(lead_time_min) AS max_min,
           CASE WHEN count(*) > 0 THEN count(lead_time_min) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS detection_rate,
           quantile_cont(lead_time_min, 0.25) AS p25_min, quantile_cont(lead_time_min, 0.5) AS median_min,
           quantile_cont(lead_time_min, 0.75) AS p75_min FROM alerts""",
        ["mean_min", "min_min", "max_min", "detection_rate", "p25_min", "median_min", "p75_min"],
    )
    out["lead_time_histogram"] = sql(
        f"{scored_windows()}, {_ALERTS}, {_histogram('alerts', 'lead_time_min', 40, 'h')}", "SELECT * FROM h", ["bin_start", "bin_end"]
    )
    drift = f"""{DISCOUNT}, span AS (SELECT min(window_end) AS lo, max(window_end) AS hi FROM lines),
binned AS (SELECT *, CAST(least(floor((window_end - lo) / ((hi - lo) / 3.0::DOUBLE)), 2) + 1 AS INT) AS bin FROM lines, span),
spans AS (SELECT bin, min(window_end) / 8.64e10 AS first_day, max(window_end) / 8.64e10 AS last_day FROM binned GROUP BY bin),
{evaluate('binned', 'label', 'score', '0.5', by='bin')}, bins AS (SELECT * FROM report JOIN spans USING (bin))"""
    out["drift_by_bin"] = sql(drift, "SELECT * FROM bins", [*METRIC_FLOATS, "first_day", "last_day"])
    out["drift_verdict"] = sql(
        f"""{drift}, moved AS (SELECT arg_max(roc_auc, bin) - arg_min(roc_auc, bin) AS roc_auc_drift,
        arg_max(pr_auc, bin) - arg_min(pr_auc, bin) AS pr_auc_drift FROM bins)""",
        """SELECT *, CASE WHEN roc_auc_drift IS NULL THEN NULL WHEN abs(roc_auc_drift) < 0.02 THEN 'holds up over time'
           WHEN roc_auc_drift < 0 THEN 'degrades over time' ELSE 'improves over time' END AS verdict FROM moved""",
        ["roc_auc_drift", "pr_auc_drift"],
    )

    machine_hash = _KEY_HASH.format("machine_id")
    out["sample_machines"] = sql(
        f"""{TRACE}, st AS (SELECT machine_id, bool_or(event_type = 1) AS removed FROM machine_events GROUP BY 1),
r AS (SELECT machine_id FROM st WHERE removed AND machine_id NOT IN (1, 4) ORDER BY {machine_hash}, machine_id LIMIT 3),
h AS (SELECT machine_id FROM st WHERE NOT removed ORDER BY {machine_hash}, machine_id LIMIT 3)""",
        "SELECT CAST(1 AS BIGINT) AS machine_id UNION SELECT CAST(4 AS BIGINT) UNION SELECT * FROM r UNION SELECT * FROM h",
    )
    series_floats = ["cpu_sum", "mem_sum", "max_predicted_risk"]
    out["machine_risk_series"] = sql(risk(), "SELECT * FROM series", series_floats)
    out["event_markers"] = sql(risk(), "SELECT * FROM markers")
    out["machine_summary"] = sql(
        risk(),
        """SELECT s.machine_id, count(*) AS n_windows, max(max_predicted_risk) AS peak_risk,
           (SELECT count(*) FROM markers m WHERE m.machine_id = s.machine_id AND event = 'task_fail') AS n_task_fail,
           CASE WHEN EXISTS (SELECT 1 FROM markers m WHERE m.machine_id = s.machine_id AND event = 'machine_remove')
                THEN 'removed' ELSE 'healthy' END AS status
           FROM series s GROUP BY s.machine_id""",
        ["peak_risk"],
    )
    out["asof_state"] = sql(
        f"""{risk()}, now AS (SELECT min(window_start) + {10 * DAY + HOUR} AS t FROM series),
latest AS (
  SELECT machine_id, window_start, cpu_sum, mem_sum, n_tasks, max_predicted_risk FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY window_start DESC) AS rn FROM series, now WHERE window_start <= t)
  WHERE rn = 1),
e AS (SELECT machine_id, CAST(count_if(time <= t) AS BIGINT) AS n_events, min((time - t) / 6e7) AS minutes_to_first_event FROM markers, now GROUP BY 1)""",
        """SELECT l.*, coalesce(n_events, 0) AS n_events, minutes_to_first_event, max_predicted_risk >= 0.5 AS alert
           FROM latest l LEFT JOIN e USING (machine_id)""",
        [*series_floats, "minutes_to_first_event"],
    )
    out["replay"] = sql(
        f"""{risk()},
spans AS (SELECT machine_id, min(window_start) AS t0, max(window_start) - min(window_start) AS span FROM series GROUP BY 1),
grid AS (SELECT machine_id, i AS position, t0 + (span * i) // 200 AS replay_time FROM spans, range(201) g(i)),
st AS (
  SELECT g.machine_id, position, replay_time, max(s.window_start) AS window_start FROM grid g
  JOIN series s ON s.machine_id = g.machine_id AND s.window_start <= g.replay_time GROUP BY ALL),
e AS (
  SELECT g.machine_id, position, CAST(count_if(m.time <= g.replay_time) AS BIGINT) AS n_events, min(m.time) AS first_event
  FROM grid g JOIN markers m ON m.machine_id = g.machine_id GROUP BY ALL)""",
        """SELECT st.machine_id, st.position, st.replay_time, st.window_start, s.cpu_sum, s.mem_sum, s.n_tasks, s.max_predicted_risk,
           s.max_predicted_risk >= 0.5 AS alert, coalesce(e.n_events, 0) AS n_events, (e.first_event - st.replay_time) / 6e7 AS minutes_to_first_event
           FROM st JOIN series s ON s.machine_id = st.machine_id AND s.window_start = st.window_start
           LEFT JOIN e ON e.machine_id = st.machine_id AND e.position = st.position""",
        [*series_floats, "minutes_to_first_event"],
    )
    out["replay_intervals"] = out["replay"]
    out["state_intervals"] = sql(
        f"""{risk()}, moments AS (SELECT machine_id, window_start AS time FROM series UNION SELECT machine_id, time FROM markers),
ends AS (SELECT *, lead(time) OVER (PARTITION BY machine_id ORDER BY time) AS to_time FROM moments),
held AS (SELECT e.*, (SELECT max(window_start) FROM series s WHERE s.machine_id = e.machine_id AND s.window_start <= e.time) AS window_start FROM ends e)""",
        """SELECT h.machine_id, h.time AS from_time, h.to_time, h.window_start, s.max_predicted_risk, s.max_predicted_risk >= 0.5 AS alert,
           (SELECT count(*) FROM markers m WHERE m.machine_id = h.machine_id AND m.time <= h.time) AS n_events,
           (SELECT min(m.time) FROM markers m WHERE m.machine_id = h.machine_id) AS first_event
           FROM held h JOIN series s ON s.machine_id = h.machine_id AND s.window_start = h.window_start""", ["max_predicted_risk"])
    order_rows = ", ".join(f"({i + 1}, '{m}', '{label}')" for i, (m, label) in enumerate(MODEL_LABELS.items()))
    out["model_comparison"] = sql(
        f"""{DISCOUNT}, {evaluate('lines', 'label', 'score', '0.7::DOUBLE', name='a')}, {evaluate('lines', 'label', 'price', '50000.0', name='b')},
reg AS (SELECT 'logreg_baseline' AS model, *, 0.7::DOUBLE AS threshold FROM a
        UNION ALL SELECT 'zscore_anomaly_baseline', *, 50000.0::DOUBLE FROM b)""",
        f"""SELECT o.position, o.model, o.label, r."precision", r.recall, r.f1, r.roc_auc, r.pr_auc, r.threshold, r.model IS NULL AS missing
            FROM (VALUES {order_rows}) o(position, model, label) LEFT JOIN reg r ON r.model = o.model""",
        [*METRIC_FLOATS, "threshold"],
    )

    out["stream_window_features"] = sql(f"{TRACE}, {_CLOSED}", "SELECT * FROM closed", WINDOW_FLOATS[:9])
    out["stream_alerts"] = sql(
        f"{TRACE}, {_CLOSED}, r AS (SELECT *, 1.0 / (1.0 + exp(-((cpu_max - cpu_mean) / 10.0 - 2.0))) AS score FROM closed)",
        f"SELECT {E}, window_start, window_end, score FROM r WHERE score >= 0.5", ["score"],
    )
    out["stream_first_alerts"] = sql(
        TRACE, f"SELECT {E}, min(end_time) AS first_alert_time FROM task_usage WHERE cpu_rate >= 100 GROUP BY {E}"
    )
    for name in ("merged_windows", "stream_late_windows"):
        out[name] = out["stream_window_features"]
    out["stream_model_alerts"] = sql(f"{TRACE}, {_CLOSED}", "SELECT count(*) AS n_windows, 0::BIGINT AS n_different, true AS some FROM closed")
    for name, horizon in (("stream_labels", DAY), ("stream_labels_long", 2 * DAY)):
        out[name] = sql(
            f"{TRACE}, {_CLOSED}",
            f"""SELECT c.job_id, c.task_index, c.window_start, c.window_end, min(f.time) AS fail_time
                FROM closed c LEFT JOIN (SELECT * FROM task_events WHERE event_type = 3) f
                  ON f.job_id = c.job_id AND f.task_index = c.task_index AND f.time > c.window_end AND f.time <= c.window_end + {horizon}
                GROUP BY ALL""",
        )
    return out
