"""Running totals and exact quantiles over a global order, with totals in a tree.

Rows are first collapsed per (keys, order value), so one hot value is one row however
often it occurs. The collapsed rows are stored in order, range by range, and numbered;
every BUCKET_ROWS of them are a bucket, every FANOUT buckets a block, every FANOUT
blocks a block of blocks and so on. A total is known for each node of that tree, and
what lies before a node is what lies before its block and before it inside the block.
So no window ever gets more than FANOUT or BUCKET_ROWS rows, and the driver learns two
numbers: how many ranges there are and how long the longest is.
"""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presage.session import staged

# Collapsed rows of a bucket, and nodes of a block.
BUCKET_ROWS = 8192
FANOUT = 1024
# Sketches of one column are made in at most so many groups of rows.
_SKETCH_GROUPS = 512
_GROUP_ROWS = 50_000
_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def _join_kind(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + inside
    return (F.least if kind == "min" else F.greatest)(before, inside)


def in_buckets(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` stored in ``order`` with ``__bucket``, the number of their bucket, and how many numbers there are.

    A range of the order is a partition, which numbers its rows as it writes them.
    """
    numbered = staged(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    parts, longest = numbered.agg(F.max(part), F.max(place)).first()
    buckets = (longest or 0) // BUCKET_ROWS + 1  # of a partition, at most
    bucket = part * buckets + F.floor(place / BUCKET_ROWS).cast("long")
    return numbered.withColumn("__bucket", bucket).drop("__id"), ((parts or 0) + 1) * buckets


def before_each(totals: DataFrame, n_keys: int, nodes: int, kinds: Mapping[str, str], descending: bool = False) -> DataFrame:
    """(__start, __before_x, x_total): what lies before each node of a key, and the whole key.

    ``totals`` has ``__at`` (struct of keys k0.. and node number b below ``nodes``) and a column
    for each name in ``kinds``. Keys and node are one struct, in which NULLs are equal.
    """
    keys = [F.col(f"__at.k{i}") for i in range(n_keys)]
    up = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.floor(F.col("__at.b") / FANOUT).cast("long").alias("b"))
    block = Window.partitionBy(up)
    place = F.col("__at.b")
    earlier = block.orderBy(place.desc() if descending else place.asc()).rowsBetween(Window.unboundedPreceding, -1)
    fold = {name: _FOLD[kind](name) for name, kind in kinds.items()}
    inside = [fold[name].over(earlier).alias(f"__before_{name}") for name in kinds]
    if nodes <= FANOUT:
        return totals.select(F.col("__at").alias("__start"), *inside, *[fold[name].over(block).alias(f"{name}_total") for name in kinds])
    blocks = staged(totals.groupBy(up.alias("__at")).agg(*[f.alias(name) for name, f in fold.items()]), "totals")
    above = before_each(blocks, n_keys, math.ceil(nodes / FANOUT), kinds, descending).select(
        F.col("__start").alias("__up"), *[F.col(f"__before_{n}").alias(f"__above_{n}") for n in kinds], *[f"{n}_total" for n in kinds])
    return totals.select(F.col("__at").alias("__start"), up.alias("__block"), *inside).join(above, F.col("__block") == F.col("__up")).select(
        "__start", *[F.coalesce(_join_kind(kind, F.col(f"__above_{n}"), F.col(f"__before_{n}")), F.col(f"__above_{n}")).alias(f"__before_{n}")
                     for n, kind in kinds.items()],
        *[f"{n}_total" for n in kinds])


def running(
    df: DataFrame,
    order: str,
    aggs: Mapping[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """One row per (keys, order value) with running aggregates in that order.

    ``aggs`` maps a name to ``(kind, column)``, kind being sum, min or max. Rows
    without an order value are left out. For each name the result has ``name``
    (this order value alone), ``name_run`` (up to and including it) and
    ``name_total`` (the whole key).

    The join with the starting points and the window use the same exchange of the
    stored rows.
    """
    keys = list(keys)
    collapsed = df.where(F.col(order).isNotNull()).groupBy(*keys, order).agg(
        *[_FOLD[kind](col).alias(name) for name, (kind, col) in aggs.items()]
    )
    rows, nodes = in_buckets(collapsed, [*keys, order])
    rows = rows.withColumn("__at", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("b")))
    totals = rows.groupBy("__at").agg(*[_FOLD[kind](name).alias(name) for name, (kind, _) in aggs.items()])
    starts = before_each(totals, len(keys), nodes, {name: kind for name, (kind, _) in aggs.items()}, descending)
    place = F.col(order)
    inside = Window.partitionBy("__at").orderBy(place.desc() if descending else place.asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.join(starts, F.col("__at") == F.col("__start")).select(
        *keys, order,
        *[c for name, (kind, _) in aggs.items() for c in (
            F.col(name),
            _join_kind(kind, F.col(f"__before_{name}"), _FOLD[kind](name).over(inside)).alias(f"{name}_run"),
            F.col(f"{name}_total"),
        )],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    keys: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles of ``value`` per key (one row when there are no keys).

    ``linear`` interpolates between neighbours; ``nearest`` takes the value at
    rank ``round((n - 1) * q)``. NULLs are left out; of an empty input the
    quantiles are NULL.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown quantile method {method!r}")
    counts = running(
        df.where(F.col(value).isNotNull()).select(*keys, value), value, {"n": ("sum", F.lit(1))}, keys
    )
    first, last, total = F.col("n_run") - F.col("n"), F.col("n_run") - 1, F.col("n_total")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value)))

    found, out = [], []
    for name, q in quantiles.items():
        position = (total - 1) * F.lit(float(q))
        if method == "nearest":
            found.append(at(F.round(position)).alias(name))
            out.append(F.col(name))
            continue
        found += [
            at(F.floor(position)).alias(f"__lo_{name}"),
            at(F.ceil(position)).alias(f"__hi_{name}"),
            F.max(position - F.floor(position)).alias(f"__part_{name}"),
        ]
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (high - low) * F.col(f"__part_{name}")).alias(name))
    return counts.groupBy(*keys).agg(*found).select(*keys, *out)


# Rank errors for which a sketch brackets a quantile, the narrow one first.
_BRACKET_ERRORS = (0.002, 0.02, 0.2)


def _double(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """(feature, one column per quantile): exact quantiles of whole columns.

    Rows are dealt round robin into groups, so that a group looks like the whole
    however the input is sorted. Sketches of the groups bracket each quantile at
    several widths; a second pass counts what lies below and inside each bracket,
    and the values inside the narrowest one that holds the rank are shuffled to
    find it. The last bracket is the whole axis, so every rank has one.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown quantile method {method!r}")
    spark = df.sparkSession
    names = list(quantiles)
    values = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns])
    schema = "feature string, quantile string, low long, high long, part double, lo double, hi double"
    sides = [side * e for e in _BRACKET_ERRORS for side in (-1, 1)]
    edges = ", ".join(_double(min(max(q + side, 0.0), 1.0)) for q in quantiles.values() for side in sides)
    accuracy = int(2 / _BRACKET_ERRORS[0])
    rows = values.count()
    groups = min(_SKETCH_GROUPS, max(1, rows // _GROUP_ROWS))
    dealt = values.withColumn("__group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    per_group = dealt.groupBy("__group").agg(*[
        F.expr(f"percentile_approx(`{c}`, array({edges}), {accuracy})").alias(f"q{i}") for i, c in enumerate(columns)
    ])
    # The overall quantile lies between the smallest and the largest of the groups' own.
    sketched = per_group.agg(*[
        F.expr(f"{'min' if k % 2 == 0 else 'max'}(q{i}[{len(sides) * j + k}])")
        for i in range(len(columns)) for j in range(len(names)) for k in range(len(sides))
    ]).first()
    found = iter(sketched)
    brackets = {}
    for c in columns:
        for name in names:
            ends = [next(found) for _ in sides]
            if ends[0] is not None:
                brackets[c, name] = [*zip(ends[::2], ends[1::2]), (float("-inf"), float("inf"))]
    if not brackets:
        return spark.createDataFrame([], "feature string, " + ", ".join(f"`{n}` double" for n in names))
    counted = iter(values.agg(*[
        F.expr(part) for (c, _), ladder in brackets.items() for part in (
            f"count(`{c}`)", *(x for lo, hi in ladder for x in (
                f"count_if(`{c}` < {_double(lo)})", f"count_if(`{c}` BETWEEN {_double(lo)} AND {_double(hi)})")),
        )
    ]).first())
    targets = []
    for (c, name), ladder in brackets.items():
        position = (next(counted) - 1) * quantiles[name]
        if method == "nearest":
            low = high = math.floor(position + 0.5)
        else:
            low, high = math.floor(position), math.ceil(position)
        sized = [(lo, hi, next(counted), next(counted)) for lo, hi in ladder]
        lo, hi, below, _ = next(x for x in sized if x[2] <= low and high < x[2] + x[3])
        targets.append((c, name, low - below, high - below, position - low if low < high else 0.0, lo, hi))
    cells = ", ".join(
        f"IF(`{c}` BETWEEN {_double(lo)} AND {_double(hi)}, "
        f"named_struct('feature', '{c}', 'quantile', '{name}', 'value', `{c}`), NULL)"
        for c, name, _, _, _, lo, hi in targets
    )
    near = values.selectExpr(f"inline(array_compact(array({cells})))")
    ranked = running(near, "value", {"n": ("sum", F.lit(1))}, ["feature", "quantile"]).join(
        spark.createDataFrame(targets, schema), ["feature", "quantile"]
    )
    ends = ranked.groupBy("feature", "quantile", "part").agg(
        F.expr("max(value) FILTER (WHERE low BETWEEN n_run - n AND n_run - 1)").alias("at_low"),
        F.expr("max(value) FILTER (WHERE high BETWEEN n_run - n AND n_run - 1)").alias("at_high"),
    )
    return ends.groupBy("feature").agg(*[
        F.expr(f"max(at_low + (at_high - at_low) * part) FILTER (WHERE quantile = '{name}')").alias(name)
        for name in names
    ])
