"""Column expressions used by several operators. All of them stay inside codegen."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_ratio(num, den, otherwise=None) -> Column:
    """``num / den`` where ``den > 0``, else ``otherwise``."""
    return F.when(_col(den) > 0, _col(num) / _col(den)).otherwise(F.lit(otherwise).cast("double"))


def or_zero(c) -> Column:
    return F.coalesce(_col(c), F.lit(0.0))


def clip(c, low: float, high: float) -> Column:
    """Clamp to [low, high]. ``least``/``greatest`` skip NULL, so NULL is kept by hand."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def code_name(code, names: Mapping[int, str]) -> Column:
    """Name of an event code, NULL for an unknown one."""
    pairs = [F.lit(x) for code_, name in names.items() for x in (code_, name)]
    return F.try_element_at(F.create_map(*pairs), _col(code).cast("int"))


def float_grid(start: float, step: float, n: int) -> list[float]:
    """``start + i*step`` in doubles, so grid points carry the usual binary noise."""
    return [start + i * step for i in range(n)]


def hash_order(keys: Iterable[str], seed: int) -> Column:
    """Pseudo-random order key of a row: depends on its keys only, never on its partition."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def max_abs_zscore(normal: Mapping[str, tuple[float, float]]) -> Column:
    """Largest ``|x - mean| / std`` over the columns of ``normal`` (column -> (mean, std))."""
    scores = [F.abs((F.col(c) - F.lit(mu)) / F.lit(sigma)) for c, (mu, sigma) in normal.items()]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))
