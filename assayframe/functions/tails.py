"""The exact lower tail of a sum of k values drawn without replacement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: cells of the counting table up to which the exact tail is used.
EXACT_CELLS = 5_000_000


def lower_tail(rest: np.ndarray, k: int, observed: int) -> float:
    """P(S <= observed), by counting k-subsets by their sum.

    Counts are doubles: sums of non-negative terms keep their relative accuracy,
    and below 2^53 they are exact.  By symmetry the smaller of the two groups is
    counted.
    """
    rest = np.asarray(rest, np.int64)
    n = len(rest)
    values = rest - rest.min()
    goal = int(observed - k * rest.min())
    reach = int(np.sort(values)[::-1][:k].sum())
    if goal < 0:
        return 0.0
    if goal >= reach:
        return 1.0
    total = int(values.sum())
    pick, low = (k, True) if k <= n - k else (n - k, False)
    width = int(np.sort(values)[::-1][:pick].sum()) + 1
    ways = np.zeros((pick + 1, width))
    ways[0, 0] = 1.0
    for seen, v in enumerate(values):
        top = min(pick, seen + 1)
        # right-hand side first: row j takes from row j - 1 as it was
        ways[1 : top + 1, v:] += ways[:top, : width - v].copy()
    last = ways[pick]
    # the k chosen sum to at most `goal` exactly if the others sum to at least total - goal
    chosen = last[: goal + 1] if low else last[max(0, total - goal) :]
    return float(chosen.sum() / last.sum())


@F.pandas_udf(DoubleType())
def exact_tail(rest: pd.Series, k: pd.Series, observed: pd.Series) -> pd.Series:
    """``lower_tail`` of each row; items that agree in all three are counted once a batch."""
    known: dict[tuple, float] = {}
    out = []
    for r, a, b in zip(rest, k, observed):
        key = (np.sort(np.asarray(r, np.int64)).tobytes(), int(a), int(b))
        if key not in known:
            known[key] = lower_tail(r, int(a), int(b))
        out.append(known[key])
    return pd.Series(out, dtype=float)
