"""Aggregates over the last rows of a key at a cost per row that does not grow with the number of rows.

Spark works a fixed frame out again for every row. Here a task reads its keys in order and keeps, from batch to batch, only
the rows that a frame can still reach: means and deviations are differences of running sums in extended precision,
maxima join the two halves of blocks as long as the frame, and quantiles are read from a sorted run of the frame.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a frame that is sorted as a whole for a quantile, at most; frames that are sorted at once.
SHORT, FRAMES_AT_ONCE = 64, 4096
#: Rows of a key that wait for the rest of it, about, before they are worked out apart.
WAITING = 100_000


@dataclass(frozen=True)
class Rolling:
    """A column over the last ``rows`` rows: mean, deviation (sample), maximum or quantile (``at``); NULL below ``least`` values (all)."""

    name: str
    column: str
    kind: str
    rows: int
    least: int | None = None
    at: float = 0.5


def _counts(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of values in each frame, first place of each frame, place behind it)."""
    behind = np.arange(1, len(values) + 1)
    first = np.maximum(behind - n, 0)
    known = np.concatenate(([0], np.cumsum(~np.isnan(values))))
    return known[behind] - known[first], first, behind


def _sums(values: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, dtype=np.longdouble), np.cumsum(values, dtype=np.longdouble)))
    return sums[behind] - sums[first]


def means(values: np.ndarray, n: int, least: int) -> np.ndarray:
    count, first, behind = _counts(values, n)
    known = values[~np.isnan(values)]
    base = known[0] if len(known) else 0.0
    total = _sums(np.where(np.isnan(values), 0.0, values - base), first, behind)
    return np.where(count >= max(least, 1), (total / np.maximum(count, 1) + base).astype(float), np.nan)


def deviations(values: np.ndarray, n: int, least: int) -> np.ndarray:
    """Sample standard deviations; the values are centred on their middle first, so that squares do not swamp differences."""
    count, first, behind = _counts(values, n)
    known = values[~np.isnan(values)]
    centred = np.where(np.isnan(values), 0.0, values - (known.mean() if len(known) else 0.0)).astype(np.longdouble)
    total, squares = _sums(centred, first, behind), _sums(centred * centred, first, behind)
    spread = np.maximum(squares - total * total / np.maximum(count, 1), 0.0) / np.maximum(count - 1, 1)
    return np.where(count >= max(least, 2), np.sqrt(spread).astype(float), np.nan)


def maxima(values: np.ndarray, n: int, least: int) -> np.ndarray:
    count, first, behind = _counts(values, n)
    blocks = np.full(-(-len(values) // n) * n, -np.inf)
    blocks[: len(values)] = np.where(np.isnan(values), -np.inf, values)
    blocks = blocks.reshape(-1, n)
    so_far = np.maximum.accumulate(blocks, axis=1).ravel()
    to_come = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.where(count >= max(least, 1), np.where(behind < n, so_far[behind - 1], np.maximum(to_come[first], so_far[behind - 1])), np.nan)


def short_quantiles(values: np.ndarray, n: int, least: int, at: float) -> np.ndarray:
    """``quantiles`` of short frames, which are sorted ``FRAMES_AT_ONCE`` at a time; missing values stand last."""
    padded = np.concatenate((np.full(n - 1, np.nan), values))
    frames, out = np.lib.stride_tricks.sliding_window_view(padded, n), np.empty(len(values))
    for a in range(0, len(values), FRAMES_AT_ONCE):
        runs = np.sort(frames[a : a + FRAMES_AT_ONCE], axis=1)
        count = n - np.count_nonzero(np.isnan(runs), axis=1)
        place = at * np.maximum(count - 1, 0)
        low = place.astype(np.int64)
        row = np.arange(len(runs))
        below, above = runs[row, low], runs[row, np.minimum(low + 1, n - 1)]
        with np.errstate(invalid="ignore"):
            between = below * (low + 1 - place) + above * (place - low)
        out[a : a + FRAMES_AT_ONCE] = np.where(count < max(least, 1), np.nan, np.where(place == low, below, between))
    return out


def quantiles(values: np.ndarray, n: int, least: int, at: float) -> np.ndarray:
    """Interpolated quantiles; a value enters and leaves the sorted run of its frame once. Short frames are sorted as a whole."""
    if n <= SHORT:
        return short_quantiles(values, n, least, at)
    run: list[float] = []
    items, out = values.tolist(), [np.nan] * len(values)
    for i, x in enumerate(items):
        if i >= n and items[i - n] == items[i - n]:
            del run[bisect_left(run, items[i - n])]
        if x == x:
            insort(run, x)
        if len(run) >= max(least, 1):
            place = at * (len(run) - 1)
            low = int(place)
            out[i] = run[low] if place == low else run[low] * (low + 1 - place) + run[low + 1] * (place - low)
    return np.array(out)


def aggregated(spec: Rolling, values: np.ndarray) -> np.ndarray:
    least = spec.rows if spec.least is None else spec.least
    if spec.kind == "quantile":
        return quantiles(values, spec.rows, least, spec.at)
    return {"mean": means, "deviation": deviations, "maximum": maxima}[spec.kind](values, spec.rows, least)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where a key begins, unless it has more than ``WAITING`` rows: sums start where they are cut, and equal keys must stay equal to the last bit."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if parts:
            yield from parts if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()

    for batch in batches:
        starts = np.flatnonzero(batch.column("__rolling_place").to_numpy() == 1)
        cut = starts[-1] if len(starts) else 0
        if len(starts):
            yield from joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        if sum(h.num_rows for h in held) > WAITING:
            yield from joined(held)
            held = []
    yield from joined(held)


def rolling(df: DataFrame, specs: Sequence[Rolling], by: str = "ticker", order: str = "date", lag: int = 0, lagged: str | None = None, keep: Sequence[str] | None = None, current: bool = True, only: Column | None = None) -> DataFrame:
    """df with a column per spec and, if ``lagged`` is given, one named with this prefix that is ``lag`` rows of the key older.

    The rows of a key are numbered by a window, which also deals and sorts them; the numbers tell where a key begins. So
    a frame that is already dealt by the key is not dealt again. With ``keep`` only these columns of df are handed on, and
    without ``current`` only the older ones are worked out into columns: every column costs its way through the kernel.
    With ``only`` frames see all rows, but no more than the rows for which it is true come out.
    """
    names = [c for c in df.columns if keep is None or c in keep]
    inputs = list(dict.fromkeys(s.column for s in specs))
    numbered = df.withColumn("__rolling_place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    narrowed = only is not None
    chosen = [] if only is None else [F.coalesce(only, F.lit(False)).alias("__rolling_only")]
    numbered = numbered.select(*names, *chosen, "__rolling_place", *[F.col(c).cast("double").alias(f"__rolling_{i}") for i, c in enumerate(inputs)])
    kept = max(s.rows for s in specs) - 1 + lag
    new = ([s.name for s in specs] if current else []) + ([f"{lagged}{s.name}" for s in specs] if lagged is not None else [])
    schema = StructType([StructField(f.name, f.dataType, True) for f in df.select(*names).schema.fields] + [StructField(n, DoubleType()) for n in new])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.zeros(0)] * len(inputs)
        for batch in whole_keys(batches):
            values = [batch.column(f"__rolling_{i}").to_numpy(zero_copy_only=False) for i in range(len(inputs))]
            starts = np.flatnonzero(batch.column("__rolling_place").to_numpy() == 1).tolist()
            bounds = [*([] if starts[:1] == [0] else [0]), *starts, batch.num_rows]
            parts: list[list[np.ndarray]] = [[] for _ in new]
            for a, b in zip(bounds, bounds[1:]):
                if a in starts[:1] or a:
                    carried = [np.zeros(0)] * len(inputs)
                whole = [np.concatenate((c, v[a:b])) for c, v in zip(carried, values)]
                for k, s in enumerate(specs):
                    out = aggregated(s, whole[inputs.index(s.column)])
                    if current:
                        parts[k].append(out[len(out) - (b - a) :])
                    if lagged is not None:
                        older = np.concatenate((np.full(lag, np.nan), out))[: len(out)]
                        parts[len(specs) * current + k].append(older[len(out) - (b - a) :])
                carried = [w[max(0, len(w) - kept) :] for w in whole]
            found = [np.concatenate(p) for p in parts]
            columns = [batch.column(n) for n in names]
            if narrowed:
                wanted = batch.column("__rolling_only")
                columns = [c.filter(wanted) for c in columns]
                found = [x[wanted.to_numpy(zero_copy_only=False)] for x in found]
            columns += [pa.array(x, mask=np.isnan(x)) for x in found]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return numbered.mapInArrow(work, schema)
