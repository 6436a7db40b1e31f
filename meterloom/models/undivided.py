"""The undivided change-point model of many meters at once, for fits without splits, smoothing and residual weights.

The grid and its refinement are those of `daily._search`. With days in order of temperature, an arm's
moments at any breakpoint follow from running sums up to it, so a breakpoint costs no pass over the
days, and all meters of a batch take each step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Days of the meters that are fitted together, if they are several, and cells of one matrix of meters by days.
DAYS, CELLS = 200_000, 200_000


def _count(t: np.ndarray, x: np.ndarray, equal: bool) -> np.ndarray:
    """How many of each row's ascending values are below (or at) each of the row's x, by bisection."""
    width = t.shape[1]
    flat, base = t.ravel(), np.arange(len(t))[:, None] * width
    found = np.zeros(x.shape, dtype=np.int64)
    step = 1 << (width.bit_length() - 1)
    while step:
        ahead = found + step
        value = flat[base + np.minimum(ahead, width) - 1]
        found = np.where((ahead <= width) & ((value <= x) if equal else (value < x)), ahead, found)
        step >>= 1
    return found


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of each row's first 0, 1, 2 ... values."""
    out = np.zeros((x.shape[0], x.shape[1] + 1))
    np.cumsum(x, axis=1, out=out[:, 1:])
    return out


class _Moments:
    """Sum, sum of squares and product with use of an arm, of each meter at each of its breakpoints."""

    def __init__(self, t: np.ndarray, y: np.ndarray, away: np.ndarray, cooling: bool):
        # away: distance from the arm's end of the range, so that sums of few days near it stay exact.
        self.t, self.cooling, self.base = t, cooling, np.arange(len(t))[:, None] * (t.shape[1] + 1)
        sums = [_running(x[:, ::-1])[:, ::-1] if cooling else _running(x) for x in (away, away * away, y, away * y)]
        self.sums = [np.ascontiguousarray(x).ravel() for x in sums]

    def at(self, x: np.ndarray, reach: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """reach: distance of breakpoints x from the arm's end."""
        k = _count(self.t, x, self.cooling)
        d, dd, sy, dy = (s[self.base + k] for s in self.sums)
        k = n - k if self.cooling else k
        return k * reach - d, (k * reach - 2 * d) * reach + dd, reach * sy - dy


def fit_many(t: np.ndarray, y: np.ndarray, n: np.ndarray, s) -> dict[str, np.ndarray]:
    """Coefficients of `daily.Fit` for each row: a meter's first n temperatures and uses, n at least 1; what follows them isn't read."""
    m, width = t.shape
    valid = np.arange(width) < n[:, None]
    t = np.where(valid, t, np.inf)
    order = np.argsort(t, axis=1)
    t, y = np.take_along_axis(t, order, 1), np.take_along_axis(y, order, 1)
    each = np.arange(m)
    mean = np.where(valid, y, 0.0).sum(1) / n
    t_min, t_max = t[:, 0], t[each, n - 1]
    low, high = t[each, np.minimum(s.segment_minimum - 1, n - 1)], t[each, np.maximum(n - s.segment_minimum, 0)]
    out = {c: np.zeros(m) for c in ("hdd_bp", "hdd_beta", "cdd_bp", "cdd_beta")} | {"intercept": mean.copy(), "t_min": t_min, "t_max": t_max}
    some = np.flatnonzero((n >= 2 * s.segment_minimum) & (high > low))
    if len(some):
        found = _search_many(t[some], y[some], n[some], valid[some], mean[some], low[some], high[some], s)
        for c, x in found.items():
            out[c][some] = x
    return out


def _search_many(t, y, n, valid, mean, low, high, s) -> dict[str, np.ndarray]:
    each, n1, n2 = np.arange(len(t)), n[:, None], n[:, None, None]
    t_min, t_max = t[:, 0], t[each, n - 1]
    y = np.where(valid, y - mean[:, None], 0.0)
    up, down = np.where(valid, t - t_min[:, None], 0.0), np.where(valid, t_max[:, None] - t, 0.0)
    heat, cool = _Moments(t, y, up, False), _Moments(t, y, down, True)
    syy = (y * y).sum(1)[:, None, None]
    off = np.where(valid, up - (up.sum(1) / n)[:, None], 0.0)
    span = np.maximum(t_max - t_min, 1e-9)
    spread = (np.sqrt((off * off).sum(1) / n) / np.maximum(np.sqrt(syy[:, 0, 0] / n), 1e-9))[:, None, None]

    def costs(hb: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cost, heating slope, cooling slope, intercept) of each pair of a meter's breakpoints, as in `daily._search`."""
        sh, shh, shy = (x[:, :, None] for x in heat.at(hb, hb - t_min[:, None], n1))
        sc, scc, scy = (x[:, None, :] for x in cool.at(cb, t_max[:, None] - cb, n1))
        # The arms don't overlap where hb <= cb, and other pairs don't count.
        shh, scc, shc = shh - sh * sh / n2, scc - sc * sc / n2, -sh * sc / n2
        has_h, has_c = shh > 1e-9 * n2, scc > 1e-9 * n2
        with np.errstate(divide="ignore", invalid="ignore"):
            det = shh * scc - shc * shc
            bh, bc = (shy * scc - scy * shc) / det, (scy * shh - shy * shc) / det
            both = has_h & has_c & (det > 1e-10 * shh * scc) & (bh >= 0) & (bc >= 0)
            one_h, one_c = np.where(has_h & (shy > 0), shy / shh, 0.0), np.where(has_c & (scy > 0), scy / scc, 0.0)
        first = one_h * shy >= one_c * scy
        hs = np.where(both, bh, np.where(first, one_h, 0.0))
        cs = np.where(both, bc, np.where(first, 0.0, one_c))
        sse = np.maximum(syy - hs * shy - cs * scy, 0.0)
        root = np.sqrt(sse / n2)
        near = [(np.minimum(x - t_min[:, None], t_max[:, None] - x) / span[:, None]) for x in (hb, cb)]
        shrink = (hs + cs) * spread + np.where(hs > 0, root * near[0][:, :, None], 0.0) + np.where(cs > 0, root * near[1][:, None, :], 0.0)
        return sse / n2 + s.penalty * shrink, hs, cs, mean[:, None, None] - hs * sh / n2 - cs * sc / n2

    def least(hb: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = np.where(hb[:, :, None] <= cb[:, None, :], costs(hb, cb)[0], np.inf).reshape(len(t), -1)
        at = value.argmin(1)
        return value[each, at], hb[each, at // cb.shape[1]], cb[each, at % cb.shape[1]]

    grid = np.linspace(low, high, 13, axis=1)
    best, hb, cb = least(grid, grid)
    step = (high - low) / 12
    for _ in range(6):
        step = step / 2
        around = [np.clip(np.stack([x - step, x, x + step], 1), low[:, None], high[:, None]) for x in (hb, cb)]
        value, h2, c2 = least(*around)
        better = value < best - 1e-12
        best, hb, cb = np.where(better, value, best), np.where(better, h2, hb), np.where(better, c2, cb)
    _, hs, cs, b0 = (x[:, 0, 0] for x in costs(hb[:, None], cb[:, None]))
    hb = np.where(hs == 0, cb, hb)
    cb = np.where(cs == 0, hb, cb)
    return {"hdd_bp": hb, "hdd_beta": hs, "cdd_bp": cb, "cdd_beta": cs, "intercept": b0}


def response_of(t: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
    """scalar.response without smoothing, each day with its own coefficients; NaN is above all numbers, as in Spark."""
    hb, hs, cb, cs, b0 = (f[c] for c in ("hdd_bp", "hdd_beta", "cdd_bp", "cdd_beta", "intercept"))
    same = hb == cb
    heat = (t < hb) | (same & (cb >= f["t_max"]))
    cool = ~heat & ((t > cb) | np.isnan(t) | (same & (hb <= f["t_min"])))
    flat = (hs == 0) & (cs == 0)
    with np.errstate(invalid="ignore"):
        return np.where(flat, b0, np.where(heat, -hs * (t - hb) + b0, np.where(cool, cs * (t - cb) + b0, b0)))


class Weather:
    """Temperatures by day, from rows of (days since 1970, temperature)."""

    def __init__(self, rows: list):
        rows = [x for x in rows if x[0] is not None]
        day = np.array([x[0] for x in rows], dtype=np.int64)
        if len(np.unique(day)) < len(day):
            raise ValueError("weather has more than one row for a day")
        self.start = int(day.min()) if len(day) else 0
        self.value = np.full(int(day.max()) - self.start + 2 if len(day) else 1, np.nan)
        self.there = np.zeros(len(self.value), dtype=bool)
        self.value[day - self.start] = [np.nan if x[1] is None else x[1] for x in rows]
        self.there[day - self.start] = [x[1] is not None for x in rows]

    def at(self, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(temperatures, whether there are any)."""
        i = day - self.start
        i = np.where((i < 0) | (i >= len(self.value)), len(self.value) - 1, i)  # the last place is empty
        return self.value[i], self.there[i]


def _sums(x: np.ndarray, there: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Sums of runs of rows, null where all are."""
    none = np.add.reduceat(there.astype(np.int64), starts) == 0
    return pa.array(np.add.reduceat(np.where(there, x, 0.0), starts), mask=none)


def _fits(t: np.ndarray, y: np.ndarray, n: np.ndarray, s, least: int = 3) -> dict[str, np.ndarray]:
    """Coefficients of meters whose n days follow each other in t and y; those with fewer than `least` days have NaN."""
    start = np.cumsum(n) - n
    out = {c: np.full(len(n), np.nan) for c in ("hdd_bp", "hdd_beta", "cdd_bp", "cdd_beta", "intercept", "t_min", "t_max")}
    order = np.argsort(-n, kind="stable")
    order = order[: int((n >= least).sum())]
    at = 0
    while at < len(order):
        width = int(n[order[at]])
        # Meters of similar length stand in one matrix, so that at most half of it is empty.
        alike = int(np.searchsorted(-n[order[at:]], -width / 2, side="right"))
        ids = order[at : at + max(1, min(alike, CELLS // width))]
        cells = np.minimum(start[ids][:, None] + np.arange(width), len(t) - 1)
        for c, x in fit_many(t[cells], y[cells], n[ids], s).items():
            out[c][ids] = x
        at += len(ids)
    return out


def _months(key: pa.Array, first: np.ndarray, last: np.ndarray, value: pa.Array, weather: Weather, months: int, s) -> list[pa.Array]:
    """(key, month, observed, predicted) of whole meters whose runs of days stand together."""
    runs = pc.run_end_encode(key)
    ends = runs.run_ends.to_numpy().astype(np.int64)
    starts, held = np.append(0, ends[:-1]), last - first + 1
    meter = np.repeat(np.arange(len(ends)), np.add.reduceat(held, starts))
    day = np.arange(len(meter)) + np.repeat(first - (np.cumsum(held) - held), held)
    t, has_t = weather.at(day)
    y = np.repeat(pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False), held)
    has_y = np.repeat(value.is_valid().to_numpy(zero_copy_only=False), held)
    good = has_t & has_y & np.isfinite(t) & np.isfinite(y)
    n = np.bincount(meter[good], minlength=len(ends))
    fits = _fits(t[good], y[good], n, s)
    fitted = (n >= 3) & runs.values.is_valid().to_numpy(zero_copy_only=False)
    predicted = response_of(t, {c: x[meter] for c, x in fits.items()})
    month = day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    start = np.minimum.reduceat(month, np.flatnonzero(np.diff(meter, prepend=-1)))
    group = (month - start[meter]) // months
    if ((np.diff(group) < 0) & (np.diff(meter) == 0)).any():
        order = np.lexsort((group, meter))
        meter, group, y, has_y, predicted, has_t = (x[order] for x in (meter, group, y, has_y, predicted, has_t))
    at = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(meter) != 0)))
    of = meter[at]
    when = (start[of] + group[at] * months).astype("datetime64[M]").astype("datetime64[D]")
    return [runs.values.take(pa.array(of)), pa.array(when), _sums(y, has_y, at), _sums(predicted, has_t & fitted[meter], at)]


def months_of_meters(batches: Iterator[pa.RecordBatch], weather: Weather, months: int, s) -> Iterator[pa.RecordBatch]:
    """Batches of (key, first, last, value), runs of days with one use, a meter's together, to sums by meter and months."""
    kept = []

    def fitted(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """The whole meters of rows, some at a time; the last meter stays in `kept` where more of it may follow."""
        key, a, b, value = (rows.column(i).combine_chunks() for i in range(4))
        a, b = (x.view(pa.int32()).to_numpy().astype(np.int64) for x in (a, b))
        ends = pc.run_end_encode(key).run_ends.to_numpy().astype(np.int64)
        total, at = np.cumsum(b - a + 1)[ends - 1], 0
        until = len(ends) if last else len(ends) - 1
        while at < until:
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + DAYS, side="right"))
            to = min(max(to, at + 1), until)
            low, size = int(ends[at - 1]) if at else 0, int(ends[to - 1] - (ends[at - 1] if at else 0))
            part = slice(low, low + size)
            yield pa.record_batch(_months(key.slice(low, size), a[part], b[part], value.slice(low, size), weather, months, s), names=[rows.column_names[0], "month", "observed", "predicted"])
            at = to
        kept[:] = [] if last else rows.slice(int(ends[until - 1]) if until else 0).to_batches()

    for batch in batches:
        if batch.num_rows:
            yield from fitted(pa.Table.from_batches([*kept, batch]), False)
    if kept:
        yield from fitted(pa.Table.from_batches(kept), True)
