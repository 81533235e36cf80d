"""Recursive state per key: observation bias, state bias, adaptive factors, AR(1) perturbations.

Each recursion is a chain of maps that can be joined before they are applied (affine ones, and products that are clipped), so a
batch of rows is folded by doubling over whole arrays, however its rows are spread over keys. The batch form streams sorted
partitions; the streaming form, in event time, is in events.py. The state can be read back and saved as a table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counters of time since the last observations stop at a year.
MOST_SECONDS = 365 * 86400

Arrays = dict[str, np.ndarray]


def _longest(starts: np.ndarray, n: int) -> int:
    return int(np.diff(np.append(starts, n)).max()) if n else 0


def affine_scan(a: np.ndarray, b: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """x[i] = a[i] x[i - 1] + b[i] within each run of rows that begins at one of `starts`, from `before` of that run."""
    a, b = a.astype(float), b.astype(float)
    b[starts] += np.where(a[starts] != 0, a[starts] * before, 0.0)
    a[starts] = 0.0
    step, most = 1, _longest(starts, len(a))
    while step < most:
        b[step:] = b[step:] + a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return b


def clipped_scan(m: np.ndarray, low: float, high: float, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """x[i] = x[i - 1] m[i], clipped to low..high, within each run; m is positive."""
    m, lo, hi = m.astype(float), np.full(len(m), low), np.full(len(m), high)
    first = np.clip(before * m[starts], low, high)
    m[starts], lo[starts], hi[starts] = 0.0, first, first
    step, most = 1, _longest(starts, len(m))
    while step < most:
        new_lo = np.clip(lo[:-step] * m[step:], lo[step:], hi[step:])
        new_hi = np.clip(hi[:-step] * m[step:], lo[step:], hi[step:])
        m[step:] = m[step:] * m[:-step]
        lo[step:], hi[step:] = new_lo, new_hi
        step *= 2
    return lo


def _shifted(x: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What stood before each row: the row before it, or `before` at the begin of a run."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = before
    return out


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n) - 1


def _known(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    for c in columns:
        out &= ~pd.isna(c)
    return out


class Fold:
    """A recursion over a key's rows. `start` is the state before the first; rows that lack a value change nothing."""

    start: dict[str, float | list[float]]

    def run(self, rows: dict[str, np.ndarray], starts: np.ndarray, before: Arrays) -> tuple[Arrays, Arrays]:
        """Results of the rows, and the state after each run of rows; runs begin at `starts`, each with its state `before`."""
        raise NotImplementedError

    def states(self, n: int) -> Arrays:
        return {k: np.repeat(np.atleast_2d(np.asarray(v, float)), n, 0) if isinstance(v, list) else np.full(n, float(v)) for k, v in self.start.items()}

    def load(self, text: str) -> dict[str, np.ndarray]:
        return {k: np.asarray(np.nan if v is None else v, float) for k, v in json.loads(text).items()}

    @staticmethod
    def dump(state: dict[str, np.ndarray]) -> str:
        plain = {k: np.asarray(v).tolist() for k, v in state.items()}
        return json.dumps({k: None if v != v else v for k, v in plain.items()})

    def __call__(self, state: dict | None, row: dict) -> tuple[dict, dict]:
        """One row of one key."""
        before = self.states(1)
        for k, v in (state or {}).items():
            before[k][0] = v
        rows = {}
        for c, v in row.items():
            rows[c] = np.empty(1, object) if isinstance(v, (list, tuple)) else np.array([np.nan if v is None else v])
            rows[c][0] = v
        out, after = self.run(rows, np.zeros(1, np.int64), before)
        return {k: v[0] for k, v in after.items()}, {k: v[0] for k, v in out.items()}


@dataclass
class obs_bias(Fold):  # noqa: N801
    """Rows: t (seconds), obs, pred, assim. Bias relaxes with the time since the last observation; assimilation waits until the
    time since the one before is below the cutoff. A row without obs or pred has no corrected obs and isn't assimilated."""

    dt: int
    relax: float
    cutoff: int

    start = {"bias": 0.0, "last": np.nan, "gap": float(MOST_SECONDS)}

    def run(self, rows, starts, before):
        obs, pred = rows["obs"].astype(float), rows["pred"].astype(float)
        known = _known(obs, pred, rows["t"])
        n = len(obs)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        at = np.flatnonzero(known)
        t, of = rows["t"][at].astype(float), run[at]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(at) else np.zeros(0, np.int64)
        last = _shifted(t, first, before["last"][of[first]])
        since = np.where(np.isnan(last), MOST_SECONDS, np.minimum(np.maximum(t - np.nan_to_num(last), self.dt), MOST_SECONDS))
        gap = _shifted(since, first, before["gap"][of[first]])
        keep, b, soon = np.ones(n), np.zeros(n), np.zeros(n, bool)
        keep[at] = np.exp(-since / self.relax)
        b[at] = (1 - keep[at]) * (obs[at] - pred[at])
        soon[at] = np.minimum(since + gap, MOST_SECONDS) < self.cutoff
        bias = affine_scan(keep, b, starts, before["bias"])
        after = {"bias": bias[_ends(starts, n)], "last": before["last"].copy(), "gap": before["gap"].copy()}
        tail = np.append(first[1:], len(at)) - 1 if len(at) else first
        after["last"][of[tail]], after["gap"][of[tail]] = t[tail], since[tail]
        return {"obs": np.where(known, obs - bias, np.nan), "bias": bias, "assim": (rows["assim"] == True) & soon}, after  # noqa: E712


@dataclass
class state_bias(Fold):  # noqa: N801
    """Rows: x, increment, and c (array of n harmonics). The flux of the bias is taken off, the bias relaxes and follows increments.
    A row without one of them has no results."""

    dt: float
    relax: float
    rate: float
    n: int

    def __post_init__(self):
        self.start = {"b": [0.0] * self.n}

    def run(self, rows, starts, before):
        x, incr = rows["x"].astype(float), rows["increment"].astype(float)
        known = _known(x, incr) & np.array([c is not None for c in rows["c"]])
        c = np.zeros((len(x), self.n))
        if known.any():
            c[known] = np.stack([np.asarray(v, float)[: self.n] for v in rows["c"][known]])
        keep, drive = np.where(known, 1 - self.dt / self.relax, 1.0), np.where(known, self.rate * np.nan_to_num(incr) / self.dt, 0.0)
        b = np.column_stack([affine_scan(keep, -drive * c[:, k], starts, before["b"][:, k]) for k in range(self.n)])
        held = np.column_stack([_shifted(b[:, k], starts, before["b"][:, k]) for k in range(self.n)])
        flux = np.where(known, (held * c).sum(1), np.nan)
        return {"x": x - flux * self.dt, "flux": flux}, {"b": b[_ends(starts, len(x))]}


@dataclass
class adaptive_factors(Fold):  # noqa: N801
    """Rows: obs, fcst, ana, fcstvar, obsvar. Moving averages drive factors of background and observation variances."""

    w_p: float
    w_r: float
    delta: float = 0.01
    low: float = 0.2
    high: float = 5.0
    beta: float = 1.0
    only_p: bool = False

    start = {"ab": 0.0, "hph": 0.0, "oa": 0.0, "r": 0.0, "p_factor": 1.0, "r_factor": 1.0}

    def run(self, rows, starts, before):
        obs, fcst, ana, fcstvar, obsvar = (rows[c].astype(float) for c in ("obs", "fcst", "ana", "fcstvar", "obsvar"))
        known = _known(obs, fcst, ana, fcstvar, obsvar)
        ends = _ends(starts, len(obs))
        omf, after = obs - fcst, dict(before)

        def follow(top: str, bottom: str, factor: str, a: np.ndarray, b: np.ndarray, w: float, by: float) -> np.ndarray:
            keep = np.where(known, 1 - w, 1.0)
            high, low = (affine_scan(keep, np.where(known, w * v, 0.0), starts, before[k]) for k, v in ((top, a), (bottom, b)))
            moves = known & (low > 0)
            ratio = np.ones(len(low))
            np.divide(by * high, low, out=ratio, where=moves)
            ratio = np.where(moves, np.clip(ratio, 1 / (1 + self.delta), 1 + self.delta), 1.0)
            out = clipped_scan(ratio, self.low, self.high, starts, before[factor])
            after[top], after[bottom], after[factor] = high[ends], low[ends], out[ends]
            return out

        p = follow("ab", "hph", "p_factor", (ana - fcst) * omf, fcstvar, self.w_p, self.beta)
        if self.only_p:
            r = np.repeat(before["r_factor"], np.diff(np.append(starts, len(obs))))
        else:
            r = follow("oa", "r", "r_factor", (obs - ana) * omf, obsvar, self.w_r, 1.0)
        return {"p_factor": p, "r_factor": r}, after


@dataclass
class ar1_series(Fold):
    """Rows: eps. x = c x + sqrt(1 - c^2) eps, from x = eps; a row without eps has no x and changes nothing."""

    c: float

    start = {"x": np.nan}

    def run(self, rows, starts, before):
        eps = rows["eps"].astype(float)
        known = _known(eps)
        n = len(eps)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        seen = np.cumsum(known) - known
        fresh = known & (seen == seen[starts][run]) & np.isnan(before["x"])[run]
        keep = np.where(known, np.where(fresh, 0.0, self.c), 1.0)
        b = np.where(known, np.where(fresh, 1.0, math.sqrt(1 - self.c * self.c)) * np.nan_to_num(eps), 0.0)
        x = affine_scan(keep, b, starts, np.nan_to_num(before["x"]))
        ends = _ends(starts, n)
        any_known = np.add.reduceat(known, starts) > 0
        return {"x": np.where(known, x, np.nan)}, {"x": np.where(any_known, x[ends], before["x"])}


def _in_order(df: DataFrame, keys: list[str], order: list[str], start: DataFrame | None = None) -> DataFrame:
    """Rows dealt by key and sorted, so that a task streams its keys one after the other and a key of any size fits."""
    if start is not None:
        df = df.join(start.select(*keys, F.col("state").alias("__state")), keys, "left")
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _key(frame: pd.DataFrame, at: int, keys: list[str]) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (frame[k].iloc[at] for k in keys))


def _runs(fold: Fold, frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, Arrays, Arrays, bool]]:
    """Each batch with the begins of its runs, results, states after the runs, and whether its first run goes on from the last."""
    held = None
    for frame in frames:
        if frame.empty:
            continue
        new = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k]
            new |= (v.ne(v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()
        new[0] = True
        starts = np.flatnonzero(new)
        before = fold.states(len(starts))
        if "__state" in frame.columns:
            for i, saved in enumerate(frame["__state"].iloc[starts]):
                if isinstance(saved, str):
                    for name, value in fold.load(saved).items():
                        before[name][i] = value
        goes_on = held is not None and held[0] == _key(frame, 0, keys)
        if goes_on:
            for name, value in held[1].items():
                before[name][0] = value
        out, after = fold.run({c: frame[c].to_numpy() for c in frame.columns}, starts, before)
        held = _key(frame, -1, keys), {name: value[-1] for name, value in after.items()}
        yield frame, starts, out, after, goes_on


def fold(df: DataFrame, keys: list[str], order: list[str], step: Fold, schema: str, keep: list[str], start: DataFrame | None = None) -> DataFrame:
    """The batch form: each key's rows in order. schema: of keys, kept columns and results.

    start: (keys, state as JSON), to go on from a saved state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _, out, _, _ in _runs(step, frames, keys):
            yield pd.DataFrame({**{c: frame[c].to_numpy() for c in (*keys, *keep)}, **out})

    return _in_order(df, keys, order, start).mapInPandas(run, schema)


def last_state(df: DataFrame, keys: list[str], order: list[str], step: Fold, keys_schema: str) -> DataFrame:
    """(keys, state as JSON) after all rows: what a restart reads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame, starts, _, after, goes_on in _runs(step, frames, keys):
            made = [(*_key(frame, int(a), keys), step.dump({k: v[i] for k, v in after.items()})) for i, a in enumerate(starts)]
            done = ([held] if held is not None and not goes_on else []) + made[:-1]
            held = made[-1]
            yield pd.DataFrame(done, columns=[*keys, "state"])
        if held is not None:
            yield pd.DataFrame([held], columns=[*keys, "state"])

    return _in_order(df, keys, order).mapInPandas(run, f"{keys_schema}, state string")


def ar1(df: DataFrame, keys: list[str], dt: float, tau: float) -> DataFrame:
    """x = c x + sqrt(1 - c^2) eps along time, c = exp(-dt / tau), from x = eps; white noise where tau is 0."""
    if tau == 0:
        return df.withColumn("x", F.col("eps"))
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, "time")), "x double"])
    return fold(df.select(*keys, "time", "eps"), keys, ["time"], ar1_series(math.exp(-dt / tau)), schema, ["time"])


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A sink's snapshot: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
