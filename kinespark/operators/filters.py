"""Butterworth filters of trials of any length, forward and back, exact over blocks.

A cascade of second-order sections is a linear recursion with a small state, so a block of rows acts on the state it starts
from as a matrix power and a constant. Blocks are first run from rest for their constants; these are carried over a trial's
blocks (a row a block), and the blocks are run again from their true states. Backward runs do the same from the other end. Trials
of up to BLOCK rows need no carrying: they go by as a sorted stream, those of a like length side by side.

Inside a block the recursion runs by chunks: products of NumPy matrices over all channels, with a short loop over chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.groups import streamed_together
from kinespark.functions.steps import written

#: Rows of a block, and of a chunk inside it.
BLOCK, CHUNK = 1 << 16, 64


def butterworth(order: int, low: float | None, high: float | None, fs: float) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a1 a2) of a Butterworth filter: low-pass at high, high-pass at low, band-pass with both.

    The band-pass takes the prototype's poles through the band transform and so has 2 * order poles. Frequencies are
    prewarped, poles go to the z plane by the bilinear transform, and the gain is 1 in the middle of the pass band.
    """
    if order < 1 or (low is None and high is None) or any(f is not None and not 0 < f < fs / 2 for f in (low, high)) or (low is not None and high is not None and low >= high):
        raise ValueError("edges must lie in order between 0 and half the sampling rate")
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low is None:
        s, n_zero, probe = poles * warp(high), 0, 0.0
    elif high is None:
        s, n_zero, probe = warp(low) / poles, order, fs / 2
    else:
        half, middle = poles * (warp(high) - warp(low)) / 2, warp(low) * warp(high)
        root = np.sqrt(half**2 - middle + 0j)
        s, n_zero = np.r_[half + root, half - root], order
        probe = fs / np.pi * np.arctan(np.sqrt(middle) / (2 * fs))
    z = (2 * fs + s) / (2 * fs - s)
    # zeros: n_zero at 1, the rest at -1; sections pair conjugate poles, real ones are paired among themselves
    pairs = [(p, p.conjugate()) for p in z[z.imag > 1e-12]]
    real = sorted(z[np.abs(z.imag) <= 1e-12].real)
    pairs += [(a, b) for a, b in zip(real[::2], real[1::2], strict=False)] + ([(real[-1], None)] if len(real) % 2 else [])
    zeros = [1.0] * n_zero + [-1.0] * (len(z) - n_zero)
    made = []
    for a, b in sorted(pairs, key=lambda p: abs(p[0])):
        if b is None:
            c = zeros.pop()
            made.append(np.array([1.0, -c, 0.0, -float(np.real(a)), 0.0]))
        else:
            # one zero from either end: a section of a band-pass stops both sides
            c, d = zeros.pop(0), zeros.pop()
            made.append(np.array([1.0, -(c + d), c * d, -float(np.real(a + b)), float(np.real(a * b))]))
    made[0][:3] /= np.abs(response(made, probe, fs))
    return made


def response(sections: Sequence[np.ndarray], f: float | np.ndarray, fs: float) -> np.ndarray:
    """The filter's complex response at frequencies f, in one direction."""
    z = np.exp(-2j * np.pi * np.asarray(f) / fs)
    out = np.ones_like(z)
    for b0, b1, b2, a1, a2 in sections:
        out = out * (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return out


class Cascade:
    """The sections as one recursion: state, step and output as matrices, run over (rows, channels) by chunks."""

    def __init__(self, sections: Sequence[np.ndarray]):
        self.sections = [np.asarray(s, float) for s in sections]
        n = 2 * len(self.sections)
        # the step of a unit of each state, and of a unit of input
        unit = [self._step(np.eye(n)[k], 0.0) for k in range(n)] + [self._step(np.zeros(n), 1.0)]
        self.step, self.enter = np.stack([u[0] for u in unit[:n]], 1), unit[n][0]
        self.out, self.through = np.array([u[1] for u in unit[:n]]), unit[n][1]

    def _step(self, state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        after = np.empty_like(state)
        for k, (b0, b1, b2, a1, a2) in enumerate(self.sections):
            y = b0 * x + state[2 * k]
            after[2 * k : 2 * k + 2] = b1 * x - a1 * y + state[2 * k + 1], b2 * x - a2 * y
            x = y
        return after, x

    @property
    def pad(self) -> int:
        """Rows by which a trial is extended at each end; a section of one pole counts as one."""
        poles = sum(2 if s[4] or s[2] else 1 for s in self.sections)
        return 3 * (poles + 1)

    @cached_property
    def steady(self) -> np.ndarray:
        """The state that a constant input of 1 leaves."""
        return np.linalg.solve(np.eye(len(self.step)) - self.step, self.enter)

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.step, n)

    @cached_property
    def _chunk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: outputs from the state, outputs from the inputs, the end state from the inputs."""
        reach, powers = np.empty((CHUNK, len(self.step))), [np.eye(len(self.step))]
        for k in range(CHUNK):
            reach[k] = self.out @ powers[k]
            powers.append(self.step @ powers[k])
        pulse = np.r_[self.through, reach[:-1] @ self.enter]
        inputs = np.zeros((CHUNK, CHUNK))
        for k in range(CHUNK):
            inputs[k:, k] = pulse[: CHUNK - k]
        return reach, inputs, np.stack([powers[CHUNK - 1 - k] @ self.enter for k in range(CHUNK)], 1)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of (rows, channels) from a state (states, channels), and the state at the end."""
        reach, inputs, gather = self._chunk
        n, channels = x.shape
        whole = n // CHUNK
        y = np.empty_like(x)
        if whole:
            parts = x[: whole * CHUNK].reshape(whole, CHUNK, channels)
            gathered, leap = gather @ parts, self.power(CHUNK)
            starts = np.empty((whole, *state.shape))
            for k in range(whole):
                starts[k] = state
                state = leap @ state + gathered[k]
            y[: whole * CHUNK] = (inputs @ parts + reach @ starts).reshape(-1, channels)
        if rest := n - whole * CHUNK:
            last = x[whole * CHUNK :]
            y[whole * CHUNK :] = inputs[:rest, :rest] @ last + reach[:rest] @ state
            state = self.power(rest) @ state + gather[:, CHUNK - rest :] @ last
        return y, state

    def both_ways(self, x: np.ndarray) -> np.ndarray:
        """Zero phase: forward and back over (rows, channels), the ends extended by odd reflection; short trials stay as they are."""
        pad = self.pad
        if len(x) <= pad:
            return x.copy()
        y = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
        for _ in range(2):
            y = self.run(y, np.outer(self.steady, y[0]))[0][::-1]
        return y[pad : len(y) - pad]

    def both_ways_together(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """both_ways() of several trials, which lie one after the other in (rows, channels): those of a like length go side by side."""
        pad, out, sizes = self.pad, x.copy(), np.diff(bounds)
        step = 2 * CHUNK
        for width in np.unique(sizes[sizes > pad] // step):
            some = np.flatnonzero((sizes > pad) & (sizes // step == width))
            n, first = sizes[some], bounds[some]
            most = int(n.max())
            # rows before the first and after the last are mirrored there; what a shorter trial has beyond that is not read again
            at = np.arange(-pad, most + pad)[:, None]
            inner = np.clip(np.where(at < 0, -at, np.where(at >= n, 2 * (n - 1) - at, at)), 0, n - 1)
            wide = x[first + inner]
            wide = np.where((at < 0)[..., None], 2 * x[first] - wide, np.where((at >= n)[..., None], 2 * x[first + n - 1] - wide, wide))
            turn = np.clip(n + 2 * pad - 1 - np.arange(most + 2 * pad)[:, None], 0, None)
            y, side = wide.reshape(len(wide), -1), np.arange(len(some))
            for _ in range(2):
                y = self.run(y, np.outer(self.steady, y[0]))[0].reshape(wide.shape)
                y = y[turn, side].reshape(len(wide), -1)
            y = y.reshape(wide.shape)
            here = np.repeat(side, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(first, n) + place] = y[pad + place, here]
        return out


def zero_phase(df: DataFrame, keys: Sequence[str], idx: str, values: Sequence[str], sections: Sequence[np.ndarray], into: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(keys, idx, values, into): values filtered forward and back along idx (dense from 0 in each trial).

    Trials of more than block rows are cut, and states are carried over the cuts. Values must be finite.
    """
    names, values, into = list(keys), list(values), list(into)
    cascade = Cascade(sections)
    if block <= cascade.pad:
        raise ValueError("a block must be longer than the filter's padding")
    x = df.select(*names, F.col(idx).cast("long").alias("idx"), *(F.col(v).cast("double").alias(v) for v in values))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)

    unknown = [f"_null{k}" for k in range(len(values))]

    def together(rows: Mapping[str, np.ndarray], bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        made = cascade.both_ways_together(np.stack([rows[v] for v in values], 1), bounds)
        return {"idx": rows["_at"]} | {c: rows[c] for c in [*values, *unknown]} | dict(zip(into, made.T, strict=True)), np.diff(bounds)

    def filtered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumnRenamed("idx", "_at").withColumns({u: F.col(v).isNull() for u, v in zip(unknown, values, strict=True)})
        made = streamed_together(rows, names, ["_at"], together, "idx long, " + ", ".join([*(f"{c} double" for c in [*values, *into]), *(f"{u} boolean" for u in unknown)]))
        return made.select(*names, "idx", *(F.when(~F.col(u), F.col(v)).alias(v) for u, v in zip(unknown, values, strict=True)), *into)

    long = written(x.filter(F.col("idx") >= block).select(*names).distinct(), "long-trials")
    if long.isEmpty():
        return filtered(x)
    short = filtered(x.join(long, names, "left_anti"))
    return short.unionByName(scanned(x.join(long, names), names, values, cascade, into, kinds, block))


def scanned(x: DataFrame, names: list[str], values: list[str], cascade: Cascade, into: list[str], kinds: str, block: int) -> DataFrame:
    """zero_phase() of trials of several blocks."""
    pad, states, channels = cascade.pad, len(cascade.step), len(values)
    blocks = written(x.withColumn("block", F.floor(F.col("idx") / block)), "filter-blocks")
    summary = f"{kinds}, block long, n long, head array<double>, tail array<double>, state array<double>"
    carried = f"{kinds}, block long, state array<double>"

    def matrix(group: pa.Table, columns: Sequence[str]) -> np.ndarray:
        return np.stack([group.column(c).to_numpy() for c in columns], 1)

    def of(group: pa.Table, n: int) -> list[pa.Array]:
        return [pa.array([group.column(k)[0].as_py()] * n, group.column(k).type) for k in names]

    def lists(rows: Sequence[np.ndarray]) -> pa.Array:
        return pa.array([r.ravel().tolist() for r in rows], pa.list_(pa.float64()))

    def summed(group: pa.Table, columns: Sequence[str], back: bool) -> pa.Table:
        """A block's first and last rows and the state it leaves from rest, in the direction of the run."""
        u = matrix(group.sort_by("idx"), columns)
        state = cascade.run(u[::-1] if back else u, np.zeros((states, channels)))[1]
        return pa.table([*of(group, 1), pa.array([group.column("block")[0].as_py()]), pa.array([len(u)]), lists([u[: pad + 1]]), lists([u[-pad - 1 :]]), lists([state])], names=[*names, "block", "n", "head", "tail", "state"])

    def ends(group: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
        group = group.sort_by("block")
        at = lambda c: [np.reshape(v, (-1, channels)) for v in group.column(c).to_pylist()]
        tail = np.concatenate(at("tail")[-2:])[-pad - 1 :]  # the last block may be shorter than the padding
        return group, [np.reshape(v, (states, channels)) for v in group.column("state").to_pylist()], at("head")[0], tail

    def carry(group: pa.Table, left: list[np.ndarray], n: list[int], state: np.ndarray, back: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """The true state before each block, and after the last in the direction of the run."""
        starts: list[np.ndarray] = [state] * len(n)
        for k in reversed(range(len(n))) if back else range(len(n)):
            starts[k] = state
            state = cascade.power(n[k]) @ state + left[k]
        return starts, state

    def forward(group: pa.Table) -> pa.Table:
        group, left, head, _ = ends(group)
        before = 2 * head[:1] - head[pad:0:-1]
        state = cascade.run(before, np.outer(cascade.steady, before[0]))[1]
        starts, _ = carry(group, left, group.column("n").to_pylist(), state, False)
        return pa.table([*of(group, len(starts)), group.column("block"), lists(starts)], names=[*names, "block", "state"])

    def settle(rows: pa.Table, state: pa.Table, columns: Sequence[str], back: bool, made: Sequence[str]) -> pa.Table:
        rows = rows.sort_by("idx")
        u = matrix(rows, columns)
        y = cascade.run(u[::-1] if back else u, np.reshape(state.column("state")[0].as_py(), (states, channels)))[0]
        keep = [c for c in rows.column_names if c not in made and c not in columns] if back else rows.column_names
        return pa.table([*(rows.column(c) for c in keep), *(pa.array(c) for c in (y[::-1] if back else y).T)], names=[*keep, *made])

    by = [*names, "block"]
    ran = [f"_ran{k}" for k in range(channels)]
    starts = blocks.groupBy(*by).applyInArrow(lambda g: summed(g, values, False), summary).groupBy(*names).applyInArrow(forward, carried)
    starts = written(starts, "filter-states")
    once = blocks.groupBy(*by).cogroup(starts.groupBy(*by)).applyInArrow(lambda a, b: settle(a, b, values, False, ran), f"{kinds}, idx long, " + ", ".join(f"{v} double" for v in values) + ", block long, " + ", ".join(f"{c} double" for c in ran))
    once = written(once, "filter-forward")

    def backward(raw: pa.Table, after: pa.Table) -> pa.Table:
        """States before the blocks from behind: the forward run goes on into the extension, and from there the way back begins."""
        raw, _, _, tail = ends(raw)
        after = after.sort_by("block")
        left = [np.reshape(v, (states, channels)) for v in after.column("state").to_pylist()]
        n = after.column("n").to_pylist()
        # the forward state behind the last block: from the states of the forward run
        state = cascade.power(n[-1]) @ np.reshape(after.column("start")[-1].as_py(), (states, channels)) + np.reshape(raw.column("state")[-1].as_py(), (states, channels))
        beyond = cascade.run(2 * tail[-1:] - tail[-2::-1], state)[0][::-1]
        state = cascade.run(beyond, np.outer(cascade.steady, beyond[0]))[1]
        starts, _ = carry(after, left, n, state, True)
        return pa.table([*of(after, len(starts)), after.column("block"), lists(starts)], names=[*names, "block", "state"])

    raw = blocks.groupBy(*by).applyInArrow(lambda g: summed(g, values, False), summary)
    after = once.groupBy(*by).applyInArrow(lambda g: summed(g, ran, True), summary).join(starts.withColumnRenamed("state", "start"), by)
    behind = written(raw.groupBy(*names).cogroup(after.groupBy(*names)).applyInArrow(backward, carried), "filter-states")
    done = once.groupBy(*by).cogroup(behind.groupBy(*by)).applyInArrow(lambda a, b: settle(a, b, ran, True, into), f"{kinds}, idx long, " + ", ".join(f"{v} double" for v in values) + ", block long, " + ", ".join(f"{c} double" for c in into))
    return done.drop("block")
