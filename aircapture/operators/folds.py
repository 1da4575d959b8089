"""Worker-side code of the sequential folds.

Shipped to the workers by value (see ``skew``), so it imports nothing of this
package, and states are stored as plain tuples.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Fold = Callable[[object, dict[str, np.ndarray]], tuple[object, dict[str, np.ndarray]]]


def arrow_folder(columns: list[str], key: str, inputs: list[str], added: pa.Schema, fold: Fold, carry: bool):
    """Arrow worker: rows arrive sorted by key; only the open state stays in memory."""

    def column(batch: pa.RecordBatch, name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))

    def output(arrays: list[pa.Array], states: list[bytes | None]) -> pa.RecordBatch:
        names = [*columns, *added.names]
        if carry:
            return pa.RecordBatch.from_arrays([*arrays, pa.array(states, pa.binary())], names=[*names, "_state"])
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def state_row(schema: pa.Schema, of_key: str, state: object) -> pa.RecordBatch:
        passed = [pa.array([of_key]) if c == key else pa.nulls(1, schema.field(c).type) for c in columns]
        return output([*passed, *[pa.nulls(1, f.type) for f in added]], [pickle.dumps(state.pack() if hasattr(state, "pack") else state)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, schema = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = batch.schema
            key_of = column(batch, key).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, key_of[1:] != key_of[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(key_of)]):
                part = batch.slice(lo, hi - lo)
                if key_of[lo] != current:
                    if carry and current is not None:
                        yield state_row(schema, current, state)
                    current, state = key_of[lo], None
                if carry:
                    stored = column(part, "_state")
                    known = len(stored) - stored.null_count
                    if known:
                        state = pickle.loads(stored[0].as_py())
                        part = part.slice(known)
                if part.num_rows == 0:
                    continue
                state, new = fold(state, {c: column(part, c).to_numpy(zero_copy_only=False) for c in inputs})
                computed = [pa.array(new[f.name], f.type, from_pandas=True) for f in added]
                yield output([*[column(part, c) for c in columns], *computed], [None] * part.num_rows)
        if carry and current is not None:
            yield state_row(schema, current, state)

    return run


def anchor_fold(window_us: int):
    """Within one chain: a reception later than the window after the open message opens the next one."""

    def fold(state, arrays):
        anchor, anchor_id = state if state is not None else (None, None)
        times, ids = arrays["_us"], arrays["_id"]
        out = np.empty(len(times), dtype=object)
        at = 0
        while at < len(times):
            if anchor is None or times[at] > anchor + window_us:
                anchor, anchor_id = int(times[at]), ids[at]
            end = int(np.searchsorted(times, anchor + window_us, side="right"))
            out[at:end] = anchor_id
            at = end
        return (anchor, anchor_id), {"message_id": out}

    return fold


class FewFlows:
    """Open flows of one device in creation order, as lists ``[ms, counter, longest pace, number, start]``."""

    LIMIT = 64

    def __init__(self, created: int = 0, rows=()):
        self.created, self.rows = created, [list(r) for r in rows]

    def pack(self) -> tuple:
        return self.created, self.rows

    def fitting(self):
        """This, or the same flows as arrays when there are many."""
        return self if len(self.rows) <= self.LIMIT else ManyFlows(self.created, self.rows)

    def retire(self, before_ms: int) -> None:
        """Forget flows silent for so long that nothing can join them any more."""
        self.rows = [r for r in self.rows if r[0] > before_ms]

    def place(self, ms: int, fcnt: int, us: int, max_step: int, max_silence_ms: int) -> tuple:
        """Number and start of the flow a packet belongs to, its pace and its counter step."""
        for row in self.rows:
            step, dt = fcnt - row[1], ms - row[0]
            if 0 < step < max_step and 0 < dt < max_silence_ms:
                pace = dt / step
                if row[2] == 0 or pace <= 2 * row[2]:
                    row[0], row[1], row[2] = ms, fcnt, max(row[2], pace)
                    return row[3], row[4], pace, step
        self.rows.append([ms, fcnt, 0.0, self.created, us])
        self.created += 1
        return self.created - 1, us, 0.0, 0


class ManyFlows:
    """The same with parallel arrays, for addresses shared by very many devices."""

    _types = {"ms": np.int64, "fcnt": np.int64, "longest": np.float64, "number": np.int64, "start": np.int64}

    def __init__(self, created: int, rows):
        self.created, self.n = created, len(rows)
        for name, values in zip(self._types, zip(*rows)):
            column = np.empty(2 * self.n, self._types[name])
            column[: self.n] = values
            setattr(self, name, column)

    def pack(self) -> tuple:
        return self.created, list(zip(*[getattr(self, name)[: self.n].tolist() for name in self._types]))

    def fitting(self):
        return self if self.n > FewFlows.LIMIT // 2 else FewFlows(*self.pack())

    def retire(self, before_ms: int) -> None:
        alive = np.flatnonzero(self.ms[: self.n] > before_ms)
        if len(alive) < self.n:
            for name in self._types:
                column = getattr(self, name)
                column[: len(alive)] = column[alive]
            self.n = len(alive)

    def place(self, ms: int, fcnt: int, us: int, max_step: int, max_silence_ms: int) -> tuple:
        dt, step = ms - self.ms[: self.n], fcnt - self.fcnt[: self.n]
        near = np.flatnonzero((step > 0) & (step < max_step) & (dt > 0) & (dt < max_silence_ms))
        pace, longest = dt[near] / step[near], self.longest[near]
        fits = np.flatnonzero((longest == 0) | (pace <= 2 * longest))
        if len(fits):
            at, pace = near[fits[0]], float(pace[fits[0]])
            self.ms[at], self.fcnt[at], self.longest[at] = ms, fcnt, max(self.longest[at], pace)
            return self.number[at], self.start[at], pace, step[at]
        if self.n == len(self.ms):
            for name in self._types:
                column = getattr(self, name)
                setattr(self, name, np.concatenate([column, np.empty_like(column)]))
        for name, value in zip(self._types, (ms, fcnt, 0.0, self.created, us)):
            getattr(self, name)[self.n] = value
        self.n, self.created = self.n + 1, self.created + 1
        return self.created - 1, us, 0.0, 0


def flow_fold(max_step: int, max_silence_ms: int) -> Fold:
    def fold(state, arrays):
        flows = FewFlows() if state is None else FewFlows(*state) if isinstance(state, tuple) else state
        us = arrays["_us"].tolist()
        placed = []
        for i, (at_us, fcnt) in enumerate(zip(us, arrays["fCnt"].tolist())):
            ms = at_us // 1000
            if i % 64 == 0:
                flows.retire(ms - max_silence_ms)
                flows = flows.fitting()
            placed.append(flows.place(ms, fcnt, at_us, max_step, max_silence_ms))
        number, start, pace, step = zip(*placed)
        return flows, {
            "flow_id": np.array(number, np.int64),
            "_since_us": np.array(start, np.int64),
            "interpkt_time_ms": np.array(pace, np.float64),
            "fCnt_diff": np.array(step, np.int64),
        }

    return fold
