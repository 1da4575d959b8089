"""Keyed state of the streaming messages and duplicate flags. Shipped to the workers by value (see ``jobs``).

Both updaters let rows wait until the watermark has passed them, settle them
in order of (time, id), and keep what a later row may still need. Spark drops
rows that are not later than the watermark, so what is settled stays settled.
Most keys have few rows, so state is kept, as Arrow data, per hash bucket of
keys: a call settles all keys of a bucket together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Fields of a reception as they come, wait and are sent on.
RECEPTION = {
    "us": "long", "_id": "string", "channel": "int", "rfChain": "int", "loRaSNR": "double", "timestamp": "long",
    "mac": "string", "rssi": "int", "crcStatus": "string",
}
#: Fields of a message that are those of its first reception, beside the key.
HEADER = {"antenna": "int", "board": "int", "size": "int", "modulation": "string"}
KEY = {"phyPayload": "string", "frequency": "long", "bandwidth": "long", "spreadFactor": "int", "codeRate": "string"}
#: A settled message: its key, and its receptions as they came in, in order.
MESSAGE = "key string, receptions array<string>"
#: Radio parameters that two copies share.
RADIO = {"sf": "int", "bw": "long", "cr": "string", "freq": "long"}
FLAG = "_id string, us long, is_duplicate boolean, copy_of string"
STATE = "waiting binary, last binary"

#: Waiting rows: ``said`` is what goes with the row as text (a whole reception, or radio parameters).
_WAITING = pa.schema([("key", pa.string()), ("us", pa.int64()), ("_id", pa.string()), ("said", pa.string())])
#: The last settled packet of each key; ``_id`` is the head of its chain.
_LAST = _WAITING


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _rows(state, batches: Iterator[pd.DataFrame]) -> tuple[pa.Table, pa.Table]:
    """All rows that wait, with those of this batch, and the last settled ones."""
    held = [_unpack(bytes(x)) for x in state.get] if state.exists else [_WAITING.empty_table(), _LAST.empty_table()]
    new = [pa.Table.from_pandas(b[_WAITING.names], _WAITING, preserve_index=False) for b in batches if len(b)]
    return pa.concat_tables([held[0], *new]), held[1]


def _objects(column: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _ordered(rows: pa.Table) -> pa.Table:
    """By key, time and id, an id that is null like an empty one."""
    tied = rows.append_column("tie", rows["_id"].fill_null(""))
    return tied.sort_by([("key", "ascending"), ("us", "ascending"), ("tie", "ascending")]).drop_columns(["tie"])


def _keep(state, waiting: pa.Table, last: pa.Table, due: list[int], mark: int) -> None:
    """``due``: the instants (µs) at or after which the watermark has something to settle or to forget."""
    if not len(waiting) and not len(last):
        if state.exists:
            state.remove()
        return
    state.update((_pack(waiting), _pack(last)))
    # a timer goes off once the watermark is past it, so it is set to the millisecond before
    state.setTimeoutTimestamp(max(-(-min(due) // 1000) - 1, mark // 1000))


def message_updater(window_us: int) -> Callable:
    """Receptions of a message key wait until their message cannot grow any more."""

    def update(bucket: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, none = _rows(state, batches)
        mark = state.getCurrentWatermarkMs() * 1000
        rows = _ordered(rows)
        keys, us = _objects(rows["key"]), rows["us"].to_numpy()
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        starts, anchor = [], 0
        for at, (new, time) in enumerate(zip(first.tolist(), us.tolist(), strict=True)):
            if new or time > anchor + window_us:
                anchor = time
                starts.append(at)
        starts = np.array(starts, np.int64)
        ends = np.r_[starts[1:], len(keys)].astype(np.int64)
        complete = us[starts] + window_us <= mark
        open_rows = np.repeat(~complete, ends - starts)
        rest = rows.filter(pa.array(open_rows))
        _keep(state, rest, none, (us[starts[~complete]] + window_us).tolist(), mark)
        if complete.any():
            said = rows["said"].to_pylist()
            told = [(keys[a], said[a:b]) for a, b in zip(starts[complete].tolist(), ends[complete].tolist(), strict=True)]
            yield pd.DataFrame(told, columns=["key", "receptions"])

    return update


def flag_updater(gap_us: int) -> Callable:
    """Packets wait for the watermark; the last one settled of each key stays, with its chain's head, for a gap."""

    def update(bucket: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, last = _rows(state, batches)
        mark = state.getCurrentWatermarkMs() * 1000
        passed = pa.array(rows["us"].to_numpy() <= mark)
        rest = rows.filter(pa.array(rows["us"].to_numpy() > mark))
        ready = _ordered(rows.filter(passed))
        # the last packets go before what came after them
        both = pa.concat_tables([last, ready])
        old = np.arange(len(both)) < len(last)
        keys = _objects(both["key"])
        order = np.argsort(keys, kind="stable")
        both, old, keys = both.take(pa.array(order)), old[order], keys[order]
        us, ids, radio = both["us"].to_numpy(), _objects(both["_id"]), _objects(both["said"])
        linked = np.zeros(len(keys), bool)
        if len(keys):
            linked[1:] = (keys[1:] == keys[:-1]) & (us[1:] - us[:-1] <= gap_us) & (radio[1:] == radio[:-1])
        heads = ids[np.maximum.accumulate(np.where(linked, 0, np.arange(len(keys))))]
        final = np.r_[keys[1:] != keys[:-1], True] if len(keys) else linked
        final = final & (us + gap_us >= mark)  # no packet to come can follow the others
        kept = pa.table([pa.array(keys[final], pa.string()), us[final], pa.array(heads[final], pa.string()), pa.array(radio[final], pa.string())], schema=_LAST)
        _keep(state, rest, kept, rest["us"].to_pylist() + (us[final] + gap_us + 1).tolist(), mark)
        if len(ready):
            now = ~old
            yield pd.DataFrame({"_id": ids[now], "us": us[now], "is_duplicate": heads[now] != ids[now], "copy_of": heads[now]})

    return update
