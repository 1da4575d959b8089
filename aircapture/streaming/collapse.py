"""State update of the streaming message collapse. Shipped to the workers by value (see ``jobs``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

MESSAGE_COLUMNS = ("frequency", "bandwidth", "spreadFactor", "codeRate")
MESSAGE_SCHEMA = "_id string, message_id string, time timestamp"
STATE_SCHEMA = (
    "wait_key array<string>, wait_us array<long>, wait_id array<string>, "
    "open_key array<string>, open_us array<long>, open_id array<string>"
)


def _micros(times: pd.Series) -> np.ndarray:
    return pd.to_datetime(times, utc=True).astype("datetime64[us, UTC]").astype("int64").to_numpy()


def _settle(ready: pd.DataFrame, anchors: dict, window_us: int) -> list[str]:
    """Message of each reception; rows come sorted by key, time, id. ``anchors`` is kept up to date."""
    told: list[str] = []
    for key, us, rid in zip(ready["key"], ready["us"], ready["_id"]):
        anchor = anchors.get(key)
        if anchor is None or us > anchor[0] + window_us:
            anchor = anchors[key] = (us, rid)
        told.append(anchor[1])
    return told


def message_updater(window_us: int) -> Callable:
    """Update function of one bucket of message keys."""

    def update(bucket: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in state.get] if state.exists else [[], [], [], [], [], []]
        waiting = [pd.DataFrame({"key": held[0], "us": np.array(held[1], np.int64), "_id": held[2]})]
        anchors = {k: (us, rid) for k, us, rid in zip(*held[3:])}
        for batch in batches:
            if len(batch):
                waiting.append(pd.DataFrame({"key": batch["key"], "us": _micros(batch["time"]), "_id": batch["_id"]}))
        rows = pd.concat([w for w in waiting if len(w)] or waiting[:1]).sort_values(["key", "us", "_id"])
        mark_us = state.getCurrentWatermarkMs() * 1000
        ready = rows[rows["us"] < mark_us]
        rest = rows[rows["us"] >= mark_us]
        told = _settle(ready, anchors, window_us)
        still_open = [(k, us, rid) for k, (us, rid) in anchors.items() if us + window_us >= mark_us]
        if rest.empty and not still_open:
            if state.exists:
                state.remove()
        else:
            opened = [list(x) for x in zip(*still_open)] or [[], [], []]
            state.update((rest["key"].tolist(), rest["us"].tolist(), rest["_id"].tolist(), *opened))
            due = [us + window_us for us in opened[1]] + rest["us"].tolist()
            state.setTimeoutTimestamp(max(min(due), mark_us) // 1000 + 1)
        if told:
            yield pd.DataFrame(
                {"_id": ready["_id"].to_numpy(), "message_id": told, "time": pd.to_datetime(ready["us"].to_numpy(), unit="us")}
            )

    return update
