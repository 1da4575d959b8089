"""Plain-Python statements of the order-dependent operators, for small inputs."""

from __future__ import annotations

GAP_US = 60 * 60 * 1_000_000


def flags(rows, gap_us=GAP_US):
    """rows: (payload, us, id, radio) -> {id: original id}."""
    out, before, chain = {}, None, None
    for payload, us, rid, radio in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        linked = before is not None and before[0] == payload and before[2] == radio and us - before[1] <= gap_us
        chain = chain if linked else rid
        out[rid] = chain
        before = (payload, us, radio)
    return out


def messages(rows, window_us=300_000):
    """rows: (key, us, id) -> {id: message id}, by one pass over all rows in time order."""
    out, open_ = {}, {}
    for key, us, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        anchor = open_.get(key)
        if anchor is None or us - anchor[0] > window_us:
            anchor = open_[key] = (us, rid)
        out[rid] = anchor[1]
    return out


def flows(rows, max_step=10_000, max_silence=604_800_000):
    """rows: (device, us, id, counter) -> {id: (flow number, pace, step)}."""
    out, known = {}, {}
    for dev, us, rid, fcnt in sorted(rows, key=lambda r: (r[0], r[1] // 1000, r[2])):
        ms, mine = us // 1000, known.setdefault(dev, [])
        for i, flow in enumerate(mine):
            step, dt = fcnt - flow["fcnt"], ms - flow["ms"]
            if not (1 <= step < max_step and 0 < dt < max_silence):
                continue
            if flow["max"] and dt / step > 2 * flow["max"]:
                continue
            flow.update(fcnt=fcnt, ms=ms, max=max(flow["max"], dt / step))
            out[rid] = (i, dt / step, step)
            break
        else:
            mine.append({"fcnt": fcnt, "ms": ms, "max": 0})
            out[rid] = (len(mine) - 1, 0.0, 0)
    return out


def ecdf(pairs):
    """pairs: (value, weight) -> [(value, weight, cumulative, total)]."""
    sums = {}
    for v, w in pairs:
        sums[v] = sums.get(v, 0) + w
    total, run, out = sum(sums.values()), 0, []
    for v in sorted(sums):
        run += sums[v]
        out.append((v, sums[v], run, total))
    return out
