"""The folds on their own: pieces, representations, stored states."""

import pickle
import random

import model
import numpy as np
import pytest

from aircapture.operators import folds

LIMITS = (10_000, 604_800_000)


def packets(seed, n=3000, sources=40):
    rnd = random.Random(seed)
    counters, rows, us = [rnd.randrange(60_000) for _ in range(sources)], [], 1_704_067_200_000_000
    for i in range(n):
        us += rnd.randrange(1, 400) * 1_000_000
        if rnd.random() < 0.002:
            us += rnd.randrange(8) * 86_400_000_000
        s = rnd.randrange(sources)
        counters[s] = (counters[s] + rnd.randrange(1, 4)) % 65536
        rows.append(("d", us, f"r{i:05d}", counters[s]))
    return rows


def run(rows, cuts):
    fold, state, out = folds.flow_fold(*LIMITS), None, []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        part = rows[lo:hi]
        state, new = fold(state, {"_us": np.array([r[1] for r in part]), "fCnt": np.array([r[3] for r in part])})
        out += list(zip(new["flow_id"].tolist(), new["interpkt_time_ms"].tolist(), new["fCnt_diff"].tolist()))
        state = pickle.loads(pickle.dumps(state.pack()))
    return out


@pytest.mark.parametrize("limit", [0, 2, 64, 10_000])
@pytest.mark.parametrize("cuts", [[], [1, 700, 701, 2500]])
def test_flow_fold(monkeypatch, limit, cuts):
    monkeypatch.setattr(folds.FewFlows, "LIMIT", limit)
    rows = packets(1)
    want = model.flows(rows)
    assert run(rows, cuts) == [want[r[2]] for r in rows]


@pytest.mark.parametrize("cuts", [[], [1, 2, 400], list(range(1, 900, 7))])
def test_anchor_fold(cuts):
    rnd = random.Random(2)
    rows = sorted((rnd.randrange(0, 60_000_000, 50_000), f"r{i:03d}") for i in range(900))
    want = model.messages([("k", us, rid) for us, rid in rows])
    fold, state, got = folds.anchor_fold(300_000), None, []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        part = rows[lo:hi]
        state, new = fold(state, {"_us": np.array([us for us, _ in part]), "_id": np.array([rid for _, rid in part], object)})
        state = pickle.loads(pickle.dumps(state))
        got += new["message_id"].tolist()
    assert got == [want[rid] for _, rid in rows]
