"""Sessions from gaps: against a plain replay of the batches, and the state's steps against plain sessions."""

import datetime
import random
import zlib

import numpy as np
import pytest

from provenir.llm import sessions
from provenir.llm.sessions import FRAGMENT, GAP, GAPS, HIGH, HOUR, LOW, absorb, close, session_gaps

EPOCH = datetime.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, n long, crc long, first_us long"


def plain(clicks, batches=8, lateness=240):
    """Replay: clicks (click_id, us, arrived us, client)."""
    once = {}
    for c, us, arrived, client in clicks:
        if None not in (c, us, client):
            x = (us, us if arrived is None else arrived, client)
            once[c] = min(once.get(c, x), x)
    if not once:
        return []
    hours = [a // HOUR for _, a, _ in once.values()]
    lo, hi = min(hours), max(hours)
    dealt = [[] for _ in range(batches)]
    for c, (us, a, client) in once.items():
        b = batches * (a // HOUR - lo) // (hi - lo + 1)
        b = min(batches - 1, b + (zlib.crc32(f"{client}:{us // HOUR}".encode()) % 3 == 0))
        dealt[b].append((us, c, client))
    open_, out, top, mark = {}, [], None, None
    for b, rows in enumerate(dealt):
        late = mark
        if rows:
            top = max([max(r[0] for r in rows), *([top] if top is not None else [])])
            mark = top - lateness * HOUR
        for client in {r[2] for r in rows} | set(open_):
            parts = [*open_.get(client, []), *([us, us, 1, zlib.crc32(str(c).encode()), 0, False] for us, c, k in rows if k == client and (late is None or us >= late))]
            joined = []
            for p in sorted(([*p[:5], len(p) == 5] for p in parts), key=lambda p: p[0]):
                if joined and p[0] - joined[-1][1] <= GAP:
                    q = joined[-1]
                    joined[-1] = [q[0], max(q[1], p[1]), q[2] + p[2], q[3] + p[3], q[4] + p[4], q[5] + p[5]]
                else:
                    joined.append([*p[:5], int(p[5])])
            open_[client] = [[*q[:4], q[4] + max(0, q[5] - 1)] for q in joined]
        for client in open_:
            done = [q for q in open_[client] if mark is not None and q[1] < mark - GAP]
            out += [(client, *q, b) for q in done]
            open_[client] = [q for q in open_[client] if q not in done]
    return sorted(out + [(client, *q, batches) for client in open_ for q in open_[client]])


def some_clicks(seed, n, days=30):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        client = rng.choice([1, 1, 2, 3, 4, -7])
        us = rng.randrange(days * 24) * HOUR + rng.choice([0, GAP, GAP + 1, rng.randrange(HOUR)])
        late = rng.choice([0, 0, 0, 5, 60, 300]) * HOUR
        out.append((i, us, us + late + 1, client))
    return out


def at(us):
    return None if us is None else EPOCH + datetime.timedelta(microseconds=us)


def frame(spark, clicks):
    return spark.createDataFrame([(c, at(us), at(a), client, 1, 2, 3) for c, us, a, client in clicks], SCHEMA).repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_a_plain_replay(spark, monkeypatch):
    monkeypatch.setattr(sessions, "STATE_ROWS", 3)
    clicks = some_clicks(1, 1500)
    clicks += clicks[:40]  # repeated rows
    clicks += [(None, 5, 5, 1), (9001, None, 5, 1), (9002, 5, 5, None), (9003, 3 * HOUR, None, 2)]
    got, want = rows_of(session_gaps(frame(spark, clicks))), plain(clicks)
    assert got == want
    assert len({r[6] for r in want}) > 3 and sum(r[3] for r in want) < 1490 and max(r[5] for r in want) > 0


def test_one_click_and_none(spark, monkeypatch):
    monkeypatch.setattr(sessions, "STATE_ROWS", 2)
    assert rows_of(session_gaps(frame(spark, [(5, 7, 9, 3)]), batches=2)) == [(3, 7, 7, 1, zlib.crc32(b"5"), 0, 2)]
    assert rows_of(session_gaps(frame(spark, []), batches=2)) == []


def test_zone_of_the_session_does_not_count(spark, monkeypatch):
    monkeypatch.setattr(sessions, "STATE_ROWS", 2)
    clicks = [(i, i * HOUR // 4 + 7 * 24 * HOUR * i // 3, i * HOUR * 9, 1) for i in range(20)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows_of(session_gaps(frame(spark, clicks), batches=3))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == plain(clicks, batches=3)


@pytest.mark.parametrize("seed", range(30))
def test_gaps_equal_plain_sessions(seed):
    """Shrunk, split and deleted gaps: after each arrival the state shows the sessions of all that arrived."""
    rng = random.Random(seed)
    gaps = {c: np.zeros(0, np.int64) for c in GAPS}
    seen, merges = [], 0
    for _ in range(6):
        new = [(rng.randrange(3), rng.randrange(40) * GAP // 3 + rng.randrange(2)) for _ in range(rng.randrange(8))]
        f = dict(zip(FRAGMENT, (np.array([x[0] for x in new], np.int64), *2 * (np.array([x[1] for x in new], np.int64),), np.ones(len(new), np.int64), np.array([x[1] % 7 for x in new], np.int64))))
        if new:
            gaps = absorb(gaps, f)
        seen += new
        want = []
        for client, t in sorted(seen):
            if want and want[-1][0] == client and t - want[-1][2] <= GAP:
                want[-1][2] = t
                want[-1][3] += 1
                want[-1][4] += t % 7
            else:
                want.append([client, t, t, 1, t % 7])
        everything, left = close(gaps, HIGH)
        got = [list(map(int, x)) for x in zip(*(everything[c] for c in ("client_id", "first_us", "last_us", "n_clicks", "ids_crc32")))]
        assert got == want and len(left["client_id"]) == 0
        assert (np.diff(gaps["n"])[np.diff(gaps["client_id"]) == 0] > 0).all()
        cut_at = rng.randrange(40) * GAP // 3
        done, rest = close(gaps, cut_at)
        assert len(done["client_id"]) == sum(w[2] < cut_at for w in want)
        again = close(rest, HIGH)[0]
        assert len(again["client_id"]) == sum(w[2] >= cut_at for w in want) and again["n_clicks"].sum() == sum(w[3] for w in want if w[2] >= cut_at)


def test_totals_of_endless_gaps():
    gaps = absorb({c: np.zeros(0, np.int64) for c in GAPS}, dict(zip(FRAGMENT, (np.array([4]), np.array([10]), np.array([20]), np.array([3]), np.array([9])))))
    assert gaps["left"].tolist() == [LOW, 20] and gaps["right"].tolist() == [10, HIGH] and gaps["n"].tolist() == [0, 3]
