import random
from datetime import datetime, timedelta, timezone

import pytest

from docspark.llm import conversations
from docspark.llm.conversations import judge, rebuild

MESSAGES = "id string, session_id string, role string, content string, deleted_at timestamp, created_at timestamp, updated_at timestamp, lane int, kind string"
SESSIONS = "id string, cleared_at timestamp, created_at timestamp, session_id string"
ALIASES = [("user", "user"), ("human", "user"), ("assistant", "assistant"), ("ai", "assistant"), ("system", "system")]
T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)
BLANKS = [None, "", " \t\n", " ", "​⁠﻿", "　"]


def make(n_sessions: int, seed: int = 0):
    rng = random.Random(seed)
    messages, sessions = [], []
    for s in range(n_sessions):
        sid = f"s{s:03d}"
        start = T0 + timedelta(hours=rng.randrange(400))
        turns = rng.choice([0, 1, 2, 4, 4, 6])
        if rng.random() < 0.9:
            sessions.append((sid, start + timedelta(seconds=rng.choice([-5, 15])) if rng.random() < 0.2 else None, start, "x"))
        if rng.random() < 0.3:
            messages.append((f"{sid}-sys", sid, " System\n", "be brief", None, start, start, 1, "k"))
        for t in range(turns):
            role = rng.choice(["user", "Human", " user\t"]) if t % 2 == 0 else rng.choice(["assistant", "AI"])
            if rng.random() < 0.04:
                role = rng.choice(["??", None, "", "assistant"])
            text = rng.choice(BLANKS) if rng.random() < 0.04 else "hello"
            at = start + timedelta(seconds=10 * (t // 2 if rng.random() < 0.1 else t))
            mid = f"{sid}-{t}"
            messages.append((mid, sid, role, text, start if rng.random() < 0.04 else None, at, at, 1, "k"))
            if rng.random() < 0.15:  # another version, older or newer
                later = at + timedelta(seconds=rng.choice([-1, 1]))
                messages.append((mid, sid, rng.choice(["user", "ai"]), "edited", None, at, later, 1, "k"))
    messages.append((messages[0][0], messages[0][1], *messages[0][2:]))
    messages.append(("z1", None, "user", "no session", None, T0, T0, 1, "k"))
    rng.shuffle(messages)
    return messages, sessions


def brute(messages, sessions):
    alias, newest = dict(ALIASES), {}
    for m in messages:
        if m[1] is not None and (m[0] not in newest or m[6] > newest[m[0]][6]):
            newest[m[0]] = m
    cleared = {s[0]: s[1] for s in sessions}
    out = {}
    for sid in {s[0] for s in sessions} | {m[1] for m in messages if m[1]}:
        live = sorted((m[5], m[0], m) for m in newest.values() if m[1] == sid and m[4] is None and (cleared.get(sid) is None or m[5] > cleared[sid]))
        told = []
        for _, mid, m in live:
            content = m[3] or ""
            blank = all(c.isspace() or c in " ​‌‍⁠﻿" for c in content)
            told.append((alias.get((m[2] or "").strip(" \t\r\n").lower()), blank, mid))
        out[sid] = (judge([x[:2] for x in told]), [x[2] for x in told])
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(spark, work, hot):
    messages, sessions = make(60)
    verdicts, told = rebuild(spark.createDataFrame(messages, MESSAGES).repartition(3), spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(ALIASES, "alias string, role string"), work, hot=hot)
    want = brute(messages, sessions)
    rows = verdicts.collect()
    assert len(rows) == len(want)
    assert {r.session_id: (r.reason is None, r.n_messages) for r in rows} == {s: (x is None, len(ids)) for s, (x, ids) in want.items()}
    got = {}
    for r in sorted(told.collect(), key=lambda r: r.position):
        got.setdefault(r.session_id, []).append(r.id)
    assert got == {s: ids for s, (x, ids) in want.items() if x is None}


def test_late_rows_timeouts_and_many_batches(spark, work, monkeypatch):
    """Sessions close by timeout while the replay runs, the state shrinks again, and rows later than the watermark change the verdict all the same."""
    messages, sessions = [], []
    for k in range(240):
        sid, at = f"s{k:03d}", T0 + timedelta(hours=6 * k)
        sessions.append((sid, None, at, "x"))
        for t, role in enumerate(("user", "assistant", "user", "assistant")):
            when = at + timedelta(seconds=30 * t)
            messages.append((f"{sid}-{t}", sid, role, "hello", None, when, when, 1, "k"))
    late = T0 + timedelta(days=50)
    messages.append(("s003-1", "s003", "assistant", " ", None, T0 + timedelta(hours=18, seconds=30), late, 1, "k"))  # edited to nothing long after its session closed
    messages.append(("s005-4", "s005", "user", "and?", None, T0 + timedelta(hours=30, seconds=150), late, 1, "k"))  # arrives weeks late
    messages.append(("s239-4", "s239", "user", "later", None, T0 + timedelta(hours=6 * 239 + 9), T0 + timedelta(hours=6 * 239 + 9), 1, "k"))  # comes when its session has been quiet for long
    monkeypatch.setattr(conversations, "SHARD_ROWS", 4)
    reports: list = []
    frames = spark.createDataFrame(messages, MESSAGES).repartition(3), spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(ALIASES, "alias string, role string")
    verdicts, told = rebuild(*frames, work, slices=8, progress=reports)
    want = brute(messages, sessions)
    assert {r.session_id: (r.reason is None, r.n_messages) for r in verdicts.collect()} == {s: (x is None, len(ids)) for s, (x, ids) in want.items()}
    assert {s for s, (x, _) in want.items() if x is not None} == {"s003", "s005", "s239"}
    assert told.count() == 237 * 4
    state = [(r.batchId, r.stateOperators[0]) for r in reports if r.stateOperators]
    assert len(state) >= 8
    assert sum(s.numRowsDroppedByWatermark for _, s in state) >= 2
    # the state holds what is open, never the table, and is dropped before the end of the replay
    totals = [s.numRowsTotal for _, s in state]
    assert totals[-1] == 0 and max(totals) < 0.5 * 240
    assert sum(s.numRowsRemoved for _, s in state[:-2]) > 0.5 * 150


def test_empty(spark, work):
    verdicts, told = rebuild(spark.createDataFrame([], MESSAGES), spark.createDataFrame([], SESSIONS), spark.createDataFrame(ALIASES, "alias string, role string"), work)
    assert verdicts.count() == 0 and told.count() == 0


def test_nulls_in_every_column(spark, work):
    messages = [(None, "a", None, None, None, None, None, None, None), (None, "a", "user", "x", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    verdicts, _ = rebuild(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame([("b", None, None, None), (None, None, None, None)], SESSIONS), spark.createDataFrame(ALIASES, "alias string, role string"), work)
    assert {(r.session_id, r.n_messages, r.reason) for r in verdicts.collect()} == {("a", 2, "unknown role"), ("b", 0, "empty")}


def test_judge():
    u, a, s = ("user", False), ("assistant", False), ("system", False)
    assert judge([s, u, a, s, u, a]) is None
    assert judge([]) == "empty"
    assert judge([s]) == "no exchange"
    assert judge([a, u]) == "does not start with user"
    assert judge([u, u, a]) == "does not alternate"
    assert judge([u]) == "does not end with assistant"
    assert judge([u, ("assistant", True)]) == "blank content"
    assert judge([u, (None, False)]) == "unknown role"
