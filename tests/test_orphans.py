import random
from datetime import datetime, timedelta, timezone

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.operators.orphans import Bitmap, orphan_references

SCHEMA = "chunk_id string, ingested_at string, children_ids array<string>, summary_of array<string>, sibling_ids array<string>, id int, field string, pos string"
TOMBS = "chunk_id string, deleted_at timestamp, reason string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=300), st.sets(st.integers(0, 200_000), max_size=300), st.integers(0, 199_000))
def test_bitmap_and_not(a, b, dense_at):
    a = a | set(range(dense_at, dense_at + 400))
    b = b | set(range(dense_at + 100, dense_at + 300))
    left, right = (Bitmap.of(np.array(sorted(x), dtype=np.int64)) for x in (a, b))
    assert left.decode().tolist() == sorted(a)
    assert left.and_not(right).decode().tolist() == sorted(a - b)
    assert right.and_not(left).decode().tolist() == sorted(b - a)


def brute(rows, tombs):
    def ts(x):
        try:
            return datetime.fromisoformat(x).astimezone(timezone.utc)
        except (TypeError, ValueError):
            return None

    first, last, stored = {}, {}, set()
    for r in rows:
        if r[0] is None:
            continue
        stored.add(r[0])
        if (t := ts(r[1])) is not None:
            first[r[0]] = min(t, first.get(r[0], t))
            last[r[0]] = max(t, last.get(r[0], t))
    gone = {c for c, at, _ in tombs if not (c in last and last[c] >= at)}
    month = lambda t: (t.year, t.month)
    out = set()
    for r in rows:
        for name, refs in zip(("children_ids", "summary_of", "sibling_ids"), r[2:5]):
            for ref in refs or []:
                if r[0] is None or not ref:
                    continue
                if ref in gone:
                    out.add((r[0], name, ref, "deleted"))
                elif ref not in stored:
                    out.add((r[0], name, ref, "missing"))
                elif ref in first and r[0] in first and month(first[ref]) > month(first[r[0]]):
                    out.add((r[0], name, ref, "late"))
    return out


def make(n: int):
    rng = random.Random(5)
    ids = [f"k{i}" for i in range(n)] + ["gone1", "gone2", "never"]
    start = datetime(2025, 1, 31, 20, tzinfo=timezone.utc)
    rows = []
    for i in range(n):
        at = start + timedelta(days=rng.randrange(90), hours=rng.randrange(24))
        text = rng.choice([at.isoformat(), at.astimezone(timezone(timedelta(hours=-5))).isoformat(), at.strftime("%Y-%m-%dT%H:%M:%S.000") + "Z"])
        if i % 17 == 0:
            text = rng.choice([None, "no time"])
        refs = [[rng.choice([*ids, "", None]) for _ in range(rng.randrange(6))] if rng.random() < 0.9 else None for _ in range(3)]
        rows.append((f"k{i}", text, *refs, i, "f", "p"))
        if i % 10 == 0:
            rows.append((f"k{i}", (at + timedelta(days=40)).isoformat(), *refs, i, "f", "p"))
    rows.append((None, start.isoformat(), ["k1"], None, None, None, None, None))
    tombs = [("gone1", start, None), ("k3", start + timedelta(days=400), "x"), ("k4", start - timedelta(days=400), "x"), ("k20", start + timedelta(days=50), None)]
    return rows, tombs


def test_against_brute_force(spark, work):
    rows, tombs = make(120)
    got = orphan_references(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(tombs, TOMBS), work, range_keys=16).collect()
    assert len(got) == len({(r.chunk_id, r.ref_field, r.ref_id) for r in got})
    assert {(r.chunk_id, r.ref_field, r.ref_id, r.kind) for r in got} == brute(rows, tombs)


def test_empty(spark, work):
    assert orphan_references(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], TOMBS), work).count() == 0
