"""The watch with keyed state: single steps, and a stream against the same events in plain order and against a scan's plan."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tarnwick.operators import documents
from tarnwick.streaming import keyed

BEGIN = datetime(2030, 1, 1, tzinfo=timezone.utc)


def event(kind, at, fingerprint=None, error=None, complete=None):
    return {"kind": kind, "at": at, "fingerprint": fingerprint, "error": error, "complete": complete}


def statuses(*events):
    out, state = [], None
    for e in events:
        state = keyed.after(state, e)
        out.append(state and (state["status"], state["attempts"]))
    return out


def test_steps():
    seen, claim = event("seen", 0, "x"), event("claim", 1)
    assert statuses(claim, event("gone", 0), event("what", 0)) == [None, None, None]
    done = event("result", 5, "x", None, True)
    assert statuses(seen, done, claim, done, event("seen", 9, "x"), event("seen", 10, "y")) == [("pending", 0), ("pending", 0), ("checking", 0), ("checked", 1), ("checked", 1), ("pending", 0)]
    failed = [event("result", t, "x", None, False) for t in (5, 400, 2000)]
    assert statuses(seen, claim, failed[0], event("claim", 304), event("claim", 305), failed[1], event("claim", 1000), failed[2]) == [
        ("pending", 0), ("checking", 0), ("pending", 1), ("pending", 1), ("checking", 1), ("pending", 2), ("checking", 2), ("incomplete", 3)]
    # silence releases a claim, a beat puts it off
    assert statuses(seen, claim, event("claim", 2401))[-1] == statuses(seen, claim, event("beat", 2000), event("beat", 2500))[-1] == ("checking", 0)
    assert statuses(seen, claim, event("beat", 2401))[-1] == ("pending", 0)
    # a text that changed while it was checked stays queued
    assert statuses(seen, claim, event("seen", 3, "y"), done)[-1] == ("pending", 0)
    # gone and back: unchanged it takes up where it left off; its claim is over
    assert statuses(seen, claim, done, event("gone", 6), event("gone", 7), event("seen", 8, "x"))[-1] == ("checked", 1)
    assert statuses(seen, claim, event("gone", 6), event("seen", 8, "x"))[-1] == ("pending", 0)
    assert statuses(event("seen", 5, "x"), event("seen", 3, "old"), event("gone", 4))[-1] == ("pending", 0)
    assert statuses(event("seen", 5, "x", "no text"), event("claim", 6))[-1] == ("unreadable", 0)


def stream_of(spark, folder, batches, **limits):
    schema = "key string, kind string, fingerprint string, error string, complete boolean, at timestamp, extra int"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, e["kind"], e["fingerprint"], e["error"], e["complete"], BEGIN + timedelta(seconds=e["at"]), 1) for k, e in rows], schema).coalesce(1).write.parquet(f"{folder}/in/b={i}")
        query = keyed.keyed_watch(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/checkpoint", **limits)
        query.processAllAvailable()
        query.stop()
    return {r["key"]: r for r in keyed.current(spark, f"{folder}/out").collect()}


def test_stream(spark, tmp_path):
    rng, offset = random.Random(3), int(BEGIN.timestamp())
    plain, batches, now = {}, [], 0
    for _ in range(3):
        rows = []
        for _ in range(400):
            now += rng.randrange(1, 12)
            kind = rng.choice(["seen", "seen", "gone", "claim", "claim", "beat", "result", "result"])
            key = f"d{rng.randrange(40)}"
            e = event(kind, now, rng.choice("xy"), rng.choice([None] * 9 + ["bad"]) if kind == "seen" else None, rng.random() < 0.5)
            rows.append((key, e))
            plain[key] = keyed.after(plain.get(key), e | {"at": now + offset})
        rng.shuffle(rows)
        batches.append([*rows, (None, event("seen", now, "x"))])
    # the last batch only lets time pass
    batches.append([("late", event("seen", now + 20000, "x"))])
    plain["late"] = keyed.after(None, event("seen", now + 20000 + offset, "x"))
    got = stream_of(spark, tmp_path, batches)
    released = {k: s | {"status": "pending"} if s["status"] == "checking" else s for k, s in plain.items() if s}
    assert any(s and s["status"] == "checking" for s in plain.values())
    assert {k: r["status"] for k, r in got.items()} == {k: s["status"] for k, s in released.items()}
    assert all((got[k]["fingerprint"], got[k]["attempts"], got[k]["retry_after"]) == (s["fingerprint"], s["attempts"], s["retry_after"]) for k, s in released.items())
    out = spark.read.schema(f"{keyed.CHANGES}, v long").parquet(f"{tmp_path}/out")
    late = out.where("key = 'late'").first()["v"]
    # an event on one document and the claims that it lets run out are all that is written, not all documents
    assert out.where(F.col("v") >= late).count() == 1 + sum(s["status"] == "checking" for s in plain.values() if s) < len(got) / 2


def test_scan_as_a_stream(spark, tmp_path):
    """Two scans as events end in the states that the batch plan gives."""
    first = [(str(i), f"f{i}") for i in range(60)]
    second = [(str(i), f"f{i}" if i % 4 else "new", "no text" if i % 7 == 0 else None) for i in range(10, 90)]
    gone = [(k, event("gone", 100)) for k, _ in first if int(k) < 10]
    got = stream_of(spark, tmp_path, [[(k, event("seen", 0, f)) for k, f in first], [(k, event("seen", 100, f, e)) for k, f, e in second] + gone])
    state = spark.createDataFrame([(k, f, "pending") for k, f in first], "key string, fingerprint string, status string")
    want = documents.after_scan(state, spark.createDataFrame(second, "key string, fingerprint string, error string"))
    assert {k: (r["fingerprint"], r["status"], r["removed_from"]) for k, r in got.items()} == {r["key"]: (r["fingerprint"], r["status"], r["removed_from"]) for r in want.select("key", "fingerprint", "status", F.when(F.col("status") == "removed", F.col("removed_from")).alias("removed_from")).collect()}
