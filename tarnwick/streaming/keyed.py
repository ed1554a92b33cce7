"""The change watch with a state for each document: what a batch costs grows with its own events, not with all documents.

Events are rows (key, kind, fingerprint, error, complete, at). ``seen`` and ``gone`` come from scans of the base, ``claim``, ``beat``
and ``result`` from the workers that check documents. A claim that falls silent is released by a timer on event time. The changes
of each batch are a table of their own in the shared folder, which a batch that is run again writes anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "key string, kind string, fingerprint string, error string, complete boolean, at timestamp"
STATE = "fingerprint string, status string, removed_from string, attempts long, retry_after long, heartbeat long, scanned long"
CHANGES = f"key string, {STATE}"
#: Seconds after which a check without a sign of life is released, attempts of a check, and seconds from one to the next.
SILENT, MOST, WAIT = 2400, 3, 300
_ORDER = {"seen": 0, "gone": 1, "beat": 2, "result": 3, "claim": 4}


def after(state: dict | None, event: dict, silent: int = SILENT, most: int = MOST, wait: int = WAIT) -> dict | None:
    """The state of a document after one event; ``at`` counts seconds.

    Scans: as ``documents.after_scan`` says, a changed text starts over with no attempts; what a scan older than the last
    one says of the document is ignored. A claim takes a document that is pending and due, and is else ignored. A result
    counts while its document is being checked; ``review.settled`` says how. Events on a document that no scan has seen, and
    those of an unknown kind, change nothing.
    """
    at, kind = event["at"], event["kind"]
    if state and state["status"] == "checking" and at >= state["heartbeat"] + silent:
        state = state | {"status": "pending"}
    if kind in ("seen", "gone"):
        if state and at < state["scanned"]:
            return state
        if kind == "gone":
            left = state and (state["removed_from"] if state["status"] == "removed" else state["status"])
            return state and state | {"status": "removed", "removed_from": left, "scanned": at}
        if state and state["fingerprint"] == event["fingerprint"]:
            if state["status"] != "removed":
                return state | {"scanned": at}
            back = state["removed_from"]
            return state | {"status": "pending" if back in (None, "checking") else back, "removed_from": None, "scanned": at}
        fresh = {"removed_from": None, "attempts": 0, "retry_after": 0, "heartbeat": 0, "scanned": at}
        return fresh | {"fingerprint": event["fingerprint"], "status": "unreadable" if event["error"] else "pending"}
    if state is None:
        return None
    if kind == "claim" and state["status"] == "pending" and state["retry_after"] <= at:
        return state | {"status": "checking", "heartbeat": at}
    if kind == "beat" and state["status"] == "checking":
        return state | {"heartbeat": max(at, state["heartbeat"])}
    if kind == "result" and state["status"] == "checking":
        n = state["attempts"] + 1
        if not event["complete"] and n < most:
            return state | {"status": "pending", "attempts": n, "retry_after": at + wait * n}
        if event["fingerprint"] == state["fingerprint"]:
            return state | {"status": "checked" if event["complete"] else "incomplete", "attempts": n}
    return state


def changes(events: DataFrame, lateness: str = "10 minutes", silent: int = SILENT, most: int = MOST, wait: int = WAIT) -> DataFrame:
    """The documents whose state moved, one row for each in a batch: key and the state. Events without a key, a kind or a time
    are left out. A document's events of one batch are sorted in one task, so the source's limits on a batch (its files or
    offsets a trigger) bound them. Of events at one time, scans come first, then signs of life, results and claims."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def moved(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = dict(zip(names, held.get)) if held.exists else None
        new = old
        if held.hasTimedOut:
            new = old | {"status": "pending"} if old["status"] == "checking" else old
        else:
            rows = [e for b in batches for e in b.astype(object).where(b.notna(), None).to_dict("records")]
            for e in sorted(rows, key=lambda e: (e["at"], _ORDER.get(e["kind"], 9), e["fingerprint"] or "", bool(e["complete"]))):
                new = after(new, e, silent, most, wait)
        if new and new["status"] == "checking":
            until = (new["heartbeat"] + silent) * 1000
            if until > held.getCurrentWatermarkMs():
                held.setTimeoutTimestamp(until)
            else:  # its events came so late that its time is over
                new = new | {"status": "pending"}
        if new and new != old:
            held.update(tuple(new[c] for c in names))
            row = pd.DataFrame([{"key": key[0]} | new])
            yield row.astype({c: "int64" for c in ("attempts", "retry_after", "heartbeat", "scanned")})

    rows = events.where("key is not null and kind is not null and at is not null").withWatermark("at", lateness)
    rows = rows.withColumn("at_seconds", F.unix_timestamp("at")).select("key", "kind", "fingerprint", "error", "complete", "at", "at_seconds")

    def by_seconds(key, batches, held):
        return moved(key, (b.drop(columns=["at"]).rename(columns={"at_seconds": "at"}) for b in batches), held)

    return rows.groupBy("key").applyInPandasWithState(by_seconds, CHANGES, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def keyed_watch(events: DataFrame, path: str, checkpoint: str, **limits):
    """Starts the watch on a stream of events; each batch's changes go to ``path``/v=N, N the number of the batch."""

    def step(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={version}")

    return changes(events, **limits).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each document: key and the state's columns."""
    names = [c.split()[0] for c in STATE.split(", ")]
    rows = spark.read.schema(f"{CHANGES}, v long").parquet(path)
    last = rows.groupBy("key").agg(F.max_by(F.struct(*names), "v").alias("s"))
    return last.select("key", "s.*")
