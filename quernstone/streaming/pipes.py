"""Event pipes: filters, buffers, debouncing, throttling, distinct events, batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fork(stream: DataFrame, when: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that fulfil a condition, and the rest."""
    ok = F.coalesce(when, F.lit(False))
    return stream.where(ok), stream.where(~ok)


def merge(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def buffer(stream: DataFrame, ts: str, every: str, late: str, *keys: str) -> DataFrame:
    """Rows and values gathered by tumbling windows of event time; rows later than `late` are dropped, which the watermark says."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def debounce(stream: DataFrame, ts: str, quiet: str, late: str, key: str) -> DataFrame:
    """The last row of each burst of a key: a session that a quiet while ends."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, quiet), key).agg(F.max_by("value", ts).alias("value"), F.count("*").alias("n"))


def throttle(stream: DataFrame, ts: str, every: str, late: str, key: str) -> DataFrame:
    """The first row of a key in each window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.min_by("value", ts).alias("value"))


def distinct(stream: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Rows with keys not seen within a while."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def count_buffer(stream: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, total) of every so many rows of a key; what is left waits for more."""

    def each(k, parts: Iterator[pd.DataFrame], state):
        n, total = state.get if state.exists else (0, 0.0)
        out = []
        for pdf in parts:
            for v in pdf["value"]:
                n, total = n + 1, total + float(v)
                if n == size:
                    out.append((k[0], n, total))
                    n, total = 0, 0.0
        state.update((n, total))
        yield pd.DataFrame(out, columns=["key", "n", "total"])

    return stream.groupBy(key).applyInPandasWithState(each, "key long, n long, total double", "n long, total double", "append", "NoTimeout")


def failure_rate(stream: DataFrame, key: str, last: int, rate: float) -> DataFrame:
    """(key, rate, triggered) after each batch, over the last so many rows (failed) of a key."""

    def each(k, parts: Iterator[pd.DataFrame], state):
        held = [c == "1" for c in state.get[0]] if state.exists else []
        for pdf in parts:
            held = (held + [bool(x) for x in pdf.sort_values("event_id")["failed"]])[-last:]
        state.update(("".join("1" if x else "0" for x in held),))
        share = sum(held) / max(len(held), 1)
        yield pd.DataFrame([(k[0], round(share, 4), share >= rate)], columns=["key", "rate", "triggered"])

    return stream.groupBy(key).applyInPandasWithState(each, "key long, rate double, triggered boolean", "held string", "update", "NoTimeout")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs work on every micro-batch that is there now."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project_into(stream: DataFrame, path: str, key: str, terminal: Column, order: list[Column], fields: dict[str, Column], checkpoint: str):
    """Keeps the projection at the path: each batch's terminal events go over the rows of their keys, older ones never over newer."""
    from ..operators.ledger import project
    from ..operators.tables import latest_per_key
    from ..sources.sinks import _swap, exists

    def work(batch: DataFrame, _: int) -> None:
        new = project(batch, key, terminal, order, fields)
        if exists(batch.sparkSession, path):
            new = latest_per_key(batch.sparkSession.read.parquet(path).unionByName(new), [key], order)
        _swap(new, path)

    return each_batch(stream, work, checkpoint)


def in_order(stream: DataFrame, key: str, seq: str, ts: str, wait: str, late: str) -> DataFrame:
    """(key, seq, value, missed): a key's events by their numbers, from 1 on, one after the other whatever the order they come in.

    An event whose predecessor isn't there is held back until it comes, or until event time has gone `wait` beyond the held event: then the
    missing numbers are passed over, and missed says how many before it. Numbers that come again, or after they were passed over, are left out.
    """
    pause = int(pd.Timedelta(wait).total_seconds() * 1000)

    def each(k, parts: Iterator[pd.DataFrame], state):
        upto, seqs, values, times = state.get if state.exists else (0, [], [], [])
        held = {s: (v, t) for s, v, t in zip(seqs, values, times)}
        now, out = state.getCurrentWatermarkMs(), []

        def release(upto):
            while held:
                first = min(held)
                if first != upto + 1 and held[first][1] + pause > now:
                    break
                out.append((k[0], first, held.pop(first)[0], first - upto - 1))
                upto = first
            return upto

        upto = release(upto)  # what has waited long enough goes before what comes now
        for pdf in parts:
            for s, v, t in zip(pdf["seq"], pdf["value"], pdf["ts"]):
                if s > upto and int(s) not in held:
                    held[int(s)] = (float(v), int(pd.Timestamp(t).timestamp() * 1000))
        upto = release(upto)
        seqs = sorted(held)
        state.update((upto, seqs, [held[s][0] for s in seqs], [held[s][1] for s in seqs]))
        if held:
            state.setTimeoutTimestamp(max(now + 1, held[seqs[0]][1] + pause))
        yield pd.DataFrame(out, columns=["key", "seq", "value", "missed"])

    own = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col("value").cast("double").alias("value"), F.col(ts).alias("ts")).withWatermark("ts", late)
    kept = "upto long, seqs array<long>, vals array<double>, times array<long>"
    return own.groupBy("key").applyInPandasWithState(each, f"key {own.schema["key"].dataType.simpleString()}, seq long, value double, missed long", kept, "append", "EventTimeTimeout")


def latest_wins(stream: DataFrame, key: str, event_id: str, ts: str, takes: str, late: str) -> DataFrame:
    """(key, event_id, value, done): each event starts work that takes a while, and a newer event of its key that comes meanwhile, by event time, puts an end to it; what is left is done that while later.

    The newer of two events of one time is the one with the greater id. What is done goes out once event time has passed it.
    """
    need = int(pd.Timedelta(takes).total_seconds() * 1000)

    def each(k, parts: Iterator[pd.DataFrame], state):
        held = list(zip(*state.get)) if state.exists else []
        for pdf in parts:
            held += [(int(pd.Timestamp(t).timestamp() * 1000), int(i), float(v)) for t, i, v in zip(pdf["ts"], pdf["event_id"], pdf["value"])]
        held = sorted(set(held))
        now, out = state.getCurrentWatermarkMs(), []
        while held and held[0][0] + need <= now:
            t, i, v = held.pop(0)
            if not held or held[0][0] >= t + need:
                out.append((k[0], i, v, pd.Timestamp(t + need, unit="ms")))
        if held:
            state.update(tuple(map(list, zip(*held))))
            state.setTimeoutTimestamp(max(now + 1, held[0][0] + need))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "value", "done"])

    own = stream.select(F.col(key).alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return own.groupBy("key").applyInPandasWithState(each, f"key {own.schema["key"].dataType.simpleString()}, event_id long, value double, done timestamp", "times array<long>, ids array<long>, vals array<double>", "append", "EventTimeTimeout")


def gap_lifecycle(stream: DataFrame, key: str, late: str, window_seconds: int) -> DataFrame:
    """(key, at, action, old, new): operators.learning.gap_transitions kept by micro-batches; observation windows end by timers of event time.

    The stream has (key, ts, event_id, kind). Events wait until event time has passed them, so that the order that they come in doesn't matter.
    """
    span = window_seconds * 1000

    def each(k, parts: Iterator[pd.DataFrame], state):
        status, deadline, task, times, ids, kinds = state.get if state.exists else ("open", -1, False, [], [], [])
        held = list(zip(times, ids, kinds))
        for pdf in parts:
            held += [(int(pd.Timestamp(t).timestamp() * 1000), int(i), str(kind)) for t, i, kind in zip(pdf["ts"], pdf["event_id"], pdf["kind"])]
        held = sorted(set(held))
        now, out = state.getCurrentWatermarkMs(), []
        put = lambda at, action, old, new: out.append((k[0], pd.Timestamp(at, unit="ms"), action, old, new))
        while True:
            due = held[0][0] if held else None
            if 0 <= deadline <= now and (due is None or deadline < due):
                put(deadline, "resolve", "observing", "resolved")
                status, deadline = "resolved", -1
                continue
            if due is None or due > now:
                break
            at, _, kind = held.pop(0)
            if kind == "fail" and status != "open":
                put(at, "reopen", status, "open")
                status, deadline = "open", -1
            elif kind == "pass" and status == "open":
                if task:
                    put(at, "close_task", "open", "open")
                put(at, "observe", "open", "observing")
                status, deadline, task = "observing", at + span, False
            elif kind == "repair" and status == "open" and not task:
                put(at, "open_task", "open", "open")
                task = True
        state.update((status, deadline, task, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]))
        wake = [x for x in (held[0][0] if held else -1, deadline) if x >= 0]
        if wake:
            state.setTimeoutTimestamp(max(now + 1, min(wake)))
        yield pd.DataFrame(out, columns=["key", "at", "action", "old", "new"])

    own = stream.select(F.col(key).alias("key"), "ts", F.col("event_id").cast("long").alias("event_id"), "kind").withWatermark("ts", late)
    kept = "status string, deadline long, task boolean, times array<long>, ids array<long>, kinds array<string>"
    return own.groupBy("key").applyInPandasWithState(each, f"key {own.schema["key"].dataType.simpleString()}, at timestamp, action string, old string, new string", kept, "append", "EventTimeTimeout")
