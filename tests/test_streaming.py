from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quernstone.streaming import pipes

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double"


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, u, START + timedelta(seconds=s), k, float(v)) for n, u, s, k, v in rows], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/b={i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


BATCHES = [[(1, 1, 0, "click", 5), (2, 1, 4, "error", 6), (3, 2, 5, "click", 7)], [(4, 1, 65, "click", 8), (5, 2, 70, "purchase", 9), (3, 2, 5, "click", 7)], [(6, 1, 200, "error", 1), (7, 9, 900, "click", 1)]]


def test_buffer_and_bursts(spark, tmp_path):
    s = feed(spark, tmp_path, BATCHES)
    got = {(r.window.start, r.user_id): (r.n, r.total) for r in drain(pipes.buffer(s, "ts", "1 minute", "10 seconds", "user_id"), "buffered")}
    assert got[(START, 1)] == (2, 11.0) and got[(START + timedelta(minutes=1), 2)] == (1, 9.0)
    quiet = drain(pipes.debounce(s, "ts", "30 seconds", "10 seconds", "user_id"), "quiet")
    assert {(r.user_id, r.value) for r in quiet} >= {(1, 6.0), (1, 8.0), (2, 7.0)}
    first = drain(pipes.throttle(s, "ts", "1 minute", "10 seconds", "user_id"), "first")
    assert (1, 5.0) in {(r.user_id, r.value) for r in first}


def test_distinct_fork_merge(spark, tmp_path):
    s = feed(spark, tmp_path, BATCHES)
    errors, rest = pipes.fork(s, F.col("event_type") == "error")
    assert len(drain(pipes.distinct(pipes.merge(errors, rest), "event_id", "ts", "1 hour"), "once")) == 7


def test_count_buffer_and_failure_rate(spark, tmp_path):
    s = feed(spark, tmp_path, BATCHES)
    assert [tuple(r) for r in drain(pipes.count_buffer(s.select("user_id", "value"), "user_id", 3), "threes") if r.key == 1] == [(1, 3, 19.0)]
    own = s.select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    last = [r for r in drain(pipes.failure_rate(own, "user_id", 3, 0.5), "rates", "update") if r.key == 1][-1]
    assert (last.rate, last.triggered) == (0.6667, True)


def test_projection_like_the_batch(spark, tmp_path):
    from quernstone.operators.ledger import project

    s = feed(spark, tmp_path, BATCHES)
    args = ("user_id", F.col("event_type") != "click", [F.desc("ts"), F.desc("event_id")], {"status": F.col("event_type"), "ts": F.col("ts"), "event_id": F.col("event_id")})
    path = f"file://{tmp_path}/out"
    pipes.project_into(s, path, *args, checkpoint=f"file://{tmp_path}/cp").awaitTermination()
    want = project(spark.read.schema(SCHEMA).parquet(f"file://{tmp_path}/in/*"), *args)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, want.collect()))


def feed_rows(spark, tmp_path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r[:-1], START + timedelta(seconds=r[-1])) for r in rows], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def test_in_order_holds_back_and_passes_over(spark, tmp_path):
    batches = [[("a", 2, 20.0, 2), ("a", 1, 10.0, 1), ("b", 3, 3.0, 3)], [("a", 4, 40.0, 5), ("b", 1, 1.0, 4), ("a", 1, 11.0, 6)], [("a", 3, 30.0, 7), ("b", 5, 5.0, 8)], [("z", 1, 0.0, 500)], [("b", 4, 4.0, 501), ("z", 2, 0.0, 900)]]
    got = drain(pipes.in_order(feed_rows(spark, tmp_path, "k string, seq long, value double, ts timestamp", batches), "k", "seq", "ts", "60 seconds", "10 seconds"), "ordered")
    by = lambda k: [(r.seq, r.value, r.missed) for r in got if r.key == k]
    assert by("a") == [(1, 10.0, 0), (2, 20.0, 0), (3, 30.0, 0), (4, 40.0, 0)]
    # number 2 never comes: 3 goes out when its time is over, then 5, and 4 is too late
    assert by("b") == [(1, 1.0, 0), (3, 3.0, 1), (5, 5.0, 1)]


def test_latest_wins_like_the_batch(spark, tmp_path):
    import random

    rng = random.Random(3)
    events, s = [], 0
    for i in range(120):
        s += rng.choice([0, 1, 2, 15, 40])
        events.append((f"k{rng.randint(0, 3)}", i, float(i), s))
    mixed = [events[i : i + 20] for i in range(0, 120, 20)]
    for a, b in zip(mixed, mixed[1:]):  # a few come a batch late, within what is allowed
        b.insert(0, a.pop())
    for m in mixed:
        rng.shuffle(m)
    mixed.append([("end", 999, 0.0, s + 5000)])
    schema = "k string, id long, value double, ts timestamp"
    stream = feed_rows(spark, tmp_path, schema, mixed)
    got = {(r.key, r.event_id, r.value) for r in drain(pipes.latest_wins(stream, "k", "id", "ts", "20 seconds", "500 seconds"), "latest")}
    want = set()
    for k in {e[0] for e in events}:
        own = sorted((e[3], e[1], e[2]) for e in events if e[0] == k)
        want |= {(k, i, v) for n, (at, i, v) in enumerate(own) if n + 1 == len(own) or own[n + 1][0] >= at + 20}
    assert got == want and 0 < len(want) < 120


def test_gap_lifecycle_like_the_batch(spark, tmp_path):
    import random

    from quernstone.operators.learning import gap_transitions

    rng = random.Random(9)
    events, s = [], 0
    for i in range(200):
        s += rng.choice([1, 5, 30, 90])
        events.append((f"g{rng.randint(0, 4)}", i, rng.choice(["fail", "pass", "repair", "other", "pass", "repair"]), s))
    mixed = [events[i : i + 25] for i in range(0, 200, 25)]
    for m in mixed:
        rng.shuffle(m)
    mixed.append([("end", 999, "other", s + 9000)])
    schema = "key string, event_id long, kind string, ts timestamp"
    stream = feed_rows(spark, tmp_path, schema, mixed)
    got = sorted((r.key, r.at, r.action, r.old, r.new) for r in drain(pipes.gap_lifecycle(stream, "key", "1000 seconds", 120), "gaps"))
    rows = spark.read.schema(schema).parquet(f"file://{tmp_path}/in/*")
    until = F.lit(START + timedelta(seconds=s + 8000))
    want = sorted((r.key, r["at"], r.action, r.old, r.new) for r in gap_transitions(rows, "key", 120, until).collect())
    assert got == want and {w[2] for w in want} == {"open_task", "close_task", "observe", "resolve", "reopen"}
    state = {}
    for key, _, action, old, new in sorted(want, key=lambda w: (w[0], w[1], ["close_task", "observe", "resolve", "reopen", "open_task"].index(w[2]))):
        status, task = state.get(key, ("open", False))
        assert old == status and (action != "open_task" or not task) and (action != "close_task" or task)
        state[key] = (new, action == "open_task" or (task and action not in ("close_task", "open_task")))
