"""Quality signals, problems, gaps, retests and memory scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import numbers as N
from ..functions import text as T
from .tables import top_k

#: Points that a signal of each kind gives towards severity.
SEVERITY = {"failure": 20, "violation": 15, "repeat": 5, "topology": 8}
NEGATIVE_POINTS, NEGATIVE_RATING = 3, 2
#: Allowed moves between gap states.
TRANSITIONS = {"open": ["in_progress", "blocked"], "in_progress": ["observing", "open", "blocked"], "observing": ["resolved", "in_progress", "open"], "blocked": ["open"], "resolved": ["open", "observing"]}
#: Seconds until the next try, by the number of tries so far.
BACKOFF = [300, 900, 3600, 14400, 86400]
#: Weights of the six dimensions of a memory's score.
DIMENSIONS = {"recency": 0.15, "frequency": 0.25, "uniqueness": 0.20, "utility": 0.20, "confidence": 0.10, "stability": 0.10}


def rolling_failure(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], failed: Column, last: int, rate: float) -> DataFrame:
    """Adds failing: more than `rate` of the last so many rows failed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("failing", F.avg(F.when(failed, 1.0).otherwise(0.0)).over(w) > rate)


def failure_trigger(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], failed: Column, last: int, least: int, rate: float) -> DataFrame:
    """For each key the failure rate of its last rows, and whether it reaches the rate on enough of them."""
    from .tables import latest_per_key

    recent = latest_per_key(rows, keys, order, last)
    out = recent.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    share = F.col("failures") / F.col("n")
    return out.withColumn("rate", F.round(share, 4)).withColumn("triggered", (F.col("n") >= least) & (share >= rate))


def severity(signals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points of signals (kind, rating), 100 at most."""
    points = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in SEVERITY.items()], F.when((F.col("kind") == "feedback") & (F.col("rating") <= NEGATIVE_RATING), F.lit(NEGATIVE_POINTS)), F.lit(0))
    return signals.groupBy(*keys).agg(F.least(F.sum(points), F.lit(100)).cast("int").alias("severity"))


def problems(signals: DataFrame, least_violations: int = 2) -> DataFrame:
    """One problem for each (route, category), with the greatest confidence: repeated failures, low ratings, violations."""
    by = signals.groupBy("route").agg(
        F.count_if(F.col("kind") == "failure").alias("failures"), F.count_if(F.col("kind") == "violation").alias("violations"), F.avg(F.when(F.col("kind") == "feedback", F.col("rating"))).alias("rating"),
        F.max("duration").alias("max_duration"), F.count("*").alias("n"),
    )
    rule = lambda when, category, confidence: F.when(when, F.struct(F.lit(category).alias("category"), F.round(confidence, 4).alias("confidence")))
    found = F.array(
        rule(F.col("failures") >= 3, "continuous_failure", F.least(F.lit(0.95), 0.5 + F.col("failures") / F.col("n") / 2)),
        rule(F.col("violations") >= least_violations, "contract", F.least(F.lit(0.95), 0.4 + 0.05 * F.col("violations"))),
        rule(F.col("rating") < 3, "low_rating", F.least(F.lit(0.95), (5 - F.col("rating")) / 5)),
    )
    return by.select("route", "max_duration", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("route", "max_duration", "p.category", "p.confidence")


def tag_trends(rows: DataFrame, tags: Column, weights: dict[str, float], share: float = 0.2, least: int = 5, weight: float = 30) -> DataFrame:
    """Tags with their share of rows and weight, and whether they trigger."""
    total = rows.agg(F.count("*").alias("total"))
    own = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    w = F.col("n") * F.coalesce(*[F.when(F.col("tag") == t, F.lit(float(v))) for t, v in weights.items()], F.lit(1.0))
    return own.select("tag", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), F.round(w, 2).alias("weight"), ((F.col("n") >= least) & (w > weight)).alias("triggered")).where(F.col("n") / F.col("total") >= share)


def gap_priority(confidence: Column, severity: Column, quality: Column, refused: Column, frequency: Column, scope_bonus: Column) -> Column:
    """Points from 0 to 100. Half points of confidence round to even."""
    points = F.least(F.lit(60), F.bround(F.greatest(F.lit(0.0), confidence) * 60).cast("int"))
    sev = F.when(severity == "high", 20).when(severity == "medium", 12).when(severity == "low", 6).otherwise(8)
    qual = F.when(quality == "failure", 12).when(quality == "weak", 6).otherwise(0)
    freq = F.least(F.lit(12), F.greatest(F.lit(0), frequency - 1) * 3)
    return F.least(F.lit(100), points + sev + qual + freq + F.when(refused, 8).otherwise(0) + scope_bonus).cast("int")


def transitions(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_status string, to_status string")


def valid_moves(moves: DataFrame) -> DataFrame:
    """Moves (from_status, to_status) with whether the state machine allows them."""
    ok = F.broadcast(transitions(moves.sparkSession).withColumn("valid", F.lit(True)))
    return moves.join(ok, ["from_status", "to_status"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def passing(quality: Column, refused: Column, generic: Column, chunks: Column, ok: Column) -> Column:
    return F.coalesce(ok & (quality == "good") & ~refused & ~generic & (chunks > 0), F.lit(False))


def retest_decision(status: Column, policy: Column, passes: Column, window_over: Column) -> Column:
    """(action, status) after a live retest."""
    to = lambda action, s: F.struct(F.lit(action).alias("action"), (F.lit(s) if isinstance(s, str) else s).alias("status"))
    return (
        F.when(policy, to("block_policy", "blocked")).when(passes & (status == "observing") & window_over, to("resolve_after_observation", "resolved")).when(passes, to("observe_fixed", "observing"))
        .when(status.isin("observing", "resolved"), to("reopen", "open")).otherwise(to("keep_open", status))
    )


def outcome(query_type: Column, refused: Column, chunks: Column, confidence: Column, gain: Column, error: Column) -> Column:
    """(family, code, quality) of an interaction."""
    to = lambda f, c, q: F.struct(F.lit(f).alias("family"), F.lit(c).alias("code"), F.lit(q).alias("quality"))
    return (
        F.when(error.isNotNull() & (error != ""), to("failed", "FAILED", "failure")).when(query_type == "chitchat", to("non_task", "EARLY_EXIT_CHITCHAT", "non_task"))
        .when(query_type == "irrelevant", to("non_task", "EARLY_EXIT_IRRELEVANT", "non_task")).when(refused | (chunks == 0), to("refused", "REFUSED_INSUFFICIENT_EVIDENCE", "failure"))
        .when((confidence < 0.5) | (gain < 0.3), to("answered", "ANSWERED_WEAK_EVIDENCE", "weak")).otherwise(to("answered", "ANSWERED_OK", "good"))
    )


def run_gaps(runs: DataFrame, samples: int = 5) -> DataFrame:
    """Weak runs clustered by type and normalised query, with how many spellings a cluster has, as far as so many samples. Spellings are gathered first, so that a hot question is a few rows."""
    own = runs.withColumn("normal", T.normalised(F.col("query")))
    most = {"confidence": F.col("confidence"), "chunks": F.col("chunks"), "last_seen": F.col("ts"), "refused": F.col("refused").cast("int")}
    spelled = own.groupBy("query_type", "normal", "query").agg(*[F.max(c).alias(n) for n, c in most.items()], F.count("*").alias("frequency"))
    return spelled.groupBy("query_type", "normal").agg(*[F.max(n).alias(n) for n in most], F.sum("frequency").alias("frequency"), F.least(F.count("query"), F.lit(samples)).cast("int").alias("samples"))


def retest_queue(requests: DataFrame) -> DataFrame:
    """One entry for each question hash, with the greatest priority."""
    own = requests.withColumn("question_hash", T.question_hash(F.col("question")))
    return own.groupBy("question_hash").agg(F.max("priority").alias("priority"), F.min("due").alias("due"), F.max("tries").alias("tries"))


def retest_batch(queue: DataFrame, now: Column, k: int) -> DataFrame:
    return top_k(queue.where(F.col("due") <= now), k, F.desc("priority"), F.col("due"), F.col("question_hash"))


def backoff(tries: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(tries, F.lit(len(BACKOFF) - 1)) + 1)


def memory_score(recency: Column, recalls: Column, queries: Column, sessions: Column, gain: Column, confidence: Column, days_known: Column) -> Column:
    one = lambda c: F.least(F.lit(1.0), c)
    parts = {"recency": recency, "frequency": one(recalls / 10), "uniqueness": one((queries * 0.4 + sessions * 0.6) / 8), "utility": one(gain / 2 + 0.3), "confidence": one(confidence), "stability": one(F.greatest(F.lit(1.0), days_known) / 30)}
    total = F.lit(0.0)
    for name, weight in DIMENSIONS.items():
        total = total + parts[name] * weight
    return total


def tiered(score: Column, days: Column) -> list[Column]:
    """Tier, decay, adjusted score and days to the next review."""
    tier = N.tier_of(score)
    decay = N.tier_decay(days, tier)
    return [tier.alias("tier"), F.round(decay, 6).alias("decay"), F.round(score * decay * N.by_tier(tier, N.TIER_WEIGHTS), 6).alias("adjusted"), F.round(F.greatest(F.lit(1.0), N.half_life(tier) / 3), 4).alias("review_days")]


def demotions(history: DataFrame, key: str, order: Sequence[Column], tier: str = "tier", window: int = 3) -> DataFrame:
    """For each assessment whether it moves the memory: up at once, down when it and the pending ones before it all say the same.

    The first assessment gives the tier to begin with. Pending ones are the last `window` that said less than the tier
    then, since the last move up. Each step hangs on the one before, so a key's rows pass in order, one at a time.
    """
    level = F.coalesce(*[F.when(F.col(tier) == t, F.lit(i)) for i, t in enumerate(N.TIERS)])
    own = history.withColumn("level", level)
    at = own.columns.index(key)

    def each(batches):
        now = current = None
        pending: list[int] = []
        begun = False
        for b in batches:
            moves = []
            for k, new in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if not begun or k != now:
                    begun, now, current, pending = True, k, new, []
                    moves.append(False)
                    continue
                if new is None or current is None or new == current:
                    moves.append(False)
                elif new > current:
                    pending = []
                    moves.append(True)
                else:
                    pending = [*pending, new][-window:]
                    moves.append(len(pending) >= 2 and set(pending) == {new})
                if moves[-1] or current is None:
                    current = new
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(moves, pa.bool_())], names=[*b.schema.names, "moves"])

    schema = types.StructType([*own.schema.fields, types.StructField("moves", types.BooleanType())])
    return own.repartition(key).sortWithinPartitions(key, *order).mapInArrow(each, schema)


def merge_memories(rows: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """Greedy merging by tag similarity within each key, in id order: (key, id, merged_into, recalls, queries, tags).

    A memory takes in later ones, with tags grown by those before; each step hangs on the last, so a key's
    candidates are handled together.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        into: dict[int, int] = {}
        tags = [set(x) for x in pdf["tags"]]
        recalls, queries = pdf["recalls"].tolist(), pdf["queries"].tolist()
        for i in range(len(pdf)):
            if i in into:
                continue
            for j in range(i + 1, len(pdf)):
                if j not in into and tags[i] and tags[j] and len(tags[i] & tags[j]) / len(tags[i] | tags[j]) >= least:
                    into[j] = i
                    recalls[i] += recalls[j]
                    queries[i] += queries[j]
                    tags[i] = tags[i] | tags[j]
        return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "merged_into": pd.array([pdf["id"][into[i]] if i in into else None for i in range(len(pdf))], "Int64"), "recalls": recalls, "queries": queries, "n_tags": [len(x) for x in tags]})

    own = rows.select(F.col(key).alias("key"), "id", "tags", "recalls", "queries")
    return own.groupBy("key").applyInPandas(each, "key long, id long, merged_into long, recalls long, queries long, n_tags long")


def convergence(rounds: DataFrame, key: str, least: int, most: int, target: float, small: float) -> DataFrame:
    """For each round (n, score) why it stops, if it does."""
    before = F.lag("score").over(Window.partitionBy(key).orderBy("n"))
    own = rounds.withColumn("before", before)
    why = F.when(F.col("n") < least, "continue").when(F.col("score") >= target, "target").when(F.abs(F.col("score") - F.col("before")) < small, "converged").when(F.col("n") >= most, "max_iterations").otherwise("continue")
    return own.withColumn("reason", why).drop("before")


def quality(chunks: DataFrame, answers: DataFrame, key: str = "query_id") -> DataFrame:
    """Seven retrieval scores for each query: chunks (key, source, score, content), answers (key, answer, rounds)."""
    by = chunks.groupBy(key).agg(F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.countDistinct("source").alias("sources"), F.sum(F.length("content")).alias("chars"))
    own = answers.join(by, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cites = F.size(F.regexp_extract_all("answer", F.lit(r"\[\d+\]"), F.lit(0))) + F.size(F.regexp_extract_all("answer", F.lit("【[^】]+】"), F.lit(0)))
    div = F.least(zero("sources") / 3, F.lit(1.0))
    complete = F.least(zero("chars") / 2000, F.lit(0.95))
    steady = F.when(F.col("var").isNull(), 0.5).otherwise(F.greatest(F.lit(0.5), 1 - F.col("var")))
    fact = F.least(0.6 + cites * 0.1, F.lit(0.95))
    conf = (complete + steady + fact + div) / 4
    r = lambda c, name: F.round(c, 4).alias(name)
    return own.select(
        key, r(complete, "completeness"), r(steady, "consistency"), r(conf, "confidence"), r(F.greatest(F.lit(0.1), 0.5 - F.col("rounds") * 0.1), "information_gain"), r(div, "source_diversity"), r(fact, "fact_consistency"),
        r(F.least(zero("mean") * div * 1.5, F.lit(0.95)), "coverage_estimate"), ((conf >= 0.7) & (fact >= 0.6)).alias("passed"),
    )


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's tokens, and of its numbers, that the context has."""
    a, c = T.distinct_tokens(answer), T.distinct_tokens(context)
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"\d+\.?\d*"), F.lit(0))
    own = F.filter(numbers(answer), lambda n: F.length(n) >= 2)
    words = F.least(F.lit(1.0), 1.5 * T.overlap_share(a, c))
    grounded = F.size(F.filter(own, lambda n: F.array_contains(numbers(context), n))) / F.size(own)
    return F.when(F.size(a) == 0, 0.5).when(F.size(own) > 0, F.round(0.6 * grounded + 0.4 * words, 4)).otherwise(F.round(words, 4))


def relevancy(question: Column, answer: Column) -> Column:
    q, a = T.distinct_tokens(question), T.distinct_tokens(answer)
    share = T.overlap_share(q, a)
    return F.when(F.size(q) == 0, 0.5).when(F.length(F.trim(answer)) < 8, F.round(0.6 * share, 4)).otherwise(F.round(F.least(F.lit(1.0), 1.5 * share), 4))


def run_summary(runs: DataFrame, feedback: DataFrame, order: Sequence[Column], feedback_order: Sequence[Column], most: int = 500, tools: int = 20) -> DataFrame:
    """Rows (part, key, n, value) over the last runs (quality, refused, confidence, tools, query_type) and the last feedback (rating).

    Parts: runs, quality, refused, confidence (n runs that have one, value their mean to three places), tool (the most frequent
    ones, ties by name), type, feedback (positive, negative, total). Good, weak and failure are there even with no run; a missing quality or type is 'unknown'.
    """
    last = top_k(runs, most, *order)
    told = top_k(feedback, most, *feedback_order)
    none = F.lit(None).cast("double")
    row = lambda part, key, n, value=none: F.struct(F.lit(part).alias("part"), F.lit(key).alias("key"), n.cast("long").alias("n"), value.alias("value"))
    quality = F.coalesce("quality", F.lit("unknown"))
    totals = last.agg(F.array(
        row("runs", "", F.count("*")), row("refused", "", F.count_if("refused")), row("confidence", "", F.count("confidence"), F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0))),
        *[row("quality", q, F.count_if(quality == q)) for q in ("good", "weak", "failure")],
    ).alias("x")).select(F.inline("x"))
    counted = lambda part, rows: rows.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", "n", none.alias("value"))
    other = counted("quality", last.select(quality.alias("key")).where("key not in ('good', 'weak', 'failure')"))
    used = top_k(counted("tool", last.select(F.explode("tools").alias("key"))), tools, F.desc("n"), F.col("key"))
    types = counted("type", last.select(F.coalesce("query_type", F.lit("unknown")).alias("key")))
    heard = told.agg(F.array(row("feedback", "positive", F.count_if(F.col("rating") > 0)), row("feedback", "negative", F.count_if(F.col("rating") < 0)), row("feedback", "total", F.count("*"))).alias("x")).select(F.inline("x"))
    return totals.unionByName(other).unionByName(used).unionByName(types).unionByName(heard)


def gap_transitions(events: DataFrame, key: str, window_seconds: int, until: Column) -> DataFrame:
    """(key, at, action, old, new): what becomes of each gap by its events (ts, event_id, kind) up to a time.

    A gap is open. Evidence that passes (kind 'pass') puts it under observation; if none that fails ('fail') comes within the window it is
    resolved, by itself; if some comes, then or later, it is open again. A repair that is asked for ('repair') while the gap is open opens a task, unless
    one is; the pass closes it. Other kinds, and what changes nothing, leave no row. Event by event in time, then id. Events that fail next after one
    that passes cut a gap's history into stretches, and what happens in a stretch are sums over it.
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    own = events.where(F.col("kind").isin("pass", "fail", "repair") & (F.col("ts") <= until))
    before = F.last(F.when(F.col("kind") != "repair", F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("cut", F.coalesce(((F.col("kind") == "fail") & (before == "pass")).cast("int"), F.lit(0)))
    own = own.withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("ts", "event_id")))
    runs = own.groupBy(key, "stretch").agg(first("fail").alias("fail"), first("pass").alias("passed"), first("repair").alias("asked"))
    runs = runs.withColumns({"end": F.lead("fail.ts").over(Window.partitionBy(key).orderBy("stretch")), "deadline": F.col("passed.ts") + F.make_dt_interval(secs=F.lit(window_seconds))})
    resolved = F.col("passed").isNotNull() & (F.col("deadline") <= until) & (F.col("end").isNull() | (F.col("end") > F.col("deadline")))
    asked = F.col("asked").isNotNull() & (F.col("passed").isNull() | (F.col("asked") < F.col("passed")))
    row = lambda when, at, action, old, new: F.when(when, F.struct(at.alias("at"), F.lit(action).alias("action"), (F.lit(old) if isinstance(old, str) else old).alias("old"), F.lit(new).alias("new")))
    passed, ended = F.col("passed").isNotNull(), F.col("passed").isNotNull() & F.col("end").isNotNull()
    steps = F.array(
        row(asked, F.col("asked.ts"), "open_task", "open", "open"), row(asked & passed, F.col("passed.ts"), "close_task", "open", "open"), row(passed, F.col("passed.ts"), "observe", "open", "observing"),
        row(resolved, F.col("deadline"), "resolve", "observing", "resolved"), row(ended, F.col("end"), "reopen", F.when(resolved, "resolved").otherwise("observing"), "open"),
    )
    return runs.select(key, F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def failure_signals(runs: DataFrame, now: Column, hours: int = 24, slow_ms: int = 5000, most: int = 100) -> DataFrame:
    """(run_id, ts, kind, duration_ms) of the last runs (run_id, ts, quality, duration_ms, outcome) of the last hours that failed, or took longer than slow_ms without being good or no task; runs answered well after all are left out. At most `most`, the latest first."""
    recent = runs.where((F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= now) & ~F.col("outcome").eqNullSafe("ANSWERED_OK"))
    failed = F.coalesce(F.col("quality") == "failure", F.lit(False))
    slow = F.coalesce(F.col("duration_ms") > slow_ms, F.lit(False)) & ~F.coalesce(F.col("quality").isin("good", "non_task"), F.lit(False))
    kind = F.when(failed, "failure").when(slow, "slow")
    return top_k(recent.withColumn("kind", kind).where("kind is not null"), most, F.desc("ts"), F.desc("run_id")).select("run_id", "ts", "kind", "duration_ms")


def keep_open_history(evidence: DataFrame, most: int = 5) -> DataFrame:
    """The last retests (gap_key, evidence_id, ts, evidence_type, decision) of each gap that left it open, numbered from the latest, 20 at most."""
    kept = evidence.where("evidence_type = 'live_retest' and decision = 'keep_open'")
    n = F.row_number().over(Window.partitionBy("gap_key").orderBy(F.desc("ts"), F.desc("evidence_id")))
    return kept.withColumn("n", n).where(F.col("n") <= max(1, min(most, 20)))
