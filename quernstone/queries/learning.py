"""Ledger projections, signals, problems, gaps, retests, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import learning as L
from ..operators import ledger as LG
from ..operators import tables as O
from .registry import query, t


@query("""
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    n AS (SELECT user_id, event_type, k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM e WHERE event_type IN ('purchase', 'error', 'signup'))
    SELECT user_id AS run_id, event_type AS status, k, event_id FROM n WHERE i = 1
""")
def run_projection(spark, sf):
    ev = t(spark, sf, "events")
    return LG.project(ev, "user_id", F.col("event_type").isin("purchase", "error", "signup"), [F.desc("ts"), F.desc("event_id")], {"status": F.col("event_type"), "k": F.get_json_object("props", "$.k").cast("long"), "event_id": F.col("event_id")}).withColumnRenamed("user_id", "run_id")


@query("SELECT 0 AS drift")
def projection_rebuild_has_no_drift(spark, sf):
    ev = t(spark, sf, "events")
    build = lambda df: LG.project(df, "user_id", F.lit(True), [F.desc("ts"), F.desc("event_id")], {"status": F.col("event_type"), "event_id": F.col("event_id")})
    return O.drift(build(ev), build(ev.unionByName(ev).dropDuplicates(["event_id"])), ["user_id"], ["status", "event_id"]).agg(F.count("*").cast("int").alias("drift"))


@query("""
    SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY md5(user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d')) ORDER BY ts, event_id) AS i FROM events) WHERE i = 1
""")
def idempotent_append(spark, sf):
    ev = t(spark, sf, "events")
    key = F.md5(F.concat_ws(":", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")).cast("binary"))
    return LG.idempotent(ev.withColumn("key", key), "key", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


_SIGNALS = """
    sig AS (SELECT event_id, user_id % 12 AS route, ts, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'repeat' WHEN 'signup' THEN 'violation' WHEN 'purchase' THEN 'topology' ELSE 'feedback' END AS kind,
            CASE WHEN event_type = 'click' THEN CAST(user_id % 5 + 1 AS DOUBLE) END AS rating, value AS duration FROM events)
"""


def _signals(spark, sf):
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in (("error", "failure"), ("view", "repeat"), ("signup", "violation"), ("purchase", "topology"))], F.lit("feedback"))
    return t(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 12).alias("route"), "ts", kind.alias("kind"), F.when(F.col("event_type") == "click", (F.col("user_id") % 5 + 1).cast("double")).alias("rating"), F.col("value").alias("duration")
    )


@query(f"""
    WITH {_SIGNALS}, w AS (SELECT * FROM sig)
    SELECT route, CAST(least(100, sum(CASE kind WHEN 'failure' THEN 20 WHEN 'violation' THEN 15 WHEN 'repeat' THEN 5 WHEN 'topology' THEN 8 ELSE CASE WHEN rating <= 2 THEN 3 ELSE 0 END END)) AS INTEGER) AS severity FROM w GROUP BY 1
""")
def signal_severity(spark, sf):
    return L.severity(_signals(spark, sf), ["route"])


@query(f"""
    WITH {_SIGNALS}, b AS (SELECT route, count(*) FILTER (kind = 'failure') AS f, count(*) FILTER (kind = 'violation') AS v, avg(CASE WHEN kind = 'feedback' THEN rating END) AS r, max(duration) AS max_duration, count(*) AS n FROM sig GROUP BY 1)
    SELECT route, max_duration, 'continuous_failure' AS category, round(least(0.95, 0.5 + f / n / 2), 4) AS confidence FROM b WHERE f >= 3
    UNION ALL SELECT route, max_duration, 'contract', round(least(0.95, 0.4 + 0.05 * v), 4) FROM b WHERE v >= 2
    UNION ALL SELECT route, max_duration, 'low_rating', round(least(0.95, (5 - r) / 5), 4) FROM b WHERE r < 3
""")
def detect_problems(spark, sf):
    return L.problems(_signals(spark, sf))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS rate,
           count(*) >= 5 AND count(*) FILTER (event_type = 'error') / count(*) >= 0.3 AS triggered FROM r WHERE i <= 20 GROUP BY 1
""")
def failure_trigger(spark, sf):
    return L.failure_trigger(t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error", 20, 5, 0.3)


@query("""
    WITH x AS (SELECT unnest([event_type, 'user' || (user_id % 3)]) AS tag FROM events), n AS (SELECT tag, count(*) AS n FROM x GROUP BY 1), c AS (SELECT count(*) AS total FROM events)
    SELECT tag, n, round(n / total, 4) AS share, round(CAST(n * CASE tag WHEN 'error' THEN 2.0 ELSE 1.0 END AS DOUBLE), 2) AS weight, n >= 5 AND n * CASE tag WHEN 'error' THEN 2.0 ELSE 1.0 END > 30 AS triggered FROM n, c WHERE n / total >= 0.2
""")
def feedback_trends(spark, sf):
    tags = F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")))
    return L.tag_trends(t(spark, sf, "events"), tags, {"error": 2.0})


@query("""
    SELECT doc_id, CAST(least(100, least(60, CAST(round_even(greatest(0, c) * 60, 0) AS INTEGER)) + CASE doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 12 WHEN 2 THEN 6 ELSE 8 END + CASE WHEN quality = 0 THEN 12 ELSE 6 END
        + least(12, greatest(0, doc_id % 6 - 1) * 3) + CASE WHEN toxic = 1 THEN 8 ELSE 0 END + 5) AS INTEGER) AS priority FROM (SELECT *, doc_id % 97 / 97.0 AS c FROM labels)
""")
def gap_priority(spark, sf):
    sev = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("none")), (F.col("doc_id") % 4 + 1).cast("int"))
    quality = F.when(F.col("quality") == 0, "failure").otherwise("weak")
    return t(spark, sf, "labels").select("doc_id", L.gap_priority(F.col("doc_id") % 97 / 97.0, sev, quality, F.col("toxic") == 1, F.col("doc_id") % 6, F.lit(5)).alias("priority"))


_STATUS = "(['open', 'in_progress', 'observing', 'blocked', 'resolved'])[{} + 1]"


def _status(n):
    return F.element_at(F.array(*map(F.lit, ("open", "in_progress", "observing", "blocked", "resolved"))), (n + 1).cast("int"))


@query(f"""
    WITH m AS (SELECT event_id, {_STATUS.format('user_id % 5')} AS from_status, {_STATUS.format('event_id % 5')} AS to_status FROM events)
    SELECT event_id, from_status, to_status, (from_status, to_status) IN (('open', 'in_progress'), ('open', 'blocked'), ('in_progress', 'observing'), ('in_progress', 'open'), ('in_progress', 'blocked'), ('observing', 'resolved'),
        ('observing', 'in_progress'), ('observing', 'open'), ('blocked', 'open'), ('resolved', 'open'), ('resolved', 'observing')) AS valid FROM m
""")
def gap_state_machine(spark, sf):
    m = t(spark, sf, "events").select("event_id", _status(F.col("user_id") % 5).alias("from_status"), _status(F.col("event_id") % 5).alias("to_status"))
    return L.valid_moves(m).select("event_id", "from_status", "to_status", "valid")


@query(f"""
    WITH m AS (SELECT event_id, {_STATUS.format('user_id % 5')} AS s, event_type = 'signup' AS policy, value > 20 AND event_type <> 'error' AS pass, event_id % 2 = 0 AS over FROM events)
    SELECT event_id, CASE WHEN policy THEN 'block_policy' WHEN pass AND s = 'observing' AND over THEN 'resolve_after_observation' WHEN pass THEN 'observe_fixed' WHEN s IN ('observing', 'resolved') THEN 'reopen' ELSE 'keep_open' END AS action,
           CASE WHEN policy THEN 'blocked' WHEN pass AND s = 'observing' AND over THEN 'resolved' WHEN pass THEN 'observing' WHEN s IN ('observing', 'resolved') THEN 'open' ELSE s END AS status FROM m
""")
def retest_decision(spark, sf):
    e = t(spark, sf, "events")
    passes = L.passing(F.lit("good"), F.col("event_type") == "error", F.lit(False), F.when(F.col("value") > 20, 1).otherwise(0), F.lit(True))
    d = L.retest_decision(_status(F.col("user_id") % 5), F.col("event_type") == "signup", passes, F.col("event_id") % 2 == 0)
    return e.select("event_id", d.alias("d")).select("event_id", "d.action", "d.status")


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'signup' THEN 'EARLY_EXIT_CHITCHAT' WHEN user_id % 9 = 0 OR event_id % 6 = 0 THEN 'REFUSED_INSUFFICIENT_EVIDENCE'
           WHEN value / 100 < 0.5 OR user_id % 10 / 10.0 < 0.3 THEN 'ANSWERED_WEAK_EVIDENCE' ELSE 'ANSWERED_OK' END AS code FROM events
""")
def outcome_classifier(spark, sf):
    got = L.outcome(F.when(F.col("event_type") == "signup", "chitchat").otherwise("task"), F.col("user_id") % 9 == 0, F.col("event_id") % 6, F.col("value") / 100, F.col("user_id") % 10 / 10.0, F.when(F.col("event_type") == "error", "timeout"))
    return t(spark, sf, "events").select("event_id", got["code"].alias("code"))


@query("""
    WITH r AS (SELECT role AS query_type, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS normal, turn, length(text) AS n FROM conversations)
    SELECT query_type, normal, max(n / 1000.0) AS confidence, max(turn) AS last_seen, max((turn % 2 = 0)::INT) AS refused, count(*) AS frequency FROM r GROUP BY 1, 2
""")
def run_gap_clusters(spark, sf):
    r = t(spark, sf, "conversations").select(F.col("role").alias("query_type"), F.col("text").alias("query"), (F.length("text") / 1000.0).alias("confidence"), F.lit(1).alias("chunks"), F.col("turn").alias("ts"), (F.col("turn") % 2 == 0).alias("refused"))
    return L.run_gaps(r).select("query_type", "normal", "confidence", "last_seen", "refused", "frequency")


@query("""
    WITH old AS (SELECT user_id AS gap, (['observing', 'resolved', 'open'])[user_id % 3 + 1] AS status, user_id % 10 / 10.0 AS confidence, user_id % 50 AS priority, 100 AS first_seen, 200 AS last_seen, 150 + user_id % 7 * 20 AS verified, 1 AS reopen_count FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 <> 0),
    new AS (SELECT user_id AS gap, 'open' AS status, user_id % 7 / 10.0 AS confidence, user_id % 60 AS priority, 90 + user_id % 30 AS first_seen, 210 AS last_seen FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0),
    j AS (SELECT coalesce(o.gap, n.gap) AS gap, o.status AS os, n.status AS ns, o.confidence AS oc, n.confidence AS nc, o.priority AS op, n.priority AS np, o.first_seen AS of_, n.first_seen AS nf, o.last_seen AS ol, n.last_seen AS nl, o.verified AS v, o.reopen_count AS rc,
          coalesce(n.status = 'open' AND o.status IN ('observing', 'resolved') AND n.last_seen > o.verified, false) AS again FROM old o FULL JOIN new n ON o.gap = n.gap)
    SELECT gap, CASE WHEN again THEN 'open' ELSE coalesce(os, ns) END AS status, greatest(oc, nc) AS confidence, greatest(op, np) AS priority, least(of_, nf) AS first_seen, greatest(ol, nl) AS last_seen, v AS verified, coalesce(rc, 0) + again::INT AS reopen_count FROM j
""")
def gap_merge(spark, sf):
    u = t(spark, sf, "events").select("user_id").distinct()
    x = F.col("user_id")
    name = F.element_at(F.array(F.lit("observing"), F.lit("resolved"), F.lit("open")), (x % 3 + 1).cast("int"))
    i = lambda n: F.lit(n).cast("long")
    old = u.where("user_id % 4 <> 0").select(x.alias("gap"), name.alias("status"), (x % 10 / 10.0).alias("confidence"), (x % 50).alias("priority"), i(100).alias("first_seen"), i(200).alias("last_seen"), (150 + x % 7 * 20).alias("verified"), F.lit(1).alias("reopen_count"))
    new = u.where("user_id % 3 <> 0").select(x.alias("gap"), F.lit("open").alias("status"), (x % 7 / 10.0).alias("confidence"), (x % 60).alias("priority"), (90 + x % 30).alias("first_seen"), i(210).alias("last_seen"), F.lit(None).cast("long").alias("verified"), F.lit(0).alias("reopen_count"))
    return O.merge_gaps(old, new, "gap")


@query("""
    WITH q AS (SELECT substr(sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))), 1, 16) AS question_hash, max(length(text) % 100) AS priority, min(turn) AS due, max(turn % 7) AS tries FROM conversations GROUP BY 1)
    SELECT question_hash, priority, due, ([300, 900, 3600, 14400, 86400])[least(tries, 4) + 1] AS delay FROM q WHERE due <= 3 ORDER BY priority DESC, due, question_hash LIMIT 50
""")
def retest_batch(spark, sf):
    r = t(spark, sf, "conversations").select(F.col("text").alias("question"), (F.length("text") % 100).alias("priority"), F.col("turn").alias("due"), (F.col("turn") % 7).cast("int").alias("tries"))
    return L.retest_batch(L.retest_queue(r), F.lit(3), 50).select("question_hash", "priority", "due", L.backoff(F.col("tries")).alias("delay"))


_MEM = """
    m AS (SELECT user_id, count(*) AS recalls, count(DISTINCT event_type) AS q, count(DISTINCT CAST(ts AS DATE)) AS s, round(avg(value) / 200, 4) AS gain, datediff('day', CAST(max(ts) AS DATE), DATE '2024-02-15') AS days, datediff('day', CAST(min(ts) AS DATE), DATE '2024-02-15') AS known FROM events GROUP BY 1),
    s AS (SELECT user_id, days, round(exp(-pow(days / 14.0, 1.5)) * 0.15 + least(1, recalls / 100) * 0.25 + least(1, (q * 0.4 + s * 0.6) / 8) * 0.2 + least(1, gain / 2 + 0.3) * 0.2 + 0.05 + least(1, greatest(1, known) / 30) * 0.1, 6) AS score FROM m)
"""


def _memory(spark, sf):
    today = F.lit("2024-02-15").cast("date")
    m = t(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("recalls"), F.countDistinct("event_type").alias("q"), F.countDistinct(F.to_date("ts")).alias("s"), F.round(F.avg("value") / 200, 4).alias("gain"), F.datediff(today, F.to_date(F.max("ts"))).alias("days"), F.datediff(today, F.to_date(F.min("ts"))).alias("known")
    )
    score = L.memory_score(N.tier_decay(F.col("days"), F.lit("working")), F.col("recalls") / 10, F.col("q"), F.col("s"), F.col("gain"), F.lit(0.5), F.col("known"))
    return m.select("user_id", "days", F.round(score, 6).alias("score"))


@query(f"""
    WITH {_MEM}, t AS (SELECT *, CASE WHEN score >= 0.7 THEN 'core' WHEN score >= 0.4 THEN 'working' ELSE 'peripheral' END AS tier FROM s),
    p AS (SELECT *, CASE tier WHEN 'core' THEN 2.5 WHEN 'working' THEN 1.5 ELSE 0.8 END AS k, CASE tier WHEN 'core' THEN 60.0 WHEN 'working' THEN 14.0 ELSE 7.0 END AS l, CASE tier WHEN 'core' THEN 0.95 WHEN 'working' THEN 0.75 ELSE 0.55 END AS w FROM t)
    SELECT user_id, score, tier, round(CASE WHEN days <= 0 THEN 1 ELSE exp(-pow(days / l, k)) END, 6) AS decay, round(score * CASE WHEN days <= 0 THEN 1 ELSE exp(-pow(days / l, k)) END * w, 6) AS adjusted, round(greatest(1, l * pow(ln(2), 1 / k) / 3), 4) AS review_days FROM p
""")
def memory_tiers(spark, sf):
    return _memory(spark, sf).select("user_id", "score", *L.tiered(F.col("score"), F.col("days")))


@query("""
    WITH RECURSIVE h AS (SELECT event_id, user_id, CASE WHEN value >= 70 THEN 2 WHEN value >= 40 THEN 1 ELSE 0 END AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (
        SELECT user_id, n, event_id, level AS current, CAST([] AS INTEGER[]) AS pending, false AS moves FROM h WHERE n = 1
        UNION ALL
        SELECT user_id, n, event_id, CASE WHEN level > current OR (level < current AND len(pending) >= 2 AND len(list_distinct(pending)) = 1) THEN level ELSE current END, pending,
               level > current OR (level < current AND len(pending) >= 2 AND len(list_distinct(pending)) = 1)
        FROM (SELECT h.user_id, h.n, h.event_id, h.level, r.current, CASE WHEN h.level > r.current THEN CAST([] AS INTEGER[]) WHEN h.level < r.current THEN list_append(r.pending, h.level)[-3:] ELSE r.pending END AS pending
              FROM r JOIN h ON h.user_id = r.user_id AND h.n = r.n + 1)
    )
    SELECT event_id, moves FROM r
""")
def demotion_hysteresis(spark, sf):
    h = t(spark, sf, "events").withColumn("tier", F.when(F.col("value") >= 70, "core").when(F.col("value") >= 40, "working").otherwise("peripheral"))
    return L.demotions(h, "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "moves")


@query()
def memory_merge(spark, sf):
    rows = t(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"), F.count("*").alias("recalls"), F.countDistinct("event_type").alias("queries"))
    return L.merge_memories(rows.select((F.col("user_id") % 7).alias("key"), F.col("user_id").alias("id"), "tags", "recalls", "queries"), "key")


@query("""
    WITH r AS (SELECT conv_id, turn AS n, round(length(text) % 100 / 100, 4) AS score FROM conversations), b AS (SELECT *, lag(score) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM r)
    SELECT conv_id, n, CASE WHEN n < 2 THEN 'continue' WHEN score >= 0.9 THEN 'target' WHEN abs(score - p) < 0.1 THEN 'converged' WHEN n >= 5 THEN 'max_iterations' ELSE 'continue' END AS reason FROM b
""")
def convergence_policy(spark, sf):
    r = t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("n"), F.round(F.length("text") % 100 / 100, 4).alias("score"))
    return L.convergence(r, "conv_id", 2, 5, 0.9, 0.1).select("conv_id", "n", "reason")


@query("""
    WITH c AS (SELECT conv_id AS query_id, avg(turn % 4 / 4) AS mean, var_pop(turn % 4 / 4) AS var, count(DISTINCT role) AS sources, sum(length(text)) AS chars FROM conversations WHERE turn > 0 GROUP BY 1),
    a AS (SELECT conv_id AS query_id, any_value(text) AS answer FROM conversations WHERE turn = 0 GROUP BY 1),
    x AS (SELECT a.query_id, least(coalesce(chars, 0) / 2000, 0.95) AS complete, CASE WHEN var IS NULL THEN 0.5 ELSE greatest(0.5, 1 - var) END AS steady, least(coalesce(sources, 0) / 3, 1.0) AS div,
          least(0.6 + (len(regexp_extract_all(answer, '\\[[0-9]+\\]')) + len(regexp_extract_all(answer, '【[^】]+】'))) * 0.1, 0.95) AS fact, coalesce(mean, 0) AS mean FROM a LEFT JOIN c ON a.query_id = c.query_id)
    SELECT query_id, round(complete, 4) AS completeness, round(steady, 4) AS consistency, round((complete + steady + fact + div) / 4, 4) AS confidence, CAST(0.4 AS DOUBLE) AS information_gain, round(div, 4) AS source_diversity, round(CAST(fact AS DOUBLE), 4) AS fact_consistency,
           round(least(mean * div * 1.5, 0.95), 4) AS coverage_estimate, (complete + steady + fact + div) / 4 >= 0.7 AND fact >= 0.6 AS passed FROM x
""")
def retrieval_quality(spark, sf):
    c = t(spark, sf, "conversations")
    chunks = c.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("role").alias("source"), (F.col("turn") % 4 / 4).alias("score"), F.col("text").alias("content"))
    answers = c.where("turn = 0").groupBy(F.col("conv_id").alias("query_id")).agg(F.first("text").alias("answer")).withColumn("rounds", F.lit(1))
    return L.quality(chunks, answers)


@query("""
    SELECT count(*) AS total, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS refused, count(DISTINCT doc_id) AS docs, round(count(*) FILTER (quality = 1) / count(*) * 100, 2) AS effectiveness, greatest(0, 100 - 10 * count(*) FILTER (toxic = 1 AND quality = 0)) AS health FROM labels
""")
def learning_health(spark, sf):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return t(spark, sf, "labels").agg(
        F.count("*").alias("total"), F.count_if(good).alias("good"), F.count_if(toxic).alias("refused"), F.countDistinct("doc_id").alias("docs"), F.round(F.count_if(good) / F.count("*") * 100, 2).alias("effectiveness"), F.greatest(F.lit(0), 100 - 10 * F.count_if(toxic & ~good)).alias("health")
    )


@query("""
    WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
    SELECT CASE WHEN user_id % 5 IN (0, 1) THEN 'active' WHEN user_id % 5 = 2 THEN 'observing' WHEN user_id % 5 = 3 THEN 'blocked' ELSE 'resolved' END AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS failing FROM l WHERE i = 1 GROUP BY 1
""")
def workbench_buckets(spark, sf):
    last = O.latest_per_key(t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    s = _status(F.col("user_id") % 5)
    return last.groupBy(F.when(s.isin("open", "in_progress"), "active").otherwise(s).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failing"))


@query("""
    SELECT user_id, count(*) AS evidence, max(event_id) AS last_event FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80) GROUP BY 1 HAVING count(*) >= 3
""")
def repair_promotion(spark, sf):
    e = t(spark, sf, "events")
    own = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("evidence"), F.max("event_id").alias("last_event")).where("evidence >= 3")
    return own.join(e.where("event_type = 'purchase' AND value > 80").select("user_id").distinct(), "user_id", "left_anti")


@query("SELECT user_id, CAST(coalesce(max(CASE WHEN event_type = 'click' THEN event_id END), 0) + 1 AS BIGINT) AS next_index FROM events GROUP BY 1")
def next_turn_index(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg((F.coalesce(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))), F.lit(0)) + 1).alias("next_index"))


@query("""
    WITH r AS (SELECT event_id AS run_id, ts, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'good' WHEN 'view' THEN 'non_task' WHEN 'click' THEN 'weak' END AS quality, value * 100 AS duration_ms, user_id % 10 = 0 AS fine FROM events)
    SELECT run_id, ts, CASE WHEN quality = 'failure' THEN 'failure' ELSE 'slow' END AS kind, duration_ms FROM r
    WHERE ts BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00' AND NOT fine AND (quality IS NOT DISTINCT FROM 'failure' OR (duration_ms > 5000 AND coalesce(quality, '') NOT IN ('good', 'non_task'))) ORDER BY ts DESC, run_id DESC LIMIT 100
""")
def failure_signals(spark, sf):
    kind = F.col("event_type")
    quality = F.when(kind == "error", "failure").when(kind == "purchase", "good").when(kind == "view", "non_task").when(kind == "click", "weak")
    runs = t(spark, sf, "events").select(F.col("event_id").alias("run_id"), "ts", quality.alias("quality"), (F.col("value") * 100).alias("duration_ms"), F.when(F.col("user_id") % 10 == 0, "ANSWERED_OK").alias("outcome"))
    return L.failure_signals(runs, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("""
    SELECT user_id AS gap_key, event_id AS evidence_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM events WHERE event_type = 'click' AND value < 50 QUALIFY n <= 5
""")
def keep_open_history(spark, sf):
    kinds = (F.when(F.col("event_type") == "click", "live_retest").otherwise("note").alias("evidence_type"), F.when(F.col("value") < 50, "keep_open").otherwise("resolve").alias("decision"))
    return L.keep_open_history(t(spark, sf, "events").select(F.col("user_id").alias("gap_key"), F.col("event_id").alias("evidence_id"), "ts", *kinds)).select("gap_key", "evidence_id", "ts", "n")
