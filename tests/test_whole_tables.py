"""Queries without SQL read all rows of their tables."""

import duckdb

from quernstone.queries import QUERIES


def merged(rows):
    """Rows (key, id, merged_into, recalls, queries, n_tags) of greedy merging, from (user_id, event_type) rows."""
    users: dict = {}
    for user, kind in rows:
        users.setdefault(user, []).append(kind)
    out = []
    for key in {u % 7 for u in users}:
        ids = sorted(u for u in users if u % 7 == key)
        tags, recalls, into = {u: set(users[u]) for u in ids}, {u: len(users[u]) for u in ids}, {}
        queries = {u: len(t) for u, t in tags.items()}
        for n, a in enumerate(ids):
            for b in ids[n + 1 :] if a not in into else []:
                if b not in into and len(tags[a] & tags[b]) / len(tags[a] | tags[b]) >= 0.6:
                    into[b] = a
                    recalls[a] += recalls[b]
                    queries[a] += queries[b]
                    tags[a] |= tags[b]
        out += [(key, u, into.get(u), recalls[u], queries[u], len(tags[u])) for u in ids]
    return sorted(out, key=str)


def test_memory_merge_reads_late_events(spark, tmp_path):
    duckdb.sql(
        "select i as event_id, (i * 7919 % 61)::bigint as user_id, ['view', 'click', 'error', 'signup', 'purchase'][(i * i + i // 61) % 5 + 1] as event_type from range(1900, 2150) r(i)"
    ).write_parquet(f"{tmp_path}/events.parquet")
    rows = duckdb.sql(f"select user_id, event_type from '{tmp_path}/events.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["memory_merge"](spark, str(tmp_path)).collect()), key=str)
    assert got == merged(rows)
    assert sum(r[3] for r in got if r[2] is None) == 250
