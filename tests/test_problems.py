"""The general problems against brute force: nulls, ties, repetitions, hot keys, empty tables, clashing columns."""

import random
from collections import Counter

from pyspark.sql import functions as F

from codeloom.operators import features, heavy_keys, orphans, runs


def references(spark, rows):
    return spark.createDataFrame(rows, "ref_field string, ref_key string, neighbour string, ref_row long, weight long")


def test_key_counts_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("f", "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), n, 1) for n in range(400)]
    got = {(r[0], r[1]): r[2] for r in heavy_keys.key_counts(references(spark, rows + rows[:50]), chunks=9).collect()}
    assert got == Counter((f, k) for f, k, *_ in rows)


def test_neighbours_are_counted_once(spark):
    rows = [("f", "k", n, i, 1) for i, n in enumerate(["x", "x", None, "y", None, "x"])]
    got = heavy_keys.key_neighbours(references(spark, rows), chunks=4).collect()
    assert [tuple(r) for r in got] == [("f", "k", 6, 2, None, "y")]


def test_heavy_share_counts_null_keys_in_the_total(spark):
    rows = [("f", "k", "x", n, 1) for n in range(2)] + [("f", None, "x", n, 1) for n in range(2, 100)]
    counts = heavy_keys.key_counts(references(spark, rows))
    assert [r["ref_key"] for r in heavy_keys.heavy_keys(counts).collect()] == ["k"]
    assert heavy_keys.heavy_keys(counts, 0.03).count() == 0


def test_called_by_lengths(spark, make_entities):
    rows = make_entities([{"id": "a::x", "called_by": ["p", "q", None]}, {"id": "a::y", "called_by": None}, {"id": "a::z", "called_by": []}])
    each, whole = heavy_keys.called_by_references(rows), heavy_keys.called_by_references(rows, each=False)
    assert each.count() == 3
    assert {r["ref_key"]: r["weight"] for r in whole.collect()} == {"a::x": 3, "a::y": 0, "a::z": 0}


def test_orphans_like_brute_force(spark):
    rng = random.Random(2)
    ids = ["hot"] * 20 + list("abcde")
    ranges = []
    for i in "abcd" + "hot":
        for _ in range(rng.randint(1, 3)):
            start = rng.randint(0, 100)
            ranges.append((i, start, start + rng.randint(1, 30)))
    ranges += [("hot", s, s + rng.randint(1, 8)) for s in range(0, 100, 7)]
    refs = [(rng.choice(["f", "g"]), n, rng.choice(ids), rng.randint(0, 130)) for n in range(600)]
    live = lambda i, t: any(k == i and s <= t < e for k, s, e in ranges)
    expected = sorted({r for r in refs if not live(r[2], r[3])})
    df = spark.createDataFrame(refs + refs[:100], "ref_field string, row_id long, ref_id string, at long")
    lives = spark.createDataFrame(ranges + ranges[:5], "ref_id string, at long, until long")
    for chunks in (1, 3, 11):
        got = orphans.orphan_references(df, lives, chunks).select("ref_field", "row_id", "ref_id", "at").collect()
        assert sorted(map(tuple, got)) == expected


def test_orphan_edges_of_time(spark, make_entities, make_edges, at):
    entities = make_entities([{"id": "a::x", "indexed_at": at(10), "deleted_at": at(20)}, {"id": "a::x", "indexed_at": at(30), "calls": [None, "print", "gone::f"], "called_by": None}])
    edges = spark.createDataFrame([(1, "a::x", None, at(10)), (2, "a::x", "a::x", at(20)), (3, "a::x", "a::x", at(30))], "edge_id long, src string, dst string, recorded_at timestamp_ntz")
    refs = orphans.all_references(entities, edges)
    found = orphans.orphan_references(refs, orphans.live_ranges(entities)).withColumn("period", orphans.period_of(F.col("at")))
    got = {(r["ref_field"], r["row_id"], r["ref_id"], r["period"]) for r in found.collect()}
    assert got == {("edges.src", 2, "a::x", "2024-03"), ("edges.dst", 2, "a::x", "2024-03"), ("entities.calls", 1, "gone::f", "2024-03")}


def test_orphans_without_parents_or_references(spark):
    refs = spark.createDataFrame([("f", 1, "a", 5)], "ref_field string, row_id long, ref_id string, at long")
    none = spark.createDataFrame([], "ref_id string, at long, until long")
    assert orphans.orphan_references(refs, none).count() == 1
    assert orphans.orphan_references(refs.limit(0), none).count() == 0


def test_runs_of_a_session(spark, make_actions):
    actions = make_actions(
        [
            {"file_path": "src/./a.rs", "action_type": "File-Read"},
            {"file_path": "src\\a.rs", "action_type": "file_read", "duration_ms": None},
            {"file_path": None},
            {"file_path": None},
            {"file_path": "src//a.rs"},
            {"file_path": "src/a.rs", "action_type": "error"},
            {"file_path": "src/a.rs", "session_id": "t"},
            {"file_path": "src/a.rs", "session_id": "t"},
        ]
    )
    again = actions.where("id = 'a001'").withColumn("logged_at", F.col("logged_at") + F.expr("interval 1 hour"))
    collapsed = runs.collapse_runs(actions.unionByName(again).withColumn("chunk", F.lit("clash")), chunks=3)
    assert collapsed.count() == 6
    got = {(r["session_id"], r["first_id"], r["last_id"], r["n_actions"], r["total_ms"], r["span_us"]) for r in runs.repeated_runs(collapsed).collect()}
    assert got == {("s", "a000", "a001", 2, 1, 1_000_000), ("t", "a006", "a007", 2, 2, 1_000_000)}
    assert runs.collapse_runs(actions.limit(0)).count() == 0


def state_rows(df):
    return sorted(map(tuple, df.select("file_path", "action_type", "tool", "n", "total_ms", "last_at").collect()), key=repr)


def test_deltas_end_where_a_full_count_does(spark, make_actions, at):
    rng = random.Random(3)
    first = [{"id": f"i{n}", "file_path": rng.choice("ab"), "tool": rng.choice(["t", None]), "ts": at(rng.randint(0, 50)), "logged_at": at(n), "duration_ms": rng.choice([None, 5])} for n in range(60)]
    # later deliveries: unchanged, moved to another file, back in time, null file (not a feature event), new
    later = [{**r, "logged_at": at(500 + n)} for n, r in enumerate(first[:10])]
    later += [{**r, "file_path": "c", "logged_at": at(600 + n)} for n, r in enumerate(first[10:20])]
    later += [{**r, "ts": at(0), "logged_at": at(700 + n)} for n, r in enumerate(sorted(first, key=lambda r: r["ts"])[-15:])]
    later += [{"id": f"n{n}", "file_path": "a", "ts": at(60 + n), "logged_at": at(800 + n)} for n in range(3)] + [{"id": "z", "file_path": None, "logged_at": at(900)}]
    known = features.last_versions(features.feature_events(make_actions(first)))
    deltas = features.signed_deltas(known, features.feature_events(make_actions(later)))
    got = features.apply_deltas(features.initial_state(known), known, deltas)
    whole = features.initial_state(features.last_versions(features.feature_events(make_actions(first + later))))
    assert state_rows(got) == state_rows(whole)


def test_redeliveries_retract(spark, make_actions, at):
    rows = [{"id": "a", "ts": at(5), "duration_ms": 3}, {"id": "b", "ts": at(1), "file_path": "b.rs"}, {"id": "c", "logged_at": None, "ts": at(9)}, {"id": "d", "ts": at(7)}]
    again = [{"id": "a", "ts": at(2), "duration_ms": 4, "logged_at": at(50)}, {"id": "b", "ts": at(1), "file_path": "b.rs", "logged_at": at(60)}, {"id": "c", "ts": at(3), "logged_at": at(70)}, {"id": "a", "logged_at": at(40)}]
    log = make_actions(rows + again)
    events = features.feature_events(log.unionByName(log.where("id = 'd'")))
    both = features.deliveries(events)
    deltas = features.redeliveries(both)
    assert Counter((r["id"], r["sign"]) for r in deltas.collect()) == {(i, s): 1 for i in "abc" for s in (-1, 1)}
    known = both.select("id", "first.*")
    same = features.signed_deltas(known, events)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in deltas.select(same.columns).collect()}
    got = features.apply_deltas(features.initial_state(known), known, deltas)
    whole = features.initial_state(features.last_versions(events))
    assert {tuple(r) for r in got.select(whole.columns).collect()} == {tuple(r) for r in whole.collect()}
    # c's latest event was retracted: the maximum is d's now
    assert got.where("file_path = 'a.rs'").first()["last_at"] == features.feature_events(log).where("id = 'd'").first()["at"]


def test_the_query_replays_with_retractions(spark):
    from codeloom.sources.tables import load

    both = features.deliveries(features.feature_events(load(spark, "/root/testdata/sf0.01", "actions")))
    signs = dict(map(tuple, features.redeliveries(both).groupBy("sign").count().collect()))
    assert signs[-1] == signs[1] > 100


def test_feature_rows_and_columns(spark, make_actions):
    events = features.feature_events(make_actions([{"tool": "t"}, {"tool": "t", "action_type": "ERROR"}, {"tool": None}]))
    rows = features.feature_rows(features.initial_state(features.last_versions(events)), events.agg(F.max("at")).first()[0])
    r = features.feature_columns(rows, [("file_read", "t"), ("error", "t"), ("error", "u")]).first()
    assert (r["n_actions"], r["n_pairs"], r["n__file_read__t"], r["since_us__error__t"], r["n__error__u"], r["since_us__error__u"]) == (3, 3, 1, 1_000_000, 0, None)
