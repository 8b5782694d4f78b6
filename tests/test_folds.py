"""Closed forms of ordered folds against loops over events, on random logs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldlog.functions import columns as C
from foldlog.functions.ranking import dense_positions
from foldlog.operators import folds, snapshots
from foldlog.operators.filters import EventFilter, Filters, InvalidPosition, union_predicate

KINDS = ("add", "sub", "reset", "price", "note")


def random_log(seed, n=400, keys=6):
    rng = random.Random(seed)
    return [(p, f"k{rng.randrange(keys)}", rng.choice(KINDS), rng.randrange(100)) for p in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "position long, key string, kind string, x long").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_clamp_with_resets(spark, seed):
    rows, balance = random_log(seed), {}
    for _, k, kind, x in rows:
        b = balance.get(k, 0)
        balance[k] = {"add": b + x, "sub": max(0, b - x), "reset": x}.get(kind, b)
    change = F.when(F.col("kind").isin("add", "reset"), F.col("x")).when(F.col("kind") == "sub", -F.col("x")).otherwise(F.lit(0))
    out = folds.final(folds.clamped_with_resets(frame(spark, rows), change, F.col("kind") == "reset", "key"), ["balance"], "key")
    assert {r.key: r.balance for r in out.collect()} == balance


@pytest.mark.parametrize("seed", range(3))
def test_as_of_known_members_and_effects(spark, seed):
    rows = random_log(seed)
    price, seen, want = {}, set(), []
    for p, k, kind, x in rows:
        if kind == "price":
            price[k] = x
        if kind == "note":
            seen.add(k)
        want.append((p, price.get(k), k in seen))
    df = frame(spark, rows).withColumn("price", folds.as_of(F.when(F.col("kind") == "price", F.col("x")), "key")).withColumn("known", folds.known(F.col("kind") == "note", "key"))
    assert sorted((r.position, r.price, r.known) for r in df.collect()) == want
    inside = set()
    for _, k, kind, x in rows:
        element = (k, x % 7)
        if kind == "add":
            inside.add(element)
        if kind == "sub":
            inside.discard(element)
    op = F.when(F.col("kind") == "add", F.lit("add")).when(F.col("kind") == "sub", F.lit("remove"))
    out = folds.members(frame(spark, rows).withColumn("e", F.col("x") % 7), "e", op, "key")
    assert {(r.key, r.e) for r in out.collect()} == inside


def test_snapshot_and_tail_equal_replay_at_every_cut(spark):
    rows = random_log(9, 40)
    df = frame(spark, rows).where("kind = 'add'")
    state = lambda d: d.groupBy("key").agg(F.sum("x").alias("total"), F.count("*").alias("n"), F.max("position").alias("position"))
    full = sorted(map(tuple, state(df).collect()))
    for cut in (-1, 0, 7, 20, 39):
        out = snapshots.resume(state(df.where(F.col("position") <= cut)), state(df.where(F.col("position") > cut)), ["key"], {"total": F.sum, "n": F.sum, "position": F.max})
        assert sorted(map(tuple, out.collect())) == full


def test_offers(spark):
    old = spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("c", 5, 1)], "id string, position long, total long")
    new = spark.createDataFrame([("a", 6, 2), ("b", 5, 2), ("d", 1, 2)], "id string, position long, total long")
    assert {tuple(r) for r in snapshots.merge(old, new, ["id"], ["total"]).collect()} == {("a", 6, 2, "stored"), ("b", 5, 1, "declined"), ("c", 5, 1, "none"), ("d", 1, 2, "stored")}
    assert snapshots.every(2).due(2) and not snapshots.every(2).due(1) and snapshots.always.due(1) and not snapshots.never.due(99)
    df = spark.createDataFrame([("a", i) for i in range(7)], "id string, position long")
    assert [r.position for r in snapshots.stored_points(df, snapshots.every(3), "id").orderBy("position").collect()] == [2, 5]
    assert snapshots.stored_points(df, snapshots.never, "id").count() == 0


filters = st.lists(st.builds(EventFilter, st.sampled_from(KINDS), st.sampled_from([None, "s", "t"]), st.sampled_from([None, "1", "2"]), st.sampled_from([None, 0, 5, 9])), max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(filters)
def test_predicates_equal_matches(spark, found):
    rng = random.Random(1)
    rows = [(rng.choice("st"), rng.choice("12"), rng.choice(KINDS), p) for p in range(30)]
    df = spark.createDataFrame(rows, "aggregate_kind string, aggregate_id string, kind string, position long")
    want = [p for ak, ai, k, p in rows if any(f.matches({"aggregate_kind": ak, "aggregate_id": ai, "kind": k, "position": p}) for f in found)]
    assert [r.position for r in df.where(union_predicate(found)).orderBy("position").collect()] == want


def test_last_handler_of_a_kind_stands():
    f = Filters().event("a", 1).event_for("s", "a", "7", 2)
    assert len(f.specs) == 2 and f.handlers == {"a": 2}
    with pytest.raises(InvalidPosition):
        EventFilter("a").after_position(-1)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a::1", 5, 86_400_001), ("a", None, -1), ("a::b::c", 2, 0)], "key string, x long, ms long")
    out = df.select(C.split_key(F.col("key")).alias("p"), C.saturating_sub(F.lit(3), F.col("x")).alias("s"), C.epoch_day(F.col("ms")).alias("d"), C.storage_key("k:", "key").alias("k")).collect()
    assert [(r.p and tuple(r.p), r.s, r.d, r.k) for r in out] == [(("a", "1"), 0, 1, "k:a::1"), (None, 3, -1, "k:a"), (None, 1, 0, "k:a::b::c")]
    assert C.json_key("7") != C.json_key(7) and C.json_key(None) == "null" and C.json_key({"b": 1, "a": 2}) == '{"a":2,"b":1}'
    assert C.kebab_case("BankAccount") == "bank-account" and C.kebab_case("HTTPServer2") == "http-server2" and C.upper_camel("shop::order_placed") == "ShopOrderPlaced"


def test_dense_positions(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), i) for i in range(500)]
    out = dense_positions(spark.createDataFrame(rows, "key long, i long").repartition(4), "key", ["i"], start=10).collect()
    assert [(r.key, r.i) for r in sorted(out, key=lambda r: r.position)] == sorted(rows)
    assert sorted(r.position for r in out) == list(range(10, 510))
    assert dense_positions(spark.createDataFrame([], "key long, i long"), "key", ["i"]).count() == 0
