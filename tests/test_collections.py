"""Golden rows of collection queries, mutations, sources and jobs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladle.operators import collection as c
from ladle.operators import jobs, mutate, quality, similar
from ladle.schemas import COLLECTIONS
from ladle.sources import io

AT = F.lit("2026-01-02 00:00:00").cast("timestamp")
TABLE = "_pos long, _id string, s string, n int, created_at timestamp, updated_at timestamp"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def t(spark):
    old = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(k, f"i{k}", s, n, old, old) for k, (s, n) in enumerate([("a", 1), ("a", 2), ("b", 3), (None, 4)])], TABLE)


def test_compare_last_wins_and_fills(spark):
    a = spark.createDataFrame([("x", 1.0, 0), ("x", 2.0, 1), ("y", None, 2)], "name string, price double, _pos int")
    b = spark.createDataFrame([("y", 3.0, 0), ("z", 4.0, 1)], "name string, price double, _pos int")
    assert rows(c.compare_sides(a, b, "name", "price", "_pos"), "key", "left_value", "right_value") == [("x", 2.0, 0.0), ("y", 0.0, 3.0), ("z", 0.0, 4.0)]


def test_locale_order(spark):
    names = spark.createDataFrame([(x,) for x in "zéBba"], "key string")
    assert [r.key for r in c.ordered_by_name(names).collect()] == ["a", "b", "B", "é", "z"]


def test_mutations(t):
    assert rows(mutate.update_one(t, {"s": "a"}, {"n": 9}, at=AT), "_pos", "n") == [(0, 9), (1, 2), (2, 3), (3, 4)]
    assert rows(mutate.update_one(t, {"s": "none"}, {"n": 9}, at=AT), "_pos", "n") == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(mutate.update_many(t, {"s": "a"}, {"n": 9}, at=AT), "_pos", "n") == [(0, 9), (1, 9), (2, 3), (3, 4)]
    changed = mutate.update_many(t, {"s": "a"}, {"n": 9}, at=AT)
    assert changed.filter("updated_at > created_at").count() == 2
    assert rows(mutate.delete_one(t, {"s": "a"}), "_pos") == [(1,), (2,), (3,)]
    assert rows(mutate.delete_many(t, {"s": "a"}), "_pos") == [(2,), (3,)]
    assert rows(mutate.delete_many(t, {"n": {"$gt": 2}}), "_pos") == [(0,), (1,)]
    with pytest.raises(ValueError):
        mutate.delete_many(t, {})
    assert mutate.delete_many(t, {}, allow_all=True).count() == 0
    assert rows(mutate.bulk_update_ordered(t, [({"s": "a"}, {"s": "c"}), ({"s": "a"}, {"s": "d"})], at=AT).fillna("-"), "_pos", "s") == [(0, "c"), (1, "d"), (2, "b"), (3, "-")]
    assert rows(mutate.unset(t, {"s": "b"}, "n").fillna(-1), "_pos", "n") == [(0, 1), (1, 2), (2, -1), (3, 4)]
    assert mutate.counters(t, mutate.delete_many(t, {"s": "a"}), {"s": "a"}).first().asDict() == {"matched": 2, "deleted": 2}


def test_insert_and_upsert(spark, t):
    new = spark.createDataFrame([("given", "x"), (None, "y")], "_id string, s string")
    out = mutate.insert_many(t, new, AT)
    assert out.count() == 6 and out.filter("_id IS NULL").count() == 0 and out.filter("_id = 'given' AND created_at = updated_at").count() == 1
    up = mutate.upsert(t, spark.createDataFrame([("i1", "u", 7), ("new", "v", 8)], "_id string, s string, n int"), "_id", ["s", "n"])
    assert {(r._id, r.s, r.n) for r in up.collect()} >= {("i1", "u", 7), ("new", "v", 8), ("i0", "a", 1)} and up.count() == 5
    with pytest.raises(ValueError):
        mutate.assert_unique(t, "s")
    assert mutate.assert_unique(t, "_id") is t


def test_bulk_update_last_wins(spark, t):
    u = spark.createDataFrame([("i0", 5, 0), ("i0", 6, 1), ("i2", None, 2), ("gone", 1, 3)], "_id string, n int, _seq int")
    assert rows(mutate.bulk_update(t, u, "_id", ["n"], at=AT).fillna(-1), "_pos", "n") == [(0, 6), (1, 2), (2, -1), (3, 4)]


def test_page_is_held_to_bounds(t):
    assert [r._pos for r in c.page(t, None, "n", limit=0, offset=-5).collect()] == [3]
    assert c.page(t, None, "n", limit=999).count() == 4


def test_collections_round_trip(spark, tmp_path, t):
    (tmp_path / "users.json").write_text('[{"_id": "1", "email": "a@b"}, {"_id": "2"}]')
    users = io.read_collection(spark, str(tmp_path / "users.json"), COLLECTIONS["users"])
    assert rows(users.fillna("-"), "_id", "email") == [("1", "a@b"), ("2", "-")]
    for schema in COLLECTIONS.values():
        assert io.empty_collection(spark, schema).count() == 0
    root = str(tmp_path / "t")
    io.write_collection(t, root)
    io.write_collection(mutate.delete_many(io.read_current(spark, root), {"s": "a"}), root)
    assert io.read_current(spark, root).count() == 2
    (tmp_path / "log.jsonl").write_text('{"time": 1, "e": "a"}\nbroken\n{"time": 3, "e": "c"}\n{"time": 2, "e": "b"}\n')
    assert [r.e for r in io.tail_log(spark, str(tmp_path / "log.jsonl"), "time long, e string", 2).collect()] == ["c", "b"]


def test_images_are_bounded(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x" * 10)
    (tmp_path / "b.png").write_bytes(b"x" * 100)
    assert io.read_images(spark, str(tmp_path), 50).count() == 1


def test_backoff_and_dead_letters(spark):
    df = spark.createDataFrame([(str(r), "s", "processing", r, 3, dt.datetime(2026, 1, 1)) for r in range(4)], "_id string, scan_id string, status string, retries int, max_retries int, created_at timestamp")
    after, dead = jobs.fail(df, AT, F.lit("e" * 3000), F.lit("s"))
    waits = {r._id: (r.retry_at - dt.datetime(2026, 1, 2)).total_seconds() if r.retry_at else None for r in after.collect()}
    assert waits == {"0": 5, "1": 10, "2": 20, "3": None}
    assert [(r.job_id, len(r.error)) for r in dead.collect()] == [("3", 2000)] and {r.status for r in after.collect()} == {"queued", "failed"}


def test_thresholds(spark):
    d = [("none", 0.5, None)] * 3 + [("mix", x, 1.0 if k < 8 else None) for k, x in enumerate([0.6] * 10)] + [("few", 0.2 + k / 100, None) for k in range(10)]
    got = {r.doc: r.threshold for r in quality.adaptive_threshold(spark.createDataFrame(d, "doc string, confidence double, price double"), "doc").collect()}
    assert got == pytest.approx({"none": 0.2, "mix": 0.42, "few": 0.25 * 0.8})


def test_three_sigma(spark):
    df = spark.createDataFrame([("a", 10.0)] * 10 + [("a", 1000.0)] + [("b", 10.0)] * 4 + [("b", 1000.0)], "g string, v double")
    out = quality.three_sigma_null(df, ["g"], "v")
    assert out.filter("g = 'a' AND v IS NULL").count() == 1 and out.filter("g = 'b' AND v IS NULL").count() == 0


def test_greedy_dedup_keeps_the_shortest(spark):
    df = spark.createDataFrame([(0, "d", "a b c d"), (1, "d", "a b c"), (2, "d", "x y")], "_pos long, doc string, name string")
    assert rows(quality.greedy_dedup(df, "doc"), "_pos", "name") == [(0, "a b c"), (2, "x y")]


def test_fuzzy_pairs_are_all_pairs_that_match(spark):
    import random

    rng = random.Random(8)
    names = {" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(60)}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    both = df.select(F.col("n").alias("a")).crossJoin(df.select(F.col("n").alias("b"))).filter((F.col("a") < F.col("b")) & quality.names_match(F.col("a"), F.col("b")))
    assert rows(quality.fuzzy_pairs(df, "n"), "a", "b") == rows(both, "a", "b")


def test_similar_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(9)
    df = spark.createDataFrame([(k, k % 2, [rng.choice("abcdefg") for _ in range(rng.randint(1, 6))]) for k in range(80)], "k int, block int, w array<string>").withColumn("w", F.array_distinct("w"))
    l, r = df.alias("l"), df.alias("r")
    s = quality.jaccard(F.col("l.w"), F.col("r.w"))
    both = l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.k") < F.col("r.k"))).filter(s >= 0.7).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"))
    assert rows(quality.similar_pairs(df, "block", "k", F.col("w")), "a", "b") == rows(both, "a", "b")


def test_pairs_of_similar_sets_reach_a_shuffle_only_where_they_may_link(spark):
    # 60 sets of 40 words: all share 15, which are ranked last or, with heavy=1, first; two near copies of each, one with a null block
    rng = random.Random(3)
    table = []
    for k in range(60):
        words = [f"c{x}" for x in range(15)] + [f"w{k}-{x}" for x in range(25)]
        table += [(3 * k, "x", words), (3 * k + 1, "x", words[:-1] + ["new"]), (3 * k + 2, rng.choice(["x", None]), words[2:] + ["a", "b"])]
    df = spark.createDataFrame(table, "k long, block string, w array<string>")
    l, r = df.alias("l"), df.alias("r")
    s = quality.jaccard(F.col("l.w"), F.col("r.w"))
    both = l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.k") < F.col("r.k"))).filter(s >= 0.7).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), s.alias("similarity"))
    want = rows(both, "a", "b", "similarity")
    for heavy in (1, 200_000):
        assert rows(quality.similar_pairs(df, "block", "k", F.col("w"), heavy=heavy), "a", "b", "similarity") == want
    w = df.filter("block IS NOT NULL").select("block", "k", F.sort_array(F.transform("w", lambda x: F.xxhash64(x))).alias("w")).withColumn("g", F.xxhash64("block", "w"))
    order = np.empty(0, np.uint64)  # all words are called rare: the shared ones stand anywhere
    met = similar._candidates(similar._group_rows(similar._sets(w, order), order, 0.7, 4), 0.7).count()
    assert len(want) <= met <= 1.5 * len(want)  # of some 12,000 pairs that share words


def test_large_tiles_of_pairs_are_split(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 50)
    df = spark.createDataFrame([(k, 1, [f"c{x}" for x in range(30)] + [f"own{k}"]) for k in range(40)], "k int, block int, w array<string>")
    got = quality.similar_pairs(df, "block", "k", F.col("w")).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 780 and {r.similarity for r in got} == {30 / 32}


def test_greedy_dedup_runs_no_pandas_group_for_each_document(spark):
    df = spark.createDataFrame([(1, 2, "a b"), (1, 0, None), (1, 1, ""), (None, 0, "x"), (1, 3, "B a"), (2, 0, "b a c"), (2, 1, "a b c d")], "doc int, _pos long, name string")
    got = quality.greedy_dedup(df, "doc")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, None), (1, 2, "a b"), (None, 0, "x"), (2, 0, "b a c")], key=str)
