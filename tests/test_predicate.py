"""Truth tables of the filter operators on values, nulls and missing columns."""

import pytest
from pyspark.sql import functions as F

from ladle.operators import collection as c
from ladle.operators.predicate import compile_filter

ROWS = [(0, "a", 1.0), (1, "B", None), (2, None, 0.0), (3, "", -2.5), (4, "abc", 7.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "_pos long, s string, x double").withColumn("_id", F.concat(F.lit("id"), "_pos")).cache()


@pytest.mark.parametrize(
    "query, places",
    [
        ({}, [0, 1, 2, 3, 4]), (None, [0, 1, 2, 3, 4]), ({"s": "a"}, [0]), ({"s": None}, [2]), ({"s": ["a"]}, []), ({"id": "id3"}, [3]), ({"gone": "a"}, []), ({"gone": None}, [0, 1, 2, 3, 4]),
        ({"x": {"$gt": 0}}, [0, 4]), ({"x": {"$gte": 0}}, [0, 2, 4]), ({"x": {"$lt": 0}}, [3]), ({"x": {"$lte": 0}}, [2, 3]), ({"x": {"$gt": 0, "$lt": 5}}, [0]),
        ({"s": {"$ne": "a"}}, [1, 2, 3, 4]), ({"x": {"$ne": 1.0}}, [1, 2, 3, 4]), ({"s": {"$in": ["a", "abc"]}}, [0, 4]), ({"s": {"$in": [None, "a"]}}, [0, 2]), ({"s": {"$in": []}}, []),
        ({"s": {"$nin": ["a", "abc"]}}, [1, 2, 3]), ({"s": {"$nin": []}}, [0, 1, 2, 3, 4]), ({"s": {"$regex": "b"}}, [4]), ({"s": {"$regex": "b", "$options": "i"}}, [1, 4]),
        ({"s": {"$regex": "^$"}}, [2, 3]), ({"s": {"$exists": True}}, [0, 1, 3, 4]), ({"s": {"$exists": False}}, [2]), ({"s": "a", "x": {"$exists": False}}, []),
    ],
)
def test_truth_table(df, query, places):
    assert [r._pos for r in c.find(df, query).orderBy("_pos").collect()] == places


@pytest.mark.parametrize("query", [{"s": {"$near": 1}}, {"s": {}}, {"s": {"nested": 1}}])
def test_unknown_operators_raise(df, query):
    with pytest.raises(ValueError):
        compile_filter(df, query)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "_pos long, s string, x double").write.parquet(str(tmp_path / "t"))
    plan = c.find(spark.read.parquet(str(tmp_path / "t")), {"s": "a", "x": {"$gte": 1}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,1.0)" in plan and "EqualTo(s,a)" in plan


def test_pipeline_stages(df):
    get = lambda stages, **k: [r.asDict() for r in c.aggregate(df, stages, **k).collect()]
    assert [r["_pos"] for r in get([{"$sort": {"x": -1}}])] == [4, 0, 1, 2, 3]
    assert [r["_pos"] for r in get([{"$sort": {"x": 1}}, {"$skip": 1}, {"$limit": 2}])] == [1, 2]
    assert len(get([{"$limit": 0}, {"$skip": 0}])) == 5
    assert {r["_id"]: r["count"] for r in get([{"$group": {"_id": "s"}}])} == {"a": 1, "B": 1, "abc": 1, "unknown": 2}
    groups = {r["_id"]: [x._pos for x in r["items"]] for r in get([{"$group": {"_id": "x"}}])}
    assert groups["unknown"] == [1, 2]
    assert get([{"$group": {"_id": None}}], items=False) == [{"_id": "_all", "count": 5}]
    with pytest.raises(ValueError):
        get([{"$lookup": {}}])
