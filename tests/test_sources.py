"""Sinks with several writers, logs from their end, readings of both shapes, fallbacks, and small rules."""

import datetime as dt
import io as pyio
import json
import threading

import pytest
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators import collection as c
from ladle.operators import food, jobs, mutate
from ladle.sources import io, tail
from ladle.streaming import stateful

BASE = dt.datetime(2026, 1, 1)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# --- several writers


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "c")
    io.write_collection(spark.range(1), root)
    both, failed = threading.Barrier(2), []

    def add(value):
        def change(df):
            if not both.broken and not getattr(add, f"done{value}", False):
                setattr(add, f"done{value}", True)
                both.wait(60)  # both have read the same version before either writes
            return df.union(spark.createDataFrame([(value,)], "id long"))

        try:
            io.update_collection(spark, root, change)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in (10, 20)]
    [x.start() for x in threads]
    [x.join(240) for x in threads]
    assert not failed and rows(io.read_current(spark, root), "id") == [(0,), (10,), (20,)] and io.current_number(spark, root) == 2


def test_versions_and_what_failed_writers_left(spark, tmp_path):
    root = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        io.read_current(spark, root)
    first = io.write_collection(spark.range(1), root)
    io.write_collection(spark.range(2), root)
    with pytest.raises(io.Conflict):
        io.write_collection(spark.range(9), root, expected=0)
    assert io.read_current(spark, root).count() == 2 and io.read_version(spark, root, 0).count() == 1
    spark.range(5).write.parquet(f"{root}/vorphan")
    assert not io._point(spark, root, 1, "another")  # a number is given once
    assert io.remove_old(spark, root, keep=1) == [first] and io.remove_old(spark, root, keep=1, orphan_s=0) == ["vorphan"]
    assert io.read_current(spark, root).count() == 2


# --- logs


@pytest.mark.parametrize("block", [1, 3, 7, 64, 4096])
def test_last_lines_by_blocks(tmp_path, block):
    import pyarrow as pa

    for text in ("", "\n", "one", "one\n", "one\n\n\ntwo\r\n", "a\nbb\nccc\n" * 5 + "the end", "x" * 100 + "\n" + "y" * 50, "\n\n" + "é" * 9 + "\n \n"):
        data = text.encode()
        places, at = [], 0
        for line in data.split(b"\n"):
            if line.strip():
                places.append((at, line))
            at += len(line) + 1
        for most in (1, 2, 5, 100):
            found, n = tail.last_lines(pa.BufferReader(data), most, block)
            assert found == places[-most:] and n <= len(data)


def test_tail_reads_no_more_of_longer_logs(spark, tmp_path):
    spark.dataSource.register(tail.LogTail)
    read = {}
    for n in (2_000, 20_000):
        path = tmp_path / f"log{n}.jsonl"
        path.write_text("".join(f'{{"time": {k}, "e": "event {k}"}}\n' for k in range(n)))
        got = spark.read.format("log_tail").option("lines", 50).option("block_bytes", 4096).load(str(path)).collect()
        assert [json.loads(r.line)["time"] for r in sorted(got, key=lambda r: r.at)] == list(range(n - 50, n))
        read[n] = got[0].bytes_read
    assert read[2_000] == read[20_000] == 4096
    with open(path, "a") as f:
        f.write("broken\n\n[1]\nalso broken")
    assert [r.e for r in io.tail_log(spark, str(path), "time long, e string", 5).collect()][-2:] == ["event 19998", "event 19999"]
    folder = tmp_path / "folder"
    assert io.tail_log(spark, str(folder), "time long", 5).collect() == []
    folder.mkdir()
    (folder / "b.log").write_text('{"time": 3}\n{"time": 4}\n')
    (folder / "a.log").write_text('{"time": 1}\n{"time": 2}\n')
    assert [r.time for r in io.tail_log(spark, str(folder), "time long", 3).collect()] == [2, 3, 4]


def test_following_a_log_that_grows(spark, tmp_path):
    folder, seen = tmp_path / "logs", []
    folder.mkdir()

    def run():
        stream = io.follow_log(spark, str(folder), "time long, e string")
        stateful.deliver(stream, lambda df, _: seen.extend(r.e for r in df.collect()), str(tmp_path / "c")).awaitTermination(240)

    (folder / "a.log").write_text('{"time": 1, "e": "one"}\nbroken\n{"time": 2, "e": "tw')
    run()
    assert seen == ["one"]  # the last line is still being written
    with open(folder / "a.log", "a") as f:
        f.write('o"}\n')
    (folder / "b.log").write_text('{"time": 3, "e": "three"}\n')
    run()
    run()
    assert sorted(seen) == ["one", "three", "two"]


def test_pieces_of_a_growing_file_hold_each_line_once(tmp_path):
    text = "".join(f"line {k} {'x' * (k % 40)}\n" for k in range(200)) + "not yet ended"
    path = tmp_path / "f"
    path.write_text(text)
    for size in (1, 13, 64, 5_000):
        stream = tail.TailStream({"path": str(path), "partition_bytes": size, "block_bytes": 16})
        found = [line for p in stream.partitions({}, stream.latestOffset()) for b in stream.read(p) for line in b.column("line").to_pylist()]
        assert found == text.split("\n")[:-1]


def test_json_lines_and_ring_buffers(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(3):
        io.append_log(spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("time")), path)
    entries = spark.read.schema("time long").json(path)
    assert entries.count() == 30
    assert [r.time for r in io.ring_buffer(entries, "time", kept=5, returned=3).collect()] == [29, 28, 27]
    assert io.ring_buffer(entries, "time", kept=2, returned=3).count() == 2


# --- readings


def test_readings_of_both_shapes(spark, tmp_path):
    told = [
        {"items": [], "raw_text": "Tomato Soup $4", "words": [{"word": "Tomato", "x": 1, "y": 2, "w": 30, "h": 9, "conf": 88.6}, {"word": "  "}, {"word": "Soup"}, {"word": 7}], "avg_confidence": 71.5},
        {"raw_text": "ab  c", "lines": [{"text": "ab  c", "conf": 0.934, "box": [10, 5, 50, 17]}, {"text": None}]},
        {"items": [{"name": "Pie", "price": 3}], "raw_text": None},
        {"items": [], "raw_text": "nothing was found", "words": []},
        [1],
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, told)) + "\nbroken")
    readings = io.read_readings(spark, str(tmp_path / "r.jsonl"))
    assert readings.count() == 4 and "avg_confidence: DECIMAL" in io.seen_schema(readings) and "words: ARRAY" in io.seen_schema(readings)
    by = {r.text: r for r in io.candidates(readings).collect()}
    assert set(by) == {"Tomato Soup $4", "ab  c", ""}
    word = lambda w: (w.text, *w.bbox, w.confidence)
    assert list(map(word, by["Tomato Soup $4"].words)) == [("Tomato", 1.0, 2.0, 31.0, 11.0, 89.0), ("Soup", 0.0, 0.0, 0.0, 0.0, 0.0), ("7", 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert (by["Tomato Soup $4"].avg_confidence, by["Tomato Soup $4"].word_count, by["Tomato Soup $4"].alpha_words) == (71.5, 2, 2)
    assert list(map(word, by["ab  c"].words)) == [("ab", 10.0, 5.0, 30.0, 17.0, 93.0), ("c", 40.0, 5.0, 50.0, 17.0, 93.0)]
    assert by[""].items[0].price == 3.0 and by[""].words == []


# --- fallbacks


def test_the_second_table_is_read_only_if_the_first_is_empty(spark, tmp_path):
    spark.range(7).withColumn("side", F.lit("a")).write.parquet(str(tmp_path / "first"))
    spark.range(100).withColumn("side", F.lit("b")).write.parquet(str(tmp_path / "second"))
    first, second = (spark.read.parquet(str(tmp_path / n)) for n in ("first", "second"))

    def run(a):
        df = food.first_unless_empty(a, second)
        got = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return got, "/second]" in final

    got, read = run(first.filter("id < 5"))
    assert {r.side for r in got} == {"a"} and len(got) == 5 and not read
    got, read = run(first.filter("id > 50"))
    assert {r.side for r in got} == {"b"} and len(got) == 100 and read


# --- small ends


def test_image_urls(spark):
    urls = {
        "https://images.unsplash.com/photo-1": True, "https://cdn.images.pexels.com/x": True, "https://notimages.pexels.com.evil.org/x": False, "https://a.example/b.JPG?w=1": True,
        "https://a.example/b.svg": True, "https://a.example/b.avif": False, "https://a.example/b.jpg/c": False, "no url.png": False, "": False, "https://evilupload.wikimedia.org/x": False,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.x for r in df.select("u", food.is_image_url(F.col("u")).alias("x")).collect()} == urls


def test_daily_counts_of_the_first_rows(spark):
    df = spark.createDataFrame([(k, BASE + dt.timedelta(days=k % 3)) for k in range(20)], "_pos long, ts timestamp")
    assert [r.n for r in c.daily_counts(df, "ts", 3).collect()] == [7, 7, 6]
    assert [r.n for r in c.daily_counts(df, "ts", 3, most=4).collect()] == [2, 1, 1]


def test_first_results_of_a_search(spark):
    df = spark.createDataFrame([(s, k, f"{s}{k}") for s in "ab" for k in range(8)], "q string, k int, name string")
    assert rows(food.first_results(df, "q", "k").groupBy("q").count(), "q", "count") == [("a", 5), ("b", 5)]
    assert rows(food.first_results(df, "q", "k", most=food.RECIPES), "name") == [(f"{s}{k}",) for s in "ab" for k in range(3)]


def test_ids_items_and_columns(spark):
    df = spark.createDataFrame([(0, "x", None, "n"), (1, None, "y", "m")], "_pos long, _id string, id string, name string")
    assert rows(c.with_id(df), "id") == [("x",), ("y",)] and rows(c.with_id(df.drop("id")), "id") == [("x",), (None,)]
    assert c.rename_id(df.select("id", "name")).columns == ["_id", "name"]
    assert c.find_by_id(c.with_id(df), "y").first().name == "m" and c.find_by_id(c.with_id(df), "z").count() == 0
    dish = "array<struct<name:string,description:string,price:double,category:string,confidence:double>>"
    scans = spark.createDataFrame([("s", [("Soup", None, 4.0, None, None), ("Pie", "warm", None, "dessert", 0.5)], BASE)], f"_id string, dishes {dish}, created_at timestamp")
    ms = int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [tuple(r) for r in c.build_items(scans).orderBy("_id").collect()] == [(f"s-0-{ms}", "s", "Soup", "", 4.0, "other", 0.8), (f"s-1-{ms}", "s", "Pie", "warm", None, "dessert", 0.5)]
    table = spark.createDataFrame([], f"_pos long, _id string, dishes {dish}, items_count int, status string, created_at timestamp, updated_at timestamp")
    saved = mutate.save_scan(table, scans.select("dishes"), F.lit(BASE)).collect()
    assert [(r.items_count, r.status, r.created_at) for r in saved] == [(2, "completed", BASE)]


def test_addresses_terms_and_formats(spark):
    ips = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "3.3.3.3"), ("", "3.3.3.3"), (None, None), (" ", "")], "f string, r string")
    assert [r.ip for r in ips.select(jobs.client_ip(F.col("f"), F.col("r")).alias("ip")).collect()] == ["1.1.1.1", "3.3.3.3", "unknown", "unknown"]
    say = lambda f, *values: [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("x")).collect()]
    assert say(t.strip_food_description, "Pan-fried Trout (two) in Butter", "x" * 60) == ["Trout  Butter", "x" * 50]
    assert say(t.valid_email, "a@b.c", "a b@c.d", "a@b", "@b.c") == [True, False, False, False]
    assert say(t.valid_id, "a-B_9", "", "a" * 65, "a b") == [True, False, False, False]
    assert say(t.content_hash, "abc") == ["ba7816bf8f01cfea"]
    assert say(lambda v: food.lookup_contained(v, {"soup": "warm", "pie": "sweet"}), "Apple PIE", "pie soup", "tea") == ["sweet", "warm", None]


def test_one_computation_for_all_who_ask(spark):
    calls = spark.sparkContext.accumulator(0)

    def compute(keys):
        def run(frames):
            for pdf in frames:
                calls.add(len(pdf))
                yield pdf.assign(value=pdf["k"].str.upper())

        return keys.mapInPandas(run, "k string, value string")

    asked = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, n int")
    assert rows(food.compute_once(asked, "k", compute), "n", "value") == [(1, "A"), (2, "B"), (3, "A"), (4, None)] and calls.value == 2


def test_events_are_delivered_to_whoever_listens(spark, tmp_path):
    spark.createDataFrame([("j", k, None) for k in range(3)], "job string, step int, error string").write.parquet(str(tmp_path / "in"))
    stream, out = spark.readStream.schema("job string, step int, error string").parquet(str(tmp_path / "in")), pyio.StringIO()

    def sink(df, batch):
        for r in df.orderBy("step").collect():
            out.write(f"event: {r.event}\ndata: {json.dumps({'step': r.step, 'progress': r.progress})}\n\n")

    stateful.deliver(jobs.progress_events(stream, "job", "step"), sink, str(tmp_path / "c")).awaitTermination(240)
    assert out.getvalue().split("\n\n")[0] == 'event: status\ndata: {"step": 0, "progress": 5}' and out.getvalue().count("event: ") == 3
