"""State over rows in order: batch folds against plain loops, with hot keys cut into parts; streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ladle.operators import folds, jobs
from ladle.streaming import stateful

BASE = dt.datetime(2026, 1, 1)


@pytest.fixture
def parts(spark):
    """Many parts, so that keys go on from part to part."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def timed(spark, rows, columns):
    return spark.createDataFrame([(*r[:-1], BASE + dt.timedelta(milliseconds=r[-1])) for r in rows], columns + ", ts timestamp")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def requests(rng, n, keys, gap):
    """Mostly one key; times repeat."""
    ms, out = 0, []
    for k in range(n):
        ms += rng.choice([0, rng.randint(0, gap), rng.randint(0, 3 * gap)])
        out.append((rng.choice(["hot", "hot", "hot", *keys]), k, rng.random() < 0.45, ms))
    rng.shuffle(out)
    return out


def plain_windows(rows, length, strict):
    until, n, out = {}, {}, []
    for key, k, _, ms in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        if key not in until or (ms > until[key] if strict else ms >= until[key]):
            until[key], n[key] = ms + length, 0
        out.append((key, k, n[key]))
        n[key] += 1
    return out


def plain_circuit(rows, limit, open_ms):
    held, out = {}, []
    for key, k, ok, ms in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        failures, opened = held.get(key, (0, None))
        if opened is not None and ms - opened < open_ms:
            out.append((key, k, "open"))
            continue
        out.append((key, k, "closed" if opened is None else "half-open"))
        held[key] = (0, None) if ok else (failures + 1, ms if failures + 1 >= limit else None)
    return out


@pytest.mark.parametrize("length", [40, 900, 10_000_000])
def test_limits_and_caches_in_parts(parts, length):
    rows = requests(random.Random(length), 2_000, "abc", 60)
    df = timed(parts, rows, "key string, k int, ok boolean")
    want = plain_windows(rows, length, True)
    assert rows_of(jobs.rate_limit(df, "key", "ts", "k", length, 3), "key", "k", "allowed") == sorted(((key, k, n < 3) for key, k, n in want), key=str)
    hits = jobs.cached_hits(df, "key", "ts", "k", length // 1000 + 1)
    assert rows_of(hits, "key", "k", "hit") == sorted(((key, k, n > 0) for key, k, n in plain_windows(rows, (length // 1000 + 1) * 1000, False)), key=str)


@pytest.mark.parametrize(("limit", "open_ms"), [(3, 200), (1, 50), (4, 5_000)])
def test_circuits_in_parts(parts, limit, open_ms):
    rows = requests(random.Random(limit), 2_000, "abc", 60)
    df = timed(parts, rows, "key string, k int, ok boolean")
    assert rows_of(jobs.circuit_breaker(df, "key", "ts", "k", "ok", limit, open_ms), "key", "k", "met") == sorted(plain_circuit(rows, limit, open_ms), key=str)


def test_one_key_is_spread_over_all_parts(parts):
    rows = [("only", k, k % 5 == 0, k * 10) for k in range(1_300)]
    df = timed(parts, rows, "key string, k int, ok boolean")
    dealt = folds.dealt_in_order(df.select("key", "k", "ok", (F.unix_millis("ts") + 0.0).alias("ms")), "key", ["ms", "k"])
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) == 13 and max(sizes) < 200
    assert rows_of(jobs.circuit_breaker(df, "key", "ts", "k", "ok", 3, 333), "key", "k", "met") == sorted(plain_circuit(rows, 3, 333), key=str)
    # rows without a key or a time have no place in an order
    odd = parts.createDataFrame([(None, 1, BASE), ("a", 2, None)], "key string, k int, ts timestamp")
    assert jobs.rate_limit(odd, "key", "ts", "k").collect() == [] == jobs.rate_limit(odd.limit(0), "key", "ts", "k").collect()


def test_rate_limit_opens_windows_with_requests(spark):
    times = [k * 5_000 for k in range(11)] + [60_001]
    df = timed(spark, [("ip", k, ms) for k, ms in enumerate(times)], "ip string, k int")
    assert [r.allowed for r in jobs.rate_limit(df, "ip", "ts", "k").orderBy("k").collect()] == [True] * 10 + [False, True]


def test_circuit_opens_and_tries_again(spark):
    calls = [(0, False), (1, False), (2, False), (30, True), (62.5, True), (63, False), (64, True)]
    df = timed(spark, [("m", k, ok, s * 1000) for k, (s, ok) in enumerate(calls)], "m string, k int, ok boolean")
    assert [r.met for r in jobs.circuit_breaker(df, "m", "ts", "k", "ok").orderBy("k").collect()] == ["closed", "closed", "closed", "open", "half-open", "closed", "closed"]


# --- the chain of providers

ROWS = "process string, request int, priority int, model string, access string, error string"
PROVIDERS = ((1, "m1", "A"), (2, "m2", "A"), (3, "m2", "B"), (4, "m3", "C"))


def chain(spark, answers):
    """answers: (seconds, what each provider would answer) of each request."""
    rows = [("p", k, *provider, error, s * 1000) for k, (s, errors) in enumerate(answers) for provider, error in zip(PROVIDERS, errors, strict=True)]
    got = jobs.provider_chain(timed(spark, rows, ROWS), "process", "request", "priority", "model", "access", "ts", "error")
    by = {(r.request, r.priority): r.outcome for r in got.collect()}
    return got, [[by[k, p] for p, _, _ in PROVIDERS] for k in range(len(answers))]


def test_chain_of_a_hand_made_trace(spark):
    down, slow = "m returned 503: busy", "m returned 429: slow down"
    got, found = chain(
        spark,
        [
            (0, (slow, None, None, None)),  # the access key A is spent within this request only
            (1, (down, "m returned 404: gone", None, None)),  # m2 does not exist within this request, whoever offers it
            (2, (down, None, down, None)),  # the third failure of m1 in a row: its circuit opens
            (3, (None, down, down, down)),  # m1 is not asked though it would answer
            (4, (None, "bad request", None, None)),  # an error that lasts counts for no circuit
            (61, (None, down, None, None)),  # m1: 59 s, still open
            (62.5, (down, None, None, None)),  # the trial fails: open again
            (100, (None, None, None, None)),
            (123, (None, None, None, None)),  # the trial succeeds
            (124, (None, None, None, None)),
        ],
    )
    assert found == [
        ["failed", "limited", "answered", "unused"],
        ["failed", "failed", "missing", "answered"],
        ["failed", "answered", "unused", "unused"],
        ["open", "failed", "failed", "failed"],
        ["open", "failed", "answered", "unused"],
        ["open", "failed", "answered", "unused"],
        ["failed", "answered", "unused", "unused"],
        ["open", "answered", "unused", "unused"],
        ["answered", "unused", "unused", "unused"],
        ["answered", "unused", "unused", "unused"],
    ]
    answers = {r.request: (r.model, r.calls) for r in jobs.chain_answers(got, "request", "priority", "model").collect()}
    assert answers[0] == ("m2", 2) and answers[3] == (None, 3) and answers[9] == ("m1", 1)


def test_chain_of_one_process_in_parts(parts):
    rng = random.Random(6)
    kinds = [None, None, "503", "timeout", "429", "404", "bad"]
    answers = [(k * 7, tuple(rng.choice(kinds if k % 90 > 30 else kinds[2:]) for _ in PROVIDERS)) for k in range(400)]
    _, found = chain(parts, answers)
    circuits, want = {}, []
    for s, errors in answers:
        spent, gone, out, done = set(), set(), [], False
        for (_, model, access), error in zip(PROVIDERS, errors, strict=True):
            failures, opened = circuits.get(model, (0, None))
            if done:
                out.append("unused")
            elif opened is not None and s - opened < 60:
                out.append("open")
            elif access in spent or model in gone:
                out.append("limited" if access in spent else "missing")
            elif error is None:
                out.append("answered")
                done, circuits[model] = True, (0, None)
            else:
                out.append("failed")
                spent |= {access} if error == "429" else set()
                gone |= {model} if error == "404" else set()
                if error in ("503", "timeout", "429"):
                    circuits[model] = (failures + 1, s if failures + 1 >= 3 else None)
        want.append(out)
    assert found == want and {"open", "limited", "missing", "unused"} < {x for row in found for x in row}


def test_chain_of_no_calls(spark):
    got = jobs.provider_chain(spark.createDataFrame([], ROWS + ", ts timestamp"), "process", "request", "priority", "model", "access", "ts", "error")
    assert got.collect() == [] and got.columns == ["process", "request", "priority", "model", "outcome"]


# --- caches


def test_cache_hits_end_with_their_time(spark):
    df = timed(spark, [("k", k, s * 1000) for k, s in enumerate([0, 5, 10, 11, 21])], "key string, n int")
    assert [r.hit for r in jobs.cached_hits(df, "key", "ts", "n", 10).orderBy("n").collect()] == [False, True, False, True, False]


def test_cache_with_lives_of_hits_and_misses(spark):
    day = 86_400
    trace = [(0, "adobo", True), (1, "xyz", False), (601, "xyz", False), (700, "xyz", True), (1202, "xyz", True), (3 * day, "xyz", True), (7 * day - 1, "adobo", True), (7 * day, "adobo", True)]
    df = timed(spark, [("c", k, key, found, s * 1000) for k, (s, key, found) in enumerate(trace)], "shard string, n int, key string, found boolean")
    got = jobs.bounded_cache(df, "shard", "key", "ts", "n", jobs.FOUND_S, jobs.CACHE_KEYS, "found", jobs.NOT_FOUND_S)
    #  what was not found lives for 10 minutes, whatever is there by then
    assert [r.hit for r in got.orderBy("n").collect()] == [False, False, False, True, False, True, True, False]


def test_a_full_cache_forgets_what_was_stored_first(parts):
    rng = random.Random(3)
    rows = [("c", k, f"dish {int(rng.gauss(300, 150))}", k * 20) for k in range(6_000)]
    got = jobs.bounded_cache(timed(parts, rows, "shard string, n int, key string"), "shard", "key", "ts", "n", 60, 200)
    held, want = {}, []
    for _, k, key, ms in rows:
        hit = key in held and ms - held[key] < 60_000
        want.append(("c", k, hit))
        if not hit:
            held.pop(key, None)
            if len(held) >= 200:
                held.pop(next(iter(held)))
            held[key] = ms
    assert rows_of(got, "shard", "n", "hit") == sorted(want, key=str) and 500 < sum(h for _, _, h in want) < 5_500


# --- streams


def stream_of(spark, batches, path, columns):
    """A stream that reads a file a batch."""
    for k, rows in enumerate(batches):
        timed(spark, rows, columns).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(columns + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def run(stream, tmp_path, name, **more):
    stateful.to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-c"), **more).awaitTermination(240)
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_streams_agree_with_batches_whatever_order_rows_come_in(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"u{k % 3}", k, rng.random() < 0.4, 700 * k) for k in range(160)]
    late = sorted(rows, key=lambda r: r[3] + rng.randint(0, 9_000))  # up to 9 s late
    end = [("end", 999, True, 700 * 160 + 30_000)]
    stream = stream_of(spark, [late[:60], late[60:110], late[110:], end], tmp_path / "in", "u string, k int, ok boolean")
    batch = timed(spark, rows, "u string, k int, ok boolean")
    got = run(stateful.rate_limit(stream, "u", "ts", "k", 20_000, 3, "10 seconds"), tmp_path, "rate").filter("key <> 'end'")
    assert rows_of(got, "key", "k", "allowed") == rows_of(jobs.rate_limit(batch, "u", "ts", "k", 20_000, 3), "u", "k", "allowed")
    got = run(stateful.circuit_breaker(stream, "u", "ts", "k", "ok", 3, 8_000, "10 seconds"), tmp_path, "circuit").filter("key <> 'end'")
    assert rows_of(got, "key", "k", "met") == rows_of(jobs.circuit_breaker(batch, "u", "ts", "k", "ok", 3, 8_000), "u", "k", "met")
    assert spark.conf.get(stateful.STORE, None) != stateful.ROCKSDB or "RocksDB" in spark.conf.get(stateful.STORE)


def test_idle_keys_are_forgotten_in_event_time(spark, tmp_path):
    fails = [("m", k, False, 1_000 * k) for k in range(2)]
    far = [("other", 10, True, 500_000)]
    again = [("m", 20, False, 600_000), ("m", 21, False, 601_000)]
    stream = stream_of(spark, [fails, far, again, [("end", 99, True, 2_000_000)]], tmp_path / "in", "u string, k int, ok boolean")
    kept = run(stateful.circuit_breaker(stream, "u", "ts", "k", "ok", 3, 5_000), tmp_path, "kept")
    assert {r.k: r.met for r in kept.collect()}[21] == "open"  # two failures were still held: the third opened the circuit
    forgot = run(stateful.circuit_breaker(stream, "u", "ts", "k", "ok", 3, 5_000, idle_ms=100_000), tmp_path, "forgot")
    assert {r.k: r.met for r in forgot.collect()}[21] == "closed"


def test_stored_values_live_for_their_time(spark, tmp_path):
    stream = stream_of(spark, [[("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], [("a", 4, 3), ("c", 5, 4)]], tmp_path / "in", "u string, k int")
    seen = {}
    stateful.deliver(stateful.cached(stream, "u", "ts", "k", 3_600_000), lambda df, _: seen.update({r.k: r.hit for r in df.collect()}), str(tmp_path / "c"), "update").awaitTermination(240)
    assert seen == {1: False, 2: True, 3: False, 4: True, 5: False}
