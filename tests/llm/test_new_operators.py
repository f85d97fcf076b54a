"""Fingerprints, the divergence audit and centroid clustering: against SQL, against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ladle.llm import op11_syncmers, op12_divergence, op13_centroids

from .test_operators import empty_documents, odd_documents, prose

VECTORS = "vec_id long, embedding array<float>, v int, cluster string"


def sql_rows(module, name, frame, columns):
    con = duckdb.connect()
    con.register("given", frame.toArrow())
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM given")
    return sorted(con.sql(module.SQL).select(*columns).fetchall(), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# --- fingerprints


def brute_anchors(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(op11_syncmers._UPPER, op11_syncmers._LOWER)))
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    inner = [digest(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)]
    out = []
    for i in range(len(words) - 4):
        four = inner[i : i + 4]
        if min(four) in (four[0], four[3]):
            out.append((four[0][:3] + four[2][:3] + four[3][:3], i))
    return out or [(digest(" ".join(words))[:9], 0)] * bool(words)


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    first = lambda x, h: next(at for g, at in x if g == h)
    shared = [h for h in dict.fromkeys(h for h, _ in a) if h in {g for g, _ in b}]
    moves = {first(b, h) - first(a, h) for h in (shared[0], shared[(len(shared) - 1) // 2], shared[-1])} if shared else set()
    same = {(h, at + m) for m in moves for h, at in a} & set(b)
    return 2 * min(len(same), len(a), len(b)) / (len(a) + len(b))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, anchors string, next string")


def test_fingerprints_against_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(5)
    texts = [(3 * k, prose(rng, rng.randint(0, 60), rng.choice([2, 400]))) for k in range(120)]
    texts += [(1000 + k, t + rng.choice(["", " end.", "!"])) for k, (_, t) in enumerate(texts[:40])] + [(-5, None), (2_000, "é " * 30 + "漢字 text"), (2_001, "ab")]
    sf_dir = write(documents(spark, texts).repartition(7), tmp_path, "documents")
    got = op11_syncmers.op11_syncmers(spark, sf_dir)
    order = sorted(texts, key=lambda r: -r[0])
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, e, n = map(brute_anchors, (t, edited, after))
        text = lambda x: " ".join(f"{h}{at}" for h, at in x)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(e), brute_likeness(a, e), brute_likeness(a, n)))
    assert rows_of(got) == sorted(want, key=str)
    assert rows_of(got) == sql_rows(op11_syncmers, "documents", spark.read.parquet(f"{sf_dir}/documents.parquet"), got.columns)
    prints = {r.doc_id: r.fingerprint for r in got.collect()}
    assert all(prints[1000 + k] == prints[3 * k] for k in range(40) if dict(texts)[1000 + k] == dict(texts)[3 * k])


def test_every_run_of_kmers_has_an_anchor():
    rng = random.Random(1)
    for _ in range(200):
        words = [str(rng.randint(0, rng.choice([3, 1000]))) for _ in range(rng.randint(7, 80))]
        at = [i for _, i in brute_anchors(" ".join(words))]
        assert max(np.diff([-1, *at, len(words) - 4])) <= op11_syncmers.K - op11_syncmers.S


def test_likeness_is_by_position(spark):
    rng = random.Random(2)
    block = prose(rng, 100)
    pairs = [(block, block), (block, "some new words before it " + block), (block, prose(rng, 100)), ("", ""), ("", block), (block + " " + prose(rng, 100), prose(rng, 100) + " " + block)]
    df = spark.createDataFrame(pairs, "a string, b string")
    stored = lambda c: op11_syncmers.parse(op11_syncmers.fingerprint(op11_syncmers.anchors(F.col(c))))
    same, shifted, other, both_empty, one_empty, moved = (r.x for r in df.select(op11_syncmers.likeness(stored("a"), stored("b")).alias("x")).collect())
    assert (same, both_empty, one_empty) == (1.0, 1.0, 0.0) and shifted > 0.9 and other < 0.05 and 0.4 < moved < 0.6


def test_successors_when_ids_are_missing_or_shared(spark, tmp_path):
    rows = [(None, "")] * 300 + [(None, f"text {k % 7}") for k in range(50)] + [(5, "b")] * 3 + [(5, "a"), (7, "c")]
    sf_dir = write(documents(spark, rows).repartition(5), tmp_path, "documents")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for parts in (2, 31):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = op11_syncmers.op11_syncmers(spark, sf_dir)
        assert rows_of(got) == sql_rows(op11_syncmers, "documents", docs, got.columns)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    # rows of one id and text lie in several ranges
    ranges = op11_syncmers.with_next(docs.select("doc_id", "text").repartition(3), [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")], {"text": F.col("text"), "part": F.spark_partition_id()})
    assert ranges.filter("doc_id IS NULL AND text = ''").select("part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fingerprints_of_odd_rows(spark, tmp_path):
    odd = odd_documents(spark).withColumns({"anchors": F.lit("x"), "next": F.lit(1), "_range": F.lit(0), "_key": F.lit("k")})
    sf_dir = write(odd, tmp_path, "documents")
    got = rows_of(op11_syncmers.op11_syncmers(spark, sf_dir))
    assert len(got) == 10 and got == sql_rows(op11_syncmers, "documents", odd.drop("n"), op11_syncmers.op11_syncmers(spark, sf_dir).columns)
    assert op11_syncmers.edited_documents(empty_documents(spark)).collect() == []
    one = op11_syncmers.edited_documents(documents(spark, [(1, "only this text")])).first()
    assert one.edited == "only this only"


# --- divergence audit


def brute_report(rows, least):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(str.maketrans(op12_divergence._UPPER, op12_divergence._LOWER)))
    by, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = words(text or "")
        by[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    p = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    shares, out = {}, []
    for (lang, source), count in by.items():
        total = sum(count[t] for t in kept[lang])
        shares[lang, source] = {t: p(count[t], total, len(kept[lang])) for t in kept[lang]}
    for lang in kept:
        count = sum((c for (x, _), c in by.items() if x == lang), Counter())
        total = sum(count[t] for t in kept[lang])
        q = {t: p(count[t], total, len(kept[lang])) for t in kept[lang]}
        sources = [s for x, s in by if x == lang]
        for s in sources:
            own = shares[lang, s]
            pairs = [(-sum(f(own[t], shares[lang, o][t]) for t in kept[lang]), o) for o in sources if o != s]
            terms = [(-f(own[t], q[t]), t) for t in kept[lang] if by[lang, s][t] and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("entries", [500_000, 40])
def test_divergence_against_brute_force(spark, monkeypatch, entries):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        words = [rng.choice(["common", "words", "Rare"]) + rng.choice("abcdefg") * rng.randint(0, 2) for _ in range(rng.randint(0, 30))]
        rows.append((" ".join(words) or None, rng.choice(["en", "de", None]), "hot" if k % 3 else rng.choice(["a", "é", "B", None])))
    rows += [("alone of its kind", "xx", "only"), (None, "en", "silent"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, p int, term string").repartition(5)
    monkeypatch.setattr(op12_divergence, "ENTRIES", entries)
    monkeypatch.setattr(op12_divergence, "HELD_TERMS", entries)
    got = op12_divergence.divergences(docs)
    assert rows_of(got) == brute_report(rows, 10)
    assert rows_of(got) == sql_rows(op12_divergence, "documents", docs, got.columns)
    assert {r.value for r in got.collect() if r.lang == "xx"} == set()  # one source, no kept term
    assert sum(r.part == "pair" and r.source == "silent" for r in got.collect()) == 5


def test_tree_shares_paths_and_counts_each_combination_once():
    #  rows: a b c, a b c, a b, b c  as items 0, 1, 2
    levels = op12_divergence.build_tree(np.array([3, 3, 2, 2]), np.array([0, 1, 2, 0, 1, 2, 0, 1, 1, 2]))
    assert [(i.tolist(), p.tolist(), n.tolist()) for i, p, n in levels] == [([0, 1], [0, 0], [3, 1]), ([1, 2], [0, 1], [3, 1]), ([2], [0], [2])]
    share, none = np.array([90, 40, 10]), np.array([2, 3, 4])
    pairs, total = op12_divergence.tree_sums(levels, np.array([0, 1, 2]), share, none)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    c = lambda a, b: f(share[a], share[b]) - f(share[a], none[b]) - f(none[a], share[b]) + f(none[a], none[b])
    assert dict(zip(pairs.tolist(), total.tolist(), strict=True)) == {1: 3 * c(0, 1), 2: 2 * c(0, 2), (1 << 32) + 2: 3 * c(1, 2)}


def test_shares_of_very_large_counts(spark):
    n, total, v = 8 * 10**15, 9 * 10**15 + 7, 12_345
    row = spark.range(1).select(op12_divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p"), op12_divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert (row.p, row.none) == (1 + 10**9 * (n + 2) // (total + 2 * v), None)


def test_divergence_on_odd_rows(spark):
    assert op12_divergence.divergences(empty_documents(spark)).collect() == []
    odd = odd_documents(spark)
    got = op12_divergence.divergences(odd, least_docs=1)
    assert {(r.lang, r.source) for r in got.filter("part = 'pair'").collect()} == {("", ""), ("", "b"), ("en", ""), ("en", "a"), ("en", "b")}
    raw = spark.range(24).select(F.when(F.col("id") % 2 == 0, F.unhex(F.lit("FF41")).cast("string")).otherwise("b").alias("text"), F.lit("l").alias("lang"), (F.col("id") % 2).cast("string").alias("source"))
    assert {r.item for r in op12_divergence.divergences(raw).filter("part = 'term'").collect()} == {"\ufffda", "b"}


# --- centroids


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        owner = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owner, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, c := nearest(v), far(v, centroids[c])) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def vectors(rng, n):
    return [(k, [rng.gauss(rng.choice([-1, 0, 1]), 0.3) for _ in range(64)]) for k in range(n)]


def cluster_rows(spark, path, rows):
    sf_dir = write(spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(3), path, "embeddings")
    return op13_centroids.op13_centroids(spark, sf_dir), spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def test_centroids_against_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = vectors(rng, 150)
    rows += rows[:3] + [(900, [0.0] * 64), (901, [0.0] * 64), (902, [0.25] * 64), (903, [-0.0001] * 64)] + [(1000 + k, rows[0][1]) for k in range(60)]  # a third are copies
    rows += [(None, rows[5][1]), (910, None), (911, [0.5] * 63), (912, [0.5] * 65), (913, [0.5] * 63 + [None]), (914, [0.5] * 63 + [float("nan")]), (915, [-float("inf")] + [0.5] * 63), (916, [])]
    got, table = cluster_rows(spark, tmp_path, rows)
    assert rows_of(got) == brute_clusters(rows)
    assert rows_of(got) == sql_rows(op13_centroids, "embeddings", table, got.columns)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, tmp_path, n):
    rows = vectors(random.Random(n), n)
    got, _ = cluster_rows(spark, tmp_path, rows)
    assert rows_of(got) == brute_clusters(rows) and got.schema.simpleString() == "struct<vec_id:bigint,cluster:int,distance:bigint,cluster_inertia:bigint,inertia:bigint,centroid_sha256:string>"


def test_equal_vectors_leave_centroids_empty_and_large_ones_are_refused(spark, tmp_path):
    rows = [(k, [0.1] * 64) for k in range(30)]
    got, _ = cluster_rows(spark, tmp_path / "a", rows)
    assert rows_of(got) == brute_clusters(rows) and {r.cluster for r in got.collect()} == {0}
    with pytest.raises(Exception, match="131072 or more"):
        cluster_rows(spark, tmp_path / "b", [(1, [2e5] * 64)])[0].collect()


def test_tables_give_the_distances():
    rng = np.random.default_rng(0)
    rows, centroids = rng.integers(-2000, 2000, (300, 64)), rng.integers(-2000, 2000, (8, 64))
    cluster, distance = op13_centroids.nearest(rows, centroids)
    far = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
