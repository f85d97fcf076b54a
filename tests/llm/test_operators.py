"""Each operator against brute force, round trips or held-out accuracy, and on odd rows."""

import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ladle.llm import dac, op1_warc, op2_rules, op3_licenses, op4_jaccard, op5_mixing, op6_quality, op7_tokens, op8_decontaminate, op9_urls, op10_token_ids
from ladle.llm.common import lean

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n long, key string, `position` string"
LONG = "lorem ipsum dolor " * 20_000


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names the operators use themselves."""
    rows = [
        (1, None, None, None), (2, "", "en", ""), (3, " \n\t ", "en", "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "a text without an id " * 9, "en", None),
        (5, LONG, "en", "b"), (6, "Licensed under CC BY-NC 4.0.\nthe MIT License apache license, gnu GENERAL public\nlicense", None, "b"),
        (7, "é ü 漢字 \x00 \x1c <|endoftext|> ‍😀 " * 5, "xx", "b"), (None, None, None, None),
    ]
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 2, "y", "z") for i, t, lang, s in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


TOKENS = ["alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "theta", "iota", "rho"]


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice(TOKENS)}{rng.randint(0, words)}" for _ in range(n))


# --- WARC


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    big, rows = "x" * 150, []
    rows += [(3, "http://a/3", big), (1, "http://a/1", big), (2, "http://a/2", big), (None, None, big), (5, "http://a\r\nb/5", None), (6, "u", "short"), (7, "u", "short"), (1, "http://a/1", big)]
    rows += [(8, "http://ü/8", "€" * 40), (9, None, "€" * 40), (10, "x", LONG)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    op1_warc.write_warc(op1_warc.dedupe_payloads(pages), path, compress)
    back = op1_warc.read_warc(spark, path).collect()
    assert len(back) == len(rows)
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in back)
    assert kinds[("urn:page:1", "response", None)] == 2  # repeated rows of the smallest id
    assert kinds[("urn:page:3", "revisit", "urn:page:1")] == 1 and kinds[("urn:page:null", "revisit", "urn:page:1")] == 1
    assert kinds[("urn:page:6", "response", None)] == 1 and kinds[("urn:page:7", "response", None)] == 1
    assert kinds[("urn:page:9", "revisit", "urn:page:8")] == 1
    payloads = {r.record_id: r.payload for r in back if r.record_type == "response"}
    assert payloads["urn:page:10"].decode() == LONG and bytes(payloads["urn:page:5"]) == b""
    assert {r.payload_length for r in back if r.record_id == "urn:page:8"} == {120}
    few = op1_warc.read_warc(spark, path, payload=False).filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a/"))
    assert sorted(r.record_id for r in few.collect()) == ["urn:page:2", "urn:page:3"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan and "= revisit" not in plan.split("BatchScan")[0]  # the reader takes the predicate


def test_warc_of_no_pages(spark, tmp_path):
    op1_warc.write_warc(op1_warc.dedupe_payloads(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "w"))
    (tmp_path / "w").mkdir(exist_ok=True)
    assert op1_warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_warc_left_behind_by_a_lost_task(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", "a page that many others repeat " * 9) for k in range(40)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    op1_warc.write_warc(op1_warc.dedupe_payloads(pages), path)
    first = next(f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz"))
    (tmp_path / "w" / "part-000009-0000-lost.warc.gz").write_bytes(first.read_bytes()[:-50])  # in no manifest
    back = op1_warc.read_warc(spark, path)
    assert Counter(r.record_type for r in back.collect()) == {"response": 1, "revisit": 39}  # one payload, held by all
    op1_warc.write_warc(op1_warc.dedupe_payloads(pages.filter("page_id < 3")), path)  # a second write adds its manifest
    assert op1_warc.read_warc(spark, path, payload=False).count() == 43


def test_foreign_gzip_archive(spark, tmp_path):
    import gzip

    row = {"record_type": "response", "target_uri": "http://x", "refers_to": None, "payload_digest": "sha256:0", "payload_length": 3, "payload": b"abc"}
    data = [op1_warc.record_bytes(row | {"record_id": f"urn:page:{k}"}, "d") for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    back = op1_warc.read_warc(spark, str(tmp_path)).filter("record_id = 'urn:page:3'").collect()
    assert [(r.record_id, bytes(r.payload)) for r in back] == [("urn:page:3", b"abc")]


# --- quality rules


def brute_rules(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            repeated += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(covered)


def test_rules_base_and_ratio(spark):
    rng = random.Random(3)
    good = [prose(rng, 200, 9) for _ in range(60)]
    junk = [" ".join(w + "###" for w in prose(rng, 200, 9).split()) for _ in range(20)]
    loops = [" ".join(["one two three four five six seven eight nine"] * 5), "a b\na b\n c | d\na b"]
    texts = good + junk + loops
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "doc_id long")
    got = {r.doc_id: r for r in op2_rules.apply_rules(docs, trusted).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(text)
    assert all(got[k].kept for k in range(60)) and not any(got[k].kept for k in range(60, 80))
    assert got[80].base_failed and got[81].base_failed
    # the ratio by hand, from the formula of the docstring
    raw, target = Counter(), Counter()
    for k, text in enumerate(texts):
        raw.update(brute_buckets(text))
        if k < 60 and k % 2 == 0:
            target.update(brute_buckets(text))
    n_raw, n_target, n = sum(raw.values()), sum(target.values()), op2_rules.BUCKETS
    prior = op2_rules.SMOOTHING * n_target / n_raw
    for k in (5, 60, 81):
        logs = [math.log((target[b] + prior) / (n_target + prior * n)) - math.log((raw[b] + op2_rules.SMOOTHING) / (n_raw + op2_rules.SMOOTHING * n)) for b in brute_buckets(texts[k])]
        assert got[k].ratio == pytest.approx(sum(logs) / len(logs), abs=1e-9)
        assert got[k].kept == (not got[k].base_failed and sum(logs) / len(logs) >= op2_rules.THRESHOLD)


def brute_buckets(text):
    """Buckets of words and word pairs, on Python's numbers."""
    word = lambda w: xxhash.xxh3_64_intdigest(w.lower().encode())

    def mixed(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % 2**64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 % 2**64
        return x ^ x >> 33

    h = [word(w) for w in text.split()]
    return [mixed(x) % op2_rules.BUCKETS for x in h] + [mixed((3 * x + y) % 2**64) % op2_rules.BUCKETS for x, y in zip(h, h[1:])]


def test_rules_on_odd_rows(spark):
    trusted = spark.createDataFrame([(5,), (None,)], "doc_id long")
    assert op2_rules.apply_rules(odd_documents(spark), trusted).count() == 10
    assert op2_rules.apply_rules(empty_documents(spark), trusted).count() == 0


# --- licenses


def on_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.sql(sql).df()


def same(spark_df, frame, *columns):
    a, b = spark_df.select(*columns).toPandas(), frame[list(columns)]
    norm = lambda rows: sorted(rows, key=str)
    assert norm(key_rows(a)) == norm(key_rows(b))


def key_rows(f):
    for r in f.itertuples(index=False):
        yield tuple("-" if pd.isna(v) else f"{float(v):.9f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r)


def test_licenses_against_sql(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30) + "\n" + " ".join(rng.sample(t.split(), rng.randint(max(1, len(t.split()) - 3), len(t.split())))) + " " + prose(rng, 3) for _, t in op3_licenses.TEMPLATES for _ in range(4)]
    texts += ["the MIT License mit license", "cc by cc by", "Gnu General\nPublic  License!", "xmit license", "all rights reserved", "é mit license é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd_documents(spark).select("doc_id", "text").filter("doc_id IS NULL OR doc_id != 5"))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = op3_licenses.scan_licenses(docs)
    same(got, on_duckdb(op3_licenses.SQL, documents=docs), *columns)
    assert got.filter("score BETWEEN 0.9 AND 0.99").count() > 0  # near matches are found
    assert op3_licenses.scan_licenses(empty_documents(spark)).count() == 0
    assert op3_licenses.scan_licenses(odd_documents(spark)).filter("doc_id = 6").first().base_labels == "apache,cc-by,gpl,mit"


def test_licenses_across_line_breaks(spark):
    rng, texts, want = random.Random(2), [], []
    for label, t in op3_licenses.TEMPLATES:
        w = t.split()
        for cut in range(1, len(w), max(1, len(w) // 12)):
            texts.append(f"{prose(rng, 6)} {' '.join(w[:cut])}\r\n * {' '.join(w[cut:])} {prose(rng, 6)}")
            want.append((label, 1.0))
        texts.append(prose(rng, 5) + "\n\n" + "\n# ".join(w) + "\n" + prose(rng, 5))  # a word a line
        want.append((label, 1.0))
    n = len(texts)
    bsd = op3_licenses.TEMPLATES[7][1].split()
    # scattered over the text: no window has them; one word of 17 changed: 16 are left
    texts += ["\n".join(f"{w} {prose(rng, 3)}" for w in bsd), " ".join(bsd[:9]) + "\nfoo " + " ".join(bsd[10:])]
    got = {r.doc_id: r for r in op3_licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score == score for k, (label, score) in enumerate(want))
    assert got[n].labels == "" and got[n].score == 0
    assert got[n + 1].labels == "bsd" and 0.9 <= got[n + 1].score < 1


def test_whole_notices_wrapped_as_in_files(spark):
    """Each template wrapped at 40 and at 76 columns, with a comment sign a line, words changed, and blank lines between paragraphs."""
    rng, texts, want = random.Random(4), [], []
    for label, t in op3_licenses.TEMPLATES:
        for width in (40, 76):
            w = t.split()
            for k in rng.sample(range(len(w)), len(set(w)) // 25):
                w[k] = f"changed{k}"
            lines = textwrap.wrap(" ".join(w).capitalize() + ".", width)
            lines.insert(len(lines) // 2, "")
            texts.append(f"/*\n * {prose(rng, 4)}\n" + "\n".join(f" * {x}" for x in lines) + f"\n */\n{prose(rng, 30)}")
            want.append(label)
    got = {r.doc_id: r for r in op3_licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [k for k, label in enumerate(want) if label not in got[k].labels.split(",")] == []
    assert {r.score for r in got.values()} != {1.0}


# --- Jaccard join


def brute_groups(texts, m):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < m.n else frozenset(tuple(w[k : k + m.n]) for k in range(len(w) - m.n + 1))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if m.den * common >= m.num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("m", [op4_jaccard.Measure(), op4_jaccard.Measure(5, 80, 100), op4_jaccard.Measure(1, 50, 100)])
def test_jaccard_against_brute_force(spark, m):
    rng = random.Random(m.n)
    texts, passage = {}, prose(rng, 25)
    for _ in range(12):
        base = prose(rng, rng.choice([9, 12, 40, 90, 160])).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 99999)}"
            texts[len(texts) + 1] = " ".join(w)
    for _ in range(30):
        texts[len(texts) + 1] = prose(rng, 10) + " " + passage
    texts |= {900: None, 901: "", 902: "two words", 903: "two words", 904: " two  words\n", 905: "TWO words"}
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, key string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_jaccard.near_duplicates(docs, m).collect()}
    assert got == brute_groups(texts, m)


def test_jaccard_in_blocks(spark, monkeypatch):
    """Large buckets are cut into block pairs, and long chains of links still make one group."""
    monkeypatch.setattr(op4_jaccard, "BLOCK", 8)
    rng = random.Random(7)
    w = [f"w{k}" for k in range(120)]
    texts = {}
    for k in range(60):
        w[rng.randrange(120)] = f"c{k}"
        texts[k] = " ".join(w)
    m = op4_jaccard.Measure()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_jaccard.near_duplicates(docs, m).collect()}
    assert got == brute_groups(texts, m)


@pytest.mark.parametrize("block", [4096, 8])
def test_jaccard_links_inside_groups(spark, monkeypatch, block):
    monkeypatch.setattr(op4_jaccard, "BLOCK", block)
    rng, m, texts = random.Random(9), op4_jaccard.Measure(5, 80, 100), {}
    for _ in range(4):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([90, 160, 900]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 99999)}"
            texts[len(texts) + 1] = " ".join(w)
    texts |= {900: None, 901: "", 902: "two words", 903: "two  words\n"}
    sets = {}
    for i, text in texts.items():
        w = (text or "").split()
        sets[i] = frozenset(tuple(w[k : k + m.n]) for k in range(max(1, len(w) - m.n + 1))) if w else frozenset()
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and m.den * len(sets[i] & sets[j]) >= m.num * len(sets[i] | sets[j])}
    links, members = op4_jaccard.linked_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), m)
    key = {r.doc_id: r.key for r in members.collect()}
    pairs = [(r.a, r.b) for r in links.collect()]
    assert set(key) == set(texts) and key[900] is None and len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    linked = set(pairs)
    assert {(i, j) for i in key for j in key if i < j and None not in (key[i], key[j]) and (key[i] == key[j] or (min(key[i], key[j]), max(key[i], key[j])) in linked)} == want
    links, members = op4_jaccard.linked_classes(empty_documents(spark))
    assert links.count() == members.count() == 0


def test_jaccard_on_odd_rows(spark):
    rows = op4_jaccard.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id == 4} == {4}
    assert op4_jaccard.near_duplicates(empty_documents(spark)).count() == 0


# --- mixing


def test_mixing_against_sql(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.choice([0, 1, 5, 80, 400])), "en", rng.choice(["big", "big", "big", "a", "b", "Z", None]), 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = op5_mixing.mix_sources(docs)
    same(got, on_duckdb(op5_mixing.SQL, documents=docs), "doc_id", "size", "source_size", "target", "taken")
    out = got.collect()
    assert all(r.taken <= 2 * r.size for r in out) and [r.position for r in out if r.position is not None] == sorted(r.position for r in out if r.position is not None)
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r.size for r in out), abs=5)
    used = Counter(r.doc_id for r in op5_mixing.mixed_documents(docs).collect())
    assert used == Counter({r.doc_id: -(-r.taken // r.size) if r.size and r.taken else 0 for r in out if r.taken})


def test_mixing_keeps_columns_of_any_name(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, 1 + k % 7), rng.choice(["a", "b", None]), f"s{k}", f"t{k}", -k, k / 3, f"u{k}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string, slope long, source_size double, uses string")
    got = [tuple(r) for r in op5_mixing.mixed_documents(docs).collect()]
    assert got and set(got) <= set(rows)
    assert Counter(r[0] for r in got) == Counter({r.doc_id: -(-r.taken // r.size) for r in op5_mixing.mix_sources(docs).collect() if r.taken})
    places = {r.doc_id: r.position for r in op5_mixing.mix_sources(docs).collect()}
    first = {}
    for r in got:
        first.setdefault(r[0], len(first))
    assert [places[i] for i in first] == sorted(places[i] for i in first)  # range-sorted over all partitions


def test_mixing_on_odd_rows(spark):
    rows = op5_mixing.mix_sources(odd_documents(spark)).collect()
    assert len(rows) == 10 and all(r.taken <= 2 * r.size for r in rows)
    assert op5_mixing.mix_sources(empty_documents(spark)).count() == 0
    assert op5_mixing.mixed_documents(empty_documents(spark)).count() == 0
    assert op5_mixing.mixed_documents(odd_documents(spark)).columns == odd_documents(spark).columns


def test_mixing_of_rows_without_ids_is_spread_and_agrees_between_runs(spark):
    rng = random.Random(14)
    rows = [(None if rng.random() < 0.9 else k % 5, prose(rng, rng.choice([3, 7])), "en", "s", 0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ranges = op5_mixing._ranged(op5_mixing._sized(docs), 64).groupBy("_mix_r").count().collect()
    assert len(ranges) > 50 and max(r["count"] for r in ranges) < 60
    runs = [Counter(map(tuple, op5_mixing.mixed_documents(docs.repartition(n, c)).collect())) for n, c in ((3, "text"), (11, "n_chars"))]
    assert runs[0] == runs[1] and sum(runs[0].values()) < 1_200
    con = duckdb.connect()
    con.register("documents", docs.toArrow())  # pandas would make numbers with points of the ids
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert Counter(map(tuple, op5_mixing.mix_sources(docs).select(*columns).collect())) == Counter(con.sql(op5_mixing.SQL).select(*columns).fetchall())


# --- quality classifier


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        bad = k % 3 == 0
        words = prose(rng, 60, 50).split()
        rows.append((k, " ".join(w + rng.choice(["###", "$$$"]) for w in words) if bad else " ".join(words).capitalize() + ".", int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = op6_quality.fit(docs, labels(spark, [(k, q, 0) for k, _, q in rows]))
    got = {r.doc_id: r.score for r in op6_quality.score(docs, model).collect()}
    held = [(got[k], q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([(s >= op6_quality.THRESHOLD) == q for s, q in held]) > 0.98
    assert all(0 <= s <= 1 for s in got.values())


def test_quality_score_by_hand(spark):
    """Features from zstandard itself, the logistic fit by plain gradient steps, contradicting and repeated labels."""
    import zstandard

    rng = random.Random(13)
    rows = [(k, prose(rng, 70, 40) if k % 2 else " ".join(f"{rng.choice('xyz')}{rng.randint(0, 9)}@@" for _ in range(90)), k % 2) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = [(k, q, 0) for k, _, q in rows] + [(4, 1, 0), (5, 1, 0), (5, 0, 0), (7, 3, 0), (9999, 1, 0), (None, 1, 0)]
    model = op6_quality.fit(docs, labels(spark, marks))
    tools = [zstandard.ZstdCompressor(level=op6_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]

    def features(text):
        data = text.encode()
        blocks = [data[i : i + op6_quality.BLOCK_BYTES] for i in range(0, len(data), op6_quality.BLOCK_BYTES)]
        good, bad = (sum(len(t.compress(b)) for b in blocks) for t in tools)
        return [(bad - good) / len(data), good / len(data)]

    fit = [(k, t, 1 if k in (4, 5) else q) for k, t, q in rows if zlib.crc32(str(k).encode()) % 5]  # of contradicting labels the larger counts
    share = np.mean([q for _, _, q in fit])
    x = np.array([features(t) for want in (0, 1) for _, t, _ in [r for r in fit if r[2] == want][1::2]])
    y = np.array([want for want in (0, 1) for _ in [r for r in fit if r[2] == want][1::2]])
    a = np.c_[np.ones(len(x)), (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)]
    w = np.zeros(3)
    for _ in range(60_000):
        w += 0.02 * (a.T @ (y - 1 / (1 + np.exp(-a @ w))) - 0.01 * w)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    got = {r.doc_id: r.score for r in op6_quality.score(docs, model).collect()}
    for k, t, _ in rows[::17]:
        z = w[0] + np.dot(w[1:], np.clip((np.array(features(t)) - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -op6_quality.REACH, op6_quality.REACH))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=0.01)


def test_quality_of_short_texts(spark):
    """Empty texts get the share of good labels, and a text moves from there to its own score as it gets longer."""
    rng = random.Random(13)
    rows = [(k, prose(rng, 70, 40) if k % 4 else " ".join(f"{rng.choice('xyz')}{rng.randint(0, 9)}@@" for _ in range(90)), int(k % 4 > 0)) for k in range(400)]
    model = op6_quality.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), labels(spark, [(k, q, 0) for k, _, q in rows]))
    share = np.mean([q for k, _, q in rows if zlib.crc32(str(k).encode()) % 5])
    assert model.score(None) == model.score(b"") == pytest.approx(share)
    for text, direction in ((rows[1][1], 1), (rows[0][1], -1)):
        data = text.encode()
        scores = [model.score(data[:n]) for n in range(0, 51)]
        assert max(abs(b - a) for a, b in zip(scores, scores[1:21], strict=False)) < 0.15  # no leaps
        assert abs(scores[1] - share) < 0.05 and (model.score(data) - share) * direction > 0
    for short in (b" ", b"a", "é".encode(), b"hello world"):
        assert abs(model.score(short) - share) < 0.3 and model.score(short) >= op6_quality.THRESHOLD


def test_quality_without_labels_and_on_odd_rows(spark):
    model = op6_quality.fit(odd_documents(spark), labels(spark))
    scores = op6_quality.score(odd_documents(spark), model).collect()
    assert len(scores) == 10 and {r.score for r in scores} == {0.5}
    assert op6_quality.score(empty_documents(spark), model).count() == 0


# --- token counts


def test_token_counts(spark, tmp_path):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    docs = odd_documents(spark)
    path = p.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time all are hits
        got = op7_tokens.count_tokens(docs, path, cache)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert got.filter("over_limit != (n_tokens > 512)").count() == 0
    assert op7_tokens.count_tokens(empty_documents(spark), path, cache).count() == 0
    pieces = p.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    assert Counter(r.n_tokens for r in op7_tokens.count_tokens(docs, pieces, cache).collect()) == Counter(len(sp.encode(r.text or "")) for r in docs.collect())


def test_token_counts_by_pieces(monkeypatch):
    """Pieces are encoded once a worker, and their sums are what the library gives for whole texts."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    rng, path = random.Random(6), p.path("byte_bpe_50k.json")
    alphabet = list("abcXYZ019 ’'.,;:!?…éÉß٣½\u0301\u200d\u180e\x00\x7f\x1c\x85\xa0\u2003\u2028\u3000\n\t\x0b\r-_<>|#ª  ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "...", "漢", "😀", "The", " word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "x" * 500, " "]
    model, asked = Tokenizer.from_file(path), []
    want = [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(op7_tokens, "_loaded", {})
    counts = op7_tokens.tokenizer(path)
    counts.limit = 5000
    for k in range(0, len(texts), 500):
        assert counts([t.encode() for t in texts[k : k + 500]]) == want[k : k + 500]
    assert counts([]) == []
    encode = counts._count
    monkeypatch.setattr(counts, "_count", lambda texts: asked.extend(texts) or encode(texts))
    words = [prose(rng, 300, 100) for _ in range(50)]
    assert counts([w.encode() for w in words]) == [len(model.encode(w, add_special_tokens=False).ids) for w in words]
    assert sum(map(len, asked)) < sum(map(len, words)) / 5


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"added_tokens": ["two words"]}])
def test_tokenizers_that_do_not_cut_encode_whole_texts(tmp_path, change):
    import public_tokenizers as p
    from tokenizers import AddedToken, Tokenizer

    model = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    model.add_special_tokens([AddedToken(t) for t in change.get("added_tokens", [])])
    told = json.loads(model.to_str()) | {k: v for k, v in change.items() if k != "added_tokens"}
    path = str(tmp_path / "t.json")
    (tmp_path / "t.json").write_text(json.dumps(told))
    text = "Some TWO words, two words. And More"
    assert not op7_tokens.PieceCounter.fits(path)
    assert op7_tokens.tokenizer(path)([text.encode()]) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)]


# --- decontamination


def plain(text):
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()


def word_shingles(words):
    n = op8_decontaminate.SHINGLE
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def weighted(window, item, weight):
    """Weighted Jaccard similarity of two bags of word tuples."""
    a, b = Counter(window), Counter(item)
    low, high = sum(weight(x) * min(a[x], b[x]) for x in a | b), sum(weight(x) * max(a[x], b[x]) for x in a | b)
    return low / high


def brute_best(text, items):
    """Best weighted similarity of each item over all windows of its length; a shorter text is one window."""
    bags = {i: word_shingles(plain(t)) for i, t in items if plain(t)}
    holders = Counter(x for bag in bags.values() for x in set(bag))
    weight = lambda x: math.log(1 + len(bags) / holders[x]) if x in holders else math.log(1 + len(bags))
    words, best = plain(text), {}
    for i, t in items:
        n = len(plain(t))
        if not n or not words or (n < op8_decontaminate.SHINGLE and len(words) < n):
            continue
        for k in range(max(1, len(words) - n + 1)):
            best[i] = max(best.get(i, 0.0), weighted(word_shingles(words[k : k + n]), bags[i], weight))
    return {i: s for i, s in best.items() if s >= op8_decontaminate.SIMILARITY}


def test_decontamination_against_all_windows(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(14, 60), 9)) for k in range(25)] + [(90, "three little words"), (91, ""), (92, None)]
    texts = []
    for _ in range(120):
        text = prose(rng, rng.randint(5, 80)).split()
        if rng.random() < 0.6:
            w = rng.choice(items[:26])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
            text[3:3] = [x.upper() + "," for x in w]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in op8_decontaminate.benchmark_matches(docs, benchmark(spark, items)).collect()}
    want = {(k, i): s for k, t in enumerate(texts) for i, s in brute_best(t, items).items()}
    assert want and got == pytest.approx({k: want[k] for k in got})
    assert len(got) >= 0.97 * len(want) and {k for k, s in want.items() if s > 0.85} <= set(got)
    clean = {r.doc_id for r in op8_decontaminate.clean_documents(docs, benchmark(spark, items)).collect()}
    assert clean == set(range(len(texts))) - {k for k, _ in got}


def test_decontamination_of_texts_shorter_than_an_item(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n, 300)) for k, n in enumerate((40, 25, 60, 14, 6))]
    texts, want = [], {}
    for item_id, text in items:
        w = text.split()
        for cut in range(len(w) // 2):
            for part in (w[: len(w) - cut], w[cut:], w[cut // 2 : len(w) - (cut - cut // 2)]):
                if item_id in (best := brute_best(" ".join(part), items)):
                    want[len(texts), item_id] = (len(part), best[item_id])
                texts.append(" ".join(part))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.similarity) for r in op8_decontaminate.benchmark_matches(docs, benchmark(spark, items)).collect()}
    assert set(got) <= set(want) and all(got[x] == (want[x][0], pytest.approx(want[x][1])) for x in got)
    assert {x for x, (_, s) in want.items() if s > 0.85} <= set(got) and any(n == 39 for n, _ in got.values())
    clean = {r.doc_id for r in op8_decontaminate.clean_documents(docs, benchmark(spark, items)).collect()}
    assert clean == set(range(len(texts))) - {k for k, _ in got}


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    items = op8_decontaminate.Items([(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20))) for k in range(300)])
    prints = items.prints[rng.integers(0, 300, 500)].copy()
    for i in range(500):
        for b in rng.choice(64, rng.integers(0, 22), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    want = {(i, k) for i in range(500) for k in range(300) if int(prints[i] ^ items.prints[k]).bit_count() <= op8_decontaminate.RADIUS}
    assert set(items.within(prints, 20)) == want


def test_decontamination_in_passes_and_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op8_decontaminate, "ITEMS", 2)
    items = [(k, f"item number {k} has these words in it and ends at {k}") for k in range(7)]
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op8_decontaminate.benchmark_matches(docs, benchmark(spark, items)).collect() if r.similarity == 1} == {(k, k) for k in range(7)}
    assert op8_decontaminate.benchmark_matches(odd_documents(spark), benchmark(spark)).count() == 0
    assert op8_decontaminate.clean_documents(odd_documents(spark), benchmark(spark, items)).count() == 10
    assert op8_decontaminate.clean_documents(empty_documents(spark), benchmark(spark, items)).count() == 0


# --- URLs


URLS = [None, "", "no scheme", "http://a.com", "http://a.com/", "HTTPS://WWW.Example.COM/en/x?y#z", "https://x.www.example.com/en/", "http://example.com/en", "http://myexample.com/en/1", "http://b.net/es/1", "http://b.net/ES/1",
        "ftp://casino-win.example.org/de/",
        "http://a.org/wp-login.php", "http://a.org/wp-content/x", "http://a.org/x?PHPSESSID=0123456789abcdef0", "http://a.org/x?sid=short", "http://a.org/?search=x", "http://a.org/?search=",
        "http://a.org/calendar/2024/02/30/", "http://a.org/calendar/2024/13/01", "http://a.org/feed/", "http://a.org/feed/x", "http://a.org/a.tar.gz?x", "http://a.org/a.zipped", "http://a.org/x?goto=https%3A//b",
        "http://my.spam-farm2.example.org/en/7", "http://spamfarm.org/x", "http://a.spamfarms77.org/", "http://a.org/b.7z", "http://a.org/atom.xml", "http://spam.farm.org/", "http://a.org/?cart=12", "http://a.org/x?poker#y", "http://com/x", "http://net/fr/", "x://?q", "http://a.com:80/en/", "http://cheap.pills.example.net/de/", "http://caſino.org/", "a\nb://c.com/d", "http://" + "a" * 50_000 + ".com/"]


def test_urls_against_sql(spark):
    pages = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(URLS)] + [(None, "http://a.com/", "r", "v"), (3, URLS[3], "r", "v")], "page_id long, url string, rule string, verdict string")
    got = op9_urls.filter_urls(pages, op9_urls.BASE_RULES + op9_urls.PATTERN_RULES)
    same(got, on_duckdb(op9_urls.SQL, pages=pages), "page_id", "host", "path", "rule", "verdict", "pattern_rule")
    assert op9_urls.filter_urls(pages.limit(0), op9_urls.BASE_RULES).count() == 0


def test_url_rules_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.literals), r.on) for r in op9_urls.PATTERN_RULES[::-1]], op9_urls.RULE_SCHEMA)
    rules = op9_urls.read_rules(table)
    assert set(rules) == set(op9_urls.PATTERN_RULES)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    judged = lambda rules: {r.page_id: r.verdict for r in op9_urls.filter_urls(pages, rules).collect()}
    assert judged(rules) == judged(op9_urls.PATTERN_RULES)
    assert sum(v == "block" for v in judged(rules).values()) >= 10
    monkeypatch.setattr(op9_urls, "MAX_RULE_BYTES", 20)
    with pytest.raises(ValueError):
        op9_urls.read_rules(table)
    with pytest.raises(ValueError):
        op9_urls.filter_urls(pages, rules)


def test_url_index_runs_few_rules(spark):
    rules = (op9_urls.word_rule("rare common", "block"), op9_urls.word_rule("common", "block"), op9_urls.Rule("archive", "block", r"\.7z", ("7z",)))
    assert op9_urls.index_rules(rules, {"common": 50, "rare": 1, "7": 3, "z": 2}) == {"rare": [0], "common": [1], "z": [2]}
    with pytest.raises(ValueError):
        op9_urls.index_rules((op9_urls.Rule("any", "block", r"\d{9}", ()),), {})


@pytest.mark.parametrize("rule", op9_urls.BASE_RULES + op9_urls.PATTERN_RULES, ids=lambda r: r.name + r.pattern[-20:])
def test_every_match_of_a_rule_holds_its_tokens(rule):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    need = set(op9_urls.tokens_of(rule))

    @settings(max_examples=150, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(op9_urls._compiled(rule.pattern)))
    def holds(text):
        low = text.translate(op9_urls._ASCII_LOWER)
        if op9_urls._compiled(rule.pattern).search(low):
            assert need <= set(op9_urls._TOKEN.findall(low))

    holds()


def test_a_table_of_some_hundred_rules(spark):
    """Which rule is found is the same as if every rule ran on every URL."""
    rng = random.Random(12)
    words = ["bet", "slots", "pharma", "loan", "keto", "crack", "keygen", "escort", "forex", "lotto"]
    rules = [op9_urls.word_rule(f"{a} {b}", "block") for a in words for b in words if a != b]
    rules += [op9_urls.host_rule(f"{a}{k}.example.com", rng.choice(["/", "/x", "/en/"]), rng.choice(["allow", "block"])) for a in words for k in range(20)]
    rules = op9_urls.read_rules(spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.literals), r.on) for r in rules], op9_urls.RULE_SCHEMA))
    urls = [f"http://{rng.choice(words)}{rng.randint(0, 30)}.{rng.choice(['example', 'a.example', 'b'])}.com/{rng.choice(['x', 'xy', 'en/', ''])}{rng.choice(words)}{rng.choice('-_/1')}{rng.choice(words)}" for _ in range(400)]
    urls += [f"http://{h}.org/x" for h in ("spamfarm", "a.spamfarms12", "spam-farm3", "notspamfarm", "spam-farmer", "spamfarm.spam-farm")]
    rules += op9_urls.PATTERN_RULES
    got = {r.page_id: (r.rule, r.verdict, r.pattern_rule) for r in op9_urls.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for k, url in enumerate(urls):
        host, path, whole = op9_urls._parts(url.encode())
        fits = [r for r in rules if op9_urls._compiled(r.pattern).search(host + path if r.on == "site" else whole)]
        site = max((r for r in fits if r.on == "site"), key=lambda r: len(r.name), default=None)
        pattern = next((r for r in fits if r.on == "url"), None)
        assert got[k] == (site and site.name, (site or pattern).verdict if site or pattern else "allow", pattern and pattern.name), url
    assert [got[k][1] for k in range(400, 406)] == ["block", "block", "block", "allow", "allow", "block"]


# --- token files


def test_codes_give_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 1 << 31, 50), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    rng.shuffle(ids)
    s = dac.Segment(dac.encode_segment(ids))
    assert all(s[i] == ids[i] for i in range(len(ids)))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (s.slice(a, b) == ids[a:b]).all()
    assert len(dac.Segment(dac.encode_segment(np.empty(0, np.uint32)))) == 0


def test_file_of_segments(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(k if k % 3 else None, rng.integers(0, 50_000, rng.integers(0, 90)).astype(np.uint32)) for k in range(60)]
    with open(tmp_path / "f", "wb") as f:
        w = dac.Writer(f, segment_ids=200)
        for d in docs:
            w.add(*d)
        w.close()
    data = (tmp_path / "f").read_bytes()
    r = dac.Reader(lambda n, at: data[at : at + n], len(data))
    assert len(r.segments) > 3 and [(i, ids.tolist()) for i, _, ids in r.documents()] == [(i, ids.tolist()) for i, ids in docs]
    whole = np.concatenate([ids for _, ids in docs])
    assert (r.ids(150, 900) == whole[150:900]).all() and r[321] == whole[321]


def brute_ids(rows):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    model, at, out = Tokenizer.from_file(p.path("word_bpe_49k.json")), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark):
    import public_tokenizers as p

    docs = odd_documents(spark)
    path = p.path("word_bpe_49k.json")
    got = [tuple(r) for r in op10_token_ids.encode_documents(docs, path).collect()]
    assert sorted(got, key=str) == sorted(brute_ids([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert op10_token_ids.encode_documents(empty_documents(spark), path).count() == 0


def test_word_encoder_is_the_tokenizer():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    rng, path = random.Random(6), p.path("word_bpe_49k.json")
    alphabet = list("abcXYZ ’'.,;:!?…éÉİıſKΣσς0٣½²\u0301\u200d\xad\x1c\x85\xa0\u3000\n\t\x0b-_<>|#ª  ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "...", "ﬁ", "漢", "😀", "ẞ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    encoder = op10_token_ids.WordEncoder(path, limit=500)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for k in range(0, 4000, 500):
        flat, at = encoder.encode(pa.array(texts[k : k + 500]))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want[k : k + 500]
    assert [a.tolist() for a in encoder.encode(pa.array([], pa.string()))] == [[], [0]]


def test_word_encoder_learns_a_word_once():
    """Whatever punctuation closes it, and, while it is met again, though more words come by than are remembered."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    rng, path, asked = random.Random(9), p.path("word_bpe_49k.json"), []
    model, encoder = Tokenizer.from_file(path), op10_token_ids.WordEncoder(path, limit=2000)
    learn = encoder._learn
    encoder._learn = lambda words: asked.extend(words) or learn(words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) + rng.choice(["", "", "é", "ß"])
    common, tails = [word() for _ in range(300)], ["", ".", "!!", "###", ".***", "'", '",', ")" * 9]
    for _ in range(20):
        words = [w + rng.choice(tails) for w in common + [word() for _ in range(200)]]
        flat, at = encoder.encode(pa.array([" ".join(words), "x" * 100, ""]))
        want = [e.ids for e in model.encode_batch([" ".join(words), "x" * 100, ""], add_special_tokens=False)]
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert len(asked) <= len(common) + 20 * (200 + 1) + 4 * len(tails)
    assert max(map(len, encoder.known)) <= encoder.longest


def test_a_lean_worker_gives_freed_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    pins = []

    def run(batches):
        held = [np.ones(8_000) for _ in range(3_000)]  # 192 MB of blocks that malloc keeps, as the last one stays in use
        pins.append(np.ones(8_000))
        del held
        yield from batches

    before = resident()
    assert list(lean(run)([1, 2])) == [1, 2] and resident() - before < 60
