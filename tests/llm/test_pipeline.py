"""Each stage of the pipeline over what the one before kept, against brute force; and the whole run."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ladle.llm import op5_mixing, op6_quality, op8_decontaminate, pipeline
from ladle.llm.queries import oracle_sql, queries

from .test_operators import brute_groups, brute_ids, prose
from ladle.llm.op4_jaccard import Measure

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad prose, near copies, benchmark passages and odd rows."""
    rng, d = random.Random(11), tmp_path_factory.mktemp("sf")
    items = [(k, prose(rng, 40)) for k in range(4)]
    rows, labelled = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = prose(rng, rng.randint(40, 90), 60).capitalize() + "."
        if bad:
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())
        elif k % 10 == 1:
            text = rows[-2][1] + " closing words" if k > 2 else text
        elif k % 10 == 3:
            text = text + " " + rng.choice(items)[1] + " " + text[:40]
        rows.append((k, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
        labelled.append((k, int(not bad), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "tiny", "en", "b", 4)]
    spark.createDataFrame(rows, COLUMNS + "").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def test_stages(spark, corpus):
    sf_dir, items = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k == 4:
            break
        rows = out.collect()
        assert out.columns == columns and all(r.text == kept[r.doc_id] for r in rows), name
        got = Counter(r.doc_id for r in rows)
        if k == 0:
            model = op6_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = Counter(i for i, t in kept.items() if model.score(t.encode() if t is not None else None) >= op6_quality.THRESHOLD)
            assert sum(i % 4 != 0 for i in range(400)) == sum(i < 400 and i % 4 != 0 for i in got)  # clean documents stay
            assert sum(i < 400 and i % 4 == 0 for i in got) < 10
        elif k == 1:
            groups = brute_groups(kept, Measure(5, 80, 100))
            want = Counter(i for i, (_, first) in groups.items() if i == first)
            assert len(want) < len(groups)
        elif k == 2:
            index = op8_decontaminate.Items(items)
            known = op8_decontaminate.WordHashes()
            want = Counter(i for i, t in kept.items() if not index.matches(known.of(op8_decontaminate.plain_words((t or "").encode()))))
            passages = [t.lower() for _, t in items]
            assert not any(p in (t or "").lower() for i, t in kept.items() if i in want for p in passages) and len(want) < len(kept)
        else:
            placed = op5_mixing.mix_sources(docs).collect()
            want = Counter({r.doc_id: -(-r.taken // r.size) for r in placed if r.taken})
        assert got == want, name
        kept = {i: kept[i] for i in got}
        docs = spark.createDataFrame(rows, docs.schema)
    last = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_ids(last))


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated and null ids: a row is dropped for its own text only, and no group vanishes."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(1, a), (5, near(a)), (5, b), (6, near(b)), (7, c), (7, c), (None, near(c)), (None, d), (None, near(d)), (8, None), (8, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], COLUMNS)
    got = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    last = [x for x in got if x[0] is None]
    assert len(last) == 1 and last[0][1] in (d, near(d))
    assert got == Counter({(1, a): 1, (5, b): 1, (7, c): 1, last[0]: 1, (8, None): 2, (8, ""): 2})


def test_stages_of_empty_and_odd_tables(spark, corpus, tmp_path):
    """No rows, nulls in all columns, repeated rows and columns that are not of documents."""
    sf_dir, _ = corpus
    wide = COLUMNS + ", size string, target string, key string, n long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "one two three", "en", "a", 3), (1, "one two three", "en", "a", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], wide)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            got = out.collect()
            assert len(got) <= 2 * len(rows) and (k == 4 or out.columns == [c.split()[0] for c in COLUMNS.split(", ")])
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).collect()
    assert mixed and {r.text for r in mixed} == {"one two three"}


def test_run_is_the_stages(spark, corpus):
    sf_dir, _ = corpus
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    again = entry.queries()["pipeline"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) > 100


def test_registered_queries():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(oracle_sql()) <= set(names) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
