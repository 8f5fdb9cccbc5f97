"""Each stage of the pipeline against a plain version of it, on documents made for that."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import helpers
from padlake.llm import decontaminate, line_dedup
from padlake.llm.labelled import fold
from test_operators import _hash, prose

pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts in lines, junk, copies exact and near, passages of a benchmark."""
    rng = random.Random(11)
    sf = str(tmp_path_factory.mktemp("sf"))
    good = ["\n".join(prose(rng, 12, 5000) + "." for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    junk = ["*** ### " * 30 for _ in range(30)]
    copies = [good[k] for k in range(10)] + [good[k].replace("w1", "v1", 1) for k in range(10, 25)]
    items = [prose(rng, 24, 5000) for _ in range(6)]
    leaks = [good[30 + k] + " x\n" + items[k % 6] + " y" for k in range(12)]
    texts = good + junk + copies + leaks + [None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 0 if 120 <= k < 150 else 1, 0) for k in range(len(texts)) if k < 150]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{len(seen)}")
        docs = spark.read.parquet(f"{folder}/{len(seen)}")
        seen[name] = (before, {r.doc_id: r.text for r in docs.collect()})
        assert docs.where(F.length("text") != F.col("n_chars")).count() == 0

    before, after = seen["quality classifier"]
    assert not set(range(120, 150)) & set(after) and set(range(120)) <= set(after)

    before, after = seen["line dedup"]
    want = helpers.line_dedup([(d, t) for d, t in before.items() if t is not None], _hash, line_dedup.WINDOW, line_dedup.DIVISOR, line_dedup.BASE, line_dedup.MODULUS)
    assert {d: t for d, t in after.items() if t is not None} == want and set(after) == set(before)

    before, after = seen["n-gram Jaccard join"]
    groups = helpers.jaccard_components(list(before.items()), 5, 80)
    assert set(after) == {d for d, (n, c) in groups.items() if c == d}

    before, after = seen["benchmark decontamination"]
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {d for d, t in before.items() for w in items if any(w == x for x in (decontaminate.words(t)[k : k + len(w)] for k in range(len(decontaminate.words(t)))))}
    assert set(after) == set(before) - leaked and leaked

    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == set(after) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in last)

    ran = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in ran) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_near_copies_of_repeated_and_null_ids(spark, folder):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60, 5000) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(1, a), (1, a), (1, near(a)), (2, near(a)), (3, b), (3, c), (None, a), (None, d), (None, d), (None, near(d)), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], COLUMNS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, folder).collect()]
    assert [k for k, t in got if t in (a, near(a))] == [1]
    assert [k for k, t in got if t in (d, near(d))] == [None]
    assert sorted(t for k, t in got if k == 3) == sorted([b, c])
    assert (4, None) in got and (5, "") in got and len(got) == 6


def test_stages_are_passed_on_as_parquet(spark, folder, monkeypatch):
    read, one = [], lambda s, docs, sf: (read.append(docs.inputFiles()), docs)[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", one), ("b", one), ("c", one)])
    assert corpus_pipeline.run(spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    shared = corpus_pipeline.shared_folder(spark).removeprefix("file:")
    assert all(shared in f and ".parquet" in f for files in read[1:] for f in files) and all(read)


def test_labels_of_folds(spark):
    got = spark.range(2000).select(fold("id", 4).alias("f")).groupBy("f").count().collect()
    assert len(got) == 4 and np.ptp([r["count"] for r in got]) < 200


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder) if docs.columns else docs
        assert docs.count() == 0
