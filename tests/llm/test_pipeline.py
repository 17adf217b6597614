"""The pipeline's stages: each takes effect, keeps clean documents, and agrees with a slow version."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from pricetide.llm import langid, packing, quality
from pricetide.llm.common import in_fold, table
from pyspark.sql import functions as F

from test_neardup import brute
from test_packing import check
from test_pii import base

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and what each stage returned."""
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append([r.asDict() for r in docs.collect()])
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, [r.asDict() for r in docs.collect()]]


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_all_but_the_last_return_documents(stages):
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for rows in stages[:-1] for r in rows[:3])
    assert len(stages) == len(corpus_pipeline.STAGES) + 1


def test_quality(spark, stages):
    docs = table(spark, FOLDER, "documents")
    model = quality.fit(docs, table(spark, FOLDER, "labels"), ~in_fold(F.col("doc_id"), 3, 1))
    scores = model.scores(quality.features([r["text"] for r in stages[0]], model.vectors))
    assert ids(stages[1]) == {r["doc_id"] for r, s in zip(stages[0], scores, strict=True) if s >= 0.5}
    good = {r["doc_id"] for r in table(spark, FOLDER, "labels").where("quality = 1").collect()}
    assert len(good & ids(stages[1])) >= 0.95 * len(good)
    assert 0 < len(stages[1]) < len(stages[0])


def test_language(spark, stages):
    model = langid.fit(spark.createDataFrame(stages[1]), ~in_fold(F.col("doc_id"), 4, 2))
    compressors = [[langid.compressor(d) for d in shards] for shards in model.shards]
    clear = {}
    for r in stages[1]:
        if any(c.isalpha() for c in r["text"] or ""):
            size = langid.sizes(r["text"], compressors)
            if 1 / (2 ** ((size.min() - size) / langid.BYTES_PER_HALVING)).sum() >= langid.MIN_SCORE:
                clear[r["doc_id"]] = model.languages[int(size.argmin())]
    assert {r["doc_id"]: r["lang"] for r in stages[2]} == clear
    assert len(stages[2]) >= 0.97 * len(stages[1])


def test_near_duplicates(stages):
    want = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in stages[2]], 5) if kept}
    assert ids(stages[3]) == want and len(stages[3]) == len(want) < len(stages[2])


def test_personal_data(stages):
    assert ids(stages[4]) == ids(stages[3]) and len(stages[4]) == len(stages[3])
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    assert sum(bool(base(t)) for t in before.values()) > 0
    for r in stages[4]:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(before[r["doc_id"]]) and r["text"] != before[r["doc_id"]]:
            assert "_LIKE>" in r["text"]


def test_packing(stages):
    check(stages[5], [(r["doc_id"], r["text"]) for r in stages[4]], packing.CAPACITY)
    assert ids(stages[5]) == ids(stages[4])


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages[5])


def test_one_row_of_each_group_stays(spark):
    draw = random.Random(3)
    long, near, clean, none = (" ".join(f"{c}{draw.randint(0, 999)}" for _ in range(80)) for c in "abcd")
    near = long + " end"
    rows = [
        *[(7, clean, "s")] * 50, (8, clean, "t"), (None, clean, "u"),  # a row that repeats, and copies of it
        (1, long, "s"), (2, near, "s"), (2, none, "s"),  # an id with a copy of a smaller id and a clean text
        *[(None, "only rows without an id", "s")] * 20, (None, "only rows without an id", "t"),
        (9, None, "s"), (10, None, "s"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs.repartition(8), FOLDER)
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(7, clean), (1, long), (2, none), (None, "only rows without an id"), (9, None), (10, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
