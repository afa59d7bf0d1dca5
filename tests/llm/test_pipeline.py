"""The pipeline's stages against brute force, each on its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_repeats, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    base = [prose(rng, 70, "aeiourst" if i % 2 else "kwzxyjvb") for i in range(120)]
    shared = prose(rng, 30, "aeiourst")
    texts = base + base[:10] + [t.upper().replace(" ", "!! ") for t in base[:40]] + [f"{prose(rng, 40, 'aeiourst')} {shared} {prose(rng, 40, 'aeiourst')}" for _ in range(6)] + ["12 34", None, ""]
    rows = [(i, t, "two" if i % 2 == 0 and i < 170 else "one", "s", len(t or "")) for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(i, int(not 130 <= i < 170), 0) for i in range(0, 176)], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "repeats", "packing"]
    good = corpus_pipeline.quality(spark, docs, folder)
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.collect()}
    assert set(range(130)) <= ids and not ids & set(range(130, 170))
    known = corpus_pipeline.language(spark, good, folder)
    assert {r["doc_id"] for r in known.collect()} & {176, 177, 178} == set()
    assert known.filter("doc_id < 130").count() == 130
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    left = corpus_pipeline.near_duplicate(spark, known, folder)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, (_, c) in brute_components(rows) if k == c)
    rows = [(r["doc_id"], r["text"].encode()) for r in left.collect()]
    cut = corpus_pipeline.repeats(spark, left, folder)
    assert cut.columns == docs.columns
    want = {k: v[0] - v[1] for k, v in brute_repeats(rows)}
    assert {r["doc_id"]: len(r["text"].encode()) for r in cut.collect()} == {k: v for k, v in want.items() if v}
    assert cut.filter(F.length("text") != F.col("n_chars")).count() == 0


AWKWARD = COLUMNS + ", score string, row string, _row string, number string, lang_pred string, n_removed string, found string"


def awkward(spark, folder, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w", "v", "u", "t") for r in rows], AWKWARD).repartition(2)


def test_stages_on_awkward_rows(spark, folder):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60, "aeiourst") for _ in range(3))
    near = a.split()
    near[30] = "changed"
    rows = [(1, a), (2, a), (2, b), (2, b), (3, " ".join(near)), (None, c), (None, c), (None, None), (4, None), (4, ""), (5, "12"), (5, c), (6, c)]
    docs = awkward(spark, folder, [(k, t, "one", "s", len(t or "")) for k, t in rows])
    left = corpus_pipeline.near_duplicate(spark, docs, folder)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"] or "") for r in left.collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (None, c), (None, c), (None, ""), (4, ""), (5, "12"), (5, c)], key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= len(rows), name
        assert {r["source"] for r in out.collect()} <= {"s"} and {r["row"] for r in out.collect()} <= {"y"}, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    cut = corpus_pipeline.repeats(spark, docs, folder).collect()
    want = {}
    for k, v in brute_repeats([(k, (t or "").encode()) for k, t in rows]):
        want.setdefault(k, []).append(v[0] - v[1])
    assert sorted(len(r["text"].encode()) for r in cut) == sorted(n for v in want.values() for n in v if n)
    packed = corpus_pipeline.packing(spark, docs, folder)
    assert packed.count() >= len(rows) and corpus_pipeline.packing(spark, docs.limit(0), folder).count() == 0


def test_quality_and_language_by_brute_force(spark, folder):
    """The stages' decisions are those of the models' scores, worked out for each text by itself."""
    import pyarrow as pa

    from strataq.llm import langid, nbsvm

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    features, y = nbsvm.labelled_features(docs, labels, 5000, "doc_id", "text", "quality")
    model = nbsvm.fit(features, y)
    one = lambda t: next(nbsvm.feature_ids(*langid.text_bytes(pa.array([t], pa.string()))))
    good = [r["doc_id"] for r in rows if model.score(one(r["text"])) >= 0.3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, docs, folder).collect()) == good
    counts = langid.training_counts(docs, 400, "doc_id", "text", "lang")
    langs, trees = langid.worker_trees("brute", counts)
    want = {}
    for r in rows:
        (said,), (sure,) = langid.score_texts(langs, trees, pa.array([r["text"]], pa.string()))
        if said != "und" and sure >= 0.5:
            want[r["doc_id"]] = said
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, folder).collect()} == want


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).filter("n <> all").count() == 0
    assert out.select("doc_id").distinct().count() > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_over_whole_tables(spark):
    from strataq.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name, f in QUERIES.items():
        if name not in ("op5_top_k", "op7_packing"):
            assert f(spark, "/root/testdata/sf0.001").count() == docs, name
