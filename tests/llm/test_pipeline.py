import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from radiolith.llm import packing, simhash, suffix_dedup, toxicity
from radiolith.llm.common import connected_components


def words_of(r, n):
    return ["".join(r.choice("abcdefghilmnorst") for _ in range(r.randrange(3, 8))) for _ in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(1)
    vocabulary = words_of(r, 800)
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = make(60)
    rows, labels = [], []
    for i in range(120):
        text = ". ".join(make(9) for _ in range(6)) + "."
        if i % 5 == 0:
            text += " what a dreadful vileness."
        rows.append((i, text))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200, rows[1][1]), (201, rows[2][1].replace(".", " .", 1)), (202, make(40) + " " + passage + " " + make(40)), (203, make(30) + " " + passage + " " + make(50)), (204, None), (205, ""), (206, make(20) + " dreadful vileness. " + make(20))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows, passage


def test_stages(spark, folder, tmp_path):
    sf, rows, passage = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 3:
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(docs.collect())
    ids = [{r["doc_id"] for r in s} for s in seen]
    assert not ids[0] & {*range(0, 120, 5), 206} and ids[0] >= {i for i, _ in rows} - {*range(0, 120, 5), 206}
    assert not ids[1] & {200, 201, 205} and {1, 2, 204} <= ids[1]  # 201 shares 45 of 56 shingles with 2
    assert ids[2] == ids[1]
    texts = {r["doc_id"]: r["text"] for r in seen[2]}
    assert passage in texts[202] and passage[20:-20] not in texts[203] and texts[1] == dict(rows)[1]
    assert ids[3] == ids[2]
    # The same as the operators one by one, held against each other's brute-force versions in the other tests.
    again = toxicity.without_toxic(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), toxicity.in_training_folds))
    again = suffix_dedup.without_repeats(simhash.one_of_each_near(again))
    assert {r["doc_id"]: r["text"] for r in again.collect()} == texts
    assert packing.pack_documents(again, corpus_pipeline.vocabulary()).count() == len(seen[3])
    assert corpus_pipeline.run(spark, sf).count() == len(seen[3])


def test_stages_carry_columns_of_clashing_names(spark, folder):
    sf, rows, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = ("fp", "component", "score", "predicted", "marks", "start", "end", "hash", "n", "`a.b`")
    wide = docs.select("*", *(F.col("doc_id").cast("string").alias(c.strip("`")) for c in extra))
    for _, stage in corpus_pipeline.STAGES[:3]:
        plain, out = stage(spark, docs, sf), stage(spark, wide, sf)
        assert out.columns == wide.columns
        got = out.collect()
        assert {r["doc_id"]: r["text"] for r in got} == {r["doc_id"]: r["text"] for r in plain.collect()}
        assert all(r[c.strip("`")] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in got for c in extra)


def test_stages_on_empty_tables(spark, folder):
    sf, _, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == 80
    assert connected_components(edges.limit(0)).count() == 0
