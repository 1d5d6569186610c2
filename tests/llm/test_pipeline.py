"""The pipeline against brute force, stage by stage, and on odd and empty inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from hydrospark.llm.common import documents
from tests.llm.test_corpus import ODD, SCHEMA, tiktoken_encoding
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it gave."""
    docs, out = documents(spark, SF), []
    for i, (name, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_are_the_asked_ones(stages, spark):
    assert [n for n, *_ in stages] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte BPE"]
    for _, given, made in stages[:-1]:
        assert made.columns == documents(spark, SF).columns


def test_toxic_documents_go(stages, spark):
    _, given, made = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in made.collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert kept <= {r["doc_id"] for r in given.collect()} and sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_exact_copies_go(stages):
    _, given, made = stages[1]
    best = {}
    for r in given.collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(best.values())


def test_near_copies_go(stages):
    _, given, made = stages[2]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert sorted(r["doc_id"] for r in made.collect()) == brute_kept(rows)


def test_mixing_and_encoding(stages):
    _, given, made = stages[3]
    before = {r["doc_id"]: r["text"] for r in given.collect()}
    after = made.collect()
    assert {r["doc_id"] for r in after} <= set(before) and max(map([r["doc_id"] for r in after].count, before)) <= 2
    e = tiktoken_encoding()
    coded = stages[4][2].collect()
    assert sorted(r["doc_id"] for r in coded) == sorted(r["doc_id"] for r in after)
    for r in coded:
        text = before[r["doc_id"]] or ""
        ids = e.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_odd_and_empty_inputs(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for name, rows in (("odd", docs), ("empty", docs.where("false"))):
        rows.withColumn("row", F.lit(1)).withColumn("id", F.lit(2)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, None)] if name == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = p.run(spark, f"{tmp_path}/{name}").count()
        assert found == 0 if name == "empty" else found > 0
