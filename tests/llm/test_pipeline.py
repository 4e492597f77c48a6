"""The pipeline against a plain version of its stages, and the queries that SQL can state."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowtide.llm import CATALOG
from tests.compare import assert_same, duck
from tests.llm.test_operators import placed_well, plain_components

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if q.sql))
def test_matches_sql(spark, name):
    assert_same(CATALOG[name].run(spark, SF_DIR), duck(SF_DIR), CATALOG[name].sql)


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    judged = {r["doc_id"]: r["kept"] for r in CATALOG["op2_quality_rules"].run(spark, SF_DIR).collect()}
    scores = {r["doc_id"]: r["score"] for r in CATALOG["op9_quality_classifier"].run(spark, SF_DIR).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if judged[r["doc_id"]] and scores[r["doc_id"]] >= 0.3]
    chosen = {c for _, _, c in plain_components(texts)}
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in out} == chosen
    assert placed_well(out, 4096) <= -(-sum(r["length"] for r in out) // 4096) + 1
    assert all(labels.get(i, 1) == 1 for i in chosen)


CLASHES = ("words_", "n_lines", "n_words", "kept", "p_good", "votes", "score", "set_key", "n_shingles", "key", "row", "value", "Group", "base_failed")


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents with nulls, copies, rows without an id, and columns that operators add by name."""
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rng = random.Random(4)
    extra = " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{i % 7}" for i in range(400)) + "."
    rows = [(None, extra, None), (None, extra + " more", "s"), (10**6, extra, "s"), (10**6, extra, "s"), (10**6 + 1, None, "s"), (10**6 + 2, "", None), (None, None, None)]
    rows += [(None, extra[::-1], "s")]
    more = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    docs = base.unionByName(more, allowMissingColumns=True)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    return docs.withColumn("tags", F.create_map(F.lit("a"), "lang")).repartition(4, "doc_id", "text").cache()


def plainly(df):
    return Counter(str(r) for r in df.collect())


def test_stages_leave_columns_untouched(spark, awkward):
    before = plainly(awkward)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF_DIR)
        assert out.dtypes == awkward.dtypes
        after = plainly(out)
        assert after and not after - before


def test_rows_without_an_id_are_compared_with_all(spark, awkward):
    out = corpus_pipeline.near_copies(spark, awkward, SF_DIR)
    assert out.filter(F.col("doc_id") == 10**6).count() == 1
    assert out.filter("doc_id IS NULL AND text IS NOT NULL").count() == 1
    packed = corpus_pipeline.packing(spark, out, SF_DIR).collect()
    assert placed_well(packed, 4096) and len({(r["doc_id"], r["piece"]) for r in packed}) >= out.select("doc_id").distinct().count()


def test_empty_tables_give_no_rows(spark, awkward):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.filter("false"), SF_DIR).count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_classifier, corpus_pipeline.packing])
def test_stages_hold_little_in_a_worker(spark, monkeypatch, stage):
    """Large batches with many words that no other text has: what a worker holds is bounded."""
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    mapped, runs = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, *rest: runs.append(run) or mapped(df, run, *rest))
    stage(spark, docs, SF_DIR)
    texts = [" ".join(f"w{(500 * i + j) % 450_000:06d}" for j in range(500)) for i in range(2000)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": texts[a : a + 1000]}) for a in (0, 1000)]
    tracemalloc.start()
    assert sum(out.num_rows for out in runs[0](iter(batches))) >= len(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 150
