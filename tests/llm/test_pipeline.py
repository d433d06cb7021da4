"""The pipeline's stages keep the columns of documents, and the last gives token ids."""

import re
from pathlib import Path

import corpus_pipeline
from logquarry.llm import registry, shared

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = shared.table(spark, FOLDER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.written(stage(spark, docs, FOLDER), f"test-{name}")
        assert out.columns == columns and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))


def test_empty_tables(spark, tmp_path):
    """Every stage and the whole pipeline on tables without rows."""
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = shared.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_odd_rows_and_a_benchmark_of_nulls(spark, docs, tmp_path):
    """Null, empty, long and repeated texts and extra columns; a benchmark that has nothing to find takes nothing away."""
    folder = str(tmp_path)
    spark.createDataFrame([(None, None), (1, None), (None, ""), (2, " ")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = shared.written(stage(spark, left, folder), "test-odd")
        assert left.columns == docs.columns
        counts.append(left.count())
    rules, one_of_each, clean, masked = counts
    assert docs.count() > rules >= one_of_each == clean == masked > 0
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert not {-1, -2, -3} & set(ids)


def test_workers_give_memory_back():
    """What a stage freed doesn't stay with the worker, where the next one would count it."""

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    before = held()
    texts = [bytes([k % 251]) * 1000 for k in range(100_000)]
    kept = texts[::500]  # these lie between what is freed
    del texts
    full = held()
    shared.give_back()
    assert len(kept) == 200 and held() - before < (full - before) / 2
