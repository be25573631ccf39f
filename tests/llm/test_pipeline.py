"""The stages on awkward documents: each against what it promises of its own input."""

import corpus_pipeline
from quiver.llm.decontamination import find_items
from tests.llm import data


def test_stages(spark, tmp_path):
    leak = "a benchmark question of more than five words that has leaked into one of the documents"
    texts = [*data.awkward(), (300, f"before {leak} after", "en", "a")]
    data.frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(1, 14)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(texts)  # one class of labels rejects nothing
    once = corpus_pipeline.near_dedup(spark, kept, str(tmp_path))
    want = data.components(texts)
    ids = [r.doc_id for r in once.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in want if want[i] == i}) and once.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, once, str(tmp_path))
    assert 300 not in [r.doc_id for r in clean.collect()] and clean.count() == len(ids) - 1
    assert find_items(clean, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
    mixed = corpus_pipeline.mixing(spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns
    sharded = corpus_pipeline.sharding(spark, mixed, str(tmp_path))
    assert sharded.count() == mixed.count()


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    texts = [*data.awkward(), (12, "another text of the same id", None, None)]
    for name, rows, labels, items in (("all", texts, [(6, 1), (9, 0), (10, 0), (None, 1), (11, None)], [(None, "one two"), (1, None)]), ("none", [], [], [])):
        folder = f"{tmp_path}/{name}"
        data.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert bool(got) == bool(rows) and 4 not in {r.doc_id for r in got}
