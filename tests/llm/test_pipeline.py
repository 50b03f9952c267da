import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    base = "clean words that many documents of this small corpus have in common with each other number"
    rows = [(i, f"{base} {' '.join(f'w{i}x{k}' for k in range(30))}", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " ", "en", "s0", 1) for i in range(5)] + [(200 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(5)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.count()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen["toxicity"] == 51 and seen["exact_dedup"] == 46 and seen["jaccard_join"] == 41
    assert docs.columns[5:] == ["ids", "n_ids"] and docs.where(F.size("ids") != F.col("n_ids")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
