"""The pipeline on an empty table and on odd rows with columns of their own."""

import corpus_pipeline


def test_odd_and_empty_tables(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a", 7), (1, text, "a", 7), (2, None, "a", 7), (3, "", None, 7), (4, text.replace("word5", "other"), None, 7), (None, "null id " + " ".join(f"z{i}" for i in range(50)), None, 7), (5, "long " + " ".join(f"q{i}" for i in range(9000)), "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if name == "empty":
            assert got == []
        else:
            assert {r["doc_id"] for r in got} <= {1, 4, 5, None} and {r["doc_id"] for r in got} >= {5}
            assert len({r["piece"] for r in got if r["doc_id"] == 5}) > 1
