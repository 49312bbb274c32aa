"""Every query and the pipeline over tables with nulls everywhere, repeated rows, long and empty texts, and extra columns named like ours."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlens.llm import registry

CLASHES = {
    "documents": "key id n component score quality_score label drop lines version grp bin offset regs ids rows base spans held_out kept_text line_counts twin band digest form output",
    "labels": "text label source lang",
    "embeddings": "block side rank vector rec_id query_id id w twin key keys of",
    "conversations": "part which alone turns perspective said section at blank cut kind copy n _conv",
}


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")

    def put(name, rows, odd_rows):
        df = rows.unionByName(spark.createDataFrame(odd_rows, rows.schema))
        df.select("*", *[F.lit(1).alias(c) for c in CLASHES[name].split()]).write.parquet(str(folder / f"{name}.parquet"))

    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    docs = read("documents").orderBy("doc_id").limit(30)
    put("documents", docs.unionByName(docs.limit(4)), [(None,) * 5, (900, None, None, None, None), (901, "", None, None, 0), (None, "a text without an id", None, None, 3), (902, "word " * 60_000, None, None, 1), (903, " \n\t", "en", "s", 3)])
    put("labels", read("labels"), [(None, None, None), (900, 1, 0), (0, 0, 0), (0, 1, 0)])
    put("embeddings", read("embeddings").orderBy("vec_id").limit(60), [(None, None, None), (100, None, 1), (200, [], 1), (300, [1.0, 2.0], 1), (400, [None, 1.0], 1)])
    put("conversations", read("conversations"), [(None,) * 4, (None,) * 4, (7777, 0, None, "x")])
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_rows(spark, odd, name):
    rows = registry.queries()[name](spark, odd).collect()
    n = spark.read.parquet(f"{odd}/documents.parquet").count()
    if name in ("op1_quality", "op6_line_dedup", "op7_secrets", "op8_near_duplicates", "op10_bpe", "op13_fill_in_middle"):
        assert len(rows) == n  # a row for every row
    assert rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, small, tmp_path, name):
    for t in CLASHES:
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert registry.queries()[name](spark, str(tmp_path)).collect() == []


def test_pipeline_over_odd_rows(spark, odd):
    assert corpus_pipeline.run(spark, odd).count() > 0
