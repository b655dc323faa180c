import glob

import corpus_pipeline
from beamloom.llm import shared
from beamloom.llm.components import components


def test_a_stage_table_goes_once_the_next_is_there(spark, tmp_path, monkeypatch):
    spark.range(50).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, sf: d.filter("id % 10 <> 3")) for n in ("quick a", "quick b", "quick c", "last")])
    there = lambda: set(glob.glob(f"{shared.shared_dir(spark)}/stage-quick-*"))
    before = there()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 45
    assert len(there() - before) == 1 and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 50


def test_tables_of_an_operator_go_before_its_texts_are_joined(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a " + passage, "x"), (2, passage + " b", "y"), (3, "c", "z"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    there = lambda: {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in set(glob.glob(f"{shared.shared_dir(spark)}/*")) - before}
    before = set(glob.glob(f"{shared.shared_dir(spark)}/*"))
    out = corpus_pipeline.repeated_passages(spark, docs, str(tmp_path))
    assert there() == {"cut"}
    assert sorted(out.collect()) == [(1, "a " + passage, "x"), (2, " b", "y"), (3, "c", "z"), (4, None, None)]


def test_links_lie_in_few_files(spark):
    """Tables of the rounds have no more files than tasks keep the cores busy, however many partitions a shuffle has."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 97)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(spark.range(1, 2000).selectExpr("id AS u", "id - id % 10 AS v"))
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism < 97
        got = {r.node: r.component for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(2000)}
