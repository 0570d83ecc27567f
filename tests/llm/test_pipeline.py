import json

import corpus_pipeline
from paperloom.llm import queries
from tests.llm.data import DOCS, prose, rows
from tests.llm.test_quality import base

ITEM = prose(77, 30)


def test_stages(spark, tmp_path):
    clean = [prose(i, 60) for i in range(30)]
    near = prose(400, 900)
    licence = "Licensed under the general terms of version {} of this text."
    texts = clean + ["too short", None, "spam word " * 60] + [near, near, near.replace("ba", "be", 1)]
    texts += [f"{prose(600 + i, 60)}\n{licence.format(i)}" for i in range(8)] + [f"{prose(700, 50)} {ITEM} {prose(701, 50)}"]
    spark.createDataFrame(rows(texts), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    kept = lambda name: {r["doc_id"] for r in seen[name]}
    assert kept("quality_rules") == {i for i, t in enumerate(texts) if not base(t)[5]}
    assert kept("line_dedup") == kept("quality_rules")
    text_of = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert all(text_of[i]["text"] == clean[i] and text_of[i]["n_chars"] == len(clean[i]) for i in range(30))
    assert not any("Licensed" in r["text"] for r in seen["line_dedup"])
    assert kept("near_dedup") == kept("line_dedup") - {34, 35}
    assert kept("decontamination") == kept("near_dedup") - {44}
    assert kept("packing") == kept("decontamination")
    final = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()
    assert sorted(map(str, final)) == sorted(str(r).split(", sequence_id")[0] + ")" for r in seen["packing"])


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert json.dumps(sorted(queries.ORACLE_SQL)) is not None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_table_and_columns_named_like_the_stages_own(spark, tmp_path):
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows([prose(1, 60), prose(1, 60), None, prose(2, 60)]), DOCS)
    for name in ("verdict", "drop", "lines", "hit_id", "one_id", "One_Hash", "bad_id", "__id", "__hash", "__drop", "__quality_verdict", "node", "root", "h"):
        docs = docs.withColumn(name, docs["doc_id"])
    for table in (docs, docs.where("false")):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{table is docs}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{table is docs}"))
            assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} == ({0, 3} if table is docs else set())
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == (2 if table is docs else 0)
