import re

import corpus_pipeline
from stylograin.llm import decontaminate, near_dup, quality, secrets
from stylograin.llm.common import stored


def test_stages_on_the_given_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, before, folder), f"test{k}")
        if k < 4:
            assert after.dtypes == docs.dtypes
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and after.count() == len(kept) > 0.5 * len(ids)
        if k == 0:
            judged = quality.judged(before, labels)
            assert kept == {r.doc_id for r in judged.where("kept").collect()}
        elif k == 1:
            assert kept == {r.doc_id for r in near_dup.near_duplicates(before, size=5).where("kept").collect()}
        elif k == 2:
            left = decontaminate.benchmark_hits(after, benchmark)
            hit = {r.doc_id for r in decontaminate.benchmark_hits(before, benchmark).where("size(hit_spans) > 0").collect()}
            assert hit and left.where("size(hit_spans) > 0").count() == 0
            untouched = {r.doc_id: r.text for r in before.collect() if r.doc_id not in hit}
            assert {r.doc_id: r.text for r in after.collect() if r.doc_id not in hit} == untouched
        elif k == 3:
            texts = {r.doc_id: r for r in after.collect()}
            assert not any(secrets.base_spans(r.text)[0] for r in texts.values())
            assert all(r.n_chars == len(r.text) for r in texts.values())
            for r in before.collect():
                if not re.search(r"password|token|AKIA", r.text):
                    assert texts[r.doc_id].text == r.text
        else:
            assert after.where("NOT round_trip").count() == 0
        before = after


def test_run_is_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_ids", "round_trip"] and rows.count() > 100


def test_awkward_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "w " * 60, None, None, 1), (3, " ".join(f"v{i}" for i in range(80)), "en", None, None)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, table in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")),
                        ("benchmark", spark.createDataFrame([(1, None)], "item_id bigint, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [3]


def test_columns_called_like_the_operators_own_come_through(spark, tmp_path):
    extra = ["n_words", "hit_spans", "hit_items", "secrets", "_secrets", "_count_n_words", "kept", "component_id", "n_shingles", "rule", "base_failed"]
    texts = [" ".join(f"v{i}" for i in range(80)), "token = abcdefgh1 " + " ".join(f"w{i}" for i in range(80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{name} {i}" for name in extra]) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra))
    for name, table in (("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")),
                        ("benchmark", spark.createDataFrame([(1, "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10")], "item_id bigint, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    after = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stored(stage(spark, after, str(tmp_path)), f"clash{k}")
        assert after.columns == docs.columns
    rows = {r.doc_id: r for r in after.collect()}
    assert all(rows[i][name] == f"{name} {i}" for i in range(2) for name in extra)
    assert rows[0].text.startswith("v0  v11") and rows[1].text.startswith("[SECRET] w0")
