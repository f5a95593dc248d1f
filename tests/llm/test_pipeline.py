from pyspark.sql import functions as F

import corpus_pipeline as cp
from notegrid.llm import neardup
from notegrid.llm.common import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.columns == columns and 0 < out.count() <= before
        if name == "near_dedup":
            assert out.count() == neardup.link(docs).select("component_id").distinct().count()
            assert neardup.link(out).filter("not kept").count() == 0
        docs, before = out, out.count()
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before


def test_repeated_rows_and_clashes(spark, sf):
    rows = [(1, "the of and the of and the of", "en", 0.5), (1, "the of and the of and the of", "en", 0.5), (2, None, None, None), (None, "the and of to in is that was for", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    assert sorted(str(r.doc_id) for r in cp.near_dedup(spark, docs, sf).collect()) == ["1", "2", "None"]
    assert cp.language_id(spark, docs, sf).count() == 3
    assert cp.quality_filter(spark, docs, sf).columns == docs.columns
    assert cp.near_dedup(spark, docs.limit(0), sf).count() == 0


def test_repeated_ids_of_different_texts(spark, sf):
    a, b, c = ("".join(f"{w}{i} " for i in range(30)) for w in ("red", "blue", "green"))
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "en"), (2, b, "en"), (3, c, "en"), (0, c, "en"), (None, a, "en"), (4, None, "en"), (4, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_digest string")
    got = cp.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, a), (1, b), (0, c), (-1, a), (4, "")])


def test_stage_edges(spark, sf):
    word = "the of and to in is that was for as with on by at from this be are it an "
    mail = "write to ann.bell@mail.example.com or 10.20.30.40 soon "
    rows = [(1, None, 1.5, None), (2, "", 1.5, 0), (3, word * 2000 + mail, 1.5, 3), (4, mail, None, len(mail)), (None, mail, 2.5, None), (3, word * 2000 + mail, 1.5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, n_chars long").withColumn("lang", F.lit("en"))
    red = {(r.doc_id, r.score): r for r in cp.pii_removal(spark, docs, sf).collect()}
    assert len(red) == 5 and red[1, 1.5].text is None and red[1, 1.5].n_chars is None and red[2, 1.5].text == ""
    assert red[4, None].text.startswith("write to [EMAIL] or [IP] soon") and red[4, None].n_chars == len(red[4, None].text)
    assert red[3, 1.5].text.startswith(word * 2000) and "ann.bell" not in red[3, 1.5].text
    packed = cp.pack(spark, docs, sf)
    sizes = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert sizes[1] == sizes[2] == 1 and sizes[3] > 2 * 2000 * 15 and packed.filter("length > 2048").count() == 0
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_stages_give_memory_back(monkeypatch):
    import pyarrow as pa

    import corpus_pipeline
    from notegrid.llm import common

    class Docs:
        schema = None

        def mapInArrow(self, run, schema):
            return run

    calls = []
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "bb"]})
    run = corpus_pipeline.keep_texts(Docs(), lambda texts: [len(t) == 1 for t in texts])
    assert [b.to_pydict() for b in run([batch])] == [{"text": ["a"]}] and calls == [1]
    monkeypatch.undo()
    common.release()
