import pytest

from .helpers import rows, table
from .test_others import slow_classes
from .test_text_ops import slow_hits, slow_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    data = rows(11, 40)
    data += [(300, "a nitwit " + data[1][1], "en", "s", 0), (301, "password=hunter22x and more", "en", "s", 0), (303, "our key is token: abcdef0123456789abcdef01 today", "en", "s", 0), (302, " ".join(data[2][1].split() + ["AKIA" + "Q" * 16]), "en", "s", 0)]
    table(spark, data).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, data[4][1]), (2, "and more")], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i == 300)) for i in [*range(40), 300]], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages(spark, folder):
    """Each stage keeps what a brute-force version keeps of its own input, and the columns of documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, bench = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(r) for r in out.collect()]
        docs = spark.createDataFrame(after, out.schema)
        assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) >= 0.8 * len(before)
        elif name == "near_dedup":
            kept = {c for _, c in slow_classes(before) if c is not None}
            assert sorted(r[0] for r in after if r[0] is not None) == sorted(kept)
        elif name == "decontamination":
            assert sorted(map(str, after)) == sorted(str(r) for r, h in zip(before, slow_hits(before, bench), strict=True) if not h[-1])
        else:
            assert {r[0] for r in after} == {r[0] for r in before}
            assert not any(slow_spans(r[1]) for r in after) and any(slow_spans(r[1]) for r in before)
        assert k < 4


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(got[0].asDict())


def test_run_goes_on_after_a_failure(spark, folder, tmp_path, monkeypatch):
    whole = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    called = []

    def counted(name, stage):
        def call(spark, docs, sf_dir):
            called.append(name)
            if name == "secrets" and called.count(name) == 1:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(n, s)) for n, s in corpus_pipeline.STAGES])
    own = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, folder, own)
    assert sorted(map(str, corpus_pipeline.run(spark, folder, own).collect())) == whole
    assert called == ["toxicity", "near_dedup", "decontamination", "secrets", "secrets", "packing"]
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["4-packing"]


def test_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts; then no documents at all, no labels and no benchmark."""
    rows_ = [(None, "a text that has no id", "en", "s", 0), (None, None, None, None, 0), (1, "one two three", "en", "s", 0), (1, "one two three", "en", "s", 0), (2, "", "en", "s", 0)]
    for name, data in (("some", rows_), ("none", [])):
        at = tmp_path / name
        table(spark, data).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert sorted({(str(r.doc_id), r.doc_tokens) for r in got}) == ([("1", 4), ("2", 1), ("None", 1), ("None", 7)] if data else [])
