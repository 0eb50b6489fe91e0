import sys

from cpelink.llm import decontam, linededup, packing, quality, superminhash

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as P  # noqa: E402


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_stages_over_the_fixture(spark, sf_dir):
    """Each stage keeps the documents' columns and does what its operator says of its own input."""
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows, before = out.collect(), docs.collect()
        ids = order([(r.doc_id,) for r in rows])
        if name == "quality_rules":
            want = [(r.doc_id,) for r in quality.quality_report(docs).collect() if r.kept]
        elif name == "line_dedup":
            want = [(r.doc_id,) for r in before]
            lost = {r.doc_id: r.n_dropped for r in linededup.line_dedup_report(docs).collect()}
            old = {r.doc_id: r.text for r in before}
            assert sum(lost.values()) and all((r.text == old[r.doc_id]) == (lost[r.doc_id] == 0) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            found = superminhash.near_dup_report(docs, superminhash.NearDup(words=2)).collect()
            want = [(r.doc_id,) for r in found if r.kept]
            assert len(want) < len(before)
        else:
            want = [(r.doc_id,) for r in decontam.contamination_report(docs, bench).collect() if not r.contaminated]
            assert len(want) < len(before)
        assert ids == order(want)
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    ran = P.run(spark, sf_dir).collect()
    total = lambda rows: order([(r.doc_id, r.doc_tokens) for r in rows if r.start == 0])
    assert total(ran) == total(pieces) and packing.SCHEMA.count("long") == len(ran[0])


def test_stages_over_hard_rows(make_docs, hard_texts, spark, sf_dir):
    docs = make_docs(hard_texts)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    docs.collect()
    none = make_docs([])
    for _, stage in P.STAGES:
        none = stage(spark, none, sf_dir)
    assert none.collect() == []


def test_columns_of_clashing_names(spark, sf_dir):
    """Names that the operators use inside stay with the user's values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["__id", "__th", "__row", "__drop", "row", "n_lines", "n", "k1", "component", "a.b"]
    for name in names:
        docs = docs.withColumn(name, docs.doc_id * 7)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id * 7 for r in rows for c in names)
    P.STAGES[-1][1](spark, docs, sf_dir).collect()
