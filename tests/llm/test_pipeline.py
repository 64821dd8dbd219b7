import corpus_pipeline
from starlace.llm import registry


def test_stages_on_odd_rows(spark, odd, none, clashing):
    for docs in (odd, none):
        some = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, some, "/root/testdata/sf0.001")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert got.columns == docs.columns, name
                some = got
            rows = got.collect()
        assert (len(rows) > 0) == (docs is odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, "/root/testdata/sf0.001").columns == clashing.columns, name


def test_run(spark, small):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in small.collect()}
    assert 0.5 * len(docs) < len(got) < len(docs)
    assert sum(got[i].decoded == docs[i] for i in got) > 0.8 * len(got)
    assert all(r.n_pieces == len(r.piece_ids) for r in got.values())


def test_registry():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
