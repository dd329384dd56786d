import corpus_pipeline as cp
from fixtures_llm import awkward, clashing, empty

from gritstone.llm import mixing, near_dedup, ordinal_quality, packing, secret_ledger
from gritstone.llm.common import stored
from gritstone.llm.tokens import VOCABULARY, encoding


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]


def test_each_stage_against_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs
    before = {r.doc_id for r in docs.collect()}
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, left, sf_dir), name)
        assert out.columns == columns
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= before and len(ids) == len(rows)
        seen[name] = (left, out, before, ids)
        left, before = out, ids
    was, _, old, new = seen["quality"]
    model = ordinal_quality.train(was, ordinal_quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert new == {r.doc_id for r in ordinal_quality.graded(was, model).collect() if r.tail_probability >= ordinal_quality.LEAST_TAIL}
    was, _, old, new = seen["near_dedup"]
    gone = {r.doc_id: r.kept_doc_id for r in near_dedup.near_duplicates(was).collect()}
    assert new == old - set(gone) and set(gone.values()) <= new
    was, _, old, new = seen["secrets"]
    assert new == old - {r.doc_id for r in secret_ledger.findings(was).collect()}
    was, _, old, new = seen["mixing"]
    assert new == {r.doc_id for r in mixing.chosen(was).collect()}
    packed = cp.pack(spark, left, sf_dir).toPandas()
    encode = encoding(VOCABULARY).encode_ordinary
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == {r.doc_id: len(encode(r.text)) for r in left.collect()}
    assert packed.groupby("bin_id").n_tokens.sum().max() <= packing.CAPACITY


def test_run_is_the_stages(spark, sf_dir):
    got = cp.run(spark, sf_dir).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"] and len(got)


def test_awkward_documents_pass_through(spark, sf_dir):
    for docs in (awkward(spark), clashing(spark), empty(spark)):
        for _, stage in cp.STAGES[:-1]:
            out = stored(stage(spark, docs, sf_dir), "x")
            assert out.columns == docs.columns
            docs = out
        cp.pack(spark, docs, sf_dir).collect()
