"""The pipeline's stages on planted documents, and the whole of it."""

import pytest
from conftest import documents, words
from test_text_operators import check_sequences

import corpus_pipeline
from tideline.llm import near_dedup, secrets, suffix_dedup, toxicity


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "secrets", "packing"]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """What each stage returns on the smallest tables, written and read again as the next one's input."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    out.append(docs)
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_stage_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_the_first_stage_drops_what_the_operator_predicts(spark, data, stages):
    docs = stages[0]
    scored = toxicity.score(docs, toxicity.trained(docs, spark.read.parquet(f"{data}/labels.parquet")))
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}


def test_each_later_stage_acts_on_all_its_input(stages):
    toxic, near, suffix, secret, packed = stages[1:]
    classes = near_dedup.classes(toxic)
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in classes.where("stays").collect()}
    spans = {r.doc_id: r for r in suffix_dedup.spans(near).collect()}
    for r in suffix.collect():
        assert (len((r.text or "").encode()) >= spans[r.doc_id].n_bytes - spans[r.doc_id].n_removed) and (spans[r.doc_id].n_removed or r.n_chars == len(r.text or ""))
    assert secrets.scan(secret).where("n_access > 0 or n_hex > 0").count() == 0
    assert secret.count() == suffix.count() == near.count()
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in secret.collect()}
    check_sequences(packed.collect(), slack=1.1)


def test_run_gives_the_stages_rows(spark, data, stages):
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, data).collect())
    assert got == sorted(tuple(r)[:5] for r in stages[-1].collect())


def test_stages_take_edges_and_empty_tables(spark, data, edges, empty):
    for docs in (edges, empty):
        for _, f in corpus_pipeline.STAGES:
            out = f(spark, docs, data)
            assert (out.count() > 0) == (docs.count() > 0)


def test_planted_copies_and_passages(spark, data):
    passage = words(70, 70)
    rows = [(1, words(1, 200)), (2, words(1, 200)), (3, words(1, 199) + " last"), (4, words(2, 100) + " " + passage), (5, words(3, 100) + " " + passage), (6, words(4, 150))]
    docs = documents(spark, rows)
    for _, f in corpus_pipeline.STAGES[1:4]:
        docs = f(spark, docs, data)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {1, 4, 5, 6} and left[6] == words(4, 150)
    assert len(left[4]) <= len(words(2, 100)) + 2 and len(left[5]) <= len(words(3, 100)) + 2
