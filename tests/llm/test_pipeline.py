"""The pipeline's stages against brute force, each over what its predecessor kept."""

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ebbmark.llm import bpe, toxicity
from ebbmark.llm.common import id_remainder
from ebbmark.session import stored
from tests.llm.test_native import brute_hits, brute_redacted, secret_rows
from tests.llm.test_nearcopies import brute_groups


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], small), name))
    return [sorted(t.collect(), key=lambda r: r.doc_id) for t in tables], [t.columns for t in tables]


def test_columns(stages):
    columns = stages[1]
    assert all(sorted(c) == sorted(columns[0]) for c in columns[:-1]) and "ids" in columns[-1]


def test_toxic_documents_go(spark, small, stages):
    before, after = stages[0][:2]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs.where(id_remainder(docs["doc_id"], 5) != 0), spark.read.parquet(f"{small}/labels.parquet"), corpus=docs)
    toxic = {r.doc_id for r in toxicity.score(docs, model, doc_id=docs["doc_id"]).where("predicted = 1").collect()}
    assert [r.doc_id for r in after] == [r.doc_id for r in before if r.doc_id not in toxic]


def test_one_of_each_group_stays(stages):
    before, after = stages[0][1:3]
    groups = brute_groups([r.text for r in before])[0]
    assert after == [r for i, r in enumerate(before) if groups[i] == i]


def test_contaminated_documents_go(spark, small, stages):
    before, after = stages[0][2:4]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def clean(r):
        n, hit, _ = brute_hits(r.text, items)
        return not (hit and 20 * hit >= n)
    assert after == [r for r in before if clean(r)]


def test_live_secrets_are_masked(spark, small, stages):
    before, after = stages[0][3:5]
    assert [r.text for r in after] == brute_redacted([(r.doc_id, r.text, r.source) for r in before])
    more = secret_rows()  # the small table has few secrets
    planted = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in more], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.secrets_stage(spark, planted, small).collect()
    assert sorted(r.text or "" for r in rows) == sorted(t or "" for t in brute_redacted(more))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_ids_decode_to_the_texts(stages):
    before, after = stages[0][4:6]
    library = Tokenizer.from_file(bpe.default_path())
    assert [(r.doc_id, r.ids) for r in after] == [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in before]


def test_run_returns_the_last_stage(spark, small, stages):
    assert sorted(corpus_pipeline.run(spark, small).collect(), key=lambda r: r.doc_id) == stages[0][-1]


def test_stages_take_empty_tables(spark, small, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs.select("doc_id", "text", "lang", "source", "n_chars"), small).collect() == []
