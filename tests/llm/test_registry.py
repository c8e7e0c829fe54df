"""Registered queries against their SQL or a brute-force version over a whole small table."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import brute
from tools.check import TABLES, table
from wakeline.llm.oracle import ORACLE
from wakeline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries() and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    cursor = db.execute(ORACLE[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in cursor.description], cursor.fetchall())


def test_tokens(spark, docs):
    got = QUERIES["op1_bpe"](spark, SMALL).collect()
    want = brute.bpe(docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert sorted(map(tuple, got)) == sorted(want)


def test_base_scores(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op2_lm_score"](spark, SMALL).collect()}
    for doc_id, held_out, n, known, train, base in brute.base_scores(docs):
        r = got[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_lines(spark, docs):
    short = sorted(docs, key=lambda d: len(d["text"]))[:120]
    rows = spark.createDataFrame([(d["doc_id"], d["text"]) for d in short], "doc_id long, text string")
    from wakeline.llm.line_dedup import removed_lines

    assert sorted(map(tuple, removed_lines(rows).collect())) == sorted(brute.fuzzy_lines(short))
    assert QUERIES["op7_line_dedup"](spark, SMALL).count() == len(docs)


def test_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, SMALL).collect()}
    want = brute.whitening(rows)
    assert len(got) == len(want) == 32 * len(rows)
    for vec_id, component, n, deviation, whitened, explained in want:
        r = got[vec_id, component]
        assert (r.n, r.deviation, r.deviation_exact) == (n, deviation, str(deviation))
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-9)
    assert {r.identity_error for r in got.values()} == {r.identity_error} and r.identity_error < 1e-12


def test_pipeline_equals_brute_force(spark, docs):
    got = corpus_pipeline.run(spark, SMALL).collect()
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, source, SMALL).collect()}
    left = [d for d in docs if d["doc_id"] in clean]
    keep = {d for d, _, _, stays, _ in brute.exact(left) if stays}
    left = [d for d in left if d["doc_id"] in keep]
    keep = {d for d, _, _, stays in brute.near(left) if stays}
    left = [d for d in left if d["doc_id"] in keep]
    items = [r.asDict() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination(left, items) if r[5]}
    left = {d["doc_id"]: d["text"] for d in left if d["doc_id"] not in bad}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in got} == set(left) and len(got) == len(left) < len(docs)
    assert all(r.token_ids == tokenizer.encode(left[r.doc_id], add_special_tokens=False).ids for r in got)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert sorted(out.columns) == sorted(docs.columns) and out.count() <= docs.count()
