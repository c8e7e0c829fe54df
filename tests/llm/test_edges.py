"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from wakeline.llm import bpe, decontaminate, exact_dedup, line_dedup, near_dedup, ngram, passages, toxicity, url_filter, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, digest string, row int, slice int, content string, score int, items int, token_ids int"


def documents():
    """Small documents with copies, near copies, shared passages and all odd cases."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(40)
    out = [None, "", " \t\n", "one", "One", "one  two", "one\ttwo", "ONE TWO", base, base, base.upper(), base.replace(" ", "\n"), passage]
    for i in range(30):
        words = base.split()
        for _ in range(i % 5):
            words[r.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [f"{text(r.randint(0, 60))} {passage} {text(r.randint(0, 60))}" for _ in range(6)]
    out += [text(r.randint(1, 80)) + "\n" + text(10) + "\nthe same line in many documents, more or less " + str(i) for i in range(12)]
    out += [text(20_000), "x" * 30_000, "a" * 5_000 + " " + passage, "Mixed \x00 controls \x1c here", "<|startoftext|> ok <|endoftext|>"]
    return [{"doc_id": None if i == 20 else i * 3 + 1, "text": t} for i, t in enumerate(out)]


def frame(spark, docs):
    rows = [(d["doc_id"], d["text"], "d", 1, 2, "c", 3, 4, 5) for d in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(spark, docs, table):
    from wakeline.llm.queries import F

    done = bpe.decode(bpe.encode(table, PATH), PATH)
    assert done.columns == [c for c in table.columns if c != "token_ids"] + ["token_ids", "decoded"]
    got = done.select("doc_id", F.size("token_ids"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256), F.sha2("decoded", 256)).collect()
    same(got, brute.bpe(docs, Tokenizer.from_file(PATH)))


def test_lm(docs, table):
    model = ngram.learn(table.where(~ngram.held_out(table.doc_id)).select("text"))
    got = {r.doc_id: r for r in ngram.score(table, model).collect()}
    assert len(got) == len(docs)
    for doc_id, _, n, known, train, base in brute.base_scores(docs):
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, model.tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_exact(docs, table):
    got = exact_dedup.exact_groups(table, ranges=3)
    same(rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact(docs))
    kept = exact_dedup.keep_first(table, ranges=3)
    assert kept.columns == table.columns
    want = sorted((d for d, _, _, stays, _ in brute.exact(docs) if stays), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_exact_with_a_hot_text_and_repeated_rows(spark):
    docs = [{"doc_id": i, "text": "hot  text" if i % 2 else "hot text"} for i in range(400)] + [{"doc_id": 5, "text": "hot text"}] * 3
    docs += [{"doc_id": i, "text": f"cold {i % 90}"} for i in range(400, 600)]
    got = exact_dedup.exact_groups(frame(spark, docs), ranges=5)
    same(rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact(docs))
    kept = exact_dedup.keep_first(frame(spark, docs), ranges=5)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(400, 490)]


def test_passages(docs, table):
    from pyspark.sql import functions as F

    for words in (13, 5, 30):
        got = passages.repeated_passages(table, min_words=words)
        same(rows_of(got, "doc_id", "n_words", "n_removed", F.sha2("kept", 256)), brute.passages(docs, words))


def test_passages_of_the_largest_identifier_and_of_none(spark):
    from pyspark.sql import functions as F

    passage = " ".join(f"w{i}" for i in range(20))
    docs = [{"doc_id": i, "text": t} for i, t in ((2**63 - 1, passage + " a"), (None, passage + " b"), (None, "only none " * 12), (None, "only none " * 12), (-(2**63), "x " + passage))]
    for some in (docs, docs[:-1]):
        frame_ = spark.createDataFrame([(d["doc_id"], d["text"]) for d in some], "doc_id long, text string")
        for parts in (1, 4):
            got = passages.repeated_passages(frame_.repartition(parts))
            same(rows_of(got, "doc_id", "n_words", "n_removed", F.sha2("kept", 256)), brute.passages(some))


def test_contamination(spark, docs, table):
    items = [{"item_id": 1, "text": docs[12]["text"]}, {"item_id": 2, "text": "ONE two!"}, {"item_id": 3, "text": None}, {"item_id": 4, "text": "?!"},
             {"item_id": 1, "text": "one two"}, {"item_id": None, "text": "controls"}, {"item_id": 10, "text": docs[12]["text"].replace(" ", ", ")}]
    frame_ = spark.createDataFrame([(i["item_id"], i["text"], 0) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(table, frame_).selectExpr(
        "doc_id", "n_words", "n_hit", "size(items)", "sha2(array_join(items, ','), 256)", "n_hit > 0 and 20 * n_hit >= n_words")
    want = brute.contamination(docs, items)
    same(got.collect(), want)
    # One document meets the item without identifier and others.
    assert any(w[3] > 1 for w in brute.contamination(docs + [{"doc_id": 900, "text": "controls one two"}], items))
    both = spark.createDataFrame([(900, "controls one two")], "doc_id long, text string")
    found = decontaminate.contamination(both, frame_).first()
    assert (found.n_hit, found["items"]) == (3, ["1", "2", None])


def test_contamination_in_parts(table, spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, docs[12]["text"]), (2, "one two")], "item_id long, text string")
    whole = rows_of(decontaminate.contamination(table, items), "doc_id", "n_words", "n_hit", "spans", "items")
    monkeypatch.setattr(decontaminate, "PART_BYTES", 800)
    assert rows_of(decontaminate.contamination(table, items), "doc_id", "n_words", "n_hit", "spans", "items") == whole


def test_near(docs, table):
    got = near_dedup.near_duplicates(table, 85)
    same(rows_of(got, "doc_id", "n_shingles", "component_id", "kept"), brute.near(docs))
    kept = near_dedup.keep_one(table, 85)
    assert set(kept.columns) == set(table.columns)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _, _, stays in brute.near(docs) if stays), key=repr)


def test_near_with_repeated_identifiers(spark):
    a, b = " ".join("abcdefghijklmnop"), " ".join("zyxwvutsrqponmlk")
    docs = [{"doc_id": 1, "text": a}, {"doc_id": 1, "text": a}, {"doc_id": 1, "text": b}, {"doc_id": 0, "text": b}, {"doc_id": None, "text": a}]
    got = near_dedup.near_duplicates(frame(spark, docs), 85)
    want = [(0, 12, 0, True), (1, 12, 0, False), (1, 12, 1, True), (1, 12, 1, False), (None, 12, None, True)]
    same(rows_of(got, "doc_id", "n_shingles", "component_id", "kept"), want)


def test_lines(docs, table):
    some = [d for d in docs if len(d["text"] or "") < 3000 and d["doc_id"] is not None]
    keep = [d["doc_id"] for d in some]
    table = table.where(table.doc_id.isin(keep))
    got = line_dedup.removed_lines(table)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.fuzzy_lines(some))
    cut = line_dedup.without_lines(table, got)
    assert cut.columns == table.columns and cut.count() == len(some)


def test_toxicity(spark, docs, table):
    words = ["idi0t", "ідіот", "IDIOT", "tr4sh"]
    r = random.Random(3)
    labelled = [(1000 + i, (docs[30 + i % 20]["text"] or "")[:300] + (f" {r.choice(words)} " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    texts = spark.createDataFrame([x[:2] for x in labelled], "doc_id long, text string")
    marks = spark.createDataFrame([(x[0], x[2], 1) for x in labelled] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    scorer = toxicity.learn(toxicity.training_rows(texts, marks))
    got = {x.doc_id: x["score"] for x in toxicity.score(texts, scorer).collect()}
    assert sum((got[d] >= 0.5) == bool(y) for d, _, y in labelled) >= 0.97 * len(labelled)
    scored = toxicity.score(table, scorer)
    assert scored.count() == len(docs) and all(0 <= x["score"] < 0.5 for x in scored.collect())
    none = toxicity.learn(toxicity.training_rows(texts, marks.limit(0)))
    assert all(x["score"] < 0.5 for x in toxicity.score(table, none).collect())


def test_exceptions_take_a_match_back():
    scorer = toxicity.Scorer({" trash ": 5.0, " idio": 4.0}, {" trash can ": -1.0}, 1.0, -2.0)
    assert scorer.raw(toxicity.folded("that trash")) > 4
    assert scorer.raw(toxicity.folded("that trash can")) < 0
    assert scorer.raw(toxicity.folded("1d10ts")) > 3 and scorer.raw(toxicity.folded("1010 10")) == 0


def pages():
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20
    out = [(3, "http://a.org/x y\n", big), (1, "http://a.org/", big), (2, None, big), (4, "http://b.org", "x" * 99), (5, "http://b.org", "x" * 99),
           (6, "http://c.org", None), (7, "", ""), (None, "http://n.org", "y" * 100), (8, "http://n.org", "y" * 100), (9, "http://l.org/a#b", "long " * 400_000)]
    return [{"page_id": a, "url": b, "html": c} for a, b, c in out]


def test_warc(spark):
    rows = pages()
    frame_ = spark.createDataFrame([(p["page_id"], p["url"], p["html"], "d", 1) for p in rows], "page_id long, url string, html string, digest string, value int")
    got = warc.round_trip(frame_, payloads=True)
    want = brute.warc(rows)
    same(got.selectExpr("page_id", "response.payload_bytes", "response.payload_digest", "response.type", "refers_to").collect(), want)
    full = {r.page_id: r for r in got.collect()}
    assert bytes(full[1].response.payload).decode() == rows[1]["html"] and full[3].response.payload is None
    assert all(r.request.record_id and r.metadata.record_id for r in full.values())
    assert full[3].target_uri == "http://a.org/x%20y%20" and full[2].target_uri is None


def test_warc_of_repeated_rows_and_none(spark):
    schema = "page_id long, url string, html string"
    twice = spark.createDataFrame([(1, "u", "z" * 200)] * 2, schema)
    assert warc.round_trip(twice).count() == 1
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_warc_query_returns_a_row_per_page_and_one_response_per_payload(spark, tmp_path):
    import duckdb

    from wakeline.llm.oracle import ORACLE
    from wakeline.llm.queries import QUERIES

    rows = [(1, "u", "z" * 200)] * 3 + [(1, "v", "z" * 200), (2, "u", "z" * 200), (2, "u", "z" * 200), (None, "w", "z" * 200)] + [(None, None, "n")] * 2
    rows += [(3, "v", "once"), (None, "a", "y" * 100), (None, "b", "y" * 100), (None, "b", "y" * 100), (4, "p", "x" * 100), (5, "p", "x" * 99), (6, "p", "x" * 99)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op10_warc"](spark, str(tmp_path)).collect()
    want = brute.warc([{"page_id": a, "url": b, "html": c} for a, b, c in rows])
    same(got, want)
    pages_ = f"with pages as (select * from '{tmp_path}/pages.parquet/*.parquet'), "
    cursor = duckdb.execute(ORACLE["op10_warc"].strip().replace("with ", pages_, 1))
    assert [c[0] for c in cursor.description] == list(got[0].asDict())
    same(cursor.fetchall(), want)
    assert sum(t == "response" and n == 200 for _, n, _, t, _ in want) == 1


def test_truncated_archive_is_refused():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nabc"))


def test_url_lists(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = spark.createDataFrame(
        [("block", "domain", "bad.org", "add", at(5)), ("block", "domain", "bad.org", "add", at(7)), ("block", "domain", "bad.org", "remove", at(20)),
         ("allow", "prefix", "x.bad.org/ok", "add", at(10)), ("block", "host", "h.org", "remove", at(3)), ("block", "host", "h.org", "add", at(3)),
         (None, "host", None, "add", at(1)), ("block", "host", "z.org", "add", None)],
        "list string, kind string, pattern string, action string, changed_at string",
    ).selectExpr("list", "kind", "pattern", "action", "cast(changed_at as timestamp) changed_at")
    rows = [(1, "HTTP://X.bad.org:80/a/b?c", 4), (2, "http://x.bad.org/a", 5), (3, "http://x.bad.org/ok/go#f", 6), (4, "http://x.bad.org/ok/go", 11),
            (5, "http://bad.org./", 19), (6, "http://bad.org", 20), (7, "http://notbad.org", 10), (8, "http://h.org", 3), (9, None, 3), (10, "junk", 3), (11, "http://z.org", 9), (8, "http://h.org", 3)]
    captures = spark.createDataFrame([(a, b, at(c), 1) for a, b, c in rows] + [(12, "http://h.org", None, 1)], "id long, url string, t string, kind int").selectExpr(
        "id", "url", "cast(t as timestamp) fetched_at", "kind")
    got = url_filter.judge(captures, entries)
    verdicts = sorted((r.id, r.verdict == "blocked", r.n_block, r.n_allow) for r in got.collect())
    assert verdicts == sorted([(1, False, 0, 0), (2, True, 1, 0), (3, True, 1, 0), (4, False, 1, 1), (5, True, 1, 0), (6, False, 0, 0), (7, False, 0, 0),
                               (8, True, 1, 0), (8, True, 1, 0), (9, False, 0, 0), (10, False, 0, 0), (11, False, 0, 0), (12, False, 0, 0)])
    assert url_filter.judge(captures.limit(0), entries).count() == 0 and url_filter.judge(captures, entries.limit(0)).count() == 13


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert near_dedup.near_duplicates(empty, 85).count() == 0 and near_dedup.keep_one(empty, 85).count() == 0
    assert line_dedup.removed_lines(empty).count() == 0
    model = ngram.learn(empty.select("text"))
    assert ngram.score(empty, model).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score for r in ngram.score(one, model).collect()] == [0.0]
    assert decontaminate.contamination(one, items).first().n_hit == 0
