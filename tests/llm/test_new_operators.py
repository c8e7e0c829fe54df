"""Whitening, license scans and the filter audit on odd inputs and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wakeline.llm import filter_audit, license_scan, whitening
from wakeline.llm.license_scan import Automaton, mandatory, parsed
from wakeline.llm.license_templates import BASE, NOTICES, TEXTS


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


# Whitening


def test_rank_one_updates_with_equal_and_tiny_values():
    r = np.random.default_rng(5)
    for case in range(200):
        size = int(r.integers(1, 24))
        values = np.sort(r.choice([0, 0, 1, 1, 2, 3.5, 1e-9, 1e5], size)) if case % 3 else np.sort(r.random(size))
        basis, _ = np.linalg.qr(r.normal(size=(size, size)))
        vector = r.normal(size=size) * 10.0 ** r.integers(-4, 5) if case % 4 else 2 * basis[:, 0]
        whole = basis @ np.diag(values) @ basis.T + np.outer(vector, vector)
        new, turned = whitening.update(values.copy(), basis.copy(), vector)
        assert np.abs(turned @ np.diag(new) @ turned.T - whole).max() <= 1e-12 * size * np.abs(whole).max()
        assert np.abs(turned.T @ turned - np.eye(size)).max() < 1e-12 and (np.diff(new) >= 0).all()
    same_values, same_basis = whitening.update(values, basis, np.zeros(size))
    assert same_values is values and same_basis is basis


def test_spectra_combine_to_the_whole():
    x = np.floor(64 * np.random.default_rng(2).normal(size=(300, 12)))
    parts = []
    for cut in (x[:1], x[1:2], x[2:150], x[150:]):
        own = whitening.Spectrum.empty(12)
        for row in cut:
            own.add(row)
        parts.append(own)
    whole = whitening.Spectrum.empty(12)
    for own in parts:
        whole.combine(own)
    twice = whitening.Spectrum.empty(12)
    for row in x:
        twice.add(row, 2)
    scatter = np.cov(x.T, bias=True) * len(x)
    for spectrum, factor in ((whole, 1), (twice, 2)):
        assert spectrum.n == factor * len(x) and np.abs(spectrum.mean - x.mean(0)).max() < 1e-9
        again = spectrum.basis @ np.diag(spectrum.values) @ spectrum.basis.T
        assert np.abs(again - factor * scatter).max() < 1e-10 * factor * np.abs(scatter).max()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, whitened double").repartition(5)


def check_whitening(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], -1 if r[4] is None else round(abs(r[4]), 6))
    got = [(r.vec_id, r.component, r.n, int(r.deviation_exact), r.whitened, r.explained) for r in got]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None)
        assert a[4] is None or abs(a[4]) == pytest.approx(b[4], abs=1e-7)
        assert a[5] == pytest.approx(b[5], abs=1e-12)


def test_whitening_of_odd_vectors(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1 + k) for k in range(6)]) for i in range(90)]
    rows += [(i % 7, rows[3][1]) for i in range(50)] + [(None, rows[4][1])]
    odd = [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, [1.0] * 7), (206, [1.0]), (207, [1e30] * 6)]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    check_whitening(got, brute.whitening(rows))
    assert got[0].identity_error < 1e-12
    assert {r.component for r in whitening.whiten(vectors(spark, rows), components=2).collect()} == {1, 2}


def test_whitening_without_variance_and_of_large_entries(spark):
    flat = [(i, [0.5, float(i % 5), 2.0]) for i in range(20)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    check_whitening(got, brute.whitening(flat))
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, 0.0, None) for k in (1, 2)]
    large = [(i, [float(2**40 * (i + 1)), float(i * i)]) for i in range(8)]
    got = whitening.whiten(vectors(spark, large)).collect()
    assert {(r.vec_id, int(r.deviation_exact)) for r in got} == {w[:1] + (w[3],) for w in brute.whitening(large)}
    assert any(r.deviation is None for r in got)
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, None)])).count() == 0


def test_the_tree_of_spectra_has_several_levels(spark):
    rows = spark.range(800).select(F.col("id").alias("vec_id"), F.array(*(F.randn(seed) for seed in range(5))).alias("embedding")).repartition(40, "vec_id")
    x = whitening.whole_vectors(rows)
    spectrum = whitening.combined(whitening.spectra(x, 5))
    data = np.array([r.x for r in x.collect()], dtype=np.float64)
    assert spectrum.n == 800
    assert spectrum.values == pytest.approx(np.linalg.eigvalsh(np.cov(data.T, bias=True) * 800), rel=1e-10)


# License scans

MARKUP = (
    ("one", "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> delta"),
    ("two", "<<beginOptional>>alpha<<endOptional>> beta <<var;words=1-3>> delta <<beginOptional>>gamma<<endOptional>>"),
    ("three", "beta <<var;words=0-2>> beta"),
)


def plain(parts):
    return [p.decode() if isinstance(p, bytes) else ("maybe", plain(p)) if isinstance(p, list) else ("any", *p) for p in parts]


def trees(templates):
    return [(label, plain(parsed(markup))) for label, markup in templates]


def test_automaton_accepts_what_backtracking_accepts(spark):
    r = random.Random(9)
    names = ["alpha", "beta", "gamma", "delta", "x", "MIT", "license", "cc", "by"]
    docs = [{"doc_id": i, "text": r.choice([" ", ", ", "\n"]).join(r.choice(names) for _ in range(r.randint(0, 14)))} for i in range(400)]
    docs += [{"doc_id": 7, "text": None}, {"doc_id": None, "text": "mit license"}, {"doc_id": 7, "text": ""}, {"doc_id": 8, "text": "?!"},
             {"doc_id": 9, "text": "x " * 30_000 + "CC BY-NC 4.0 " + "cc by " * 5_000}]
    frame = spark.createDataFrame([(d["doc_id"], d["text"], 5, "y") for d in docs], "doc_id long, text string, score int, Labels string").repartition(3)
    got = license_scan.scan(frame, templates=MARKUP)
    assert got.columns == ["doc_id", "text", *license_scan.RESULT]
    got = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ","), F.array_join("labels", ","), "score").collect()
    same(got, brute.licenses(docs, trees(BASE), trees(MARKUP)))
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_places_are_the_longest_from_a_start(spark):
    row = license_scan.scan(spark.createDataFrame([(1, "alpha beta x x delta gamma")], "doc_id long, text string"), base=(), templates=MARKUP).first()
    assert {(p.start, p.end, p.label) for p in row.places} == {(0, 6, "two"), (1, 6, "two")} and row.n_base == 0


def test_whole_texts_are_accepted_with_and_without_their_regions():
    automaton = Automaton([*BASE, *NOTICES, *TEXTS])
    for label, markup in TEXTS:
        def written(parts, full):
            out = []
            for p in parts:
                out += [p] if isinstance(p, bytes) else written(p, full) if isinstance(p, list) and full else [] if isinstance(p, list) else [b"anyone"] * (p[1] if full else p[0])
            return out

        for full in (False, True):
            text = written(parsed(markup), full)
            found = {automaton.labels[t] for start, end, t in automaton.find([b"so", *text, b"end"]) if (start, end) == (1, len(text) + 1)}
            assert label in found
            broken = [*text]
            places = [i for i, p in enumerate(broken) if p != b"anyone"]
            broken[places[len(places) // 2]] = b"otherwise"
            assert label not in {automaton.labels[t] for _, _, t in automaton.find(broken)} or full
    assert mandatory(parsed(NOTICES[0][1])) == 6


def test_bounded_deterministic_states_do_not_change_the_result(monkeypatch):
    monkeypatch.setattr(license_scan, "STATES", 3)
    small, large = Automaton([*BASE, *MARKUP]), Automaton([*BASE, *MARKUP])
    r = random.Random(1)
    for _ in range(200):
        text = [r.choice([b"alpha", b"beta", b"gamma", b"delta", b"x"]) for _ in range(12)]
        found = list(small.find(text))
        monkeypatch.setattr(license_scan, "STATES", 10**6)
        assert found == list(large.find(text))
        monkeypatch.setattr(license_scan, "STATES", 3)


@pytest.mark.parametrize("markup", ["a <<beginOptional>> b", "a <<endOptional>>", "<<var;words=0-2>> a", "<<beginOptional>>a<<endOptional>>", ""])
def test_markup_that_says_nothing_is_refused(markup):
    with pytest.raises(ValueError):
        Automaton([("x", markup)])


# Filter audit


def audited(docs, labels, spark):
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["source"], 1, "p", 3) for d in docs], "doc_id long, text string, source string, row int, part string, prefix int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return filter_audit.document_audit(frame.repartition(3), marks)


def test_audit_of_odd_documents(spark):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["one", "Two", "THREE", "été", "#4", f"w{r.randrange(900)}"]) for _ in range(n))
    base = [text(r.randint(0, 120)) for _ in range(25)] + [None, "", " ", "x " * 20_000, " ".join(map(str, range(20_000)))]
    docs = [{"doc_id": i, "text": base[i % len(base)], "source": r.choice([None, "", "a", "b"])} for i in range(90)]
    docs += [{"doc_id": None, "text": base[0], "source": "a"}, {"doc_id": None, "text": "only null ids", "source": "c"}, {"doc_id": None, "text": "only null ids", "source": "c"}]
    docs += [{"doc_id": 500, "text": "twice the same row", "source": "b"}] * 2
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)] + [(2, 1, 1), (None, 1, 1), (500, 1, 0), (9999, 1, 1)]
    got = audited(docs, labels, spark)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    same(got.collect(), brute.audit(docs, labels))


def test_audit_with_a_hot_text(spark):
    docs = [{"doc_id": i, "text": "hot" if i % 3 else f"cold {i % 40}", "source": "a" if i % 2 else "b"} for i in range(300)]
    same(audited(docs, [(0, 1, 0)], spark).collect(), brute.audit(docs, [(0, 1, 0)]))


def test_audit_of_nothing(spark):
    assert audited([], [], spark).count() == 0


def test_rows_are_dealt_out_once_and_never_behind_the_doubling(spark):
    rows = spark.range(1000).selectExpr("id as row", "cast(id % 3 as string) as part", "0 as good", "1 as toxic")
    failing = {name: spark.range(0, 1000, step).withColumnRenamed("id", "row") for name, step in (("A", 2), ("B", 3), ("C", 5))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = filter_audit.prefix_counts(rows, failing)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        got = {(r["part"], r["filter"], r["prefix"]): r.n for r in counts.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["0", -1, 0] == 334 and got["0", 0, 0] == 167
    assert got["0", 1, 1] == sum(i % 3 == 0 and i % 2 != 0 for i in range(1000))
    generated = plan.index("Generate")
    assert plan[:generated].count("Exchange") == 1 + plan[:generated].count("Exchange hashpartitioning(failed")
