"""The methods themselves: exactness at scale of a test, distributions, recall and accuracy."""

import math
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm import brute
from wakeline.llm import line_dedup, ngram, similar, toxicity
from wakeline.llm.bpe import LONG_WORD, Vocabulary
from wakeline.llm.decontaminate import Patterns
from wakeline.llm.line_dedup import CharacterShingles
from wakeline.llm.near_dedup import WordShingles, super_minhash
from wakeline.llm.queries import QUERIES
from wakeline.llm.similar import Sets
from wakeline.llm.words import ROLL, mixed
from wakeline.models.components import components
from wakeline.session import FILE_CLEANUP

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_the_library_on_random_text():
    ours, theirs, r = Vocabulary(PATH), Tokenizer.from_file(PATH), random.Random(1)
    # Letters newer than the library's tables of characters may be classed otherwise.
    letters = [chr(c) for c in range(1, 0x1FFFF) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    for _ in range(1500):
        text = "".join(r.choice(letters) if r.random() < 0.5 else r.choice(" 'abstDLREvm09!?\t\n\x1c") for _ in range(r.randint(1, 50)))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert list(ours.encode(text)) == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_scan_and_heap_merge_alike():
    v, r = Vocabulary(PATH), random.Random(2)
    for _ in range(200):
        word = "".join(r.choice("abcdeinrst") for _ in range(r.randint(2, LONG_WORD)))
        assert v.merge(v.symbols(word)) == v._merge_long(v.symbols(word))


def test_arcs_of_every_state_and_its_failure_sum_to_one():
    r = random.Random(4)
    texts = [[r.randrange(8) for _ in range(r.randint(0, 30))] + [8] for _ in range(200)]  # 8 is the end
    n, pairs = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([8, *t], t))
    tokens, followers = sum(n.values()), Counter(a for a, _ in pairs)
    root = np.log10([(n[w] + 0.5) / (tokens + 0.5 * 10) for w in range(9)])
    arcs = sorted(pairs)
    weights = np.log10([(pairs[a, b] - 0.75 + 0.75 * followers[a] * 10 ** root[b]) / n[a] for a, b in arcs])
    failure = np.log10([0.75 * followers[w] / n[w] for w in range(9)])
    a = ngram.Automaton(np.array([(x << 32) | y for x, y in arcs], np.int64), weights, failure, root)
    unknown = 0.5 / (tokens + 0.5 * 10)
    every = np.arange(9)
    for state in range(9):
        assert (10 ** a.step(np.full(9, state), every)).sum() + 10 ** failure[state] * unknown == pytest.approx(1)
    # The traversal is that of one text after the other, token by token.
    words, lengths = np.array([w for t in texts for w in t]), np.array([len(t) for t in texts])
    for got, t in zip(a.traverse(words, lengths, 8), texts):
        total = sum(weights[arcs.index(p)] if p in pairs else failure[p[0]] + root[p[1]] for p in zip([8, *t], t))
        assert got == pytest.approx(total, rel=1e-12)
    root_only = ngram.Automaton(np.empty(0, np.int64), np.empty(0), np.zeros(9), root)
    assert root_only.traverse(words, lengths, 8)[0] == pytest.approx(sum(root[w] for w in texts[0]))
    assert len(root_only.traverse(words[:0], lengths[:0], 8)) == 0


@pytest.mark.parametrize("bucket", [1_000_000, 40])
def test_every_pair_counts_however_rare(spark, monkeypatch, bucket):
    """Scores equal the plain bigram model over all pairs, those seen once included."""
    monkeypatch.setattr(ngram, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(ngram, "COUNT_BYTES", 400)
    r = random.Random(7)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 300}"
    texts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(120)] + ["once upon", None]
    train = [t for i, t in enumerate(texts) if i % 5]
    split = [[b"", *ngram.tokens((t or "").encode())] for t in texts]
    learnt = [s for i, s in enumerate(split) if i % 5]
    n = Counter(w for s in learnt for w in s[1:])
    pairs = Counter(p for s in learnt for p in zip(s, s[1:]))
    followers = Counter(a for a, _ in pairs)
    tokens, types = sum(n.values()), len(n)

    def plain(s):
        total = 0
        for a, b in zip(s, s[1:]):
            single = (n[b] + 0.5) / (tokens + 0.5 * (types + 1))
            p = (max(pairs[a, b] - 0.75, 0) + 0.75 * followers[a] * single) / n[a] if n[a] else single
            total += math.log10(p)
        return total

    assert min(pairs.values()) == 1
    model = ngram.learn(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    both = [ngram.score(docs, model), ngram.score(docs, model, trained=docs.doc_id % 5 != 0)]
    for found in both:
        got = {x.doc_id: x.score for x in found.collect()}
        assert len(got) == len(texts)
        for i, s in enumerate(split):
            assert got[i] == pytest.approx(plain(s), rel=1e-9)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op2_lm_score"](spark, SMALL).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_signatures_estimate_the_similarity():
    r = np.random.default_rng(0)
    for size in (3, 40, 400, 3000):
        estimates = []
        for _ in range(40):
            x = r.integers(0, 2**63, size * 2, dtype=np.uint64)
            a, b = x[: size + size // 2], x[size // 2 :]
            owner = np.repeat([0, 1], [len(a), len(b)])
            s = super_minhash(np.concatenate((a, b)), owner, 2, 100)
            estimates.append((s[0] == s[1]).mean())
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs(np.mean(estimates) - true) < 0.04


def test_signature_does_not_depend_on_the_block():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 7, 90, 800)]
    owner = np.repeat(np.arange(4), [len(s) for s in sets])
    together = super_minhash(np.concatenate(sets), owner, 4, 100)
    for i, s in enumerate(sets):
        assert (super_minhash(s, np.zeros(len(s), np.int64), 1, 100)[0] == together[i]).all()


def test_wu_manber_equals_plain_search():
    r = random.Random(5)
    for length in (1, 2, 3, 13):
        for _ in range(30):
            text = [r.choice([b"a", b"b", b"c"]) for _ in range(120)]
            patterns = {tuple(text[i : i + length]): [str(i)] for i in (r.randrange(120 - length) for _ in range(4))}
            patterns[tuple([b"zz"] * length)] = ["none"]
            want = [(i, patterns[p]) for i in range(120 - length + 1) if (p := tuple(text[i : i + length])) in patterns]
            assert list(Patterns(length, patterns).find(text)) == want


def test_line_buckets_travel_packed_and_give_the_same_edges_however_cut(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    lines = [" ".join(words[(i * k) % 10] for k in range(1, 9)) + f" {i % 40}" for i in range(120)] + ["short", "tiny", "x"]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)] + [(9, "\n".join(lines[::3]))], "id long, text string").repartition(3)
    measure = line_dedup.CharacterShingles()
    for shares in (1, 5):
        rows = line_dedup.bucket_rows(docs, measure, shares)
        assert rows.count() <= 3 * shares and rows.agg({"share": "max"}).first()[0] < shares
        found = line_dedup._edges(rows)
        got = components(found).collect()
        distinct = sorted({line_dedup.canonical(x.encode()) for x in lines})
        keys = measure.keys(measure.signatures(*measure.sets(distinct), len(distinct)))
        up = Sets(len(distinct))
        for i in range(len(distinct)):
            for j in range(i):
                if (keys[i] == keys[j]).any():
                    up.join(i, j)
        ids = [line_dedup.line_id(x) for x in distinct]
        groups = {}
        for i, x in enumerate(ids):
            groups.setdefault(up.root(i), []).append(x)
        assert {r.node: r.root for r in got} == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


@pytest.mark.parametrize("n", [40, 200_000])
def test_only_candidate_lines_leave_their_block(spark, n):
    lines = [f"line {i} of {i * 7919 % 104729:x}" for i in range(4000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::8])) for i in range(8)], "id long, text string").repartition(4)
    wanted = {line_dedup.line_id(x.encode()): x for x in lines[::100]}
    bits = line_dedup.line_filter(spark.createDataFrame([(x,) for x in wanted], "id long"), n)
    assert len(bits) == (1 if n == 40 else 8) << line_dedup.SEGMENT - 3
    got = {r.id: r.text for r in line_dedup.distinct_lines(docs, spark.sparkContext.broadcast(bits)).collect()}
    assert got.items() >= wanted.items() and len(got) <= len(wanted) + 4


def test_lines_do_not_depend_on_the_filter(spark, monkeypatch):
    near = "the quick brown fox jumps over the lazy dog and runs away into the woods for the rest of the day"
    docs = [{"doc_id": i, "text": "\n".join([f"own line {i} {i * 104729:x}", near + f" {i % 3}", "shared"])} for i in range(12)]
    rows = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").repartition(3)
    want = sorted(brute.fuzzy_lines(docs))
    assert sorted(map(tuple, line_dedup.removed_lines(rows).collect())) == want
    monkeypatch.setattr(line_dedup, "line_filter", lambda wanted, n: np.full(1 << line_dedup.SEGMENT - 3, 255, np.uint8))
    assert sorted(map(tuple, line_dedup.removed_lines(rows).collect())) == want


def test_lines_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = blocks.getAllFiles()
        return {name for i in range(every.size()) if (name := every.apply(i).getName()).startswith("shuffle_")}

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [(i, "\n".join(" ".join(words[(i * j + k) % 10] for k in range(12)) for j in range(1, 9))) for i in range(40)]
    docs, before = spark.createDataFrame(texts, "doc_id long, text string"), files()
    line_dedup.fuzzy_lines(docs)
    for _ in range(100):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(FILE_CLEANUP) == "false"


def test_byte_runs_are_the_polynomial_of_every_place(monkeypatch):
    data = np.frombuffer(bytes(range(40, 110)), np.uint8)
    monkeypatch.setattr(line_dedup, "PIECE", 16)
    for length in (1, 2, 3, 7, 9):
        wanted = [sum(int(v) * int(ROLL) ** (length - 1 - k) for k, v in enumerate(data[i : i + length])) % 2**64 for i in range(len(data) - length + 1)]
        assert line_dedup.byte_runs(data, length).tolist() == mixed(np.array(wanted, np.uint64)).tolist()
    assert len(line_dedup.byte_runs(data[:3], 9)) == 0


@pytest.mark.parametrize("measure", [WordShingles(85), CharacterShingles(80)])
def test_large_candidate_groups_lose_no_link(spark, monkeypatch, measure):
    """Chains, hubs and strangers in one candidate component, far larger than a block."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "TILE", 5)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(6))
    base = [word() for _ in range(60)]
    texts = []
    for chain in range(12):
        words = list(base) if chain % 3 else [word() for _ in range(60)]
        for _ in range(14):
            words[r.randrange(60)] = word()
            texts.append(" ".join(words))
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").cache()
    # Every text is a candidate of the first, so only verification tells them apart.
    edges = spark.createDataFrame([(i, 0) for i in range(1, len(texts))], "u long, v long")
    got = dict(tuple(x) for x in similar.similar_components(items, edges, measure).collect())
    sets, _ = measure.distinct_sets([t.encode() for t in texts])
    links = [(i, j) for j in range(len(texts)) for i in range(j) if measure.linked(sets[i], sets[j])]
    want = brute.roots(len(texts), links)
    assert [got.get(i, i) for i in range(len(texts))] == want
    assert 3 < len(set(want)) < len(texts)


def test_toxic_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    found = [r.predicted for r in rows if labels[r.doc_id]]
    assert right >= 0.95 and sum(found) >= 0.8 * len(found)


def test_folding_joins_disguises():
    for disguise in ("idiot", "IDIOT", "1d10t", "ідіот", "i​diot", "ïdiot", "idi0t!"):
        assert toxicity.folded(disguise) == ["idiot"]
    assert toxicity.folded("2024 10:30") == ["2024", "10", "30"]
    assert math.isclose(toxicity.Scorer({}, {}, 1, 0).score([]), 0.5)
