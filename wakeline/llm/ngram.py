"""A smoothed bigram model over all words and all neighbouring pairs of the training texts.

Tokens are words and one end per text. Unigrams are smoothed by adding a half to every count, with
one further type for all unknown words. A word follows another, or the start, by absolute discounting:
every pair seen, however rare, keeps its count less ``DISCOUNT``, and the mass taken off goes to the
unigrams. A word never trained on passes all its mass to them. No pair and no word is left out, so what
is counted grows with the corpus.

Pairs meet their counts by block: a block of texts sends each of its distinct pairs once, with the
times its training texts hold it, to the bucket of the pair's first word. The bucket adds up the counts of all
blocks and answers each block for its own pairs. As every token but the end is also the first word of a pair,
and the end is as frequent as the start, the answers hold the unigram counts as well. Buckets take about
``BUCKET_TOKENS`` tokens at any corpus size. A word more frequent than that is heavy: its pairs are dealt over
all buckets, and its count and number of followers, at most one pair of numbers a bucket, are broadcast.

From the answers a block builds its part of the model, a weighted backoff automaton: a state per word, an arc
per trained pair with the pair's smoothed probability, a failure arc per state to the root. One traversal
carries each text's state from left to right and adds up the log-probabilities.

Words stand for themselves by 64-bit hashes, the followers of a word by 48 bits of theirs.

Defined results: null and empty texts consist of the end alone; without training texts each token
has the uniform probability over nothing but the unknown type, 1; repeated rows are texts of their
own in training and each get a row; other columns pass no data.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.storage import stored
from wakeline.llm.words import _Hashes, blocks, in_batches, mixed, utf8

DISCOUNT = 0.75
END = b""
COUNT_BYTES = 16 << 20
BUCKET_TOKENS = 1_000_000
LEAST_BUCKETS = 16
FOLLOWER_BITS = np.uint64((1 << 48) - 1)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words (bytes.split() separates at exactly 0x20 and 0x09-0x0D) and the end."""
    words = text.lower().split()
    words.append(END)
    return words


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def unigram_counts(texts: DataFrame) -> DataFrame:
    """(word as binary, n) over the single column of texts, summed by block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            ids, counts = _Ids(), []
            for raw in group:
                counts.append(np.array([ids[w] for w in tokens(raw)], np.int64))
            n = np.bincount(np.concatenate(counts), minlength=len(ids)) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    return in_batches(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _grouped(batches: Iterator[pa.RecordBatch], limit: int = COUNT_BYTES) -> Iterator[list[bytes]]:
    """Texts in lists of about ``limit`` bytes, over batch borders."""
    group, size = [], 0
    for batch in blocks(batches, 0):
        for raw in utf8(batch.column(0)):
            group.append(raw)
            size += len(raw)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


class Automaton:
    """States are words, 0 to n - 1; n is the root, which has no history.

    ``arcs`` are state x 2^32 + word, ascending, of pairs that were trained, with their log10 weights. A state
    without an arc for a word takes its failure arc, whose weight is the mass its pairs left over, to the
    root, and reads the word there by the word's own weight. A state never trained on is the root in all
    but name: no arcs, failure weight 0.
    """

    def __init__(self, arcs: np.ndarray, weights: np.ndarray, failure: np.ndarray, root: np.ndarray):
        self.arcs, self.weights, self.failure, self.root = arcs, weights, np.append(failure, 0.0), root

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 weights of reading a word each in a state each; the new states are the words."""
        key = (state << 32) | word
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        failing = self.failure[state] + self.root[word]
        return np.where(self.arcs[at] == key, self.weights[at], failing) if len(self.arcs) else failing

    def traverse(self, words: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
        """log10 weight of each text. All texts go left to right together, each with its state."""
        order = np.argsort(-lengths, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        longest = lengths[order]
        total, state = np.zeros(len(lengths)), np.full(len(lengths), start, np.int64)
        # Texts by falling length: those that still have a word at a place are the first ones.
        left = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")
        for place, n in enumerate(left.tolist()):
            word = words[begins[:n] + place].astype(np.int64)
            total[:n] += self.step(state[:n], word)
            state[:n] = word
        out = np.empty(len(lengths))
        out[order] = total
        return out


class Model:
    """Counts of all training words as a table, the training texts, and what is known of heavy words."""

    def __init__(self, texts: DataFrame, counts: DataFrame, tokens_: int, types: int, buckets: int, heavy: dict[int, tuple[int, int]]):
        self.texts, self.counts, self.tokens, self.types, self.buckets, self.heavy = texts, counts, tokens_, types, buckets, heavy


def learn(texts: DataFrame) -> Model:
    """Learn from the rows of a table whose single column holds texts."""
    counts = stored(unigram_counts(texts), "unigrams")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_TOKENS))
    heavy = counts.where(F.col("n") * buckets > n).collect()  # fewer than buckets
    followers = {r.word: r.followers for r in _followers(texts, [bytes(r.word) for r in heavy]).collect()} if heavy else {}
    return Model(texts, counts, n, v, buckets, {h: (r.n, followers[h - (h >> 63 << 64)]) for r in heavy for h in _hashes([bytes(r.word)]).tolist()})


def _hashes(words: list[bytes]) -> np.ndarray:
    table = _Hashes()
    for word in words:
        table[word]
    return np.array(table.values_, np.uint64)


def _followers(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """(word as signed hash, followers): the number of distinct words behind each of a few words."""
    wanted = np.sort(_hashes(words))
    limit = COUNT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, limit):
            words, sequence, lengths = _numbered(group)
            first, second = _neighbours(sequence, lengths)
            chosen = np.isin(words, wanted)[first]
            pairs = np.unique((first[chosen] << 32) | second[chosen])
            columns = [pa.array(words[pairs >> 32].view(np.int64)), pa.array((words[pairs & 0xFFFFFFFF] & FOLLOWER_BITS).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "follower"])

    return in_batches(texts, run, "word long, follower long").distinct().groupBy("word").agg(F.count("*").alias("followers"))


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, the texts as word numbers with an end before and behind, their lengths)."""
    table = _Hashes()
    at = table.__getitem__
    parts = [np.array([at(END), *map(at, tokens(raw))], np.int64) for raw in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.array(table.values_, np.uint64), np.concatenate(parts), lengths


def _neighbours(sequence: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, next word) at each place that is not the last of its text."""
    inside = np.ones(len(sequence), bool)
    inside[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inside)
    return sequence[at], sequence[at + 1]


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _requests(rows: DataFrame, buckets: int, heavy: list[int]) -> DataFrame:
    """Of (id, text, trains, asks): each block's pairs by bucket, and the block's own texts under a negative key."""
    dealt, limit = np.array(sorted(heavy), np.uint64), COUNT_BYTES

    def block(number: int, ids: list, texts: list[bytes], trains: list[bool], asks: list[bool]) -> pa.RecordBatch:
        words, sequence, lengths = _numbered(texts)
        first, second = _neighbours(sequence, lengths)
        pairs, place = np.unique((first << 32) | second, return_inverse=True)
        times = np.bincount(place[np.repeat(np.array(trains, bool), lengths - 1)], minlength=len(pairs))
        first, follower = pairs >> 32, words[pairs & 0xFFFFFFFF] & FOLLOWER_BITS
        own = words[first]
        bucket = mixed(np.where(np.isin(words, dealt)[first], own ^ mixed(follower), own)) % np.uint64(buckets)
        order = np.lexsort((first, bucket))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        bucket, own, follower, times = bucket[order].astype(np.int64), own[order], follower[order], times[order]
        starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1]))))
        runs = np.diff(np.append(starts, len(own)))
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        of_runs = np.searchsorted(starts, cuts)
        six = follower.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        out = []
        for i in range(len(cuts) - 1):
            a, b, c, d = cuts[i], cuts[i + 1], of_runs[i], of_runs[i + 1]
            key = int(bucket[a])
            out.append((key, number, key, own[starts[c:d]].tobytes(), six[a:b].tobytes(), _packed(runs[c:d].astype(np.uint32), times[a:b].astype(np.uint32))))
        asking = np.array(asks, bool)
        if asking.any():
            known = [i for i, asks_ in zip(ids, asks) if asks_]
            about = np.array([i or 0 for i in known], np.int64), np.array([i is None for i in known], np.int64), (lengths - 1)[asking]
            # The word of every run in bucket order, for the states, then every token's pair.
            states = pairs[order][starts] >> 32
            out.append((-1 - number, number, -1, _packed(*about), _packed(rank[place[np.repeat(asking, lengths - 1)]]), _packed(states.astype(np.int32))))
        types = pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "block", "bucket", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                held.append(row)
                size += len(row[1])
                if size >= limit:
                    yield block(number, *map(list, zip(*held)))
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, *map(list, zip(*held)))

    return in_batches(rows, run, "key long, block long, bucket int, a binary, b binary, c binary")


def _answers(requests: DataFrame, heavy: dict[int, tuple[int, int]]) -> DataFrame:
    """(block, bucket, a, b): counts for each block's pairs, in their order; the blocks' own texts pass through."""
    fields = ["block", "bucket", "a", "b", "c"]
    known = sorted(heavy)
    heavy = np.array(known, np.uint64), np.array([heavy[w] for w in known], np.int64).reshape(-1, 2)
    shared = requests.sparkSession.sparkContext.broadcast(heavy)

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("key")[0].as_py() < 0:
            return rows.select(fields)
        own = [np.frombuffer(x, np.uint64) for x in rows.column("a").to_pylist()]
        six = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in rows.column("b").to_pylist()]
        small = [np.frombuffer(_unpacked(x), np.uint32).astype(np.int64) for x in rows.column("c").to_pylist()]
        runs = np.concatenate([x[: len(o)] for x, o in zip(small, own)])
        times = np.concatenate([x[len(o) :] for x, o in zip(small, own)])
        wide = np.zeros((len(times), 8), np.uint8)
        wide[:, :6] = np.concatenate(six)
        follower = wide.view("<u8").ravel()
        words, which = np.unique(np.concatenate(own), return_inverse=True)
        first = np.repeat(which, runs)
        order = np.lexsort((follower, first))
        a, b = first[order], follower[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=times).astype(np.int64)
        count = np.bincount(a[new], weights=total, minlength=len(words)).astype(np.int64)
        followers = np.bincount(a[new], weights=total > 0, minlength=len(words)).astype(np.int64)
        dealt, numbers = shared.value
        if len(dealt):
            at = np.minimum(np.searchsorted(dealt, words), len(dealt) - 1)
            found = dealt[at] == words
            count[found], followers[found] = numbers[at[found]].T
        out, r, p = [], 0, 0
        for o, s in zip(own, six):
            q, t = r + len(o), p + len(s)
            out.append(np.array([len(o)], np.int64).tobytes() + _packed(runs[r:q], count[which[r:q]], followers[which[r:q]], total[group[p:t]]))
            r, p = q, t
        nothing = pa.nulls(len(out), pa.binary())
        return pa.table([rows.column("block").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array(out, pa.binary()), nothing, nothing], names=fields)

    return requests.groupBy("key").applyInArrow(run, "block long, bucket int, a binary, b binary, c binary")


def _joined(answers: list[bytes]) -> list[np.ndarray]:
    """Runs, counts, followers and pair counts of a block from its buckets' answers; takes the answers out of the list."""
    parts: tuple[list, ...] = ([], [], [], [])
    kinds = np.int32, np.int64, np.int64, np.int64
    while len(answers) > 1:
        x = answers.pop(1)
        numbers, n = np.frombuffer(_unpacked(x[8:]), np.int64), int.from_bytes(x[:8], "little")
        for part, piece, kind in zip(parts, np.split(numbers, [n, 2 * n, 3 * n]), kinds):
            part.append(piece.astype(kind))
    return [np.concatenate(part) for part in parts]


def _scores(answers: DataFrame, tokens_: int, types: int) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each text of each block."""
    denominator = tokens_ + 0.5 * (types + 1)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if rows.column("bucket")[0].as_py() >= 0:  # training texts alone
            return pa.table([pa.array([], k) for k in kinds], names=names)
        a = rows.column("a").to_pylist()
        ids, none, lengths = np.frombuffer(_unpacked(a[0]), np.int64).reshape(3, -1)
        place = np.frombuffer(_unpacked(rows.column("b")[0].as_py()), np.int32)
        state = np.frombuffer(_unpacked(rows.column("c")[0].as_py()), np.int32)
        del rows
        runs, count, followers, pair = _joined(a)
        size = int(state.max()) + 1
        # A heavy word has a run in several buckets, all with the same count.
        seen, kinds_ = np.zeros(size), np.zeros(size)
        seen[state], kinds_[state] = count, followers
        root = np.log10((seen + 0.5) / denominator)
        with np.errstate(divide="ignore"):
            failure = np.where(seen > 0, np.log10(DISCOUNT * kinds_ / np.maximum(seen, 1)), 0.0)
        # A token is the first word of the next pair; the end behind a text's last word is the one before its first.
        history = np.repeat(state, runs)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        words = np.empty(len(place), np.int32)
        words[:-1] = history[place[1:]]
        words[starts + lengths - 1] = history[place[starts]]
        following = np.full(len(pair), -1, np.int32)  # pairs of texts that only train lead nowhere here
        following[place] = words
        start = int(history[place[0]])
        del place
        trained = np.flatnonzero((pair > 0) & (following >= 0))
        arcs = history[trained].astype(np.int64) << 32 | following[trained]
        order = np.argsort(arcs)
        arcs, trained = arcs[order], trained[order]
        times, first, second = pair[trained], history[trained], following[trained]
        del order, trained, pair, history, following
        weights = np.log10((times - DISCOUNT + DISCOUNT * kinds_[first] * 10 ** root[second]) / seen[first])
        del times, first, second
        score = Automaton(arcs, weights, failure, root).traverse(words, lengths, start)
        sums = [np.add.reduceat(x[words], starts) for x in ((seen > 0).astype(np.int64), root)]
        return pa.table([pa.array(ids, mask=none.astype(bool)), pa.array(lengths), *map(pa.array, sums), pa.array(score)], names=names)

    return answers.groupBy("block").applyInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", trained: Column | None = None) -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score.

    ``trained`` says which of the documents are exactly the model's training texts: these are then read once
    for both their counts and their scores.
    """
    counts_itself = trained if trained is not None else F.lit(False)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), counts_itself.alias("trains"), F.lit(True).alias("asks"))
    if trained is None:
        texts = model.texts.select(F.lit(None).cast("long").alias("id"), F.col(model.texts.columns[0]).alias("text"))
        rows = rows.unionByName(texts.select("id", "text", F.lit(True).alias("trains"), F.lit(False).alias("asks")))
    answers = _answers(_requests(rows, model.buckets, list(model.heavy)), model.heavy)
    return _scores(answers, model.tokens, model.types).withColumnRenamed("id", id_column)
