"""License wordings in documents, by templates with optional and replaceable regions.

A template is compiled into an automaton over words. A mandatory word is one edge. An optional region
is a way round it. A replaceable region is as many edges that take any word as its upper bound says,
the last of them skippable down to its lower bound. All templates share one automaton; it is made
deterministic piece by piece, as texts need it, on word classes: a word that no template has is one
class. A text is read from every word with which a template can begin, until no state is left, so a
start costs as many steps as its wording matches. A template is accepted when an end state is met,
which means that its mandatory words stand there exactly, in order and without others between.

The scan needs no shuffle and no state besides the automaton, whose size follows from the templates.

Defined results: null and empty texts have no words, no places and no labels, score 0; every row of a
repeated identifier has its own result; an empty table gives no rows; other columns pass through, and
those with a result's name are replaced. ``n_base`` counts a place once for each base phrase that starts
there. A template's place is its longest from a start. ``score`` is m / (m + 1) for the most mandatory words
m of any accepted template, 0 without one: it says how sure the find is, not how much of the text it covers.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wakeline.llm.decontaminate import words
from wakeline.llm.license_templates import BASE, NOTICES, TEXTS
from wakeline.llm.words import blocks, in_batches, utf8

MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")
OTHER = -1
#: Deterministic states that are kept; beyond, they are built anew from those in use.
STATES = 20_000

Template = tuple[str, str]


def parsed(markup: str) -> list:
    """Nested parts: a word, a list (optional region) or a pair (fewest, most) of any words."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*MARK.finditer(markup), None]:
        stack[-1] += words(markup[at : mark.start() if mark else None].encode())
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that did not begin: {markup!r}")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append((int(mark[2]), int(mark[3])))
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {markup!r}")
    return stack[0]


def mandatory(parts: list) -> int:
    """Number of words that every accepted text has."""
    return sum(isinstance(p, bytes) for p in parts)


class Automaton:
    """All templates in one; ``places`` reads a text from one start."""

    def __init__(self, templates: list[Template]):
        self.labels = [label for label, _ in templates]
        trees = [parsed(markup) for _, markup in templates]
        self.mandatory = [mandatory(tree) for tree in trees]
        self._edges: list[dict] = []  # word class to next states; None stands for any word
        self._ways: list[list[int]] = []  # next states without a word
        self._ends: dict[int, int] = {}
        starts = []
        for i, tree in enumerate(trees):
            begin = self._state()
            end = self._sequence(tree, begin)
            if not self.mandatory[i] or end in self._open({begin}):
                raise ValueError(f"no mandatory word in the template of {self.labels[i]!r}")
            self._ends[end] = i
            starts.append(begin)
        vocabulary = {w for edges in self._edges for w in edges if w is not None}
        self.classes = {w: n for n, w in enumerate(sorted(vocabulary))}
        self._edges = [{None if w is None else self.classes[w]: to for w, to in edges.items()} for edges in self._edges]
        self._start = self._open(set(starts))
        if any(None in self._edges[s] for s in self._start):
            raise ValueError("a template begins with a replaceable region: it would begin at every word")
        self.first = {w for w, n in self.classes.items() if any(n in self._edges[s] for s in self._start)}
        self._reset()

    def _state(self) -> int:
        self._edges.append({})
        self._ways.append([])
        return len(self._edges) - 1

    def _step(self, state: int, word) -> int:
        to = self._state()
        self._edges[state].setdefault(word, set()).add(to)
        return to

    def _sequence(self, parts: list, state: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                state = self._step(state, part)
            elif isinstance(part, list):
                begin, state = state, self._sequence(part, state)
                join = self._state()
                self._ways[begin].append(join)
                self._ways[state].append(join)
                state = join
            else:
                fewest, most = part
                passed = [state]
                for _ in range(most):
                    passed.append(self._step(passed[-1], None))
                state = self._state()
                for s in passed[fewest:]:
                    self._ways[s].append(state)
        return state

    def _open(self, states: set[int]) -> frozenset[int]:
        """The states and all that are reached from them without a word."""
        found, todo = set(states), list(states)
        while todo:
            new = [s for s in self._ways[todo.pop()] if s not in found]
            found.update(new)
            todo += new
        return frozenset(found)

    def _reset(self) -> None:
        self._numbers: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._accepts: list[tuple[int, ...]] = []
        self._moves: dict[tuple[int, int], int] = {}
        self._number(self._start)

    def _number(self, states: frozenset[int]) -> int:
        n = self._numbers.get(states)
        if n is None:
            n = self._numbers[states] = len(self._sets)
            self._sets.append(states)
            self._accepts.append(tuple(sorted(self._ends[s] for s in states if s in self._ends)))
        return n

    def _move(self, state: int, word: int) -> int:
        """The deterministic state after a word, OTHER if none is left."""
        to: set[int] = set()
        for s in self._sets[state]:
            to |= self._edges[s].get(None, set())
            if word != OTHER:
                to |= self._edges[s].get(word, set())
        new = self._number(self._open(to)) if to else OTHER
        self._moves[state, word] = new
        return new

    def places(self, text: list[bytes], start: int) -> dict[int, int]:
        """Longest end by number of each template that is accepted from the start."""
        if len(self._sets) > STATES:
            self._reset()
        found: dict[int, int] = {}
        state, classes, moves, accepts = 0, self.classes, self._moves, self._accepts
        for at in range(start, len(text)):
            word = classes.get(text[at], OTHER)
            state = moves[state, word] if (state, word) in moves else self._move(state, word)
            if state < 0:
                break
            for template in accepts[state]:
                found[template] = at + 1
        return found

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, end, template) of every accepted place, in the order of starts."""
        first = self.first
        for start in [i for i, w in enumerate(text) if w in first]:
            for template, end in sorted(self.places(text, start).items()):
                yield start, end, template


PLACE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
RESULT = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "places": pa.list_(PLACE), "score": pa.float64(),
}
RESULT_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "places array<struct<start:long,end:long,label:string>>, score double"
)


def scan(docs: DataFrame, text: str = "text", base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = NOTICES + TEXTS) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, places and score.

    ``base`` are phrases whose places are counted; ``templates`` add labels of their own.
    """
    taken = {c.lower() for c in RESULT} - {text.lower()}
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
    at, every = [c.lower() for c in kept.columns].index(text.lower()), [*base, *templates]
    n_base, names = len(base), list(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(every)
        for batch in blocks(batches, at):
            out = [summary(automaton, words(raw), n_base) for raw in utf8(batch.column(at))]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(RESULT.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return in_batches(kept, run, StructType(kept.schema.fields + StructType.fromDDL(RESULT_SCHEMA).fields))


def summary(automaton: Automaton, text: list[bytes], n_base: int) -> tuple:
    found = list(automaton.find(text))
    starts = [start for start, _, template in found if template < n_base]
    labels = automaton.labels
    most = max((automaton.mandatory[template] for _, _, template in found), default=0)
    places = [{"start": a, "end": b, "label": labels[t]} for a, b, t in found]
    return (
        len(text), len(starts), min(starts, default=None), max(starts, default=None),
        sorted({labels[t] for _, _, t in found if t < n_base}), sorted({labels[t] for _, _, t in found}), places, most / (most + 1),
    )
