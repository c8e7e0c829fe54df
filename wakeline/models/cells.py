"""A k-d index of cells with counts and tight boxes, for exact searches that look at few rows.

The cuts come from a bounded sample and only decide how even the cells are. Which cells a search has to
visit is decided by the boxes, and they are the exact extent of all indexed rows of a cell.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_ROWS = 1024
#: The index goes to every task: at most this many cells, whatever the number of rows.
MAX_CELLS = 16_384
SAMPLES_PER_CELL = 16
#: Rows whose paths through the index are followed together.
SLICE = 256


@dataclass
class Cells:
    """Nodes in heap order: node i has the children 2i + 1 (below its cut) and 2i + 2."""

    dimension: np.ndarray  # -1 for a cell
    cut: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @classmethod
    def of_sample(cls, sample: np.ndarray, cells: int) -> "Cells":
        """Even cells by halving the widest side of the sample."""
        depth = int(np.ceil(np.log2(max(cells, 1))))
        index = cls(np.full(2 ** (depth + 1) - 1, -1, np.int16), np.zeros(2 ** (depth + 1) - 1))
        members = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            at = members.pop(node, None)
            if at is None or len(at) < 2:
                continue
            widths = sample[at].max(0) - sample[at].min(0)
            d = int(widths.argmax())
            if not widths[d] > 0:
                continue
            values = np.sort(sample[at, d])
            cut = values[len(values) // 2]
            if cut == values[0]:  # equal values stay together
                cut = values[np.searchsorted(values, cut, side="right")]
            index.dimension[node], index.cut[node] = d, cut
            above = sample[at, d] >= cut
            members[2 * node + 1], members[2 * node + 2] = at[~above], at[above]
        return index

    def find(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.dimension[node] >= 0)):
            at = node[inner]
            node[inner] = 2 * at + 1 + (points[inner, self.dimension[at]] >= self.cut[at])
        return node

    def measure(self, boxes: pd.DataFrame, size: int) -> None:
        """Take the extents of the cells (columns cell, low0.., high0..); a node's box holds its children's."""
        nodes = len(self.dimension)
        self.low, self.high = np.full((nodes, size), np.inf), np.full((nodes, size), -np.inf)
        cells = boxes["cell"].to_numpy(np.int64)
        self.low[cells] = boxes[[f"low{i}" for i in range(size)]].to_numpy(np.float64)
        self.high[cells] = boxes[[f"high{i}" for i in range(size)]].to_numpy(np.float64)
        for node in range(nodes // 2 - 1, -1, -1):
            if self.dimension[node] >= 0:
                children = [2 * node + 1, 2 * node + 2]
                self.low[node], self.high[node] = self.low[children].min(0), self.high[children].max(0)

    def within(self, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell whose box is no farther than the row's limit, a squared distance.

        The distance to a box is summed like that to a point in it, so rounding never hides a cell.
        """
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        rows, cells = [], []
        while len(row):
            away = np.maximum(np.maximum(self.low[node] - points[row], points[row] - self.high[node]), 0.0)
            distance = away[:, 0] * away[:, 0]
            for d in range(1, away.shape[1]):
                distance += away[:, d] * away[:, d]
            near = (distance <= limit[row]) & (self.low[node, 0] <= self.high[node, 0])
            row, node = row[near], node[near]
            cell = self.dimension[node] < 0
            rows.append(row[cell])
            cells.append(node[cell])
            row, node = np.tile(row[~cell], 2), np.concatenate((2 * node[~cell] + 1, 2 * node[~cell] + 2))
        return np.concatenate(rows), np.concatenate(cells)


def build(rows: DataFrame, features: list[str], cell_rows: int = CELL_ROWS) -> Cells:
    """Cuts for stored rows, from a sample of at most ``SAMPLES_PER_CELL`` rows a cell."""
    total = rows.count()
    cells = min(MAX_CELLS, max(1, total // cell_rows))
    wanted = cells * SAMPLES_PER_CELL
    # Some more than wanted, so that the draw seldom falls short; the limit is the bound.
    picked = rows.select(*(F.col(f).cast("double") for f in features)).sample(min(1.0, 1.2 * wanted / max(total, 1)), seed=1).limit(wanted)
    sample = np.array([tuple(r) for r in picked.collect()], np.float64).reshape(-1, len(features))
    return Cells.of_sample(sample, cells)


def with_cell(rows: DataFrame, index: Cells, features: list[str]) -> DataFrame:
    """The rows with the number of their cell."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(cell=index.find(part[features].to_numpy(np.float64)))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))


def measured(index: Cells, rows: DataFrame, features: list[str]) -> Cells:
    """The index with the boxes of all rows, which carry their cell. One row a cell comes to the driver."""
    extents = [f(x).cast("double").alias(f"{name}{i}") for i, x in enumerate(features) for name, f in (("low", F.min), ("high", F.max))]
    index.measure(rows.groupBy("cell").agg(*extents).toPandas(), len(features))
    return index


def other_cells(rows: DataFrame, index: Cells, features: list[str], limit: str) -> DataFrame:
    """A copy of a row for every cell but its own that is no farther than its ``limit``; null reaches all cells."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            points, home = part[features].to_numpy(np.float64), part["cell"].to_numpy()
            limits = part[limit].fillna(np.inf).to_numpy(np.float64)
            for at in range(0, len(part), SLICE):
                row, cell = index.within(points[at:at + SLICE], limits[at:at + SLICE])
                away = cell != home[at:at + SLICE][row]
                yield part.iloc[at + row[away]].assign(cell=cell[away])

    return rows.mapInPandas(run, rows.schema)
