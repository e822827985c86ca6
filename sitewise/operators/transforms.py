"""Rigid motions of snapshots, and whether a predictor's results follow them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sitewise.shared import ship

OUT = "frame_id string, finite boolean, deterministic boolean, rotation double, translation double, permutation double, error string"


def rotation_matrix(seed: int) -> np.ndarray:
    """A proper rotation drawn uniformly: the Q of a random matrix with the signs of R taken out."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, ::-1]


def rotated(x: np.ndarray, cell: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x @ q.T, cell @ q.T


def translated(x: np.ndarray, cell: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moved by fractions of the lattice vectors and wrapped into the cell."""
    f = x @ np.linalg.inv(cell) + shift
    return (f - np.floor(f)) @ cell


def invariance(frames: DataFrame, setup: Callable[[], object], predict: Callable[[object, list, list, list], tuple[float, list]], seed: int = 0) -> DataFrame:
    """How far a predictor's results (energy, forces by atom) change: largest deviation over the scale of the results.

    frames: frame_id, numbers, positions, cell. rotation compares forces turned back, permutation forces put back in
    order; deterministic asks for equal results of two calls. A predictor's error is told in `error`.
    """
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, q = setup(), rotation_matrix(seed)
        rng = np.random.Generator(np.random.PCG64(seed))
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                z, x, cell = list(r.numbers), np.array([list(p) for p in r.positions]), np.array([list(c) for c in r.cell])
                order = rng.permutation(len(z))

                def ask(z: list, x: np.ndarray, cell: np.ndarray) -> tuple[float, np.ndarray]:
                    e, f = predict(state, z, x.tolist(), cell.tolist())
                    return float(e), np.array(f, float)

                try:
                    e, f = ask(z, x, cell)
                    scale = max(1.0, abs(e), float(np.abs(f).max(initial=0)))
                    again, turned = ask(z, x, cell), ask(z, *rotated(x, cell, q))
                    moved, mixed = ask(z, translated(x, cell, np.full(3, 0.37)), cell), ask([z[i] for i in order], x[order], cell)
                    apart = lambda a, g: max(abs(a - e), float(np.abs(g - f).max(initial=0))) / scale  # noqa: E731, B023
                    back = np.empty_like(f)
                    back[order] = mixed[1]
                    rows.append((r.frame_id, bool(np.isfinite(e) and np.isfinite(f).all()), again[0] == e and bool((again[1] == f).all()), apart(turned[0], turned[1] @ q), apart(*moved), apart(mixed[0], back), None))
                except MemoryError:
                    raise
                except Exception as why:
                    rows.append((r.frame_id, False, False, None, None, None, f"{type(why).__name__}: {why}"[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.select("frame_id", "numbers", "positions", "cell").mapInPandas(run, OUT)
