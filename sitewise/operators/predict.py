"""Running a predictor over frames: user code in Arrow batches, with state kept for each worker.

`setup` builds the predictor once in a worker; `predict` is called for each frame. An error of the predictor is a
failed row with its type and message; running out of memory is no result and fails the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.shared import ship

_state: dict = {}
OUT = "frame_id string, status string, energy double, forces array<array<double>>, error_type string, error_message string"


def predicted(frames: DataFrame, name: str, setup: Callable[[], object], predict: Callable[[object, list, list, list], tuple[float, list]], verify: Callable[[float, list, list], None] | None = None) -> DataFrame:
    """frames: frame_id, numbers, positions, cell. One row for each frame.

    verify(energy, forces, numbers) is called on every result where it was made; what it raises makes the row a failure.
    """
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _state:
            _state[name] = setup()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    energy, forces = predict(_state[name], list(r.numbers), [list(p) for p in r.positions], [list(c) for c in r.cell])
                    if verify is not None:
                        verify(float(energy), forces, list(r.numbers))
                    out.append((r.frame_id, "success", float(energy), forces, None, None))
                except MemoryError:
                    raise
                except Exception as why:
                    out.append((r.frame_id, "failed", None, None, type(why).__name__, str(why)[:500]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.select("frame_id", "numbers", "positions", "cell").mapInPandas(run, OUT)


def compacted(results: DataFrame, folder: str, on_result: Callable[[dict], None] | None = None) -> DataFrame:
    """results written once under folder; on_result gets one summary for each status (a bounded number), on the driver."""
    results.write.mode("errorifexists").parquet(folder)
    out = results.sparkSession.read.schema(results.schema).parquet(folder)
    if on_result is not None:
        for row in out.groupBy("status", "error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status", "error_type").limit(1000).collect():
            on_result(row.asDict())
    return out
