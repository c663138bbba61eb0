"""Row errors as values: a step that fails on a row fails on that row alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ERROR = "error struct<kind: string, message: string>"


def isolated(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], adds: str) -> DataFrame:
    """``rows`` with the columns ``adds`` (a schema) that ``run`` gives, and ``error``: what went
    wrong on this row, null if nothing did.

    ``run`` takes a batch and returns the new columns for its rows, in order.  A batch it fails
    on is halved until the rows at fault are alone; they get nulls and their error, all
    others what ``run`` gives.  ``run`` must treat a row alike in any batch.
    """
    new = StructType.fromDDL(f"{adds}, {ERROR}")
    names = [f.name for f in new.fields[:-1]]
    schema = StructType([*rows.schema.fields, *new.fields])

    def tried(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            made = run(frame)[names].set_axis(frame.index)
            if len(made) != len(frame):
                raise ValueError(f"{len(made)} rows for {len(frame)}")
            return made.assign(error=None)
        except Exception as e:  # noqa: BLE001: whatever it is, it is the row's
            if len(frame) == 1:
                return pd.DataFrame({**dict.fromkeys(names), "error": [{"kind": type(e).__name__, "message": str(e)[:500]}]}, index=frame.index)
        half = len(frame) // 2
        parts = [tried(frame.iloc[:half]), tried(frame.iloc[half:])]
        return pd.concat([p.astype(object) for p in parts])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            yield pd.concat([frame, tried(frame) if len(frame) else pd.DataFrame(columns=[*names, "error"])], axis=1)

    return rows.mapInPandas(each, schema)
