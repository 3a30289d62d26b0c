"""Limits on what a source gives, and notes about it that cost no pass of their own."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, Observation, functions as F

from tidewell.frame import Frame, Meta, col, string_columns
from tidewell.operators.cells import cell_warning, long_cells, truncate_cells
from tidewell.operators.limits import MAX_ROW_LIMIT, row_limit
from tidewell.operators.profile import DICTIONARY_THRESHOLD
from tidewell.operators.project import limit_columns

# Values a task keeps for each text column while it counts distinct ones: as 64-bit hashes, so their length does not matter.
TRACKED = 1024
# Seconds to wait for the numbers of a run that has ended.
PATIENCE = 30.0


@dataclass(frozen=True)
class Watch:
    """Numbers that come with the first run of a guarded source."""

    seen: Observation
    columns: Mapping[str, str]
    threshold: int

    def told(self, meta: Meta) -> Meta:
        """The notes added to a source's meta; as it was if the source has not run."""
        ready, until = self.seen._jo.future(), time.monotonic() + PATIENCE
        while not ready.isCompleted():
            if time.monotonic() > until:
                return meta
            time.sleep(0.02)
        numbers = self.seen.get
        if not numbers:
            return meta
        meta = replace(meta, row_count=numbers["rows"])
        if numbers["cut"]:
            meta = meta.warn(cell_warning(numbers["cut"]))
        few = {
            name: numbers[f"kept_{key}"] for key, name in self.columns.items()
            if numbers[f"about_{key}"] <= 2 * self.threshold + 16 and 1 <= numbers[f"kept_{key}"] <= self.threshold
        }
        return replace(meta, extra={**meta.extra, "dictionaryColumns": few}) if self.threshold > 0 else meta


def guarded(frame: Frame, config: Mapping[str, Any]) -> Frame:
    """Column cap, cell limits, dictionary detection and row limit, as far as `config` asks for them.

    `max_columns`, `max_string_bytes`, `max_binary_bytes`, `dictionary_threshold` (True: 128 values), `row_limit`. How many cells were cut and which text columns
    have few values is counted while the source's rows pass by, in the run that reads them anyway, and is
    there afterwards: see `settled`. Filters are not pushed below these counters, hence all of it is opt-in.
    """
    if config.get("max_columns"):
        frame = limit_columns(frame, config["max_columns"])
    limits = {k: config[k] for k in ("max_string_bytes", "max_binary_bytes") if config.get(k)}
    threshold = config.get("dictionary_threshold") or 0
    threshold = DICTIONARY_THRESHOLD if threshold is True else int(threshold)
    if limits or threshold > 0:
        frame = _watched(frame, limits, threshold)
    if limits:
        frame = replace(frame, df=truncate_cells(frame.df, **_both(limits)))
    if config.get("row_limit"):
        limited = row_limit(frame, config["row_limit"], maximum=config.get("max_row_limit", MAX_ROW_LIMIT))
        frame = replace(limited, watch=frame.watch)
    return frame


def _both(limits: Mapping[str, int]) -> dict[str, int]:
    """A kind of cell without a limit of its own is not cut."""
    return {k: limits.get(k, 0) for k in ("max_string_bytes", "max_binary_bytes")}


def _watched(frame: Frame, limits: Mapping[str, int], threshold: int) -> Frame:
    names = string_columns(frame.df) if threshold > 0 else []
    columns = {str(i): n for i, n in enumerate(names)}
    cut = long_cells(frame.df, **_both(limits)) if limits else F.lit(0).cast("long")
    metrics = [F.count(F.lit(1)).alias("rows"), F.coalesce(cut, F.lit(0)).cast("long").alias("cut")]
    for key, name in columns.items():
        metrics += [_kept(col(name), threshold).alias(f"kept_{key}"), F.approx_count_distinct(col(name)).alias(f"about_{key}")]
    seen = Observation(f"guards:{frame.meta.name or frame.meta.source_id}")
    return replace(frame, df=frame.df.observe(seen, *metrics), watch=Watch(seen, columns, threshold))


def _kept(value: Column, threshold: int) -> Column:
    """The distinct values, at most one more than `threshold`. Exact as long as no task meets more than `TRACKED`; the sketch beside it tells."""
    hashed = F.when(value.isNotNull(), F.xxhash64(value))
    tracked = max(TRACKED, 4 * threshold)
    items = F.call_function("approx_top_k", hashed, F.lit(threshold + 2), F.lit(tracked))
    return F.size(F.filter(items, lambda x: x["item"].isNotNull()))


def settled(frame: Frame) -> Frame:
    """The frame with the notes of its guards in its meta, once a run has read the source."""
    return replace(frame, meta=frame.watch.told(frame.meta)) if frame.watch else frame
