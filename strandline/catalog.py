"""Name of each query: how to build it, and the SQL that gives the same rows."""

from __future__ import annotations

from strandline.functions import configs, documents, frames, logs, noise, records, text
from strandline.operators import alignment, boxes, folds, hulls, masks, metrics, sequences
from strandline.plans import loads, ranges, sweeps
from strandline.sources import files
from strandline.streaming import flows

_ALL = {k: v for m in (sequences, folds, boxes, masks, hulls, alignment, metrics, ranges, loads, sweeps, text, records, configs, frames, documents, logs, noise, files, flows) for k, v in m.QUERIES.items()}


def queries() -> dict:
    return {name: build for name, (build, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
