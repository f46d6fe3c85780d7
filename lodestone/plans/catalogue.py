"""Registry of the engine's queries and their DuckDB twins."""

from __future__ import annotations

from lodestone.functions import names, routing, tables
from lodestone.operators import chunks, communities, fill, knn, packing, paths, quotes, ranks, runs, terms
from lodestone.operators import resolution as merges
from lodestone.plans import census, events, evidence, full, graph, links, more, records, resolution, temporal, text
from lodestone.sources import records as raw
from lodestone.sources import snapshots
from lodestone.streaming import events as stream
from lodestone.streaming import items, windows

MODULES = (temporal, graph, events, text, resolution, records, evidence, links, census, full, more, chunks, packing, merges, communities, knn, names, routing, terms, ranks, runs, quotes, paths, fill, tables, raw, snapshots, stream, windows, items)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
