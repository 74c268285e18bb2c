"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from annalist.plans import catalogue, evaluation, generation, knowledge, records, stages

PARTS = (catalogue, generation, knowledge, evaluation, records, stages)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
