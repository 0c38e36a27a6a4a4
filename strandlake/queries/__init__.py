"""Queries over the test tables in the parts of sequences, hits, counts, pairs and terms, each with its SQL."""

from __future__ import annotations

from strandlake.queries import clusters, expression, frames, hits, merging, ontology, pairs, reports, sequences, tables

ALL: dict[str, tuple] = {}
for _m in (hits, tables, expression, ontology, pairs, clusters, sequences, frames, reports, merging):
    ALL |= _m.QUERIES

QUERIES = {name: q[0] for name, q in ALL.items()}
ORACLE_SQL = {name: q[1] for name, q in ALL.items() if q[1]}
