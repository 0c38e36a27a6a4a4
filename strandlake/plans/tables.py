"""The tables that are shown: their columns, by group, and what each column joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strandlake.plans.views import Field, TableView

#: What a hit adds to a row that has its id.
HIT_COLUMNS = ("description", "species", "dbtype", "taxonomy", "go_list", "interpro", "kegg", "pfam", "ec")


def hit_details(details: DataFrame, key: str = "hit_id") -> tuple[DataFrame, list[Field]]:
    """Details of hits with their names prefixed ``hit_``, and the fields that show them."""
    columns = [c for c in HIT_COLUMNS if c in details.columns]
    return details.select(key, *[details[c].alias(f"hit_{c}") for c in columns]), [Field(f"hit_{c}", "best hit", "hit") for c in columns]


def with_hits(base: DataFrame, details: DataFrame, group: str, key: str = "hit_id", more: dict[str, tuple[DataFrame, list[str]]] | None = None) -> TableView:
    """A table of rows that name a hit (sequences, pairs or clusters), with the details of that hit and of tables in ``more``
    (name: rows and key). Rows without a hit stay, with nulls. A table of several rows a key, as of members, gives a row for
    each. A column that two of them have is shown from the first."""
    hit, fields = hit_details(details, key)
    joins, own = {"hit": (hit, [key])}, [Field(c, group) for c in base.columns]
    taken = {*base.columns, *hit.columns}
    for name, (rows, on) in (more or {}).items():
        fresh: Sequence[str] = [c for c in rows.columns if c not in taken]
        joins[name] = (rows.select(*on, *fresh), on)
        own += [Field(c, name, name) for c in fresh]
        taken |= set(fresh)
    return TableView(base, [*own, *fields], joins)
