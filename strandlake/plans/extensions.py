"""Where a user's own methods come in: differential expression and enrichment of a matrix, and scores of alignments.

A method is a function of a pandas frame. Spark deals the work out: one group for each contrast, term set or cluster, so
several contrasts run at once. The built-in operators never need one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Method = Callable[[pd.DataFrame], pd.DataFrame]


class Registry:
    """Methods by name, each with the columns that it gives."""

    def __init__(self) -> None:
        self._methods: dict[str, tuple[Method, str]] = {}

    def add(self, name: str, method: Method, schema: str) -> None:
        if name in self._methods:
            raise ValueError(f"the method {name} is there already")
        self._methods[name] = (method, schema)

    def names(self) -> list[str]:
        return sorted(self._methods)

    def run(self, name: str, rows: DataFrame, by: str) -> DataFrame:
        """The method's results for each group of ``by``. A group is a table that the method wants whole: the matrix of a
        contrast, the members of a cluster."""
        method, schema = self._methods[name]
        return rows.groupBy(by).applyInPandas(lambda group: method(group), schema)


#: From (seq_id, contrast, counts) to (seq_id, contrast, p); from (contrast, gonum, ...) to (gonum, contrast, p); from
#: (cluster, member, aligned) to (cluster, score).
expression_methods, enrichment_methods, alignment_scores = Registry(), Registry(), Registry()
