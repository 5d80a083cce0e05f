"""Column projector (P20, R7): keep or drop a set of samples, with compact new indices.

A projector is a value: the samples there are, the chosen ones, and whether these
are kept or dropped.  Its places, the kept indices in order with their new 0-based
ones, come from a distributed prefix sum and are computed once; cells, labels and
dictionaries are projected by one join with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.operators.indexing import dense_index
from allelo.operators.matrix import SUBJECT_BROADCAST_ROWS


class Projector:
    """``every(column)`` and ``chosen(column)`` hold indices; null and unknown chosen ones choose nothing."""

    def __init__(self, every: DataFrame, chosen: DataFrame, include: bool = True, column: str = "sample_index"):
        self.column, self.include = column, include
        self.every, self.chosen = every.select(column).distinct(), chosen.select(column).distinct()

    @property
    def inverted(self) -> "Projector":
        """The projector that keeps what this one drops."""
        return Projector(self.every, self.chosen, not self.include, self.column)

    @property
    def pair(self) -> tuple["Projector", "Projector"]:
        """This projector and its inverse, as for test and training samples."""
        return self, self.inverted

    @cached_property
    def places(self) -> DataFrame:
        """``(column, place)`` of the kept samples; checkpointed, so projections share it."""
        kept = self.every.join(self.chosen, self.column, "left_semi" if self.include else "left_anti")
        return dense_index(kept.where(F.col(self.column).isNotNull()), [self.column], "place").checkpoint()

    def project(self, table: DataFrame) -> DataFrame:
        """Rows of kept samples with their new indices; works on cells, labels and dictionaries alike."""
        places = self.places
        side = F.broadcast(places) if places.count() <= SUBJECT_BROADCAST_ROWS else places
        renamed = [F.col("place").alias(c) if c == self.column else F.col(f"`{c}`") for c in table.columns]
        return table.join(side, self.column).select(*renamed)
