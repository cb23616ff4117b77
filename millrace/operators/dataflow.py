"""Dealing rows out: shuffles by a key, equal keys side by side, splits, and the rows of each group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def shuffled(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """Rows dealt to n partitions by a hash of the keys."""
    return df.repartition(n, *keys)


def adjacent(df: DataFrame, key: str) -> DataFrame:
    """Rows with equal keys side by side."""
    return df.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))


def split(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the mask is true, and where it is false; rows with a null mask are in neither."""
    return df.where(mask), df.where(~mask)


def reduced(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of aggregates, each added up in the tasks first."""
    return df.agg(*(c.alias(n) for n, c in aggregates.items()))


class Groups:
    """The rows of each group as a table of its own, in order of the key."""

    def __init__(self, table, keys: list[str]):
        self._table, self._keys = table, keys

    def keys(self) -> list[tuple]:
        found = self._table[self._keys].unique().sort(self._keys)
        return [tuple(r.values()) for r in found]

    def get_group(self, *key):
        part = self._table
        for name, value in zip(self._keys, key):
            part = part[part[name] == value]
        return part

    def num_groups(self) -> int:
        return self._table[self._keys].unique().num_rows()

    def __iter__(self) -> Iterator[tuple]:
        for key in self.keys():
            yield key, self.get_group(*key)
