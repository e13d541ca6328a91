"""Memoised results in dependency groups: what rests on a group is forgotten, and unpersisted, when the group changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Memo:
    """Results by name, each with the groups that it rests on. DataFrames are persisted while they are remembered."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[object, frozenset[str]]] = {}

    def get(self, name: str, groups: list[str], make: Callable[[], object]) -> object:
        if name not in self.kept:
            made = make()
            self.kept[name] = (made.persist() if isinstance(made, DataFrame) else made, frozenset(groups))
        return self.kept[name][0]

    def changed(self, group: str) -> list[str]:
        """Forget what rests on the group; the names that went."""
        gone = [n for n, (_, g) in self.kept.items() if group in g]
        for n in gone:
            v, _ = self.kept.pop(n)
            if isinstance(v, DataFrame):
                v.unpersist()
        return gone
