"""Ordered pairs of sources: every source against each later one."""

from __future__ import annotations

from dataclasses import dataclass

SEPARATOR = "__vs__"


@dataclass(frozen=True)
class Pair:
    y: str
    x: str

    @property
    def key(self) -> str:
        return f"{self.y}{SEPARATOR}{self.x}"

    @property
    def label(self) -> str:
        return f"{self.y} ~ {self.x}"

    @classmethod
    def parse(cls, key: str) -> Pair:
        """The pair of a key, split at its first separator."""
        y, _, x = key.partition(SEPARATOR)
        return cls(y, x)


def pairs(fields: list[str]) -> list[Pair]:
    """All pairs (earlier, later) of the distinct fields, in order."""
    names = list(dict.fromkeys(fields))
    return [Pair(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
