"""What the local results of a pair of sources say: a sentence of what is measured and one of how a value is read, put
together from the operand order, the denominator, the unit and the value of perfect agreement of each result."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed names: result fields as files of an analysis call them, and our columns.
COLUMNS = {"Local_R2": "local_r2", "Coeff": "slope", "Corr": "local_corr", "LME": "lme", "LMAE": "lmae", "LMRE": "lmre", "LRMSE": "lrmse"}


@dataclass(frozen=True)
class Measure:
    """``signed``: y minus x keeps its sign; ``over``: what a difference is divided by; ``unit``: that of the values;
    ``perfect``: the value where the sources agree; ``squared``: differences count by their squares."""

    of: str
    unit: str = ""
    perfect: float = 0.0
    signed: bool = False
    over: str = ""
    squared: bool = False

    def meaning(self, y: str, x: str) -> str:
        text = self.of.format(y=y, x=x)
        return f"{text}, weighted by nearness" + (f", divided by {self.over.format(y=y, x=x)}" if self.over else "") + (f", in units of {self.unit.format(y=y, x=x)}" if self.unit else "") + "."

    def reading(self, y: str, x: str) -> str:
        signs = f" Above it {y} exceeds {x}, below it {y} falls short." if self.signed else ""
        weight = " A few large differences raise it more than many small ones." if self.squared else ""
        return f"{self.perfect:g} where {y} and {x} agree.{signs}{weight}"


MEASURES = {
    "local_r2": Measure("share of the variance of {y} that a line through {x} accounts for", perfect=1.0),
    "slope": Measure("rise of {y} with one unit of {x}, from the local regression", unit="{y} per {x}", perfect=1.0),
    "local_corr": Measure("correlation of {y} with {x} among the neighbours", perfect=1.0),
    "lme": Measure("mean of {y} minus {x}", unit="{y}", signed=True),
    "lmae": Measure("mean distance between {y} and {x}", unit="{y}"),
    "lmre": Measure("mean distance between {y} and {x}", over="the size of {x}"),
    "lrmse": Measure("root of the mean squared difference of {y} and {x}", unit="{y}", squared=True),
}


def meaning(field: str, y: str = "y", x: str = "x") -> tuple[str, str] | None:
    """What a result field of a pair measures and how it is read; None for a field that is no result."""
    found = MEASURES.get(COLUMNS.get(field, field))
    return None if found is None else (found.meaning(y, x), found.reading(y, x))
