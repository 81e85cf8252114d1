"""What defines a table besides its stored rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from colonnade.plans.grammar import Agg, RowRel, parse, parse_total


@dataclass
class TableDef:
    """formulas: computed columns by name; aggregates: name -> text like ``sum(total where region = "EU") - min(total)``."""

    formulas: dict[str, str] = field(default_factory=dict)
    aggregates: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    order: str | None = None
    #: An extension: running totals restart for each of these values.
    partition: tuple[str, ...] = ()

    def trees(self) -> dict[str, object]:
        return {n: parse(f) for n, f in self.formulas.items()}

    def scalars(self) -> dict[str, list[tuple[int, Agg]]]:
        """Each declared value as a sum of aggregates with signs."""
        return {name: parse_total(text) for name, text in self.aggregates.items()}

    def needs_order(self) -> bool:
        return any(isinstance(t, RowRel) for t in self.trees().values())
