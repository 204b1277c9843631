"""Kinds of graph nodes: how a typed key becomes a term, and a term a key.

Joins run on keys (whole numbers where the source has them); terms are rendered at the end, or
where two kinds must be compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """Terms ``prefix + key + suffix``; the kind ``TERM`` has terms as its keys."""

    name: str
    prefix: str = ""
    suffix: str = ""
    integer: bool = False

    def render(self, key: Column) -> Column:
        return key if self is TERM or self == TERM else F.concat(F.lit(self.prefix), key.cast("string"), F.lit(self.suffix))

    def key(self, term: str) -> int | str | None:
        """The key of a term of this kind, None if it is of another."""
        if self == TERM:
            return term
        if len(term) < len(self.prefix) + len(self.suffix) or not term.startswith(self.prefix) or not term.endswith(self.suffix):
            return None
        key = term[len(self.prefix) : len(term) - len(self.suffix)]
        if not self.integer:
            return key
        try:
            return int(key) if str(int(key)) == key and -(1 << 63) <= int(key) < 1 << 63 else None
        except ValueError:
            return None

    @property
    def literal(self) -> bool:
        return self.prefix.startswith('"')

    def disjoint(self, other: Kind) -> bool:
        """Whether no term is of both kinds, as their prefixes show."""
        if TERM in (self, other) or self == other:
            return False
        return not (self.prefix.startswith(other.prefix) or other.prefix.startswith(self.prefix))


TERM = Kind("term")
#: A plain literal, by the text between its quotes.
TEXT = Kind("text", '"', '"')
#: A literal that holds a whole number.
INTEGER = Kind("integer", '"', '"', integer=True)


def iri(name: str, base: str, integer: bool = True) -> Kind:
    return Kind(name, f"<{base}{name}/", ">", integer)
