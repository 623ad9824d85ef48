"""Column names and the concepts behind them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant import vocab
from foliant.functions.text import col


def flatten(name: str) -> str:
    return name.upper().translate({ord(ch): None for ch in vocab.FLATTENED_AWAY})


#: flattened alias -> concept; an alias listed twice belongs to the first concept
CONCEPT_OF: dict[str, str] = {}
for _concept, _aliases in vocab.COLUMN_ALIASES:
    for _alias in [_concept, *_aliases]:
        CONCEPT_OF.setdefault(flatten(_alias), _concept)


def flatten_name(c: Column | str) -> Column:
    return F.translate(F.upper(col(c)), vocab.FLATTENED_AWAY, "")


def concept_of(c: Column | str) -> Column:
    """Concept of a header, null when none is known.  A constant map: no join, no shuffle."""
    pairs = [F.lit(x) for kv in CONCEPT_OF.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), flatten_name(c))


def canonical_column(c: Column | str) -> Column:
    return F.coalesce(concept_of(c), col(c))
