"""What a question asks for, as expressions on its text.

The phrase lists are constants, so each list becomes one regular-expression
test inside the projection; no lookup table is joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from foliant import vocab
from foliant.functions.text import col


def mentions(lowered: Column, phrases: list[str]) -> Column:
    """True when a lower-case text contains any of the phrases, anywhere."""
    return lowered.rlike("|".join(re.escape(p) for p in dict.fromkeys(phrases)))


def classify_intent(query: Column | str) -> Column:
    q = F.lower(col(query))
    chain = None
    for intent, phrases in vocab.INTENT_KEYWORDS:
        test = mentions(q, phrases)
        chain = F.when(test, F.lit(intent)) if chain is None else chain.when(test, F.lit(intent))
    return chain.otherwise(F.lit(vocab.DEFAULT_INTENT))


def needs_full_document(intent: Column | str) -> Column:
    return col(intent).isin(vocab.FULL_DOCUMENT_INTENTS)


def is_enumeration(intent: Column | str) -> Column:
    return col(intent).isin(vocab.ENUMERATION_INTENTS)


def is_structured(intent: Column | str) -> Column:
    return col(intent).isin(vocab.STRUCTURED_INTENTS)


def document_wide_flag(query: Column | str) -> Column:
    return mentions(F.lower(col(query)), vocab.DOCUMENT_WIDE_PHRASES)
