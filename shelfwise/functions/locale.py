"""Order, equality and search as readers of a language expect them, by Spark's collations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compares base letters only: accents and case do not count.
BLIND = "UNICODE_CI_AI"


def in_order(text: Column, language: str = "pt") -> Column:
    """A text that sorts and compares as in a dictionary of the language."""
    return F.collate(text, language)


def blind(text: Column) -> Column:
    """A text that groups, joins and compares without regard to accents and case."""
    return F.collate(text, BLIND)


def contains_blind(text: Column, term: Column) -> Column:
    """Whether a text holds a term, accents and case apart; an empty term is in every text."""
    return F.contains(blind(text), blind(term))
