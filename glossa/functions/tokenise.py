"""Tokens of a text column, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = r"\p{L}+"


def fold_case(text: Column) -> Column:
    """Lower case by simple mappings, one character to one: the two letters with context or length changes go first."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


class Tokeniser:
    """Matches of a pattern in the lower-cased text, without the stop words.

    Stop words are compared with the lower-cased tokens as they are, so one with a capital removes nothing. A null text
    has no tokens.
    """

    def __init__(self, stop_words: Sequence[str] = (), pattern: str = LETTERS) -> None:
        self.stop_words, self.pattern = tuple(dict.fromkeys(stop_words)), pattern

    def tokenise(self, text: Column) -> Column:
        """The tokens as an array."""
        found = F.regexp_extract_all(fold_case(F.coalesce(text, F.lit(""))), F.lit(f"({self.pattern})"), F.lit(1))
        if not self.stop_words:
            return found
        stop = F.array(*map(F.lit, self.stop_words))
        return F.filter(found, lambda t: ~F.array_contains(stop, t))

    def for_each_in(self, docs: DataFrame, keep: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
        """``keep`` columns, ``pos`` and ``term``: one row for each token."""
        return docs.select(*keep, F.posexplode(self.tokenise(F.col(column))).alias("pos", "term"))
