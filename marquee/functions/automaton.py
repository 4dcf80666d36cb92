"""Many pieces searched in whole texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_piece(text: Column, pieces: list[str]) -> Column:
    """The number of the first of the pieces, in their order, that the text contains; null if none. A null text counts as empty.

    Each task builds one automaton of all pieces, so a text is read once, however many there are. Callers bound the pieces.
    """

    @F.pandas_udf("long")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k in range(len(pieces) - 1, -1, -1):  # of equal pieces the first one counts
            if pieces[k]:
                automaton.add_word(pieces[k], k)
        automaton.make_automaton()
        none = not len(automaton)
        for texts in batches:
            yield pd.Series([None if none or not t else min((k for _, k in automaton.iter(t)), default=None) for t in texts], dtype="Int64")

    return search(text)
