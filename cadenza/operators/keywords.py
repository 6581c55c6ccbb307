"""Keyword search whose cost does not depend on the number of keywords."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def listed_hits(lowered: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """``struct`` with one array a list: its keywords contained in the (already lower-cased) text, in the list's order.

    All lists share one automaton, which a task builds once and walks once along each whole text; overlapping and
    nested keywords are all found.  The result equals ``functions.texts.keyword_hits`` of each list, which is the better
    choice for short lists, as it stays in the JVM: a keyword listed twice is reported twice, an empty one is in every
    text, a null text has none.  The lists travel with the query, so they are for word lists, not for tables.
    """
    import ahocorasick

    names = list(lists)
    words = [[w.lower() for w in lists[n]] for n in names]
    shown = [list(lists[n]) for n in names]
    schema = ", ".join(f"`{n}` array<string>" for n in names)

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, places = ahocorasick.Automaton(), {}
        for number, listed in enumerate(words):
            for at, word in enumerate(listed):
                places.setdefault(word, []).append((number, at))
        everywhere = places.pop("", [])
        for word, where in places.items():
            automaton.add_word(word, where)
        automaton.make_automaton()
        for texts in batches:
            rows = []
            for text in texts:
                found: set[tuple[int, int]] = set()
                if text is not None:
                    found.update(everywhere)
                    if places:
                        for _, where in automaton.iter(text):
                            found.update(where)
                row = [[] for _ in names]
                for number, at in sorted(found):
                    row[number].append(shown[number][at])
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return pandas_udf(search, f"struct<{schema}>")(lowered)
