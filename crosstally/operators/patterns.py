"""Names by the first of many substrings, from a table of patterns with priorities.

All patterns are looked for in one pass over a text, by an automaton that each worker builds once from the broadcast
patterns. Their size is summed up before; too many for one broadcast are cut into parts, each with an automaton of its
own, and the best of the parts' answers counts. Texts are not shuffled.
"""

from __future__ import annotations

from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import materialise
from .schema import q

UNKNOWN = "Unknown"
# An automaton takes about so many bytes for a character of its patterns; most bytes of one part's automaton.
BYTES_PER_CHARACTER, MOST_BYTES = 64, 64 << 20


class Patterns:
    """Patterns as they travel; the automaton is built where it is used."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.rows = rows

    def __getstate__(self):
        return {"rows": self.rows}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made, best = ahocorasick.Automaton(), {}
        for pattern, priority, name in self.rows:
            best[pattern] = min(best.get(pattern, (priority, name)), (priority, name))
        for pattern, found in best.items():
            made.add_word(pattern, found)
        made.make_automaton()
        return made

    def first(self, text: str | None) -> tuple[int | None, str | None]:
        """Smallest priority and name of all patterns in a text."""
        if not text or not self.rows:
            return None, None
        return min((found for _, found in self.automaton.iter(text)), default=(None, None))


def first_match(df: DataFrame, text: str, patterns: DataFrame, into: str = "name", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds ``into``: of the ``patterns`` (``pattern, priority, name``) that the text contains, whatever the case, the
    name with the smallest priority (of equal ones the name that sorts first); ``UNKNOWN`` if there is none.

    Null and empty texts hold no pattern. Patterns that are null or empty, or have no priority or name, are left out.
    """
    usable = patterns.select(F.lower("pattern").alias("pattern"), F.col("priority").cast("bigint").alias("priority"), F.col("name").cast("string").alias("name")).dropna().filter("pattern <> ''")
    usable = materialise(usable.distinct(), "patterns")
    size = usable.agg(F.coalesce(F.sum(F.length("pattern") * BYTES_PER_CHARACTER), F.lit(0))).first()[0]
    parts = 1 + size // most_bytes
    lowered, best = F.lower(q(text)), []
    for part in range(parts):
        # A part's patterns are about most_bytes / BYTES_PER_CHARACTER characters.
        mine = usable.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        shared = df.sparkSession.sparkContext.broadcast(Patterns([tuple(r) for r in mine.toLocalIterator()]))
        best.append(_found(shared)(lowered))
    # least() passes over nulls.
    first = best[0] if parts == 1 else F.least(*[F.when(b["priority"].isNotNull(), b) for b in best])
    return df.withColumn(into, F.coalesce(first["name"], F.lit(UNKNOWN)))


def _found(shared) -> Column:
    @F.pandas_udf("priority bigint, name string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.first(t) for t in texts]
        return pd.DataFrame({"priority": pd.array([p for p, _ in rows], "Int64"), "name": [n for _, n in rows]})

    return found
