"""Vocabularies as data, compiled to expressions; query pools and their rotation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions.text import let


@dataclass(frozen=True)
class Entry:
    """A thing to find: by its name, unless bare_name is off, and by other names; not_ are phrases that hide it."""

    id: str
    name: str
    aka: tuple[str, ...] = ()
    not_: tuple[str, ...] = ()
    bare_name: bool = True
    score: bool = True

    def needles(self) -> list[str]:
        names = ([self.name] if self.bare_name else []) + list(self.aka)
        return list(dict.fromkeys(n.lower() for n in names))


@dataclass(frozen=True)
class Vocabulary:
    entries: tuple[Entry, ...] = field(default_factory=tuple)

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, name, needle, ascii, scored): a small dimension table."""
        rows = [(e.id, e.name, n, n.isascii(), e.score) for e in self.entries for n in e.needles()]
        return spark.createDataFrame(rows, "id string, name string, needle string, ascii boolean, scored boolean")

    def matches(self, text: Column) -> Column:
        """Ids found in a text, in the vocabulary's order. A text is lower-cased once, not for each needle."""
        return let(F.lower(F.coalesce(text, F.lit(""))), self.matches_in_lower)

    def matches_in_lower(self, low: Column) -> Column:
        """Ids found in a text that is in lower case already, in the vocabulary's order.

        An ASCII needle must not touch a letter or digit, nor follow &; another is found anywhere. Each pattern is guarded by
        a plain search, which is far cheaper than the pattern.
        """

        def has(e: Entry, own: Column) -> Column:
            plain = [n for n in e.needles() if n.isascii()]
            tests = [F.contains(own, F.lit(n)) for n in e.needles() if not n.isascii()]
            if plain:
                guard = F.lit(False)
                for n in plain:
                    guard = guard | F.contains(own, F.lit(n))
                tests.append(guard & own.rlike("(?<![a-z0-9&])(?:" + "|".join(re.escape(n) for n in plain) + ")(?![a-z0-9])"))
            any_ = F.lit(False)
            for t in tests:
                any_ = any_ | t
            return any_

        def test(e: Entry) -> Column:
            own = low
            for phrase in e.not_:
                own = F.replace(own, F.lit(phrase.lower()), F.lit(" " * len(phrase)))
            return let(own, lambda x: has(e, x)) if e.not_ else has(e, low)

        found = [F.when(test(e), F.lit(e.id)) for e in self.entries]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def scoring(self, ids: Column) -> Column:
        """Without the ids that are labels only."""
        labels = [e.id for e in self.entries if not e.score]
        return F.array_except(ids, F.array(*[F.lit(x) for x in labels])) if labels else ids

    def display(self, id_: Column) -> Column:
        """The name of an id, or the id itself."""
        if not self.entries:
            return id_
        pairs = F.create_map(*[F.lit(x) for e in self.entries for x in (e.id, e.name)])
        return F.coalesce(F.try_element_at(pairs, id_), id_)


def derived_queries(names: DataFrame, templates: list[str], name_col: str = "name") -> DataFrame:
    """(query, name) for each name and template, %s replaced: a few rows by a few templates."""
    shapes = F.explode(F.array(*[F.lit(t) for t in templates])).alias("template")
    return names.select(name_col, shapes).select(F.replace("template", F.lit("%s"), F.col(name_col)).alias("query"), F.col(name_col).alias("name"))


def rotation(pool: DataFrame, date: Column, per_day: int, size: int, ord_col: str = "ord") -> DataFrame:
    """The queries whose turn it is: those at i with i modulo the cycle equal to the day's number modulo the cycle."""
    cycle = max(1, math.ceil(size / max(1, per_day)))
    days = F.datediff(date, F.lit("1970-01-01").cast("date"))
    return pool.where(F.pmod(F.col(ord_col), F.lit(cycle)) == F.pmod(days, F.lit(cycle)))
