"""Style taxonomy expressions: family, style similarity, genre similarity."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from tonearm.functions import taxonomy as tx
from tonearm.functions.text import clean, col


def _map(pairs) -> Column:
    """A constant map; one parsed literal keeps the plan small and folds at planning time."""
    values = dict(pairs)
    kind = "double" if all(isinstance(v, float) for v in values.values()) else "string"
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


class Styles:
    """A taxonomy bound to expressions.  Lists are constants of a bounded size (the taxonomy itself)."""

    def __init__(self, families=None, adjacency=None, family_pairs=None, dialect: str = "hosted"):
        self.families = families if families is not None else tx.families()
        self.adjacency = adjacency if adjacency is not None else tx.adjacency()
        self.family_pairs = family_pairs if family_pairs is not None else tx.FAMILY_PAIRS
        self.empty = tx.EMPTY_STYLE[dialect]
        self.dialect = dialect
        both = {f"{b}|{a}": v for a, b, v in self.adjacency}
        both.update({f"{a}|{b}": v for a, b, v in self.adjacency})  # the stated direction wins
        self._adjacent = _map(both.items())
        first_family: dict[str, str] = {}
        for style, family in self.families:
            first_family.setdefault(style, family)
        self._family = _map(first_family.items())
        linked = {f"{a}|{b}": v for a, b, v in self.family_pairs}
        linked.update({f"{b}|{a}": v for a, b, v in self.family_pairs})
        self._linked = _map(linked.items())

    def family(self, style) -> Column:
        value = clean(style)
        return F.coalesce(F.element_at(self._family, value), value)

    def similarity(self, a, b) -> Column:
        left, right = clean(a), clean(b)
        fa, fb = self.family(a), self.family(b)
        adjacent = F.element_at(self._adjacent, F.concat_ws("|", left, right))
        linked = F.element_at(self._linked, F.concat_ws("|", fa, fb))
        return (
            F.when((left == "") | (right == ""), F.lit(self.empty))
            .when(left == right, F.lit(1.0))
            .when(adjacent.isNotNull(), adjacent)
            .when(fa == fb, F.lit(tx.SAME_FAMILY))
            .otherwise(F.coalesce(linked, F.lit(tx.UNRELATED)))
        )

    def genre_similarity(self, primary_a, sub_a, primary_b, sub_b) -> Column:
        pa, sa, pb, sb = (col(c) for c in (primary_a, sub_a, primary_b, sub_b))
        return (
            F.when((pa != "") & (pa == pb), F.lit(1.0))
            .when((sa != "") & (sa == sb), F.lit(0.9))
            .otherwise(F.greatest(self.similarity(sa, sb), self.similarity(pa, pb) * 0.82))
        )

    def reach_keys(self, primary, sub) -> Column:
        """Keys a lane looks for; a lane pair with similarity >= .10 shares one with own_keys."""
        def keys(style):
            style = clean(style)
            family = self.family(style)
            linked = F.transform(
                F.filter(F.array(*[F.lit(f"{a}|{b}") for x, y, _ in self.family_pairs for a, b in ((x, y), (y, x))]),
                         lambda p: F.element_at(F.split(p, r"\|"), 1) == family),
                lambda p: F.concat(F.lit("f:"), F.element_at(F.split(p, r"\|"), 2)))
            near = F.transform(
                F.filter(F.map_keys(self._adjacent), lambda p: F.element_at(F.split(p, r"\|"), 1) == style),
                lambda p: F.concat(F.lit("s:"), F.element_at(F.split(p, r"\|"), 2)))
            own = F.array(F.concat(F.lit("s:"), style), F.concat(F.lit("f:"), family))
            everything = F.when(style == "", F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
            return F.concat(own, linked, near, everything)

        return F.array_distinct(F.concat(keys(primary), keys(sub)))

    def own_keys(self, primary, sub) -> Column:
        def keys(style):
            style = clean(style)
            return F.array(F.concat(F.lit("s:"), style), F.concat(F.lit("f:"), self.family(style)))

        return F.array_distinct(F.concat(keys(primary), keys(sub), F.array(F.lit("*"))))


def primary_genre(dialect: str = "hosted", ignore=()) -> Column:
    """Primary genre of a track row.

    hosted: provider_genre, else provider_subgenre (an empty string is kept).
    classic: first non-empty of the two, skipping labels in ``ignore``.
    """
    if dialect == "hosted":
        return clean(F.coalesce(F.col("provider_genre"), F.col("provider_subgenre")))
    options = []
    for name in ("provider_genre", "provider_subgenre"):
        value = clean(name)
        options.append(F.when((value != "") & ~value.isin([*ignore, ""]), value))
    return F.coalesce(*options, F.lit(""))


def sub_genre(dialect: str = "hosted") -> Column:
    if dialect == "hosted":
        return clean(F.coalesce(F.col("provider_subgenre"), F.col("seed_genre")))
    filled = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))
    return clean(F.coalesce(filled("provider_subgenre"), filled("seed_genre")))


def title_mood(title, album) -> Column:
    text = clean(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(album), F.lit(""))))
    return F.when(text.rlike(tx.NEGATIVE_TITLE), F.lit(-1)).when(text.rlike(tx.POSITIVE_TITLE), F.lit(1))
