"""Tag rules compiled to one predicate over a map of tags.

A rule is (key, value, flags). ``*`` stands for any value, and with ``MULTI`` the value may be one of a list
separated by semicolons. ``SKIP_*`` flags keep a rule from being asked of that kind of entity.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT, MULTI, SKIP_RELATION, SKIP_WAY, SKIP_NODE = 1, 2, 4, 8, 16
_SKIPS = {"node": SKIP_NODE, "way": SKIP_WAY, "relation": SKIP_RELATION, None: 0}


@dataclass(frozen=True)
class Rule:
    key: str
    value: str = "*"
    flags: int = 0


def matches(tags: Column, rule: Rule) -> Column:
    value = F.try_element_at(tags, F.lit(rule.key))
    if rule.value == "*":
        return value.isNotNull()
    hit = value == rule.value
    if rule.flags & MULTI:
        hit = hit | F.array_contains(F.transform(F.split(value, ";"), lambda v: F.trim(v)), rule.value)
    return F.coalesce(hit, F.lit(False))


def any_rule(tags: Column, rules: Iterable[Rule], kind: str | None = None) -> Column:
    asked = [matches(tags, r) for r in rules if not r.flags & _SKIPS[kind]]
    return reduce(lambda a, b: a | b, asked, F.lit(False))


def flat_only(tags: Column, rules: Sequence[Rule]) -> Column:
    """The relation is kept by flat rules only, so what it holds is not kept for its sake."""
    hard = [r for r in rules if not r.flags & FLAT]
    return any_rule(tags, rules, "relation") & ~any_rule(tags, hard, "relation")


def kept(tags: Column, keep: Iterable[Rule], drop: Iterable[Rule], kind: str | None = None) -> Column:
    return any_rule(tags, keep, kind) & ~any_rule(tags, drop, kind)


def oneway(tags: Column, forward: Iterable[Rule], reverse: Iterable[Rule], twoway: Iterable[Rule]) -> Column:
    """0: both ways, 1: along the way, 2: against it."""
    return (
        F.when(any_rule(tags, twoway, "way"), 0).when(any_rule(tags, reverse, "way"), 2).when(any_rule(tags, forward, "way"), 1)
    ).otherwise(0)


def level(tags: Column, levels: Sequence[Iterable[Rule]]) -> Column:
    """Number of the first set of rules that matches, else 0."""
    return F.coalesce(*[F.when(any_rule(tags, rules), F.lit(i)) for i, rules in enumerate(levels)], F.lit(0))


def node_class(tags: Column, classes: Mapping[str, Iterable[Rule]]) -> Column:
    """First of the named classes that matches, e.g. station, blocker, turning_circle."""
    return F.coalesce(*[F.when(any_rule(tags, rules, "node"), F.lit(name)) for name, rules in classes.items()])


def restriction(tags: Column, positive: Iterable[Rule], negative: Iterable[Rule], exempt: Iterable[Rule]) -> Column:
    """True: the only turn allowed, false: a turn forbidden, null: neither."""
    free = any_rule(tags, exempt)
    return F.when(free, F.lit(None)).when(any_rule(tags, positive), True).when(any_rule(tags, negative), False)


def pruned(tags: Column, *rules: Iterable[Rule]) -> Column:
    """Only tags whose key some rule names."""
    keys = sorted({r.key for group in rules for r in group})
    return F.map_filter(tags, lambda k, _: k.isin(keys)) if keys else F.map_filter(tags, lambda k, _: F.lit(False))


def merged(*groups: Iterable[Rule]) -> tuple[Rule, ...]:
    """Union of rules: what several modes keep together."""
    return tuple(sorted({r for g in groups for r in g}, key=lambda r: (r.key, r.value, r.flags)))


def deep_attribute(tags: Column, wanted: Sequence[tuple[str, Rule | None]], relations: Column) -> Column:
    """First non-empty attribute, read from the entity or from the first containing relation a rule accepts."""
    found = []
    for attribute, rule in wanted:
        if rule is None:
            found.append(F.try_element_at(tags, F.lit(attribute)))
        else:
            found.append(_inside(relations, rule, attribute))
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found])


def _inside(relations: Column, rule: Rule, attribute: str) -> Column:
    def accepted(tags: Column) -> Column:
        return matches(tags, rule) & F.try_element_at(tags, F.lit(attribute)).isNotNull()

    return F.try_element_at(F.get(F.filter(relations, accepted), 0), F.lit(attribute))
