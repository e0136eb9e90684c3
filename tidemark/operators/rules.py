"""Rules over series specs (BKT-01), from the text to a backtest in one job."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, ge, gt, le, lt, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backtests, series

COMPARE = {"<": lt, "<=": le, ">": gt, ">=": ge}


@dataclass(frozen=True)
class Comparison:
    left: series.Spec | float
    sign: str
    right: series.Spec | float


@dataclass(frozen=True)
class Rule:
    """Groups of comparisons: true if all of one group hold."""

    groups: tuple[tuple[Comparison, ...], ...]

    def specs(self) -> list[series.Spec]:
        """Each spec once, in order."""
        sides = [x for g in self.groups for c in g for x in (c.left, c.right)]
        return list(dict.fromkeys(x for x in sides if isinstance(x, series.Spec)))

    def condition(self, columns: Mapping[str, Column]) -> Column:
        """BKT-02: three-valued: a missing side leaves its comparison undecided."""
        side = lambda x: F.lit(x) if isinstance(x, float) else columns[x.text]
        return reduce(or_, (reduce(and_, (COMPARE[c.sign](side(c.left), side(c.right)) for c in g)) for g in self.groups))


def parsed(text: str, registry: series.Registry) -> Rule:
    """Comparisons of specs or numbers; ``and`` binds tighter than ``or``. A spec may hold spaces, as around its / or -."""

    def side(part: str) -> series.Spec | float:
        return float(part) if re.fullmatch(r"[-+]?\d+(\.\d+)?", part) else series.parsed(part, registry)

    groups = []
    for clauses in backtests.rule_clauses(text):
        groups.append(tuple(Comparison(side(a), sign, side(b)) for a, sign, b in clauses))
    return Rule(tuple(groups))


def run(rules: Mapping[str, tuple[str, str]], tables: dict[str, DataFrame], days: DataFrame, registry: series.Registry, *, start: str | None = None, end: str | None = None, cost_bps: float = 5.0, short: bool = False, source: str = "px") -> DataFrame:
    """BKT-01..03: backtests of several rules, {name: (asset id, rule)}; the rows of ``backtests.run`` with ``security_id``, the rule's name.

    All terms of all rules are loaded once and all specs built together
    (TSR-02); a day's values stand side by side, one column a spec. A run starts
    where every input and the asset have a value, on or after ``start``.
    """
    found = {name: (series.parsed(f"{source}:{asset}", registry), parsed(text, registry)) for name, (asset, text) in rules.items()}
    wanted = {s.text: s for price, rule in found.values() for s in (price, *rule.specs())}
    built = series.build(wanted.values(), tables, days, registry, end=end)
    place = {text: f"s{i}" for i, text in enumerate(wanted)}
    wide = built.groupBy("date").agg(*(F.max(F.when(F.col("key") == text, F.col("value"))).alias(c) for text, c in place.items()))
    columns = {text: F.col(c) for text, c in place.items()}
    rows = []
    for name, (price, rule) in found.items():
        known = reduce(and_, (columns[s.text].isNotNull() for s in rule.specs()), F.lit(True))
        if start:
            known = known & (F.col("date") >= F.lit(start).cast("date"))
        rows.append(wide.select(F.lit(name).alias("security_id"), "date", columns[price.text].alias("close"), rule.condition(columns).alias("_rule"), known.alias("_known")))
    return backtests.run(reduce(DataFrame.unionByName, rows), F.col("_rule"), cost_bps, short, inputs=F.col("_known"))
