"""Rule trees as data, compiled to one boolean column.

A tree is nested mappings: ``{"feature": "ret_1", "op": ">", "value": 0.0}`` (or
``"other": "vol_5"``), ``{"all_of": [...]}``, ``{"any_of": [...]}``, ``{"not": {...}}``. A
comparison with a missing side is false, not null, so its negation is true.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}


def condition(tree: Mapping) -> Column:
    """The tree as a column that is never null."""
    kinds = {"all_of", "any_of", "not", "feature"} & set(tree)
    if len(kinds) != 1:
        raise ValueError(f"a condition is one of all_of, any_of, not, or a comparison: {tree}")
    kind = kinds.pop()
    if kind == "feature":
        return _compare(tree)
    if kind == "not":
        return ~condition(tree["not"])
    parts = [condition(t) for t in tree[kind]]
    if not parts:
        raise ValueError(f"{kind} needs at least one condition")
    return functools.reduce(operator.and_ if kind == "all_of" else operator.or_, parts)


def _compare(leaf: Mapping) -> Column:
    extra = set(leaf) - {"feature", "op", "value", "other"}
    if extra or leaf.get("op") not in _OPS:
        raise ValueError(f"malformed comparison {leaf}")
    if (leaf.get("value") is None) == (leaf.get("other") is None):
        raise ValueError(f"a comparison needs exactly one of value or other: {leaf}")
    left = F.col(leaf["feature"]).cast("double")
    right = F.lit(float(leaf["value"])) if leaf.get("other") is None else F.col(leaf["other"]).cast("double")
    unordered = F.isnan(left) | F.isnan(right)
    met = F.when(unordered, F.lit(leaf["op"] == "!=")).otherwise(_OPS[leaf["op"]](left, right))
    return F.coalesce(F.when(left.isNotNull() & right.isNotNull(), met), F.lit(False))


def referenced(tree: Mapping | None) -> set[str]:
    """Every feature column a tree reads."""
    if tree is None:
        return set()
    if "feature" in tree:
        return {tree["feature"]} | ({tree["other"]} if tree.get("other") else set())
    children = tree.get("all_of") or tree.get("any_of") or [tree["not"]]
    return set().union(*map(referenced, children))


def target_weight(rule: Mapping) -> Column:
    """``weight`` when ``long_when`` holds, else ``-weight`` when ``short_when`` does, else 0."""
    if not (rule.get("long_when") or rule.get("short_when")):
        raise ValueError("a rule needs long_when or short_when")
    weight = float(rule.get("weight", 0.2))
    if weight <= 0:
        raise ValueError("weight must be positive")
    long_when = condition(rule["long_when"]) if rule.get("long_when") else F.lit(False)
    short_when = condition(rule["short_when"]) if rule.get("short_when") else F.lit(False)
    return F.when(long_when, weight).when(short_when, -weight).otherwise(0.0)


def check_features(df: DataFrame, rule: Mapping, rank_by: str | None = None) -> None:
    """Refuse a rule that names columns the frame lacks; otherwise it would never fire."""
    needed = referenced(rule.get("long_when")) | referenced(rule.get("short_when"))
    needed |= {rank_by} if rank_by else set()
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"rule reads columns {missing} that the features do not have")
