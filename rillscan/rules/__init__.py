"""The rule catalogue, in scan order."""

from . import c, csharp, frontend, java, node, python, sql
from .spec import Line, RuleSpec

CATALOGUE = [
    rule
    for module in (java, python, sql, frontend, csharp, c, node)
    for rule in module.RULES
]


def rules_for(*rulesets: str) -> list[RuleSpec]:
    return [rule for rule in CATALOGUE if rule.ruleset in rulesets]


__all__ = ["CATALOGUE", "Line", "RuleSpec", "rules_for"]
