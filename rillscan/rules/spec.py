"""What a rule is: a name, a predicate over one line, and the scope it needs.

A rule never loops over anything.  ``when`` receives the columns of one line and returns
a boolean column; Spark evaluates all rules of a language in one projection.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text

_FIXED = {rule[0]: rule[1:] for rule in fixed.RULES}


@dataclass(frozen=True)
class Line:
    """Columns a predicate may use."""

    s: Column          # trimmed line
    raw: Column        # untouched line
    near: Column       # this line and the two before it, joined (front-end files only)
    path: Column
    fact: Callable[[str], Column]  # whole-file facts, by name

    @property
    def low(self) -> Column:
        return F.lower(self.s)


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    ruleset: str
    when: Callable[[Line], Column]
    why: str
    fix: str
    step: int = 1                 # pass of the ruleset, part of the scan order
    min_depth: int = 0            # loops that must enclose the line
    max_depth: int | None = None
    in_sync: bool = False
    in_async: bool = False
    first_only: bool = False      # only the first hit of a file counts
    fallback: bool = False        # counts only when no other hit of the rule exists
    code: str | None = None       # shown instead of the line
    skips: tuple = ("ruleset",)   # prefixes of lines the rule does not look at
    title: str | None = None
    category: str | None = None
    severity: str | None = None

    def __post_init__(self):
        known = _FIXED.get(self.rule_id)
        for place, name in enumerate(("title", "category", "severity")):
            if getattr(self, name) is None:
                if known is None:
                    raise ValueError(f"{self.rule_id}: a new rule needs a {name}")
                object.__setattr__(self, name, known[place])

    @property
    def scoped(self) -> bool:
        return (self.min_depth > 0 or self.max_depth is not None
                or self.in_sync or self.in_async)

    def predicate(self, line: Line) -> Column:
        prefixes = fixed.SKIP_PREFIXES[self.ruleset] if self.skips == ("ruleset",) else self.skips
        hit = self.when(line)
        if prefixes:
            hit = hit & ~text.starts(line.s, *prefixes)
            if not self.first_only:  # a first hit may be an empty line
                hit = hit & (line.s != "")
        return hit
