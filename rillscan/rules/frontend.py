from pyspark.sql import functions as F

from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec

RULES = [
    RuleSpec(
        "fe.missing_cleanup", "frontend",
        lambda c: c.fact("effect_without_cleanup") & has(c.s, "setInterval(", "addEventListener("),
        "The timer or listener lives on after its component is gone.",
        "Return a function from the effect that removes it."),
    RuleSpec(
        "fe.inline_function", "frontend", lambda c: matches(c.s, fx.P_FE_INLINE, "=>"),
        "Each render makes another function, so children look changed.",
        "Define the handler outside, or keep it with useCallback."),
    RuleSpec(
        "fe.list_no_virtualization", "frontend",
        lambda c: matches(c.s, fx.P_FE_MAP, ".map") & has(F.lower(c.near), "return"),
        "All elements are rendered at once, seen or not.",
        "Render the visible window of a long list only.",
        first_only=True),
]
