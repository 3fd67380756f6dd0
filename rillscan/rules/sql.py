from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec

RULES = [
    RuleSpec(
        "sql.select_star", "sql", lambda c: matches(c.low, fx.P_SQL_SELECT_STAR, "*"),
        "All columns are read, and no covering index can answer the query.",
        "Name the columns."),
    RuleSpec(
        "sql.leading_wildcard", "sql", lambda c: matches(c.low, fx.P_SQL_WILDCARD, "'%"),
        "A pattern that starts open cannot use an index.",
        "Fix the start of the pattern, or use a text index."),
    RuleSpec(
        "sql.function_on_column", "sql",
        lambda c: matches(c.low, fx.P_SQL_WHERE_FUNCTION, "where")
        | matches(c.low, fx.P_SQL_FUNCTION_EQUALS, "="),
        "The index on the column does not know the result of the function.",
        "Compare the bare column, by a range for instance, or index the expression."),
    RuleSpec(
        "sql.cartesian_join", "sql",
        lambda c: matches(c.low, fx.P_SQL_COMMA_JOIN, ",") & ~has(c.low, " join "),
        "Tables listed with commas multiply their rows when a condition is missing.",
        "Write JOIN ... ON with the keys."),
    RuleSpec(
        "sql.correlated_subquery", "sql", lambda c: matches(c.low, fx.P_SQL_SUBQUERY, "select"),
        "The inner query may run once for every outer row.",
        "Join with the inner query, aggregated once."),
]
