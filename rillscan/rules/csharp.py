from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec

_SECOND_PASS = ("//",)

RULES = [
    RuleSpec(
        "cs.ef_n_plus_one", "csharp",
        lambda c: has(c.s, *fx.CS_CONTEXT_WORDS) & matches(c.s, fx.P_CS_QUERY),
        "The query runs once for every item of the loop.",
        "Load all items by one query, with Include where needed, and join in memory.",
        min_depth=1),
    RuleSpec(
        "cs.linq_materialize_in_loop", "csharp",
        lambda c: has(c.s, ".Where(", ".Select(") & matches(c.s, fx.P_CS_MATERIALIZE),
        "The chain is run from its source on every pass.",
        "Run it once before the loop and look the results up.",
        min_depth=1),
    RuleSpec(
        "cs.sync_over_async", "csharp",
        lambda c: ~has(c.s, "async") & matches(c.s, fx.P_CS_BLOCKING, ".Result", ".Wait", ".GetAwaiter"),
        "A pool thread waits for a task and may wait for itself.",
        "Await the task, and make the callers asynchronous."),
    RuleSpec(
        "cs.string_concat_loop", "csharp",
        lambda c: matches(c.s, fx.P_APPEND, "+=") & (has(c.s, '"') | has(c.low, "string", "sql")),
        "Every += builds a whole new string, which turns the loop quadratic.",
        "Append to one StringBuilder made before the loop.",
        min_depth=1),
    RuleSpec(
        "cs.regex_in_loop", "csharp", lambda c: matches(c.s, fx.P_CS_REGEX, "Regex"),
        "The same expression is parsed again on every pass.",
        "Keep the compiled expression in a static field.",
        min_depth=1),
    RuleSpec(
        "cs.alloc_in_loop", "csharp",
        lambda c: matches(c.s, fx.P_NEW, "new") & matches(c.s, fx.P_CS_NEW_COLLECTION),
        "The loop makes a new collection on every pass.",
        "Make it once before the loop and clear it, or give it its size.",
        min_depth=1),
    RuleSpec(
        "cs.count_instead_of_any", "csharp", lambda c: matches(c.s, fx.P_CS_COUNT, ".Count"),
        "Counting walks the whole sequence to answer yes or no.",
        "Ask Any(), which stops at the first element."),
    RuleSpec(
        "cs.select_star", "csharp",
        lambda c: has(c.s, '"') & matches(c.s, fx.P_CS_SELECT_STAR),
        "All columns are read and sent although few are used.",
        "Name the columns, or project in the query.",
        step=2, skips=_SECOND_PASS),
    RuleSpec(
        "cs.lazy_loading_proxies", "csharp", lambda c: has(c.s, "UseLazyLoadingProxies"),
        "Reading a navigation property silently sends a query.",
        "Load related data explicitly.",
        step=2, skips=_SECOND_PASS),
]
