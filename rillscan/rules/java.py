from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec


def _appends_text(c):
    return matches(c.s, fx.P_APPEND, "+=") & (has(c.s, '"', "String", "report") | has(c.low, "sql"))


def _allocates(c):
    fresh = matches(c.s, fx.P_JAVA_NEW_ARRAY, "[") | matches(c.s, fx.P_JAVA_NEW_COLLECTION)
    return ~has(c.s, "Thread") & matches(c.s, fx.P_NEW, "new") & fresh


def _starts_thread(c):
    return has(c.s, "new Thread(", "new Thread (")


def _first(rule_id, step, pattern, word, why, fix, fact=None):
    """First line of the file that matches, comment lines included."""
    def when(c):
        hit = matches(c.raw, pattern, word)
        return c.fact(fact) & hit if fact else hit

    return RuleSpec(rule_id, "java", when, why, fix, step=step, first_only=True, skips=())


RULES = [
    RuleSpec(
        "java.n_plus_one", "java",
        lambda c: matches(c.s, fx.P_JAVA_QUERY, "execute", "Statement")
        | (has(c.s, "Repository") & matches(c.s, fx.P_JAVA_REPO_CALL)),
        "Each pass of the loop asks the database again, so the cost follows the number of items.",
        "Ask once for all items, by a join, an IN list or a batch fetch.",
        min_depth=1),
    RuleSpec(
        "java.string_concat_loop", "java", _appends_text,
        "Every += builds a whole new string, which turns the loop quadratic.",
        "Append to one StringBuilder made before the loop.",
        min_depth=1),
    RuleSpec(
        "java.alloc_in_loop", "java", _allocates,
        "The loop makes a new object on every pass and leaves it to the collector.",
        "Make it once before the loop and clear it, or give the collection its size.",
        min_depth=1),
    RuleSpec(
        "java.autoboxing_loop", "java", lambda c: matches(c.s, fx.P_JAVA_BOXED, "="),
        "A wrapper object is created for every value the loop handles.",
        "Keep primitives: arrays or primitive streams.",
        min_depth=1),
    RuleSpec(
        "java.thread_per_item", "java", _starts_thread,
        "A thread for every item costs memory and switching, and nothing limits their number.",
        "Hand the work to a shared executor with a bound.",
        min_depth=1, title=fx.THREAD_IN_LOOP_TITLE, severity=fx.THREAD_IN_LOOP_SEVERITY),
    RuleSpec(
        "java.thread_per_item", "java", _starts_thread,
        "A thread started by hand escapes every pool and its limits.",
        "Hand the work to a shared executor with a bound.",
        max_depth=0),
    RuleSpec(
        "java.regex_compile_loop", "java", lambda c: matches(c.s, fx.P_JAVA_REGEX, "Pattern"),
        "The same expression is compiled again on every pass.",
        "Keep the compiled pattern in a constant.",
        min_depth=1),
    RuleSpec(
        "java.sleep_in_sync", "java", lambda c: has(c.s, "Thread.sleep"),
        "The sleeper keeps the monitor, so all who need it sleep too.",
        "Wait outside the guarded block.",
        in_sync=True),
    RuleSpec(
        "java.busy_wait", "java",
        lambda c: has(c.s, "isDone()", "Thread.yield") & matches(c.s, fx.P_JAVA_SPIN),
        "The loop burns a core while it waits.",
        "Block on the result: a future, a latch or a callback."),
    RuleSpec(
        "java.select_star", "java", lambda c: has(c.low, "select *"),
        "All columns are read and sent although few are used.",
        "Name the columns."),
    _first("java.connection_per_request", 2, fx.P_JAVA_CONNECTION, "DriverManager",
           "Each call pays for a new connection, and the server runs out of them under load.",
           "Take connections from a pool."),
    _first("java.unbounded_pool", 3, fx.P_JAVA_POOL, "newCachedThreadPool",
           "The pool grows with every burst until memory ends.",
           "Use a pool and a queue with a bound."),
    RuleSpec(
        "java.dcl_no_volatile", "java",
        lambda c: c.fact("unsafe_singleton") & matches(c.raw, fx.P_JAVA_GET_INSTANCE, "getInstance"),
        "Without volatile another thread may see the object before it is complete.",
        "Declare the field volatile, or let a holder class or an enum create it.",
        step=4, first_only=True, skips=()),
    RuleSpec(
        "java.dcl_no_volatile", "java",
        lambda c: c.fact("unsafe_singleton") & c.fact("first_line"),
        "Without volatile another thread may see the object before it is complete.",
        "Declare the field volatile, or let a holder class or an enum create it.",
        step=4, first_only=True, fallback=True, code=fx.DCL_FALLBACK_CODE, skips=()),
    _first("java.finalizer", 5, fx.P_JAVA_FINALIZE, "finalize",
           "Finalizers delay the release of memory by several collections.",
           "Close resources explicitly, or register a Cleaner."),
    _first("java.synchronized_method", 6, fx.P_JAVA_SYNC_METHOD, "synchronized",
           "All callers queue for the whole method, slow parts included.",
           "Guard only the lines that share state."),
    _first("java.exception_flow_control", 7, fx.P_JAVA_PARSE_INT, "parseInt",
           "An exception per bad value costs a stack trace each time.",
           "Test the text before parsing it.",
           fact="catches_bad_numbers"),
    _first("java.eager_fetch", 8, fx.P_JAVA_EAGER, "EAGER",
           "The association is loaded with every query of its owner, wanted or not.",
           "Load lazily, and fetch it where it is needed."),
    _first("java.collection_mapping", 9, fx.P_JAVA_TO_MANY, "ToMany",
           "Walking a mapped collection easily becomes one query per element.",
           "Fetch it in the query or in batches, and page large ones.",
           fact="no_lazy_fetch"),
]
