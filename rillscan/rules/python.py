from pyspark.sql import functions as F

from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec


def _reads_all(c):
    opened_here = F.right(F.substring_index(c.s, ".read", 1), F.lit(fx.PY_OPEN_LOOKBACK))
    return matches(c.s, fx.P_PY_READ, ".read()") & ~has(opened_here, "open(")


RULES = [
    RuleSpec(
        "py.nested_loop", "python", lambda c: has(c.s, "==", " in "),
        "Comparing inside two loops takes time in the product of their lengths.",
        "Put one side into a dict or set and walk the other once.",
        min_depth=2),
    RuleSpec(
        "py.string_concat_loop", "python",
        lambda c: has(c.s, "str(", '"', "'") & matches(c.s, fx.P_APPEND, "+="),
        "The text is copied again each time a piece is added.",
        "Gather the pieces and join them once.",
        min_depth=1),
    RuleSpec(
        "py.read_whole_file", "python", _reads_all,
        "The whole file has to fit in memory.",
        "Read it by lines or blocks."),
    RuleSpec(
        "py.sync_io_in_async", "python",
        lambda c: matches(c.s, fx.P_PY_REQUESTS, "requests.") | matches(c.s, fx.P_PY_SLEEP, "time.sleep"),
        "A blocking call stops the event loop for everyone.",
        "Await an asynchronous client or asyncio.sleep.",
        in_async=True),
    RuleSpec(
        "py.connection_per_iter", "python", lambda c: matches(c.s, fx.P_PY_CONNECT, ".connect"),
        "Each pass pays for a new connection.",
        "Connect once before the loop, or use a pool, and send batches.",
        min_depth=1),
]
