from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec

RULES = [
    RuleSpec(
        "c.alloc_in_loop", "c", lambda c: matches(c.s, fx.P_C_ALLOC, "alloc"),
        "Each pass calls the allocator, and a missed free leaks on each pass.",
        "Allocate before the loop and reuse the block.",
        min_depth=1),
    RuleSpec(
        "c.strlen_in_condition", "c",
        lambda c: matches(c.s, fx.P_C_STRLEN, "strlen") & matches(c.s, fx.P_C_LOOP_WORD),
        "The string is measured from its start on every pass.",
        "Measure it once before the loop."),
    RuleSpec(
        "c.strcat_in_loop", "c", lambda c: matches(c.s, fx.P_C_STRCAT, "strc", "sprintf"),
        "Each call looks for the end of the string again.",
        "Keep a pointer to the end, and use the bounded functions.",
        min_depth=1),
    RuleSpec(
        "c.io_in_loop", "c", lambda c: matches(c.s, fx.P_C_IO, "open", "read", "write", "print", "scan"),
        "A system call per pass costs more than the work it does.",
        "Open the file once and move larger blocks.",
        min_depth=1),
    RuleSpec(
        "c.nested_loop", "c", lambda c: has(c.s, "==", "strcmp"),
        "Comparing inside two loops takes time in the product of their lengths.",
        "Sort and merge, or look up in a hash table.",
        min_depth=2),
    RuleSpec(
        "c.process_spawn_in_loop", "c", lambda c: matches(c.s, fx.P_C_SPAWN, "system", "popen"),
        "A process is started on every pass.",
        "Call a library, or start one process and feed it.",
        min_depth=1),
]
