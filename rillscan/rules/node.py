from .. import fixed as fx
from ..functions.text import has, matches
from .spec import RuleSpec

_FRAMEWORK = ("//",)

RULES = [
    RuleSpec(
        "node.sync_fs", "node", lambda c: matches(c.s, fx.P_NODE_SYNC_FS, "Sync"),
        "One thread serves all requests, and the call stops it.",
        "Await the asynchronous call."),
    RuleSpec(
        "node.sync_crypto", "node", lambda c: matches(c.s, fx.P_NODE_SYNC_CRYPTO, "Sync"),
        "Hashing on the event loop stops the server for its duration.",
        "Await the asynchronous call."),
    RuleSpec(
        "node.await_in_loop", "node",
        lambda c: ~c.s.startswith("for ") & ~has(c.s, "Promise.all")
        & matches(c.s, fx.P_NODE_AWAIT, "await"),
        "The calls run one after the other and their latencies add up.",
        "Start them together and await Promise.all, or send one query.",
        min_depth=1),
    RuleSpec(
        "node.json_parse_sync", "node",
        lambda c: has(c.s, "JSON.parse(")
        & (has(c.s, "readFileSync") | (~has(c.s, "await") & has(c.s, ".read("))),
        "A large document is parsed in one go on the event loop.",
        "Parse it as a stream, or fetch it in pages."),
    RuleSpec(
        "next.fetch_no_cache", "node",
        lambda c: c.fact("server_code") & ~has(c.s, *fx.NEXT_POLICY_WORDS)
        & matches(c.s, fx.P_NEXT_FETCH, "fetch"),
        "The origin is asked on every render.",
        "Give the fetch a cache policy or a revalidation time.",
        step=2, first_only=True, skips=_FRAMEWORK),
    RuleSpec(
        "ng.ngfor_no_trackby", "node",
        lambda c: c.fact("angular_template") & has(c.s, "*ngFor") & ~has(c.s, "trackBy"),
        "The whole list is rebuilt when one of its items changes.",
        "Give trackBy a function that returns a stable id.",
        step=3, first_only=True, skips=()),
    RuleSpec(
        "ng.method_in_template", "node",
        lambda c: c.fact("angular_template") & matches(c.s, fx.P_NG_METHOD, "{{"),
        "The method runs again on every change detection.",
        "Keep the value in a field, or use a pure pipe.",
        step=4, first_only=True, skips=()),
]
