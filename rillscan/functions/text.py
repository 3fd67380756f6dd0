"""Column functions on text.  All of them stay inside the JVM."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

# Regex classes follow Unicode, and the dot stops at "\n" only.
UNICODE = "(?Ud)"
_BLANK = r"[\s\x1c-\x1f]"


def matches(col: Column, pattern: str, *words: str) -> Column:
    """True when the pattern is found.

    ``words`` are literal texts of which any match holds at least one.  Looking for a word is
    far cheaper than running a pattern, and few lines pass.
    """
    found = col.rlike(UNICODE + pattern)
    return has(col, *words) & found if words else found


def has(col: Column, *words: str) -> Column:
    """True when the text holds any of the words."""
    return reduce(or_, [col.contains(w) for w in words])


def starts(col: Column, *prefixes: str) -> Column:
    return reduce(or_, [col.startswith(p) for p in prefixes])


def strip(col: Column) -> Column:
    """Trim every kind of Unicode blank, not only U+0020."""
    return F.btrim(col, F.lit(fixed.BLANKS))


def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, f"{UNICODE}{_BLANK}+", " ")


def evaluated(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A plain projection may be merged into each filter and projection above it, and a costly
    expression is then repeated at every mention.  A generator is not merged.
    """
    row = F.struct(*[col.alias(name) for name, col in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def unix_newlines(col: Column) -> Column:
    return F.when(col.contains("\r"), F.regexp_replace(col, "\r\n?", "\n")).otherwise(col)


def split_lines(content: Column) -> Column:
    return F.split(unix_newlines(content), "\n", -1)


def indent_width(raw: Column) -> Column:
    """Number of leading spaces; tabs count as nothing."""
    return F.length(raw) - F.length(F.ltrim(raw))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot does not start one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def without_comments(content: Column) -> Column:
    blocks = F.regexp_replace(content, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(blocks, r"//[^\n]*", "")


def fingerprint(rule_id: Column, file: Column, code: Column) -> Column:
    """Identity of a finding across runs: no line number, blanks squeezed."""
    code = squeeze(strip(F.coalesce(code, F.lit(""))))
    return F.left(F.sha1(F.concat_ws("|", rule_id, file, code).cast("binary")), F.lit(16))


def tokens(text: Column) -> Column:
    """Words of a text, as written: fold their case after they are taken apart."""
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))
