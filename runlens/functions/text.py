"""Quoted spellings of strings and lists in reports, and the reversible spelling of bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with an escape of their own in a quoted string.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("\0", "\\0")]


def quoted(text: Column) -> Column:
    """``text`` in double quotes with control characters escaped; other controls as \\u{hex}."""
    named = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)
    # Only the controls that occur in a text are replaced, each everywhere.
    found = F.array_distinct(F.regexp_extract_all(named, F.lit(r"[\x01-\x1f\x7f-\x9f]"), F.lit(0)))
    code = lambda c: F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))
    rest = F.aggregate(found, named, lambda out, c: F.replace(out, c, code(c)))
    return F.concat(F.lit('"'), rest, F.lit('"'))


def quoted_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def optional(value: Column) -> Column:
    """A number that may be missing: Some(n) or None."""
    return F.when(value.isNull(), "None").otherwise(F.concat(F.lit("Some("), value.cast("string"), F.lit(")")))


def spelled_bytes(content: Column) -> Column:
    """Bytes as printable ASCII without the backslash, all others as \\xNN in lower case."""
    pairs = F.regexp_extract_all(F.hex(content), F.lit("(..)"), F.lit(1))
    plain = lambda h: F.decode(F.unhex(h), "US-ASCII")
    printable = lambda h: (h >= "20") & (h < "7F") & (h != "5C")
    return F.array_join(F.transform(pairs, lambda h: F.when(printable(h), plain(h)).otherwise(F.concat(F.lit("\\x"), F.lower(h)))), "")


def raw_flags(call: Column) -> Column:
    """Names of open flags in the text of a raw call, each once, in byte order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(call, F.lit(r"\b(O_[A-Z0-9_]+)\b"), F.lit(1))))


def unescaped(text: Column) -> Column:
    """\\xNN runs as the text they spell; bytes that are no UTF-8 keep their escape."""
    runs = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:\\x[0-9a-fA-F]{2})+)"), F.lit(1))), lambda a, b: F.length(b) - F.length(a))

    def plain(run: Column) -> Column:
        content = F.unhex(F.replace(run, F.lit("\\x"), F.lit("")))
        return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(spelled_bytes(content))

    return F.aggregate(runs, text, lambda out, run: F.replace(out, run, plain(run)))


def redacted(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Unescaped text with private prefixes replaced, in order."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), replacements, unescaped(text))
