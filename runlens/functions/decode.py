"""Decoding of trace lines and of symbolic values, as columns wherever SQL can express them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import spelled_bytes
from .vocab import ARGV_AT, CLONE3_FLAGS, CLONE_FLAGS, OPERATIONS, SIGNALS, UNSHARE_FLAGS


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once: a lambda's variable isn't copied into every use as an expression is."""
    return F.transform(F.array(value), body)[0]


def framed(body: Column) -> Column:
    """A terminated line without its carriage return."""
    return F.regexp_replace(body, "\r$", "")


def line_parts(line: Column) -> Column:
    """Struct pid, body of one line; pid null where the first token isn't all digits."""
    ok = line.rlike(r"^\s*[0-9]+\s")
    return F.struct(F.when(ok, F.regexp_extract(line, r"^\s*([0-9]+)\s+", 1)).alias("pid"), F.when(ok, F.regexp_extract(line, r"^\s*[0-9]+\s+(.*)$", 1)).alias("body"))


def line_kind(body: Column) -> Column:
    """U unfinished, R resumed, X exit, S signal, C call, or null; an exit code above 255 is no exit."""
    return (
        F.when(body.endswith("<unfinished ...>"), "U")
        .when(body.startswith("<... "), "R")
        .when(body.startswith("--- "), "S")
        .when(is_exit_spelling(body), "X")
        .when(body.rlike(r"^[a-z0-9_]+\("), "C")
    )


def operation(body: Column) -> Column:
    """Name of the call, also of resumed halves."""
    return F.when(body.startswith("<... "), F.regexp_extract(body, r"^<\.\.\. ([a-z0-9_]+) resumed>", 1)).otherwise(F.regexp_extract(body, r"^([a-z0-9_]+)\(", 1))


def kind_of(operation_: Column) -> Column:
    pairs = [F.lit(x) for kind, names in OPERATIONS.items() for name in names for x in (name, kind)]
    return F.create_map(*pairs)[operation_]


def outcome(returned: Column) -> Column:
    """success for a leading integer >= 0, perhaps annotated; the errno after -1; else null."""
    value = F.regexp_extract(returned, r"^\s*(\S+)", 1)
    number_ = F.regexp_extract(value, r"^([+-]?[0-9]+)(<.*)?$", 1).try_cast("bigint")
    errno = F.regexp_extract(returned, r"^\s*-1\s+(E[A-Z0-9_]+)(\s|$)", 1)
    return F.when(number_ >= 0, "success").when(errno != "", errno)


def symbolic_bits(expression: Column, names: dict[str, int] = CLONE_FLAGS, numbers: bool = True) -> Column:
    """Value of terms joined by |: known names and, with ``numbers``, decimal or 0x numbers; null if a term is unknown."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]).cast("map<string,bigint>")

    def value(term: Column) -> Column:
        known = F.when(F.map_contains_key(table, term), table[term])
        return F.coalesce(known, number(term)) if numbers else known

    terms = F.transform(F.split(expression, r"\|"), lambda x: value(F.trim(x)))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


NAMESPACES = ["CLONE_NEWNS", "CLONE_NEWCGROUP", "CLONE_NEWUTS", "CLONE_NEWIPC", "CLONE_NEWUSER", "CLONE_NEWPID", "CLONE_NEWNET"]
_ALL = CLONE_FLAGS | CLONE3_FLAGS
SIGNAL_BYTE = 0xFF


def _has(bits: Column, *names: str, table: dict[str, int] = _ALL) -> Column:
    mask = 0
    for name in names:
        mask |= table[name]
    return bits.bitwiseAND(F.lit(mask)) != 0


def _outside(bits: Column, allowed: int) -> Column:
    return bits.bitwiseAND(F.lit(~allowed)) != 0


def _conflict(bits: Column, namespaces: Column) -> Column:
    """Flags that no kernel accepts together, whichever of the clone calls has them."""
    has = lambda *names: _has(bits, *names)
    return (
        (has("CLONE_SIGHAND") & ~has("CLONE_VM"))
        | (has("CLONE_THREAD") & ~has("CLONE_SIGHAND"))
        | (has("CLONE_FS") & namespaces)
        | (has("CLONE_NEWUSER") & has("CLONE_FS", "CLONE_THREAD", "CLONE_PARENT"))
        | (has("CLONE_NEWIPC") & has("CLONE_SYSVSEM"))
        | (has("CLONE_NEWPID") & has("CLONE_THREAD", "CLONE_PARENT"))
    )


def _copy_effect(bad: Column, namespaces: Column, bits: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), "Unknown").when(namespaces, "PrivateFsNamespaceUncertain").when(_has(bits, "CLONE_FS"), "SharedFs").otherwise("PrivateFs")


def spawn_effect(bits: Column) -> Column:
    """Effect of clone's flags, exit signal in the low byte, on the child's file-system context."""
    return bound(bits, _spawn_effect)


def _spawn_effect(bits: Column) -> Column:
    allowed = SIGNAL_BYTE
    for bit in CLONE_FLAGS.values():
        allowed |= bit
    namespaces = _has(bits, *NAMESPACES)
    bad = _outside(bits, allowed) | (bits.bitwiseAND(F.lit(SIGNAL_BYTE)) > 64) | _conflict(bits, namespaces)
    bad |= _has(bits, "CLONE_PIDFD") & _has(bits, "CLONE_DETACHED", "CLONE_PARENT_SETTID")
    return _copy_effect(bad, namespaces, bits)


def clone_effect(expression: Column) -> Column:
    """The same from clone's printed flags, at most one of them a signal."""
    terms = F.transform(F.split(expression, r"\|"), lambda x: F.struct(F.trim(x).alias("name"), signal_number(F.trim(x), 32).cast("bigint").alias("signal")))
    return spawn_effect(F.coalesce(number(expression), bound(terms, _clone_bits)))


def _clone_bits(terms: Column) -> Column:
    signals = F.filter(terms, lambda x: x["signal"].isNotNull())
    names = F.transform(F.filter(terms, lambda x: x["signal"].isNull()), lambda x: x["name"])
    named = F.when(F.size(names) > 0, symbolic_bits(F.array_join(names, "|"), CLONE_FLAGS | {"0": 0}, numbers=False)).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.size(signals) <= 1, named.bitwiseOR(F.coalesce(F.get(signals, F.lit(0))["signal"], F.lit(0).cast("bigint"))))


def clone3_effect(flags: Column, exit_signal: Column) -> Column:
    """Effect of clone3, whose exit signal is a field of its own."""
    names = {n: b for n, b in _ALL.items() if n != "CLONE_DETACHED"} | {"0": 0}
    bits = F.coalesce(number(flags), symbolic_bits(flags, names, numbers=False))
    signal = F.coalesce(number(exit_signal), signal_number(exit_signal, 32).cast("bigint"))
    return bound(F.struct(bits.alias("bits"), signal.alias("signal")), lambda x: _clone3_effect(x["bits"], x["signal"]))


def _clone3_effect(bits: Column, signal: Column) -> Column:
    allowed = 0
    for name, bit in _ALL.items():
        allowed |= bit if name != "CLONE_DETACHED" else 0
    namespaces = _has(bits, *NAMESPACES, "CLONE_NEWTIME", "CLONE_EMPTY_MNTNS")
    has = lambda *n: _has(bits, *n)
    alone = has("CLONE_THREAD", "CLONE_PARENT")
    bad = _outside(bits, allowed) | (signal > 64) | _conflict(bits, namespaces) | ((signal != 0) & alone)
    bad |= (has("CLONE_CLEAR_SIGHAND") & has("CLONE_SIGHAND")) | (has("CLONE_AUTOREAP") & (alone | (signal != 0))) | (has("CLONE_NNP") & has("CLONE_THREAD"))
    bad |= has("CLONE_PIDFD_AUTOKILL") & ~(has("CLONE_PIDFD") & has("CLONE_AUTOREAP"))
    return _copy_effect(bad, namespaces, bits)


def unshare_effect(expression: Column) -> Column:
    """Effect of unshare's flags on the caller's own context."""
    return bound(F.coalesce(number(expression), symbolic_bits(expression, UNSHARE_FLAGS | {"0": 0}, numbers=False)), _unshare_effect)


def _unshare_effect(bits: Column) -> Column:
    allowed = 0
    for bit in UNSHARE_FLAGS.values():
        allowed |= bit
    has = lambda *n: _has(bits, *n, table=UNSHARE_FLAGS)
    splits = has("CLONE_FS", "CLONE_NEWUSER", "CLONE_NEWNS", "UNSHARE_EMPTY_MNTNS")
    return (
        F.when(F.coalesce(_outside(bits, allowed), F.lit(True)), "Unknown")
        .when(has(*NAMESPACES, "CLONE_NEWTIME", "UNSHARE_EMPTY_MNTNS"), F.when(splits, "SplitFsNamespaceUncertain").otherwise("ConnectedFsNamespaceUncertain"))
        .when(has("CLONE_FS"), "SplitFs")
        .otherwise("NoFsChange")
    )


def number(text: Column) -> Column:
    """A decimal or 0x number, else null."""
    hexadecimal = F.conv(F.substring(text, 3, 16), 16, 10).try_cast("bigint")
    return F.when(text.rlike("^0x[0-9a-fA-F]{1,15}$"), hexadecimal).when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def field(args: Column, marker: str) -> Column:
    """The printed value behind ``marker`` in the first argument that has it, up to a comma or the closing brace."""
    holder = F.get(F.filter(args, lambda x: x.contains(marker) & (F.trim(F.regexp_extract(x, marker + "([^,}]*)", 1)) != "")), F.lit(0))
    return F.trim(F.regexp_extract(holder, marker + "([^,}]*)", 1))


def signal_number(name: Column, realtime_min: int = 34) -> Column:
    """Linux number of a signal name; SIGRT_n is 32+n, SIGRTMIN+n starts at ``realtime_min``."""
    table = F.create_map(*[F.lit(x) for k, v in SIGNALS.items() for x in (k, v)])
    direct = F.regexp_extract(name, r"^SIGRT_([0-9]+)$", 1).try_cast("int")
    above = F.regexp_extract(name, r"^SIGRTMIN\+([0-9]+)$", 1).try_cast("int")
    return F.coalesce(table[name], F.when(name == "SIGRTMIN", realtime_min).when(name == "SIGRTMAX", 64), F.when(direct <= 32, direct + 32), F.when(above <= 64 - realtime_min, above + realtime_min))


FRAME = r"^\+\+\+ (.*) \+\+\+$"


def is_exit_spelling(text: Column) -> Column:
    """Whether a saved exit text has one of the two framings, with a code up to 255."""
    code = F.regexp_extract(text, r"^\+\+\+ exited with ([0-9]+) \+\+\+$", 1).try_cast("int")
    return F.coalesce(code.between(0, 255), F.lit(False)) | F.coalesce(text.rlike(r"^\+\+\+ killed by [A-Za-z0-9_+\-() ]+ \+\+\+$"), F.lit(False))


def exit_fields(spelling: Column) -> Column:
    """Struct code, signal of an exit text, framed or not; both null for legal but unknown names."""
    text = F.regexp_replace(spelling, FRAME, "$1")
    code = F.regexp_extract(text, "^exited with ([0-9]+)$", 1).try_cast("int")
    name = F.regexp_extract(F.regexp_replace(text, r" \(core dumped\)$", ""), "^killed by (.+)$", 1)
    return F.struct(F.when(code <= 255, code).alias("code"), signal_number(name).alias("signal"))


#: A type object, so that importing this module needs no session.
_STRINGS = T.ArrayType(T.StringType())
_PARTS = T.StructType([T.StructField("args", _STRINGS), T.StructField("returned", T.StringType()), T.StructField("argv", _STRINGS)])
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|["()\[\]{}<>,]', re.S)


def split_arguments(text: str) -> list[str]:
    """Arguments between commas that stand outside quotes and brackets."""
    out, depth, start = [], 0, 0
    for mark in _MARKS.finditer(text):
        c = mark[0]
        if c == '"':  # a quote that never ends
            break
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start : mark.start()].strip())
            start = mark.end()
    return [*out, text[start:].strip()]


def split_call(text: str | None) -> tuple:
    """(arguments, return value, words of the printed argv) of one call; nulls if it isn't whole.

    Only quotes, brackets and commas are looked at; the parenthesis that closes the call is
    found by counting parentheses outside quotes.
    """
    name, _, rest = (text or "").partition("(")
    depth = 1
    for mark in _MARKS.finditer(rest):
        if mark[0] == '"':
            break
        depth += (mark[0] == "(") - (mark[0] == ")")
        if not depth:
            tail = rest[mark.end() :].lstrip()
            if not tail.startswith("="):
                break
            args = split_arguments(rest[: mark.start()])
            at = ARGV_AT.get(name)
            list_ = args[at] if at is not None and at < len(args) else ""
            inner = list_[1:-1] if len(list_) > 1 and list_[0] == "[" and list_[-1] == "]" else None
            return args, tail[1:].lstrip(), None if inner is None else split_arguments(inner) if inner else []
    return None, None, None


@F.pandas_udf(_PARTS)
def call_parts(body: pd.Series) -> pd.DataFrame:
    """:func:`split_call` of each row: quotes and brackets nest, so no column expression splits them."""
    return pd.DataFrame([split_call(t) for t in body], columns=["args", "returned", "argv"])


def unquoted(argument: Column) -> Column:
    """The bytes of a quoted argument of ASCII characters and \\xNN escapes, else null."""
    whole = argument.rlike(r'(?s)^"(?:[\x00-\x21\x23-\x5b\x5d-\x7f]|\\x[0-9a-fA-F]{2})*"$')
    pieces = F.regexp_extract_all(F.substr(argument, F.lit(2), F.length(argument) - 2), F.lit(r"(?s)\\x..|[^\\]+"), F.lit(0))
    hexed = F.transform(pieces, lambda x: F.when(x.startswith("\\x"), F.substring(x, 3, 2)).otherwise(F.hex(F.encode(x, "UTF-8"))))
    return F.when(whole, F.unhex(F.array_join(hexed, "")))


def annotation(encoded: Column) -> Column:
    """The bytes of a note between angle brackets that is spelled in \\xNN throughout, else null."""
    return F.when(encoded.rlike(r"^(\\x[0-9a-fA-F]{2})*$"), F.unhex(F.replace(encoded, F.lit("\\x"), F.lit(""))))


def _absolute(content: Column) -> Column:
    return F.substring(F.hex(content), 1, 2) == "2F"


def annotated_path(value: Column) -> Column:
    """The absolute path noted at a descriptor, like 3<...>, else null."""
    noted = annotation(F.regexp_extract(value, r"(?s)^[^<]*<(.+)>$", 1))
    return F.when(_absolute(noted), spelled_bytes(noted))


def resolved_path(args: Column, at: Column | bool = True) -> Column:
    """Spelled path of a call: the absolute operand, the noted directory and the operand, or an explicit relative spelling."""
    at = F.lit(at) if isinstance(at, bool) else at
    given = F.struct(unquoted(F.get(args, F.when(at, 1).otherwise(0))).alias("operand"), F.get(args, F.lit(0)).alias("directory"), at.alias("at"))
    return bound(given, lambda x: F.when(x["operand"].isNotNull(), _resolved(x["operand"], x["directory"], x["at"])))


def _resolved(operand: Column, directory: Column, at: Column) -> Column:
    relative = lambda why: F.concat(F.lit("relative:"), spelled_bytes(operand), F.lit(" ["), why, F.lit("]"))
    encoded = F.regexp_extract(directory, r"(?s)^[^<]*<(.*)>$", 1)

    def beside(base: Column) -> Column:
        slash = F.when(F.hex(base).endswith("2F"), F.lit("")).otherwise(F.lit("/"))
        return F.when(_absolute(base) & (F.octet_length(operand) > 0), F.concat(spelled_bytes(base), slash, spelled_bytes(operand)))

    noted = F.when(~directory.endswith(">"), relative(F.lit("dirfd annotation incomplete"))).otherwise(F.coalesce(bound(annotation(encoded), beside), relative(F.concat(F.lit("dirfd:"), encoded))))
    return (
        F.when(_absolute(operand), spelled_bytes(operand))
        .when(at & directory.contains("<"), noted)
        .when(at & (directory != "AT_FDCWD"), relative(F.lit("dirfd unresolved")))
        .otherwise(relative(F.lit("cwd unresolved")))
    )


def abbreviated(body: Column) -> Column:
    """Whether three dots stand outside quotes: the tracer left something out."""
    return F.regexp_replace(body, r'(?s)"(?:[^"\\]|\\.)*("|$)', "").contains("...")
