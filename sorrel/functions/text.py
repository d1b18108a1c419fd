"""Scalar functions on names, paths and hover text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The symbol kinds of the language server protocol, numbered from 1 in this order.
SYMBOL_KINDS = [
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable",
    "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter",
]
# The words that name a construct, and those that may stand before one, in hover text.
CONSTRUCTS = ["type", "interface", "class", "function", "const", "let", "var", "enum", "namespace", "module"]
MODIFIERS = ["export", "declare", "default", "public", "private", "protected", "readonly", "abstract", "async", "static"]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def leaf(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def container_prefix(fqn: Column) -> Column:
    """All before the last dot; empty without one."""
    return F.regexp_extract(fqn, r"^(?s)(.*)\.", 1)


def path_to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def uri_to_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def module_path(uri: Column, root_uri: str) -> Column:
    """Dotted module name of a file: root and extension cut off, one leading slash dropped, separators to dots."""
    root = F.lit(root_uri)
    under = F.when(uri.startswith(root), F.substring(uri, F.length(root) + 1, F.length(uri))).otherwise(uri)
    stem = F.regexp_replace(under, r"(?s)\.[^.]*$", "")
    return F.translate(F.regexp_replace(stem, r"^/", ""), "/\\", "..")


def trimmed(c: Column) -> Column:
    """White space of any kind cut from both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def symbol_kind(kind: Column) -> Column:
    """Label of a symbol kind, ``Unknown(n)`` outside the protocol's range; null stays null."""
    label = F.get(F.array(*[F.lit(k) for k in SYMBOL_KINDS]), (kind - 1).cast("int"))
    known = kind.between(1, len(SYMBOL_KINDS))
    return F.when(known, label).when(kind.isNotNull(), F.format_string("Unknown(%d)", kind))


def kind_label(node_kind: Column, construct: Column) -> Column:
    """A variable that hover calls a type is a type alias."""
    return F.when((node_kind == "Variable") & construct.eqNullSafe("type"), F.lit("TypeAlias")).otherwise(node_kind)


def construct_from_hover(text: Column) -> Column:
    """The construct keyword that a hover text begins with, behind modifiers; null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: (x != "") & ~x.startswith("```"))
    words = F.filter(F.split(F.get(lines, F.lit(0)), r"\s+"), lambda w: ~w.isin(*MODIFIERS))
    first = F.get(words, F.lit(0))
    return F.when(first.isin(*CONSTRUCTS), first)


def shown_number(c: Column) -> Column:
    """Saturates to the range of an unsigned 32-bit number."""
    return F.greatest(F.lit(0).cast("long"), F.least(c.cast("long"), F.lit(4294967295)))


def epoch_seconds(at: Column) -> Column:
    """Whole seconds from the start of 1970 in UTC to a time stamp."""
    return F.unix_timestamp(at)


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def signature_fingerprint(name: Column, kind: Column, detail: Column, *bounds: Column) -> Column:
    """Hash of name, kind, detail and absolute bounds: a moved declaration has another."""
    parts = [name, kind.cast("string"), F.coalesce(detail, F.lit("\u0002")), *[b.cast("string") for b in bounds]]
    return F.substring(F.md5(F.concat_ws("\u0001", *parts).cast("binary")), 1, 16)


def line_slice(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Lines ``[start, end)`` joined by line feeds, and the number of lines; a final line end begins no line."""
    parts = F.split(text, r"\r?\n")
    lines = F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    total = F.size(lines).cast("long")
    first = F.least(F.greatest(start.cast("long"), F.lit(0).cast("long")), total)
    last = F.greatest(first, F.least(end.cast("long"), total))
    return F.array_join(F.slice(lines, (first + 1).cast("int"), (last - first).cast("int")), "\n"), total


def matches(fqn: Column, pattern: str, mode: str = "segment", ignore_case: bool = False) -> Column:
    """Whether a name fits a pattern: ``segment``, ``contains``, ``exact`` or ``fuzzy`` (similarity of a segment of 0.7 or more)."""
    name, want = (ascii_lower(fqn), pattern.translate(str.maketrans(UPPER, LOWER))) if ignore_case else (fqn, pattern)
    if mode == "segment":
        return F.array_contains(F.split(name, r"\."), want)
    if mode == "contains":
        return name.contains(want)
    if mode == "exact":
        return name == want
    if mode == "fuzzy":
        wanted = F.lit(want)
        longest = lambda s: F.greatest(F.char_length(s), F.char_length(wanted), F.lit(1))
        return F.exists(F.split(name, r"\."), lambda s: 1 - F.levenshtein(s, wanted) / longest(s) >= 0.7)
    raise ValueError(f"match mode: {mode}")
