"""Criteria as trees, and their two text formats.

Parsing happens on the driver: criteria files are small. A tree compiles to one boolean Column (see
operators.predicates), so Catalyst sees a plain filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from recordloom.errors import ParseError
from recordloom.functions.codec import unescaped

# The predicates, those without a value, and the deepest nesting of blocks.
PRESENCE = ("has", "nohas")
TEXT = ("eq", "ne", "lt", "le", "gt", "ge", "pre", "suf", "sub")
NUMERIC = ("neq", "nne", "nlt", "nle", "ngt", "nge")
OPERATORS = (*PRESENCE, *TEXT, *NUMERIC)
MAX_DEPTH = 4


@dataclass(frozen=True)
class Leaf:
    """A predicate on a key; of lookup files also `token`, `pair` and `absent_pair`."""

    op: str
    key: str
    value: str | None = None


@dataclass(frozen=True)
class Group:
    """A conjunction (`and`) or disjunction (`or`)."""

    op: str
    parts: tuple[Leaf | Group, ...] = field(default=())


Tree = Leaf | Group


def mode_of(line: str) -> str | None:
    return {"# mode\tunion": "or", "# mode\tintersect": "and"}.get(line)


def lines_of(text: str) -> list[tuple[int, str]]:
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return [(i, s.rstrip("\r")) for i, s in enumerate(lines, 1)]


def plain(text: str, line: int, what: str) -> str:
    out = unescaped(text)
    if out is None:
        raise ParseError(line, f"bad escape in {what}: {text!r}")
    return out


def with_mode(lines: list[tuple[int, str]]) -> tuple[str, list[tuple[int, str]]]:
    """The mode that the first line that isn't blank declares (default: all must hold), and the other criteria lines."""
    filled = [x for x in lines if x[1]]
    mode = mode_of(filled[0][1]) if filled else None
    return mode or "and", [x for x in (filled[1:] if mode else filled) if not x[1].startswith("#")]


def leaf(line: str, number: int) -> Leaf:
    op, *rest = line.split("\t", 2)
    if op not in OPERATORS:
        raise ParseError(number, f"unknown predicate {op!r}")
    if not rest:
        raise ParseError(number, f"{op} needs a key")
    key = plain(rest[0], number, "key")
    if op in PRESENCE:
        if len(rest) > 1:
            raise ParseError(number, f"{op} takes only a key")
        return Leaf(op, key)
    if len(rest) < 2:
        raise ParseError(number, f"{op} needs a value")
    value = plain(rest[1], number, "value")
    if len(value) >= 2 and value[0] + value[-1] in ("[]", "{}"):
        raise ParseError(number, f"array and object values aren't allowed: {value!r}")
    return Leaf(op, key, value)


def parse_filter(text: str) -> Tree:
    """Tree of a filter file: predicates and nested and/or ... end blocks. No criteria match everything."""
    mode, lines = with_mode(lines_of(text))
    stack: list[tuple[str, int, list[Tree]]] = [(mode, 0, [])]
    for number, line in lines:
        if line in ("and", "or"):
            if len(stack) > MAX_DEPTH:
                raise ParseError(number, f"blocks nest deeper than {MAX_DEPTH}")
            stack.append((line, number, []))
        elif line == "end" and len(stack) > 1:
            op, _, parts = stack.pop()
            stack[-1][2].append(Group(op, tuple(parts)))
        else:
            stack[-1][2].append(leaf(line, number))
    if len(stack) > 1:
        raise ParseError(stack[-1][1], f"block {stack[-1][0]!r} has no end")
    return Group(mode, tuple(stack[0][2])) if stack[0][2] else Group("and")


def parse_lookup(text: str) -> Tree:
    """Tree of a lookup file: tokens, key-value pairs, @present and @absent. No criteria match nothing."""
    mode, lines = with_mode(lines_of(text))
    parts: list[Tree] = []
    for number, line in lines:
        head, *rest = line.split("\t")
        if line.startswith("@"):
            if head == "@present" and len(rest) == 1:
                parts.append(Leaf("has", plain(rest[0], number, "key")))
            elif head == "@absent" and len(rest) == 1:
                parts.append(Leaf("nohas", plain(rest[0], number, "key")))
            elif head == "@absent" and len(rest) == 2:
                parts.append(Leaf("absent_pair", plain(rest[0], number, "key"), plain(rest[1], number, "value")))
            else:
                raise ParseError(number, f"unknown directive or wrong number of columns: {line!r}")
        elif rest:
            parts.append(Leaf("pair", head, "\t".join(rest)))
        else:
            parts.append(Leaf("token", line))
    return Group(mode, tuple(parts)) if parts else Group("or")


def leaves(tree: Tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for part in tree.parts for x in leaves(part)]
