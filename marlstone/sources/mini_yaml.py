"""The YAML subset of content files, and front matter.

A lexer turns lines into marks: an indentation and either the start of a list item, a key
with the text after its colon, or bare text. A stack holds the nodes that are still open; a
mark closes all nodes that lie as deep as itself or deeper, and opens its own. What a node
is worth is settled when it closes: its items, else its fields, else its text.

Blank lines and lines that begin with # don't count. A key ends at the first colon. Values
are numbers, booleans, null and inline lists, whose elements are text and which may run over
several lines; anything else, dates and quotes included, stays text. A key without a value
is there but holds nothing (ABSENT). Items at the indentation of their key belong to the
map that the key is in and take its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

STEP = 2
WORDS = {"true": True, "false": False, "null": None}
LARGEST_EXACT = 2**53


class _Absent:
    """What a key without a value has: it is there, but holds nothing."""

    def __repr__(self) -> str:
        return "ABSENT"


ABSENT = _Absent()


class Mark(NamedTuple):
    indent: int
    item: bool
    key: str | None
    text: str


@dataclass
class Node:
    """depth: lines indented by less close it. slot: where its parent keeps it."""

    depth: int
    slot: str | None = None
    text: str = ""
    fields: dict[str, Any] = field(default_factory=dict)
    items: list[Any] = field(default_factory=list)

    def settled(self) -> Any:
        return self.items or self.fields or scalar(self.text)

    def take(self, child: Node) -> None:
        if child.slot is None:
            self.items.append(child.settled())
        else:
            self.fields[child.slot] = child.settled()


def inline_list(text: str) -> list[str]:
    bare = (part.strip(" \t\r\n'\"") for part in text.strip()[1:-1].split(","))
    return [part for part in bare if part]


def scalar(text: str) -> Any:
    if text in WORDS:
        return WORDS[text]
    if not text:
        return ABSENT
    if len(text) > 1 and text.startswith("[") and text.endswith("]"):
        return inline_list(text)
    whole, point, fraction = text.removeprefix("-").partition(".")
    digits = [whole, fraction] if point else [whole]
    if not all(d.isascii() and d.isdigit() for d in digits):
        return text
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < LARGEST_EXACT else value


def _marks(text: str) -> Iterator[Mark]:
    lines = iter(text.replace("\r\n", "\n").split("\n"))

    def closed(start: str) -> str:
        """An inline list from where it begins to the line that ends it."""
        parts = [start]
        while not parts[-1].endswith("]") and (line := next(lines, None)) is not None:
            parts.append(line.strip())
        return " ".join(p for p in parts if p)

    for line in lines:
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        item = body.startswith("- ")
        if item:
            body = body[2:].strip()
        key, colon, rest = ("", "", body) if body.startswith("[") else body.partition(":")
        content = (rest if colon else body).strip()
        if content.startswith("["):
            content = closed(content)
        yield Mark(indent, item, key.strip() if colon else None, content)


def parse_yaml(text: str) -> Any:
    """A map, or a list where the text has items at its top; {} where it has neither."""
    open_ = [Node(0)]

    def close(depth: int) -> None:
        while len(open_) > 1 and open_[-1].depth > depth:
            done = open_.pop()
            open_[-1].take(done)

    for mark in _marks(text):
        close(mark.indent)
        depth = mark.indent
        if mark.item:
            if mark.key is None:
                open_[-1].items.append(scalar(mark.text))
                continue
            depth += STEP
            open_.append(Node(depth))
        if mark.key is not None:
            open_.append(Node(depth + STEP, mark.key, mark.text))
        elif mark.text.startswith("[") and len(open_) > 1 and not open_[-1].text:
            open_[-1].text = mark.text
    close(-1)
    return open_[0].items or open_[0].fields


def parse_front_matter(text: str) -> dict:
    """The map between the leading `---` lines; of a list its first item; {} where there is none. The body is left out."""
    first, *lines = text.replace("\r\n", "\n").split("\n")
    ends = [n for n, line in enumerate(lines) if line.startswith("---")] if first == "---" else []
    if not ends:
        return {}
    data = parse_yaml("\n".join(lines[: ends[0]]))
    return data[0] if isinstance(data, list) else data


def plain(value: Any) -> Any:
    """Without absent values, for JSON."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not ABSENT}
    if isinstance(value, list):
        return [plain(v) for v in value if v is not ABSENT]
    return value
