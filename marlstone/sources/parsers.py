"""Parsers by format. A parser takes a file's text and gives a record or a list of records."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from marlstone.sources.mini_yaml import parse_front_matter, parse_yaml

Parser = Callable[[str], Any]

_parsers: dict[str, Parser] = {"markdown": parse_front_matter, "yaml": parse_yaml, "json": json.loads}


def register_parser(kind: str, parser: Parser) -> None:
    """For every engine of this process; takes the place of a parser of the same name."""
    _parsers[kind] = parser


def parsers() -> dict[str, Parser]:
    return dict(_parsers)


def parse(kind: str, content: str | bytes, known: dict[str, Parser] | None = None) -> Any:
    parser = (known or _parsers).get(kind)
    if parser is None:
        raise ValueError(f"No parser registered for type: {kind}")
    return parser(content.decode("utf-8") if isinstance(content, bytes) else content)
