"""Pages: cursors, what comes before and after, and slices of lists in memory."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PAGE = 20
AFTER, BEFORE = "after", "before"


class CursorError(ValueError):
    def __init__(self):
        super().__init__("Invalid cursor")


@dataclass(frozen=True)
class PageInfo:
    has_next: bool
    has_previous: bool
    start_cursor: str | None = None
    end_cursor: str | None = None

    def to_json(self) -> dict[str, Any]:
        ends = {"startCursor": self.start_cursor, "endCursor": self.end_cursor}
        return {"hasNextPage": self.has_next, "hasPreviousPage": self.has_previous} | {k: v for k, v in ends.items() if v is not None}


def encode_cursor(order: dict[str, str], slug: str) -> str:
    return base64.b64encode(json.dumps({"order": order, "slug": slug}, ensure_ascii=False, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> tuple[dict[str, str], str]:
    try:
        found = json.loads(base64.b64decode(cursor, validate=True).decode())
        return dict(found["order"]), str(found["slug"])
    except (binascii.Error, ValueError, KeyError, TypeError):
        raise CursorError from None


def cursor_column(key: str, value: Column, slug: Column) -> Column:
    """encode_cursor in the plan."""
    text = F.to_json(F.struct(F.struct(value.alias(key)).alias("order"), slug.alias("slug")))
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def look_ahead_info(more: bool, direction: str, cursor_given: bool, start: str | None, end: str | None) -> PageInfo:
    """more: a row beyond the page was found in the direction of reading."""
    behind = cursor_given
    return PageInfo(more, behind, start, end) if direction == AFTER else PageInfo(behind, more, start, end)


def page_slice(rows: Sequence, start: int, size: int, direction: str) -> Sequence:
    """The page after the row at `start` (0: from the beginning), or before it."""
    if direction == BEFORE:
        return rows[max(0, start - size) : start]
    begin = start + 1 if start else 0
    return rows[begin : begin + size]


def slice_info(page: Sequence, size: int, start: int, total: int, direction: str, encode: Callable[[Any], str]) -> PageInfo:
    ends = (encode(page[0]), encode(page[-1])) if page else (None, None)
    if direction == BEFORE:
        return PageInfo(start < total, start - size > 0, *ends)
    skipped = start + 1 if start else 0
    return PageInfo(skipped + size < total, skipped > 0, *ends)
