"""Packing documents into fixed-length token sequences.

Bounded-space online packing. Every input partition streams through one task that
keeps at most `open_windows` partly filled windows. A document is cut into whole
windows and a remainder; the remainder goes to the window that it fills best. When
none fits and no more windows may be opened, the fullest window is closed, after its
gap has been filled with the head of the document if the gap is at least `min_cut`
tokens. What is still open at the end of a partition is merged in rounds: the
leftovers of `fan_in` partitions meet in one task, are packed again by decreasing
size, and only windows that are still far from full go on to the next round. A task
therefore never holds more than fan_in * open_windows windows, whatever the input.

Token ids are computed once, where the text is read; only the placements (a few
numbers for each piece) are written and shuffled.

Defined results: null or empty text is a document of one token (the end id); a text of any
length is cut into as many windows as it fills; rows with equal or null doc_id, or that
repeat a whole row, are packed independently; of windows that a piece fills equally well the
one opened first is taken; columns besides doc_id and text are not read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import release, text_or_empty, written
from marlstone.llm.tokenizing import tokenizer_of
from marlstone.shipping import ship

SEQUENCE_TOKENS = 4096
END_ID = 2
OPEN_WINDOWS = 64
MIN_CUT = 64
FAN_IN = 16
BATCH_CHARS = 1_000_000

PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_tokens long, padded_tokens long, part long, open boolean"
)


class Packer:
    """The open windows of one task. Closed windows collect in `done`."""

    def __init__(self, first_id: int, capacity: int, open_windows: int, min_cut: int):
        self.capacity, self.open_windows, self.min_cut = capacity, open_windows, min_cut
        self.next_id = first_id
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.done: list[tuple] = []

    def _new(self) -> int:
        self.next_id += 1
        self.held[self.next_id - 1] = []
        return self.next_id - 1

    def close(self, window: int, room: int) -> None:
        used, at = self.capacity - room, 0
        padded = used if used & (used - 1) == 0 else self.capacity
        for doc_id, start, length, crc, total in self.held.pop(window):
            self.done.append((doc_id, start, length, crc, total, window, at, used, padded))
            at += length

    def put(self, window: int, room: int, piece: tuple) -> None:
        self.held[window].append(piece)
        left = room - piece[2]
        if left == 0:
            self.close(window, 0)
        else:
            bisect.insort(self.free, (left, window))

    def add(self, doc_id: int, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        piece = lambda n: (doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total)
        while total - at >= self.capacity:
            self.put(self._new(), self.capacity, piece(self.capacity))
            at += self.capacity
        while at < total:
            rest = total - at
            best = bisect.bisect_left(self.free, (rest, -1))
            if best < len(self.free):
                room, window = self.free.pop(best)
                self.put(window, room, piece(rest))
                return
            if len(self.free) < self.open_windows:
                self.put(self._new(), self.capacity, piece(rest))
                return
            room, window = self.free.pop(0)  # the fullest
            if room >= self.min_cut:
                self.put(window, room, piece(room))
                at += room
            else:
                self.close(window, room)

    def add_piece(self, piece: tuple) -> None:
        """Places a piece as it is: best fit, or a new window."""
        best = bisect.bisect_left(self.free, (piece[2], -1))
        room, window = self.free.pop(best) if best < len(self.free) else (self.capacity, self._new())
        self.put(window, room, piece)

    def leftovers(self) -> list[tuple]:
        rows = [(*piece, window, 0, 0, 0) for _, window in self.free for piece in self.held[window]]
        self.free, self.held = [], {}
        return rows


def _batch(rows: list[tuple], part: int, open_: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens"]
    columns = [pa.array(c, type=pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([part] * len(rows), pa.int64()), pa.array([open_] * len(rows), pa.bool_())], [*names, "part", "open"]
    )


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a few documents at a time, of about BATCH_CHARS bytes together or a single one."""
    for batch in batches:
        size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()


def _pack_partition(tokenizer_path: str, capacity: int, open_windows: int, min_cut: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer, end = tokenizer_of(tokenizer_path), np.asarray([end_id], "<u4")
        packer = Packer(part << 32, capacity, open_windows, min_cut)
        for doc_ids, texts in _some(batches):
            for doc_id, ids in zip(doc_ids, tokenizer.encode(texts), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]).tobytes())
            if packer.done:
                yield _batch(packer.done, part, False)
                packer.done = []
        yield _batch(packer.leftovers(), part, True)
        release()

    return run


def _merge_group(capacity: int, open_windows: int, min_cut: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        packer = Packer((level << 58) + (group << 32), capacity, open_windows, min_cut)
        rows = rows.sort_values(["length", "doc_id", "start", "sequence_id"], ascending=[False, True, True, True])
        for piece in zip(*(rows[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), strict=True):
            packer.add_piece(tuple(None if pd.isna(x) else int(x) for x in piece))
        while packer.free and (last or packer.free[0][0] < min_cut or len(packer.free) > open_windows):
            room, window = packer.free.pop(0)
            packer.close(window, room)
        return pa.Table.from_batches([_batch(packer.done, group, False), _batch(packer.leftovers(), group, True)]).to_pandas(integer_object_nulls=True)

    return run


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = SEQUENCE_TOKENS,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    fan_in: int = FAN_IN,
    end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece of a document: where it starts in the document, and where it lies.

    docs needs doc_id and text; other columns are not read. sequence_tokens is how many
    tokens the sequence holds, padded_tokens how many after padding (capacity, or as many
    as it holds if that is a power of two).
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    placed = written(source.mapInArrow(_pack_partition(tokenizer_path, capacity, open_windows, min_cut, end_id), PLACED), "packed")
    out, left, level = placed.where(~F.col("open")), placed.where("open"), 0
    parts = left.agg(F.max("part")).first()[0]
    groups = -1 if parts is None else int(parts)
    while groups >= 0:
        groups, level = groups // fan_in, level + 1
        grouped = left.groupBy(F.floor(F.col("part") / fan_in).alias("grp"))
        merged = written(grouped.applyInPandas(_merge_group(capacity, open_windows, min_cut, level, groups == 0), PLACED), "merged")
        out, left = out.unionByName(merged.where(~F.col("open"))), merged.where("open")
        if groups == 0:
            break
    return out.drop("part", "open")
