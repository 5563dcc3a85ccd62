"""Token ids of many texts by a BPE tokenizer whose tokens never span white space.

Words repeat, so each distinct run of non-space is encoded once for a task and then
looked up; Arrow splits the texts and numbers their distinct words, and numpy joins the
looked-up ids. New words are cut into the tokenizer's pieces and merged by rank, all of
them at once. Words with unusual characters, and texts with a special token's string, go
to the tokenizers library itself; `tests/llm/test_operators.py` holds both against it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Of the words that a tokenizer keeps, with what Python needs for each.
CACHE_BYTES = 64_000_000
WORD_BYTES = 160
LONGEST_WORD = 48
#: Characters whose case and normal form Python and the library treat alike.
_PLAIN = re.compile("[\n!-~¡-¬®-įĲ-ňŊ-ž]*")


def slices(text: str, size: int = 1_000_000) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut at ASCII white space only."""
    at, space = 0, re.compile(r"[ \t\n\r\f\v]")
    while len(text) - at > size:
        gap = space.search(text, at + size)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0] + lengths[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class _Merges:
    """Byte-pair merging of many pieces at once."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        names, extra = {b: chr(b) for b in shown}, 256
        for b in range(256):
            if b not in names:
                names[b], extra = chr(extra), extra + 1
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[names[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.none = len(pairs)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = np.append(made, 0)
        # A table of two slots a key: collisions beyond them stay in a sorted list.
        self.bits = 20
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        at = self._hash(keys)
        self.slot_key[at], self.slot_rank[at] = keys, np.arange(len(keys))
        lost = self.slot_key[at] != keys
        order = np.argsort(keys[lost])
        self.rest_key, self.rest_rank = keys[lost][order], np.flatnonzero(lost)[order]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        out = np.where(self.slot_key[at] == keys, self.slot_rank[at], self.none)
        open_ = np.flatnonzero(out == self.none)
        if len(open_) and len(self.rest_key):
            k = np.minimum(np.searchsorted(self.rest_key, keys[open_]), len(self.rest_key) - 1)
            hit = self.rest_key[k] == keys[open_]
            out[open_[hit]] = self.rest_rank[k[hit]]
        return out

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one piece's after the other's, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done_s, done_w = [], []
        while len(symbols):
            rank = np.full(len(symbols), self.none, np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.rank(symbols[inside] * self.base + symbols[inside + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best < self.none, size)
            done_s.append(symbols[~live])
            done_w.append(word[~live])
            take = (rank == np.repeat(best, size)) & live
            at = np.flatnonzero(take)
            if len(at):  # of overlapping pairs, every second from the left
                run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
                start = at[np.flatnonzero(np.append(True, np.diff(run) != 0))]
                at = at[(at - start[run]) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            live[at + 1] = False
            symbols, word = symbols[live], word[live]
        words = np.concatenate(done_w) if done_w else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return (np.concatenate(done_s)[order] if done_s else words), np.bincount(words, minlength=len(pieces))


class _Growing:
    """An array that grows at its end, in place or into twice the room."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.used + len(more)
        if end > len(self.data):
            room = np.zeros(max(end, 2 * len(self.data)), self.data.dtype)
            room[: self.used] = self.data[: self.used]
            self.data = room
        self.data[self.used : end] = more
        self.used = end


_tokenizers: dict[str, "Tokenizer"] = {}


def tokenizer_of(path: str) -> "Tokenizer":
    """The worker's own tokenizer: a reused Python worker keeps the words it has learnt."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


class Tokenizer:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        described = json.loads(self.library.to_str())
        self.special = [t["content"] for t in described["added_tokens"]]
        splits = [p["pattern"]["Regex"] for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(rf"\n|{splits[0]}")
        self.merges = _Merges(described["model"])
        self.cache_bytes = cache_bytes
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.bytes = 0
        self.start, self.length, self.pool = _Growing(np.int64), _Growing(np.int64), _Growing(np.uint32)
        self.start.add(np.zeros(1, np.int64))
        self.length.add(np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> np.ndarray:
        """Adds new words; their entries."""
        joined, plain = "\n".join(words), words
        if not _PLAIN.fullmatch(joined) or max(map(len, words)) > LONGEST_WORD or any(s in joined for s in self.special):
            plain = [w for w in words if len(w) <= LONGEST_WORD and _PLAIN.fullmatch(w) and not any(s in w for s in self.special)]
            joined = "\n".join(plain)
        odd = list(set(words).difference(plain)) if len(plain) < len(words) else []
        got, sizes = [], []
        if plain:
            pieces = self.pieces.findall(unicodedata.normalize("NFC", joined).lower())
            raw = list(map(str.encode, pieces))
            breaks = np.array([p == "\n" for p in pieces])
            owner = np.cumsum(breaks)[~breaks]
            distinct = pa.array(raw, pa.large_binary()).dictionary_encode()
            ids, counts = self.merges.ids(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
            which = distinct.indices.to_numpy()[~breaks]
            ids, counts = ids[ragged((np.cumsum(counts) - counts)[which], counts[which])], counts[which]
            got.append(ids.astype(np.uint32))
            sizes.append(np.bincount(owner, weights=counts, minlength=len(plain)).astype(np.int64))
        for k in range(0, len(odd), 1000):
            for x in self.library.encode_batch_fast(odd[k : k + 1000], add_special_tokens=False):
                got.append(np.asarray(x.ids, np.uint32))
                sizes.append(np.array([len(x.ids)]))
        size = np.concatenate(sizes)
        n = len(self.known)
        self.known.update(zip([*plain, *odd], range(n, n + len(size)), strict=True))
        self.bytes += sum(map(len, words)) + WORD_BYTES * len(words) + 4 * int(size.sum())
        self.start.add(self.pool.used + np.cumsum(size) - size)
        self.length.add(size)
        for ids in got:
            self.pool.add(ids)
        return np.array([self.known[w] for w in words] if odd else range(n, n + len(size)), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The unsigned 32-bit ids of each text."""
        parts = [list(slices(t)) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([p for some in parts for p in some], pa.large_string()))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        if None in found:
            new = [w for w, k in zip(distinct, found, strict=True) if k is None]
            if self.bytes + sum(map(len, new)) + WORD_BYTES * len(new) > self.cache_bytes:
                self._empty()
                new = [w for w in distinct if w]
                found = [None if w else 0 for w in distinct]
            fresh = self._learn(new)
            entry = np.array([-1 if k is None else k for k in found], np.int64)
            entry[entry < 0] = fresh
        else:
            entry = np.array(found, np.int64)
        at = entry[words.indices.to_numpy()]
        size = self.length.data[at]
        ids = self.pool.data[ragged(self.start.data[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy()]
        owner = np.cumsum([len(p) for p in parts])
        return np.split(ids, ends[owner[:-1]]) if len(texts) else []
