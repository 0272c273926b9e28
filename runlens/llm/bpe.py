"""Byte-level BPE encoding and decoding, vectorised with numpy over Arrow batches.

Pre-tokenisation runs without a regular expression. Each code point becomes a symbol (its
class, plus marks for the letters that can follow an apostrophe); a small automaton's
transition functions are composed by a two-level scan (function composition is
associative: within blocks for all blocks at once, then over the blocks), and a piece
starts where the state before a code point and its symbol say so. The automaton is needed
for one thing only: whether an apostrophe begins a match, so that a contraction does.

The pieces' byte slices are hashed; distinct pieces not met before by this worker are merged,
all of them at once, one lowest-rank pair each per round, as the rank file orders. Results
are cached by the piece's 64-bit hash; the cache is emptied when it holds CACHE pieces or
CACHE_IDS ids. Memory: the arrays of one chunk of CHUNK bytes of text (a longer text stands
alone), the cache, and for a single piece of more than WIDE bytes about 100 bytes each.

Defined results: null is the empty text, which has no tokens; whole texts are encoded; rows
are independent, so repeated rows repeat their result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame

from runlens.llm.common import Rolling, chunks, code_points, in_arrow, mix64, text_bytes, text_of

CHUNK = 1 << 18
CACHE = 100_000
CACHE_IDS = 1 << 20
#: Pieces of more bytes than this are merged one by one with a heap.
WIDE = 48

# Symbols of code points and states of the automaton.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE, ONE, TWO = range(8)
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, QUOTE, HALF, ENDED = range(7)
_STATES = 7


@functools.cache
def _classes() -> np.ndarray:
    """Symbol of each code point, without the marks of contractions."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # fixed values: the code points of the White_Space property
    white = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    table[0x20] = SPACE
    table[ord("'")] = APOSTROPHE
    return table


@functools.cache
def _transitions() -> np.ndarray:
    """next state by [symbol, state]; symbols from 8 on are those of a text's first code point."""
    table = np.zeros((16, _STATES), dtype=np.uint8)
    plain = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_OTHERS, WHITE: IN_WHITE, ONE: IN_LETTERS, TWO: IN_LETTERS}
    for symbol, state in plain.items():
        table[symbol] = state  # after a plain space an apostrophe belongs to the space's match, as after other signs
    table[APOSTROPHE] = [QUOTE, QUOTE, IN_OTHERS, QUOTE, IN_OTHERS, QUOTE, QUOTE]
    table[ONE, QUOTE] = ENDED
    table[TWO, QUOTE] = HALF
    for symbol in (LETTER, ONE, TWO):
        table[symbol, HALF] = ENDED
    for symbol in range(8):
        table[8 + symbol] = table[symbol, IN_WHITE]
    return table


def _states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The automaton's state after each symbol, by composing transition functions."""
    table, n = _transitions(), len(symbols)
    rows = -(-n // width)
    padded = np.zeros(rows * width, dtype=np.uint8)
    padded[:n] = symbols
    padded = padded.reshape(rows, width).T.copy()
    # functions of whole blocks, all blocks at a time
    flat = table.ravel()
    whole = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for step in padded:
        whole = flat[step[:, None].astype(np.uint16) * _STATES + whole]
    # states at the blocks' starts: doubling scan over the block functions
    ahead, stride = whole, 1
    while stride < rows:
        ahead = np.concatenate([ahead[:stride], np.take_along_axis(ahead[stride:], ahead[:-stride], axis=1)])
        stride *= 2
    state = np.concatenate([np.full(1, IN_WHITE, dtype=np.uint8), ahead[:-1, IN_WHITE]])
    out = np.empty((width, rows), dtype=np.uint8)
    for i, step in enumerate(padded):
        state = flat[step.astype(np.uint16) * _STATES + state]
        out[i] = state
    return out.T.reshape(-1)[:n]


def piece_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin in the code points of several texts; offsets: the texts' limits."""
    n = len(cps)
    if not n:
        return np.zeros(0, dtype=np.int64)
    symbols = _classes()[np.minimum(cps, 0x10FFFF)]
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    after = np.zeros(n, dtype=np.uint32)
    after[:-1] = np.where(first[1:], 0, cps[1:])
    code = {c: ord(c) for c in "stmdrevl"}
    one = (cps == code["s"]) | (cps == code["t"]) | (cps == code["m"]) | (cps == code["d"])
    two = (((cps == code["r"]) | (cps == code["v"])) & (after == code["e"])) | ((cps == code["l"]) & (after == code["l"]))
    symbols = np.where(one, ONE, np.where(two, TWO, symbols)).astype(np.uint8)
    states = _states(symbols + first * np.uint8(8))
    # runs of one kind; a contraction is one piece
    kind = np.array([0, 1, 2, 3, 3, 2, 0, 0], dtype=np.uint8)[symbols]
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = IN_WHITE, states[:-1]
    starts = np.empty(n, dtype=bool)
    starts[0], starts[1:] = True, kind[1:] != kind[:-1]
    inside = ((states == ENDED) & ((before == QUOTE) | (before == HALF))) | (states == HALF)
    starts[inside] = False
    starts[1:] |= (before[1:] == ENDED) & (kind[1:] == 0) & ~inside[1:]
    # the last of a white run before a sign begins a piece of its own; if it is a plain space, with what follows
    white, follows = kind == 3, np.zeros(n, dtype=bool)
    follows[:-1] = white[:-1] & (kind[1:] != 3) & ~first[1:]
    starts |= follows
    starts[1:] &= ~(follows[:-1] & (symbols[:-1] == SPACE))
    starts |= first
    return np.flatnonzero(starts)


class Vocabulary:
    """Ranks of a rank file, with the tables that merging and decoding need."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.by_id = by_id
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ids = [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 20) | right)
                    ids.append(i)
        self._hash(np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int64))
        self.rolling = Rolling()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(CACHE + 1, dtype=np.int64)
        self.size = np.zeros(CACHE + 1, dtype=np.int64)

    def _hash(self, keys: np.ndarray, ids: np.ndarray) -> None:
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_id = np.full(1 << self.bits, size := 1 << 40, dtype=np.int64)
        self.none = size
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot_key[slot[left]] < 0]
            self.slot_key[slot[free]] = keys[free]  # the last one wins a slot
            placed = self.slot_key[slot[left]] == keys[left]
            self.slot_id[slot[left[placed]]] = ids[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined pair, or `none`; negative ids join with nothing."""
        keys = (left << 20) | right
        slot = self._slot(keys)
        found = self.slot_key[slot]
        out = np.where(found == keys, self.slot_id[slot], self.none)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_id[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = self.none
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece: whole tokens as they are, the others by merging."""
        out: list = [None] * len(pieces)
        narrow: list[int] = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > WIDE:
                out[i] = self._merge_long(piece)
            else:
                narrow.append(i)
        narrow.sort(key=lambda i: len(pieces[i]))
        for at in range(0, len(narrow), 8192):
            group = narrow[at : at + 8192]
            for i, ids in zip(group, self._merge_many([pieces[i] for i in group]), strict=True):
                out[i] = ids
        return out

    def _merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        width = int(sizes.max())
        ids = np.full((len(pieces), width + 1), -1, dtype=np.int64)
        filled = np.arange(width)[None, :] < sizes[:, None]
        ids[:, :width][filled] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        active = np.arange(len(pieces))
        columns = np.arange(width)
        while len(active):
            own = rank[active]
            best = own.argmin(axis=1)
            least = own[np.arange(len(active)), best]
            go = least < self.none
            active, best, least = active[go], best[go], least[go]
            if not len(active):
                break
            # drop the right part: everything behind it moves one to the left
            take = columns[None, :] + (columns[None, :] > best[:, None])
            moved = np.full((len(active), width + 1), -1, dtype=np.int64)
            moved[:, :width] = np.take_along_axis(ids[active], take, axis=1)
            every = np.arange(len(active))
            moved[every, best] = least
            ids[active] = moved
            ranks = np.full((len(active), width + 1), self.none, dtype=np.int64)
            ranks[:, :width] = rank[active]
            ranks = np.take_along_axis(ranks, take, axis=1)
            ranks[every, best] = self.pair_rank(least, moved[every, best + 1])
            left = np.maximum(best - 1, 0)
            ranks[every, left] = np.where(best > 0, self.pair_rank(moved[every, left], least), ranks[every, left])
            rank[active] = ranks
        return [row[row >= 0].tolist() for row in ids]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, in n log n, by a heap over linked parts."""
        rank, n = self.ranks, len(piece)
        ends, after = array("q", range(1, n + 1)), array("q", range(1, n + 1))
        ahead, alive = array("q", range(-1, n - 1)), bytearray(b"\1" * n)
        heap: list[int] = []  # rank and first byte of a part that joins with the one after it

        def joined(i: int) -> int | None:
            return rank.get(piece[i : ends[after[i]]]) if after[i] < n else None

        for i in range(n):
            if (r := joined(i)) is not None:
                heap.append(r << 40 | i)
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 40)
            if not alive[i] or joined(i) != r:  # one of the two has been merged meanwhile
                continue
            j = after[i]
            alive[j], ends[i], after[i] = 0, ends[j], after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (i, ahead[i]):
                if k >= 0 and (r := joined(k)) is not None:
                    heapq.heappush(heap, r << 40 | k)
        return [rank[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def _learn(self, keys: list[int], pieces: list[bytes]) -> None:
        for key, ids in zip(keys, self.merge(pieces), strict=True):
            k, n = len(self.known), len(ids)
            if self.used + n > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(n, len(self.pool)), dtype=np.int32)])
            self.pool[self.used : self.used + n] = ids
            self.known[key], self.start[k], self.size[k] = k, self.used, n
            self.used += n

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) for UTF-8 bytes of several texts."""
        if not len(raw):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        cps, at = code_points(raw, offsets)
        begin = np.flatnonzero((raw & 0xC0) != 0x80)[piece_starts(cps, at)]
        end = np.append(begin[1:], len(raw))
        keys, first, inverse = np.unique(self.rolling.spans(raw, begin, end), return_index=True, return_inverse=True)
        if len(keys) > CACHE:  # very many distinct pieces: room for this chunk
            self.start, self.size = np.zeros(len(keys) + 1, dtype=np.int64), np.zeros(len(keys) + 1, dtype=np.int64)
            self.known, self.used = {}, 0
        elif len(self.known) + len(keys) > len(self.start) - 1 or self.used > CACHE_IDS:
            self.forget()
        names = keys.tolist()
        new = [i for i, key in enumerate(names) if key not in self.known]
        if new:
            text = raw.tobytes()
            self._learn([names[i] for i in new], [text[begin[first[i]] : end[first[i]]] for i in new])
        known = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))[inverse]
        size = self.size[known]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.start[known] - sums[:-1], size) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offset of each id and the end)."""
        size = self.lengths[ids]
        sums = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.at[ids] - sums[:-1], size) + np.arange(sums[-1])], sums


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _batches(vocab: Vocabulary, column):
    """(first row, ids, id offsets) of each chunk of a text column."""
    raw, offsets = text_bytes(column)
    for i, j in chunks(offsets, CHUNK):
        ids, at = vocab.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, ids, at


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The general operator: id, ids array<int>, offsets array<int> (each token's first byte in the text)."""
    path = path or default_path()
    source = docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text"))

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(path)
        for batch in batches:
            row = 0
            for _, ids, at in _batches(vocab, batch.column(1)):
                _, where = vocab.decode(ids)
                n = len(at) - 1
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                offs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((where[:-1] - np.repeat(where[at[:-1]], np.diff(at))).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), lists, offs], ["_id", "ids", "offsets"])
                row += n

    kind = source.schema["_id"].dataType.simpleString()
    return in_arrow(source, run, f"_id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, text of rows with ids."""
    path = path or default_path()
    source = encoded.select(encoded[id_col].alias("_id"), "ids")

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(path)
        for batch in batches:
            texts = [b"".join(vocab.by_id[i] for i in row or ()).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    kind = source.schema["_id"].dataType.simpleString()
    return in_arrow(source, run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def token_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and the columns named in carry; ids never leave the worker."""
    path = path or default_path()
    source = docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)])
    kept = [f for f in source.schema.fields if f.name not in ("_text",)]

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(path)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for _, ids, at in _batches(vocab, batch.column(1)):
                raw, where = vocab.decode(ids)
                limits, where = at.tolist(), where[at].tolist()
                wire, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
                count += np.diff(at).tolist()
                ids_sha += [hashlib.sha256(wire[4 * a : 4 * b]).hexdigest() for a, b in zip(limits, limits[1:], strict=False)]
                text_sha += [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(where, where[1:], strict=False)]
            others = [c for i, c in enumerate(batch.columns) if i != 1]
            made = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*others, *made], [*[f.name for f in kept], "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"])
    out = in_arrow(source, run, schema).withColumnRenamed("_id", id_col)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"_c{i}", c)
    return out
