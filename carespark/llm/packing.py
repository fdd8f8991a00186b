"""Cost-balanced packing of documents into token sequences.

The cost of a piece is linear in its tokens plus quadratic, for attention
within the piece. Pieces go, by falling cost, to the cheapest sequence with
room left for them.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .common import give_back, texts_of

SEQUENCE = 2048
END_ID = 1
#: Tokens that are packed together; about what one task holds at a time.
BLOCK_TOKENS = 4 << 20
#: Rows of a batch that are Python strings at a time.
SLICE_ROWS = 1000
#: Cost of a token, and of a pair of tokens of the same piece.
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE
#: Bytes of words and ids that a task remembers; then it starts anew. Size of an entry besides its characters.
MEMORY, ENTRY = 64 << 20, 190
END = END_ID.to_bytes(4, "little")

# The tokenizer's own word pattern, for Latin-1 text in lower case.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = "\t-\r \u0085 "
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> Tokenizer:
    """The tokenizer itself stays with the worker: its size is fixed."""
    return Tokenizer.from_file(path)


class Budget:
    """Bytes that several memories share; when they are spent, all start anew."""

    def __init__(self, total: int):
        self.total = self.left = total
        self.memories: list[Memo] = []

    def spend(self, size: int) -> None:
        self.left -= size
        if self.left < 0:
            for m in self.memories:
                m.clear()
            self.left = self.total - size


class Memo(dict):
    """Ids, as little-endian bytes, of the words asked for so far."""

    def __init__(self, find, budget: Budget):
        super().__init__()
        self.find, self.budget = find, budget
        budget.memories.append(self)

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        self.budget.spend(len(word) + len(ids) + ENTRY)
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts by a word-splitting BPE tokenizer, with each word encoded once.

    Latin-1 texts are cut at white space and by the tokenizer's pattern here; the
    pieces' ids come from its BPE model and are remembered. Any other text, and
    texts with strings of special tokens, go through the whole tokenizer.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.whole = tokenizer_of(path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # also characters that only Python takes for white space
        odd = re.compile("[\x1c-\x1f]|" + "|".join(map(re.escape, special)), re.IGNORECASE).search
        heads = {*"\x1c\x1d\x1e\x1f", *(c for t in special for c in (t[0].lower(), t[0].upper()))}
        self.odd = lambda text: any(c in text for c in heads) and odd(text)  # most texts hold no such character
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_chars = [chars[b] for b in range(256)]
        budget = Budget(memory)
        pieces = Memo(self._piece, budget)
        self.words = Memo(
            lambda word: self._piece(word) if word.isalpha() else b"".join(map(pieces.__getitem__, PIECES.findall(word))), budget
        )

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isalpha() else "".join(self.byte_chars[b] for b in piece.encode())
        return _bytes([t.id for t in self.whole.model.tokenize(spelled)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            text.encode("latin-1")
            plain = not self.odd(text)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)


def encoder(path: str, memory: int = MEMORY) -> WordEncoder:
    """An encoder for one task: what it remembers goes with the task."""
    return WordEncoder(path, memory)


def capacities(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences, and powers of two for the rest: no token of padding."""
    full, rest = divmod(total, sequence)
    return [sequence] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], sequence: int = SEQUENCE) -> list[list[tuple[int, int, int, int]]]:
    """For each item its pieces (start, length, sequence, offset) that fill `capacities` exactly.

    Items longer than a sequence give whole sequences first. What remains goes,
    longest first, to the cheapest sequence that has room for it; where none
    has, as much as fits goes to the roomiest one and the rest is tried again.
    A tree over the room left holds the cheapest sequence of each room, so
    an item costs a few steps whatever the number of sequences.
    """
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    room = capacities(sum(lengths), sequence)
    full = 0
    rest = []
    for i, n in enumerate(lengths):
        whole, left = divmod(n, sequence)
        for j in range(whole):
            pieces[i].append((j * sequence, sequence, full, 0))
            full += 1
        if left:
            rest.append((left, i, whole * sequence))
    size = 1 << sequence.bit_length()
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(size)]
    tree: list[tuple[float, int] | None] = [None] * (2 * size)
    capacity = list(room)

    def update(r: int) -> None:
        at = r + size
        tree[at] = heaps[r][0] if heaps[r] else None
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            best = a if b is None or (a is not None and a <= b) else b
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1

    def put(cost: float, s: int) -> None:
        if room[s]:
            heapq.heappush(heaps[room[s]], (cost, s))
            update(room[s])

    def cheapest(low: int) -> tuple[float, int] | None:
        best, a, b = None, low + size, 2 * size
        while a < b:
            if a & 1:
                if tree[a] is not None and (best is None or tree[a] < best):
                    best = tree[a]
                a += 1
            if b & 1:
                b -= 1
                if tree[b] is not None and (best is None or tree[b] < best):
                    best = tree[b]
            a >>= 1
            b >>= 1
        return best

    def roomiest() -> tuple[float, int]:
        at = 1
        while at < size:
            at = 2 * at + 1 if tree[2 * at + 1] is not None else 2 * at
        return tree[at]

    for s in range(full, len(room)):
        put(0.0, s)
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, i, start in rest:
        while n:
            cost, s = cheapest(n) or roomiest()
            part = min(n, room[s])
            heapq.heappop(heaps[room[s]])
            update(room[s])
            pieces[i].append((start, part, s, capacity[s] - room[s]))
            room[s] -= part
            put(cost + LINEAR * part + QUADRATIC * part * part, s)
            start += part
            n -= part
    return pieces


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True, memory: int = MEMORY) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    `ids` holds little-endian unsigned 32-bit ids and is left out on request. A
    task remembers words in at most about `memory` bytes: more memory saves time.

    Each document is its token ids and the end id. `tokenizer` is the path of a
    tokenizer file that every machine has. A task packs its rows in blocks of
    about `block_tokens`, without a shuffle; sequence ids are numbered per
    task. Null texts count as empty: one end id. Repeated rows are packed each.
    A sequence is full, or a power of two long where a block ends.
    """
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()),
              ("sequence_id", T.LongType()), ("offset", T.LongType()), *[("ids", T.BinaryType())] * with_ids]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, memory)
        arrow = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 36

        def packed(names: list, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, last = [], -1
            for name, own, pieces in zip(names, ids, assign([len(x) // 4 for x in ids], sequence)):
                for start, n, s, offset in pieces:
                    part = own[4 * start:4 * (start + n)]
                    rows.append((name, start, n, zlib.crc32(part), len(own) // 4, number + s, offset, *[part] * with_ids))
                    last = max(last, s)
            number += last + 1
            for a in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[a:a + 5000]), arrow)], schema=arrow
                )

        names: list = []
        ids: list[bytes] = []
        held = 0
        slices = (batch.slice(a, SLICE_ROWS) for batch in batches for a in range(0, batch.num_rows, SLICE_ROWS))
        for part in slices:
            for name, text in zip(part.column(0).to_pylist(), texts_of(part, "text")):
                own = words.encode(text) + END
                names.append(name)
                ids.append(own)
                held += len(own) // 4
                if held >= block_tokens:
                    yield from packed(names, ids)
                    names, ids, held = [], [], 0
        if names:
            yield from packed(names, ids)
        del words, names, ids
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
