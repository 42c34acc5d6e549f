"""Packing: minimum bin slack by a bitset subset-sum over the lengths that remain.

Every task packs what it reads into windows of its own, so neither texts nor
ids are shuffled, and a task repeated elsewhere writes the same windows.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import per_worker, slices

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END = 1
# Remainders a task holds before it packs them (each below one window: 32 MB at most).
HELD = 4_096
# Parts a worker remembers the ids of, twice over (some 150 bytes each).
ENTRIES = 500_000
# Text that is split at a time; splitting takes 11 times its size in memory, as measured.
SPLIT_BYTES = 4 << 20

# A run of white space leaves its last blank to the word behind it, as the
# tokenizer's own pattern does; its merges never cross the borders between these parts.
PART = re.compile(r" ?\S+|\s+(?!\S)|\s+")
OTHER_SPACE = re.compile(r"[^\S \n]")

# Texts of printable ASCII, blanks, newlines, and Latin and Cyrillic letters split
# further by these classes; for other characters the library's own classes decide.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481"
PLAIN = re.compile(f"[ \n!-~{LETTERS}]*")
PIECE = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n{LETTERS}0-9]+|[ \n]+(?![^ \n])|[ \n]+"
)

# What the bytes of such texts are; those from 0x80 on are parts of letters. A NUL ends a text.
BLANK, NEWLINE, LETTER, DIGIT, OTHER, STOP = range(6)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KINDS[0x30:0x3A], KINDS[0x20], KINDS[0x0A], KINDS[0x00] = DIGIT, BLANK, NEWLINE, STOP


def piece_starts(texts: bytes) -> np.ndarray:
    """Where the matches of PIECE start in texts of PLAIN, with a NUL behind each; every NUL is a piece, too."""
    codes = np.frombuffer(texts, np.uint8)
    kinds = KINDS[codes]
    before = np.append(np.uint8(STOP), kinds[:-1])
    behind = np.append(kinds[1:], np.uint8(STOP))
    # The last of a run of white space is apart from the others; a blank belongs to what follows it.
    starts = np.where(
        kinds <= NEWLINE,
        (before > NEWLINE) | (behind > NEWLINE) & (behind != STOP),
        (kinds != before) & (before != BLANK) | (kinds == STOP),
    )
    quotes = np.flatnonzero((codes == ord("'")) & (before != BLANK) & (before != OTHER))
    first, second = codes[quotes + 1].astype(np.int64), codes.take(quotes + 2, mode="clip")
    one = quotes[np.isin(first, list(b"stmd"))]
    two = quotes[np.isin(first << 8 | second, [0x7265, 0x7665, 0x6C6C])]  # re, ve, ll
    starts[one + 1] = starts[two + 1] = False
    starts[one + 2] = starts[two + 3] = True
    return np.flatnonzero(starts)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + n for n, b in enumerate(hidden)}


class Remembered(dict):
    """A dict that fills itself by ``make`` and forgets what was long not asked for.

    It has at most twice ``limit`` entries, and those that are set for one text.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.turn()
        self[key] = value
        return value

    def turn(self) -> None:
        """Makes room once ``limit`` is reached."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts; each distinct part is given to the library once.

    Plain texts are split together and each of their distinct pieces is looked
    up once. Texts with other white space than blanks and newlines, or with a
    string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, byte_letters()
        self.blank = chr(self.letters[0x20])
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = Remembered(self.part, ENTRIES)

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def piece(self, piece: str) -> bytes:
        """Ids of what the library's pattern does not split, straight from its merges."""
        if piece.isascii() and piece[-1] > " ":  # only a blank in front looks different
            shown = self.blank + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def split(self, text: str) -> list[str]:
        """Parts that are encoded independently of each other."""
        return [q for p in PART.findall(text) for q in (PIECE.findall(p) if PLAIN.fullmatch(p) else (p,))]

    def part(self, part: str) -> bytes:
        return self.piece(part) if PLAIN.fullmatch(part) else self.encode([part])[0]

    def plain_ids(self, texts: bytes) -> Iterator[np.ndarray]:
        """Ids of each of the texts, which are plain and have a NUL behind them."""
        starts = piece_starts(texts)
        borders = [None, pa.py_buffer(np.append(starts, len(texts))), pa.py_buffer(texts)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), borders).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [b"" if p == "\0" else self.known[p] for p in distinct]
        _, borders, ids = pa.array(known, pa.large_binary()).take(pieces.indices).buffers()
        stops = np.flatnonzero(np.frombuffer(texts, np.uint8)[starts] == 0)
        ends = np.frombuffer(borders, np.int64)[stops] // 4
        return iter(np.split(np.frombuffer(ids, np.uint32), ends)[:-1])

    def other_ids(self, text: str) -> np.ndarray:
        if OTHER_SPACE.search(text) or self.added and self.added.search(text):
            return np.frombuffer(self.encode([text])[0], np.uint32)
        parts, known, odd = self.split(text), self.known, []
        known.turn()
        for part in {p for p in parts if p not in known and p not in known.older}:
            if PLAIN.fullmatch(part):
                known[part] = self.piece(part)
            else:
                odd.append(part)
        for at in range(0, len(odd), 10_000):
            some = odd[at : at + 10_000]
            known.update(zip(some, self.encode(some), strict=True))
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), np.uint32)

    def all_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [bool(PLAIN.fullmatch(t)) and not (self.added and self.added.search(t)) for t in texts]
        found = self.plain_ids("".join(t + "\0" for t in compress(texts, plain)).encode())
        return (next(found) if p else self.other_ids(t) for t, p in zip(texts, plain, strict=True))

    def ids(self, text: str) -> np.ndarray:
        return next(self.all_ids([text]))


def fullest(counts: Mapping[int, int], room: int, order: Iterable[int] | None = None) -> list[tuple[int, int]]:
    """[(length, how often)]: a multiset of the lengths left whose sum comes closest to ``room``.

    Bit s of ``reach`` says that some multiset sums to s. A length that is
    there c times enters in portions of 1, 2, 4, ... copies, so any number up to c can be
    chosen; longest first, and no further once the room is filled exactly.
    The sets before each portion tell, backwards, which portions were taken.
    """
    reach, every, steps = 1, (1 << room + 1) - 1, []
    for length in sorted(counts, reverse=True) if order is None else order:
        if reach >> room & 1:
            break
        left, portion = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(portion, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & every
            left, portion = left - take, portion * 2
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return list(chosen.items())


class Packer:
    """Windows of ``capacity`` ids from documents that arrive one by one.

    A piece is (doc_id, start, ids, doc_tokens). Whole windows are cut off a
    document as it arrives; its remainder waits with others of its length.
    """

    def __init__(self, capacity: int, held: int):
        self.capacity, self.held = capacity, held
        self.waiting: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []  # ascending, as in ``waiting``
        self.pieces = self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(doc_id, start, ids[start : start + self.capacity], len(ids))]
        if whole < len(ids):
            self.wait((doc_id, whole, ids[whole:].copy(), len(ids)))
        if self.pieces >= self.held:
            # Less than a window could not be filled; it waits.
            while self.pieces > self.held // 2 and self.tokens >= self.capacity:
                yield from self.window()

    def wait(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.waiting:
            self.waiting[length] = []
            self.counts[length] = 0
            insort(self.lengths, length)
        self.waiting[length].append(piece)
        self.counts[length] += 1
        self.pieces += 1
        self.tokens += length

    def take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.waiting[length], self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.pieces -= 1
        self.tokens -= length
        return piece

    def window(self) -> Iterator[list[tuple]]:
        """The longest remainder and those that fill its window best, as often as the lengths last.

        Where they leave a gap, all others are longer than it: one is cut.
        """
        head = self.take(self.lengths[-1])
        longest = len(head[2])
        room = self.capacity - longest
        order = islice(reversed(self.lengths), len(self.lengths) - bisect_right(self.lengths, room), None)
        chosen = fullest(self.counts, room, order)
        out = [head, *(self.take(n) for n, c in chosen for _ in range(c))]
        gap = self.capacity - sum(len(p[2]) for p in out)
        if gap and self.lengths:
            doc_id, start, ids, total = self.take(self.lengths[0])
            out.append((doc_id, start, ids[:gap], total))
            self.wait((doc_id, start + gap, ids[gap:], total))
        yield out
        needed = Counter(dict(chosen))
        needed[longest] += 1
        while not gap and all(self.counts.get(n, 0) >= c for n, c in needed.items()):
            yield [self.take(n) for n, c in needed.items() for _ in range(c)]

    def rest(self) -> Iterator[list[tuple]]:
        """All that waits. The last ids, less than a window, go into lengths of powers of two, which need no padding."""
        while self.tokens >= self.capacity:
            yield from self.window()
        pieces = [self.take(self.lengths[-1]) for _ in range(self.pieces)]
        left = sum(len(p[2]) for p in pieces)
        while left:
            size, out = 1 << left.bit_length() - 1, []
            left -= size
            while size:
                doc_id, start, ids, total = pieces.pop()
                out.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    pieces.append((doc_id, start + size, ids[size:], total))
                size -= len(out[-1][2])
            yield out


PIECES = pa.list_(pa.struct([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()),
    ("doc_tokens", pa.int64()),
]))
NAMES = ["part", "number", "n_tokens", "ids", "pieces"]


def sequence_batch(part: int, first: int, windows: list[list[tuple]]) -> pa.RecordBatch:
    ids = [np.concatenate([p[2] for p in w]).astype("<u4") for w in windows]
    pieces = []
    for window in windows:
        own, offset = [], 0
        for doc_id, start, some, total in window:
            own.append({"doc_id": doc_id, "start": start, "length": len(some), "offset": offset, "doc_tokens": total})
            offset += len(some)
        pieces.append(own)
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(windows), pa.int64()), pa.array(range(first, first + len(windows)), pa.int64()),
         pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
         pa.array(pieces, PIECES)], NAMES,
    )


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, held: int = HELD
) -> DataFrame:
    """sequence_id, n_tokens, padded, ids (little-endian 32 bit), pieces of every training sequence.

    A document's ids are those of its whole text and then ``end``; null and
    empty texts have the end alone. Pieces (doc_id, start, length, offset,
    doc_tokens) lie one after another in their sequence. ``padded`` is the
    length to pad to: ``capacity``, or the sequence's own where that is a power
    of two. Only the last ids of a task make sequences below ``capacity``.
    Repeated rows are packed each for itself, a null doc_id stays null, an empty
    table gives no rows, other columns are ignored. Which rows share a
    sequence follows from how the input is partitioned. Map-only: one pass, no
    shuffle, and a task holds ``held`` remainders at most and one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, first, ready, part = None, Packer(capacity, held), 0, [], 0
        for batch in batches:
            encoder = encoder or per_worker(f"packing {path}", lambda: Encoder(path or tokenizer_path()))
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for some in slices(batch, "text", SPLIT_BYTES):
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.all_ids(texts), strict=True):
                    for window in packer.add(doc_id, np.append(ids, np.uint32(end))):
                        ready.append(window)
                        if len(ready) >= 256:
                            yield sequence_batch(part, first, ready)
                            first, ready = first + len(ready), []
        for window in packer.rest():
            ready.append(window)
            if len(ready) >= 256:
                yield sequence_batch(part, first, ready)
                first, ready = first + len(ready), []
        if ready:
            yield sequence_batch(part, first, ready)

    packed = docs.select(
        F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long"), "text"
    ).mapInArrow(
        run,
        "part long, number long, n_tokens long, ids binary, "
        "pieces array<struct<doc_id:long,start:long,length:long,offset:long,doc_tokens:long>>",
    )
    alone = F.bit_count("n_tokens") == 1
    return packed.select(
        F.shiftleft("part", 33).bitwiseOR(F.col("number")).alias("sequence_id"), "n_tokens",
        F.when(alone, F.col("n_tokens")).otherwise(F.lit(capacity)).cast("long").alias("padded"), "ids", "pieces",
    )


def list_pieces(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of :func:`pack`'s sequences."""
    piece = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return piece.select(
        "p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset"
    )
