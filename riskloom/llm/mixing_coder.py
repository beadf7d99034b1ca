"""Files of token ids, written with a context-mixing range coder.

Ids are cut into blocks that start from nothing and carry their own checksums, so any block can be read alone. Inside a
block an id is a symbol, its place among the block's distinct ids. The two and the one symbols before it (order 2, order 1)
each predict one symbol, with a count of how often they were right in a row, and learn from every id; order 0 holds the
frequencies of the block. Whether the surer prediction holds is one binary decision: what the counts of both orders and the
frequency of the symbol have been worth in this block is mixed in the logistic domain, with weights that are fitted to the
block, and drives the range coder (rANS). If the prediction fails, the symbol is coded by its order-0 frequency among such
symbols. A block is gone through twice, so distinct ids, frequencies and weights stand at its beginning.

Many blocks are coded side by side, one position at a time, with the same arithmetic in whole numbers on both ways: only the
fit of the weights is not, and the block carries them as whole numbers.

A file is lines of records; a line break or an escape byte inside a record is escaped. Spark writes and reads the lines,
so files lie wherever Spark can write, and a lost task writes its file again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import slices, stored
from riskloom.llm.cutting_stock import ByteBpe
from riskloom.session import run_folder

MAGIC = b"MXR2"
HEAD = struct.Struct("<4sIIQIIIIB")  # magic, file, block, ids before it in the file, first row, documents, ids, their CRC, flags
CONTINUED, WIDE, LAST = 1, 2, 4  # the first document began in the block before; ids of 32 bits; the file ends here
BREAK, ESCAPE = 0x0A, 0x1B


@dataclass(frozen=True)
class CoderSetting:
    """block: most ids in a block, up to 524,288; lanes: most blocks coded side by side; end: id behind every document."""

    block: int = 4096
    lanes: int = 2048
    end: int = 2


# --- Prediction --------------------------------------------------------------------------------------------------------

ORDER2 = 4096  # entries of a block's order-2 table, a part of the format
SURE, AGREE, LEVELS = 4, 2, 4  # counts of an entry; both orders say the same or not; how often order 0 has a symbol
CONTEXTS = SURE * SURE * AGREE * LEVELS
CHANCE, LEAST, WORD = 12, 1 << 31, 32  # bits of a chance; smallest state of the coder; bits of a word


@cache
def logistic() -> np.ndarray:
    """squash, of -2047..2047 (index + 2047), in whole numbers.

    It is the logistic curve with 256 to the unit of its argument and 4096 to that of its value, by exact fractions of a power
    series, so that all machines have the same table.
    """
    one = 1 << 60
    squash = []
    for x in range(-2047, 2048):
        term = total = one
        for k in range(1, 60):  # e^(|x| / 256)
            term = term * abs(x) // (256 * k)
            total += term
        share = 4096 * total // (total + one) if x >= 0 else 4096 * one // (total + one)
        squash.append(min(4095, max(1, share)))
    return np.array(squash, np.uint16)


@cache
def counted(wide: bool) -> np.ndarray:
    """Count of an entry after its symbol came (counts up to 3, index below 16), or another."""
    out = np.ones(1 << 16, np.uint32 if wide else np.uint16)
    out[:16] = np.minimum(np.arange(16) + 1, 3)
    return out


class Predictor:
    """Adaptive predictions of orders 2 and 1 in blocks side by side. An entry is a symbol above 4 bits of count.

    Both orders have one table, so that one operation serves both.
    """

    def __init__(self, kinds: np.ndarray, bits: int) -> None:
        lanes, self.wide = len(kinds), bits > 12
        self.kind = np.uint32 if self.wide else np.uint16
        self.factor, self.shift = (2654435761, 20) if self.wide else (40503, 4)
        self.first1, self.counted = np.cumsum(kinds) - kinds, counted(self.wide)
        self.base = np.stack([np.arange(lanes, dtype=np.int64) * ORDER2, self.first1 + lanes * ORDER2])
        self.table = np.empty(lanes * ORDER2 + int(kinds.sum()), self.kind)
        self.table.fill(0)  # zeros() would get small pages
        self.places, self.before = np.zeros((2, lanes), self.kind), np.zeros(lanes, self.kind)

    def narrow(self, lanes: int) -> None:
        """Only the first `lanes` go on."""
        self.base, self.places, self.before = self.base[:, :lanes].copy(), self.places[:, :lanes].copy(), self.before[:lanes]

    def say(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbol that the order with the larger count expects, and the counts of both as a context of level 0."""
        key, last = self.places
        np.multiply(last, self.factor, out=key)
        key ^= self.before
        key >>= self.shift
        self.at = self.base + self.places
        self.old = self.table.take(self.at)
        order2, order1 = self.old
        sure2, sure1 = self.old & 15
        context = sure2 << 2
        context |= sure1
        context <<= 1
        context |= (order2 ^ order1) < 16
        said = np.where(sure2 >= sure1, order2, order1)
        said >>= 4
        return said, context

    def learn(self, symbol: np.ndarray) -> None:
        self.before = self.places[1] << 4
        self.places[1] = symbol
        mark = symbol << 4
        count = self.old ^ mark
        new = self.counted.take(np.minimum(count, 16) if self.wide else count)
        new |= mark
        self.table[self.at] = new


@cache
def context_parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context its place among the inputs of order 2, of order 1 and of order 0."""
    c = np.arange(CONTEXTS)
    agree, sure1, sure2, level = c & 1, c >> 1 & 3, c >> 3 & 3, c >> 5
    return sure2 << 1 | agree, sure1 << 1 | agree, level


@cache
def possible() -> np.ndarray:
    """Contexts in which an order has an entry."""
    return (context_parts()[0] >= AGREE) | (context_parts()[1] >= AGREE)


INPUTS = (SURE * AGREE, SURE * AGREE, LEVELS)
MIXING = struct.Struct(f"<3h{sum(INPUTS)}b")


def fitted(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of 4096) and inputs (stretched, 16 to the unit) of every block, from misses and hits in its contexts."""
    made = [_fitted(seen[at : at + 64].astype(np.float32)) for at in range(0, len(seen), 64)]
    return np.concatenate([w for w, _ in made]), np.concatenate([i for _, i in made])


def _fitted(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen[:, ~possible()] = 0
    hits, times = np.ascontiguousarray(seen[:, :, 1]), seen.sum(2)
    lanes, inputs, columns = len(times), [], []
    for part, size in zip(context_parts(), INPUTS):
        place = np.zeros((CONTEXTS, size), np.float32)
        place[np.arange(CONTEXTS), part] = 1
        n, h = times @ place, hits @ place
        said = np.rint(16 * np.log((h + 0.4) / (n - h + 0.4))).clip(-127, 127)
        said[n == 0] = 0
        inputs.append(said.astype(np.int8))
        columns.append((said / 16).astype(np.float32)[:, part])
    weights = np.tile(np.array([0.5, 0.4, 0.2], np.float32), (lanes, 1))
    for _ in range(3):  # Newton's method, held near its start where a block says little
        z = sum(weights[:, k, None] * columns[k] for k in range(3))
        p = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
        slope = [((hits - times * p) * c).sum(1) for c in columns]
        bend = times * p * (1 - p)
        curve = np.zeros((lanes, 3, 3), np.float32)
        for k in range(3):
            bent = bend * columns[k]
            for j in range(k + 1):
                curve[:, k, j] = curve[:, j, k] = np.einsum("lc,lc->l", bent, columns[j])
        curve += 2 * np.eye(3, dtype=np.float32)
        weights += np.linalg.solve(curve, np.stack(slope, 1)[..., None])[..., 0].clip(-1, 1)
        weights = weights.clip(-4, 4)
    return np.rint(weights * 4096).astype(np.int16), np.concatenate(inputs, 1)


def chances(weights: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Chance of a hit, of 4096, in every context of every block: its inputs mixed in the logistic domain."""
    total, at = np.zeros((len(weights), CONTEXTS), np.int32), 0
    for order, (part, size) in enumerate(zip(context_parts(), INPUTS)):
        total += (weights[:, order, None].astype(np.int32) * inputs[:, at : at + size])[:, part]
        at += size
    out = logistic().take((total >> 8) + 2047, mode="clip")
    out[:, ~possible()] = 0  # neither order has an entry
    return out.reshape(-1)


# --- Blocks ------------------------------------------------------------------------------------------------------------


def packed(numbers: np.ndarray, top: int) -> bytes:
    """Ascending numbers up to `top`: their high parts as marks in a row of bits, their low bits as they are (Elias-Fano)."""
    low = low_bits(len(numbers), top)
    marks = np.zeros(len(numbers) + (top >> low) + 1, np.uint8)
    marks[(numbers >> low) + np.arange(len(numbers))] = 1
    lows = (numbers[:, None] >> np.arange(low)).astype(np.uint8) & 1
    return np.packbits(np.concatenate([marks, lows.reshape(-1)])).tobytes()


def unpacked(data: bytes, at: int, n: int, top: int) -> tuple[np.ndarray, int]:
    """The `n` numbers that begin at byte `at`, and the byte after them."""
    low = low_bits(n, top)
    marks = n + (top >> low) + 1
    size = (marks + n * low + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=marks + n * low)
    numbers = np.flatnonzero(bits[:marks]) - np.arange(n) << low
    if low:
        numbers += bits[marks:].reshape(n, low) @ (1 << np.arange(low))
    return numbers, at + size


def low_bits(n: int, top: int) -> int:
    return max(0, (top // max(1, n)).bit_length() - 1)


def numbered(ids: np.ndarray, seen: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a block, ascending, and its ids as their numbers. `seen` and `places` are room for 65,536 ids."""
    if int(ids.max()) >= len(seen):
        return np.unique(ids, return_inverse=True)
    seen[ids] = True
    distinct = seen.nonzero()[0]
    seen[distinct] = False
    places[distinct] = np.arange(len(distinct), dtype=places.dtype)
    return distinct, places.take(ids)


def shares(counts: np.ndarray, kinds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts up to each symbol in its block, and start and size of its part of 1 << bits. A count of one has a part."""
    ends = np.cumsum(counts)
    first = np.cumsum(kinds) - kinds
    before = ends[first] - counts[first]
    whole = ends[first + kinds - 1] - before
    ends -= np.repeat(before, kinds)
    starts = np.zeros(len(ends) + 1, np.int64)
    starts[1:] = (ends << bits) // np.repeat(whole, kinds)
    sizes = starts[1:].copy()
    starts[first] = 0
    sizes -= starts[:-1]
    return ends, starts[:-1], sizes


def together(sizes: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Blocks that are coded side by side, longest first, and the bits of their order-0 shares. Empty blocks have no payload."""
    groups: dict[int, list[int]] = {}
    for b in sorted(range(len(sizes)), key=lambda b: -sizes[b]):
        if sizes[b]:
            groups.setdefault(max(12, (sizes[b] - 1).bit_length()), []).append(b)
    if max(groups, default=0) > 19:
        raise ValueError("A block has at most 524,288 ids.")
    yield from groups.items()


@cache
def counts_head(bits: int, wide: bool) -> struct.Struct:
    """Distinct ids, ids that order 0 codes, and the largest id."""
    return struct.Struct(f"<{'HH' if bits < 16 else 'II'}{'I' if wide else 'H'}")


def active(sizes: np.ndarray) -> list[int]:
    """How many of the blocks (longest first) are longer than 0, 1, 2, ... ids."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0]))).tolist()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of ids (unsigned 32-bit), coded side by side."""
    out = [b""] * len(blocks)
    for bits, chosen in together([len(b) for b in blocks]):
        for b, payload in zip(chosen, _encode([blocks[b] for b in chosen], bits)):
            out[b] = payload
    return out


def _encode(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    sizes, lanes = np.array([len(b) for b in blocks]), len(blocks)
    most, known, rows = int(sizes[0]), [], np.zeros((lanes, int(sizes[0])), np.uint32 if bits > 12 else np.uint16)
    seen, places = np.zeros(1 << 16, bool), np.zeros(1 << 16, rows.dtype)
    for row, block in zip(rows, blocks):
        distinct, row[: len(block)] = numbered(block, seen, places)
        known.append(distinct)
    symbols = np.ascontiguousarray(rows.T)
    del rows
    kinds = np.array([len(d) for d in known])
    model, going = Predictor(kinds, bits), active(sizes)
    first, contexts, said = model.first1, np.zeros_like(symbols), np.zeros_like(symbols)
    for step, n in enumerate(going):
        if n < model.base.shape[1]:
            model.narrow(n)
        said[step, :n], contexts[step, :n] = model.say()
        model.learn(symbols[step, :n])
    del model
    hit = said == symbols
    hit &= contexts >= AGREE
    parts = [slice(at, at + 256) for at in range(0, most, 256)]
    there = [np.arange(most)[p, None] < sizes for p in parts]
    counts = np.zeros(int(kinds.sum()), np.int64)
    for p, t in zip(parts, there):
        counts += np.bincount((symbols[p] + first)[t & ~hit[p]], minlength=len(counts))
    ends, starts, widths = shares(counts, kinds, bits)
    level, lane = levels(counts).astype(symbols.dtype), np.arange(lanes) * CONTEXTS
    times = np.zeros(2 * lanes * CONTEXTS, np.int64)
    for p, t in zip(parts, there):
        contexts[p] |= level.take(said[p] + first)
        times += np.bincount(((contexts[p] + lane) * 2 + hit[p])[t], minlength=len(times))
    del said
    weights, inputs = fitted(times.reshape(lanes, CONTEXTS, 2))
    table = chances(weights, inputs)

    state = np.full(lanes, LEAST, np.uint64)
    lows, out = np.zeros((most, lanes), np.uint32), np.zeros((most, lanes), bool)
    for at in range(most - 1 - (most - 1) % 32, -1, -32):
        p = slice(at, at + 32)
        h, s, chance = hit[p], symbols[p] + first, table.take(contexts[p] + lane).astype(np.uint64)
        size1, start1 = np.where(h, chance, (1 << CHANCE) - chance), np.where(h, 0, chance)
        size0, start0 = np.where(h, 1 << bits, widths.take(s)).astype(np.uint64), np.where(h, 0, starts.take(s)).astype(np.uint64)
        rest1, rest0, full = (1 << CHANCE) - size1, (1 << bits) - size0, size1 * size0 << (63 - CHANCE - bits)
        for k in range(len(h) - 1, -1, -1):
            n = going[at + k]
            x = state[:n]
            lows[at + k, :n] = x
            full_now = np.greater_equal(x, full[k, :n], out=out[at + k, :n])
            x = np.where(full_now, x >> WORD, x)
            x += x // size0[k, :n] * rest0[k, :n]
            x += start0[k, :n]
            x += x // size1[k, :n] * rest1[k, :n]
            x += start1[k, :n]
            state[:n] = x
    words, ending = np.ascontiguousarray(lows.T)[out.T].astype("<u4"), np.cumsum(out.sum(0))
    made = []
    for i, distinct in enumerate(known):
        mine = slice(first[i], first[i] + kinds[i])
        head = counts_head(bits, bool(distinct[-1] >= 1 << 16)).pack(kinds[i], ends[mine][-1], distinct[-1])
        head += MIXING.pack(*weights[i].tolist(), *inputs[i].tolist())
        head += packed(distinct.astype(np.int64), int(distinct[-1])) + packed(ends[mine], int(ends[mine][-1]))
        made.append(head + struct.pack("<Q", state[i]) + words[ending[i - 1] if i else 0 : ending[i]].tobytes())
    return made


def levels(counts: np.ndarray) -> np.ndarray:
    """How often order 0 has a symbol, in its place in a context."""
    return (1 * (counts > 1) + (counts > 4) + (counts > 16)) << 5


def decode(payloads: list[bytes], sizes: list[int], wide: list[bool]) -> list[np.ndarray]:
    """The ids of blocks from their payloads."""
    out = [np.zeros(0, np.uint32)] * len(payloads)
    for bits, chosen in together(sizes):
        for b, ids in zip(chosen, _decode([payloads[b] for b in chosen], np.array([sizes[b] for b in chosen]), [wide[b] for b in chosen], bits)):
            out[b] = ids
    return out


def _decode(payloads: list[bytes], sizes: np.ndarray, wide: list[bool], bits: int) -> list[np.ndarray]:
    lanes, known, ends, heads, states, rest = len(payloads), [], [], [], [], []
    for payload, w in zip(payloads, wide):
        counts_of = counts_head(bits, w)
        n, coded, top = counts_of.unpack_from(payload)
        heads.append(MIXING.unpack_from(payload, counts_of.size))
        distinct, at = unpacked(payload, counts_of.size + MIXING.size, n, top)
        end, at = unpacked(payload, at, n, coded)
        known.append(distinct)
        ends.append(end)
        states.append(struct.unpack_from("<Q", payload, at)[0])
        rest.append(payload[at + 8 :])
    mixing = np.array(heads)
    table = chances(mixing[:, :3].astype(np.int16), mixing[:, 3:].astype(np.int8))
    kinds = np.array([len(d) for d in known])
    counts = np.concatenate([np.diff(e, prepend=0) for e in ends])
    _, starts, widths = shares(counts, kinds, bits)
    model, going = Predictor(kinds, bits), active(sizes)
    kind, first = model.kind, model.first1
    parts = (starts << 32 | widths) if bits > 15 else (starts << 16 | widths).astype(np.uint32)
    level = levels(counts).astype(kind)
    names = np.repeat((np.arange(len(counts)) - np.repeat(first, kinds)).astype(kind), widths)  # symbol of every place
    words = np.frombuffer(b"".join(rest) + bytes(8), "<u4").astype(np.int64)
    lengths = np.array([len(r) // 4 for r in rest])
    at, state = np.cumsum(lengths) - lengths, np.array(states, np.int64)
    lane, zero = np.arange(lanes) * CONTEXTS, np.arange(lanes) << bits
    symbols = np.zeros((int(sizes[0]), lanes), kind)
    half, ones = (32, 0xFFFFFFFF) if bits > 15 else (16, 0xFFFF)
    x = state
    for step, n in enumerate(going):
        if n < len(x):
            model.narrow(n)
            x, first, lane, zero, at = x[:n], first[:n], lane[:n], zero[:n], at[:n]
        said, context = model.say()
        context |= level.take(first + said)
        chance = table.take(lane + context).astype(np.int64)
        low = x & ((1 << CHANCE) - 1)
        hit = low < chance
        taken = (x >> CHANCE) * chance
        low += taken  # the state after a hit
        x -= taken
        x -= chance  # after a miss
        place = x & ((1 << bits) - 1)
        symbol = np.where(hit, said, names.take(zero + place))
        part = parts.take(first + symbol).astype(np.int64)
        x >>= bits
        x *= part & ones
        x += place
        x -= part >> half
        x = np.where(hit, low, x)
        short = x < LEAST
        x = np.where(short, x << WORD | words.take(at), x)
        at += short
        symbols[step, :n] = symbol
        model.learn(symbol)
    rows = np.ascontiguousarray(symbols.T)
    return [d.astype(np.uint32)[row[:size]] for d, row, size in zip(known, rows, sizes)]


# --- Records -----------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """ids with the documents they belong to (doc_id or None, and how many ids) and their place in the file."""

    number: int
    before: int
    first_row: int
    documents: list[tuple[int | None, int]]
    ids: np.ndarray
    continued: bool
    last: bool = False

    def record(self, file: int, payload: bytes) -> bytes:
        """The block as one line without a line break; a CRC of all of it stands at the end."""
        flags = CONTINUED * self.continued + WIDE * bool(self.ids.max(initial=0) >= 1 << 16) + LAST * self.last
        n, crc = len(self.documents), crc32(self.ids.astype("<u4").tobytes())
        head = HEAD.pack(MAGIC, file, self.number, self.before, self.first_row, n, len(self.ids), crc, flags)
        names = struct.pack(f"<{n}q", *[d or 0 for d, _ in self.documents]) + bytes(d is None for d, _ in self.documents)
        body = head + names + struct.pack(f"<{n}I", *[k for _, k in self.documents]) + payload
        body += struct.pack("<I", crc32(body))
        return body.replace(b"\x1b", b"\x1b\x01").replace(b"\n", b"\x1b\x02")


@dataclass
class Record:
    file: int
    block: Block
    crc: int
    wide: bool
    payload: bytes

    @classmethod
    def read(cls, line: bytes) -> Record:
        body = line.replace(b"\x1b\x02", b"\n").replace(b"\x1b\x01", b"\x1b")
        if len(body) < HEAD.size + 4 or body[:4] != MAGIC or struct.unpack("<I", body[-4:])[0] != crc32(body[:-4]):
            raise ValueError("A record of a token file is damaged.")
        _, file, number, before, first_row, n, size, crc, flags = HEAD.unpack_from(body)
        at = HEAD.size
        names, missing = struct.unpack_from(f"<{n}q", body, at), body[at + 8 * n : at + 9 * n]
        counts = struct.unpack_from(f"<{n}I", body, at + 9 * n)
        documents = [(None if gone else d, k) for d, gone, k in zip(names, missing, counts)]
        block = Block(number, before, first_row, documents, np.zeros(size, np.uint32), bool(flags & CONTINUED), bool(flags & LAST))
        return cls(file, block, crc, bool(flags & WIDE), body[at + 13 * n : -4])


def read_records(lines: list[bytes]) -> list[Record]:
    """Records with their ids, decoded side by side and checked."""
    records = [Record.read(line) for line in lines]
    ids = decode([r.payload for r in records], [len(r.block.ids) for r in records], [r.wide for r in records])
    for r, found in zip(records, ids):
        if crc32(found.astype("<u4").tobytes()) != r.crc:
            raise ValueError("The ids of a block don't agree with their checksum.")
        r.block.ids = found
    return records


class Cutter:
    """Blocks of the ids of one file, in order."""

    def __init__(self, size: int) -> None:
        self.size, self.number, self.before, self.row = size, 0, 0, 0
        self._open(False)

    def _open(self, continued: bool) -> None:
        self.parts: list[np.ndarray] = []
        self.documents: list[tuple[int | None, int]] = []
        self.first_row, self.room, self.continued = self.row, self.size, continued

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[Block]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.room]
            self.parts.append(part)
            self.documents.append((doc_id, len(part)))
            self.room -= len(part)
            at += len(part)
            if not self.room:
                self.row += at == len(ids)  # the next block begins with the next document
                yield self.close(at < len(ids))
                self.row -= at == len(ids)
        self.row += 1

    def close(self, continued: bool = False) -> Block:
        block = Block(self.number, self.before, self.first_row, self.documents, np.concatenate(self.parts), self.continued)
        self.number, self.before = self.number + 1, self.before + len(block.ids)
        self._open(continued)
        return block


# --- Tables ------------------------------------------------------------------------------------------------------------


def write(documents: DataFrame, path: str, folder: str, setting: CoderSetting = CoderSetting()) -> None:
    """Write the ids of all documents (doc_id, text), by the vocabulary at `path`, as files of records to `folder`.

    Documents are ordered by doc_id; rows of one doc_id by their text's hash and their text, a null doc_id comes first. A null
    text has the end id alone. File 0 holds the first range of documents, file 1 the next, and so on.
    """
    with open(path, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(ByteBpe(file.read()))  # as large as its vocabulary
    end = struct.pack("<I", setting.end)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cutter, waiting = TaskContext.get().partitionId(), Cutter(setting.block), []

        def lines() -> pa.RecordBatch:
            ready = waiting[: setting.lanes]
            del waiting[: setting.lanes]
            made = [b.record(number, p) for b, p in zip(ready, encode([b.ids for b in ready]))]
            return pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

        for batch in source:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.frombuffer(shared.value.encode(text) + end, "<u4")
                    for block in cutter.add(doc_id, ids):
                        waiting.append(block)
                        if len(waiting) > setting.lanes:  # the last block is known at the end
                            yield lines()
        if cutter.parts:
            waiting.append(cutter.close())
        if waiting:
            waiting[-1].last = True
        while waiting:
            yield lines()

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    lined = ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lined.write.option("lineSep", "\n").option("compression", "none").text(folder)


def read(spark: SparkSession, folder: str, ids: bool = True, setting: CoderSetting = CoderSetting()) -> DataFrame:
    """Pieces of documents, one for each block a document lies in.

    file, file_row (place of the document in the file), doc_id, block, first (the piece begins the document), start (ids before
    it in the file), n, ids_crc32, closes (its block is the last of the file) and, if asked for, ids. A damaged record raises.
    """
    schema = "file long, file_row long, doc_id long, block long, first boolean, start long, n long, ids_crc32 long, closes boolean"
    schema += ", ids array<bigint>" if ids else ""
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()] + [pa.list_(pa.int64())] * ids

    def pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.replace("<bigint>", "").split(", ")
        for batch in source:
            for at in range(0, batch.num_rows, setting.lanes):
                rows = []
                for r in read_records(batch.column(0).slice(at, setting.lanes).to_pylist()):
                    b, done = r.block, 0
                    for i, (doc_id, n) in enumerate(b.documents):
                        part = b.ids[done : done + n]
                        row = (r.file, b.first_row + i, doc_id, b.number, i > 0 or not b.continued, b.before + done, n, crc32(part.astype("<u4").tobytes()), b.last)
                        rows.append((*row, part.tolist()) if ids else row)
                        done += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in names])

    lines = spark.read.option("lineSep", "\n").schema("value string").text(folder)
    return lines.select(F.col("value").cast("binary")).mapInArrow(pieces, schema)


@cache
def advanced(zeros: int) -> int:
    """x^(8 * zeros) modulo the polynomial of the CRC, with the bits in its order."""
    out, square, bits = 1 << 31, 1 << 30, 8 * zeros  # 1 and x
    while bits:
        if bits & 1:
            out = product(out, square)
        square, bits = product(square, square), bits >> 1
    return out


def product(a: int, b: int) -> int:
    """Of two polynomials modulo that of the CRC."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """CRC of bytes that follow each other, from the CRCs and the sizes of the pieces."""
    crc = 0
    for part, size in pieces:
        crc = product(advanced(size), crc) ^ part
    return crc


def documents_in(spark: SparkSession, folder: str, setting: CoderSetting = CoderSetting()) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files of `folder`.

    A file whose blocks are not all there raises. Only one row per file reaches the driver.
    """
    pieces = stored(read(spark, folder, False, setting), "token_pieces")
    files = pieces.groupBy("file").agg(
        F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("last"), F.max("block").alias("block"),
        F.countDistinct("block").alias("blocks"), F.max("closes").alias("closed"),
    )
    before, offsets = 0, []
    for f in files.orderBy("file").collect():
        if f.n != f.last or f.blocks != f.block + 1 or not f.closed:
            raise ValueError(f"Blocks of token file {f.file} are missing or there twice.")
        offsets.append((f.file, before))
        before += f.n
    whole = F.count("*").over(Window.partitionBy("file", "file_row")) == 1
    marked = pieces.withColumn("whole", whole)
    one = marked.where("whole").select("file", "doc_id", "start", "n", "ids_crc32")
    cut = marked.where("NOT whole").groupBy("file", "file_row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("block", "ids_crc32", "n"))).alias("pieces"),
    )

    def join(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            crcs = [joined_crc([(p["ids_crc32"], 4 * p["n"]) for p in row]) for row in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["file", "doc_id", "start", "n", "ids_crc32"])

    joined = cut.select("file", "doc_id", "start", "n", "pieces").mapInArrow(join, "file long, doc_id long, start long, n long, ids_crc32 long")
    table = F.broadcast(spark.createDataFrame(offsets, "file long, before long"))  # one row per file
    out = one.unionByName(joined).join(table, "file")
    return out.select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def round_trip(documents: DataFrame, path: str, setting: CoderSetting = CoderSetting()) -> DataFrame:
    """The documents' ids written to files in a new shared folder and read back from them.

    Rows that repeat a doc_id are documents of their own. Columns but doc_id and text are not read. Without documents nothing
    returns.
    """
    spark = documents.sparkSession
    folder = run_folder(spark, "token_files")
    write(documents, path, folder, setting)
    return documents_in(spark, folder, setting)
