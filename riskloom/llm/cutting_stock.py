"""Packing of documents into sequences as a cutting-stock problem.

A document gives full sequences and a rest. The lengths of the rests form a histogram. Column generation over it finds
how often to use which pattern of lengths: a linear program has one row per length, and a knapsack by dynamic programming
prices the next pattern. Rounded patterns are filled with ranked documents of each length. What rounding leaves over is
cut at powers of two, which fill whole sequences.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.bpe_automaton import CLITICS, LETTER, byte_letters, odd
from riskloom.llm.common import batches, stored
from riskloom.session import shuffle_partitions

#: Sequence ids from here on are those of full sequences, so many for each group of rows.
FULL, FULL_EACH = 1 << 44, 1 << 34


@dataclass(frozen=True)
class PackSetting:
    """size: tokens of a sequence, a power of two; slack: most padding in a pattern; unit: tokens that the linear program
    counts as one; gap: it ends this near to its bound; rounds: or after so many patterns; passes: how often it runs; group: about how many
    documents are ranked in one task.
    """

    size: int = 1024
    slack: int = 8
    unit: int = 8
    gap: float = 0.002
    rounds: int = 2000
    passes: int = 3
    group: int = 20_000


# --- Token ids ---------------------------------------------------------------------------------------------------------


class Words(dict):
    """Ids of words as bytes, filled as words come."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        self[word] = made = struct.pack(f"<{len(ids)}I", *ids)
        return made


class ByteBpe:
    """Ids of whole texts by a byte-level vocabulary of the tokenizers library, as little-endian 32-bit numbers.

    Texts are split into words here, and a word is encoded once: most words come again and again.
    """

    fast = re.compile(rf" ?{LETTER}++| ?\d++|{CLITICS}| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+")
    exact = regex.compile(
        rf"{CLITICS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\p{{White_Space}}\p{{L}}\p{{N}}]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"
    )

    def __init__(self, content: str) -> None:
        self.content = content
        self.special = {t["content"]: t["id"] for t in json.loads(content)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = [byte_letters()[b] for b in range(256)]
        self.words, self.model = Words(self._ids), None

    def __getstate__(self):
        return self.content

    def __setstate__(self, content: str) -> None:
        self.__init__(content)

    def _ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        if self.model is None:
            self.model = Tokenizer.from_str(self.content).model
        letters = self.letters
        return [token.id for token in self.model.tokenize("".join([letters[b] for b in word.encode()]))]

    def encode(self, text: str | None) -> bytes:
        words: list[str] = []
        for piece in self.cut.split(text or "") if self.cut else [text or ""]:
            if piece in self.special:
                words.append(piece)
            else:
                words += (self.exact if odd(piece) else self.fast).findall(piece)
        if len(self.words) > 1_000_000:  # a memo, not a result
            self.words.clear()
        known = self.words
        return b"".join([known[w] for w in words])


def tokens(documents: DataFrame, path: str, setting: PackSetting = PackSetting()) -> DataFrame:
    """Of each row: doc_id, doc_tokens, CRCs of its full pieces, of its rest, and of the rest cut at powers of two.

    Ids are followed by id 0; a null text has that one alone.
    """
    with open(path, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(ByteBpe(file.read()))  # as large as its vocabulary
    size = setting.size

    def run(batch: pa.RecordBatch) -> pa.Table:
        rows = []
        for text in batch.column(1).to_pylist():
            data = shared.value.encode(text) + b"\0\0\0\0"
            n = len(data) // 4
            whole = n - n % size
            full = [crc32(data[4 * at : 4 * (at + size)]) for at in range(0, whole, size)]
            cuts, at = [], whole
            for length in powers(n - whole):
                cuts.append(crc32(data[4 * at : 4 * (at + length)]))
                at += length
            rows.append((n, full, n - whole, crc32(data[4 * whole :]) if n > whole else None, cuts))
        n, full, rest, rest_crc, cuts = zip(*rows)
        longs = pa.list_(pa.int64())
        return pa.table(
            {"doc_id": batch.column(0), "doc_tokens": pa.array(n, pa.int64()), "full": pa.array(full, longs), "rest": pa.array(rest, pa.int32()),
             "rest_crc": pa.array(rest_crc, pa.int64()), "cuts": pa.array(cuts, longs)}
        )

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return batches(source, run, "doc_id long, doc_tokens long, full array<long>, rest int, rest_crc long, cuts array<long>")


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


# --- Patterns ----------------------------------------------------------------------------------------------------------


class Patterns:
    """Column generation for min sum(x) with patterns * x = demand; the basis is kept as its inverse.

    lengths: in units, ascending; size: units of a sequence.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, size: int, setting: PackSetting) -> None:
        self.lengths, self.size = lengths, size
        each = size // lengths
        self.columns = np.diag(each).astype(np.float64)  # one length as often as it fits
        self.inverse = np.diag(1.0 / each)
        self.used = demand / each
        area = float(lengths @ demand) / size
        for _ in range(setting.rounds):
            pattern, value = self.best(self.inverse.sum(0))
            total = self.used.sum()
            if value <= 1 + 1e-9 or total - max(area, total / value) <= setting.gap * total:
                break
            self._enter(pattern)

    def best(self, worth: np.ndarray) -> tuple[np.ndarray, float]:
        """The most worthy pattern: what fits into each room, from smaller rooms on."""
        room, taken = np.zeros(self.size + 1), np.full(self.size + 1, -1)
        useful = worth > 1e-12
        lengths, worths, index = self.lengths[useful], worth[useful], np.flatnonzero(useful)
        stop = np.searchsorted(lengths, np.arange(self.size + 1), side="right")
        for c in range(1, self.size + 1):
            room[c] = room[c - 1]
            if stop[c]:
                here = room[c - lengths[: stop[c]]] + worths[: stop[c]]
                k = int(here.argmax())
                if here[k] > room[c] + 1e-13:
                    room[c], taken[c] = here[k], k
        pattern, c = np.zeros(len(worth)), self.size
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                pattern[index[taken[c]]] += 1
                c -= int(lengths[taken[c]])
        return pattern, float(room[self.size])

    def _enter(self, pattern: np.ndarray) -> None:
        step = self.inverse @ pattern
        ratio = np.where(step > 1e-9, self.used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        least = ratio[out]
        self.used = np.maximum(self.used - least * step, 0)
        self.used[out] = least
        row = self.inverse[out] / step[out]
        self.inverse -= np.outer(step, row)
        self.inverse[out] = row
        self.columns[:, out] = pattern


class Rounding:
    """Whole times of patterns of exact lengths: a list of (lengths, times).

    The linear program counts in units of `setting.unit` tokens. A pattern of its solution is filled with exact lengths
    that round to its units and leave at most `setting.slack` tokens of a sequence. The lengths that are left over are
    filled longest first. Lengths that find no such pattern stay in `left`.
    """

    def __init__(self, demand: dict[int, int], setting: PackSetting) -> None:
        self.left, self.size, self.slack = dict(demand), setting.size, setting.slack
        self.chosen: list[tuple[list[int], int]] = []
        self.by_unit: dict[int, list[int]] = {}
        for n in sorted(demand):
            self.by_unit.setdefault(max(1, round(n / setting.unit)), []).append(n)
        for _ in range(setting.passes):  # each solves what the one before left over
            self._solve(setting)
        self._rest()

    def _solve(self, setting: PackSetting) -> None:
        total = {u: sum(self.left[n] for n in lengths) for u, lengths in self.by_unit.items()}
        units = np.array(sorted(u for u, n in total.items() if n), np.int64)
        if not len(units):
            return
        demand = np.array([total[u] for u in units.tolist()], np.float64)
        solved = Patterns(units, demand, setting.size // setting.unit, setting)
        for k in np.argsort(-solved.used, kind="stable"):
            items = [int(u) for u, n in zip(units[::-1], solved.columns[::-1, k]) for _ in range(int(n))]
            self._fill(items, int(solved.used[k] + 1e-6))

    def _take(self, lengths: list[int], most: int) -> int:
        times = min([most, *(self.left[n] // lengths.count(n) for n in set(lengths))])
        for n in lengths:
            self.left[n] -= times
        if times:
            self.chosen.append((lengths, times))
        return times

    def _fill(self, items: list[int], times: int) -> None:
        while times > 0 and (lengths := self._exact(items)):
            times -= self._take(lengths, times)

    def _exact(self, items: list[int]) -> list[int] | None:
        """Exact lengths for the units `items`: the most frequent ones, and two at the end that fill the sequence."""
        picked: list[int] = []
        for u in items[:-2]:
            free = [n for n in self.by_unit[u] if self.left[n] > picked.count(n)]
            if not free:
                return None
            picked.append(max(free, key=lambda n: self.left[n]))
        room = self.size - sum(picked)
        ends = [self.by_unit[u] for u in items[-2:]]
        pairs = [(a, b) for a in ends[0] for b in ends[1]] if len(ends) == 2 else [(a,) for a in ends[0]]
        best, most = None, 0
        for pair in pairs:
            if 0 <= room - sum(pair) <= self.slack:
                both = [*picked, *pair]
                times = min(self.left[n] // both.count(n) for n in set(pair))
                if times > most:
                    best, most = both, times
        return best

    def _rest(self) -> None:
        lengths = sorted((n for n, k in self.left.items() if k), reverse=True)
        for k, longest in enumerate(lengths):
            while self.left[longest]:
                picked, room = [], self.size
                for n in lengths[k:]:
                    count = min(self.left[n], room // n)
                    picked += [n] * count
                    room -= n * count
                if room > self.slack:
                    break  # these are cut
                self._take(picked, self.left[longest])


class Plan:
    """Where the document of a length and a rank goes; as large as the histogram, whatever the number of documents."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, setting: PackSetting) -> None:
        self.size, self.lengths, self.bits = setting.size, lengths, setting.size.bit_length() - 1
        patterns = Rounding(dict(zip(lengths.tolist(), demand.tolist())), setting).chosen
        blocks: dict[int, list[tuple[int, int, int]]] = {int(n): [] for n in lengths}  # first rank, sequence, offset
        filled, sequence = dict.fromkeys(blocks, 0), 0
        for picked, times in patterns:
            offset = 0
            for length in picked:
                blocks[length].append((filled[length], sequence, offset))
                filled[length] += times
                offset += length
            sequence += times
        self.blocks = {n: np.array(b, np.int64).reshape(-1, 3) for n, b in blocks.items()}
        self.filled, self.sequences = filled, sequence
        # Cut rests: pieces of one size lie in a row, larger sizes first, so none crosses the end of a sequence.
        self.before, count = {}, np.zeros(self.bits, np.int64)
        for n, demanded in zip(lengths, demand):
            self.before[int(n)] = count.copy()
            count += (int(demanded) - filled[int(n)]) * (int(n) >> np.arange(self.bits) & 1)
        sizes = 1 << np.arange(self.bits)
        self.base = np.array([int((count * sizes)[k + 1 :].sum()) for k in range(self.bits)])
        self.whole = int((count * sizes).sum()) // self.size  # sequences that cut pieces fill

    def rest(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of each piece of a rest."""
        if rank < self.filled[length]:
            block = self.blocks[length]
            first, sequence, offset = block[np.searchsorted(block[:, 0], rank, side="right") - 1]
            yield length, int(sequence) + rank - int(first), int(offset)
            return
        for piece in powers(length):
            k = piece.bit_length() - 1
            number = int(self.before[length][k]) + rank - self.filled[length]
            at = int(self.base[k]) + number * piece
            sequence, offset = divmod(at, self.size)
            if sequence < self.whole:
                yield piece, self.sequences + sequence, offset
            else:  # what fills no sequence: each piece is one, of a power of two
                yield piece, self.sequences + self.whole + offset, 0


def pack(documents: DataFrame, path: str, setting: PackSetting = PackSetting()) -> DataFrame:
    """Pieces of all rows of `documents` (doc_id, text) in sequences of `setting.size` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. A null or empty text is id 0 alone.
    Repeated rows are packed one by one. An empty table gives no pieces. Other columns are ignored.
    """
    spark = documents.sparkSession
    coded = stored(tokens(documents, path, setting), "tokens")
    histogram = coded.where("rest > 0").groupBy("rest").count().orderBy("rest").collect()  # a row per length
    lengths = np.array([r["rest"] for r in histogram], np.int64)
    plan = spark.sparkContext.broadcast(Plan(lengths, np.array([r["count"] for r in histogram], np.int64), setting))
    groups = max(4 * shuffle_partitions(spark), -(-sum(r["count"] for r in histogram) // setting.group))
    order = ["doc_id", "rest_crc", "doc_tokens", "full"]
    grouped = coded.withColumn("group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = Window.partitionBy("group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = grouped.withColumns(
        {
            "place": F.row_number().over(Window.partitionBy("group", "rest").orderBy(*order)) - 1,
            "full_before": F.coalesce(F.sum(F.size("full")).over(before), F.lit(0)),
        }
    )
    counts = grouped.groupBy("rest", "group").count()
    earlier = Window.partitionBy("rest").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("rest", "group", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    ranked = ranked.join(offsets, ["rest", "group"]).select(
        "doc_id", "doc_tokens", "full", "rest", "rest_crc", "cuts",
        (F.col("place") + F.col("earlier")).alias("rank"),
        (F.lit(FULL) + F.col("group") * FULL_EACH + F.col("full_before")).alias("first"),
    )
    size = setting.size

    def place(batch: pa.RecordBatch) -> pa.Table:
        out: list[tuple] = []
        for row in batch.to_pylist():
            n, doc_id = row["doc_tokens"], row["doc_id"]
            out += [(doc_id, k * size, size, crc, n, row["first"] + k, 0) for k, crc in enumerate(row["full"])]
            at, pieces = len(row["full"]) * size, list(plan.value.rest(row["rest"], row["rank"])) if row["rest"] else []
            for (length, sequence, offset), crc in zip(pieces, [row["rest_crc"]] if len(pieces) == 1 else row["cuts"]):
                out.append((doc_id, at, length, crc, n, sequence, offset))
                at += length
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, zip(*out))})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return batches(ranked, place, schema)
