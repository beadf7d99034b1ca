"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Per batch, the tokens of both sides lie on one line of byte offsets, keyed by document. An as-of merge finds for the start of
each token of one side the token of the other side that covers it, and the other way round. Two tokens overlap exactly if one
of the two starts lies in the other token, so both directions together are all overlaps. Offsets where tokens of both sides
end cut a document into groups.

How many documents hold a pair of ids linked is counted by Spark over the whole corpus. Pairs that many documents hold are at
most `heavy`, and are sent to all tasks; the others are few per key and are joined by a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe_automaton import byte_letters
from riskloom.llm.common import slices, stored
from riskloom.llm.cutting_stock import ByteBpe


@dataclass(frozen=True)
class AlignSetting:
    """batch: about how many bytes of text are aligned at once; heavy: most pairs that are sent to all tasks."""

    batch: int = 1 << 20
    heavy: int = 100_000


class ByteSide(ByteBpe):
    """Ids by a byte-level vocabulary; strings of special tokens are plain text. `bytes` by id."""

    def __init__(self, content: str) -> None:
        super().__init__(content)
        self.special, self.cut = {}, None
        codes = {letter: b for b, letter in byte_letters().items()}
        entries = json.loads(content)["model"]["vocab"]
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            if all(letter in codes for letter in entry):
                self.bytes[number] = bytes([codes[letter] for letter in entry])

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode(" " + t), "<u4").astype(np.int64) for t in texts]


class PieceSide:
    """Ids by a sentencepiece model, which puts a space in front. `bytes` by id."""

    def __init__(self, model: bytes) -> None:
        self.model, self.processor = model, sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(i) for i in range(self.processor.get_piece_size())]

    def _bytes(self, number: int) -> bytes:
        piece = self.processor.id_to_piece(number)
        if self.processor.is_byte(number):
            return bytes([int(piece[1:-1], 16)])  # <0xHH>
        return piece.replace("▁", " ").encode()

    def __getstate__(self):
        return self.model

    def __setstate__(self, model: bytes) -> None:
        self.__init__(model)

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.processor.encode(texts, num_threads=1)]


class Aligner:
    """Alignment of batches of texts. `a` and `b` tokenize a text with a space in front and know the bytes of an id."""

    def __init__(self, a: ByteSide, b: PieceSide) -> None:
        self.sides = (a, b)

    def _prepare(self) -> None:
        """Sizes of ids, and their digits followed by a comma or by what ends a group on this side."""
        if not hasattr(self, "sizes"):
            self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
            self.inner = [np.array([f"{i}," for i in range(len(s))], object) for s in self.sizes]
            self.outer = [np.array([f"{i}{end}" for i in range(len(s))], object) for s, end in zip(self.sizes, "|;")]

    def __getstate__(self):
        return self.sides

    def __setstate__(self, sides) -> None:
        self.sides = sides

    def align(self, texts: list[str | None]) -> pa.Table:
        """A row for each text: n_a, n_b, n_groups, n_links, groups_sha256, its pairs a and b, and how often each is linked."""
        self._prepare()
        given = [t or "" for t in texts]
        found = [side.tokens(given) for side in self.sides]
        for i, text in enumerate(given):
            whole = b" " + text.encode()
            if not text or any(b"".join([side.bytes[n] for n in ids[i].tolist()]) != whole for side, ids in zip(self.sides, found)):
                found[0][i] = found[1][i] = np.zeros(0, np.int64)
        counts = [np.array([len(x) for x in ids], np.int64) for ids in found]
        ids = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        frames, ends = [], []
        for side, (numbers, n) in enumerate(zip(ids, counts)):
            end = np.cumsum(self.sizes[side][numbers])
            ends.append(end)
            frames.append(pd.DataFrame({"at": end - self.sizes[side][numbers], "document": np.repeat(np.arange(len(n)), n), "token": np.arange(len(numbers))}))
        a, b = frames
        under = pd.merge_asof(a, b, on="at", by="document", suffixes=("_a", "_b"))  # the B token at each A token's start
        over = pd.merge_asof(b, a, on="at", by="document", suffixes=("_b", "_a"))
        over = over[a["at"].to_numpy()[over["token_a"].to_numpy(np.int64)] != over["at"].to_numpy()]  # equal starts are there already
        link_a = np.concatenate([under["token_a"].to_numpy(np.int64), over["token_a"].to_numpy(np.int64)])
        link_b = np.concatenate([under["token_b"].to_numpy(np.int64), over["token_b"].to_numpy(np.int64)])
        return self._rows(ids, counts, ends, link_a, link_b, np.concatenate([under["document"], over["document"]]).astype(np.int64))

    def _rows(self, ids, counts, ends, link_a, link_b, document) -> pa.Table:
        closed = [np.isin(ends[0], ends[1]), np.isin(ends[1], ends[0])]  # bytes of documents follow each other
        group = [np.cumsum(c) - c for c in closed]
        size = [np.bincount(g, minlength=int(closed[0].sum())) for g in group]
        before = [np.concatenate([[0], np.cumsum(s)]) for s in size]
        words = np.empty(len(ids[0]) + len(ids[1]), object)  # A's tokens of a group, then B's
        for side, place in ((0, np.arange(len(ids[0])) + before[1][group[0]]), (1, np.arange(len(ids[1])) + before[0][group[1] + 1])):
            words[place] = np.where(closed[side], self.outer[side][ids[side]], self.inner[side][ids[side]])
        first = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        groups = np.concatenate([[0], np.cumsum(closed[0])])[first[0]]
        order = np.argsort(document, kind="stable")
        keys = (ids[0][link_a] << 32 | ids[1][link_b])[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=len(counts[0])))])
        digests, pairs, often = [], [], []
        for i in range(len(counts[0])):
            part = words[first[0][i] + first[1][i] : first[0][i + 1] + first[1][i + 1]].tolist()
            digests.append(sha256("".join(part)[:-1].encode()).hexdigest() if part else "")
            pair, k = np.unique(keys[cuts[i] : cuts[i + 1]], return_counts=True)
            pairs.append(pair), often.append(k)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
        pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        lists = [pair >> 32, pair & 0xFFFFFFFF, np.concatenate(often) if often else np.zeros(0, np.int64)]
        return pa.table(
            {"n_a": counts[0], "n_b": counts[1], "n_groups": np.diff(groups), "n_links": np.diff(cuts), "groups_sha256": pa.array(digests, pa.string()),
             **{name: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for name, x in zip(("a", "b", "times"), lists)}}
        )


def linked(documents: DataFrame, aligner: Aligner, setting: AlignSetting = AlignSetting()) -> DataFrame:
    """Of each row of `documents` (doc_id, text): doc_id, counts, groups_sha256, and its distinct linked id pairs as lists a, b
    and times (how often each is linked)."""
    shared = documents.sparkSession.sparkContext.broadcast(aligner)  # as large as the two vocabularies

    def run(source):
        for batch in source:
            for part in slices(batch, setting.batch):
                rows = shared.value.align(part.column(1).to_pylist())
                yield from rows.add_column(0, "doc_id", part.column(0)).combine_chunks().to_batches()

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lists = "a array<int>, b array<int>, times array<int>"
    return source.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {lists}")


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, documents (how many rows of `held` hold the pair linked) and best (no pair of this a has more)."""
    pairs = held.select(F.explode(F.arrays_zip("a", "b")).alias("pair")).select("pair.*")
    counts = stored(pairs.groupBy("a", "b").agg(F.count("*").alias("documents")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), "a").withColumn("best", F.col("documents") == F.col("most")).drop("most")  # one row per A id


def summed(rows: DataFrame) -> DataFrame:
    value: Column = F.col("times").cast("long")
    return rows.groupBy("row").agg(F.sum(F.when(F.col("best"), value).otherwise(0)).alias("n_best"), F.sum(value * F.col("documents")).alias("count_sum"))


def compare(documents: DataFrame, byte_path: str, piece_path: str, setting: AlignSetting = AlignSetting()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of `documents` (doc_id, text).

    A is the byte-level vocabulary at `byte_path` over a space and the text, B the sentencepiece model at `piece_path` over the
    text. A text that is null, empty, or that one side changes has no tokens: zeros and an empty digest. Rows that repeat a
    doc_id are documents of their own. Columns but doc_id and text are not read. Without rows nothing returns.
    """
    with open(byte_path, encoding="utf-8") as byte_file, open(piece_path, "rb") as piece_file:
        aligner = Aligner(ByteSide(byte_file.read()), PieceSide(piece_file.read()))
    held = stored(linked(documents, aligner, setting).withColumn("row", F.monotonically_increasing_id()), "linked_tokens")
    counts = stored(pair_counts(held), "pair_ranks")
    pairs = held.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("pair")).select("row", "pair.*")
    total = counts.agg(F.sum("documents")).first()[0] or 0
    often = F.col("documents") > total // setting.heavy  # fewer than `heavy` pairs, as their documents add up to `total`
    heavy, light = F.broadcast(counts.where(often)), counts.where(~often)
    sums = summed(pairs.join(heavy, ["a", "b"]))
    if not light.isEmpty():
        rare = pairs.join(F.broadcast(counts.where(often).select("a", "b")), ["a", "b"], "left_anti")
        sums = sums.unionByName(summed(rare.join(light, ["a", "b"])))
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    zero = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("n_best", "count_sum")]
    return held.join(sums, "row", "left").select(*facts, *zero, "groups_sha256")
