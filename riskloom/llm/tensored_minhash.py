"""Near-duplicate groups by MinHash with tensored banding.

A few small collections of minhashes are computed, and each gives one half of a key. A table's key combines the halves of
two collections, so many tables of long keys need few minhashes. Documents that share a table's key are candidates, and
links are confirmed on full shingle sets.

A bucket is never expanded into all its pairs. Stars come first: every document is compared with one member of its
bucket, which joins nearly all of a group of copies. Only pairs that are then still in different components are compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import batches, stored
from riskloom.llm.components import components


@dataclass(frozen=True)
class MinHashSetting:
    """words: words of a shingle; percent: least similarity of a link.

    collections, hashes: collections of so many minhashes each; steps: collections i and i + step (in a ring) share a
    table. At a similarity of 0.8 a pair shares no table with a probability of about 0.0002, at 0.85 of about 0.00001.
    stars: rounds of stars; block: rows of a bucket that are compared at once with as many others.
    """

    words: int = 5
    percent: int = 80
    collections: int = 30
    hashes: int = 3
    steps: tuple[int, ...] = (1, 4)
    stars: int = 3
    block: int = 128
    seed: int = 11


class Shingler:
    """Sets of hashed shingles, and minhashes of them."""

    def __init__(self, setting: MinHashSetting) -> None:
        self.setting, self.known = setting, {}
        draw = np.random.default_rng(setting.seed)
        number = setting.collections * setting.hashes
        self.factors = draw.integers(1, 2**63, number, dtype=np.uint64) | np.uint64(1)
        self.masks = draw.integers(0, 2**63, number, dtype=np.uint64)
        self.places = draw.integers(1, 2**63, setting.words, dtype=np.uint64) | np.uint64(1)

    def _hash(self, word: bytes) -> int:
        if len(self.known) > 1_000_000:  # a memo, not a result
            self.known.clear()
        self.known[word] = value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes (64 bits) of the shingles; one for the whole of a shorter text, none without words."""
        words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six ASCII spaces
        known, new = self.known, self._hash
        codes = np.fromiter([known.get(w) or new(w) for w in words], np.uint64, len(words))
        width = min(self.setting.words, len(codes))
        if not width:
            return codes
        total = np.full(len(codes) - width + 1, width, np.uint64)
        for k in range(width):
            total = mixed(total + codes[k : len(codes) - width + 1 + k] * self.places[k])
        return np.unique(total)

    def minhashes(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = (shingles[at : at + 2048, None] ^ self.masks) * self.factors
            np.minimum(out, part.min(0), out=out)
        return out

    def halves(self, minhashes: np.ndarray) -> np.ndarray:
        """One number for each collection."""
        rows = minhashes.reshape(self.setting.collections, self.setting.hashes)
        out = np.arange(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            out = mixed(out + rows[:, k] * self.places[0] + np.uint64(k))
        return out

    def keys(self, halves: np.ndarray) -> np.ndarray:
        """Keys of all tables, from rows of halves."""
        return np.column_stack(
            [mixed(halves * self.factors[step] + np.roll(halves, -step, axis=1)) for step in self.setting.steps]
        )


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(documents: DataFrame, setting: MinHashSetting) -> DataFrame:
    """doc_id, n_shingles, key of the set, and halves of table keys."""
    shingler = Shingler(setting)

    def sign(batch: pa.RecordBatch) -> pa.Table:
        rows, seen = [], {}
        for text in batch.column(1).to_pylist():
            shingles = shingler.shingles(text)
            if not len(shingles):
                rows.append((0, None, None))
                continue
            key = blake2b(shingles.tobytes(), digest_size=16).digest()
            if key not in seen:
                seen[key] = (len(shingles), key, shingler.halves(shingler.minhashes(shingles)).tobytes())
            rows.append(seen[key])
        n, keys, halves = zip(*rows)
        return pa.table(
            {"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()),
             "halves": pa.array(halves, pa.binary())}
        )

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return batches(source, sign, "doc_id long, n_shingles long, set_key binary, halves binary")


def table_keys(nodes: DataFrame, setting: MinHashSetting) -> DataFrame:
    """(key, node) for every table."""
    shingler = Shingler(setting)

    def spread(batch: pa.RecordBatch) -> pa.Table:
        halves = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        keys = shingler.keys(halves)
        node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
        return pa.table({"key": pa.array(keys.ravel().view(np.int64)), "node": pa.array(node)})

    return batches(nodes.select("node", "halves"), spread, "key long, node long")


def confirmed(pairs: DataFrame, texts: DataFrame, setting: MinHashSetting) -> DataFrame:
    """Those of `pairs` (u, v) whose full shingle sets are similar enough. `texts` has node and text."""
    shingler = Shingler(setting)

    def compare(batch: pa.RecordBatch) -> pa.Table:
        last: dict[int, tuple[str, np.ndarray]] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in last or last[node][0] != text:
                if len(last) > 64:
                    last.clear()
                last[node] = (text, shingler.shingles(text))
            return last[node][1]

        keep = []
        for u, v, a, b in zip(*(column.to_pylist() for column in batch.columns)):
            x, y = of(u, a), of(v, b)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= setting.percent * (len(x) + len(y) - same))
        return batch.select(["u", "v"]).filter(pa.array(keep))

    first = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = first.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return batches(both.select("u", "v", "a", "b"), compare, "u long, v long")


def codes(texts: DataFrame, setting: MinHashSetting) -> DataFrame:
    """node and its shingles as sorted 32-bit codes."""
    shingler = Shingler(setting)

    def run(batch: pa.RecordBatch) -> pa.Table:
        made = [np.unique((shingler.shingles(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1).to_pylist()]
        return pa.table({"node": batch.column(0), "codes": pa.array(made, pa.binary())})

    return batches(texts.select("node", "text"), run, "node long, codes binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Only what stands in two sets or more needs a column."""
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.bincount(place, minlength=len(every)) > 1
    column = np.cumsum(shared) - 1
    out, width = np.zeros((len(sets), len(sets)), np.float32), int(shared.sum())
    use = shared[place]
    row, column = row[use], column[place[use]]
    for at in range(0, width, 8192):
        inside = (column >= at) & (column < at + 8192)
        part = np.zeros((len(sets), min(8192, width - at)), np.float32)
        part[row[inside], column[inside] - at] = 1
        out += part @ part.T
    return out


def crossing(rows: DataFrame, codes: DataFrame, setting: MinHashSetting) -> DataFrame:
    """Pairs (u, v) of one bucket and different components that are similar enough, to be confirmed.

    `rows` has key, node and component. In each bucket the component with most rows is cut into blocks, and so are the
    other rows; others meet all blocks of that component and of each other, while it never meets itself. Codes of 32
    bits may let two shingles look like one, so pairs down to one percent below the limit are kept; where a node is surely
    linked with a component, one link is enough.
    """
    size = setting.block
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("key", F.col("main.component").alias("main"), F.col("main.n").alias("most"), "all")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    dealt = rows.join(main, "key").join(codes, "node").withColumns(
        {"large": blocks(F.col("most")), "small": blocks(F.col("all") - F.col("most")), "is_main": F.col("component") == F.col("main")}
    )
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    spread = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    own = at(F.col("small"))
    meets = F.when(
        F.col("is_main"), spread(F.col("small"), lambda x: place("main", at(F.col("large")), x))
    ).otherwise(
        F.concat(
            spread(F.col("large"), lambda x: place("main", x, own)),
            spread(F.col("small"), lambda x: place("other", F.least(x, own), F.greatest(x, own))),
        )
    )
    dealt = dealt.select("key", "node", "component", "codes", F.explode(meets).alias("at")).select("key", "at.*", "node", "component", "codes")

    def compare(group: pa.Table) -> pa.Table:
        node, component = group.column("node").to_numpy(), group.column("component").to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in group.column("codes").to_pylist()]
        n, same = np.array([len(x) for x in sets]), overlaps(sets)
        alike = 100 * same / np.maximum(n[:, None] + n[None, :] - same, 1)
        alike[component[:, None] == component[None, :]] = 0
        u, v = [], []
        for k in np.flatnonzero(alike.max(1) >= setting.percent - 1):
            met: set[int] = set()
            for j in np.argsort(-alike[k], kind="stable"):
                if alike[k, j] < setting.percent - 1:
                    break
                if component[j] not in met:
                    u.append(node[k])
                    v.append(node[j])
                if alike[k, j] >= setting.percent + 1:
                    met.add(component[j])
        u, v = np.array(u, np.int64), np.array(v, np.int64)
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    return dealt.groupBy("key", "side", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(documents: DataFrame, setting: MinHashSetting = MinHashSetting()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group) and kept (whether it is that one).

    Words are split at ASCII white space, with A-Z as a-z. A null or empty text has no shingles and is linked with
    nothing. doc_id is a key: rows that repeat it count as one document, each giving a row; a null doc_id is linked with
    nothing and kept. Equal sets are one node from the start, however many rows hold them. Other columns are ignored.
    """
    signed = stored(signatures(documents, setting), "signatures")
    valid = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = stored(
        valid.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves")),
        "sets",
    )
    keys = table_keys(sets, setting)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = stored(keys.join(shared, "key"), "buckets")
    nodes = rows.select("node").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = stored(texts.join(nodes, "node", "left_semi"), "texts")

    labels = None  # node, component: rows only for nodes with a link
    for turn in range(setting.stars + 1):
        placed = rows.withColumn("component", F.col("node"))
        if labels is not None:
            placed = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = stored(placed, "placed")
        if turn < setting.stars:
            pairs = _stars(placed, turn)
        else:
            pairs = crossing(placed, codes(texts, setting), setting)
        links = stored(confirmed(stored(pairs, "pairs"), texts, setting), "links")
        labels = _joined(labels, links)
    found = sets.select("set_key", "node")
    found = found.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    result = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = result.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _stars(placed: DataFrame, turn: int) -> DataFrame:
    """One pair for every node: with the centre of one of its buckets, if that is of another component."""
    by = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    centre = F.min(F.struct(by.alias("by"), F.col("node").alias("centre"), F.col("component").alias("other")))
    centres = placed.groupBy("key").agg(centre.alias("c")).select("key", "c.*")
    met = placed.join(centres, "key").where("component <> other")
    return met.groupBy(F.col("node").alias("u")).agg(F.min(F.struct("by", "centre")).alias("c")).select("u", F.col("c.centre").alias("v"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: those of before are nodes of a smaller graph."""
    if labels is None:
        return stored(components(links), "labels")
    old = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_old"))
    between = links.join(old("u"), "u", "left").join(old("v"), "v", "left")
    between = between.select(F.coalesce("u_old", "u").alias("u"), F.coalesce("v_old", "v").alias("v"))
    merged = components(between)
    kept = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("newer")), "component", "left")
    kept = kept.select("node", F.coalesce("newer", "component").alias("component"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return stored(kept.unionByName(new), "labels")
