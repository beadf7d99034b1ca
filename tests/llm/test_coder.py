import random
import struct
import time
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import mixing_coder as coder
from riskloom.llm.common import table
from riskloom.session import run_folder
from tests.llm.cases import FOLDER, ODD, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def back(blocks):
    wide = [bool(b.max(initial=0) >= 1 << 16) for b in blocks]
    return coder.decode(coder.encode(blocks), [len(b) for b in blocks], wide)


def same(blocks):
    blocks = [np.asarray(b, np.uint32) for b in blocks]
    return all(np.array_equal(a, b) for a, b in zip(blocks, back(blocks), strict=True))


def test_blocks_of_all_kinds_come_back():
    draw = np.random.default_rng(0)
    assert same([draw.integers(0, 5, 1000), draw.integers(0, 50_000, 700), draw.integers(0, 2**32, 300), np.zeros(4096), np.arange(4096)])
    assert same([[7], [], [2**32 - 1] * 50, np.tile(draw.integers(0, 60_000, 37), 60), draw.zipf(1.2, 3000) % 50_000])
    assert same([]) and same([[]]) and same([[0]])


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=80), max_size=5))
@settings(deadline=None, max_examples=60)
def test_any_blocks_come_back(blocks):
    assert same(blocks)


def test_a_block_depends_on_no_other():
    draw = np.random.default_rng(1)
    blocks = [(draw.zipf(1.3, n) % 5000).astype(np.uint32) for n in (900, 30, 900, 1)]
    assert coder.encode(blocks) == [coder.encode([b])[0] for b in blocks]


def test_predictions_save_room():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 50_000, 400)
    text = words[(draw.zipf(1.3, 4096) - 1) % 400].astype(np.uint32)
    repeated = np.tile(words[:256].astype(np.uint32), 16)
    free, known = coder.encode([text])[0], coder.encode([repeated])[0]
    counts = np.unique(text, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / 4096)).sum() / 8
    assert len(free) < 1.15 * (entropy + 400 * 2) and len(known) < len(coder.encode([repeated[:256]])[0]) + 300


def test_coding_is_cheap_for_each_id():
    draw = np.random.default_rng(3)
    blocks = list((draw.zipf(1.3, (1024, 1024)) % 5000).astype(np.uint32))
    coder.encode(blocks[:1])  # tables made once

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: back(blocks)) < 18 * seconds(lambda: sum(range(2_000_000)))


def test_numbers_in_order_come_back():
    draw = np.random.default_rng(4)
    for n, top in ((1, 0), (1, 2**32 - 1), (500, 49_999), (4096, 4096), (3, 2**32 - 1), (700, 5)):
        numbers = np.sort(draw.integers(0, top + 1, n))
        found, end = coder.unpacked(b"x" + coder.packed(numbers, top) + b"y", 1, n, top)
        assert found.tolist() == numbers.tolist() and end == 1 + len(coder.packed(numbers, top))


def test_long_blocks_come_back():
    draw = np.random.default_rng(5)
    assert same([draw.zipf(1.2, 70_000) % 50_000, draw.integers(0, 2**32, 5000), [9]])
    with pytest.raises(ValueError, match="524,288"):
        coder.encode([np.zeros(524_289, np.uint32)])


def test_records_and_damage():
    block = coder.Block(3, 10, 7, [(5, 2), (None, 1)], np.array([10, 27, 70_000], np.uint32), True)
    line = block.record(4, coder.encode([block.ids])[0])
    assert b"\n" not in line
    [found] = coder.read_records([line])
    assert (found.file, found.block.number, found.block.before, found.block.first_row, found.block.continued) == (4, 3, 10, 7, True)
    assert found.block.documents == block.documents and found.block.ids.tolist() == [10, 27, 70_000]
    for at in range(len(line)):
        with pytest.raises(ValueError):
            coder.read_records([line[:at] + bytes([line[at] ^ 4]) + line[at + 1 :]])


def test_crc_of_pieces():
    draw = random.Random(1)
    parts = [draw.randbytes(n) for n in (0, 1, 70, 16384, 5)]
    assert coder.joined_crc([(crc32(p), len(p)) for p in parts]) == crc32(b"".join(parts))


def expected(rows):
    """Rows of the contract for (doc_id, text) in order."""
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [64, 4096])
def test_odd_texts(spark, block):
    docs = documents(spark, ODD).repartition(3)
    found = coder.round_trip(docs, PATH, coder.CoderSetting(block=block, lanes=16)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(enumerate(ODD))
    assert coder.round_trip(empty(spark), PATH).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "first"), (3, "x y"), (3, "x y"), (3, "other"), (1, None)]
    found = coder.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 3, 3, 3]
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    one = {t: expected([(0, t)])[0][2:] for _, t in rows}
    assert sorted((r.n_tokens, r.ids_crc32) for r in found) == sorted(one[t] for _, t in rows)


def test_files_hold_the_ids_and_a_lost_block_is_seen(spark):
    texts = [r.text for r in table(spark, FOLDER, "documents").orderBy("doc_id").limit(40).collect()]
    folder = run_folder(spark, "files")
    coder.write(documents(spark, texts), PATH, folder, coder.CoderSetting(block=256))
    pieces = coder.read(spark, folder).orderBy("doc_id", "block").collect()
    ids = {}
    for p in pieces:
        assert p.first == (p.doc_id not in ids)
        ids.setdefault(p.doc_id, []).extend(p.ids)
    library = Tokenizer.from_file(PATH)
    assert ids == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    lines = spark.read.option("lineSep", "\n").text(folder)
    other = run_folder(spark, "files")
    lines.limit(lines.count() - 1).write.option("lineSep", "\n").text(other)
    with pytest.raises(ValueError, match="missing"):
        coder.documents_in(spark, other)


def test_query_over_the_table(spark):
    from riskloom.llm.queries import QUERIES

    rows = table(spark, FOLDER, "documents").orderBy("doc_id").select("doc_id", "text").collect()
    found = QUERIES["op12_mixing_coder"](spark, FOLDER).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(rows)
