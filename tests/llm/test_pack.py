from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import cutting_stock
from riskloom.llm.common import table
from tests.llm.cases import FOLDER, ODD, documents, empty
from tests.llm.test_bpe import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_as_the_library(spark, library):
    texts = [*ODD, *odd_texts(), *[r.text for r in table(spark, FOLDER, "documents").select("text").collect()]]
    coder = cutting_stock.ByteBpe(open(PATH, encoding="utf-8").read())
    for text in texts:
        data = coder.encode(text)
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def check(pieces, ids):
    """Every id in one piece, sequences without gaps, little padding; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == ids.keys()
    for doc_id, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc_id])
            at += p.length
            assert p.ids_crc32 == crc32(np.asarray(ids[doc_id][p.start : at], "<u4").tobytes())
        assert at == len(ids[doc_id])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, sum(map(len, ids.values())))


def test_pieces_of_all_texts(spark, library):
    texts = [*ODD, *[r.text for r in table(spark, FOLDER, "documents").select("text").collect()] * 3]
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    pieces = cutting_stock.pack(documents(spark, texts), PATH).collect()
    assert check(pieces, ids) < 0.01
    assert cutting_stock.pack(empty(spark), PATH).count() == 0


def test_repeated_rows_are_packed_one_by_one(spark):
    rows = spark.createDataFrame([(7, "some words")] * 5 + [(None, "x")], "doc_id long, text string")
    pieces = cutting_stock.pack(rows, PATH).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert sum(p.length for p in pieces if p.doc_id == 7) == 5 * 3


def test_column_generation_comes_near_its_bound():
    draw = np.random.default_rng(5)
    lengths, demand = np.unique(draw.integers(1, 128, 20_000), return_counts=True)
    solved = cutting_stock.Patterns(lengths, demand.astype(float), 128, cutting_stock.PackSetting())
    assert np.allclose(solved.columns @ solved.used, demand) and (solved.columns.T @ lengths <= 128).all()
    assert solved.used.sum() <= 1.01 * (lengths @ demand) / 128
