import json
import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import token_alignment
from riskloom.llm.common import table
from tests.llm.cases import FOLDER, ODD, documents, empty

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [*ODD, " lead", "trail ", "a  b", "a\tb\n\nc", "<s> </s> <unk> <0x41>", "▁▁ x", "日本語😀", " x　y", "é", "ﬁ ½", "\r\n", "x" * 500]


@pytest.fixture(scope="module")
def sides():
    letters = {}
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    for b in range(256):
        letters[chr(b) if b in own else chr(256 + sum(x not in own for x in range(b)))] = b
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    names = {i: bytes(letters.get(c, 0) for c in t) for t, i in json.load(open(BYTE))["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    return lambda t: [(i, names[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


def plain(texts, sides):
    """The rows of the contract, by comparing all tokens of a text with all tokens."""
    rows, corpus = [], Counter()
    for text in texts:
        tokens = [side(text) if text else [] for side in sides]
        if any(b"".join(x for _, x in side) != b" " + (text or "").encode() for side in tokens):
            tokens = [[], []]
        spans = []
        for side in tokens:
            at, places = 0, []
            for i, x in side:
                places.append((at, at + len(x), i))
                at += len(x)
            spans.append(places)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in spans))
            start = end
        links = Counter()
        for s, e, i in spans[0]:
            for t, f, j in spans[1]:
                if s < f and t < e:
                    links[i, j] += 1
        corpus.update(dict.fromkeys(links, 1))
        rows.append((len(spans[0]), len(spans[1]), groups, links))
    most = {}
    for (i, _), n in corpus.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (a, b, len(groups), sum(links.values()), sum(k for (i, j), k in links.items() if corpus[i, j] == most[i]),
         sum(k * corpus[p] for p, k in links.items()), sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a, b, groups, links in rows
    ]


def texts_of(spark):
    draw = random.Random(5)
    letters = "abcdefghij é ß 中 12.,'-\n\t  "
    made = ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(150)]
    some = [r.text[:1500] for r in table(spark, FOLDER, "documents").orderBy("doc_id").limit(60).collect() if r.text]
    return [t if t is None or len(t) < 4000 else t[:4000] for t in ODD_TEXTS] + made + some


@pytest.mark.parametrize("heavy", [100_000, 20, 1])
def test_as_by_all_pairs(spark, sides, heavy):
    texts = texts_of(spark)
    setting = token_alignment.AlignSetting(batch=2000, heavy=heavy)
    found = token_alignment.compare(documents(spark, texts).repartition(3), BYTE, PIECE, setting).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(len(texts)))
    expected = plain(texts, sides)
    for r, e, t in zip(found, expected, texts, strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == e, t


def test_repeated_null_and_no_rows(spark, sides):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None)]
    found = token_alignment.compare(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, PIECE).collect()
    expected = plain([t for _, t in rows], sides)
    assert sorted(r.count_sum for r in found) == sorted(e[5] for e in expected)
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in found if r.doc_id == 2] == [(0, 0, "")]
    assert token_alignment.compare(empty(spark), BYTE, PIECE).count() == 0


def test_a_long_text(spark):
    text = "lorem ipsum dolor " * 20_000
    [row] = token_alignment.compare(documents(spark, [text]), BYTE, PIECE).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups > 60_000
