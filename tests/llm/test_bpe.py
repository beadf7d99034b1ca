import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import bpe_automaton
from riskloom.llm.common import table
from tests.llm.cases import FOLDER, ODD, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe_automaton.Codec.read(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz' 019.,-_éßΣςüſ½²一क्́\x1c\x85 😀"
    return ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(3000)] + ["aaaa" * 50, "a" * 5000]


def test_encode_and_decode_as_the_library(codec, library, spark):
    texts = [t or "" for t in ODD] + odd_texts() + [r.text for r in table(spark, FOLDER, "documents").select("text").collect()]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_automaton_accepts_only_what_merges_make():
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("b", "aa"), ("aa", "aa")]
    tokens = ["a", "b", *("".join(m) for m in merges)]
    made = bpe_automaton.Automaton({t: i for i, t in enumerate(dict.fromkeys(tokens))}, merges)

    def plain(word):
        parts = list(word)
        for u, v in merges:
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [u, v]:
                    out, i = [*out, u + v], i + 2
                else:
                    out, i = [*out, parts[i]], i + 1
            parts = out
        return parts

    words = [format(n, "b").replace("0", "a").replace("1", "b") for n in range(1, 4096)]
    assert all([made.labels[i] for i in made.path(w.encode())] == plain(w) for w in words)


def test_queries_over_tables(spark, library):
    docs = documents(spark, ODD)
    rows = bpe_automaton.round_trip(docs, PATH).orderBy("doc_id").collect()
    encoded = bpe_automaton.encode(docs, PATH)
    assert {r.doc_id: r.text for r in bpe_automaton.decode(encoded, PATH).collect()}.keys() == set(range(len(ODD)))
    for row, text in zip(rows, ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_automaton.round_trip(empty(spark), PATH).count() == 0
