import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import tensored_minhash
from riskloom.llm.common import table
from riskloom.llm.components import components
from tests.llm.cases import FOLDER, ODD, documents, empty


def plain_groups(texts, width, percent=80):
    """Smallest number of each text's group, by comparing all pairs."""
    sets = []
    for text in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and 100 * same >= percent * (len(a) + len(sets[j]) - same):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(draw, words, share):
    return " ".join("".join(draw.choices("abcdefgh", k=6)) if draw.random() < share else w for w in words)


def near_copies():
    """A core of light edits, stragglers near the limit, chains, and a passage that other texts share."""
    draw = random.Random(4)
    base = ["".join(draw.choices("klmnopqr", k=5)) for _ in range(150)]
    texts = [edited(draw, base, share) for share in [0.02] * 60 + [0.06] * 60 + [0.1] * 40]
    chain = [" ".join(f"w{i}" for i in range(k, k + 80)) for k in range(0, 60, 5)]
    passage = " ".join(base[:40])
    shared = [passage + " " + " ".join("".join(draw.choices("stuvwxyz", k=5)) for _ in range(40)) for _ in range(60)]
    return [*texts, *chain, *chain[:3], *shared, *ODD]


@pytest.mark.parametrize("width", [2, 5])
def test_groups_against_all_pairs(spark, width):
    texts = near_copies() + [r.text for r in table(spark, FOLDER, "documents").select("text").collect()]
    setting = tensored_minhash.MinHashSetting(words=width, block=16)
    rows = tensored_minhash.near_duplicates(documents(spark, texts), setting).orderBy("doc_id").collect()
    groups, sizes = plain_groups(texts, width)
    assert [r.n_shingles for r in rows] == sizes
    assert [r.component_id for r in rows] == groups
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_ids_that_repeat_or_are_null(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(3, same), (3, same), (None, same), (5, same), (None, None)], "doc_id long, text string")
    out = tensored_minhash.near_duplicates(rows).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out)[:2] == [("3", "3", True), ("3", "3", True)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id == 5] == [(3, False)]
    assert all(r.kept for r in out if r.doc_id is None) and len(out) == 5
    assert tensored_minhash.near_duplicates(empty(spark)).count() == 0


def test_pairs_near_the_limit_share_a_table():
    """The share of pairs of similarity 0.8 that no table joins, over many draws of minhashes."""
    setting = tensored_minhash.MinHashSetting(words=1)
    draw, missed = np.random.default_rng(3), 0
    p = 0.8**setting.hashes
    hit = draw.random((200_000, setting.collections)) < p
    met = np.zeros(len(hit), bool)
    for step in setting.steps:
        met |= (hit & np.roll(hit, -step, axis=1)).any(1)
    missed = (~met).mean()
    assert missed < 0.0005


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 140), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
