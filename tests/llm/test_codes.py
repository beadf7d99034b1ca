import math
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from riskloom.llm import dual_tree_codes as codes
from riskloom.llm.common import table
from tests.llm.cases import FOLDER


def plain(rows, setting):
    """vec_id -> (code, error, label_error) and the digest, by comparing every part with every entry."""
    width = len(rows[0][1]) // setting.parts
    whole = [[math.floor(Fraction(x) * setting.scale) for x in v] for _, v, _ in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(setting.parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[: setting.entries]
    books = [[cut[i][p] for i in first] for p in range(setting.parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), k) for k, e in enumerate(book))

    for _ in range(setting.rounds):
        for p, book in enumerate(books):
            owner = [nearest(c[p], book)[1] for c in cut]
            for k in range(len(book)):
                mine = [c[p] for c, o in zip(cut, owner) if o == k]
                if mine:
                    book[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(setting.parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), error in zip(rows, errors):
        sums[label] = sums.get(label, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    out = [(i, "".join(f"{k:02x}" for _, k in f), e if e < 2**63 else None, sums[label] if sums[label] < 2**63 else None)
           for (i, _, label), f, e in zip(rows, found, errors)]
    return out, sha256(text.encode()).hexdigest()


def check(spark, rows, setting=codes.CodeSetting()):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, code string")
    found = codes.compress(table.repartition(3), setting).collect()
    expected, digest = plain(rows, setting)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, [(r.vec_id, r.code, r.error, r.label_error) for r in found])) == sorted(map(key, expected))
    assert {r.codebooks_sha256 for r in found} == {digest}


def cloud(draw, n, width, spread=0.1):
    centres = draw.normal(size=(9, width))
    return [(i, (centres[i % 9] + spread * draw.normal(size=width)).tolist(), f"l{i % 4}" if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("width,spread", [(8, 0.1), (32, 0.02), (24, 2.0)])
def test_as_by_all_distances(spark, width, spread):
    check(spark, cloud(np.random.default_rng(width), 300, width, spread), codes.CodeSetting(leaf=4))


def test_ties_and_repeated_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(int(draw.integers(0, 30)), (draw.integers(-2, 3, 16) / 4096).tolist(), "a") for _ in range(250)]
    rows += [(None, rows[0][1], None), (None, rows[0][1], None)]
    check(spark, rows, codes.CodeSetting(leaf=2, rounds=3))


def test_fewer_rows_than_entries(spark):
    check(spark, cloud(np.random.default_rng(2), 5, 8))


def test_large_components_are_exact(spark):
    rows = cloud(np.random.default_rng(3), 60, 8)
    rows[3] = (3, [1e9] * 8, "far")
    rows[40] = (40, [-3.0e38, 1e300, 0.0, 1.5, 2.5, -1e17, 7.0, 1.0], "far")
    check(spark, rows, codes.CodeSetting(rounds=3))


def test_rows_that_take_no_part(spark):
    rows = cloud(np.random.default_rng(4), 40, 16)
    odd = [(100, None, "l1"), (101, [float("nan")] * 16, "l1"), (102, [0.0] * 15 + [float("inf")], None), (103, [1.0, None], "l1")]
    short = [(104, [1.0] * 8, "l1"), (105, [], "l1"), (106, [1.0] * 3, None), (107, [1.0] * 24, "new")]
    schema = "vec_id long, embedding array<double>, label string"
    found = {r.vec_id: r for r in codes.compress(spark.createDataFrame(rows + odd + short, schema)).collect()}
    expected, digest = plain(rows, codes.CodeSetting())
    assert set(found) == set(range(40)) | {104, 105, 106, 107}
    assert all(tuple(found[i])[:4] == (i, c, e, s) for i, c, e, s in expected)
    assert all(found[i].code is None and found[i].error is None for i in (104, 105, 106, 107)) and found[107].label_error is None
    assert codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert codes.compress(spark.createDataFrame(odd, schema)).count() == 0


def test_whole_nodes_are_assigned_by_their_sums():
    """Of tight groups most rows are never compared with an entry."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-4000, 4000, (16, 8))
    rows = centres[draw.integers(0, 16, 4000)] + draw.integers(-40, 41, (4000, 8))
    found = codes.assign(codes.Tree(rows, 16), centres.tolist())
    dist = ((rows[:, None] - centres[None]) ** 2).sum(2)
    tree = codes.Tree(rows, 16)
    assert (dist.argmin(1)[tree.order] == found.entry).all()
    assert found.whole > 3600
    assert (np.bincount(dist.argmin(1), minlength=16) == found.counts).all()


def test_query_over_the_table(spark):
    from riskloom.llm.queries import QUERIES

    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in table(spark, FOLDER, "embeddings").collect()]
    found = QUERIES["op11_dual_tree_codes"](spark, FOLDER).collect()
    expected, digest = plain(rows, codes.CodeSetting())
    assert sorted(tuple(r)[:4] for r in found) == sorted(expected) and {r.codebooks_sha256 for r in found} == {digest}
