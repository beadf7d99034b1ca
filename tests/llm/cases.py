"""Small tables with the odd rows that every operator must bear."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " \n\t ",
    "word",
    "two words",
    "İstanbul ΣΑΣ ſecret KEY über   x y",
    "<|endoftext|> a <|startoftext|>b<|endoftext|>",
    "a b c d e f " * 3000,
    "\x00 nul \x7f",
]


def documents(spark, texts, first=0):
    """doc_id counts up from `first`; one column more than the table has, with a clashing name."""
    rows = [(first + i, t, "en", "src0", len(t or ""), 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + ", score double")


def empty(spark):
    return documents(spark, [])
