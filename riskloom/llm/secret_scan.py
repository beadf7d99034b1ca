"""Secret scan: fixed patterns, and Markov models of random strings and of ordinary identifiers.

All of it is column expressions. Two first-order character models are counted from labelled tokens. A long token counts
as random when its mean log-likelihood ratio per character pair is above a bound that ordinary long tokens keep below.
What no fixed pattern matches is not ordinary for that: the ordinary tokens are words too short to be judged and
identifiers made of such words, and the bound stays below the midpoint between them and the secrets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fewest, stored

#: Fixed patterns by kind, in the order of their listing, with the group whose length counts and its least length.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
RANDOM = "random"
KINDS = (*PATTERNS, RANDOM)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
#: Between the words of identifiers; besides, words with a capital follow each other.
JOINS = ("_", "-", "/", "")
SPAN = "array<struct<start: int, kind: int, end: int>>"
CHUNK = 32
JUDGED = "struct<start: int, end: int, token: string>"


@dataclass(frozen=True)
class MarkovSetting:
    """length: least length of a judged token; secrets, texts, identifiers: bounds of the labelled sample; smoothing: added to counts.

    spread: how many deviations above the median of ordinary long tokens the bound lies; margin: least mean ratio of a
    random token; step, reach: width of the bins and largest absolute score of the histogram of long tokens.
    """

    length: int = 20
    secrets: int = 5000
    texts: int = 1000
    identifiers: int = 1000
    smoothing: float = 0.5
    spread: float = 5.0
    margin: float = 0.5
    step: float = 0.02
    reach: float = 12.0


@dataclass(frozen=True)
class Model:
    """weights: log-likelihood ratios by pair of letters of ALPHABET; bound: least mean ratio of a random token."""

    weights: tuple[float, ...]
    bound: float


def ended(sizes: Column) -> Column:
    """Running sums of an array of sizes. Long arrays are summed in chunks, so that a step copies no long list."""

    def along(values: Column, start: Column) -> Column:
        def step(state: Column, size: Column) -> Column:
            at = state["at"] + size
            return F.struct(at.alias("at"), F.concat(state["ends"], F.array(at)).alias("ends"))

        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("ends")), step, lambda state: state["ends"])

    zero = F.lit(0)

    def chunked(sizes: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda i: F.slice(sizes, i * CHUNK + 1, CHUNK))
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda total, size: total + size))
        before = F.transform(F.arrays_zip(along(totals, zero).alias("end"), totals.alias("size")), lambda t: t["end"] - t["size"])
        return F.flatten(F.zip_with(chunks, before, along))

    def both(sizes: Column) -> Column:
        return F.when(F.size(sizes) <= CHUNK, along(sizes, zero)).otherwise(chunked(sizes))

    return F.get(F.transform(F.array(sizes), both), zero)  # `sizes` is computed once


def added(state: Column, items: Column, kind: str) -> list[Column]:
    """Fields `out` and `done` of a state that gathers a list in chunks."""
    full = F.size(state["out"]) >= CHUNK
    out = F.when(full, F.array().cast(f"array<{kind}>")).otherwise(state["out"])
    done = F.when(full, F.concat(state["done"], F.array(state["out"]))).otherwise(state["done"])
    return [F.concat(out, items).alias("out"), done.alias("done")]


def gathered(kind: str) -> list[Column]:
    return [F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(f"array<array<{kind}>>").alias("done")]


def whole_list(state: Column) -> Column:
    return F.flatten(F.concat(state["done"], F.array(state["out"])))


def tokens_of(text: Column, setting: MarkovSetting) -> Column:
    """Start, end and letters of all long tokens, left to right."""
    pattern = f"{TOKEN}{{{setting.length},}}"
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = ended(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda piece, match: F.length(piece) + F.length(match)))
    spans = F.zip_with(ends, found, lambda end, token: F.struct((end - F.length(token)).alias("start"), end.alias("end"), token.alias("token")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{JUDGED}>"))


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Start and end of all matches whose `group` has `least` characters, left to right, not overlapping.

    The pieces between matches give the places: what stands before a match is as long as the pieces and matches there.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(
        F.slice(pieces, 1, F.size(found)),
        found,
        lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size")),
    )
    if group:
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        rows = F.zip_with(rows, inner, lambda row, part: F.struct(row["gap"], row["size"], F.length(part).alias("counts")))
    else:
        rows = F.transform(rows, lambda row: F.struct(row["gap"], row["size"], row["size"].alias("counts")))
    ends = ended(F.transform(rows, lambda row: row["gap"] + row["size"]))
    spans = F.zip_with(rows, ends, lambda row, end: F.struct((end - row["size"]).alias("start"), end.alias("end"), row["counts"].alias("counts")))
    kept = F.transform(F.filter(spans, lambda s: s["counts"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start: int, end: int>>"))


def _bounded(pattern: str, group: int, least: int) -> tuple[str, int, int]:
    """A run with its least length in the pattern, where that finds the same runs: shorter ones need no place."""
    head = pattern.split("[", 1)[0]
    return f"{pattern[:-1]}{{{least - len(head)},}}", group, least


def base_values(text: Column) -> Column:
    """The strings that the fixed patterns hold for secrets, without the name before an assignment."""
    values = [
        F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda v, n=n: F.length(v) >= n)
        for p, g, n in (PATTERNS["assign"], *(_bounded(*PATTERNS[k]) for k in ("access", "hex")))
    ]
    return F.concat(*values)


def samples(documents: DataFrame, setting: MarkovSetting = MarkovSetting()) -> DataFrame:
    """Labelled tokens (token, random): secrets of fixed form from all texts, and words of a bounded number of texts.

    Each secret counts once. Both are taken in the order of a hash, so the same corpus gives the same sample. A token long
    enough to be judged is not ordinary because no pattern matches it: it may be a key. The long ordinary tokens are identifiers made of words.
    """
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = stored(texts.select(F.explode(base_values(F.col("text"))).alias("token")).distinct(), "secrets_found")
    found = fewest(found, setting.secrets, F.col("token"), "token")
    some = fewest(texts, setting.texts, F.col("doc_id"), "doc_id", "text")
    plain = F.regexp_replace("text", "|".join(p for p, *_ in (PATTERNS["assign"], *(_bounded(*PATTERNS[k]) for k in ("access", "hex")))), " ")
    some = some.select(plain.alias("plain"))
    words = some.select(F.explode(F.regexp_extract_all("plain", F.lit(f"{TOKEN}{{4,}}"), F.lit(0))).alias("token"))
    words = words.where(F.length("token") < setting.length).unionByName(identifiers(some, setting))
    return stored(found.withColumn("random", F.lit(True)).unionByName(words.withColumn("random", F.lit(False))), "labelled_tokens")


def identifiers(texts: DataFrame, setting: MarkovSetting) -> DataFrame:
    """(token): long identifiers of five successive plain words of `texts` (plain), joined in one of the ways of JOINS.

    Plain words are too short to be judged and have letters alone, of which only the first may be a capital.
    """
    word = f"[A-Za-z][a-z]{{1,{setting.length - 2}}}"
    pattern = F.lit(f"(?<!{TOKEN}){word}(?: {word}){{4}}(?!{TOKEN})")
    groups = texts.select(F.explode(F.regexp_extract_all("plain", pattern, F.lit(0))).alias("words"))
    way = F.pmod(F.xxhash64("words"), F.lit(len(JOINS) + 1))
    token = F.translate(F.initcap("words"), " ", "")
    for number, join in enumerate(JOINS):
        token = F.when(way == number, F.translate("words", " ", join)).otherwise(token)
    found = groups.distinct().select(token.alias("token")).where(F.length("token") >= setting.length)
    return found.orderBy(F.xxhash64("token"), "token").limit(setting.identifiers)


def places(token: Column) -> Column:
    """Places of a token's letters in ALPHABET, from 1; 0 for another. The token is cut into letters once."""
    return F.transform(F.split(token, ""), lambda letter: F.instr(F.lit(ALPHABET), letter))


def pair(first: Column, second: Column) -> Column:
    """Number of a pair of places, from 1; null where one is not in ALPHABET."""
    return F.when((first > 0) & (second > 0), (first - 1) * len(ALPHABET) + second)


def mean_ratio(token: Column, weights: tuple[float, ...]) -> Column:
    """Mean log-likelihood ratio over the pairs of a token of two letters or more."""
    values = F.split(F.lit(",".join(f"{w:.4f}" for w in weights)), ",").cast("array<double>")  # becomes one constant

    def step(state: Column, letter: Column) -> Column:
        weight = F.coalesce(F.element_at(values, pair(state["last"], letter)), F.lit(0.0))
        return F.struct(letter.alias("last"), (state["total"] + weight).alias("total"))

    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))
    total = F.aggregate(places(token), start, step, lambda state: state["total"])
    last = F.length(token) - 1
    return F.when(last >= 1, total / last).otherwise(F.lit(0.0))


def train(labelled: DataFrame, setting: MarkovSetting = MarkovSetting(), documents: DataFrame | None = None) -> Model:
    """Both models from labelled tokens (token, random), the bound from those and from the long tokens of `documents`.

    What reaches the driver is one row per pair of letters and the bins of two histograms. With no random tokens that
    model is uniform, with no ordinary ones the other is.
    """
    known = labelled.where("token IS NOT NULL AND length(token) >= 2")
    cut = known.select("random", places(F.col("token")).alias("at"))
    after = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), pair)
    counted = cut.select("random", F.explode(after).alias("pair")).where("pair IS NOT NULL")
    size = len(ALPHABET)
    counts = {True: [0] * size**2, False: [0] * size**2}
    for row in counted.groupBy("pair", "random").count().collect():
        counts[row["random"]][row["pair"] - 1] = row["count"]

    def logs(numbers: list[int]) -> list[float]:
        sums = [sum(numbers[a * size : (a + 1) * size]) for a in range(size)]
        s = setting.smoothing
        return [math.log((n + s) / (sums[k // size] + s * size)) for k, n in enumerate(numbers)]

    weights = tuple(a - b for a, b in zip(logs(counts[True]), logs(counts[False])))
    long = known.where(F.length("token") >= setting.length)
    bins = {kind: histogram(long.where(F.col("random") == kind), weights, setting) for kind in (True, False)}
    everywhere = [] if documents is None else histogram(long_tokens(documents, setting), weights, setting)
    return Model(weights, bound(bins[False], bins[True], everywhere, setting))


def long_tokens(documents: DataFrame, setting: MarkovSetting = MarkovSetting()) -> DataFrame:
    """(token): the distinct tokens of all texts that scan() judges."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike(f"{TOKEN}{{{setting.length},}}"))
    whole = F.col("text")
    texts = texts.select("text", F.struct(*(c.alias(k) for k, c in _located(whole).items())).alias("_secret"))
    texts = texts.select("text", F.concat(*(tagged(F.col(f"_secret.{kind}"), kind) for kind in PATTERNS)).alias("_base"))
    free = F.transform(judged(whole, F.sort_array("_base"), setting), lambda t: t["token"])
    return texts.select(F.explode(free).alias("token")).distinct()


def histogram(tokens: DataFrame, weights: tuple[float, ...], setting: MarkovSetting) -> list[tuple[float, int]]:
    """(score, number of tokens) by bins of the mean ratio, in order; their number does not grow with the tokens."""
    score = F.greatest(F.lit(-setting.reach), F.least(F.lit(setting.reach), mean_ratio(F.col("token"), weights)))
    rows = tokens.groupBy(F.round(score / setting.step).cast("int").alias("bin")).count().collect()
    return sorted((row["bin"] * setting.step, row["count"]) for row in rows)


def middle(bins: list[tuple[float, int]]) -> float:
    """Median of a histogram."""
    seen, half = 0, sum(n for _, n in bins) / 2
    for value, n in bins:
        seen += n
        if seen >= half:
            return value
    return 0.0


def bound(ordinary: list[tuple[float, int]], random: list[tuple[float, int]], everywhere: list[tuple[float, int]], setting: MarkovSetting) -> float:
    """A bound from the histograms of long tokens: known to be ordinary, known to be random, and of all texts.

    It lies some deviations above the median of the ordinary ones, and of the tokens of all texts on their side of the
    midpoint between both medians, whichever is more; but never above the midpoint, so no number of keys lifts it there.
    """

    def above(bins: list[tuple[float, int]]) -> float:
        centre = middle(bins)
        apart = middle(sorted((abs(value - centre), n) for value, n in bins))
        return centre + setting.spread * max(1.4826 * apart, setting.step)

    if not ordinary:
        return setting.margin
    half = (middle(ordinary) + middle(random)) / 2 if random else setting.reach
    near = [(value, n) for value, n in everywhere if value < half] if random else []
    return max(setting.margin, min(half, max(above(part) for part in (ordinary, near) if part)))


def judged(whole: Column, base: Column, setting: MarkovSetting) -> Column:
    """Start, end and letters of the long tokens that touch no span of `base`, which is in order.

    Both lists are gone through once, by start. A token waits until the next one begins: a span of `base` that begins before
    its end takes it away, as does one before it that reaches into it.
    """
    tokens = tokens_of(whole, setting)
    known = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), F.lit(None).cast("string").alias("token")))
    asked = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("own"), t["end"].alias("end"), t["token"].alias("token")))
    nothing = F.lit(None).cast(JUDGED)

    def waiting(state: Column) -> Column:
        return F.when(state["waits"].isNull(), F.array().cast(f"array<{JUDGED}>")).otherwise(F.array(state["waits"]))

    def step(state: Column, row: Column) -> Column:
        own = row["own"] == 1
        token = F.struct(row["start"].alias("start"), row["end"].alias("end"), row["token"].alias("token"))
        taken = state["waits"]["end"] > row["start"]
        waits = F.when(own, F.when(state["reach"] <= row["start"], token)).when(taken, nothing).otherwise(state["waits"])
        reach = F.when(own, state["reach"]).otherwise(F.greatest(state["reach"], row["end"]))
        settled = F.when(own, waiting(state)).otherwise(F.array().cast(f"array<{JUDGED}>"))
        return F.struct(reach.alias("reach"), waits.alias("waits"), *added(state, settled, JUDGED))

    state = F.struct(F.lit(0).alias("reach"), nothing.alias("waits"), *gathered(JUDGED))
    swept = F.aggregate(F.sort_array(F.concat(known, asked)), state, step, lambda state: F.concat(whole_list(state), waiting(state)))
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(swept)


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))
    ).cast(SPAN)


def scan(documents: DataFrame, model: Model, setting: MarkovSetting = MarkovSetting()) -> DataFrame:
    """Adds base_spans and spans, arrays of (start, kind, end) in that order, to `documents` (doc_id, text, ...).

    Places are code points, the end exclusive; kind is a place in KINDS. spans has random tokens besides, unless they
    touch one of base_spans. A null text is empty. Rows are scanned one by one, so repeated ones get the same spans.
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = documents.columns
    base = F.sort_array(F.concat(*(tagged(F.col(f"_secret.{kind}"), kind) for kind in PATTERNS)))
    found = documents.withColumn("_secret", F.struct(*(c.alias(k) for k, c in _located(whole).items())))
    found = found.withColumn("base_spans", base)
    free = F.filter(judged(whole, F.col("base_spans"), setting), lambda t: mean_ratio(t["token"], model.weights) > model.bound)
    spans = F.sort_array(F.concat("base_spans", tagged(free, RANDOM)))
    return found.withColumn("spans", spans).select(*[c for c in keep if c not in ("base_spans", "spans")], "base_spans", "spans")


def _located(whole: Column) -> dict[str, Column]:
    return {
        kind: located(whole, *(PATTERNS[kind] if kind == "assign" else _bounded(*PATTERNS[kind]))) for kind in PATTERNS
    }


def listing(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """`text` with every span replaced by `mark`; spans that overlap become one mark each for what is still there.

    A long list of spans is gone through in chunks, each over its own part of the text.
    """
    kind = "struct<start: int, end: int>"

    def apart(state: Column, span: Column) -> Column:
        left = F.struct(F.greatest(span["start"], state["at"]).alias("start"), span["end"].alias("end"))
        items = F.when(span["end"] > state["at"], F.array(left)).otherwise(F.array().cast(f"array<{kind}>"))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), *added(state, items, kind))

    cuts = F.aggregate(spans, F.struct(F.lit(0).alias("at"), *gathered(kind)), apart, whole_list)

    def marked(cuts: Column) -> Column:
        def replaced(number: Column) -> Column:
            chunk = F.slice(cuts, number * CHUNK + 1, CHUNK)
            first = F.get(chunk, F.lit(0))["start"]
            end = F.coalesce(F.get(cuts, (number + 1) * CHUNK)["start"], F.length(text))

            def step(state: Column, span: Column) -> Column:
                size, gap = span["end"] - state["at"], span["start"] - state["at"]
                parts = F.concat(state["parts"], F.array(F.substr(state["rest"], F.lit(1), gap), F.lit(mark)))
                rest = F.substr(state["rest"], size + 1, F.length(state["rest"]))
                return F.struct(span["end"].alias("at"), parts.alias("parts"), rest.alias("rest"))

            here = F.substr(text, first + 1, end - first)
            state = F.struct(first.alias("at"), F.array().cast("array<string>").alias("parts"), here.alias("rest"))
            return F.aggregate(chunk, state, step, lambda s: F.concat(F.array_join(s["parts"], ""), s["rest"]))

        last = F.floor((F.size(cuts) - 1) / CHUNK).cast("int")
        head = F.substr(text, F.lit(1), F.get(cuts, F.lit(0))["start"])
        return F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), last), replaced), ""))

    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(cuts), marked), F.lit(0))).otherwise(text)
