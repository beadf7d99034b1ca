"""BPE encoding and decoding with an automaton over tokens.

The automaton starts with one state where every base symbol loops. Each merge (u, v) -> w in its turn changes it by a
gadget: arcs labelled u that lead to a state with an arc v lead to a copy of that state without it, and a new arc w
leads from where the u arcs start to where that v arc led. What is left accepts exactly the token sequences that the
merges make, so a word has one path, and the labels along it are its tokens.

All arcs with one label lead to the same state, so a state is named by the label that enters it and by how many arcs
were taken from its first form. Copies share what they have in common; arcs are looked up, not listed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import batches

END = -2
ROOT = -1


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies: itself, or one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """The deterministic automaton of a vocabulary (token -> id) and its merges, in order."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]], end: str = "") -> None:
        """end: what the vocabulary writes behind the last byte of a word."""
        self.labels = {i: token for token, i in vocabulary.items()}
        made = [vocabulary[u + v] for u, v in merges]
        self.born: dict[int, int] = dict.fromkeys(vocabulary.values(), -1)  # the merge that made a token
        self.parts: dict[int, tuple[int, int]] = {}
        self.first: dict[int, tuple[int, int]] = {}  # state that a label entered when it was new
        self.taken_at: dict[int, list[int]] = {}  # merges that took an arc from the state behind a label
        self.taken: dict[tuple[int, int], int] = {}  # (label, arc taken) -> merge
        self.dead: set[int] = set()
        self.memo: dict[tuple[int, int], bool] = {}
        for k, ((u, v), w) in enumerate(zip(merges, made)):
            self._gadget(k, vocabulary[u], vocabulary[v], w)
        self.memo = {}
        self.ids = vocabulary
        self.trie = self._trie(end)

    def _trie(self, end: str) -> dict:
        """Tokens by their bytes: -1 leads to the id of a token that may stand inside a word, END to one that ends it."""
        codes, root = {letter: b for b, letter in byte_letters().items()}, {}
        for token, number in self.ids.items():
            last = bool(end) and token.endswith(end)
            node = root
            for letter in token[: len(token) - len(end)] if last else token:
                node = node.setdefault(codes[letter], {})
            node[END if last else -1] = number
            if not end:
                node[END] = number
        return root

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.parts:
            raise ValueError("Two merges make the same token; an arc would need two origins.")
        self.born[w], self.parts[w] = k, (u, v)
        if u in self.dead or v in self.dead or not self._arc(self.state(u), v):
            self.dead.add(w)
            return
        self.first[w] = self.state(v)
        self.taken_at.setdefault(u, []).append(k)
        self.taken[u, v] = k

    def state(self, label: int) -> tuple[int, int]:
        """(label, arcs taken so far) of the state that arcs with this label enter now."""
        return label, len(self.taken_at.get(label, ()))

    def _arc(self, state: tuple[int, int], token: int) -> bool:
        """Whether an arc `token` leaves `state`."""
        while True:
            label, taken = state
            born = self.born[token]
            if token in self.dead:
                return False
            if label == ROOT:
                return True
            if taken == 0:  # the same state as its first form
                state = self.first.get(label, (ROOT, 0))
                continue
            times = self.taken_at[label]
            if times[taken - 1] <= born:  # the state was there when the token's merge came: it has w if it has u
                token = self.parts[token][0]
                continue
            older = bisect_right(times, born, 0, taken)
            gone = self.taken.get((label, token))
            if gone is not None and times[older] <= gone <= times[taken - 1]:
                return False
            state = (label, older)

    def follows(self, label: int, token: int) -> bool:
        """Whether `token` may stand behind `label` (ROOT at the start)."""
        key = (label, token)
        if (known := self.memo.get(key)) is None:
            if len(self.memo) > 2_000_000:  # a memo, not a result: it may be dropped at any time
                self.memo = {}
            known = self.memo[key] = self._arc(self.state(label), token)
        return known

    def _longest_last(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of the vocabulary's tokens at `at`; those that end the word have its length and one as end."""
        found, node, size = [], self.trie, len(data)
        for stop in range(at, size):
            node = node.get(data[stop])
            if node is None:
                return found
            if stop + 1 < size and -1 in node:
                found.append((stop + 1, node[-1]))
        if END in node:
            found.append((size, node[END]))
        return found

    def path(self, data: bytes) -> list[int]:
        """Labels of the path that spells the bytes of one word.

        Longest arcs are tried first; a place from which the rest can't be spelled is not entered twice.
        """
        size, labels, closed = len(data), [], set()
        trail: list[tuple[int, list[tuple[int, int]]]] = []
        at, before, ahead = 0, ROOT, self._longest_last(data, 0)
        memo, follows = self.memo, self.follows
        while True:
            while ahead:
                stop, token = ahead.pop()
                if stop not in closed and (memo.get((before, token)) or follows(before, token)):
                    break
            else:
                if not trail:
                    raise ValueError(f"The vocabulary can't spell {data!r}.")
                closed.add(at)
                at, ahead = trail.pop()
                labels.pop()
                before = labels[-1] if labels else ROOT
                continue
            trail.append((at, ahead))
            labels.append(token)
            if stop == size:
                return labels
            at, before, ahead = stop, token, self._longest_last(data, stop)


CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def letter_class(wanted) -> str:
    """A class of all signs up to U+FFFF that are `wanted`, as ranges."""
    codes = [c for c in range(0x10000) if wanted(chr(c))]
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends)) + "]"


LETTER = letter_class(str.isalpha)
ODD_NUMBER = re.compile(letter_class(lambda c: unicodedata.category(c) in ("Nl", "No")))


def odd(text: str) -> bool:
    """Whether `text` may hold what the fast patterns take for something else.

    These are numbers that are no decimal digits, separators that are no white space, and signs beyond U+FFFF.
    """
    if any(map(text.__contains__, SEPARATORS)):
        return True
    return not text.isascii() and (len(text.encode("utf-16-le")) > 2 * len(text) or ODD_NUMBER.search(text) is not None)


class WordSplitter:
    """NFC, lower case letter by letter, then runs of letters, single digits and runs of other signs; no white space."""

    fast = re.compile(rf"{LETTER}++|\d|{CLITICS}|(?:[^\s\w]|_)++")
    exact = regex.compile(rf"{CLITICS}|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+")

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # else lower() would look at its neighbours
        text = text.lower()
        return (self.exact if odd(text) else self.fast).findall(text)


class Codec:
    """Encodes and decodes whole texts; knows words it has seen."""

    def __init__(self, automaton: Automaton, special: dict[str, int]) -> None:
        self.automaton, self.special, self.split = automaton, special, WordSplitter()
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.names = automaton.labels | {i: token for token, i in special.items()}
        self.known: dict[str, tuple[int, str, str]] = {}

    @classmethod
    def read(cls, path: str) -> Codec:
        """From a vocabulary file of the tokenizers library with word ends."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        return cls(automaton, {t["content"]: t["id"] for t in content["added_tokens"]})

    def word(self, word: str) -> list[int]:
        return self.automaton.path(word.encode())

    def _pieces(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; names of special tokens in it become those tokens."""
        out: list[int] = []
        for piece in self._pieces(text or ""):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                for word in self.split(piece):
                    out += self.word(word)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Arc labels of `ids` in a row, as this vocabulary's files ask for: without a decoder, spaces between them."""
        return " ".join([self.names[i] for i in ids])

    def _known(self, word: str) -> tuple[int, str, str]:
        ids = [self.special[word]] if word in self.special else self.word(word)
        if len(self.known) > 1_000_000:  # a memo, not a result
            self.known.clear()
        self.known[word] = row = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return row

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of their listing and of what they decode to."""
        words: list[str] = []
        for piece in self._pieces(text or ""):
            words += [piece] if piece in self.special else self.split(piece)
        known, look_up = self.known, self._known
        rows = [known.get(word) or look_up(word) for word in words]
        ids, text = " ".join([r[1] for r in rows]), " ".join([r[2] for r in rows])
        return sum([r[0] for r in rows]), sha256(ids.encode()).hexdigest(), sha256(text.encode()).hexdigest()


def _shared(documents: DataFrame, path: str):
    """The compiled automaton, as large as its vocabulary, for all executors; only the driver reads the file."""
    return documents.sparkSession.sparkContext.broadcast(Codec.read(path))


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text of `documents` (doc_id, text); a null text has no ids.

    Rows are encoded one by one, so repeated ones give the same ids; other columns are ignored.
    """
    shared = _shared(documents, path)

    def run(batch: pa.RecordBatch) -> pa.Table:
        ids = [shared.value.encode(t) for t in batch.column(1).to_pylist()]
        return pa.table({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return batches(_source(documents), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids in `encoded` (doc_id, ids); null ids give an empty text."""
    shared = _shared(encoded, path)

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = [shared.value.decode(ids or ()) for ids in batch.column(1).to_pylist()]
        return pa.table({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the listed ids and of the decoded text, without moving the ids."""
    shared = _shared(documents, path)

    def run(batch: pa.RecordBatch) -> pa.Table:
        rows = [shared.value.digests(t) for t in batch.column(1).to_pylist()]
        n, ids, texts = zip(*rows)
        return pa.table({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return batches(_source(documents), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
