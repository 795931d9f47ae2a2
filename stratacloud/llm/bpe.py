"""BPE encoding and decoding with a public word-level vocabulary.

A word is a doubly linked list of symbols; a priority queue holds (merge rank, position)
of adjacent pairs, entries whose symbols have changed since are skipped when popped, and
equal ranks merge from the left.  Words repeat, so each worker keeps a bounded memo of
encoded words, two generations of 98 304.  Decoding joins vocabulary strings by a space, as the library does for a
file without a decoder.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm._common import tokenizer_path
from stratacloud.llm._text import frugal, resident

VOCABULARY = "word_bpe_49k.json"
#: The memo holds two generations of at most so many words, none longer than `MEMO_CHARS`, so at most about 45 MB.
MEMO_WORDS, MEMO_CHARS = 3 << 15, 48
#: Bits of an id in a pair, and of a position in an entry of the queue.
ID_BITS, PLACE_BITS = 32, 32
PLACE_MASK = (1 << PLACE_BITS) - 1
#: Texts are encoded in runs of about so many characters, so that a batch's tokens stay few.
RUN_CHARS = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Memo(dict):
    """make(word) by word, in two generations: once the younger one is full, the older one goes."""

    def __init__(self, make: Callable) -> None:
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class WordBpe:
    """Encoder and decoder for a vocabulary file with an end-of-word suffix."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        # by both ids in one number: the merge rank; by rank: both ids and the one they make
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[a], self.ids[b]
            self.ranks[left << ID_BITS | right] = rank
            self.made.append((left, right, self.ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.tokens = np.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], object)
        self.known = np.array([t is not None for t in self.tokens], bool)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        letters = byte_letters()
        self.inner, self.last = [self.ids.get(x) for x in letters], [self.ids.get(x + self.suffix) for x in letters]
        self.memo = Memo(lambda word: array("i", self.merge(word)).tobytes())

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        data, ranks, made = word.encode(), self.ranks.get, self.made
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if None in symbols:
            symbols = [i for i in symbols if i is not None]
        n = len(symbols)
        # an entry is a merge rank and, in its low bits, the position of the left symbol
        queue = [rank << PLACE_BITS | at for at, (a, b) in enumerate(pairwise(symbols)) if (rank := ranks(a << ID_BITS | b)) is not None]
        if not queue:
            return tuple(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at = entry & PLACE_MASK
            left, right, new = made[entry >> PLACE_BITS]
            follow = after[at]
            if symbols[at] != left or follow < 0 or symbols[follow] != right:
                continue  # a symbol of the pair is gone
            symbols[at], symbols[follow] = new, -1
            after[at] = beyond = after[follow]
            if beyond >= 0:
                before[beyond] = at
                if (rank := ranks(new << ID_BITS | symbols[beyond])) is not None:
                    heappush(queue, rank << PLACE_BITS | at)
            if (prior := before[at]) >= 0 and (rank := ranks(symbols[prior] << ID_BITS | new)) is not None:
                heappush(queue, rank << PLACE_BITS | prior)
        return tuple([i for i in symbols if i >= 0])

    def packed(self, text: str) -> bytes:
        """Ids of a text, 4 bytes each."""
        out: list[bytes] = []
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            # one character at a time, as the library lowers: no final sigma
            words = self.words(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            memo = self.memo
            out.extend([memo[w] for w in words])
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return " ".join(self.tokens[ids[self.known[ids]]].tolist())


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def _runs(column: pa.Array) -> Iterator[list[str]]:
    run, size = [], 0
    for value in column:
        text = value.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, decode_too: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; decoded as well if asked for.

    Null reads as empty; an empty text has no ids.  Special strings of the vocabulary become
    their ids, as in the library.  Rows keep their order and number, repeated ones too; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = resident(load, tokenizer_path(vocabulary))
        for batch in batches:
            at = 0
            for texts in _runs(batch.column("text")):
                ids = [np.frombuffer(bpe.packed(t), np.int32) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if decode_too:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, ids array<int>" + ", decoded string" * decode_too)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and decoded text of (doc_id, ids): vocabulary strings, special ones too, joined by a space.

    Null or empty ids give an empty text; null ids and those outside the vocabulary are left out, as in the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = resident(load, tokenizer_path(vocabulary))
        for batch in batches:
            texts = [bpe.decode(np.array([i for i in x.as_py() or [] if i is not None], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(frugal(run), f"doc_id {kind}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode(decode_too=True)."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
