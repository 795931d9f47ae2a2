"""Token counts under a unigram vocabulary, without building the segmentation.

White space separates words, each word begins with the mark U+2581, and pieces do not cross
words.  An Aho-Corasick automaton lists the vocabulary matches in a word; dynamic programming
over end positions carries the best score and its number of pieces.  Rules for ties are those
of the libraries: a piece replaces another one with the same end only if its score is
strictly higher, longest piece first, and a character without a piece of its own costs the
lowest score less ten and counts a token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stratacloud.llm._common import tokenizer_path
from stratacloud.llm._text import frugal, resident
from stratacloud.llm.bpe import Memo, _runs

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: A mark and what follows up to the next: a mark in a text begins a word, as in the tokenizers library.
MARKED = re.compile(f"{MARK}[^{MARK}]*")
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces with scores; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if plain(i)]


class CountOnlyViterbi:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.memo = Memo(self.marked)

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of a word that carries its mark.

        Scores and counts are kept for as many ends as the longest piece spans, so a word
        without any space needs no more memory than a short one.
        """
        span = min(self.longest, len(word)) + 1
        best, count = [0.0] * span, [0] * span
        matches = self.automaton.iter(word)
        following, match = next(matches, (-1, None))
        for end, letter in enumerate(word):
            top, pieces = None, 0
            ending = []
            while following == end:
                ending.append(match)
                following, match = next(matches, (-1, None))
            # longest first: of equal scores the piece that starts earliest stays
            for length, score in sorted(ending, reverse=True) if len(ending) > 1 else ending:
                at = (end + 1 - length) % span
                total = best[at] + score
                if top is None or total > top:
                    top, pieces = total, count[at] + 1
            if letter not in self.single:
                at = end % span
                total = best[at] + self.unknown
                if top is None or total > top:
                    top, pieces = total, count[at] + len(letter.encode())
            at = (end + 1) % span
            best[at], count[at] = top, pieces
        return count[len(word) % span]

    def marked(self, word: str) -> int:
        if MARK not in word:
            return self.word(MARK + word)
        return sum(self.word(m[0]) for m in MARKED.finditer(word if word[0] == MARK else MARK + word))

    def text(self, text: str) -> int:
        memo = self.memo
        return sum([memo[w] for w in text.split()])


def load(path: str) -> CountOnlyViterbi:
    return CountOnlyViterbi(read_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every whole text.

    Words are separated by white space as Unicode has it, which counts no token itself.  Null, empty and blank texts have
    0 tokens.  Repeated rows are counted each; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = resident(load, tokenizer_path(vocabulary))
        for batch in batches:
            counts = [viterbi.text(t) for texts in _runs(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long")
