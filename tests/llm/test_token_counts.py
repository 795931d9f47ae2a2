import itertools

from tokenizers import Tokenizer, models, pre_tokenizers

from stratacloud.llm import token_counts as tc
from stratacloud.llm._common import tokenizer_path


def test_counts_equal_the_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tc.VOCABULARY))
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always", split=True)])
    texts = ["", "  \n", "don't", "日本語 🙂 ꙮ", "x" * 5000, "▁▁ a▁b", "abc日" * 20_000, "x" * 5000] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(df).collect()}
    assert got.pop(-1) == 0
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_ties_and_unknown_characters():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁", -1.0)]
    viterbi = tc.CountOnlyViterbi(pieces)

    def brute(word):
        best, count = None, None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1]):
                if c:
                    parts.append(word[at : i + 1])
                    at = i + 1
            scores = dict(pieces)
            if all(p in scores or len(p) == 1 for p in parts):
                total = sum(scores.get(p, viterbi.unknown) for p in parts)
                n = sum(1 if p in scores else len(p.encode()) for p in parts)
                if best is None or total > best + 1e-9:
                    best, count = total, {n}
                elif abs(total - best) <= 1e-9:
                    count.add(n)
        return best, count

    # equal scores: the longest last piece stays, so "aba" is one piece and "ab" beats "a" + "b"
    assert viterbi.word("▁aba") == 2 and viterbi.word("▁abb") == 3 and viterbi.word("▁aé") == 4
    assert brute("▁aba")[0] == -4.0
    for n in range(1, 7):
        for letters in itertools.product("abé", repeat=n):
            word = "▁" + "".join(letters)
            assert viterbi.word(word) in brute(word)[1], word


def test_marks_in_a_text_equal_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tc.VOCABULARY))
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always", split=True)])
    viterbi = tc.load(tokenizer_path(tc.VOCABULARY))
    for text in ("▁", "▁▁ a▁b", "a▁", "▁the", "▁▁▁▁", "one▁▁two three▁", "x ▁\n▁y"):
        assert viterbi.text(text) == len(library.encode(text, add_special_tokens=False).ids), text
