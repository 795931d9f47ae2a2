import random

from tokenizers import Tokenizer

from stratacloud.llm import bpe
from stratacloud.llm._common import tokenizer_path

ODD = ["", " ", "Straße ÉTÉ Σίσυφος ΣΑΣ", "don't we'll 'S 12345 a1b2", "x<|endoftext|>y <|startoftext|>", "é    İ", "日本語 mixed テキスト 🙂🙂", "!!!???", "a" * 3000, "\x00\x1f \t\r\n"]


def test_encode_and_decode_equal_the_library(spark, sf_dir):
    library = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCÉßÑñçœ'’.,!?0123 \n-_|$"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(df, decode_too=True).collect()}
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df)).collect()}
    assert len(got) == len(texts) + 1
    for i, text in [*enumerate(texts), (-1, "")]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids, text
        assert got[i].decoded == again[i] == library.decode(ids, skip_special_tokens=False)


def test_decode_leaves_out_unknown_ids(spark):
    rows = [(1, [320, -1, None, 10**6, 321]), (2, []), (3, None)]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    library = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    assert got == {1: library.decode([320, 10**6, 321], skip_special_tokens=False), 2: "", 3: ""}


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    word_bpe = bpe.load(tokenizer_path(bpe.VOCABULARY))
    assert len(word_bpe.encode("one two three four five six")) >= 6
    assert len(word_bpe.memo) <= 3 and len(word_bpe.memo.older) <= 3
    word_bpe.encode("x" * 5000)
    assert all(len(w) <= bpe.MEMO_CHARS for w in [*word_bpe.memo, *word_bpe.memo.older])
