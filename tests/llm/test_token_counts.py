"""Token counts against the tokenizer on whole texts."""

import random

import pytest

from lumenfuse.llm import token_counts

WORDS = ["the", " ", "  ", "\n", "\n\n", "\t", "Été", "straße", "don't", "we'll", "'s", "x1y22", "½²", "a.b", "...", "=====" * 9, "<|endoftext|>", "<|endof", "中文字", "日本", "🙂", "é", "\x1c", "\xa0", "　", "_", "İ", "ﬁ", "٣", ""]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(WORDS) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + [None, "", " ", "<|endoftext|><|endoftext|>"]


@pytest.mark.parametrize("heavy", [token_counts.HEAVY, 20])
def test_counts_equal_the_tokenizer(spark, monkeypatch, heavy):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "PIECE_CHARS", 40)
    monkeypatch.setattr(token_counts, "CHUNK_TOKENS", 60)
    monkeypatch.setattr(token_counts, "ROW_TOKENS", 7)
    path, many = P.path("byte_bpe_50k.json"), texts(120, 4)
    whole = Tokenizer.from_file(path)
    rows = [(None if i == 3 else i % 50, t, "x") for i, t in enumerate(many)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, row string"), path, heavy)
    want = [(d, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False))) for d, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_other_tokenizers_are_refused(spark):
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        token_counts.PreTokens(P.path("word_bpe_49k.json"))
