import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import bpe

TOKENIZER = Tokenizer.from_file(bpe.vocabulary_path())
CODER = bpe.WordBpe(open(bpe.vocabulary_path(), encoding="utf-8").read())


def expected(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    return ids, TOKENIZER.decode(ids, skip_special_tokens=False)


def check(text):
    packed, decoded = CODER.encode(text)
    ids, string = expected(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert decoded == string == CODER.decode(ids)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "Hello, WORLD's  best\n\ttest!!", "<|startoftext|>a<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "<|ENDOFTEXT|>",
        "ΑΣ ΣΑΣ Σ", "İstanbul DŽ ǅ", "é é ﬁ ①②", "a b c​d\x1cx\x85y᠎", "日本語 テスト 한국어", "😀😃 emoji👨‍👩‍👧", "1234 3.14 ½",
        "a" * 3000, "ab" * 700 + " " + "é" * 500, "'s 't 'RE 'll'd'", "\x00\x01", "_a_b_",
    ],
)
def test_matches_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_matches_library_on_any_text(text):
    check(text)


def test_random_words():
    r = random.Random(1)
    for _ in range(200):
        check("".join(r.choice("the anding ré'd 9.") for _ in range(r.randrange(80))))


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A b"), (4, "x" * 5000)]
    out = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5
    for row in out:
        ids, string = expected(row.text or "")
        assert (row.n_tokens, row.token_ids) == (len(ids), ids)
        assert row.decoded_sha256 == hashlib.sha256(string.encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_clashing_column_and_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and out.count() == 0


def test_every_code_point_splits_as_in_the_library():
    for first in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}! " for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        if first >= 0x558 and first < 0x20000 or first % 4096 == 0:
            check(text)
