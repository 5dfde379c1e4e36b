import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quire.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def same(text: str) -> None:
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    packed = bpe.loaded(PATH).encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == wanted
    assert bpe.loaded(PATH).decode(np.frombuffer(packed, "<u4")).decode() == LIBRARY.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello, World's 123 tests!", "a" * 5000, "aaa aaaa aaaaa", "x<|endoftext|>y <|startoftext|>", "ΑΣΑΣ ΟΔΟΣ İI ẞß", "é  \x85\x1cfoo\x1d", "naïve\tcafé\r\n ñandú straße", "日本語 テスト 한국어", "\x00\x01 � \U0001f600\U0001f468‍\U0001f469", "'s 't're I'll don't"],
)
def test_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abdehinorst ", max_size=80))
def test_words(text):
    same(text)


def test_table(spark):
    texts = [None, "", "one two", "one two", "long " * 40_000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids string")
    found = {r["doc_id"]: r for r in bpe.digests(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert back[0]["ids"] == [] and back[0]["decoded"] == ""
    assert back[2]["decoded"] == LIBRARY.decode(back[2]["ids"], skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).collect() == []
