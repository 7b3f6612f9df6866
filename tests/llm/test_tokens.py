import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import tokens
from docloom.llm.bpe import PIECE, TOKENIZERS, encoder


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    bpe = encoder(f"{TOKENIZERS}/{request.param}.tiktoken")
    return bpe, tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=bpe.ranks, special_tokens={})


def test_random_joins_of_tokens(both):
    bpe, public = both
    r, every = random.Random(5), list(bpe.ranks)
    texts = [b"".join(r.choices(every, k=r.randint(1, 6))).decode("utf-8", "ignore") for _ in range(3000)]
    texts += ["", " ", "\n\n  \n x", "it's 'Twas 'll''s", "a" * 5000, " " * 4000, "<|endoftext|>", "e\u0301\u200b\x1c\x85 ２²Ⅳ", "'" * 9 + "re"]
    ids, sizes = bpe.encode_flat(texts)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == public.encode_ordinary(t), t[:60]
        at += n
    assert bpe.count_batch(texts).tolist() == sizes.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_texts(texts):
    bpe = encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=bpe.ranks, special_tokens={})
    ids, sizes = bpe.encode_flat(texts)
    assert ids.tolist() == [i for t in texts for i in public.encode_ordinary(t)] and sizes.sum() == len(ids)


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, " ", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode(df).collect()), key=str)
    assert (2, []) in got and (3, None) in got and got.count((1, [31373, 995])) == 2 and len(got) == 5
    assert tokens.encode(df.limit(0)).count() == 0
    counts = {r.doc_id: r.n_tokens for r in tokens.count(df, keep=["doc_id"]).collect()}
    assert counts == {1: 2, 2: 0, 3: None, None: 1}
