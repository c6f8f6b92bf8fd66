import random

import public_tokenizers
import pytest
import tiktoken

from prismatica.llm import byte_bpe


@pytest.fixture(scope="module")
def both():
    data = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = byte_bpe.read_ranks(data)
    return data, byte_bpe.Bpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_merging_on_awkward_texts(both):
    _, bpe, own = both
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "12", "!?", " ", "　", "漢", "🙂", "\x1c", "\x85", "<|endoftext|>", "x" * 30]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        assert bpe.encode(text) == own.encode_ordinary(text), repr(text)
    for text in ("", " ", "a" * 3000, " a  b   c \n\n  d\n e \n", "\n" * 50, " " * 70):
        assert bpe.encode(text) == own.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_append_and_edit_keep_the_prefix_table(both):
    _, bpe, _ = both
    rng = random.Random(6)
    for _ in range(200):
        piece, more = bytes(rng.choices(b"aetionsr", k=rng.randint(1, 30))), bytes(rng.choices(b"aetionsr", k=rng.randint(0, 10)))
        table = bpe.prefixes(piece)
        assert bpe.append(piece, table, more) == bpe.prefixes(piece + more)
        assert bpe.walk(bpe.prefixes(piece + more)) == bpe.merge(piece + more)
        cut = rng.randint(0, len(piece))
        assert bpe.edit(piece, table, cut, min(len(piece), cut + 2), more)[1] == bpe.prefixes(piece[:cut] + more + piece[cut + 2 :])


def test_documents_round_trip(spark, sf01, both):
    data, _, own = both
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.encode_documents(docs, data, public_tokenizers.PATTERN).collect():
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        assert list(memoryview(bytes(r.ids)).cast("I")) == own.encode_ordinary(texts[r.doc_id])


def test_null_empty_and_extra_columns(spark, both):
    data, _, _ = both
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "hello", 9), (2, "", 9)], "doc_id long, text string, ids int")
    rows = byte_bpe.encode_documents(docs, data, public_tokenizers.PATTERN, with_ids=False).collect()
    assert sorted(r.n_tokens for r in rows)[:3] == [0, 0, 0] and len(rows) == 4
    assert byte_bpe.encode_documents(docs.limit(0), data, public_tokenizers.PATTERN).count() == 0


def test_long_texts_and_repeated_rows(spark, both):
    data, _, own = both
    long = "some words, été 12 and  more\n" * 100_000 + "z" * 20_000
    docs = spark.createDataFrame([(1, long), (1, long), (1, "other")], "doc_id long, text string")
    rows = byte_bpe.encode_documents(docs, data, public_tokenizers.PATTERN).collect()
    want = own.encode_ordinary(long)
    assert sorted(r.n_tokens for r in rows) == sorted([len(want), len(want), len(own.encode_ordinary("other"))])
    assert all(list(memoryview(bytes(r.ids)).cast("I")) == want and bytes(r.decoded) == long.encode() for r in rows if r.n_tokens == len(want))
