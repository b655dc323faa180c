import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beamloom.llm import byte_bpe, token_files

RANKS = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
OURS = byte_bpe.PrefixBPE(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
with open(P.path("word_bpe_49k.json")) as f:
    WORDS = token_files._Words(f.read())
UNTOUCHED = Tokenizer.from_file(P.path("word_bpe_49k.json"))
TEXTS = [None, "", "a", " ", "\n\n x  y ", "l'été où ß ñ 你好 🙂", "x" * 3000, "the cat sat " * 400, "1234 %%% ***", "<|endoftext|> <|startoftext|>", "a<|endoftext|>B <|ENDOFTEXT|> c", "x<|startoftext|", "y" * 70 + " " + "Z" * 90]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_equal_the_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


def test_any_bytes_equal_the_library():
    rnd, tokens = random.Random(1), list(RANKS)
    for _ in range(2000):
        data = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 5)))
        assert OURS.encode_piece(data) == THEIRS._core_bpe.encode_single_piece(data)


def test_appends_and_edits_equal_encoding_anew():
    rnd = random.Random(2)
    for _ in range(100):
        data = bytes(rnd.choice(b"theingandor ") for _ in range(200))
        e = byte_bpe.EditableEncoding(OURS, data[:50])
        e.append(data[50:])
        a = rnd.randint(0, 190)
        b = rnd.randint(a, 200)
        new = bytes(rnd.choice(b"theing ") for _ in range(rnd.randint(0, 8)))
        computed = e.replace(a, b, new)
        data = data[:a] + new + data[b:]
        assert e.data == data and e.last == byte_bpe.EditableEncoding(OURS, data).last
        assert computed <= len(data) - a


def test_encode_documents(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(1, "", "x", "y"), (None, "b", "", "")], "doc_id long, text string, ids string, n_tokens string")
    got = byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = THEIRS.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    full = byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(bytes(r.decoded).decode() == ("b" if r.doc_id is None else TEXTS[r.doc_id] or "") for r in full.collect())
    assert byte_bpe.encode_documents(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** min(bits, 31), 1003).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, len(ids)) == ids).all()
    ends = np.array([0, 10, 500, 1003])
    f = token_files.TokenFile(token_files.build(ids, ends, bits, block=64))
    assert (f.read(0, 2000) == ids).all() and (f.read(130, 131) == ids[130:131]).all() and (f.document(2) == ids[10:500]).all() and not len(f.document(0))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aÉéΣİßñ你🙂  '.,!*\n\u0301\u00a0\x1c3sSłK\u0327") | st.text() | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", " ", "a"])).map("".join), max_size=6))
def test_words_equal_whole_texts(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.by_word(texts)] == [UNTOUCHED.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_are_those_of_the_library():
    assert np.frombuffer(WORDS.by_word(["<|endoftext|>"])[0], "<u4").tolist() == [49407]


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)][::-1] + [(3, " ", 2), (None, "b", 3)], "doc_id long, text string, part int")
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    files = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), file_ids=300)
    got = token_files.read_token_files(files, digests=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    start = 0
    for r in got:
        ids = tok.encode("b" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = token_files.read_token_files(files).orderBy("start").collect()
    assert [len(r.ids) for r in whole] == [r.n_tokens for r in got]
    names = token_files.export(files, str(tmp_path))
    assert sum(token_files.TokenFile((tmp_path / n).read_bytes()).n_ids for n in names) == start
    empty = token_files.write_token_files(docs.limit(0), P.path("word_bpe_49k.json"))
    assert token_files.read_token_files(empty).count() == 0
