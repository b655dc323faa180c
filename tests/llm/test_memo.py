from beamloom.llm import byte_bpe


def test_a_full_memo_keeps_what_is_asked_for(monkeypatch):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"abcd": 258, b"abcde": 259, b"bc": 260, b"cd": 261, b"de": 262, b"xabcd": 263}
    bpe = byte_bpe.PrefixBPE(ranks, r"[a-z]+|[^a-z]+")
    assert bpe.lengths[b"abcd"] == (5, 4, 2, 1)  # by the last four bytes; no token of three ends so
    first = bpe.encode("zabab abcdz bcde")
    monkeypatch.setattr(byte_bpe, "CACHED_BYTES", 100)
    assert bpe.encode("bcde zabab") == bpe.encode("bcde") + [32] + bpe.encode("zabab") and bpe.encode("zabab abcdz bcde") == first
    bpe.encode_all(["bcde zabab"])
    kept = dict(bpe.pieces)
    bpe.trim(1.0, {"bcde", "unseen"})
    assert bpe.pieces == {"bcde": kept["bcde"]}
