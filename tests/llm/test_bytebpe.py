import base64
import hashlib
import random
import time

import pytest

from attest.llm import bytebpe

from .helpers import collected, documents, empty

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
POOL = "aAbBéÉ İıßΣσς'sS'tllLL''re 0129٣Ⅷ½\t\n\x1c\x1f\x85\xa0​ 　{}$#@!…—中文字あ\U0001F600̧́ﬁŉ\x00᠎़̈ⰀΑ"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rnd = random.Random(5)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [
        "", "   ", " \n\n  a", "<|endoftext|> hi", "a" * 3000, "ababab" * 300, "It's we'll 2024's", "the quick brown fox " * 500]


def test_every_character_is_cut_as_by_the_library(library):
    split = bytebpe.splitter(P.PATTERN, *bytebpe.classes())
    ranks = bytebpe.read_ranks(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5000):
        text = "a".join(chr(c) + "1 " + chr(c) for c in points[at: at + 5000])
        words = [w for part in split(text) for w in part]
        assert "".join(words) == text
        got = [i for w in words for i in bytebpe.merge(w.encode(), ranks)]
        assert got == library.encode_ordinary(text)


def test_merges_of_long_words_are_those_of_short_ones():
    ranks = bytebpe.read_ranks(PATH)
    rnd = random.Random(2)
    for _ in range(300):
        word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(2, 48))).encode()
        if word not in ranks:
            assert bytebpe._merge_long(word, ranks) == bytebpe.merge(word, ranks)


def test_a_word_of_a_megabyte_takes_seconds(library):
    ranks = bytebpe.read_ranks(PATH)
    rnd = random.Random(3)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.time()
    found = bytebpe.merge(word.encode(), ranks)
    assert time.time() - began < 60
    assert found == library.encode_ordinary(word)


def _expect(library, text):
    ids = library.encode_ordinary(text or "")
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(library.decode_bytes(ids)).hexdigest(), "ids": ids}


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_rows_are_those_of_the_library(spark, library, monkeypatch, block):
    # Small blocks: many of them, and long texts alone in theirs.
    monkeypatch.setattr(bytebpe, "BLOCK", block)
    df = documents(spark, [(t, "en") for t in _texts()])
    texts = {r["doc_id"]: r["text"] for r in collected(df)}
    rows = collected(bytebpe.encode(df, PATH, ids=True))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in collected(df))
    for r in rows:
        assert {k: v for k, v in r.items() if k != "doc_id"} == _expect(library, texts[r["doc_id"]]), texts[r["doc_id"]]
    assert collected(bytebpe.encode(empty(df), PATH)) == []


def test_kept_columns(spark, library):
    df = spark.createDataFrame([(1, "x", "one two"), (None, None, None)], "n int, s string, body string")
    rows = sorted(collected(bytebpe.encode(df, PATH, "s string, n int", "body")), key=str)
    assert {(r["s"], r["n"], r["n_tokens"]) for r in rows} == {("x", 1, len(library.encode_ordinary("one two"))), (None, None, 0)}


def test_words_forgotten_do_not_change_ids(spark, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN", 1)
    monkeypatch.setattr(bytebpe, "LISTED", 3)
    text = "one two three four one two " * 20
    row = collected(bytebpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, ids=True))[0]
    assert row["ids"] == library.encode_ordinary(text)


def test_decoding_joins_the_table(spark, library):
    texts = {i: t for i, t in enumerate(_texts()[-40:])}
    df = spark.createDataFrame([(i, library.encode_ordinary(t)) for i, t in texts.items()], "doc_id long, ids array<int>")
    rows = collected(bytebpe.decode(df, PATH))
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == texts
    with pytest.raises(Exception, match="no token has the id"):
        bytebpe.decode(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), PATH).collect()


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    rows = collected(bytebpe.op13_bytebpe(spark, d))
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: v for k, v in r.items() if k != "doc_id"} == {k: v for k, v in _expect(library, texts[r["doc_id"]]).items() if k != "ids"}
