import hashlib
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from attest.llm import bpe, bytebpe

from .helpers import collected, documents, empty

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
POOL = "aAbBéÉ İıßΣσς'sS'tllLL''re 0129٣Ⅷ½\t\n\x1c\x85\xa0​ 　{}$#@!…—中文字あ\U0001F600̧́ﬁŉ\x00᠎"


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def _texts():
    rnd = random.Random(5)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(600)] + [
        "", "   ", "<|startoftext|> hi <|endoftext|><|endoftext|>x", "<|StartOfText|>", "a" * 3000, "ababab" * 300, "ΑΣ ΑΣ", "It's we'll 2024's",
        "the quick brown fox " * 500]


def test_same_ids_and_text_as_the_library(library):
    texts = _texts()
    encoder = bpe.Encoder(bpe.Vocabulary.read(PATH))
    for text, (ids, decoded), expected in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert [int(i) for i in ids.split()] == expected.ids, text
        assert decoded == library.decode(expected.ids, skip_special_tokens=False)


def test_long_words(library, monkeypatch):
    """A megabyte of letters takes seconds; rounds of long words give the ids of plain rounds."""
    vocabulary = bpe.Vocabulary.read(PATH)
    rnd = random.Random(8)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.time()
    found = vocabulary.encode_words([word.encode()])[0]
    assert time.time() - began < 60
    assert found.tolist() == library.encode(word, add_special_tokens=False).ids
    words = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 90))).encode() for pool in ("ab", "a", "ether", "abcdefghijklmnopqrstuvwxyzé") for _ in range(60)]
    plain = [w.tolist() for w in vocabulary.encode_words(words)]
    monkeypatch.setattr(bpe, "LONG", 0)
    assert [w.tolist() for w in vocabulary.encode_words(words)] == plain


def test_every_character_is_classed_as_by_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for pattern, ranges in zip((r"\p{L}", r"\p{N}"), bytebpe.classes()):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed")
        kept = {c for part, _ in split.pre_tokenize_str("".join(every)) for c in part}
        mine = regex.compile(f"[{ranges}]")
        assert [c for c in every if (mine.match(c) is None) != (c in kept)] == []


def test_query_rows(spark, library):
    df = documents(spark, [("The cat's <|endoftext|> hat", "en"), ("ÄÖ ß 12", "de")])
    rows = collected(bpe.encode(df, PATH, "doc_id long", ids=True))
    assert len(rows) == df.count()
    texts = {r["doc_id"]: r["text"] or "" for r in collected(df)}
    for r in rows:
        e = library.encode(texts[r["doc_id"]], add_special_tokens=False)
        assert r["ids"] == e.ids and r["n_tokens"] == len(e.ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert collected(bpe.encode(empty(df), PATH, "doc_id long")) == []


def test_words_forgotten_do_not_change_ids(monkeypatch, spark):
    monkeypatch.setattr(bpe, "CACHED", 2)
    encoder = bpe.Encoder(bpe.Vocabulary.read(PATH))
    first = encoder.encode(["one two three four"])
    encoder.encode(["five six seven"])
    assert encoder.encode(["one two three four"]) == first and len(encoder.ids) <= 4


def test_registered(spark):
    df = bpe.op2_bpe(spark, "/root/testdata/sf0.001")
    assert df.agg(F.count("*"), F.min("n_tokens")).first()[0] == 200
