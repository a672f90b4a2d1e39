import random
import re

import pytest

from attest.llm import spans

from .helpers import collected, documents, empty


def test_sentences_are_the_whole_text():
    for text in ("One two. Three!  Four\nfive six", "", "  \n", " lead. x", "a" * 50, "w " * 55 + ".", "a.b c. D?\n\n\nE"):
        units = spans.sentences(text)
        assert "".join(text[a:b] for a, b, *_ in units) == (text if units else "")
        assert [w for u in units for w in u[2].split()] == text.split()
        assert all(1 <= u[3] <= spans.LONG for u in units)
    assert [u[2] for u in spans.sentences("One two. Three!  Four\nfive six")] == ["One two.", "Three!", "Four", "five six"]


def brute(docs, least=2, words=12):
    """Removed sentences of each document, by comparing all runs as text."""
    units = {i: [u[2] for u in spans.sentences(t or "")] for i, t in docs.items()}
    seen = {}
    for i in sorted(units):
        u = units[i]
        size = [len(x.split()) for x in u]
        for a in range(len(u)):
            for b in range(a + least, len(u) + 1):
                enough = lambda x, y: y - x >= least and sum(size[x:y]) >= words
                if enough(a, b) and (not enough(a, b - 1) or not enough(a + 1, b)):
                    seen.setdefault(" ".join(u[a:b]), []).append((i, a, b))
    gone = {i: set() for i in docs}
    for places in seen.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b))
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randrange(9)) for _ in range(rnd.choice([1, 1, 3, 6, 9, 30]))) + rnd.choice([".", "!", "?\n"]) for _ in range(25)]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(30)]
    df = documents(spark, [(t, "en") for t in texts])
    rows = collected(spans.dedup(df))
    assert len(rows) == df.count()
    known = {r["doc_id"]: r["text"] for r in collected(df) if r["doc_id"] is not None}
    gone = brute(known)
    for r in rows:
        if r["doc_id"] is None:
            continue
        units = spans.sentences(known[r["doc_id"]] or "")
        assert {k for p in r["removed"] for k in range(p["first"], p["end"])} == gone[r["doc_id"]]
        assert r["n_sentences"] == len(units) and r["n_removed"] == len(gone[r["doc_id"]])
        left = "".join(known[r["doc_id"]][a:b] for k, (a, b, *_) in enumerate(units) if k not in gone[r["doc_id"]])
        assert r["text"] == (left if gone[r["doc_id"]] else known[r["doc_id"]])


def test_long_passages_go_but_for_the_first(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(6))
    passages = [" ".join(word() for _ in range(51)) + ".", " ".join(" ".join(word() for _ in range(rnd.randint(1, 9))) + "." for _ in range(14))]
    texts, where = [], []
    for k in range(40):
        lines = [" ".join(word() for _ in range(rnd.randint(3, 40))) + "." for _ in range(3)]
        if k % 2:
            lines.insert(1, passages[k // 2 % 2])
            where.append((k, k // 2 % 2))
        texts.append("\n".join(lines))
    rows = {r["doc_id"]: r for r in collected(spans.dedup(documents(spark, [(t, "en") for t in texts], extra=False)))}
    first = {}
    for k, p in where:
        assert (passages[p] in rows[k]["text"]) == (p not in first)
        if p in first:
            assert rows[k]["text"].split() == re.sub(re.escape(passages[p]), "", texts[k]).split()
        first.setdefault(p, k)
    assert all(rows[k]["n_removed"] == 0 and rows[k]["text"] == texts[k] for k in range(0, 40, 2))
    assert collected(spans.dedup(empty(documents(spark, [("a", "en")])))) == []


@pytest.mark.parametrize("kind", ["blanks", "none"])
def test_passages_inside_a_sentence_are_found_at_any_offset(spark, kind):
    rnd = random.Random(5)
    word = (lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))) if kind == "blanks" else (lambda: chr(rnd.randrange(0x4e00, 0x9f00)))
    blank = " " if kind == "blanks" else ""
    said = lambda n: [word() for _ in range(n)]
    passages = [said(60) for _ in range(25)]
    texts = [blank.join(said(30) + p + said(30)) for p in passages]
    texts += [blank.join(said(k) + p + said(25 - k)) for k, p in enumerate(passages)]
    rows = {r["doc_id"]: r for r in collected(spans.dedup(documents(spark, [(t, "en") for t in texts], extra=False)))}
    for k in range(25):
        assert rows[k]["text"] == texts[k]
        left, p = rows[25 + k]["text"], passages[k]
        assert sum(w not in left for w in p) >= 0.4 * len(p)
        assert all(w in left for w in texts[25 + k].split() if w not in p) if blank else left[:k] == texts[25 + k][:k]


def test_stops_of_other_scripts():
    assert [u[2].replace(" ", "") for u in spans.sentences("今天很好。我们去！「好。」他说")] == ["今天很好。", "我们去！", "「好。」", "他说"]
    assert [u[2] for u in spans.sentences("यह एक है। दो؟ তিন")] == ["यह एक है।", "दो؟", "তিন"]


def test_rows_of_one_id_or_none_keep_their_own_spans(spark):
    rnd = random.Random(6)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    shared = f"{line(9)} {line(9)}"
    own = [f"{line(8)} {line(8)} {line(8)}" for _ in range(4)]
    texts = [(None, line(5)), (None, f"{own[0]} {shared}"), (None, f"{own[1]} {own[2]} {shared}"), (7, own[3]), (7, f"{line(4)} {line(9)} {line(9)} {shared}"), (9, shared)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = collected(spans.dedup(df))
    assert len(rows) == len(texts) and sum(shared in r["text"] for r in rows) == 1
    for i, t in texts:
        left = t.replace(shared, "").strip()
        assert any(r["doc_id"] == i and r["text"].replace(shared, "").strip() == left for r in rows)
