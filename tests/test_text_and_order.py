import random
import re

import pytest
from pyspark.sql import functions as F

from attest.functions import text as X
from attest.functions import vectors as V
from attest.operators import ordered
from attest.operators.topk import exact_median, first_wins, last_wins, split_blank, top_k

TEXTS = ["a  b\t c d", "  ", "", "don't well-known (x) 12.5 naïve ²", "x y\x1cz", "l1\r\nl2\n\nl4\n", "end\r", "’tis o’clock"]


def test_whitespace_tokens_and_lines_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    out = df.select("i", X.collapse(F.col("t")).alias("c"), X.token_count(F.col("t")).alias("n"), X.word_count(F.col("t")).alias("w"),
                    X.lines(F.col("t")).alias("l")).orderBy("i").collect()
    token = re.compile(r"\w+(?:['’-]\w+)?|[^\w\s]")
    for row, text in zip(out, TEXTS):
        assert row.c == " ".join(text.split())
        assert row.n == len(token.findall(text))
        assert row.w == len(text.split())
        assert (row.l or []) == text.splitlines()


def test_heading_path_split(spark):
    df = spark.createDataFrame([("A  x >   > B ",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(X.heading_path(F.col("p"))).collect()] == [["A x", "B"], [], []]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.7071067811865475) < 1e-12 and got[1] is None


def _documents(seed, n_docs=4, longest=300):
    rng = random.Random(seed)
    rows = []
    for d in range(n_docs):
        # The first document holds most rows, so it spans many segments.
        for p in range(longest if d == 0 else rng.randint(0, 25)):
            level = rng.choice([None, None, None, 1, 2, 3, 4])
            rows.append((f"d{d}", p, level, f"h{rng.randint(0, 3)}" if level else None, rng.randint(0, 2)))
    return rows


def test_heading_stack_equals_a_sequential_stack(spark):
    rows = _documents(1)
    df = spark.createDataFrame(rows, "doc string, pos int, level int, h string, k int").withColumn("seg", ordered.segment_of(F.col("pos"), 7))
    out = ordered.heading_stack(df, ["doc"], "seg", ["pos"], "level", F.col("h"), max_level=4)
    got = {(r.doc, r.pos): r.heading_path for r in out.collect()}
    stack, current = {}, None
    for doc, pos, level, h, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if doc != current:
            stack, current = {}, doc
        if level:
            stack = {k: v for k, v in stack.items() if k < level}
            stack[level] = h
        assert got[doc, pos] == [stack[k] for k in sorted(stack)]
    assert len(got) == len(rows)


def test_scan_and_adjacent_repeats_cross_segments(spark):
    rows = _documents(2)
    df = spark.createDataFrame(rows, "doc string, pos int, level int, h string, k int").withColumn("seg", ordered.segment_of(F.col("pos"), 5))
    out = ordered.scan(df, ["doc"], "seg", ["pos"], sums={"s": F.col("k")}, lags={"b": F.col("level")}, leads={"a": F.col("k")})
    got = {(r.doc, r.pos): r for r in out.collect()}
    marked = {(r.doc, r.pos): r.is_repeat for r in ordered.dedup_adjacent(df, ["doc"], "seg", ["pos"], ["level", "k"]).collect()}
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        by_doc.setdefault(r[0], []).append(r)
    for doc, items in by_doc.items():
        total = 0
        for i, r in enumerate(items):
            total += r[4]
            g = got[doc, r[1]]
            assert g.s == total
            assert (g.b is None) == (i == 0) and (i == 0 or g.b.v == items[i - 1][2])
            assert (g.a is None) == (i == len(items) - 1) and (g.a is None or g.a.v == items[i + 1][4])
            assert marked[doc, r[1]] == (i > 0 and (items[i - 1][2], items[i - 1][4]) == (r[2], r[4]))


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "x"), ("b", 2, None), ("a", 2, "y")], "k string, o int, v string")
    assert {r.k: r.v for r in first_wins(df, ["k"], ["o"]).collect()} == {"a": "x", "b": None}
    assert {r.k: r.v for r in last_wins(df, ["k"], ["o"]).collect()} == {"a": "z", "b": None}


def test_exact_median_with_ties_and_small_groups(spark):
    rng = random.Random(3)
    data = {"hot": [rng.choice([1.0, 2.0, 50.0]) for _ in range(3001)], "even": [4.0, 1.0, 3.0, 2.0], "one": [7.5]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    import statistics

    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in data.items()}


def test_parameter_checks(spark):
    import pytest

    df = spark.createDataFrame([(1, "q"), (2, " ")], "query_id int, query_text string")
    with pytest.raises(ValueError):
        top_k(df, ["query_id"], [F.asc("query_id")], 0)
    good, bad = split_blank(df, "query_text")
    assert [r.query_id for r in good.collect()] == [1] and bad.first().reason == "blank query"


def test_heading_deeper_than_declared_is_an_error(spark):
    df = spark.createDataFrame([("d", 0, i, lv, f"h{lv}") for i, lv in enumerate((1, 7, 8, 9))], "doc string, seg int, pos int, level int, h string")
    out = ordered.heading_stack(df, ["doc"], "seg", ["pos"], "level", F.col("h"), max_level=9).orderBy("pos").collect()
    assert [r.heading_path for r in out] == [["h1"], ["h1", "h7"], ["h1", "h7", "h8"], ["h1", "h7", "h8", "h9"]]
    with pytest.raises(Exception, match="deeper than the declared level"):
        ordered.heading_stack(df, ["doc"], "seg", ["pos"], "level", F.col("h"), max_level=7).collect()
