import math
import random

import pytest
from pyspark.sql import functions as F

from attest import config as C
from attest.operators import embed, grid, hybrid, lexical, metrics, vector_search

VECTORS = "chunk_id string, embedding array<float>"


def _vectors(spark, n, dim=6, seed=5):
    rng = random.Random(seed)
    rows = [(f"c{i:03d}", [round(rng.gauss(0, 1), 2) for _ in range(dim)]) for i in range(n)]
    # A third of all vectors are copies of one.
    rows = [(c, rows[0][1] if i % 3 == 0 else v) for i, (c, v) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(4)


def _brute(queries, vectors, k):
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    import numpy as np

    out = {}
    for q, a in queries:
        a = [float(np.float32(x)) for x in a]
        scored = sorted((-round(cos(a, [float(np.float32(x)) for x in b]), 10), c) for c, b in vectors)
        out[q] = [c for _, c in scored[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 200, "tile_bytes": 1000}])
def test_exact_vector_topk_with_copies(spark, options):
    rows, df = _vectors(spark, 90)
    queries = rows[:7]
    q = spark.createDataFrame(queries, VECTORS).withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in vector_search.vector_topk(q, df, 8, **options).orderBy("vector_rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == _brute(queries, rows, 8)


def test_cells_with_all_probes_are_exact_and_full_cells_are_cut(spark):
    rows, df = _vectors(spark, 60)
    queries = rows[:4]
    q = spark.createDataFrame(queries, VECTORS).withColumnRenamed("chunk_id", "query_id")
    centres = [r[1] for r in rows[:5]]
    out = vector_search.ivf_topk(q, df, 6, n_probe=5, centres=centres, tile_bytes=6 * 8 * 7)
    got = {}
    for r in out.orderBy("vector_rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == _brute(queries, rows, 6)


def test_embedding_retries_and_reports(spark):
    df = spark.createDataFrame([("c1", "ab"), ("c2", "bad"), ("c3", "abcd")], "chunk_id string, t string").coalesce(1)

    def factory():
        calls = {"n": 0}

        def model(texts):
            calls["n"] += 1
            if any("bad" in t for t in texts):
                raise ValueError("no")
            if calls["n"] == 1:
                raise OSError("first call fails")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    got = {r.chunk_id: r for r in embed.embed(df, "t", factory, prefix="p: ", batch=1, wait=0.0).collect()}
    assert abs(math.hypot(*got["c1"].embedding) - 1) < 1e-6 and got["c1"].embed_error is None
    assert got["c2"].embedding is None and got["c2"].embed_error == "ValueError: no"


CHUNKS = "chunk_id string, heading_path array<string>, evidence_text string"


def _posted(spark):
    return lexical.postings(spark.createDataFrame([
        ("a", ["Meter rules"], "a smart inverter needs a meter"), ("b", [], "inverter smart, not in order. inverter meter"),
        ("c", ["Other"], "nothing of the kind"), ("d", [], "smart grid inverter far away from the meter")], CHUNKS), stemmed=False)


def _match(spark, text):
    terms = lexical.query_terms(spark.createDataFrame([("q", text)], "query_id string, query_text string"), stemmed=False)
    return sorted({r.chunk_id for r in lexical.lexical_match(terms, _posted(spark)).collect()})


def test_web_style_matching(spark):
    assert _match(spark, "smart meter") == ["a", "b", "d"]
    assert _match(spark, '"smart inverter"') == ["a"]
    assert _match(spark, "smart -grid") == ["a", "b"]
    assert _match(spark, 'kind or "smart grid"') == ["c", "d"]
    assert _match(spark, '"inverter needs a meter"') == ["a"]
    assert _match(spark, "-smart") == [] and _match(spark, "the of") == []


def test_maps_of_a_chunk_are_copied_for_rarest_words_only(spark):
    """A chunk of many asked words goes on once for each group that stands under one of its words, before any group is matched."""
    text = " ".join(f"w{i}" for i in range(300))
    posted = lexical.postings(spark.createDataFrame([("a", [], text), ("b", [], text + " rare")], CHUNKS), stemmed=False)
    queries = spark.createDataFrame([("q", text + " rare"), ("r", "w1 or rare")], "query_id string, query_text string")
    found = lexical._candidates(lexical.query_terms(queries, stemmed=False), posted)
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r.part.group_no, r.chunk_id) for r in found.collect())
    assert got == [("q", 0, "b"), ("r", 0, "a"), ("r", 0, "b"), ("r", 1, "b")]


def test_relevance_reads_the_attributes_of_ranked_chunks_only(spark):
    """The corpus is read for the gold chunks; those that are ranked were fetched before."""
    from attest.catalog import evaluation

    plan = evaluation.metadata_relevance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("n_chars") and plan.count("Relation [doc_id") == 1


def test_cover_density_by_hand(spark):
    q = spark.createDataFrame([("q", "smart inverter")], "query_id string, query_text string")
    got = {r.chunk_id: r.lexical_score for r in lexical.lexical_topk(q, _posted(spark), 10, stemmed=False).collect()}
    # Covers have two hits of weight 0.4, so 0.4 each, divided by one plus the words between.
    expected = {"a": 0.4, "b": 0.4 + 0.4 / 4, "d": 0.4 / 2}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v / (v + 1), 9) for k, v in expected.items()}


def test_rrf_limits_equal_each_side(spark):
    lex = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, lexical_rank int")
    vec = spark.createDataFrame([("q", "c", 1), ("q", "b", 2)], "query_id string, chunk_id string, vector_rank int")
    rows = hybrid.rrf(lex, vec, (0.0, 0.5, 1.0), k=10).collect()

    def order(alpha):
        return [r.chunk_id for r in sorted((r for r in rows if r.alpha == alpha), key=lambda r: r.hybrid_rank)]

    assert order(1.0)[:2] == ["a", "b"] and order(0.0)[:2] == ["c", "b"] and order(0.5) == ["b", "a", "c"]
    assert all(r.lexical_rank or r.vector_rank for r in rows)
    with pytest.raises(ValueError):
        hybrid.rrf(lex, vec, (1.5,))


def test_rerank_keeps_prior_order_on_ties_and_uses_models(spark):
    cands = spark.createDataFrame([("q", c, i) for i, c in enumerate("abcd", 1)], "query_id string, chunk_id string, r int")
    q = spark.createDataFrame([("q", "red blue")], "query_id string, query_text string")
    chunks = spark.createDataFrame([("a", "x"), ("b", "red"), ("c", "blue red"), ("d", "red blue")], "chunk_id string, evidence_text string")
    got = hybrid.rerank(cands, q, chunks, "r", k=3, limit=3).orderBy("rerank_rank").collect()
    assert [r.chunk_id for r in got] == ["c", "b", "a"]
    model = hybrid.model_scorer(lambda: (lambda pairs: [len(d) for _, d in pairs]), batch=2)
    got = hybrid.rerank(cands, q, chunks, "r", scorer=model, characters=4, k=2).orderBy("rerank_rank").collect()
    assert [r.chunk_id for r in got] == ["c", "d"]


def test_expansion_falls_back(spark):
    df = spark.createDataFrame([(1, "q", ["a", " b", "c", "d", "e", " "], None), (2, "q", ["a"], None), (3, "q", None, "E: x")],
                               "query_id int, query_text string, terms array<string>, error string")
    got = {r.query_id: (r.retrieval_query, r.status) for r in hybrid.expand_queries(df).collect()}
    assert got == {1: ("q a b c d e", "expanded"), 2: ("q", "fallback_invalid_term_count"), 3: ("q", "fallback_error")}


# --- metrics ----------------------------------------------------------------------------------


def _scored(spark, scores):
    return spark.createDataFrame([("q", "equal", f"c{i}", i, float(s), s > 0.5) for i, s in enumerate(scores, 1)],
                                 "query_id string, weighting string, chunk_id string, rank int, score double, relevant boolean")


def _metrics(spark, scores, total, **options):
    totals = spark.createDataFrame([("q", "equal", total)], "query_id string, weighting string, total_relevant long")
    return metrics.ranking_metrics(_scored(spark, scores), totals, ["query_id", "weighting"], **options).first()


def test_metric_values(spark):
    assert _metrics(spark, [1.0, 0.8, 0.2], 2).ndcg_at_10 == 1.0
    m = _metrics(spark, [0.1, 0.2, 0.9, 0.6], 4)
    assert m.mrr == 1 / 3 and m.recall_at_10 == 0.5
    none = _metrics(spark, [0.0, 0.5], 0)
    assert (none.mrr, none.recall_at_10) == (0.0, 0.0) and _metrics(spark, [0.0], 0).ndcg_at_10 == 0.0
    assert _metrics(spark, [1.0, 0.0], 3, ideal="corpus").ndcg_at_10 == pytest.approx(1 / (1 + 1 / math.log2(3) + 0.5))
    # Recall looks at k, the reciprocal rank at the whole list.
    deep = _metrics(spark, [0.0] * 11 + [1.0], 1)
    assert deep.mrr == 1 / 12 and deep.recall_at_10 == 0.0


def test_corpus_counts_equal_brute_force(spark):
    rng = random.Random(9)

    def meta():
        return {"source_id": rng.choice(["s1", "s1", "s2", None]),
                "citation": {"section_ids": rng.sample(["1", "2", "3", "4"], rng.randint(0, 3)) or None, "pdf_page_start": rng.choice([None, 1, 2, 4, 7])},
                "block_types": rng.sample(["p", "h", "t"], rng.randint(0, 2)), "source_policy": {"authority_tier": rng.choice([None, "a", "b"])}}

    schema = ("source_id string, citation struct<section_ids:array<string>,pdf_page_start:int>, block_types array<string>, "
              "source_policy struct<authority_tier:string>")
    chunks, golds = [meta() for _ in range(120)], [meta() for _ in range(12)]
    cdf = spark.createDataFrame([dict(chunk_id=f"c{i}", **m) for i, m in enumerate(chunks)], "chunk_id string, " + schema)
    gdf = spark.createDataFrame([dict(query_id=f"q{i}", gold_metadata=m) for i, m in enumerate(golds)],
                                f"query_id string, gold_metadata struct<{schema.replace(' struct', ': struct').replace(' string', ':string').replace(' array', ': array')}>")

    def score(c, g, w):
        pc, pg = c["citation"]["pdf_page_start"], g["citation"]["pdf_page_start"]
        flags = (c["source_id"] == g["source_id"], bool(set(c["citation"]["section_ids"] or []) & set(g["citation"]["section_ids"] or [])),
                 pc is not None and pg is not None and abs(pc - pg) <= 2, bool(set(c["block_types"]) & set(g["block_types"])),
                 (c["source_policy"]["authority_tier"] or "") == (g["source_policy"]["authority_tier"] or ""))
        total = 0.0
        for f, on in zip(C.FEATURES, flags):
            total += w[f] * float(on)
        return total

    got = {(r.query_id, r.weighting): r.total_relevant for r in metrics.corpus_relevant(gdf, cdf).collect()}
    for i, g in enumerate(golds):
        for name, w in C.WEIGHTINGS.items():
            assert got[f"q{i}", name] == sum(score(c, g, w) > 0.5 for c in chunks)


def test_weighting_and_result_checks(spark):
    with pytest.raises(ValueError, match="sum to 1.0"):
        metrics.check_weightings({"x": {f: 0.3 for f in C.FEATURES}})
    with pytest.raises(ValueError, match="missing keys"):
        metrics.check_weightings({"x": {"source": 1.0}})
    with pytest.raises(grid.InvalidResults):
        grid.check_results(spark.createDataFrame([], "query_id string, retriever string, weighting string, ndcg_at_10 double, mrr double, recall_at_10 double"))


def test_summary_keeps_alphas_apart_and_ties_differ(spark):
    rows = [("q1", "hybrid", 0.3, "equal", 1.0, 1.0, 0.5), ("q2", "hybrid", 0.3, "equal", 0.0, 1.0, 0.5), ("q1", "hybrid", 0.5, "equal", 0.5, 1.0, 0.5),
            ("q1", "hybrid", 0.5, "equal", 0.5, 1.0, 0.5), ("q1", "vector", None, "equal", 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "query_id string, retriever string, alpha double, weighting string, ndcg_at_10 double, mrr double, recall_at_10 double")
    grid.check_results(df)
    s = grid.summarise(df)
    got = {r.configuration: r for r in s.collect()}
    a, b = (f"retriever=hybrid | alpha={x} | weighting=equal" for x in ("0.30", "0.50"))
    assert set(got) == {a, b, "retriever=vector | alpha=n/a | weighting=equal"}
    assert (got[a].queries_evaluated, got[b].queries_evaluated, got[b].records_aggregated) == (2, 1, 2)
    assert got[a].ndcg_at_10_std == 0.5 and got[a].composite_score == pytest.approx(0.5 * 0.5 + 0.3 + 0.1)
    assert {r.configuration for r in grid.best_by_metric(s).collect()} == {b}
    assert grid.ranked(s, 1, ["mrr_mean"]).first().configuration == a
    assert grid.recommended(s).first().configuration == b


STEMS = """consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolatory consolatori
consoles consol consolidating consolid consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir knackeries knackeri knavish knavish
kneeling kneel knightly knight knitted knit knives knive interconnections interconnect interconnection interconnect running run happily happili generate generat
communism communism arsenal arsenal hopping hop hoping hope cries cri ties tie gas gas kiwis kiwi gaps gap agreed agre feed feed skies sky dying die news news
exceeds exceed inning inning say say by by cry cri enjoy enjoy relational relat valenci valenc digitizer digit feudalism feudal hopefulness hope
callousness callous formalize formal electrical electr goodness good airliner airlin replacement replac adoption adopt rate rate controll control bed bed
luxuriated luxuri hopped hop failing fail only onli geology geolog early earli toy toy youth youth"""


def test_stems_are_the_published_ones(spark):
    from attest.functions.stem import stems

    words = STEMS.split()
    known = dict(zip(words[::2], words[1::2]))
    got = {r.lexeme: r.stem for r in stems(spark.createDataFrame([(w,) for w in [*known, None]], "lexeme string")).collect()}
    assert got == known


def test_search_finds_other_forms_of_a_word(spark):
    chunks = spark.createDataFrame([("a", ["Rules"], "the interconnection of plants"), ("b", [], "other text")], "chunk_id string, heading_path array<string>, evidence_text string")
    q = spark.createDataFrame([("q", "interconnections ruling")], "query_id string, query_text string")
    assert [r.chunk_id for r in lexical.lexical_topk(q, lexical.postings(chunks), 5).collect()] == ["a"]
    assert lexical.lexical_topk(q, lexical.postings(chunks, stemmed=False), 5, stemmed=False).count() == 0


def test_postings_are_made_without_a_shuffle(spark):
    posted = _posted(spark)
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    rows = {(r.chunk_id, r.lexeme): ([(h.pos, h.inv) for h in r.hits], r.n_a, r.n_b) for r in posted.collect()}
    assert rows["a", "meter"] == ([(1, 1.0), (8, 2.5)], 1, 1) and rows["b", "inverter"] == ([(1, 2.5), (6, 2.5)], 0, 2)
    assert ("a", "a") not in rows and len(rows) == 17


def test_hits_of_groups_that_a_chunk_lacks_count_in_covers(spark):
    q = spark.createDataFrame([("q", "smart meter or grid absent")], "query_id string, query_text string")
    got = {r.chunk_id: r.lexical_score for r in lexical.lexical_topk(q, _posted(spark), 10, stemmed=False).collect()}
    # d: smart 1, grid 2, meter 8: three hits from smart to meter, with five other words between them.
    r = 0.4 / 6
    assert round(got["d"], 9) == round(r / (r + 1), 9)


def test_few_keys_go_to_the_postings(spark):
    keys = lexical.sent(spark.createDataFrame([("meter",)], "lexeme string").distinct(), "test-keys")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _posted(spark).join(keys, "lexeme", "left_semi")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
