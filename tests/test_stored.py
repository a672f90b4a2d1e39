"""Stored cells, late text, versions across batches, resumable embedding, neighbours and bounded parts."""
import random
import tempfile
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.operators import embed, fetch, html, hybrid, metrics, neighbours
from attest.operators.ordered import numbered
from attest.operators.vector_search import vector_topk
from attest.sources import writers
from attest.sources.vector_index import VectorIndex, recall


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def rows(df):
    return sorted(map(str, df.collect()))


# --- cells ------------------------------------------------------------------------------------


def test_cells_after_replacements(spark):
    rng = np.random.default_rng(3)
    now = {i: [float(x) for x in rng.standard_normal(8)] for i in range(200)}
    schema = "chunk_id long, embedding array<float>"
    index = VectorIndex.create(spark, folder("cells"), spark.createDataFrame(list(now.items()), schema), lists=6)
    index.add(spark.createDataFrame([*now.items(), (900, None), (901, [0.0] * 8)], schema))
    for step in range(2):
        changed = {i: [float(x) for x in rng.standard_normal(8)] for i in rng.choice(260, 60, replace=False).tolist()}
        now |= changed
        batch = spark.createDataFrame(list(changed.items()), schema)
        index.add(batch)
        if step:
            index.add(batch)  # once more: nothing changes
    assert {r["chunk_id"]: r["embedding"] for r in index.placed().collect()} == {
        r["chunk_id"]: r["embedding"] for r in spark.createDataFrame(list(now.items()), schema).collect()}
    queries = spark.createDataFrame([(i, now[i]) for i in range(0, 200, 20)], "query_id long, embedding array<float>")
    exact = vector_topk(queries, spark.createDataFrame(list(now.items()), schema), 7)
    found = index.search(queries, 7, n_probe=6)
    assert rows(found.select("query_id", "chunk_id", "vector_rank")) == rows(exact.select("query_id", "chunk_id", "vector_rank"))
    assert recall(exact, found).first()[0] == 1.0
    assert 0 < recall(exact, index.search(queries, 7, n_probe=1)).first()[0] <= 1
    assert index.search(queries.limit(0), 3).isEmpty()


def test_codes_stay_within_their_bounds(spark):
    from attest.sources.vector_index import _coded

    rng = np.random.default_rng(5)
    unit = rng.standard_normal((300, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centre = unit[0]
    codes, scale, left_out = _coded(unit, centre)
    for q in unit[:20]:
        about = centre @ q + (codes * scale[:, None]) @ q
        assert (np.abs(about - unit @ q) <= left_out + 1e-9).all()


# --- late text --------------------------------------------------------------------------------


def test_fetched_rows_are_those_asked_for(spark):
    table = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("text"))
    ids = spark.createDataFrame([(f"c{i}",) for i in (1, 1, 7, 4999, 6000)] + [(None,)], "chunk_id string")
    assert rows(fetch.fetched(table, ids)) == rows(table.where(F.col("chunk_id").isin("c1", "c7", "c4999")))
    assert fetch.fetched(table, ids.limit(0)).isEmpty()
    passed = fetch.maybe(table, "chunk_id", fetch.bloom(ids.na.drop().distinct(), "chunk_id", 4)).count()
    assert 3 <= passed <= 60


def test_one_text_exchange_for_all_variants(spark):
    chunks = spark.createDataFrame([(i, f"text {i} alpha") for i in range(30)], "chunk_id long, evidence_text string")
    queries = spark.createDataFrame([(1, "alpha 3"), (2, "text 5")], "query_id long, query_text string")
    ranked = [(q, c, n + 1) for q in (1, 2) for n, c in enumerate(random.Random(q).sample(range(30), 10))]
    lexical = spark.createDataFrame(ranked, "query_id long, chunk_id long, lexical_rank int")
    vector = spark.createDataFrame(ranked[::-1], "query_id long, chunk_id long, vector_rank int")
    out = hybrid.variants(lexical, vector, queries, chunks, (0.5,))
    assert out.where("retriever like '%rerank'").count() > 0
    # The plan reads the fetched table only, never the corpus.
    lines = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "evidence_text" in x and ("Relation" in x or "LogicalRDD" in x)]
    assert lines and all("parquet" in x for x in lines)


# --- batches ----------------------------------------------------------------------------------


def test_versions_give_one_table_in_any_order(spark):
    rng = random.Random(7)
    everything = [(k, v, f"row {k}.{v}") for k in range(6) for v in range(5)] + [(9, None, "no version")]
    rng.shuffle(everything)
    batches = [everything[:10], everything[10:20], everything[20:]]
    schema = "k int, version int, text string"
    for order in permutations(range(3)):
        table = spark.createDataFrame([], schema)
        for n in order:
            table = writers.upsert(table, spark.createDataFrame(batches[n], schema), ["k"], version="version")
        assert sorted((r["k"], r["version"], r["text"]) for r in table.collect()) == [(k, 4, f"row {k}.4") for k in range(6)] + [(9, None, "no version")]


def test_versions_must_be_stored(spark):
    base = spark.createDataFrame([(1, 9, "new")], "k int, version int, text string")
    late = spark.createDataFrame([(1, 3, "old")], "k int, version int, text string")
    assert writers.upsert(base, late, ["k"], version="version").first()["text"] == "new"
    assert writers.upsert(base, late, ["k"], order="version").first()["text"] == "old"  # within the batch only
    same = spark.createDataFrame([(1, 9, "again")], "k int, version int, text string")
    assert writers.upsert(base, same, ["k"], version="version").first()["text"] == "again"
    for options in ({"version": "text", "order": "version"}, {"version": "other"}, {"version": "version", "keep": ["version"]}):
        with pytest.raises(ValueError):
            writers.upsert(base, late, ["k"], **options)


def test_bucketed_versions(spark):
    path = folder("versions")
    schema = "k int, version int, text string"
    for batch in ([(1, 9, "new"), (2, 1, "two")], [(1, 3, "old"), (3, 1, "three")], [(1, 3, "old"), (3, 1, "three")]):
        writers.upsert_buckets(path, spark.createDataFrame(batch, schema), ["k"], buckets=4, version="version")
    assert sorted(r["text"] for r in writers.read_buckets(spark, path).collect()) == ["new", "three", "two"]


# --- embedding --------------------------------------------------------------------------------


def test_only_failed_batches_are_embedded_again(spark):
    data = [(i, i // 3, f"text {i}") for i in range(12)] + [(12, 4, None)]
    df = spark.createDataFrame(data, "chunk_id long, batch long, text string")
    run = embed.EmbeddingRun(spark, folder("embed"))
    seen = folder("seen")

    def model(attempt):
        def factory():
            def f(texts):
                import os
                import uuid

                for t in texts:
                    open(os.path.join(seen, f"{attempt}-{t.replace(' ', '_')}-{uuid.uuid4().hex}"), "w").close()
                if attempt == 1 and "text 4" in texts:
                    raise TimeoutError("late")
                return [[1.0, float(len(t)), 0.0] for t in texts]
            return f
        return factory

    assert run.vectors(df).isEmpty() and run.dead_letters(df).isEmpty()
    assert run.resume(df, "text", model(1), prefix="") == 1
    assert sorted(r["chunk_id"] for r in run.dead_letters(df).collect()) == [3, 4, 5]
    assert run.resume(df, "text", model(2), prefix="") == 2
    report = {r["batch"]: (r["rows"], r["failed_attempts"], r["embedded_in"], r["last_error"]) for r in run.report(df).collect()}
    assert report == {0: (3, 0, 1, None), 1: (3, 1, 2, "TimeoutError: late"), 2: (3, 0, 1, None), 3: (3, 0, 1, None), 4: (1, 0, 1, None)}
    import os

    again = {f.split("-")[1] for f in os.listdir(seen) if f.startswith("2-")}
    assert again == {"text_3", "text_4", "text_5"}
    assert run.vectors(df).count() == 13
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in run.vectors(df).collect())


# --- neighbours and parts ---------------------------------------------------------------------


def test_neighbours_never_repeat(spark):
    chain = spark.createDataFrame([(f"d{d}.{o}", f"d{d}", o, 10 + o) for d in range(3) for o in range(8)], "chunk_id string, document_id string, chunk_ordinal int, tokens int")
    found = spark.createDataFrame([(1, "d0.2", 1), (1, "d0.4", 2), (1, "d1.0", 3), (2, "d2.7", 1)], "query_id int, chunk_id string, rank int")
    out = [r.asDict() for r in neighbours.expand(found, chain, 1).collect()]
    got = sorted((r["query_id"], r["chunk_id"], r["distance"], r["found_rank"]) for r in out)
    assert got == [(1, "d0.1", 1, 1), (1, "d0.2", 0, 1), (1, "d0.3", 1, 1), (1, "d0.4", 0, 2), (1, "d0.5", 1, 2), (1, "d1.0", 0, 3), (1, "d1.1", 1, 3),
                   (2, "d2.6", 1, 1), (2, "d2.7", 0, 1)]
    passages = sorted((r["query_id"], r["document_id"], r["first_ordinal"], r["last_ordinal"], r["n_chunks"], r["tokens"]) for r in neighbours.intervals(
        neighbours.expand(found, chain, 1)).collect())
    assert passages == [(1, "d0", 1, 5, 5, 65), (1, "d1", 0, 1, 2, 21), (2, "d2", 6, 7, 2, 33)]
    # Within the budget: the results first (12 + 14 + 10), then the nearest of the best.
    kept = sorted(r["chunk_id"] for r in neighbours.expand(found, chain, 1, 48).where("query_id = 1").collect())
    assert kept == ["d0.1", "d0.2", "d0.4", "d1.0"]
    assert rows(neighbours.expand(found, chain, 0).select("chunk_id")) == rows(found.select("chunk_id"))


def test_parts_joined_are_the_text(spark):
    rnd = random.Random(2)
    pages = [(f"d{d}", n, rnd.choice(("", None, "x" * rnd.randint(1, 200)))) for d in range(3) for n in range(1, 60)]
    df = spark.createDataFrame(pages, "document_id string, page_number long, text string")
    whole = {r["document_id"]: r["structured_text"] for r in html.structured_pages(df).collect()}
    parts = {}
    for r in sorted(html.structured_parts(df, 500, segment=16).collect(), key=lambda r: (r["document_id"], r["part"])):
        assert r["start"] == sum(map(len, parts.get(r["document_id"], [])))
        parts.setdefault(r["document_id"], []).append(r["text"])
    assert {d: "".join(p) for d, p in parts.items()} == whole
    assert max(len(p) for ps in parts.values() for p in ps) < 500 + 220 and min(map(len, parts.values())) > 1


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = {r["no"]: r["k"] for r in numbered(df, ["k"]).collect()}
    assert [got[i] for i in range(1000)] == sorted(i * 7919 % 1009 for i in range(1000))
    assert numbered(df.limit(0), ["k"]).isEmpty()


# --- relevance --------------------------------------------------------------------------------


def test_relevance_counts_are_those_of_comparing_all(spark):
    rnd = random.Random(11)

    def attributes():
        return (rnd.choice(("a", "b", None)), rnd.choice(([], ["1"], ["1", "2"], ["3"], None)), rnd.choice((None, 1, 2, 5, 9)), rnd.choice((["p"], ["p", "t"], ["t"])), rnd.choice(("x", "y", None)))

    shape = "source_id string, citation struct<section_ids: array<string>, pdf_page_start: int>, block_types array<string>, source_policy struct<authority_tier: string>"

    def record(a):
        return (a[0], (a[1], a[2]), a[3], (a[4],))

    corpus, asked = [attributes() for _ in range(400)], [attributes() for _ in range(12)]
    chunks = spark.createDataFrame([(i, *record(a)) for i, a in enumerate(corpus)], f"chunk_id long, {shape}")
    columns = ["source_id", "citation", "block_types", "source_policy"]
    queries = spark.createDataFrame([(i, *record(a)) for i, a in enumerate(asked)], f"query_id long, {shape}").select("query_id", F.struct(*columns).alias("gold_metadata"))
    schemes = {"even": dict(zip(metrics.C.FEATURES, (0.2,) * 5)), "heavy": dict(zip(metrics.C.FEATURES, (0.6, 0.1, 0.1, 0.1, 0.1)))}

    def score(q, c, w):
        near = q[2] is not None and c[2] is not None and abs(q[2] - c[2]) <= 2
        flags = ((q[0] or "") == (c[0] or ""), bool(set(q[1] or ()) & set(c[1] or ())), near, bool(set(q[3]) & set(c[3])), (q[4] or "") == (c[4] or ""))
        total = 0.0
        for f, hit in zip(metrics.C.FEATURES, flags):
            total += w[f] * float(hit)
        return total

    got = {(r["query_id"], r["weighting"]): r["total_relevant"] for r in metrics.corpus_relevant(queries, chunks, schemes).collect()}
    assert got == {(i, n): sum(score(q, c, w) > metrics.C.RELEVANT_ABOVE for c in corpus) for i, q in enumerate(asked) for n, w in schemes.items()}
