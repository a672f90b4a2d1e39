import json

import pytest
from pyspark.sql import functions as F

from attest import schemas
from attest.catalog import load
from attest.operators import evidence, impact, monitor, registry
from attest.schemas import ANSWER
from attest.sources import readers, writers
from attest.streaming import logs


def _answers(spark, rows):
    return spark.createDataFrame(
        [dict(query_id=i, answer=dict(answer_status=s, direct_answer="x", claims=[dict(text="t", citation_labels=ls) for ls in claims]),
              supplied_labels=supplied, generation_error=error) for i, (s, claims, supplied, error) in enumerate(rows)],
        f"query_id int, answer {ANSWER.simpleString()}, supplied_labels array<string>, generation_error string")


def test_citations_fail_closed(spark):
    df = _answers(spark, [
        ("answered", [["S1"], ["S2", "S1"]], ["S1", "S2"], None), ("answered", [["S99"]], ["S1"], None), ("answered", [["S1"], []], ["S1"], None),
        ("insufficient_evidence", [["S1"]], ["S1"], None), ("answered", [["page"]], ["S1"], None), ("answered", [], [], None),
        ("answered", [], ["S1"], "TimeoutError: t")])
    out = {r.query_id: r for r in evidence.fail_closed(evidence.validate_citations(df)).collect()}
    checks = {i: r.citation_validation for i, r in out.items()}
    assert checks[0].is_valid and checks[0].used_labels == ["S1", "S2"] and out[0].displayed_answer.answer_status == "answered"
    assert checks[1].errors == ["Unknown citation label: S99"] and checks[1].unknown_labels == ["S99"] and out[1].fail_closed_triggered
    assert checks[2].uncited_claim_indexes == [1] and checks[2].errors == ["Claim 1 has no citations"]
    assert "insufficient_evidence" in checks[3].errors[0] and out[3].displayed_answer.claims == []
    assert checks[4].errors == ["Unknown citation label: page", "Invalid citation label syntax: page"]
    assert checks[5].is_valid and out[5].displayed_answer.answer_status == "insufficient_evidence" and not out[5].fail_closed_triggered
    assert not checks[6].is_valid and checks[6].errors == ["Generation failed: TimeoutError: t"]


def test_generator_errors_become_rows(spark):
    df = spark.createDataFrame([("a", "p", ["S1"], "ctx"), ("boom", "p", ["S1"], "ctx"), ("none", None, [], None)],
                               "query_text string, prompt string, supplied_labels array<string>, evidence_context string")

    def factory():
        def model(question, prompt, labels):
            if question == "boom":
                raise RuntimeError("down")
            return {"answer_status": "answered", "direct_answer": question, "claims": [{"text": "t", "citation_labels": labels}],
                    "uncertainty_statement": "", "clarifying_question": None, "evidence_gaps": [], "research_next_steps": []}

        return model

    got = {r.query_text: r for r in evidence.generate(df, factory).collect()}
    assert got["a"].answer.claims[0].citation_labels == ["S1"] and got["boom"].generation_error == "RuntimeError: down"
    assert got["none"].answer is None and got["none"].generation_error is None


def test_locator_without_citation(spark):
    df = spark.createDataFrame([dict(citation=dict(section_ids=[]))], f"citation {schemas.CITATION.simpleString()}")
    assert df.select(evidence.locator()).first()[0] == "No citation locator available"


def test_pairs_need_both_sides_and_take_the_last(spark):
    df = spark.createDataFrame([("q", "l", "old", None, 1), ("q", "l", "new", None, 2), ("q", "r", "x", None, 3), ("p", "l", "y", None, 4), ("p", "r", "z", "err", 5)],
                               "question_id string, case_id string, answer string, generation_error string, ingest_seq int")
    got = impact.pair_candidates(df, (("l", "r"),)).collect()
    assert len(got) == 1 and {got[0].candidate_a_answer, got[0].candidate_b_answer} == {"new", "x"}
    assert impact.pair_candidates(df, (("l", "r"),), done=spark.createDataFrame(got).select("question_id", "comparison_id")).count() == 0


def test_config_hash_equals_sorted_json(spark):
    import hashlib

    expected = hashlib.sha256(json.dumps({"prompt_version": "v3", "top_k": 10, "retrieval_config_id": "default"}, sort_keys=True).encode()).hexdigest()
    assert spark.range(1).select(monitor.config_hash(F.lit("v3"), F.lit(10), F.lit("default"))).first()[0] == expected


def test_upsert_twice_changes_nothing(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", "id1"), (2, "b", "id2")], "k int, v string, cache_id string")
    new = spark.createDataFrame([(2, "B", "id9"), (3, "c", "id3")], "k int, v string, cache_id string")
    once = writers.upsert(base, new, ["k"], keep=["cache_id"])
    rows = {tuple(r) for r in once.collect()}
    assert rows == {(1, "a", "id1"), (2, "B", "id2"), (3, "c", "id3")}
    assert {tuple(r) for r in writers.upsert(once, new, ["k"], keep=["cache_id"]).collect()} == rows
    path = str(tmp_path / "t")
    for rows in (base, new, new):
        writers.upsert_buckets(path, rows, ["k"], "v", 2, keep=["cache_id"])
    assert {tuple(r) for r in writers.read_buckets(spark, path).select("k", "v", "cache_id").collect()} == {(1, "a", "id1"), (2, "B", "id2"), (3, "c", "id3")}


def test_repeated_keys_need_an_order(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", None)], "k int, v string, at timestamp")
    twice = spark.createDataFrame([(1, "b", None), (1, "c", None)], base.schema)
    with pytest.raises(Exception, match="no order is given"):
        writers.upsert(base, twice, ["k"]).collect()
    assert [r.v for r in writers.upsert(base, twice, ["k"], order="v").collect()] == ["c"]
    stamped = writers.upsert(base, twice, ["k"], order="v", refresh="at").collect()
    assert stamped[0].at is not None


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert_buckets(path, spark.range(100).selectExpr("id k", "0 v"), ["k"], "v", 16)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("*/*.parquet")}
    writers.upsert_buckets(path, spark.createDataFrame([(5, 9)], "k long, v int"), ["k"], "v", 16)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("*/*.parquet")}
    assert len(before.keys() - after.keys()) == 1 and len(before.keys() & after.keys()) == len(before) - 1
    assert writers.read_buckets(spark, path).where("v = 9").count() == 1 and writers.read_buckets(spark, path).count() == 100


def test_readers(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text(json.dumps({"document_id": "a", "source": {"id": "s"}, "chunks": [{"chunk_id": "a:c1"}, {"chunk_id": "a:c2"}]}))
    (docs / "report.json").write_text("{}")
    got = readers.read_json_docs(spark, str(docs), schemas.CHUNKS_DOC, ["report.json"], "chunks").collect()
    assert [r.chunk_id for r in got] == ["a:c1", "a:c2"] and got[0].document_document_id == "a"
    with pytest.raises(readers.EmptyInput):
        readers.read_json_docs(spark, str(docs), schemas.CHUNKS_DOC, ["report.json", "a.json"])
    vec = tmp_path / "v"
    vec.mkdir()
    (vec / "1.jsonl").write_text('{"chunk_id": "x", "embedding": [1.0], "model_id": "m1"}\n\n{"chunk_id": "x", "embedding": [2.0], "model_id": "m2"}\n')
    (vec / "2.jsonl").write_text('{"chunk_id": "y", "embedding": [3.0]}\n')
    assert {r.chunk_id: r.embedding for r in readers.read_embeddings(spark, str(vec)).collect()} == {"x": [2.0], "y": [3.0]}
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "w?", "expected_sources": ["s"]}\n\n')
    q = readers.read_questions(spark, str(tmp_path / "q.jsonl")).collect()
    assert len(q) == 1 and q[0].expected_sources == ["s"] and q[0].expected_topics == []
    files = spark.read.format("binaryFile").load(str(docs)).select(registry.content_hash(F.col("content"))).collect()
    assert all(r[0].startswith("sha256:") for r in files)


def test_ledger_gate(spark):
    failed = spark.createDataFrame([("d", "boom")], "document_id string, error string")
    ok = spark.createDataFrame([("e", 3)], "document_id string, count long")
    rows = writers.ledger("stage", ok=ok, failed=failed)
    assert {(r.document_id, r.status, r.error, r["count"]) for r in rows.collect()} == {("d", "failed", "boom", None), ("e", "success", None, 3)}
    with pytest.raises(writers.StageFailed):
        writers.stage_gate(rows)
    writers.stage_gate(writers.ledger("stage", ok=ok))


def test_incremental_load_drops_copies_and_is_repeatable(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    schema = spark.createDataFrame([], "k int, v string, at timestamp").schema
    spark.sql("select 1 k, 'a' v, timestamp'2024-01-01 00:00:00' at union all select 1, 'a', timestamp'2024-01-01 00:00:00'").coalesce(1).write.json(source)
    run = logs.load_increments(logs.read_increments(spark, source, schema), table, ["k"], state, "at", at="at")
    run.awaitTermination()
    spark.sql("select 1 k, 'b' v, timestamp'2024-02-01 00:00:00' at union all select 2, 'c', timestamp'2024-02-01 00:00:00'").coalesce(1).write.mode("append").json(source)
    for _ in range(2):
        logs.load_increments(logs.read_increments(spark, source, schema), table, ["k"], state, "at", at="at").awaitTermination()
    assert {(r.k, r.v) for r in writers.read_buckets(spark, table).collect()} == {(1, "b"), (2, "c")}


def test_streams_read_tables_that_are_folders_of_files(spark, tmp_path):
    registered, _ = load()
    said = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(tuple(r) for r in registered["stream_upserts"](spark, str(tmp_path)).collect()) == [r[:3] for r in said]
    spark.sql("select explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-03 02:00:00')) ts, 'view' event_type, 1.5D value").repartition(2) \
        .write.parquet(f"{tmp_path}/events.parquet")
    assert [r.day for r in registered["stream_daily_status"](spark, str(tmp_path)).collect()] == ["2024-01-01"]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert registered["stream_upserts"](spark, f"{tmp_path}/none").count() == 0
