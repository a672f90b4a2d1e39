from pyspark.sql import functions as F

from attest import config as C
from attest.operators import embed
from attest.plans import answering, corpus


def test_pages_to_answers_and_cache(spark):
    pages = spark.createDataFrame([
        ("doc", "src", "h", 1, "1.1 Meters\nA smart meter records energy. It must be sealed.\n1.2 Inverters\nAn inverter must stop within two seconds."),
        ("doc", "src", "h", 2, "1.3 Forms\nThe form has three parts.")],
        "document_id string, source_id string, source_hash string, page_number int, text string")
    documents = spark.createDataFrame([("doc", "src", "pdf", "1.0", "h", "Rules")],
                                      "document_id string, source_id string, source_type string, schema_version string, content_hash string, title string")
    policies = spark.createDataFrame([("src", "primary_governing", "default_current", "current_candidate")],
                                     "source_id string, authority_tier string, retrieval_tier string, currency_status string")
    blocks = corpus.blocks_of_pages(pages, {})
    chunks, rows = corpus.build_chunks(blocks, documents, policies, C.ChunkLimits(20, 40, 5))
    assert chunks.count() == 3 and [r.status for r in rows.collect()] == ["success"]

    model = embed.HashedTfidf(256).fit(chunks, "embedding_text")
    vectors = model.transform(chunks, "embedding_text").select("chunk_id", "embedding")
    questions = spark.createDataFrame([("q1", "When must an inverter stop?"), ("q2", " ")], "query_id string, query_text string")
    cache = spark.createDataFrame([], "cache_id string, question_text string, config_hash string, answer_status string")
    hits, new, rejected = answering.answer_batch(questions, cache, vectors, chunks, model, k=2, characters=None)
    got = new.collect()
    assert hits.count() == 0 and [r.query_id for r in rejected.collect()] == ["q2"] and len(got) == 1
    assert got[0].citation_validation.is_valid and "inverter" in got[0].evidence_snapshot[0].evidence_text
    kept = answering.remember(cache, new)
    hits, again, _ = answering.answer_batch(questions, kept, vectors, chunks, model, k=2, characters=None)
    assert hits.count() == 1 and again.count() == 0
