"""Stages of the corpus pipeline: (spark, docs, folder of the tables) to documents, the last to token digests."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.fetch import bloom, maybe
from . import langid, secrets, simhash, winnow
from .bpe import encode
from .common import materialise, per_row, table

__all__ = ["language", "near_dedup", "decontaminate", "redact", "tokens", "materialise"]

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3  # calibrated probability below which no language is told


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not null, with a letter, and a probability of LEAST_SCORE or more.

    The model learns from the rows themselves (see langid.learn); a row without a language gets the one told. Without
    any row that names a language nothing can be told and only texts without a letter go.
    """
    rows = _documents(docs)
    model = langid.learn(rows.filter("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").alias("id"), "text", "lang"))
    told = langid.predict(rows, model, COLUMNS)
    if model is None:
        return rows.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)) \
        .select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each component of similar texts; repeated rows of it count as copies, too.

    Similar are texts whose distinct shingles of five words have a Jaccard similarity of 0.8 or more; wide fingerprints choose
    the pairs that are compared. Rows without an id stay, each: they cannot be told apart.
    """
    rows = _documents(docs)
    found = simhash.similar_texts(rows.select("doc_id", "text"))
    named = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = materialise(named.filter("not stays").select("doc_id"), "copied-documents")
    # Rows that are surely no copies stay where they lie; only the others meet the ids that go.
    bits = bloom(gone, "doc_id", gone.count())
    with_id = rows.filter("doc_id is not null")
    single = maybe(with_id, "doc_id", bits, others=True).union(maybe(with_id, "doc_id", bits).join(gone, "doc_id", "left_anti").select(*NAMES))
    repeated = materialise(single.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-documents")
    if not repeated.isEmpty():
        first = single.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("s"))
        single = single.join(repeated, "doc_id", "left_anti").select(*NAMES).union(first.select("doc_id", "s.*"))
    return single.select(*NAMES).union(rows.filter("doc_id is null").select(*NAMES))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand in a ten-word window of a benchmark item, and n_chars of what is left.

    A hit run goes with the signs between its words; all documents stay, and a text without hits stays as it is.
    """
    found = winnow.contamination(_documents(docs), table(spark, sf_dir, "benchmark"), keep=COLUMNS, cut=True)
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by [kind], spans that overlap by the first one's kind."""
    found = secrets.scan(_documents(docs), secrets.new_ledger(spark), keep=NAMES)

    def replacer():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, spans = batch.column("text"), batch.column("spans").to_pylist()
            changed = [i for i, s in enumerate(spans) if s]
            out = texts.to_pylist() if changed else texts
            for i in changed:
                kept, at = [], 0
                for s in spans[i]:
                    if s["start"] >= at:
                        kept += [out[i][at: s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                out[i] = "".join([*kept, out[i][at:]])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), *(batch.column(n) for n in NAMES[2:])], list(NAMES))
        return f

    return per_row(found.select(*NAMES, "spans"), replacer, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path(name), "doc_id long")
