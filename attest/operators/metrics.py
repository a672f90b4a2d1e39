"""Benchmark records, relevance and ranking metrics (V-01 .. V-09, V-14)."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as X
from ..session import materialise
from .ordered import numbered
from .topk import require_positive

Weightings = Mapping[str, Mapping[str, float]]


def check_weightings(weightings: Weightings) -> None:
    """V-14: all five weights, summing to one."""
    for name, w in weightings.items():
        missing = sorted(set(C.FEATURES) - set(w))
        if missing:
            raise ValueError(f"Weighting scheme '{name}' is missing keys: {missing}.")
        total = sum(float(w[f]) for f in C.FEATURES)
        if not math.isclose(total, 1.0, rel_tol=1e-9, abs_tol=1e-9):
            raise ValueError(f"Weighting scheme '{name}' must sum to 1.0; found {total}.")


def weighting_rejects(schemes: DataFrame) -> DataFrame:
    """V-14 as rows: the schemes (weighting and a column per feature) that ``check_weightings`` would not take, and why."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(C.FEATURES)]))
    total = sum((F.col(f) for f in C.FEATURES), F.lit(0.0))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(F.abs(total - 1.0) > 1e-9, "must sum to 1.0")
    return schemes.select("weighting", reason.alias("reason")).where("reason is not null")


def stratified_sample(chunks: DataFrame, quotas: Mapping[str, int] | int, seed: int = 42) -> DataFrame:
    """V-01: exactly n chunks per source (all when there are fewer), in the order of a seeded hash.

    The row_number filter cuts every task to n rows per source before the shuffle.
    """
    key = F.sha2(F.concat(F.lit(str(seed)), F.col("chunk_id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(key, "chunk_id"))
    if isinstance(quotas, int):
        return chunks.withColumn("__n", place).where(F.col("__n") <= quotas).drop("__n")
    if not quotas:
        return chunks.limit(0)
    largest = max(quotas.values())
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("source_id")]
    listed = chunks.where(F.col("source_id").isin(*quotas)).withColumn("__n", place).where(F.col("__n") <= largest)
    return listed.where(F.col("__n") <= quota).drop("__n")


def source_description(source_id: Column, known: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """V-02: description by the first keyword the source id contains."""
    out = None
    for key, text in known:
        hit = source_id.contains(key)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def benchmark_records(questions: DataFrame, chunks: DataFrame, characters: int | None = None) -> DataFrame:
    """V-02: query id, gold metadata and the evidence shown to the question writer, whole or its first ``characters``.

    ``questions``: chunk_id, query_text, query_type.
    """
    evidence = F.col("evidence_text") if characters is None else F.substring("evidence_text", 1, characters)
    rows = questions.join(chunks, "chunk_id")
    qid = F.concat(F.lit("q"), F.substring(F.sha2(F.concat(F.col("chunk_id").cast("string"), "query_text"), 256), 1, 8))
    gold = F.struct("source_id", "document_id", "heading_path", "citation", "block_types", "source_policy")
    return rows.select(qid.alias("query_id"), "query_text", "query_type", F.col("chunk_id").alias("gold_chunk_id"),
                       gold.alias("gold_metadata"), evidence.alias("evidence"))


def metadata(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """The five compared attributes in comparable form.

    ``df``: source_id, citation (section_ids, pdf_page_start), block_types, source_policy (authority_tier).
    """
    none = F.array().cast("array<string>")
    return df.select(
        *keys,
        F.coalesce("source_id", F.lit("")).alias(prefix + "source"),
        F.array_sort(F.array_distinct(F.coalesce("citation.section_ids", none))).alias(prefix + "sections"),
        F.col("citation.pdf_page_start").cast("int").alias(prefix + "page"),
        F.array_sort(F.array_distinct(F.coalesce("block_types", none))).alias(prefix + "types"),
        F.coalesce("source_policy.authority_tier", F.lit("")).alias(prefix + "tier"))


def gold_metadata(queries: DataFrame) -> DataFrame:
    return metadata(queries.where(F.col("gold_metadata").isNotNull()).select("query_id", "gold_metadata.*"), "g_", "query_id")


def scheme_rows(df: DataFrame, weightings: Weightings) -> DataFrame:
    """Repeat each row for every weighting scheme (a short list known to the driver)."""
    check_weightings(weightings)
    items = F.array(*[
        F.struct(F.lit(n).alias("name"), *[F.lit(float(w[f])).alias(f) for f in C.FEATURES]) for n, w in weightings.items()])
    return df.withColumn("w", F.explode(items)).withColumn("weighting", F.col("w.name"))


def weighted(source: Column, section: Column, page: Column, block_type: Column, tier: Column) -> Column:
    """V-03: the sum runs in this order in doubles, because ties at one half decide relevance."""
    flags = zip(C.FEATURES, (source, section, page, block_type, tier))
    total = None
    for name, flag in flags:
        part = F.col("w")[name] * flag.cast("double")
        total = part if total is None else total + part
    return total


def relevance(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, weightings: Weightings = C.WEIGHTINGS) -> DataFrame:
    """V-03, V-04: score and relevance of every ranked chunk per scheme."""
    rows = ranked.join(metadata(chunks, "c_", "chunk_id"), "chunk_id").join(gold_metadata(queries), "query_id")
    page = F.coalesce(F.abs(F.col("c_page") - F.col("g_page")) <= C.PAGE_DISTANCE, F.lit(False))
    rows = rows.select(
        *ranked.columns, (F.col("c_source") == F.col("g_source")).alias("f1"),
        F.arrays_overlap("c_sections", "g_sections").alias("f2"), page.alias("f3"),
        F.arrays_overlap("c_types", "g_types").alias("f4"), (F.col("c_tier") == F.col("g_tier")).alias("f5"))
    scored = scheme_rows(rows, weightings).withColumn(
        "score", weighted(*[F.col(f"f{i}") for i in range(1, 6)]))
    return scored.select(*ranked.columns, "weighting", "score", (F.col("score") > C.RELEVANT_ABOVE).alias("relevant"))


BUCKET = 32768  # combinations in a bitmap


def _bitmaps(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by`, bucket and bitmap: which numbers (no) of each bucket occur."""
    return rows.groupBy(*by, F.floor(F.col("no") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("no") % BUCKET).alias("bitmap"))


def _attributes(prefix: str, around: int = 0) -> Column:
    """The compared attributes of a row as (kind, value); a page also as the pages around it."""
    def one(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))

    def each(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))

    page = F.col(prefix + "page")
    pages = F.when(page.isNotNull(), F.sequence(page - around, page + around)).otherwise(F.array().cast("array<int>"))
    return F.concat(one("f1", F.col(prefix + "source")), each("f2", F.col(prefix + "sections")), each("f3", pages),
                    each("f4", F.col(prefix + "types")), one("f5", F.col(prefix + "tier")))


def corpus_relevant(queries: DataFrame, chunks: DataFrame, weightings: Weightings = C.WEIGHTINGS) -> DataFrame:
    """V-09: how many chunks of the corpus are relevant, per query and scheme.

    Combinations of attributes are counted and numbered. Each value of an attribute has a bitmap of the combinations that hold it,
    and each binary digit of the counts one of those that have it. A query unites the bitmaps of its values, attribute by
    attribute; every pattern of matching attributes is then an intersection, whose chunks are counted digit by digit. Queries never
    meet chunks or combinations: rows between are values of queries, and five bitmaps for each query and bucket.
    """
    check_weightings(weightings)
    combos = metadata(chunks, "c_").groupBy("c_source", "c_sections", "c_page", "c_types", "c_tier").agg(F.count("*").alias("n"))
    combos = materialise(numbered(combos, ["c_source", "c_sections", "c_page", "c_types", "c_tier"]), "combinations")
    held = _bitmaps(combos.select("no", F.explode(_attributes("c_")).alias("a")).select("no", "a.kind", "a.value").where("value is not null"), ["kind", "value"])
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda j: F.call_function("getbit", F.col("n"), j) == 1)
    counts = _bitmaps(combos.select("no", F.explode(digits).alias("digit")), ["digit"]).groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("digit", "bitmap"))).alias("digits"))  # 63 at most
    gold = materialise(gold_metadata(queries), "gold-attributes")
    asked = gold.select("query_id", F.explode(F.array_distinct(_attributes("g_", C.PAGE_DISTANCE))).alias("a")).select("query_id", "a.kind", "a.value")
    kinds = [f"f{i}" for i in range(1, 6)]
    matched = asked.join(held, ["kind", "value"]).groupBy("query_id", "bucket", "kind").agg(F.bitmap_or_agg("bitmap").alias("bitmap")) \
        .groupBy("query_id", "bucket").agg(*[F.max(F.when(F.col("kind") == k, F.col("bitmap"))).alias(k) for k in kinds])
    names = list(weightings)
    # Which patterns are relevant; the sum runs in the order of `weighted`.
    relevant = {}
    for pattern in range(32):
        for name in names:
            score = 0.0
            for i, feature in enumerate(C.FEATURES):
                score = score + float(weightings[name][feature]) * float(pattern >> i & 1)
            if score > C.RELEVANT_ABOVE:
                relevant.setdefault(pattern, []).append(names.index(name))

    @F.pandas_udf("array<long>")
    def totals(f1: pd.Series, f2: pd.Series, f3: pd.Series, f4: pd.Series, f5: pd.Series, digits: pd.Series) -> pd.Series:
        out = []
        for *bitmaps, own in zip(f1, f2, f3, f4, f5, digits):
            words = [np.frombuffer(b, np.uint64) if b is not None else np.zeros(BUCKET // 64, np.uint64) for b in bitmaps]
            weights = [(int(x["digit"]), np.frombuffer(x["bitmap"], np.uint64)) for x in own]
            found = [0] * len(names)
            for pattern, schemes in relevant.items():
                some = np.full(BUCKET // 64, np.iinfo(np.uint64).max, np.uint64)
                for i, w in enumerate(words):
                    some = some & (w if pattern >> i & 1 else ~w)
                n = sum(int(np.bitwise_count(some & w).sum()) << digit for digit, w in weights) if some.any() else 0
                for s in schemes:
                    found[s] += n
            out.append(found)
        return pd.Series(out, index=f1.index)

    counted = matched.join(counts, "bucket").select("query_id", F.posexplode(totals(*kinds, "digits")).alias("scheme", "n")) \
        .groupBy("query_id", "scheme").agg(F.sum("n").alias("n"))
    every = gold.select("query_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("scheme", "weighting"))
    return every.join(counted, ["query_id", "scheme"], "left").select("query_id", "weighting", F.coalesce("n", F.lit(0)).cast("long").alias("total_relevant"))


def ranking_metrics(scored: DataFrame, totals: DataFrame, by: Sequence[str], k: int = C.FINAL_K,
                    ideal: str = "retrieved") -> DataFrame:
    """V-05 .. V-08, V-13: DCG, nDCG, MRR and recall per ranked list.

    ``ideal="retrieved"`` re-sorts the list itself; ``"corpus"`` takes the ideal
    as k full scores, or as many as are relevant. A list is bounded by its
    candidate limit.
    """
    require_positive(k=k)
    if ideal not in ("retrieved", "corpus"):
        raise ValueError("ideal must be 'retrieved' or 'corpus'")
    by = list(by)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("rank")))
    rows = scored.withColumn("best", best)

    def gain(place: str) -> Column:
        return F.when(F.col(place) <= k, F.col("score") / F.log2(F.col(place) + 1.0)).otherwise(0.0)

    lists = rows.groupBy(*by).agg(
        F.sum(gain("rank")).alias("dcg"), F.sum(gain("best")).alias("idcg"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_relevant"),
        F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("found"), F.count("*").alias("retrieved_count"),
        X.ordered_list(F.col("chunk_id"), F.col("rank")).alias("retrieved_ids"),
        X.ordered_list(F.col("score"), F.col("rank")).alias("scores"))
    out = lists.join(totals, [c for c in ("query_id", "weighting") if c in by], "left")
    if ideal == "corpus":
        steps = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(
            i <= F.coalesce("total_relevant", F.lit(0)), 1.0 / F.log2(i + 1.0)).otherwise(0.0))
        out = out.withColumn("idcg", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x))
    total = F.coalesce("total_relevant", F.lit(0))
    return out.select(
        *by, F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)).alias("ndcg_at_10"),
        F.coalesce(1.0 / F.col("first_relevant"), F.lit(0.0)).alias("mrr"),
        F.when(total > 0, F.col("found") / total).otherwise(0.0).alias("recall_at_10"),
        total.alias("total_relevant"), "retrieved_count", "retrieved_ids", "scores")
