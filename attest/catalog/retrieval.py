"""Vector, lexical and fused retrieval over vectors, documents and benchmark items."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as X
from ..operators import embed, hybrid, lexical, neighbours, vector_search
from ..operators.hybrid import overlap_scorer, rerank, rrf, variants
from ..operators.topk import top_k
from ..session import checkpoint_folder, materialise
from ..sources import vector_index
from . import query
from .common import (CHUNKS_SQL, SQL_STOP, SQL_WORD, benchmark_queries, document_chunks, document_index, document_postings, once, query_vectors,
                     sql_words, table, vector_table)

K = 10


def _vector_sql(queries: str, k: int, where: str = "true") -> str:
    return f"""
vec as (select vec_id chunk_id, embedding::double[] v from embeddings where {where}),
asked as ({queries}),
pairs as (select query_id, chunk_id, round(list_cosine_similarity(q, v), 10) similarity from asked, vec),
vector_ranked as (
  select *, row_number() over (partition by query_id order by similarity desc, chunk_id) vector_rank from pairs
  qualify vector_rank <= {k})
"""


ALL_QUERIES = "select vec_id query_id, embedding::double[] q from embeddings"
BENCH_QUERIES = "select item_id query_id, embedding::double[] q from benchmark join embeddings on vec_id = item_id"


@query("vector_topk", f"with {_vector_sql(ALL_QUERIES, K)} select query_id, chunk_id, round(similarity, 6) similarity, vector_rank::int vector_rank from vector_ranked")
def vector_topk(spark, d):
    vectors = vector_table(spark, d)
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "embedding")
    out = vector_search.vector_topk(queries, vectors, K)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_by_source", f"with {_vector_sql(BENCH_QUERIES, K, 'label = 3')} select query_id, chunk_id, round(similarity, 6) similarity, vector_rank::int vector_rank from vector_ranked")
def vector_topk_by_source(spark, d):
    out = vector_search.vector_topk(query_vectors(spark, d), vector_table(spark, d), K, F.col("source_id") == 3)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_tiled", f"with {_vector_sql(BENCH_QUERIES, K)} select query_id, chunk_id, round(similarity, 6) similarity, vector_rank::int vector_rank from vector_ranked")
def vector_topk_tiled(spark, d):
    """The layout for query batches above the broadcast bound."""
    out = vector_search.vector_topk(
        query_vectors(spark, d), vector_table(spark, d), K, broadcast_bytes=1 << 13, tile_bytes=1 << 17)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("ivf_every_cell", f"with {_vector_sql(BENCH_QUERIES, K)} select query_id, chunk_id, round(similarity, 6) similarity, vector_rank::int vector_rank from vector_ranked")
def ivf_every_cell(spark, d):
    """Cells around given centres; with all of them probed the search is exact."""
    vectors = vector_table(spark, d)
    centres = [[float(x) for x in r["embedding"]] for r in vectors.where("chunk_id < 8").select("embedding").collect()]
    out = vector_search.ivf_topk(query_vectors(spark, d), vectors, K, lists=8, n_probe=8, centres=centres)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("vector_unit_norm_gate", """
select vec_id chunk_id, list_filter([case when len(embedding) <> 64 then 'dimension' end,
  case when not abs(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) - 1) < 1e-7 then 'norm' end],
  lambda x: x is not null) violations
from embeddings where len(violations) > 0""")
def vector_unit_norm_gate(spark, d):
    return vector_search.vector_violations(vector_table(spark, d), dimension=64, tolerance=1e-7)


@query("ivf_topk")
def ivf_topk(spark, d):
    return vector_search.ivf_topk(query_vectors(spark, d), vector_table(spark, d), K, lists=16, n_probe=4)


@query("ivf_recall")
def ivf_recall(spark, d):
    """Share of the exact best k that the cells find, per number of cells probed."""
    queries, vectors = query_vectors(spark, d), vector_table(spark, d)
    centres = vector_search.fit_cells(vectors, 16)
    exact = vector_search.vector_topk(queries, vectors, K).select("query_id", "chunk_id")
    total = exact.groupBy("query_id").agg(F.count("*").alias("n"))
    out = None
    for probes in (1, 4, 16):
        found = vector_search.ivf_topk(queries, vectors, K, n_probe=probes, centres=centres)
        hits = exact.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
            F.count("*").alias("hits"))
        part = total.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
        part = part.select(F.lit(probes).alias("n_probe"), "recall")
        out = part if out is None else out.unionByName(part)
    return out


LISTS = 16


@once
def stored_cells(spark, d):
    """A stored index of all vectors around sixteen of them; two thirds were placed first, the others later, some of the first again."""
    vectors, n = vector_table(spark, d), F.col("chunk_id")
    centres = [[float(x) for x in r["embedding"]] for r in vectors.where(n < LISTS).orderBy(n).select("embedding").collect()]
    index = vector_index.VectorIndex.create(spark, f"{checkpoint_folder(spark)}/attest/cells-{uuid.uuid4().hex}", centres=centres)
    turned = F.when(n % 5 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    index.add(vectors.where(n % 3 != 0).withColumn("embedding", turned))
    index.add(vectors.where((n % 3 == 0) | (n % 5 == 0)))
    return index


def _cells_sql(probes: str) -> str:
    """The best k of each query within its nearest cells, for numbers of cells."""
    return f"""
vec as (select vec_id chunk_id, embedding::double[] v from embeddings),
centres as (select vec_id cell, embedding::double[] c from embeddings where vec_id < {LISTS}),
cell_of as (select chunk_id, v, arg_min(cell, (-round(list_cosine_similarity(v, c), 10), cell)) cell from vec, centres group by 1, 2),
asked as ({BENCH_QUERIES}),
probed as (
  select query_id, q, cell, row_number() over (partition by query_id order by round(list_cosine_similarity(q, c), 10) desc, cell) place from asked, centres),
near as (
  select n_probe, query_id, chunk_id, round(list_cosine_similarity(q, v), 10) similarity
  from probed join cell_of on cell_of.cell = probed.cell, (values {probes}) p(n_probe) where place <= n_probe),
near_ranked as (
  select *, row_number() over (partition by n_probe, query_id order by similarity desc, chunk_id) vector_rank from near qualify vector_rank <= {K})"""


@query("cells_topk", f"with {_cells_sql('(4)')} select query_id, chunk_id, round(similarity, 6) similarity, vector_rank::int vector_rank from near_ranked")
def cells_topk(spark, d):
    """The best ten within the four nearest cells of a stored index."""
    out = stored_cells(spark, d).search(query_vectors(spark, d), K, n_probe=4)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("cells_recall", f"""with {_cells_sql('(1), (4), (8), (12), (16)')},
best as (
  select query_id, chunk_id from (select query_id, chunk_id, row_number() over (partition by query_id order by round(list_cosine_similarity(q, v), 10) desc, chunk_id) n from asked, vec)
  where n <= {K})
select n_probe::int n_probe, round(avg(hits / n), 6) recall from (
  select n_probe, b.query_id, count(*) n, count(r.chunk_id)::double hits
  from best b cross join (values (1), (4), (8), (12), (16)) p(n_probe) left join near_ranked r using (n_probe, query_id, chunk_id) group by 1, 2) group by 1""")
def cells_recall(spark, d):
    """Share of the exact best ten that a stored index finds, by the number of cells that are read."""
    index, queries = stored_cells(spark, d), query_vectors(spark, d)
    exact = materialise(vector_search.vector_topk(queries, vector_table(spark, d), K).select("query_id", "chunk_id"), "exact")
    parts = [vector_index.recall(exact, index.search(queries, K, n_probe=n)).select(F.lit(n).alias("n_probe"), F.round("recall", 6).alias("recall"))
             for n in (1, 4, 8, 12, 16)]
    return reduce(DataFrame.union, parts)


@query("embedding_batch")
def embedding_batch(spark, d):
    """Documents embedded by the native model, as records."""
    rows = document_chunks(spark, d).withColumnRenamed("evidence_text", "embedding_text")
    model = embed.HashedTfidf(128).fit(rows, "embedding_text")
    done = model.transform(rows, "embedding_text").withColumn("embed_error", F.lit(None).cast("string"))
    return embed.embedding_records(done, "hashed-tfidf-128").drop("embedded_at")


@query("embedding_counts", "select 'd' || doc_id document_id, 1 embedded, 0 failed from documents")
def embedding_counts(spark, d):
    rows = document_chunks(spark, d)

    def factory():
        return lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]

    return embed.embedding_counts(embed.embed(rows, "evidence_text", factory))


def _unsteady(attempt: int):
    """A model that fails on some texts: on one kind in its first two attempts, on another kind always."""
    def factory():
        def model(texts):
            if any(len(t) % 89 == 0 for t in texts):
                raise ValueError("a text that the model cannot take")
            if attempt < 3 and any(len(t) % 41 == attempt for t in texts):
                raise TimeoutError(f"no answer in attempt {attempt}")
            return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]
        return model
    return factory


_HELD = "sum((length(text) % 89 = 0)::int) > 0"


@query("embedding_recovery", f"""
with b as (
  select doc_id // 4 as batch, count(*) as "rows", {_HELD} never, sum((length(text) % 41 = 1)::int) > 0 one, sum((length(text) % 41 = 2)::int) > 0 two
  from documents group by 1)
select batch, "rows", (case when never then 3 when one and two then 2 when one then 1 else 0 end)::bigint failed_attempts,
  case when never then null when one and two then 3 when one then 2 else 1 end embedded_in,
  case when never then 'ValueError: a text that the model cannot take' when one and two then 'TimeoutError: no answer in attempt 2' when one then 'TimeoutError: no answer in attempt 1' end last_error
from b""")
def embedding_recovery(spark, d):
    """All documents in batches of four ids: some batches fail once or twice and recover, some stay dead letters."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).cast("long").alias("batch"), "text")
    run = embed.EmbeddingRun(spark, f"{checkpoint_folder(spark)}/attest/embedding-{uuid.uuid4().hex}")
    for attempt in (1, 2, 3):
        run.resume(rows, "text", _unsteady(attempt), prefix="")
    return run.report(rows)


# --- lexical ----------------------------------------------------------------------------------

POSTINGS_SQL = CHUNKS_SQL + f""",
heading_words as (
  select chunk_id, unnest(w) lexeme, generate_subscripts(w, 1) pos from (
    select chunk_id, {sql_words("array_to_string(heading_path, ' ')")} w from docs)),
heading_kept as (select * from heading_words where lexeme not in ({SQL_STOP})),
shifts as (select chunk_id, max(pos) shift from heading_kept group by 1),
evidence_words as (
  select chunk_id, unnest(w) lexeme, generate_subscripts(w, 1) pos from (
    select chunk_id, {sql_words('evidence_text')} w from docs)),
occurrences as (
  select chunk_id, lexeme, pos, 'A' tag from heading_kept
  union all
  select e.chunk_id, lexeme, pos + coalesce(shift, 0), 'B' from evidence_words e left join shifts s on s.chunk_id = e.chunk_id
  where lexeme not in ({SQL_STOP})),
posted as (
  select lexeme, chunk_id, count(*) filter (tag = 'A') n_a, count(*) filter (tag = 'B') n_b from occurrences group by all)
"""


@query("postings", f"with {POSTINGS_SQL} select lexeme, chunk_id, n_a, n_b from posted")
def postings(spark, d):
    return document_postings(spark, d).select("lexeme", "chunk_id", "n_a", "n_b")


def terms_sql(source: str) -> str:
    return f"""
queries as ({source}),
raw_items as (
  select query_id, unnest(r) raw, generate_subscripts(r, 1) - 1 element from (
    select query_id, regexp_extract_all(query_text, '-?"[^"]*"|[^\\s]+') r from queries)),
items as (select *, sum(case when lower(raw) = 'or' then 1 else 0 end) over (partition by query_id order by element) group_no from raw_items),
item_words as (
  select query_id, group_no, element, starts_with(raw, '-') negated, unnest(w) lexeme, generate_subscripts(w, 1) - 1 "offset" from (
    select *, {sql_words('raw')} w from items where lower(raw) <> 'or')),
terms as (select * from item_words where lexeme not in ({SQL_STOP})),
sizes as (select query_id, group_no, element, negated, count(*) n_words from terms group by all),
needs as (select query_id, group_no, count(*) n_needed from sizes where not negated group by all),
element_hits as (
  select distinct query_id, group_no, chunk_id, element, negated from (
    select t.query_id, t.group_no, o.chunk_id, t.element, t.negated, case when n_words = 1 then 0 else o.pos - t."offset" end base
    from terms t join sizes s on s.query_id = t.query_id and s.group_no = t.group_no and s.element = t.element
    join occurrences o on o.lexeme = t.lexeme
    group by all having count(distinct t."offset") = max(s.n_words))),
matched as (
  select h.query_id, h.group_no, chunk_id from element_hits h join needs n on n.query_id = h.query_id and n.group_no = h.group_no
  group by all having count(*) filter (negated) = 0 and count(*) filter (not negated) = max(n_needed))
"""


BENCHMARK_SOURCE = "select item_id query_id, text query_text from benchmark"


def web_queries(spark, d):
    """Phrases, alternatives and exclusions built from all words of each benchmark item, six at a time."""
    last = F.size("w") - 1
    marked = F.transform("w", lambda x, i: F.when((i % 6 == 0) & (i < last), F.concat(F.lit('"'), x))
                         .when(i % 6 == 1, F.concat(x, F.lit('" or'))).when((i % 6 == 2) & (i < last), F.concat(F.lit('"'), x))
                         .when(i % 6 == 3, F.concat(x, F.lit('"'))).when(i % 6 == 4, F.concat(F.lit("-"), x, F.lit(" or")))
                         .when(i % 6 == 5, F.concat(x, F.lit(" or"))).otherwise(x))
    return benchmark_queries(spark, d).select("query_id", F.split("query_text", r"\s+").alias("w")).select(
        "query_id", F.array_join(marked, " ").alias("query_text"))


WEB_SOURCE = """
select query_id, array_to_string(list(case
    when (n - 1) % 6 = 0 and n < len(w) then '"' || x when (n - 1) % 6 = 1 then x || '" or' when (n - 1) % 6 = 2 and n < len(w) then '"' || x
    when (n - 1) % 6 = 3 then x || '"' when (n - 1) % 6 = 4 then '-' || x || ' or' when (n - 1) % 6 = 5 then x || ' or' else x end order by n), ' ') query_text
from (select item_id query_id, w, unnest(w) x, generate_subscripts(w, 1) n from (select item_id, regexp_split_to_array(text, '\\s+') w from benchmark)) group by 1"""


@query("query_terms", f"""with {CHUNKS_SQL}, occurrences as (select 0 chunk_id, '' lexeme, 0 pos), {terms_sql(WEB_SOURCE)}
select query_id, group_no::int group_no, element::int element, negated, "offset"::int as "offset", lexeme from terms""")
def query_terms(spark, d):
    return lexical.query_terms(web_queries(spark, d), stemmed=False).select("query_id", "group_no", "element", "negated", "offset", "lexeme")


@query("lexical_and_match", f"with {POSTINGS_SQL}, {terms_sql(BENCHMARK_SOURCE)} select query_id, group_no::int group_no, chunk_id from matched")
def lexical_and_match(spark, d):
    posted = document_postings(spark, d)
    return lexical.lexical_match(lexical.query_terms(benchmark_queries(spark, d), stemmed=False), posted).select("query_id", "group_no", "chunk_id")


@query("lexical_web_match", f"with {POSTINGS_SQL}, {terms_sql(WEB_SOURCE)} select query_id, group_no::int group_no, chunk_id from matched")
def lexical_web_match(spark, d):
    posted = document_postings(spark, d)
    return lexical.lexical_match(lexical.query_terms(web_queries(spark, d), stemmed=False), posted).select("query_id", "group_no", "chunk_id")


TF_SQL = """
tf_scores as (
  select query_id, chunk_id, sum(w) r from (
    select distinct t.query_id, m.chunk_id, t.lexeme, n_a * 1.0::double + n_b * 0.4::double w
    from terms t join matched m on m.query_id = t.query_id and m.group_no = t.group_no
    join posted p on p.chunk_id = m.chunk_id and p.lexeme = t.lexeme where not t.negated)
  group by all),
lexical_ranked as (
  select query_id, chunk_id, r / (r + 1) lexical_score,
    row_number() over (partition by query_id order by round(r / (r + 1), 10) desc, chunk_id) lexical_rank
  from tf_scores qualify lexical_rank <= {k})
"""

COVER_SQL = """
wanted as (select distinct query_id, group_no, lexeme from terms where not negated),
chosen as (select distinct query_id, chunk_id from matched),
entries as (
  select c.query_id, c.chunk_id, o.lexeme, o.pos, case when tag = 'A' then 1.0::double else 2.5::double end inv
  from chosen c join (select distinct query_id, lexeme from wanted) w on w.query_id = c.query_id
  join occurrences o on o.chunk_id = c.chunk_id and o.lexeme = w.lexeme),
numbered_entries as (
  select *, row_number() over w i, sum(inv) over w cum from entries window w as (partition by query_id, chunk_id order by pos)),
lasts as (
  select e.query_id, e.chunk_id, e.i, w.group_no, w.lexeme, max(x.i) last_i
  from numbered_entries e join wanted w on w.query_id = e.query_id
  left join numbered_entries x on x.query_id = e.query_id and x.chunk_id = e.chunk_id and x.lexeme = w.lexeme and x.i <= e.i
  group by all),
lefts as (
  select query_id, chunk_id, i, max(l) l from (
    select query_id, chunk_id, i, group_no, case when count(*) = count(last_i) then min(last_i) end l from lasts group by all)
  group by all),
moved as (select *, lag(l) over (partition by query_id, chunk_id order by i) before from lefts),
covers as (
  select m.query_id, m.chunk_id, ((m.i - m.l + 1) / (e.cum - b.cum + b.inv)) / (1 + (e.pos - b.pos) - (m.i - m.l)) s
  from moved m join numbered_entries e on e.query_id = m.query_id and e.chunk_id = m.chunk_id and e.i = m.i
  join numbered_entries b on b.query_id = m.query_id and b.chunk_id = m.chunk_id and b.i = m.l
  where m.l > coalesce(m.before, -1)),
cover_scores as (select query_id, chunk_id, sum(s) r from covers group by all),
lexical_ranked as (
  select query_id, chunk_id, r / (r + 1) lexical_score,
    row_number() over (partition by query_id order by round(r / (r + 1), 10) desc, chunk_id) lexical_rank
  from cover_scores qualify lexical_rank <= {k})
"""
LEXICAL_OUT = " select query_id, chunk_id, round(lexical_score, 6) lexical_score, lexical_rank::int lexical_rank from lexical_ranked"


@query("lexical_topk", f"with {POSTINGS_SQL}, {terms_sql(BENCHMARK_SOURCE)}, {TF_SQL.format(k=K)}{LEXICAL_OUT}")
def lexical_topk(spark, d):
    posted = document_postings(spark, d)
    out = lexical.lexical_topk(benchmark_queries(spark, d), posted, K, "tf_weighted", stemmed=False)
    return out.withColumn("lexical_score", F.round("lexical_score", 6))


@query("cover_density", f"with {POSTINGS_SQL}, {terms_sql(BENCHMARK_SOURCE)}, {COVER_SQL.format(k=K)}{LEXICAL_OUT}")
def cover_density(spark, d):
    posted = document_postings(spark, d)
    out = lexical.lexical_topk(benchmark_queries(spark, d), posted, K, "cover_density", stemmed=False)
    return out.withColumn("lexical_score", F.round("lexical_score", 6))


@query("cover_density_web", f"with {POSTINGS_SQL}, {terms_sql(WEB_SOURCE)}, {COVER_SQL.format(k=K)}{LEXICAL_OUT}")
def cover_density_web(spark, d):
    posted = document_postings(spark, d)
    out = lexical.lexical_topk(web_queries(spark, d), posted, K, "cover_density", stemmed=False)
    return out.withColumn("lexical_score", F.round("lexical_score", 6))


@query("rejected_queries", f"""with {CHUNKS_SQL}, occurrences as (select 0 chunk_id, '' lexeme, 0 pos),
{terms_sql("select turn + conv_id * 1000 query_id, case when turn % 2 = 0 then '-' || array_to_string(regexp_split_to_array(text, '\\s+'), ' -') else text end query_text from conversations")}
select query_id, 'no searchable term' reason from queries where query_id not in (select query_id from terms where not negated)""")
def rejected_queries(spark, d):
    """Every second turn with all its words excluded: such a query ranks nothing."""
    excluded = F.concat(F.lit("-"), F.array_join(F.split("text", r"\s+"), " -"))
    rows = table(spark, d, "conversations").select(
        (F.col("turn") + F.col("conv_id") * 1000).alias("query_id"), F.when(F.col("turn") % 2 == 0, excluded).otherwise(F.col("text")).alias("query_text"))
    return lexical.rejected_queries(rows, lexical.query_terms(rows, stemmed=False)).select("query_id", "reason")


@query("vector_rejects", """
select chunk_id, reason from (
  select doc_id chunk_id, case when doc_id % 3 = 0 then 'no vector' when doc_id % 3 = 1 then 'no direction' end reason from documents)
where reason is not null""")
def vector_rejects(spark, d):
    """Documents as vectors of their size: every third has none, another third a zero one."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        n.alias("chunk_id"), F.when(n % 3 == 1, F.array(F.lit(0.0), F.lit(0.0))).when(n % 3 == 2, F.array(F.col("n_chars") + 1.0, F.lit(1.0))).alias("embedding"))
    return vector_search.vector_rejects(rows)


# --- stored index ------------------------------------------------------------------------------


@query("index_postings", f"""with {POSTINGS_SQL}
select lexeme, chunk_id, n_a, n_b, array_to_string(list(pos order by pos), ',') positions from posted join occurrences using (lexeme, chunk_id) group by all""")
def index_postings(spark, d):
    """The postings that a stored index holds after an increment with new and changed documents."""
    found = document_index(spark, d).postings("bigint")
    return found.select("lexeme", "chunk_id", "n_a", "n_b", F.array_join(F.transform("hits", lambda h: h["pos"]), ",").alias("positions"))


@query("index_compacted", f"with {POSTINGS_SQL} select lexeme, chunk_id, n_a, n_b from posted")
def index_compacted(spark, d):
    index = document_index(spark, d)
    return index.compacted(f"{index.path}-{uuid.uuid4().hex}").postings("bigint").select("lexeme", "chunk_id", "n_a", "n_b")


@query("index_and_match", f"with {POSTINGS_SQL}, {terms_sql(BENCHMARK_SOURCE)} select query_id, group_no::int group_no, chunk_id from matched")
def index_and_match(spark, d):
    return document_index(spark, d).match(benchmark_queries(spark, d), "bigint").select("query_id", "group_no", "chunk_id")


@query("index_web_match", f"with {POSTINGS_SQL}, {terms_sql(WEB_SOURCE)} select query_id, group_no::int group_no, chunk_id from matched")
def index_web_match(spark, d):
    return document_index(spark, d).match(web_queries(spark, d), "bigint").select("query_id", "group_no", "chunk_id")


@query("index_topk", f"with {POSTINGS_SQL}, {terms_sql(BENCHMARK_SOURCE)}, {TF_SQL.format(k=K)}{LEXICAL_OUT}")
def index_topk(spark, d):
    out = document_index(spark, d).topk(benchmark_queries(spark, d), K, "tf_weighted", "bigint", first=1)
    return out.withColumn("lexical_score", F.round("lexical_score", 6))


# Words that many documents hold, so that many windows could answer.
COMMON_SOURCE = """select (row_number() over (order by lexeme))::int query_id, lexeme query_text from (
  select lexeme, count(*) n from posted group by 1 order by n desc, lexeme limit 20)"""


def common_queries(spark, d):
    words = document_postings(spark, d).groupBy("lexeme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lexeme").limit(20)
    return words.select(F.row_number().over(Window.orderBy("lexeme")).alias("query_id"), F.col("lexeme").alias("query_text"))


@query("index_common_topk", f"with {POSTINGS_SQL}, {terms_sql(COMMON_SOURCE)}, {TF_SQL.format(k=K)}{LEXICAL_OUT}")
def index_common_topk(spark, d):
    """The twenty words that most documents hold: most of their blocks are never read."""
    out = document_index(spark, d).topk(common_queries(spark, d), K, "tf_weighted", "bigint", first=1)
    return out.withColumn("lexical_score", F.round("lexical_score", 6))


@query("index_cover_density", f"with {POSTINGS_SQL}, {terms_sql(WEB_SOURCE)}, {COVER_SQL.format(k=K)}{LEXICAL_OUT}")
def index_cover_density(spark, d):
    out = document_index(spark, d).topk(web_queries(spark, d), K, "cover_density", "bigint", first=1)
    return out.withColumn("lexical_score", F.round("lexical_score", 6))


@query("index_windows_skipped")
def index_windows_skipped(spark, d):
    """For each common word: windows with blocks of it, how many were read for its best ten, and how many never were."""
    return document_index(spark, d).topk(common_queries(spark, d), K, "tf_weighted", "bigint", first=1, report=True)


# --- fusion and reranking ---------------------------------------------------------------------

CANDIDATES_SQL = f"{POSTINGS_SQL}, {terms_sql(BENCHMARK_SOURCE)}, {TF_SQL.format(k=50)}, {_vector_sql(BENCH_QUERIES, 50)}"


def fused_sql(alphas: tuple[float, ...]) -> str:
    values = ", ".join(f"({a}::double)" for a in alphas)
    return f"""
sides as (
  select coalesce(l.query_id, v.query_id) query_id, coalesce(l.chunk_id, v.chunk_id) chunk_id, lexical_rank, vector_rank
  from lexical_ranked l full join vector_ranked v on v.query_id = l.query_id and v.chunk_id = l.chunk_id),
fused as (
  select *, coalesce(alpha / (lexical_rank + 1), 0) + coalesce((1.0 - alpha) / (vector_rank + 1), 0) rrf_score
  from sides, (values {values}) a(alpha)),
hybrid_ranked as (
  select *, row_number() over (partition by query_id, alpha order by rrf_score desc, chunk_id) hybrid_rank
  from fused qualify hybrid_rank <= 50)
"""


FUSED_OUT = (" select query_id, chunk_id, alpha, lexical_rank::int lexical_rank, vector_rank::int vector_rank, round(rrf_score, 8) rrf_score,"
             " hybrid_rank::int hybrid_rank from hybrid_ranked")


@once
def candidates(spark, d):
    """(lexical, vector): the first fifty of each query, searched once."""
    posted = document_postings(spark, d)
    found = lexical.lexical_topk(benchmark_queries(spark, d), posted, 50, "tf_weighted", stemmed=False)
    near = vector_search.vector_topk(query_vectors(spark, d), vector_table(spark, d), 50)
    return materialise(found, "lexical-candidates"), materialise(near, "vector-candidates")


@query("rrf_hybrid", f"with {CANDIDATES_SQL}, {fused_sql((0.5,))}{FUSED_OUT}")
def rrf_hybrid(spark, d):
    out = rrf(*candidates(spark, d))
    return out.withColumn("rrf_score", F.round("rrf_score", 8))


@query("rrf_alpha_sweep", f"with {CANDIDATES_SQL}, {fused_sql((0.0, 0.3, 0.5, 0.7, 1.0))}{FUSED_OUT}")
def rrf_alpha_sweep(spark, d):
    out = rrf(*candidates(spark, d), alphas=(0.0, 0.3, 0.5, 0.7, 1.0))
    return out.withColumn("rrf_score", F.round("rrf_score", 8))


def rerank_sql(name: str, source: str, rank: str, by: str = "query_id", text: str = "d.evidence_text") -> str:
    return f"""
{name}_scored as (
  select c.*, len(list_intersect(list_distinct({sql_words('q.query_text')}), list_distinct({sql_words(text)})))
    / len(list_distinct({sql_words('q.query_text')}))::double reranker_score
  from {source} c join queries q on q.query_id = c.query_id join docs d on d.chunk_id = c.chunk_id where {rank} <= 50),
{name} as (
  select *, row_number() over (partition by {by} order by reranker_score desc, {rank}) rerank_rank from {name}_scored
  qualify rerank_rank <= 10)
"""


@query("rerank_topk", f"""with {CANDIDATES_SQL}, {rerank_sql('reranked', 'vector_ranked', 'vector_rank')}
select query_id, chunk_id, vector_rank::int vector_rank, round(reranker_score, 8) reranker_score, rerank_rank::int rerank_rank from reranked""")
def rerank_topk(spark, d):
    vector = vector_search.vector_topk(query_vectors(spark, d), vector_table(spark, d), 50)
    out = rerank(vector, benchmark_queries(spark, d), document_chunks(spark, d), "vector_rank", overlap_scorer, characters=None)
    return out.select("query_id", "chunk_id", "vector_rank", F.round("reranker_score", 8).alias("reranker_score"), "rerank_rank")


@query("rerank_topk_cut", f"""with {CANDIDATES_SQL}, {rerank_sql('reranked', 'vector_ranked', 'vector_rank', text='d.evidence_text[1:450]')}
select query_id, chunk_id, vector_rank::int vector_rank, round(reranker_score, 8) reranker_score, rerank_rank::int rerank_rank from reranked""")
def rerank_topk_cut(spark, d):
    """The same over the first 450 characters of each text, the bound that a slow model may ask for."""
    vector = vector_search.vector_topk(query_vectors(spark, d), vector_table(spark, d), 50)
    out = rerank(vector, benchmark_queries(spark, d), document_chunks(spark, d), "vector_rank", overlap_scorer, characters=450)
    return out.select("query_id", "chunk_id", "vector_rank", F.round("reranker_score", 8).alias("reranker_score"), "rerank_rank")


ALPHAS = (0.3, 0.5, 0.7)
VARIANTS_SQL = f"""{CANDIDATES_SQL}, {fused_sql(ALPHAS)},
{rerank_sql('vector_reranked', 'vector_ranked', 'vector_rank')},
{rerank_sql('hybrid_reranked', 'hybrid_ranked', 'hybrid_rank', 'query_id, alpha')},
variants as (
  select query_id, chunk_id, lexical_rank as "rank", 'lexical' retriever, null::double alpha from lexical_ranked
  union all select query_id, chunk_id, vector_rank, 'vector', null from vector_ranked
  union all select query_id, chunk_id, hybrid_rank, 'hybrid', alpha from hybrid_ranked
  union all select query_id, chunk_id, rerank_rank, 'vector_rerank', null from vector_reranked
  union all select query_id, chunk_id, rerank_rank, 'hybrid_rerank', alpha from hybrid_reranked)
"""


@once
def variant_rows(spark, d):
    """The five variants over one set of candidates; both are written out once and read by all that is measured on them."""
    found, vector = candidates(spark, d)
    return materialise(variants(found, vector, benchmark_queries(spark, d), document_chunks(spark, d), ALPHAS, characters=None), "ranked")


@query("retrieval_variants", f'with {VARIANTS_SQL} select query_id, chunk_id, "rank"::int as "rank", retriever, alpha from variants')
def retrieval_variants(spark, d):
    return variant_rows(spark, d)


@query("rewrite_variants", """
with r as (
  select item_id query_id, trim(text) original, case when item_id % 3 <> 0 then trim(text) || ' passage' else '' end hyde,
    case when item_id % 2 = 0 then 'terms ' || trim(text) else '' end expanded from benchmark)
select query_id, 'original' technique, original query_text from r
union all select query_id, 'hyde', hyde from r where hyde <> ''
union all select query_id, 'expanded', expanded from r where expanded <> ''
union all select query_id, 'hyde_expanded', hyde || ' ' || expanded from r where hyde <> '' and expanded <> ''""")
def rewrite_variants(spark, d):
    rows = benchmark_queries(spark, d)
    text = F.trim("query_text")
    rows = rows.withColumn("hyde", F.when(F.col("query_id") % 3 != 0, F.concat(text, F.lit(" passage")))).withColumn(
        "expanded", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("terms "), text)))
    return hybrid.rewrite_variants(rows)


@query("expanded_queries", f"""
with t as (select item_id query_id, text query_text, list_filter(regexp_extract_all(text, '{SQL_WORD}'), lambda w: length(w) >= 7) terms from benchmark)
select query_id, case when len(terms) = 5 then query_text || ' ' || array_to_string(terms, ' ') else query_text end retrieval_query,
  case when query_id % 10 = 9 then 'fallback_error' when len(terms) = 5 then 'expanded' else 'fallback_invalid_term_count' end status
from (select query_id, query_text, case when query_id % 10 = 9 then [] else terms end terms from t)""")
def expanded_queries(spark, d):
    long = F.filter(F.regexp_extract_all("query_text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) >= 7)
    failed = F.col("query_id") % 10 == 9
    rows = benchmark_queries(spark, d).withColumn("terms", F.when(~failed, long)).withColumn(
        "error", F.when(failed, "TimeoutError: no answer"))
    return hybrid.expand_queries(rows).select("query_id", "retrieval_query", "status")


FEEDBACK_SQL = f"""{CANDIDATES_SQL},
own as (select query_id, p.lexeme, p.chunk_id, n_a + n_b tf, sum(n_a + n_b) over (partition by query_id, p.chunk_id) length
  from vector_ranked v join posted p on p.chunk_id = v.chunk_id where vector_rank <= 10),
shares as (select query_id, lexeme, sum(tf / length::double) share from own group by all),
weighed as (
  select query_id, s.lexeme, round(share * ln(n / df::double), 10) weight
  from shares s join (select lexeme, count(*) df from posted group by 1) p on p.lexeme = s.lexeme, (select count(distinct chunk_id) n from posted)
  where not exists (select 1 from terms t where t.query_id = s.query_id and t.lexeme = s.lexeme)),
feedback as (
  select query_id, list(lexeme order by place) terms from (
    select *, row_number() over (partition by query_id order by weight desc, lexeme) place from weighed qualify place <= 5) group by 1)"""


def corpus_terms(spark, d):
    queries = benchmark_queries(spark, d)
    near = vector_search.vector_topk(query_vectors(spark, d), vector_table(spark, d), K)
    return hybrid.feedback_terms(near, document_postings(spark, d), lexical.query_terms(queries, stemmed=False), rank="vector_rank")


@query("feedback_terms", f"with {FEEDBACK_SQL} select query_id, array_to_string(terms, ' ') terms from feedback")
def feedback_terms(spark, d):
    """Five words for each query that mark its best chunks against the corpus."""
    return corpus_terms(spark, d).select("query_id", F.array_join("terms", " ").alias("terms"))


@query("feedback_queries", f"""with {FEEDBACK_SQL}
select q.query_id, case when len(terms) = 5 then query_text || ' ' || array_to_string(terms, ' ') else query_text end retrieval_query,
  case when len(terms) = 5 then 'expanded' else 'fallback_invalid_term_count' end status
from queries q left join feedback f on f.query_id = q.query_id""")
def feedback_queries(spark, d):
    """The queries expanded by them."""
    rows = benchmark_queries(spark, d).join(corpus_terms(spark, d), "query_id", "left").withColumn("error", F.lit(None).cast("string"))
    return hybrid.expand_queries(rows).select("query_id", "retrieval_query", "status")


# --- neighbours -------------------------------------------------------------------------------

TURNS_SQL = f"""
turns as (select conv_id * 1000 + turn chunk_id, conv_id document_id, turn chunk_ordinal, len({sql_words('text')})::int tokens, text from conversations),
turn_words as (select chunk_id, w, count(*) n from (select chunk_id, unnest({sql_words('text')}) w from turns) group by all),
asked_words as (select (row_number() over (order by w))::int query_id, w from (select w, count(*) c from turn_words where w not in ({SQL_STOP}) group by 1 order by c desc, w limit 20)),
found as (
  select query_id, chunk_id, (row_number() over (partition by query_id order by n desc, chunk_id))::int "rank" from turn_words join asked_words using (w) qualify "rank" <= 10),
near as (
  select query_id, t.document_id, t.chunk_ordinal + s chunk_ordinal, min((abs(s), "rank")) b
  from found join turns t on t.chunk_id = found.chunk_id, (values (-2), (-1), (0), (1), (2)) v(s) group by all),
spread as (
  select query_id, document_id, chunk_ordinal, t.chunk_id, tokens, b[1] distance, b[2] found_rank,
    sum(tokens) over (partition by query_id order by b[1], b[2], document_id, chunk_ordinal rows unbounded preceding) upto
  from near join turns t using (document_id, chunk_ordinal)),
kept as (select * from spread where upto <= 6000)"""


def _expanded(spark, d):
    """The turns around the ten turns that hold each of twenty common words most often, within 6,000 words a query."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"),
                                                    F.col("turn").alias("chunk_ordinal"), F.size(X.words(F.coalesce("text", F.lit("")))).alias("tokens"), "text")
    counts = turns.select("chunk_id", F.explode(X.words(F.col("text"))).alias("w")).groupBy("w", "chunk_id").agg(F.count("*").alias("n"))
    counts = materialise(counts.where(~F.col("w").isin(*C.STOP_WORDS)), "turn-words")
    asked = counts.groupBy("w").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(20)
    asked = asked.select("w", F.row_number().over(Window.orderBy("w")).alias("query_id"))
    found = top_k(counts.join(F.broadcast(asked), "w"), ["query_id"], [F.desc("n"), F.asc("chunk_id")], K)
    return neighbours.expand(found, turns.drop("text"), 2, 6000)


@query("neighbours", f"with {TURNS_SQL} select query_id, document_id, chunk_ordinal, chunk_id, tokens, distance, found_rank from kept")
def expanded_neighbours(spark, d):
    return _expanded(spark, d)


@query("neighbour_passages", f"""with {TURNS_SQL}
select query_id, document_id, min(chunk_ordinal) first_ordinal, max(chunk_ordinal) last_ordinal, count(*) n_chunks, sum(tokens)::bigint tokens, min(found_rank) found_rank
from (select *, chunk_ordinal - row_number() over (partition by query_id, document_id order by chunk_ordinal) i from kept) group by query_id, document_id, i""")
def neighbour_passages(spark, d):
    """The same as passages of neighbouring turns."""
    return neighbours.intervals(_expanded(spark, d))
