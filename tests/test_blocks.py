import random

import pytest
from pyspark.sql import functions as F

from attest import config as C
from attest.operators import chunk, html, normalise, quality

PAGES = "document_id string, source_id string, source_hash string, page_number int, text string"
RAW = ("document_id string, source_id string, source_hash string, seq int, block_type string, heading_level int, heading string, "
       "heading_path string, text string")


def _blocks(spark, pages, rules, default=C.PageRules(), size=1):
    df = spark.createDataFrame([("doc", "src", "h", n, t) for n, t in pages], PAGES)
    return normalise.normalise_pages(df, rules, default, size).orderBy("ordinal").collect()


LETTERED = {"src": C.PageRules(lettered=True)}


def test_four_level_path_goes_over_pages(spark):
    got = _blocks(spark, [
        (1, "Rule 21 Sheet 50\nE. First part\nopening words\n3. Second level\n"),
        (2, "a. Third level\niv) Special Case\nbody one\nbody two\n\ni) an irrevocable promise;\nF. Next part\ntail")], LETTERED)
    by_text = {b.text: b for b in got}
    body = by_text["body one body two"]
    assert body.citation.section_ids == ["E", "3", "a", "iv"]
    assert body.heading_path == ["E. First part", "3. Second level", "a. Third level", "iv) Special Case"]
    item = by_text["i) an irrevocable promise;"]
    assert item.block_type == "list_item" and item.heading_path == body.heading_path
    assert by_text["tail"].heading_path == ["F. Next part"]
    assert by_text["opening words"].citation.printed_page_start == "50"
    assert [b.ordinal for b in got] == list(range(1, len(got) + 1))
    assert body.block_id == f"doc:p002:b{body.ordinal:04d}"


def test_appendix_resets_and_contents_pages_are_skipped(spark):
    got = _blocks(spark, [(1, "A. TABLE OF CONTENTS\nA. Start"), (2, "A. Start\n1. Deep\nAppendix b\nwords")], LETTERED)
    assert [b.text for b in got] == ["A. Start", "1. Deep", "APPENDIX B", "words"]
    assert got[-1].citation.section_ids == ["appendix_B"]


def test_numbered_pages_boilerplate_and_printed_label(spark):
    rules = {"src": C.PageRules(skip_pages=(1,), repeated_lines=("^Version No\\. 16$",), part_patterns=(r"^PART\s+(\d+)$",),
                                section_patterns=(r"^SECTION\s+(\d+)\s+(.+)$",), clause_patterns=(r"^(\d+(?:\.\d+){1,4})\s+(.+)$",))}
    got = _blocks(spark, [
        (1, "left out"),
        (2, "Part 1 | Page 3-7\nversion no. 16\nPART 2\nSECTION 4 Scope\n4.1 Limits\nfirst line\nVersion No. 16\nsecond line\n\n• point\nPart 1 | Page 3-7\nTable 1 of things"),
        (3, "no label here")], rules)
    assert [(b.block_type, b.text) for b in got] == [
        ("heading", "Part 2"), ("heading", "SECTION 4 Scope"), ("heading", "4.1 Limits"), ("paragraph", "first line second line"),
        ("list_item", "• point Table 1 of things"), ("paragraph", "no label here")]
    assert got[3].heading_path == ["Part 2", "SECTION 4 Scope", "4.1 Limits"] and got[3].citation.section_ids == ["4.1"]
    assert got[3].citation.printed_page_start == "Part 1 | Page 3-7" and got[5].citation.printed_page_start is None
    assert got[5].heading_path == got[3].heading_path and got[0].citation.section_ids == ["part_2"]


def test_no_heading_is_flagged(spark):
    got = _blocks(spark, [(1, "just words")], {})
    assert got[0].normalisation_flags == ["no_detected_heading_path"]


def test_html_duplicates_collapse_once(spark):
    rows = [("w", "web", None, i, "paragraph", None, None, p, t) for i, (p, t) in enumerate(
        [("A", "one"), ("A", " one "), ("A", "two"), ("A", "one"), ("Drop > me", "x"), ("A", "one"), ("A", "  ")], 1)]
    df = spark.createDataFrame(rows, RAW)
    rules = {"web": C.HtmlRules(drop_paths=("Drop > me",))}
    got = normalise.normalise_html(df, rules, rows_per_segment=2).orderBy("ordinal").collect()
    assert [b.text for b in got] == ["one", "two", "one"] and [b.ordinal for b in got] == [1, 2, 3]
    s = normalise.html_summary(df, rules, 2).first()
    assert (s.input_blocks, s.output_blocks, s.adjacent_duplicates_suppressed) == (7, 3, 2)


def _elements(spark, page, base=""):
    df = spark.createDataFrame([(1, base, page)], "page_id long, url string, html string")
    return [(r.block_type, r.heading_level, r.text) for r in html.html_elements(df).orderBy("seq").collect()]


def test_html_pages_share_batches_and_are_parsed_once(spark):
    """Elements of many pages make one batch; a one-page document is numbered without parsing its page again."""
    import pyarrow as pa

    from attest.catalog import rich

    pages = pa.RecordBatch.from_pylist([{"page_id": i, "url": "u", "html": f"<h1>A</h1><p>{i}</p>" if i % 7 else ""} for i in range(1, 100)])
    out = list(html.page_events(iter([pages, pages.slice(0, 3)])))
    assert len(out) == 1 and out[0].num_rows == 2 * (99 - 14 + 3)
    assert out[0].column("heading_level").to_pylist()[:2] == [1, None]
    found = rich.html_dropped_parts(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("page_events") == 1


def test_one_page_documents_are_numbered_alike(spark):
    df = spark.createDataFrame([("d", "s", None, i, "paragraph", None, None, "", t) for i, t in enumerate("xyyyz", 1)],
                               "document_id string, source_id string, source_hash string, seq int, block_type string, heading_level int, heading string, "
                               "heading_path string, text string")
    got = [[(r.ordinal, r.text) for r in normalise.normalise_html(df, {}, 2, one_segment=one).orderBy("ordinal").collect()] for one in (False, True)]
    assert got[0] == got[1] == [(1, "x"), (2, "y"), (3, "z")]


def test_html_elements(spark):
    page = """<body><nav><p>menu</p></nav><main><h2>T <b>x</b></h2><p>see <a href="/a">the <i>page</i></a> now<!-- c --></p>
      <ul><li>one<ul><li>inner</li></ul></li></ul><button class="Accordion-b">More</button><button>no</button>
      <table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><h3> </h3><form><p>f</p></form></main><p>outside</p></body>"""
    assert _elements(spark, page, "http://h.example/d/") == [
        ("heading", 2, "T x"), ("paragraph", None, "see [the page](http://h.example/a) the page now c"),
        ("list_item", None, "- one inner"), ("list_item", None, "- inner"), ("heading", 3, "More"),
        ("table", None, "| a | b |\n| --- | --- |\n| 1 |  |")]


def test_html_links_and_tables(spark):
    assert _elements(spark, '<p><a href="x"> </a><a>plain</a> <a href="http://[">bad</a></p>', "http://h/") == [
        ("paragraph", None, "plain [bad](http://[) bad")]
    assert _elements(spark, '<p>a<a href="/1">b<a href="/2">c</a></a>d</p>', "http://h") == [
        ("paragraph", None, "a [b c](http://h/1) b [c](http://h/2) c d")]
    assert _elements(spark, "<table>only <b>text</b><!-- no --></table>") == [("table", None, "only text")]
    assert _elements(spark, '<table><tr></tr><tr><td></td><td><a href="#k">k</a></td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>') == [
        ("table", None, "|  | [k](#k) k |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |")]


def test_html_main_part_by_role_and_class(spark):
    assert [t for _, _, t in _elements(spark, '<div role="main"><p>a</p></div><p>b</p>')] == ["a"]
    assert [t for _, _, t in _elements(spark, '<div class="x page-content-y"><p>a</p></div><p>b</p>')] == ["a"]
    assert [t for _, _, t in _elements(spark, "<p>a</p><p>b</p>")] == ["a", "b"]


def test_html_paths_in_spark(spark):
    df = spark.createDataFrame([(1, "u", "<h1>A</h1><p>x</p><h3>C</h3><p>y</p><h2>B</h2><p>z</p>"), (2, "u", "")], "page_id long, url string, html string")
    got = {r.text: r.heading_path for r in html.html_blocks(df).collect()}
    assert got["x"] == "A" and got["y"] == "A > C" and got["z"] == "A > B"
    assert html.structured_html(html.html_blocks(df)).first().structured_text.startswith("--- H1: A ---\n\nx\n\n--- H3: C ---")


# --- gates ------------------------------------------------------------------------------------


def _quality_blocks(spark, rows):
    from attest.schemas import BLOCK

    full = [dict(block_id=f"b{i}", document_id=d, source_id=s, ordinal=i, block_type="paragraph", text=t, heading_path=p,
                 citation={"pdf_page_start": page, "heading_path": p}, is_substantive=True, normalisation_flags=[])
            for i, (d, s, t, p, page) in enumerate(rows, 1)]
    return spark.createDataFrame(full, BLOCK)


def test_block_gate(spark):
    blocks = _quality_blocks(spark, [("ok", "s", "five words are in here", ["A"], 1), ("warn", "s", "text", [], 1), ("bad", "s", "text", ["A"], None)])
    docs = spark.createDataFrame([(d, "pdf", "1.0", "h") for d in ("ok", "warn", "bad")] + [("none", "pdf", None, None)],
                                 "document_id string, source_type string, schema_version string, content_hash string")
    violations = quality.check_blocks(blocks, docs)
    status = quality.document_status(violations, docs)
    assert {r.document_id: r.status for r in status.collect()} == {"ok": "pass", "warn": "review", "bad": "fail", "none": "fail"}
    assert "b3: PDF block missing pdf_page_start" in [r.message for r in violations.collect()]
    with pytest.raises(quality.GateFailed):
        quality.gate(status)
    quality.gate(status.where("status <> 'fail'"))
    assert quality.block_counters(blocks).where("document_id = 'warn'").first().short_substantive_blocks == 1


# --- chunks -----------------------------------------------------------------------------------


def _check_chunk_rules(blocks, chunks, soft, hard, overlap):
    """What must hold of the chunks (lists of positions) of one document: (type, path, tokens) of its blocks."""
    def size(g):
        return sum(blocks[i][2] for i in g)

    assert all(g == list(range(g[0], g[-1] + 1)) for g in chunks)
    assert chunks[0][0] == 0 and chunks[-1][-1] == len(blocks) - 1
    for before, after in zip(chunks, chunks[1:]):
        old = [i for i in after if i <= before[-1]]
        assert after[0] <= before[-1] + 1 and after[-1] > before[-1]
        if old:  # a part of a chunk above the hard limit: it holds what the overlap allows, one block at least
            assert len(old) == 1 or size(old) <= overlap
            assert old[0] == before[0] or len(old) == len(before) or size([old[0] - 1, *old]) > overlap
            assert size([*before, before[-1] + 1]) > hard
    for g in chunks:
        assert size(g) <= hard or len([i for i in g if not any(i in o for o in chunks if o[0] < g[0])]) == 1 or size(g) <= soft
        for i in g[1:]:  # a heading of another path does not go on a chunk that has text
            if blocks[i][0] == "heading" and blocks[i][1] != blocks[g[0]][1]:
                assert all(blocks[j][0] == "heading" for j in g[: i - g[0]])
        assert all(blocks[i][0] != "table" for i in g[:-1])  # a table closes its chunk


@pytest.mark.parametrize("soft,hard,overlap,seed", [(15, 30, 5, 1), (15, 30, 5, 2), (40, 20, 8, 3), (12, 12, 3, 4)])
def test_chunks_keep_the_rules(spark, soft, hard, overlap, seed):
    rng = random.Random(seed)
    docs = {}
    for d, length in (("long", 900), ("short", 20), ("one", 1), ("plain", 400)):
        rows = []
        for _ in range(length):
            kind = "paragraph" if d == "plain" else rng.choice(["heading", "paragraph", "paragraph", "list_item", "table"])
            rows.append((kind, [f"p{rng.randint(0, 4)}"], rng.choice([1, 1, 2, 3, 5, 9, 35])))
        docs[d] = rows
    data = [(d, i, k, p, " ".join(["w"] * n)) for d, rows in docs.items() for i, (k, p, n) in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "document_id string, ordinal long, block_type string, heading_path array<string>, text string")

    def of(blocks_per_segment):
        got = {}
        for r in chunk.chunk_members(df, C.ChunkLimits(soft, hard, overlap), blocks_per_segment=blocks_per_segment).collect():
            got.setdefault(r.document_id, {}).setdefault(r.chunk_ordinal, []).append(r.ordinal - 1)
        return {d: [sorted(got[d][k]) for k in sorted(got[d])] for d in got}

    pieces, whole = of(1), of(8192)
    assert pieces == whole  # where a document is cut into segments does not matter
    for d, rows in docs.items():
        if hard >= soft:
            _check_chunk_rules(rows, whole[d], soft, hard, overlap)
    if d == "plain" and hard >= soft:
        assert all(sum(rows[i][2] for i in g) <= soft or len(g) == 1 for g in whole["plain"])


@pytest.mark.parametrize("sizes,hard,overlap,parts", [
    ([4, 4, 4], 20, 5, [[0, 1, 2]]),  # fits
    ([6, 6, 6, 6], 13, 6, [[0, 1], [1, 2], [2, 3]]),  # one block is carried over
    ([3, 3, 3, 3, 3], 9, 6, [[0, 1, 2], [1, 2, 3], [2, 3, 4]]),  # two are
    ([9, 9, 2], 10, 1, [[0], [0, 1], [1, 2]]),  # the last block is carried even above the overlap, and one is new
    ([50, 1, 1], 10, 5, [[0], [0, 1], [1, 2]]),
])
def test_parts_of_a_large_chunk(sizes, hard, overlap, parts):
    got = chunk.split_parts(7, 7 + len(sizes), [0] * 7 + sizes, C.ChunkLimits(0, hard, overlap))
    assert got == [[i + 7 for i in g] for g in parts]


def _chunk_blocks(spark, texts, kinds=None):
    from attest.schemas import BLOCK

    rows = [dict(block_id=f"d:b{i:04d}", document_id="d", source_id="s", ordinal=i, block_type=(kinds or {}).get(i, "paragraph"), text=t,
                 heading_path=["H"], citation={"pdf_page_start": i, "pdf_page_end": i, "section_ids": [str(i % 2), "x"]},
                 is_substantive=True, normalisation_flags=[]) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, BLOCK)


def test_chunk_fields_links_and_gate(spark):
    blocks = _chunk_blocks(spark, ["w " * 10, "v " * 10, "t " * 3, "u " * 10], {3: "table"})
    policies = spark.createDataFrame([("s", "primary", "historical_only", "historical")],
                                     "source_id string, authority_tier string, retrieval_tier string, currency_status string")
    titles = spark.createDataFrame([("d", "My Title")], "document_id string, title string")
    out = chunk.chunks(blocks, policies, titles, C.ChunkLimits(15, 30, 5))
    got = out.orderBy("chunk_ordinal").collect()
    assert [c.block_ids for c in got] == [["d:b0001"], ["d:b0002", "d:b0003"], ["d:b0004"]]
    assert [c.previous_chunk_id for c in got] == [None, "d:c0001", "d:c0002"]
    assert [c.next_chunk_id for c in got] == ["d:c0002", "d:c0003", None]
    assert got[1].citation.section_ids == ["0", "x", "1"] and got[1].citation.pdf_page_start == 2 and got[1].citation.pdf_page_end == 3
    assert got[1].embedding_text.startswith("title: My Title | text: Section: H\n\nv v") and "\n\nt t t" in got[1].evidence_text
    documents = spark.createDataFrame([("d", "s")], "document_id string, source_id string")
    assert quality.check_chunks(out, documents).count() == 0
    broken = out.withColumn("next_chunk_id", F.lit("nowhere"))
    status = quality.document_status(quality.check_chunks(broken, documents), documents).first()
    assert status.status == "fail" and status.errors == 2
    assert quality.document_status(quality.check_chunks(out, documents, hard=5), documents).first().status == "review"
    s = chunk.chunk_summary(blocks, out).first()
    assert (s.input_blocks, s.output_chunks, s.historical_only) == (4, 3, True)
    assert chunk.missing_policy(blocks, policies.where("false")).first().error == "Missing source policy for s"


def test_single_large_block_is_kept_whole_and_flagged(spark):
    text = " ".join(["word"] * 900)
    got = chunk.chunks(_chunk_blocks(spark, [text])).collect()
    assert len(got) == 1 and got[0].evidence_text == text and got[0].chunking_flags == ["single_block_exceeds_hard_limit"]
