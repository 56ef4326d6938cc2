"""Each stage of the corpus pipeline on odd rows, and the whole of it against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repeatloom.llm import line_dedup, quality

from .conftest import frame
from .test_operators import SF, brute_groups, brute_hits, brute_lines, library, pairs, same

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_keeps_the_columns(spark, odd, empty, name):
    for docs in (odd, empty):
        out = STAGES[name](spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= docs.count()


def test_last_stage(spark, odd, empty):
    out = STAGES["byte_bpe"](spark, odd, SF)
    assert out.count() == odd.count() and STAGES["byte_bpe"](spark, empty, SF).count() == 0
    same(out.select("doc_id", "decoded").collect(), [(i, t or "") for i, t in pairs(odd)])


def brute_lines_once(rows, ratio, least):
    """As ``brute_lines``, but rows of one source and text count as one page."""
    pages, having = Counter(), Counter()
    for text, site in {(t, s) for _, t, s in rows if s is not None}:
        pages[site] += 1
        having.update({(site, x.strip(" ")) for x in (text or "").split("\n")} - {(site, "")})
    bad = {k for k, n in having.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad))
            for i, t, s in rows]


def test_whole_pipeline(spark):
    docs, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.train(docs, labels)
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    lines = brute_lines_once(rows, 0.1, line_dedup.MIN_PAGES)
    assert any(a[1] != b[1] for a, b in zip(rows, lines))
    group = {i: g for i, _, g in brute_groups(lines, 5, 80)}
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    left = [(i, t) for i, t in lines if group[i] == i and not brute_hits(t, items)[1]]
    enc = library("byte_bpe_multi_50k.tiktoken")
    expected = [(i, len(ids := enc.encode_ordinary(t)), list(ids), t) for i, t in left]
    assert 0 < len(left) < docs.count()
    same(corpus_pipeline.run(spark, SF).collect(), expected)


def test_clean_documents_of_good_quality_stay(spark):
    """No labelled document of label 1 that is held out goes in the first stage."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.keep_good(spark, docs, "/root/testdata/sf0.01")
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id").where(quality.held_out(F.col("doc_id")))
    assert good.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_line_stage_has_the_floor_of_the_operator(spark):
    """At fifty documents a source, lines of six to nine of them are boilerplate."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    expected = brute_lines(rows, 0.1, line_dedup.MIN_PAGES)
    assert sum(a[1] != b[1] for a, b in zip(rows, expected)) > sum(a[1] != b[1] for a, b in zip(rows, brute_lines(rows, 0.1, 10)))
    same(STAGES["line_dedup"](spark, docs, SF).select("doc_id", "text").collect(), expected)


def test_copies_do_not_take_their_own_lines(spark):
    """A third of a source are copies of one text: it stays whole, once; a line of different texts goes."""
    clean = "A first line of its own\nand a second one that no other text has"
    rows = [(i, clean, "s") for i in range(20)] + [(i, f"shared line\ntext {i} says {i * i} things of {i + 7}", "s") for i in range(20, 60)]
    lines = STAGES["line_dedup"](spark, frame(spark, rows), SF)
    same(lines.select("doc_id", "text").collect(), [(i, t.removeprefix("shared line\n")) for i, t, _ in rows])
    left = STAGES["near_duplicates"](spark, lines, SF).where("doc_id < 20").select("doc_id", "text").collect()
    same(left, [(0, clean)])


def test_copies_count_once_in_the_pages_too(spark):
    """Five of 46 distinct texts are more than a tenth; five of the 85 rows are not."""
    rows = [(i, "the same words", "s") for i in range(40)] + [
        (i, f"own words {i}" + "\nshared line" * (i < 45), "s") for i in range(40, 84)] + [(84, None, "s")]
    got = STAGES["line_dedup"](spark, frame(spark, rows), SF)
    assert got.where(F.col("text").contains("shared line")).count() == 0 and got.where("text = 'the same words'").count() == 40
