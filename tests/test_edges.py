"""Hand-made edges and brute-force comparisons."""

import itertools
import random

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.functions import wordsets
from repeatloom.operators import arrays as A
from repeatloom.operators import intervals as I
from repeatloom.operators import kmers as K
from repeatloom.operators import ordered as O
from repeatloom.operators import placement as P
from repeatloom.operators import sequences as Q
from repeatloom.operators import summaries as G
from repeatloom.plans import compartments as D
from repeatloom.plans import linkers as L
from repeatloom.plans import surveys as V
from repeatloom.sinks import writers as W
from repeatloom.sources import readers as R

TTA = M.both_strands("TTAGGG")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "seq string").select(column.alias("x")).first()["x"]


def mask(text, kmers):
    covered = [False] * len(text)
    for m in kmers:
        for i in range(len(text) - len(m) + 1):
            if text[i:i + len(m)] == m:
                covered[i:i + len(m)] = [True] * len(m)
    return covered


def mask_runs(covered, least=1):
    runs, start = [], None
    for i, c in enumerate(covered + [False]):
        if c and start is None:
            start = i
        elif not c and start is not None:
            if i - start >= least:
                runs.append((start, i))
            start = None
    return runs


def random_texts(n, seed=3, size=90):
    rng = random.Random(seed)
    pieces = ["TTAGGG", "CCCTAA", "GGG", "TTA", "A", "C", "G", "T", "N", "TTTAGGG"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, size // 3))) for _ in range(n)]


@pytest.mark.parametrize("kmers", [M.forward("TTAGGG"), TTA, M.both_strands("TTTTAGGG")])
def test_runs_and_coverage_match_masks(spark, kmers):
    texts = ["", "TTAGG", "TTAGGG", "TTAGGGTTAGGG", "TTAGGGATTAGGG", *random_texts(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "seq string").select(
        "seq", M.covered_runs(F.col("seq"), kmers, 1).alias("r"), M.covered_bases(F.col("seq"), kmers).alias("b"),
        M.hit_count(F.col("seq"), kmers).alias("h"), M.hit_positions(F.col("seq"), kmers).alias("p")).collect()
    for r in rows:
        covered = mask(r.seq, kmers)
        assert [(x.start, x.end) for x in r.r] == mask_runs(covered)
        assert r.b == sum(covered)
        assert r.h == len(r.p) == sum(r.seq[i:i + len(kmers[0])] in kmers for i in range(len(r.seq)))


def test_mixed_runs_and_gap_match_masks(spark):
    kmers = TTA + M.both_strands("TTTAGGG")
    rows = A.with_canonical_linker(
        spark.createDataFrame([(t,) for t in random_texts(300, 5)], "seq string"), kmers, 5
    ).withColumn("r", M.mixed_runs(F.col("seq"), kmers)).collect()
    for r in rows:
        covered = mask(r.seq, kmers)
        assert [(x.start, x.end) for x in r.r] == mask_runs(covered)
        gaps = mask_runs([not c for c in covered])
        best = max(gaps, key=lambda g: g[1] - g[0], default=(0, 0))
        want = best if best[1] - best[0] >= 5 else (None, None)
        assert (r.gap_start, r.gap_end) == want


def test_very_long_array_is_one_run(spark):
    text = "TTAGGG" * 60_000
    assert one(spark, text, M.covered_bases(F.col("seq"), TTA)) == len(text)
    assert one(spark, text, M.coverage_one_mismatch(F.col("seq"), "TTAGGG")) == 1.0


def test_contig_hits_and_runs_do_not_depend_on_chunks(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["TTAGGG", "CCCTAA", "ACGT", "G"]) for _ in range(700))
    seqs = spark.createDataFrame([("c", text)], "contig string, seq string")
    runs = {tuple(r) for r in Q.contig_runs(seqs, TTA, 10, size=64).select("start", "end").collect()}
    assert runs == set(mask_runs(mask(text, TTA), 10))
    hits = sorted(r.pos for r in Q.contig_hits(seqs, TTA, size=50).collect())
    assert hits == [i for i in range(len(text)) if text[i:i + 6] in TTA]


@pytest.mark.parametrize("n", [198, 199, 200, 201, 450])
def test_dense_windows_match_sliding(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice(["TTAGGG"] + ["ACGTA" * 9] * 2) for _ in range(60))[:n]
    got = one(spark, text, A.dense_windows(F.col("seq"), TTA))
    starts = [text[i:i + 6] in TTA for i in range(n)]
    windows = max(0, n - 199)
    dense = sum(sum(starts[i:i + 200]) >= 2 for i in range(windows))
    assert (got.n_windows, got.n_dense) == (windows, dense)
    assert got.n_hits == (sum(starts) if n >= 200 else 0)


def test_orientation_edges(spark):
    g, c = "TTAGGG" * 4, "CCCTAA" * 4
    cases = {
        g + c: "CONVERGING_NOLINKER", g + "ACGA" + c: "CONVERGING_NOLINKER", g + "ACGTACGTAC" + c: "CONVERGING_WITHLINKER",
        c + "ACACACACA" + g: "DIVERGING_WITHLINKER", g: "SINGLE_G", c: "SINGLE_C", "ACGT" * 9: "NONE",
    }
    df = spark.createDataFrame([(t,) for t in cases], "seq string")
    for r in A.with_orientation(A.with_strand_runs(df)).collect():
        assert r.classification == cases[r.seq], r.seq


def test_best_family_tie_takes_list_order(spark):
    df = A.with_best_family(spark.createDataFrame([("ACACACAC",), ("TTAGGG",)], "seq string"))
    got = {r.seq: (r.telo_coverage, r.repeat_type) for r in df.collect()}
    assert got == {"ACACACAC": (0.0, None), "TTAGGG": (1.0, "TTAGGG")}


def test_splice_strand_flip_and_reverse_complement(spark):
    assert one(spark, "CTAAAC", S.sense_strand(F.col("seq"))) == "GTTTAG"
    assert one(spark, "GTNNAG", S.revcomp(S.revcomp(F.col("seq")))) == "GTNNAG"
    assert one(spark, "ACGU", S.revcomp_masked(F.col("seq"))) == "NCGT"


def test_inserted_sequence_rules(spark):
    long = "G" * 40
    rows = [("A", "<INS>", "SVTYPE=INS;SEQ=acgt", "ACGT"), ("A", "<INS>", "SVTYPE=INS", None), ("A", "<DEL>", "SVTYPE=DEL", None),
            ("A", "A" + long, "", long), ("A", "AC,A" + long, "", ("C,A" + long)), ("AAAA", "AC,<DEL>", "", None), ("A", "C", "", None)]
    df = spark.createDataFrame(rows, "ref string, alt string, info string, want string")
    for r in df.withColumn("got", S.inserted_sequence(F.col("ref"), F.col("alt"), F.col("info"))).collect():
        assert r.got == r.want


def small_bins(monkeypatch, width=16):
    monkeypatch.setattr(O, "position_bin", lambda pos, w=width: F.floor(F.col(pos) / width).cast("long"))


def random_intervals(n, seed, span=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randint(0, span)
        rows.append((rng.randint(0, 2), rng.randint(0, 3), s, s + rng.choice([1, 3, 10, 40, 150])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_algebra_across_bins(spark, monkeypatch, seed):
    small_bins(monkeypatch)
    rows = random_intervals(60, seed)
    df = spark.createDataFrame(rows, "contig int, parent int, start long, end long")
    covered = {c: [False] * 700 for c in range(3)}
    for c, _, s, e in rows:
        covered[c][s:e] = [True] * (e - s)
    merged = I.merge(df)
    got = {tuple(r) for r in merged.collect()}
    assert got == {(c, s, e) for c in covered for s, e in mask_runs(covered[c])}
    lengths = spark.createDataFrame([(c, 300) for c in range(3)], "contig int, contig_len long")
    free = {tuple(r) for r in I.complement(merged, lengths).collect()}
    assert free == {(c, s, e) for c in covered for s, e in mask_runs([not x for x in covered[c][:300]])}


@pytest.mark.parametrize("running", [True, False])
def test_introns_across_bins(spark, monkeypatch, running):
    small_bins(monkeypatch)
    rows = random_intervals(80, 7)
    df = spark.createDataFrame(rows, "contig int, parent int, start long, end long")
    want = set()
    for key in {r[:2] for r in rows}:
        mine = sorted(r[2:] for r in rows if r[:2] == key)
        far = mine[0][1]
        for (s0, e0), (s1, _) in zip(mine, mine[1:]):
            edge = far if running else e0
            if s1 > edge:
                want.add((*key, edge, s1, s1 - edge))
            far = max(far, mine[mine.index((s0, e0)) + 1][1])
    assert {tuple(r) for r in I.introns(df, running=running).collect()} == want


def test_nested_cds_quirk(spark):
    df = spark.createDataFrame([(1, 1, 0, 100), (1, 1, 10, 50), (1, 1, 200, 300)], "contig int, parent int, start long, end long")
    assert {r.start for r in I.introns(df).collect()} == {100}
    assert {r.start for r in I.introns(df, running=False).collect()} == {50}


@pytest.mark.parametrize("closed", [False, True])
def test_covering_label_is_brute_force(spark, closed):
    rng = random.Random(11)
    spans = [(rng.randint(0, 1), s, s + rng.choice([0, 1, 5, 63, 64, 65, 200, 5000]), i) for i in range(300)
             for s in [rng.randint(0, 6000)]]
    points = [(i, rng.randint(0, 1), rng.randint(0, 8000)) for i in range(400)]
    p = spark.createDataFrame(points, "id int, contig int, pos long")
    v = spark.createDataFrame(spans, "contig int, start long, end long, name int")
    for r in I.covering_label(p, v, "name", "got", closed=closed).collect():
        inside = [n for c, s, e, n in spans if c == r.contig and s <= r.pos and (r.pos <= e if closed else r.pos < e)]
        assert r.got == min(inside, default=None)


def test_scans_of_a_batch_match_masks(spark, monkeypatch):
    """Texts of one batch don't touch; slabs, other letters, open places, empty and null texts."""
    from repeatloom.functions import scans

    rng = random.Random(5)
    sets = [M.both_strands(u) for u in M.RESCREEN_FAMILIES] + [M.one_mismatch(M.forward("TTAGGG"))]
    texts = [None, "", "TTAG", "GGTTA"] + [
        "".join(rng.choice(["TTAGGG", "CCCTAA", "TTTAGGG", "TTAGG", "A", "G", "N", "é", "\U0001f9ec"]) for _ in range(rng.randint(0, 90)))
        for _ in range(120)]
    monkeypatch.setattr(scans, "_SLAB", 64)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string").repartition(2)
    rows = df.select("seq", scans.covered(F.col("seq"), sets).alias("c"), scans.runs(F.col("seq"), sets[:7], 9).alias("r"),
                     scans.positions(F.col("seq"), sets[0]).alias("p"), scans.counts(F.col("seq"), sets).alias("n")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.seq is None:
            assert r.c is None and r.r is None and r.p is None
            continue
        masks = [mask(r.seq, s) for s in sets[:7]]
        assert r.c[:7] == [sum(m) for m in masks]
        near = {i for m in M.forward("TTAGGG") for i in range(len(r.seq) - 5)
                if sum(a != b for a, b in zip(m, r.seq[i:i + 6])) <= 1}
        assert r.c[7] == len({i + o for i in near for o in range(6)})
        assert r.n[7] == len(near) and r.n[0] == len(r.p)
        raw = r.seq.encode().decode("latin-1")
        assert r.p == [i for i in range(len(raw)) if any(raw.startswith(m, i) for m in sets[0])]
        for got, m in zip(r.r, [mask(raw, s) for s in sets[:7]]):
            assert all(all(m[x.start:x.end]) and x.end - x.start >= 9 for x in got)


def test_covering_label_sends_no_points_through_the_driver(spark):
    points = spark.range(1000).select(F.lit(1).alias("contig"), F.col("id").alias("pos"))
    spans = points.select("contig", F.col("pos").alias("start"), (F.col("pos") + 900).alias("end"), F.col("pos").alias("name"))
    got = I.covering_label(points, spans, "name", "got")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.pos: r.got for r in got.collect()} == {p: max(0, p - 899) for p in range(1000)}


def test_first_container_is_brute_force(spark):
    rng = random.Random(12)
    inner = [(rng.randint(0, 1), s, s + rng.randint(1, 80)) for s in [rng.randint(0, 3000) for _ in range(150)]]
    outer = [(rng.randint(0, 1), s, s + rng.randint(20, 6000)) for s in [rng.randint(0, 3000) for _ in range(80)]]
    a = spark.createDataFrame(inner, "contig int, start long, end long")
    b = spark.createDataFrame(outer, "contig int, o_start long, o_end long")
    for r in I.first_container(a, b, slack=50).collect():
        fits = [(s, e) for c, s, e in outer if c == r.contig and r.start >= s - 50 and r.end <= e + 50]
        assert (r.o_start, r.o_end) == min(fits, default=(None, None))


def test_similar_sets_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    texts = [b[:rng.randint(25, 60)] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) for b in base for _ in range(5)]
    texts += [base[0]] * 4 + ["TTAGGG" * 8] * 3 + ["ACGT"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")

    def kset(t):
        r = M.rc_text(t)
        return {x[i:i + 8] for x in (t, r) for i in range(len(x) - 7)}

    sets = {i: kset(t) for i, t in enumerate(texts) if len(t) >= 8}
    want = {i: sum(1 for j in sets if j != i and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= 0.2) for i in sets}
    reps = K.distinct_sets(df, 8, 8)
    degree = K.degrees(reps, K.similar_sets(reps, 0.2)).join(reps.select("rep", "set_key"), "rep")
    got = {r.id: r.degree for r in K.members(df, 8, 8).join(degree, "set_key").collect()}
    assert got == want
    sizes = sorted(r["size"] for r in L.linker_groups(df, 8, 0.2).collect())
    assert sum(sizes) == sum(1 for t in texts if len(t) >= 16)


def _brute_pairs(texts, k, threshold):
    def words(t):
        r = M.rc_text(t)
        return {x[i:i + k] for x in (t, r) for i in range(len(x) - k + 1)}

    sets = {i: words(t) for i, t in texts.items()}
    out = {}
    for i, j in itertools.combinations(sorted(sets), 2):
        small = min(len(sets[i]), len(sets[j]))
        n = len(sets[i] & sets[j])
        if n and n / small >= threshold:
            out[i, j] = (n, n / small)
    return out


@pytest.mark.parametrize("k,letters,threshold", [
    (8, "ACGT", 0.2), (5, "ACGTN", 0.5), (16, "ACGT", 0.15), (8, "ACGTRYé", 0.2), (29, "ACGT", 0.3), (4, "AT", 0.9)])
def test_similar_sets_need_no_row_per_word(spark, monkeypatch, k, letters, threshold):
    """Blocks of any size, any letters, palindromes, words longer than a number; nothing is shuffled per word."""
    rng = random.Random(k)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 2 * k))) for _ in range(14)] + ["ACGT" * 6, "AT" * 10]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(2, 12))) for i in range(90)}
    texts = {i: t for i, t in texts.items() if len(t) >= k}
    texts = {i: t for i, t in texts.items() if not any(texts[j] in (t, M.rc_text(t)) for j in texts if j < i)}
    want = _brute_pairs(texts, k, threshold)
    df = spark.createDataFrame([(f"t{i}", t) for i, t in texts.items()], "id string, seq string")
    for block in (400, 1 << 25):
        monkeypatch.setattr(wordsets, "BLOCK", block)
        pairs = K.similar_sets(K.distinct_sets(df, k, k), threshold)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan
        rows = pairs.collect()
        got = {tuple(sorted((int(r.a[1:]), int(r.b[1:])))): (r.shared, r.overlap) for r in rows}
        assert len(rows) == len(got) and got == want


def test_similar_sets_of_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "AC")], "id long, seq string")
    sets = K.distinct_sets(df, 8, 8)
    assert K.similar_sets(sets, 0.2).collect() == [] and K.degrees(sets, K.similar_sets(sets, 0.2)).collect() == []


def test_blocks_are_counted_in_small_steps(monkeypatch):
    """Steps of a few pairs, words and matches, and few common words, give the same."""
    rng = random.Random(9)
    pieces = ["".join(rng.choice("ACGT") for _ in range(rng.randint(4, 14))) for _ in range(20)]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(2, 9))) + "ACGT" * 2 for i in range(80)}
    want = {p: n for p, (n, _) in _brute_pairs(texts, 8, 0.3).items()}
    schema = pa.schema([("block", pa.int64()), ("reps", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                        ("sizes", pa.list_(pa.int32())), ("n_bytes", pa.int64()), ("letters", pa.binary())])
    for counters, found, matches, checked, common in ((1, 1, 1, 1, 1), (300, 70, 40, 7, 5), (1 << 18, 1 << 22, 1 << 20, 1 << 16, 2048)):
        for name, value in zip(("_COUNTERS", "_FOUND", "_MATCHES", "_CHECKED", "_COMMON"), (counters, found, matches, checked, common)):
            monkeypatch.setattr(wordsets, name, value)
        row = wordsets._row(schema, 0, list(texts), list(texts.values()), 8, True)
        block = wordsets._opened(row.rename_columns([f"x_{c}" for c in schema.names]), "x", 8, True)
        got = {(int(x), int(y)): int(n) for some in wordsets._Lookup(block).similar(block, 0.3) for x, y, n in zip(*some)}
        assert got == want


def test_slices_go_to_their_rows(spark):
    """Ranges inside a chunk, across several, clipped and outside; rows of one range each get the text; only those
    across chunks are put together."""
    rng = random.Random(31)
    texts = {c: "".join(rng.choice("ACGTN") for _ in range(n)) for c, n in enumerate((0, 1, 16, 40, 65))}
    spans = [(rng.randint(0, 5), s, s + rng.randint(0, 40)) for s in [rng.randint(-20, 70) for _ in range(300)]]
    rows = spark.createDataFrame([(c, s, e, i) for i, (c, s, e) in enumerate([*spans, *spans[:30]])], "contig int, start long, end long, id int")
    seqs = spark.createDataFrame([(c, f"g{c}", t) for c, t in texts.items()], "contig int, genome string, seq string")
    got = Q.with_slices(rows, Q.chunk(seqs, ["contig", "genome"], size=16), size=16)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    want = {i: (f"g{c}", texts[c][max(s, 0):max(e, 0)]) for i, (c, s, e) in enumerate([*spans, *spans[:30]])
            if c in texts and texts[c][max(s, 0):max(e, 0)]}
    found = got.collect()
    assert len(found) == len(want) and {r.id: (r.genome, r.seq) for r in found} == want


def test_a_row_goes_once_to_its_texts(spark):
    """Several ranges of a row: inside a chunk, across chunks, empty, null, clipped and outside; equal rows stay apart."""
    rng = random.Random(32)
    texts = {c: "".join(rng.choice("ACGTN") for _ in range(n)) for c, n in enumerate((0, 1, 16, 40, 65))}
    at = lambda: rng.choice([None, *range(-20, 80)])
    rows = [(rng.randint(0, 5), at(), at(), at(), at()) for _ in range(300)]
    rows = [(*r, i) for i, r in enumerate(rows + rows[:40])]
    df = spark.createDataFrame(rows, "contig int, a long, b long, c long, d long, id int")
    seqs = spark.createDataFrame(list(texts.items()), "contig int, seq string")
    got = Q.with_texts(df, Q.chunk(seqs, size=16), {"x": (F.col("a"), F.col("b")), "y": (F.col("c"), F.col("d"))}, size=16, by=["id"])
    text = lambda c, s, e: "" if s is None or e is None else texts.get(c, "")[max(s, 0):max(e, 0)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        repr((*r, text(r[0], r[1], r[2]), text(r[0], r[3], r[4]))) for r in rows)


def _shuffles(df):
    """Exchanges of the plan as it ran, without those that are read a second time."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in ran.splitlines())


def test_rows_and_carry_share_their_exchange(spark):
    """Starts, rows by bin, and the carry by key and by bin: four, whatever is joined behind them."""
    f = spark.createDataFrame([(c, p, s, s + 5) for c in range(4) for p in range(5) for s in range(0, 90, 9)],
                              "contig int, parent int, start long, end long")
    n = spark.createDataFrame([(c, 80) for c in range(3)], "contig int, contig_len int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(I.introns(f)) <= 4 and _shuffles(I.introns(f, running=False)) <= 4
        assert _shuffles(I.introns(f).join(n, "contig")) <= 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flanks_need_few_exchanges(spark):
    """Rows, lengths, chunks, rows by chunk and texts of several chunks; flanks were joined back to their rows before."""
    rows = spark.createDataFrame([(c, s, s + 30) for c in range(4) for s in range(0, 90, 9)], "contig int, start long, end long")
    seqs = spark.createDataFrame([(c, "ACGTN" * 20) for c in range(4)], "contig int, seq string")
    chunks, lengths = Q.chunk(seqs, size=16), seqs.select("contig", F.length("seq").cast("long").alias("contig_len"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.flanks(rows, chunks, lengths, 10, size=16)
        assert _shuffles(got) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = "ACGTN" * 20
    assert {(r.contig, r.start, r.end, r.left_flank, r.right_flank) for r in got.collect()} == {
        (c, s, s + 30, text[max(s - 10, 0):s], text[s + 30:s + 40]) for c in range(4) for s in range(0, 90, 9)}


def test_tolerance_of_both_ends(spark):
    """Cells of both ends find what a comparison of all pairs finds, at cell borders and below zero too."""
    rng = random.Random(33)
    span = lambda: (rng.randint(0, 1), *[rng.randint(-70, 140) for _ in range(2)])
    introns = [span() for _ in range(400)] + [(0, 62, 127), (0, 64, 128), (1, -1, 0)]
    targets = [span() for _ in range(400)] + [(0, 63, 128), (1, 1, -1)]
    a = spark.createDataFrame(introns, "contig int, start long, end long")
    b = spark.createDataFrame(targets, "contig int, t_start long, t_end long")
    for tol in (0, 2, 11):
        want = Counter((c, s, e, ts, te) for c, s, e in introns for d, ts, te in targets
                       if c == d and abs(s - ts) <= tol and abs(e - te) <= tol)
        got = I.within_tolerance(a, b, tol=tol).select("contig", "start", "end", "t_start", "t_end").collect()
        assert Counter(map(tuple, got)) == want
    assert I.within_tolerance(a, b.limit(1), tol=2)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


@pytest.mark.parametrize("name", ["j11_flanks", "q11_g14_density_ratios"])
def test_contigs_are_made_once(spark, monkeypatch, name):
    """Texts become contigs in one place, whose file gives lengths, names and chunks."""
    from repeatloom.suite import views
    from repeatloom.suite.registry import QUERIES
    calls, made = [], views.dna
    monkeypatch.setattr(views, "dna", lambda *of: calls.append(of) or made(*of))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_long_chain_is_one_group(spark):
    v = spark.createDataFrame([(i,) for i in range(40)], "rep int")
    e = spark.createDataFrame([(i, i + 1) for i in range(38)], "a int, b int")
    labels = {r.rep: r.label for r in K.components(v, e).collect()}
    assert labels == {**{i: 0 for i in range(39)}, 39: 39}


def test_placement_ties_prefer_forward_then_left(spark):
    df = spark.createDataFrame([("AC", "ACGTAC"), ("GGG", "GG"), ("AAA", "CTTTC")], "query string, target string")
    got = {r["query"]: (r["matches"], r["offset"], r["strand"]) for r in P.best_placement(df).collect()}
    assert got == {"AC": (2, 0, "+"), "GGG": (None, None, None), "AAA": (3, 1, "-")}


def test_fasta_chunks_over_many_blocks(spark, tmp_path):
    rng = random.Random(8)
    genome = {f"chr{i}": "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 9000))) for i in range(6)}
    text = "".join(f">{n} some words\n" + "".join(s[i:i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in genome.items())
    path = str(tmp_path / "g.fa")
    with open(path, "w") as f:
        f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = R.read_fasta_chunks(spark, path, 512).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r.contig, r.chunk_no)):
        assert r.chunk_start == r.chunk_no * 512
        got[r.contig] = got.get(r.contig, "") + r.seq
    assert got == genome
    records = {r.contig: r.seq for r in R.read_fasta_records(spark, path).collect()}
    assert records == genome


def test_gff_lines(spark):
    lines = spark.createDataFrame([
        ("##gff",), ("c\ts\tgene\t1\t10\t.\t+\t.\tID=g1;Name=N;gene_biotype=protein_coding",), ("short\tline",),
        ("c\ts\tmRNA\t1\t10\t.\t+\t.\tID=m1;Parent=g1",), ("c\ts\texon\t2\t5\t.\t+\t.\tParent=m1;Parent=m2",)], "value string")
    f = R.parse_gff(lines)
    genes, transcripts, exons = R.gene_tables(f)
    assert genes.first()["gene_name"] == "N" and transcripts.first()["gene_id"] == "g1"
    e = exons.first()
    assert (e.parent, e.start, e.end) == ("m2", 1, 5)


def test_alignment_lines_reversed_and_self_hits(spark):
    row = lambda q, s, a, b: ("\t".join([q, s, "90", "50", "0", "0", "1", "50", str(a), str(b), "0", "0", "55", "x"]),)
    lines = spark.createDataFrame([
        row("a|b|NW_1.1|100-300|e", "NW_1.1", 700, 650), row("a|b|NW_1.1|100-300|e", "NW_1.1", 500, 420),
        row("a|b|NW_1.1|100-x|e", "NW_1.1", 1, 2), row("a|b", "NW_1.1", 1, 2)], "value string")
    hits = R.parse_alignment_hits(lines)
    assert sorted((r.hit_start, r.hit_end) for r in hits.collect()) == [(420, 500), (650, 700)]
    assert [r.hit_start for r in L.distant_hits(hits).collect()] == [650]


def test_medians(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 10)] + [("b", i) for i in (1, 5, 9)], "g string, x int")
    got = {r.g: (r.u, r.m) for r in df.groupBy("g").agg(
        G.upper_median("x").alias("u"), F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    assert got == {"a": (3, 2.5), "b": (5, 5.0)}


def test_hot_duplicate_group(spark):
    df = spark.createDataFrame([(i, "s", "ACGT" if i % 3 else "acgt") for i in range(90)] + [(99, "s", "G")], "id int, species string, seq string")
    got = {r.id: r.copies for r in G.duplicate_counts(df, ["species"], "seq", ["id"]).collect()}
    assert got[0] == got[1] == 90 and got[99] == 1


def test_only_and_force_arguments(spark):
    catalog = spark.createDataFrame([("GC1", "Mus_musculus", 5), ("GC2", "Homo", 6), ("GC3", "Big", 6_000_000_000)], "acc string, name string, genome_bp long")
    ledger = spark.createDataFrame([("GC1", "ok")], "acc string, status string")
    accs = lambda df: sorted(r.acc for r in df.collect())
    assert accs(V.todo(catalog, ledger)) == ["GC2", "GC3"]
    assert accs(V.todo(catalog, ledger, max_bp=5_000_000_000)) == ["GC2"]
    assert [tuple(r) for r in V.too_large(catalog, 5_000_000_000).collect()] == [("GC3", "skipped_too_large")]
    assert accs(V.todo(catalog, ledger, only="MUS", force=True)) == ["GC1"]


def test_consensus_families(spark):
    rng = random.Random(4)
    words = ["GGTTAG", "CTAACC", "GGTTAC", "AAAAAA", "ggttag", "GG-TAG", "GGNTAG", "", None]
    for unit in M.REPEAT_FINDER_FAMILIES * 12:
        word = list(rng.choice(M.both_strands(unit)))
        for _ in range(rng.randint(0, 2)):
            word[rng.randrange(len(word))] = rng.choice("ACGTNX*")
        words.append("".join(word))
    rows = [(w, len(w) if w is not None else 6) for w in words] + [("GGTTAG", 7)]
    df = spark.createDataFrame(rows, "consensus string, period int")
    for r in V.with_consensus_family(df).collect():
        want = None
        for most in (0, 1):
            for unit in M.REPEAT_FINDER_FAMILIES:
                for strand, kmers in (("fwd", M.forward(unit)), ("rev", M.backward(unit))):
                    if want is None and r.consensus and r.period == len(r.consensus) == len(unit) and any(
                            sum(a != b for a, b in zip(k, r.consensus.upper())) <= most for k in kmers):
                        want = (unit + ("~1mm" if most else ""), strand, not most)
        assert (tuple(r.kind) if r.kind else None) == want


def test_table_form_fills_missing(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert W.table_form(df, ["b", "c", "a"]).first().asDict() == {"b": "", "c": "", "a": "1"}


def test_first_component_follows_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ np.array([[3.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    got = np.array([r.pc1 for r in G.first_component(df, ["a", "b", "c"]).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    axis = np.linalg.eigh(np.cov(z.T))[1][:, -1]
    assert np.allclose(np.abs(np.corrcoef(got, z @ axis)[0, 1]), 1.0)


def test_ranks_and_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.01, 0.5, 0.9, 0.04]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    ranks = {r.id: r.k for r in G.average_rank(df, "p", "k").collect()}
    assert ranks == {i: sum(q < v for q in p) + (sum(q == v for q in p) + 1) / 2 for i, v in enumerate(p)}
    order = sorted(p)
    want = {v: min(1.0, min(q * len(p) / (order.index(q) + order.count(q)) for q in p if q >= v)) for v in p}
    for r in G.adjusted_p_values(df).collect():
        assert abs(r.adjusted - want[r.p]) < 1e-12


def test_ranks_stay_within_groups(spark):
    rows = [("a", 1.0, 3.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("b", 1.5, 9.0), ("b", 2.5, 2.0), ("b", 3.5, 4.0), ("b", 9.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    both = {r.g: r.rho for r in G.spearman(df, "x", "y", ["g"]).collect()}
    for g in ("a", "b"):
        alone = G.spearman(df.where(F.col("g") == g), "x", "y", ["g"]).first().rho
        assert abs(both[g] - alone) < 1e-12


def test_lines_that_hold_no_numbers(spark):
    gff = ["c\ts\texon\t5\t9\t.\t+\t.\tID=a", "c\ts\texon\tx\t9\t.\t+\t.\tID=b", "# note", "c\ts\texon\t5\t9"]
    lines = spark.createDataFrame([(x,) for x in gff], "value string")
    assert [(r.start, r.end) for r in R.parse_gff(lines).collect()] == [(4, 9)]
    assert tuple(R.rejected(lines, 9, (3, 4)).first()) == (3, 2)
    vcf = spark.createDataFrame([("c\tp\tid\tA\tAC",), ("c\t7\tid\tA\t" + "AC" * 20,)], "value string")
    assert [r.pos for r in R.parse_vcf(vcf).collect()] == [7]
    hit = "a|b|c|1-9|e\tx\t{}\t9\t0\t0\t1\t8\t{}\t4\t0\t5\t{}\ts"
    hits = spark.createDataFrame([(hit.format(*v),) for v in (("90.0", "3", "10"), ("?", "3", "10"), ("90.0", "y", "10"), ("90.0", "3", "0"))], "value string")
    assert sorted((r.pident, r.qcov or -1.0) for r in R.parse_alignment_hits(hits).collect()) == [(90.0, -1.0), (90.0, 0.8)]
    catalog = ["Accession\tname\tx\ty\tbp", "GC1\ta b\tx\ty\t5", "GC2\tshort", "\tno\tx\ty\t5", "GC3\tc\tx\ty\t?"]
    got = R.parse_catalog(spark.createDataFrame([(x,) for x in catalog], "value string")).collect()
    assert sorted(map(tuple, got)) == [("GC1", "a_b", 5), ("GC3", "c", 0)]


def test_genomes_without_rows_have_no_burden(spark):
    df = spark.createDataFrame([("x", 1, 4), ("x", 0, 0)], "t string, telo long, total long")
    top = G.burden(df, ["t"]).where("t is null").first()
    assert (top.n_genomes, top.mean_burden, top.prevalence) == (2, 0.25, 0.5)


def test_exons_behind_four_gigabases(spark):
    big = 5_000_000_000
    df = spark.createDataFrame([("c", "t", big, big + 100), ("c", "t", big + 300, big + 400)], "contig string, parent string, start long, end long")
    assert [(r.start, r.end) for r in I.exon_ranks(df).collect()] == [(big + 100, big + 300)]


def test_deeply_nested_containers(spark):
    outer = spark.range(10_000).select(F.lit(0).alias("contig"), F.col("id").alias("o_start"), (20_000 - F.col("id")).alias("o_end"))
    inner = spark.range(10_000).select(F.lit(0).alias("contig"), F.col("id").alias("start"), (F.col("id") + 50).alias("end"))
    got = I.first_container(inner, outer).groupBy("o_start", "o_end").count().collect()
    assert [tuple(r) for r in got] == [(0, 20_000, 10_000)]


def test_readers_on_files(spark, tmp_path):
    def file(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    gff = R.read_gff(spark, file("GCF_000001.2_x.gff", "##gff", "c\ts\tgene\t5\t9\t.\t+\t.\tID=a;Name=n", "bad")).first()
    assert (gff.acc, gff.start, gff.end, gff.attrs) == ("GCF_000001.2", 4, 9, {"ID": "a", "Name": "n"})
    assert R.read_vcf(spark, file("v.vcf", "#h", "c\t7\tid\tA\t" + "AC" * 20)).first().pos == 7
    hits = file("GCA_7.1.tsv", "a|b|ctg|3-9|e\tNW_5.1\t91.5\t9\t0\t0\t1\t8\t30\t20\t0\t5\t10\ts")
    hit = R.read_alignment_hits(spark, hits).first()
    assert (hit.src_contig, hit.src_start, hit.hit_contig, hit.hit_start, hit.hit_end, hit.qcov, hit.acc) == ("ctg", 3, "NW_5.1", 20, 30, 0.8, "GCA_7.1")
    row = ["s", "1", "40", "6", "80", "TTAGGG", "6.5", "0", "0", "0"]
    finder = R.read_repeat_finder(spark, file("GCA_8.1.csv", "SeqID\tx", "\t".join(row), "\t".join(row[:5]), "\t".join(["s", "?", *row[2:]]))).collect()
    assert [(r.consensus, r.tr_end, r.acc) for r in finder] == [("TTAGGG", 40, "GCA_8.1")]
    table = R.read_table(spark, file("GCF_9.3_hits.tsv", "a\tb", "1\tx"), "a int, b string", accession=True).first()
    assert (table.a, table.b, table.acc) == (1, "x", "GCF_9.3")
    ledger = R.read_json(spark, file("ledger.json", '[{"acc": "GC1", "n": 3},', ' {"acc": "GC2", "extra": 1}]'), "acc string, n long").collect()
    assert [tuple(r) for r in ledger] == [("GC1", 3), ("GC2", None)]


def test_hits_across_chunk_borders(spark):
    rng = random.Random(9)
    texts = {c: "".join(rng.choice(["TTAGGG", "TTTAGGG", "A", "C", "TTAGG", "CCCTAA"]) for _ in range(60)) for c in range(4)}
    texts[4], texts[5] = "TTAGGG", "TT"
    seqs = spark.createDataFrame(list(texts.items()), "contig long, seq string")
    kmers = ["TTAGGG", "TTTAGGG", "TTAGG"]
    for size in (7, 16, 4096):
        got = {(r.contig, r.pos, r.k) for r in Q.chunk_hits(Q.chunk(seqs, size=size), kmers).collect()}
        assert got == {(c, i, len(m)) for c, t in texts.items() for m in kmers for i in range(len(t)) if t.startswith(m, i)}


def test_hits_of_an_array_are_one_stretch(spark):
    """One row per stretch, not per hit: the array's 595 hits are two rows, as it crosses a chunk border."""
    text = "N" * 100 + "TTAGGG" * 100 + "N" * 100
    chunks = Q.chunk(spark.createDataFrame([(1, text)], "contig int, seq string"), size=512)
    rows = sorted((r.pos, r["last"]) for r in Q.chunk_stretches(chunks, TTA).collect())
    assert rows == [(100, 511), (512, 694)]


def test_density_of_intervals_without_their_text(spark):
    rng = random.Random(10)
    text = "".join(rng.choice(["TTAGGG", "A" * 9, "C" * 40]) for _ in range(120))
    n = len(text)
    spans = [("cds", 0, 90), ("cds", 130, 131), ("intron", 90, 130), ("intron", 500, 900), ("intergenic", 131, 500), ("intergenic", 900, n)]
    intervals = spark.createDataFrame([(0, c, s, e, "g") for c, s, e in spans], "contig long, compartment string, start long, end long, genome string")
    chunks = Q.chunk(spark.createDataFrame([(0, text)], "contig long, seq string"), size=64)
    for strict in (True, False):
        got = {r.compartment: tuple(r)[2:] for r in D.compartment_density(intervals, chunks, ["genome"], window=50, strict=strict).collect()}
        for c in ("cds", "intron", "intergenic"):
            bp = hits = dense = windows = 0
            for _, s, e in [x for x in spans if x[0] == c]:
                piece = text[s:e]
                at = [i for i in range(len(piece) - 5) if piece[i:i + 6] in TTA]
                bp, windows = bp + e - s, windows + max(0, e - s - 49)
                hits += len(at) if not strict or e - s >= 50 else 0
                dense += sum(sum(w <= i < w + 50 for i in at) >= 2 for w in range(e - s - 49))
            assert got[c] == (bp, hits, dense, windows)


def plain_placement(q, t):
    """All offsets of both strands, compared letter by letter."""
    if not q or not t or len(q) > len(t):
        return None, None, None
    rc = q[::-1].translate(str.maketrans("ACGT", "TGCA"))
    tries = [(-sum(a == b for a, b in zip(p, t[o:])), s, o) for s, p in enumerate((q, rc)) for o in range(len(t) - len(q) + 1)]
    m, s, o = min(tries)
    return -m, "+-"[s], o


def test_placement_against_all_offsets(spark):
    """Close matches, ties between offsets and strands, repeats, and texts without any seed in common."""
    draw = random.Random(6)
    dna = lambda n, letters="ACGT": "".join(draw.choice(letters) for _ in range(n))
    pairs = [("TTAGGG" * 4, "TTAGGG" * 30), ("ACGT" * 3, "ACGT" * 9), ("A" * 13, "T" * 40 + "A" * 5), ("A" * 9, "C" * 30),
             ("ACG", "TTACGAACG"), ("", "ACG"), ("ACGTA", "ACG"), (None, "ACG"), ("ACG", None), ("AC", "GT")]
    for _ in range(60):
        t = dna(draw.randrange(20, 300))
        n = draw.randrange(1, len(t))
        at = draw.randrange(len(t) - n + 1)
        q = list(t[at:at + n])
        for _ in range(draw.randrange(0, n // 3 + 1)):
            q[draw.randrange(n)] = draw.choice("ACGT")
        pairs.append(("".join(q), t))
        pairs.append((dna(draw.randrange(1, 40), "AT"), dna(60, "AT")))
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs)], "i int, query string, target string").repartition(4)
    got = {r.i: (r.matches, r.strand, r.offset) for r in P.best_placement(df).collect()}
    assert got == {i: plain_placement(q, t) for i, (q, t) in enumerate(pairs)}


def test_few_offsets_are_compared_for_a_close_match():
    draw = random.Random(2)
    t = "".join(draw.choice("ACGT") for _ in range(50_000))
    q = t[31_000:31_060] + "A" + t[31_061:31_300]
    index = P.SeedIndex(P._letters(t))
    votes, seeds = index.votes(P._letters(q))
    best, at = index.best(P._letters(q))
    assert (at, best >= len(q) - 1) == (31_000, True)
    assert (votes >= seeds - (len(q) - best)).sum() == 1


def test_half_sites_in_a_long_text(spark):
    """100,000 sites: the walk keeps only those within reach."""
    seq = ("GGGTCA" * 3 + "AAAA" + "TGACCC") * 25_000
    fwd, rev = ([i for i in range(len(seq) - 5) if seq[i:i + 6] == w] for w in ("GGGTCA", "TGACCC"))
    f, r = set(fwd), set(rev)
    row = spark.createDataFrame([(seq,)], "seq string").select(A.half_site_pairs(F.col("seq")).alias("p")).first().p
    assert (row.n_fwd, row.n_rev) == (len(fwd), len(rev)) == (75_000, 25_000)
    assert row.direct == sum(s + d in f for s in fwd for d in range(6, 17))
    assert row.inverted == sum((s + d in r) + (s - d in r) for s in fwd for d in range(6, 17))


def test_boundary_density_letter_by_letter(spark):
    draw = random.Random(12)
    rows = [("AATTAGG", "GTTAGGGAC", "CCTAA"), (None, "TTAGGG", None), ("", "", ""), ("TTAGGG" * 12, "ACG", "CCCTAA" * 12), ("A", None, "C")]
    rows += [tuple("".join(draw.choice(["TTAGGG", "CCCTAA", "A", "G"]) for _ in range(draw.randrange(0, 30))) for _ in range(3))
             for _ in range(20)]
    df = spark.createDataFrame(rows, "left string, seq string, right string")
    motifs = {s: [(u * 2)[i:i + 6] for i in range(6)] for s, u in (("fwd", "TTAGGG"), ("rev", "CCCTAA"))}
    bases, covered = Counter(), Counter()
    for left, seq, right in rows:
        left, seq, right = (left or "")[-50:], seq or "", (right or "")[:50]
        t = left + seq + right
        for strand, words in motifs.items():
            under = {i + d for i in range(len(t) - 5) if t[i:i + 6] in words for d in range(6)}
            for p in range(len(t)):
                key = (("left", len(left) - 1 - p) if p < len(left) else ("inside", (p - len(left)) * 7 // len(seq))
                       if p < len(left) + len(seq) else ("right", p - len(left) - len(seq)))
                bases[*key, strand] += 1
                covered[*key, strand] += p in under
    got = {(r.zone, r.bin, r.strand): (r.bases, r.covered) for r in A.boundary_density(df, "TTAGGG", 7).collect()}
    assert got == {k: (n, covered[k]) for k, n in bases.items()}


def test_document_frequency_of_odd_texts(spark):
    import numpy as np

    from repeatloom.functions import scans

    texts = ["ACGTACGTACGT", "ACGTNNACGTAC", "", None, "ACG", "ÄCGTÄCGTxyÄCGT", "ACGT", "ACGTACGTACGT", "GGGGGGGGGG"]
    df = spark.createDataFrame([(t,) for t in texts], "seq string").coalesce(1)
    for k in (4, 3, 9, 30):  # a table of all words, and words sorted or counted singly
        seqs, total = Counter(), Counter()
        for t in texts:
            words = [t[i:i + k] for i in range(len(t) - k + 1)] if t else []
            total.update(words)
            seqs.update(set(words))
        found = K.document_frequency(df, k)
        assert {r.kmer: (r.n_seqs, r.n_total) for r in found.collect()} == {w: (seqs[w], total[w]) for w in total}
    some = np.frombuffer(b"ACGTACGTAACCAC", np.uint8), np.array([0, 0, 5, 6, 12, 14])
    words, n_seqs, n_total = scans._count(*some, 2)
    dense = np.zeros((2, 25), np.int64)
    scans._count(*some, 2, dense)
    assert (dense[:, words] == [n_seqs, n_total]).all() and dense[1].sum() == n_total.sum() == 4 + 5 + 1
    # No row per letter is made before the shuffle.
    assert "Generate" not in K.document_frequency(df, 8)._jdf.queryExecution().executedPlan().toString()


def test_window_hits_are_counted_from_stretches(spark):
    text = "ACG" + "TTAGGG" * 20 + "NNN" + "TTAGGG" + "A"
    starts = [i for i in range(len(text)) if text[i:i + 6] in TTA]
    seqs = spark.createDataFrame([(1, text), (2, "ACGT"), (3, None)], "contig long, seq string")
    for size in (10, 64, 1000):
        hits = Q.contig_stretches(seqs, TTA, size=size)
        assert sorted(p for r in hits.collect() for p in range(r.pos, r.last + 1)) == starts
        none = spark.createDataFrame([], "contig long, start long, end long")
        lengths = spark.createDataFrame([(1, len(text))], "contig long, contig_len long")
        land = I.window_landscape(lengths, none, none, hits, size=20, step=10)
        assert {r.w_start: r.n_hits for r in land.collect()} == {
            w: sum(w <= p < w + 20 for p in starts) for w in range(0, len(text), 10)}
    assert "Exchange" not in Q.contig_stretches(seqs, TTA)._jdf.queryExecution().executedPlan().toString()


def test_exon_ranks_by_one_exchange(spark):
    draw = random.Random(5)
    rows = [(c, p, s, s + draw.randrange(1, 900_000)) for c, p in ((1, 1), (1, 2), (2, 1))
            for s in (draw.randrange(1 << 22) for _ in range(40))]
    rows += rows[:9] + [(3, 1, 5, 9)]  # copies, and a transcript of one exon
    df = spark.createDataFrame(rows, "contig long, parent long, start long, end long")
    expected = set()
    for key in {r[:2] for r in rows}:
        exons = sorted({r[2:] for r in rows if r[:2] == key})
        expected |= {(*key, a[1], b[0], i, len(exons), len(exons) - 1, a[1] - a[0], b[1] - b[0], a[0], b[1])
                     for i, (a, b) in enumerate(zip(exons, exons[1:]))}
    found = I.exon_ranks(df)
    plan = found.withColumn("next_exon_len", F.col("next_exon_end") - F.col("end"))
    rows_found = [(r.contig, r.parent, r.start, r.end, r.exon_index, r.n_exons, r.n_introns, r.prev_exon_len,
                   r.next_exon_end - r.end, r.prev_exon_start, r.next_exon_end) for r in plan.collect()]
    assert len(rows_found) == len(expected) and set(rows_found) == expected
    # Distinct, one exchange of the exons by bin (used twice), and small ones of a row per bin.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # the distinct, in both readers


def test_separate_counts_leave_out_overlaps(spark):
    from repeatloom.functions import scans

    draw = random.Random(8)
    texts = ["GTTAGGTTAGGTTAGG", "TTAGG" * 30, "TTAGGG" * 9, "GTTAG", "GTTAGG", "GTTAGG", "", None, "ÄTTAGGGTTAGGGÄ", "CCCTAACCCTAACCTAACC"] + [
        "".join(draw.choices(["TTAGGG", "TTAGG", "CCCTAA", "G", "N"], k=30)) for _ in range(20)]
    sets = [M.forward("TTAGGG"), M.backward("TTAGGG")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, seq string").coalesce(1)
    got = {r.i: r.c for r in df.select("i", scans.separate_counts(F.col("seq"), sets).alias("c")).collect()}
    assert got == {i: t if t is None else [sum(t.count(w) for w in s) for s in sets] for i, t in enumerate(texts)}


def test_stretches_keep_nothing_per_hit():
    import numpy as np
    import pyarrow as pa

    from repeatloom.functions import scans

    sets = scans._freeze([M.both_strands("TTAGGG"), M.both_strands("TTAGG")])
    copies = 2 * scans._SLAB // 6
    texts = ["ACGTN" * 4, "", "TTAGGG" * copies, "TTAGG", "GTTAG" + "CCCTAA" * 3]
    raw, ends = scans._letters(pa.array(texts))
    begin, end, text, value = scans._stretches(raw, ends, sets[:1])
    # Neighbouring stretches are cut at slabs only; an array of a hundred thousand hits is three of them.
    assert len(begin) <= 5 and set(text.tolist()) == {2, 4} and (value == 1).all()
    hits = [{i for i in range(len(t)) for w in s if t.startswith(w, i)} for s in sets for t in (texts[0], texts[3], texts[4])]
    under = [len({i + j for i in h for j in range(len(s[0]))}) for s, h in zip([sets[0]] * 3 + [sets[1]] * 3, hits)]
    few = scans._sums(*scans._letters(pa.array([texts[0], texts[3], texts[4]])), sets)
    assert few.ravel().tolist() == under
    assert np.array_equal(scans._sums(raw, ends, sets)[0], [0, 0, 6 * copies, 0, 18])


def test_kept_letters(spark):
    from repeatloom.functions import scans

    texts = ["aZ-b\u00e9B c\nn", "", None, "\u00e9\u2603", "AB" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", scans.kept_letters(F.col("t"), "abAB", "ACAC").alias("c")).collect()}
    assert got == {0: "ACC", 1: "", 2: None, 3: "", 4: "AC" * 40}


def test_views_of_documents_run_no_expression_per_letter(spark):
    from repeatloom.suite import views as V

    plan = V.dna(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "translate" not in plan


def test_genome_survey_reads_rows_once(spark):
    from repeatloom.operators import summaries as G
    from repeatloom.plans import surveys as P

    draw = random.Random(5)
    kinds = ["template-strand", "coding-strand", "converging", "unknown"]
    rows = [(draw.choice(["a", "b", None]), draw.choice(kinds),
             draw.choice(["GT", "GT", "CT"]) + draw.choice(["AACC", "ACGT", "TTTT"]) + draw.choice(["", "AACC", "GGGG"]) + "AG")
            for _ in range(300)] + [("c", "unknown", "GTAG"), ("d", "converging", "CC"), ("e", "unknown", None)]
    df = spark.createDataFrame(rows, "genome string, orientation string, norm_seq string")
    got = P.genome_survey(df)
    totals = {tuple(r) for r in G.boundary_totals(df).collect()}
    assert {tuple(r)[:-2] for r in got.collect()} == totals and got.columns[:-2] == G.boundary_totals(df).columns
    for r in got.collect():
        for side, top in (("donor", r.top_donor), ("acceptor", r.top_acceptor)):
            cut = (lambda t: t[2:6]) if side == "donor" else (lambda t: t[-6:-2])
            found = [cut(t) for g, _, t in rows if g == r.genome and t and t[:2] == "GT" and t[-2:] == "AG" and len(t) >= 8]
            best = min(set(found), key=lambda m: (-found.count(m), m)) if found and r.genome is not None else None
            assert top == best
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_strand_class_runs_no_pattern_per_motif(spark):
    texts = ["TTAGGG" * 3, "CCCTAA" * 3, "TTAGGGCCCTAA", "ACGT", "", None, "GTTAGGTTAGG"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, seq string")
    told = A.with_strand_class(df)
    plain = df.withColumn("fwd_frac", M.strand_fraction(F.col("seq"))).withColumn(
        "orientation", M.strand_class(F.col("seq"), F.col("fwd_frac")))
    assert sorted(map(repr, told.collect())) == sorted(map(repr, plain.collect()))
    for family in ("TTAGG", "TTAGGG", "TTTT", None):
        mine = df.withColumn("family", F.lit(family).cast("string"))
        own = A.with_strand_class(mine, family="family", families=M.RESCREEN_FAMILIES)
        listed = family in M.RESCREEN_FAMILIES
        expected = mine.withColumn("fwd_frac", M.strand_fraction(F.col("seq"), family) if listed else F.lit(None)).withColumn(
            "orientation", M.strand_class(F.col("seq"), F.col("fwd_frac"), family) if listed else F.lit(None))
        assert sorted(map(repr, own.collect())) == sorted(map(repr, expected.collect()))
    assert "regexp_count" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_points_and_placements_are_made_once(spark):
    points = spark.range(50).select((F.col("id") % 3).alias("contig"), (F.col("id") * 7).alias("pos"))
    spans = spark.createDataFrame([(0, 10, 90, 1), (1, 0, 40, 2), (1, 30, 300, 3)], "contig long, start long, end long, gene long")
    none = spans.where("gene < 0").withColumn("name", F.col("gene"))
    told = I.annotate_points(points, none, spans.where("gene < 3"), spans)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    for r in told.collect():
        introns, exons = ([g for c, s, e, g in [(0, 10, 90, 1), (1, 0, 40, 2), (1, 30, 300, 3)][:n]
                           if c == r.contig and s <= r.pos < e] for n in (2, 3))
        place = "in_intron" if introns else "in_exon" if exons else "intergenic"
        assert (r.place, r.gene) == (place, min(introns or exons, default=None))
    pairs = spark.createDataFrame([("ACGTACG", "TTACGAACGTT"), ("", "A"), (None, "A"), ("ACG", "AC")], "query string, target string")
    placed = P.best_placement(pairs).where(F.col("matches").isNotNull())
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [_placed") == 1
    assert [r.matches for r in placed.collect()] == [6]


def test_short_texts_are_placed_without_votes(monkeypatch):
    draw = random.Random(9)
    for _ in range(60):
        target, query = ("".join(draw.choices("ACGT"[:draw.choice([1, 2, 4])], k=n)) for n in (draw.randint(30, 200), draw.randint(1, 30)))
        index, q = P.SeedIndex(P._letters(target)), P._letters(query)
        for least in (0, 5, len(query)):
            monkeypatch.setattr(P, "DIRECT", 1 << 17)
            direct = index.best(q, least)
            monkeypatch.setattr(P, "DIRECT", 0)
            assert direct == index.best(q, least)
            found = [sum(a == b for a, b in zip(query, target[i:])) for i in range(len(target) - len(query) + 1)]
            assert direct == ((max(found), found.index(max(found))) if max(found) >= least else None)


def test_rows_on_keys_of_others(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (None, 7), (1, 8)], "contig long, start long")
    others = spark.createDataFrame([(1,), (1,), (3,), (None,)], "contig long")
    assert sorted(r.start for r in I.on_keys_of(rows, others).collect()) == [5, 8]
