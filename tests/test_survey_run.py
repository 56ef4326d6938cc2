"""The survey from files to files: rows, report, a killed run, a forced one."""

import pytest

from repeatloom.plans import runs as U

ARRAY = "TTAGGG" * 12
A1, A2, A3, BIG = "GCF_000000001.1", "GCF_000000002.1", "GCF_000000003.1", "GCF_000000009.1"


def gff(spans):
    return "##gff-version 3\n" + "".join(
        f"{contig}\tx\texon\t{s + 1}\t{e}\t.\t+\t.\tID=e{i};Parent={parent}\n"
        for i, (contig, parent, s, e) in enumerate(spans))


@pytest.fixture
def files(tmp_path):
    inner = "GTGACC" + ARRAY + "GACCAG"
    first = "ACGTACGTAC" * 5 + inner + "TGCATGCATG" * 5 + "GT" + "ACGTT" * 12 + "AG" + "C" * 50
    second = "A" * 40 + inner + "C" * 40
    a, b = 50, 50 + len(inner)
    c = b + 50
    put = lambda folder, acc, name, text: (
        (tmp_path / folder / acc).mkdir(parents=True), (tmp_path / folder / acc / name).write_text(text))
    put("gff", A1, "genomic.gff", gff([("c1", "t1", 0, a), ("c1", "t1", b, c), ("c1", "t1", c + 64, c + 114)]))
    put("gff", A2, "genomic.gff", gff([("c1", "t9", 0, 40), ("c1", "t9", 40 + len(inner), 80 + len(inner))]))
    wrap = lambda text: "\n".join(text[i:i + 60] for i in range(0, len(text), 60))
    put("fna", A1, "genomic.fna", f">c1 first\n{wrap(first)}\n>c2\nACGT\n")
    put("fna", A2, "genomic.fna", f">c1\n{wrap(second)}\n")
    put("fna", A3, "genomic.fna", ">c1\nACGT\n")
    lines = ["accession\tname\ta\tb\tbp", f"{A1}\tOne sp\tx\tx\t500", f"{A2}\tTwo sp\tx\tx\t300",
             f"{A3}\tThree\tx\tx\t4", f"{BIG}\tBig\tx\tx\t9000", f"{A1}\tOne sp\tx\tx\t500"]
    (tmp_path / "catalog.tsv").write_text("\n".join(lines) + "\n")
    return tmp_path, inner


def survey(spark, at, **kw):
    return U.survey(spark, f"{at}/catalog.tsv", f"{at}/gff", f"{at}/fna", f"{at}/out", max_bp=1000, **kw)


def test_rows_report_and_boundary(spark, files):
    at, inner = files
    report = {r.acc: r for r in survey(spark, at).collect()}
    assert {a: (r.status, r.error, r.n_introns, r.n_kept) for a, r in report.items()} == {
        A1: ("ok", None, 2, 1), A2: ("ok", None, 1, 1), A3: ("failed", "input_missing", 0, 0),
        BIG: ("skipped_too_large", None, 0, 0)}
    rows = {r.acc: r for r in U.survey_rows(spark, f"{at}/out").collect()}
    assert set(rows) == {A1, A2}
    one = rows[A1]
    assert (one.genome_acc, one.genome_name, one.contig, one.start, one.end) == (A1, "One_sp", "c1", "50", str(50 + len(inner)))
    assert (one.mrna, one.donor, one.acceptor, one.repeat_type, one.intron_seq) == ("t1", "GT", "AG", "TTAGGG", inner)
    assert (one.donor_8, one.acceptor_8, one.orientation) == (inner[:8], inner[-8:], "coding-strand")
    detail = {r.acc: r for r in U.boundary_rows(spark, f"{at}/out").collect()}[A1]
    assert (detail.n_kept, detail.n_gt_ag) == (1, 1)
    assert [tuple(x) for x in detail.top_acceptor_4] == [("GACC", 1)] and [tuple(x) for x in detail.top_donor_4] == [("GACC", 1)]
    assert [(o.orientation, o.n) for o in detail.orientations] == [("coding-strand", 1)]
    assert survey(spark, at).count() == 4 and U.survey_rows(spark, f"{at}/out").count() == 2


def test_killed_run_goes_on_and_force_replaces_only_its_own(spark, files, monkeypatch):
    at, _ = files

    def killed(rows, out):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(U, "_commit", killed)
        with pytest.raises(RuntimeError):
            survey(spark, at)
    assert U.survey_rows(spark, f"{at}/out").count() == 0 and U.read_ledger(spark, f"{at}/out").count() == 0
    survey(spark, at, only="two")
    assert [r.acc for r in U.survey_rows(spark, f"{at}/out").collect()] == [A2]
    survey(spark, at)
    before = {r.acc: r.run for r in U.survey_rows(spark, f"{at}/out").collect()}
    assert set(before) == {A1, A2} and before[A1] != before[A2]
    (at / "fna" / A2 / "genomic.fna").write_text(">c1\n" + "ACGT" * 100 + "\n")
    report = {r.acc: r for r in survey(spark, at, only=A2, force=True).collect()}
    assert (report[A2].status, report[A2].n_introns, report[A2].n_kept) == ("ok", 1, 0)
    assert {r.acc: r.run for r in U.survey_rows(spark, f"{at}/out").collect()} == {A1: before[A1]}
    assert [r.acc for r in U.boundary_rows(spark, f"{at}/out").collect()] == [A1]
