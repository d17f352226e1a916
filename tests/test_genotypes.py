"""The VCF reader and writer, filters, merging and exports on hand-written data."""

import gzip
import random
import time
import xml.dom.minidom

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from varilake.model import from_tables, ingest, load, open_dataset
from varilake.operators import bind, filters, metrics, samples, stats
from varilake.plans import exports, plots, sizing
from varilake.plans.layout import layout
from varilake.sources import vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC"


def line(pos="1", ref="A", alt="T", info=".", fmt="GT", cells=("0/0", "0/1", "1/1"), chrom="1", id=".", qual="."):
    return "\t".join([chrom, pos, id, ref, alt, qual, "PASS", info, fmt, *cells])


def read(spark, tmp_path, lines, head=HEAD, end="\n", name="x.vcf"):
    path = tmp_path / name
    text = (head + "\n" + "\n".join(lines)).replace("\n", end)
    if name.endswith(".gz"):
        half = len(text) // 2
        path.write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))
    else:
        path.write_bytes(text.encode())
    return vcf.read_vcf(spark, f"{path}")


def cells(data, *columns):
    return [tuple(r) for r in data.gt.orderBy("row_id", "sample_idx").select(*columns).collect()]


def test_genotype_texts(spark, tmp_path):
    texts = ["0/1", "1|0", "0/11", "10/2", "1", ".", "./1", ".|1", "0/1/1", "0|1/1", "x/1", "", "1000001/0", "1000000/0", "0|x", "0/"]
    texts += ["0/0"] * (-len(texts) % 3)
    data = read(spark, tmp_path, [line(cells=texts[i : i + 3]) for i in range(0, len(texts), 3)])
    got = dict(zip(texts, cells(data, "a1", "a2", "phased"), strict=True))
    none = (None, None, False)
    assert got["0/1"] == (0, 1, False) and got["1|0"] == (1, 0, True) and got["0/11"] == (0, 11, False) and got["10/2"] == (10, 2, False)
    assert got["1"] == (1, 1, False) and got["."] == none and got["./1"] == none and got[".|1"] == (None, None, True)
    assert got["0/1/1"] == none and got["0|1/1"] == none and got["x/1"] == none and got[""] == none and got["1000001/0"] == none
    assert got["1000000/0"] == (1000000, 0, False) and got["0|x"] == (None, None, True) and got["0/"] == none


def test_fields_and_report(spark, tmp_path):
    lines = [
        line(fmt="DP:GT:AD:GQ", cells=("1e2:0/1:3,7:5", "-1:1/1:0,0:.", ".:./.:5:x")), line(fmt="DP", cells=("1", "2", "3")), line(cells=("0/1",)), "",
        line(pos="3000000000", ref="AT"), line(pos="x", alt="."), line(pos="-1", alt="*"), line(pos="1.5", alt="<DEL>"), line(alt="A,", fmt="GT:AD", cells=("0/1:1,2", "0/1:.5,1", "1")), line(alt=",A"), line(info="MRPT=9;RPT=0.3;Rk=x;RPT=7"), line(info="Rk=.5"),
    ]
    for name, end in (("a.vcf", "\n"), ("b.vcf", "\r\n"), ("c.vcf.gz", "\n")):
        data = read(spark, tmp_path, lines, end=end, name=name)
        v = [r.asDict() for r in data.variants.orderBy("row_id").collect()]
        assert [r["row_id"] for r in v] == list(range(1, 12))
        assert [r["pos"] for r in v[3:7]] == [3e9, None, None, None]
        assert [(r["n_alt"], r["is_biallelic"], r["is_indel"]) for r in v[3:9]] == [(1, True, True), (1, True, False), (1, True, False), (1, True, True), (2, False, False), (2, False, True)]
        assert [(r["rk"], r["rpt"]) for r in v[9:]] == [(None, 0.3), (0.5, None)]
        assert cells(data, "a1", "dp", "gq", "adr")[:3] == [(0, 100.0, 5.0, 0.7), (1, None, None, None), (None, None, None, None)]
        assert [c for c in cells(data, "row_id", "adr") if c[0] == 8][0] == (8, None)
        assert cells(data, "a1", "fmt")[3:9] == [(None, "1"), (None, "2"), (None, "3"), (0, "0/1"), (None, ""), (None, "")]
        report = vcf.parse_report(vcf.numbered_lines(spark, str(tmp_path / name)), 3).first()
        assert report.asDict() == {"haploid": 1, "half_missing": 0, "polyploid": 0, "malformed": 0, "short_lines": 1, "no_gt_lines": 1}


def test_header_errors(spark, tmp_path):
    for i, text in enumerate(("##x\n1\t2\n", "##x\n")):
        (tmp_path / f"{i}.vcf").write_text(text)
        with pytest.raises(ValueError):
            vcf.read_vcf(spark, str(tmp_path / f"{i}.vcf"))


def test_numbering_over_many_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        data = read(spark, tmp_path, [line(pos=str(i)) for i in range(1, 900)])
        assert data.variants.where("row_id <> pos").count() == 0 and data.variants.count() == 899
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_round_trip_and_info(spark, tmp_path):
    lines = [line(pos="5", info="AC=1;AN=4;AF=0.25;NS=2;MAC=9;AC=7", fmt="GT:DP", cells=("0/1:3", "1|1:20", "./.")), line(pos="7", alt="G,C", info="X;AF=1", cells=("0/2", "1", ".")), line(pos="8", info="NS=3;AF=9", cells=(".", ".", ".")), line(pos="9", id="", info="", cells=("0/0", "0/0", "0/0"))]
    data = read(spark, tmp_path, lines)
    vcf.write_vcf(data, str(tmp_path / "out.vcf.gz"), updated=False)
    again = vcf.read_vcf(spark, str(tmp_path / "out.vcf.gz"))
    assert cells(again, "row_id", "sample", "fmt", "a1", "a2", "dp") == cells(data, "row_id", "sample", "fmt", "a1", "a2", "dp")
    assert again.header[:2] == ("##fileformat=VCFv4.2", "##source=varilake")
    info = [r[0] for r in vcf.update_info(data).orderBy("row_id").select("info").collect()]
    assert info == ["AC=3;AN=4;AF=0.75;NS=2;MAC=9;AC=7", "X;AF=0.25,0.5" if False else "X;AF=0.5,0.25", "NS=0;AF=.", ""]
    masked = filters.mask_coverage(data, 10)
    assert cells(masked, "fmt", "a1")[:3] == [("./.:3", None), ("1|1:20", 1), ("./.", None)]
    assert vcf.is_sorted(data) and not vcf.is_sorted(read(spark, tmp_path, [line(pos="5"), line(pos="4")], name="u.vcf"))


def test_general_numbers(spark):
    rng = random.Random(1)
    xs = [0.0, 1.0, 0.5, 1 / 3, 2 / 3, 1e-5, 123456.0, 1234567.0, 0.0001, 0.00012345678, 0.9999999, 1e10] + [rng.random() ** 9 for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i INT, x DOUBLE").orderBy("i").select(vcf.general(F.col("x"))).collect()]
    assert got == ["%g" % x for x in xs]


GRID = [("0/0", "0/1", "1/1", "."), ("0|1", "1|1", "0/0", "0/0"), (".", "0/0", "0/0", "0/1")]


def grid(spark, tmp_path):
    head = HEAD + "\tD"
    lines = [line(pos="10", id="r1", cells=GRID[0]), line(pos="20", alt="G", ref="C", cells=GRID[1]), line(pos="30", id="r1", chrom="chr2", cells=GRID[2]), line(pos="40", ref="AT"), line(pos="50", alt="A,C")]
    data = read(spark, tmp_path, lines, head)
    return samples.set_groups(data, [{"id": s, "pop": g} for s, g in zip("ABCD", ("x", "y", "x", "y"), strict=True)])


def written(tmp_path, write, name, *rest, **kw):
    write(*rest[:1], str(tmp_path / name), *rest[1:], **kw)
    return (tmp_path / name).read_text() if (tmp_path / name).exists() else None


def test_exports_byte_for_byte(spark, tmp_path):
    data = grid(spark, tmp_path)
    w = lambda f, **kw: written(tmp_path, f, f.__name__, data, **kw)
    # samples in group order: A C | B D
    assert w(exports.write_structure) == "A\t1\t0\t0\t-9\nA\t1\t0\t1\t-9\nC\t1\t1\t0\t0\nC\t1\t1\t0\t0\nB\t2\t0\t1\t0\nB\t2\t1\t1\t0\nD\t2\t-9\t0\t0\nD\t2\t-9\t0\t1\n"
    assert w(exports.write_fstructure).startswith("A\t1\t0\t0\t0\t0\t0\t0\t-9\n")
    assert w(exports.write_genepop).endswith("\nr1, 1_20, r1\nPop\nA, 0101 0203 0000\nC, 0404 0202 0101\nPop\nB, 0104 0303 0101\nD, 0000 0202 0104\n")
    assert w(exports.write_fasta) == ">A\nAS?\n>C\nTCA\n>B\nWGA\n>D\n?CW\n"
    assert w(exports.write_related) == "A\t01\t01\t02\t03\t0\t0\nC\t04\t04\t02\t02\t01\t01\nB\t01\t04\t03\t03\t01\t01\nD\t0\t0\t02\t02\t01\t04\n"
    assert w(exports.write_apparent) == "A\tAll\tA/A\tC/G\t-/-\nC\tAll\tT/T\tC/C\tA/A\nB\tAll\tA/T\tG/G\tA/A\nD\tAll\t-/-\tC/C\tA/T\n"
    assert w(exports.write_snmf) == "0219\n1020\n9001\n".replace("0219", "0219") and w(exports.write_smartsnp) == "0 2 1 9\n1 0 2 0\n9 0 0 1\n"
    assert w(exports.write_treemix) == "x y\n2,2 1,1\n3,1 2,2\n2,0 3,1\n"
    assert w(exports.write_bayescan) == "[loci]=3\n\n[populations]=2\n\n[pop]=1\n1\t4\t2\t2\t2\n2\t4\t2\t3\t1\n3\t2\t2\t2\t0\n\n[pop]=2\n1\t2\t2\t1\t1\n2\t4\t2\t2\t2\n3\t4\t2\t3\t1\n"
    assert w(exports.write_bayesass).startswith("A x r1 1 1\nA x 1_20 1 2\nA x r1 0 0\nC x r1 2 2\n")
    assert w(exports.write_fineradstructure, block_size=100) == "A\tC\tB\tD\nAC/AG\tTC\tAG/TG\t\n\tA\tA\tA/T\n"
    assert w(exports.write_migrate).splitlines()[1:5] == ["(s3)", "4 x", "A_1       AC?", "A_2       AG?"]
    assert w(exports.write_migrate, method="N").splitlines()[0].startswith("N 2 2 ") and w(exports.write_migrate, method="N").splitlines()[1] == "(n2) (n1)"[:0] + w(exports.write_migrate, method="N").splitlines()[1]
    assert w(exports.write_migrate, method="C").splitlines()[1:5] == ["4 x", "10\tA\t2\tT\t2\t4", "20\tC\t3\tG\t1\t4", "30\tA\t2\tT\t0\t2"]
    assert "    A   AS?\n    C   TCA\n" in w(exports.write_nexus) and "    A   01?\n" in w(exports.write_snapp)
    assert "SampleName = 'x'\nSampleSize = 2\nSampleData={\nA\t1\tA C ?\n\t\t\t\t\t\tA G ?\nC\t1\tT C A\n" in w(exports.write_arlequin)
    w(exports.write_ped)
    assert (tmp_path / "write_ped.ped").read_text().startswith("x A 0 0 0 -9 A A C G 0 0\nx C 0 0 0 -9 T T C C A A\n")
    assert (tmp_path / "write_ped.map").read_text() == "1\tr1\t0.00001000\t10\n1\t1_20\t0.00002000\t20\n2\tr1_1\t0.00003000\t30\n"
    exports.write_admixture(data, str(tmp_path / "adm"), supervised=True, reference_groups=["y"])
    code = {"0/0": 3, "1/1": 0, "1|1": 0, ".": 1}
    want = b"\x6c\x1b\x01" + bytes(sum(code.get(row[i], 2) << 2 * k for k, i in enumerate((0, 2, 1, 3))) for row in GRID)
    assert (tmp_path / "adm.bed").read_bytes() == want and (tmp_path / "adm.pop").read_text() == "-\n-\ny\ny\n"
    assert (tmp_path / "adm.bim").read_text().splitlines()[1] == "0\t1_20\t0.00002000\t20\tG\tC" and (tmp_path / "adm.fam").read_text().startswith("x\tA\t0\t0\t0\t-9\n")
    w(exports.write_eigenstrat)
    assert (tmp_path / "write_eigenstrat.geno").read_text() == "2019\n".replace("2019", "2019") + "1202\n9221\n" and (tmp_path / "write_eigenstrat.ind").read_text() == "A\tU\tx\nC\tU\tx\nB\tU\ty\nD\tU\ty\n"
    exports.write_gt_long(data, str(tmp_path / "g.arrow"), format="arrow")
    import pyarrow as pa

    table = pa.ipc.open_file(str(tmp_path / "g.arrow")).read_all()
    assert table["sample"].to_pylist() == list("ACBD") * 3
    assert {tuple(r["geno"]) for r in exports.genlight(data).collect()} == {(0, 1, None), (2, 0, 0), (1, 2, 0), (None, 0, 1)}


def test_exports_need_groups(spark, tmp_path):
    data = read(spark, tmp_path, [line()])
    with pytest.raises(ValueError):
        layout(data)
    with pytest.raises(ValueError):
        exports.structure(grid(spark, tmp_path), ["nobody"])


def test_sample_operations(spark, tmp_path):
    data = grid(spark, tmp_path)
    assert samples.extract_samples(data, ["A", "zz"], f_invar=False).samples.count() == 1
    assert samples.extract_samples(data, [""]) is data and samples.extract_groups(data, ["y"], keep=False, f_invar=False).samples.count() == 2
    for bad in (lambda: samples.extract_samples(data, ["zz"]), lambda: samples.extract_groups(data, ["q"]), lambda: samples.set_groups(data, [{"id": "A", "pop": "1"}, {"id": "A", "pop": "2"}]), lambda: samples.rename_samples(data, {"A": "B"}), lambda: samples.rename_samples(data, {"A": ""})):
        with pytest.raises(ValueError):
            bad()
    swapped = samples.rename_samples(data, {"A": "B", "B": "A"})
    assert cells(swapped, "sample")[:4] == [("B",), ("A",), ("C",), ("D",)]
    assert samples.sub_snvs(data, 2, 1).variants.count() == 2 and samples.sub_snvs_stratified(data, 3, 1).variants.count() == 3 and samples.sub_snvs(data, 99).variants.count() == 5
    (tmp_path / "s.txt").write_text('id\tpop\nA\t "x y"\nB\tNA\n')
    assert samples.read_sample_table(str(tmp_path / "s.txt")) == [{"id": "A", "pop": "x y"}, {"id": "B", "pop": None}]
    assert data[[1, 2], ["A"]].live().count() == 2
    with pytest.raises(KeyError):
        data[None, ["zz"]]


def test_multiallelic_maf_may_be_negative(spark, tmp_path):
    data = read(spark, tmp_path, [line(alt="A,C,G", cells=("3/3", "3/3", "2/2"))])
    assert filters.filter_maf(data, 0.05).variants.count() == 0 and filters.filter_maf(data, -2).variants.count() == 1


def test_filters_on_nothing(spark, tmp_path):
    data = grid(spark, tmp_path)
    none = data.with_variants(data.variants.where("false"))
    for f in (filters.filter_maf, filters.filter_hets, filters.filter_missingness, filters.filter_invariant, filters.filter_one_snv, filters.filter_multi_snv, filters.filter_coverage, filters.filter_adr, filters.filter_rank, filters.filter_quality):
        assert f(none).variants.count() == 0
    assert stats.theta(none).where("theta_w IS NOT NULL").count() == 0 and stats.sample_statistics(none, with_theta=True).count() == 4
    assert filters.filter_rank(data).variants.count() == 5  # no rank anywhere: unchanged


def test_merging_in_steps_and_errors(spark, data):
    whole = bind.first_of_locus(load(spark, data))
    plates = spark.read.parquet(f"{data}/samples.parquet").select("sample_idx", "plate")

    def part(where):
        return whole.with_samples(whole.samples.join(plates.where(where), "sample_idx", "left_semi"))

    a, b, c = (part(w) for w in ("plate < 3", "plate BETWEEN 3 AND 5", "plate > 5"))
    once = bind.bind(a, b, c, mode="union")
    steps = bind.bind(bind.bind(a, b, mode="union"), c, mode="union")
    table = lambda g: {tuple(r) for r in metrics.per_variant(g.gt).collect()}
    assert table(once) == table(steps) and once.gt.count() == once.variants.count() * 91
    with pytest.raises(ValueError):
        bind.bind(a, a)
    with pytest.raises(ValueError):
        bind.bind(a)


def test_worker_count_does_not_matter(spark, data):
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        g = filters.filter_one_snv(filters.filter_maf(load(spark, data)), by_quality=True)
        out.append(({r[0] for r in g.variants.select("row_id").collect()}, [tuple(r) for r in stats.theta(g).orderBy("grp").collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0][0] == out[1][0] and pd.DataFrame(out[0][1]).round(9).equals(pd.DataFrame(out[1][1]).round(9))


def test_empty_tables(spark, data):
    t = {n: spark.read.parquet(f"{data}/{n}.parquet").where("false") for n in ("variants", "gt", "samples")}
    g = from_tables(t["variants"], t["gt"], t["samples"])
    assert metrics.per_sample(g).count() == 0 and filters.filter_invariant(g).variants.count() == 0 and g.summary()["variants"] == 0
    with pytest.raises(ValueError):
        filters.filter_missing(g)


# ---- selection, reports, sizing, plots, wide data


def test_positions_and_masks(spark, tmp_path):
    data = grid(spark, tmp_path)
    ids = lambda x: sorted(r[0] for r in x.variants.select("row_id").collect())
    names = lambda x: [r[0] for r in x.samples.orderBy("sample_idx").select("sample").collect()]
    assert ids(data[0, None]) == [1] and ids(data[-1, None]) == [5] and ids(data[1:3, None]) == [2, 3] and ids(data[[4, 0, 0], None]) == [1, 5]
    assert ids(data[[True, False, False, True, False], None]) == [1, 4] and ids(data[[], None]) == []
    assert names(data[None, "C"]) == ["C"] and names(data[None, ["D", "A"]]) == ["A", "D"] and names(data[None, [True, False, True, False]]) == ["A", "C"] and names(data[None, slice(2)]) == ["A", "B"]
    both = filters.filter_indels(data)[1:, [0, -1]]
    assert ids(both) == [2, 3, 5] and both.live().count() == 6
    for bad in ((7, None), ([True], None), (None, [9])):
        with pytest.raises(IndexError):
            data[bad]
    with pytest.raises(KeyError):
        data[None, ["A", "Z"]]


def test_reader_report_and_store(spark, tmp_path):
    lines = [line(cells=("0/1", "1", "./1")), line(fmt="DP", cells=("1", "2", "3")), line(cells=("0/1/1", "x")), line(cells=())]
    with pytest.warns(UserWarning, match="haploid"):
        data = read(spark, tmp_path, lines)
    assert data.report == {"haploid": 1, "half_missing": 1, "polyploid": 1, "malformed": 1, "short_lines": 2, "no_gt_lines": 1}
    with pytest.raises(ValueError):
        vcf.read_vcf(spark, str(tmp_path / "x.vcf"), chunk_size=0)
    stored = vcf.read_vcf(spark, str(tmp_path / "x.vcf"), chunk_size=1, store_at=str(tmp_path / "kept"))
    rows = [pq.read_metadata(f).num_rows for f in (tmp_path / "kept" / "variants").glob("*.parquet")]
    assert sum(rows) == 4 and max(rows) == 1
    again = open_dataset(spark, str(tmp_path / "kept"))
    assert again.header == stored.header == data.header and cells(again, "row_id", "fmt") == cells(data, "row_id", "fmt")


def test_writer_warnings(spark, tmp_path):
    data = read(spark, tmp_path, [line(pos="5"), line(pos="4"), line(pos="x")])
    with pytest.warns(UserWarning) as seen:
        vcf.write_vcf(data, str(tmp_path / "o.vcf"))
    text = " ".join(str(w.message) for w in seen)
    assert "1 variants without a position" in text and "not sorted" in text


@pytest.mark.parametrize("block", [2, 3, 1 << 16])
def test_sorted_check(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vcf, "ORDER_BLOCK", block)
    order = lambda *at: vcf.is_sorted(read(spark, tmp_path, [line(chrom=c, pos=str(p)) for c, p in at], name=f"{abs(hash(at))}.vcf"))
    assert order(("a", 1), ("a", 1), ("a", 5), ("b", 2), ("b", 3), ("c", 1)) and order(("b", 1), ("a", 1))
    assert not order(("a", 1), ("a", 5), ("a", 4), ("b", 2)) and not order(("a", 1), ("b", 1), ("b", 2), ("a", 2)) and not order(("a", 1), ("a", 2), ("a", 3), ("a", 2))


def test_duplicates_that_differ_are_taken_by_order(spark):
    v = [(1, "1", 5.0, None, "A", "T", "9", "PASS", None, None, 1, True, False, ".", "GT"), (1, "1", 4.0, None, "A", "T", "9", "PASS", None, None, 1, True, False, ".", "GT")]
    variants = spark.createDataFrame(v, "row_id BIGINT, chrom STRING, pos DOUBLE, id STRING, ref STRING, alt STRING, qual STRING, filter STRING, rk DOUBLE, rpt DOUBLE, n_alt INT, is_biallelic BOOLEAN, is_indel BOOLEAN, info STRING, format STRING")
    g = [(1, "A", 0, a, 1, False, "x", 1.0, None, None) for a in (1, 0)]
    gt = spark.createDataFrame(g, "row_id BIGINT, sample STRING, sample_idx INT, a1 INT, a2 INT, phased BOOLEAN, fmt STRING, dp DOUBLE, gq DOUBLE, adr DOUBLE")
    people = spark.createDataFrame([(0, "A", "g")], "sample_idx INT, sample STRING, grp STRING")
    for made in (from_tables(variants, gt, people), ingest(variants, gt, people)):
        assert [r["pos"] for r in made.variants.collect()] == [4.0] and [r["a1"] for r in made.gt.collect()] == [0]


def test_ingest_pushes_filters_and_shuffles_once(spark, data):
    stored = load(spark, data)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(filter" in plan(filters.filter_pass(stored).variants.select("row_id"))
    assert plan(filters.filter_maf(stored).variants.select("row_id")).count("Exchange hashpartitioning(row_id") <= 2 and "Exchange" not in plan(filters.filter_quality(stored).variants)


def wide(spark, n):
    people = spark.createDataFrame([(i, f"s{i}", f"g{i % 3}") for i in range(n)], "sample_idx INT, sample STRING, grp STRING")
    rows = spark.range(20).select(F.col("id").alias("row_id"))
    variants = rows.select((F.col("row_id") + 1).alias("row_id"), F.lit("1").alias("chrom"), F.col("row_id").cast("double").alias("pos"), F.lit(".").alias("id"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.lit("9").alias("qual"), F.lit("PASS").alias("filter"), F.lit(None).cast("double").alias("rk"), F.lit(None).cast("double").alias("rpt"), F.lit(1).alias("n_alt"), F.lit(True).alias("is_biallelic"), F.lit(False).alias("is_indel"), F.lit(".").alias("info"), F.lit("GT").alias("format"))
    gt = variants.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(2))).alias("sample_idx")).select("row_id", F.concat(F.lit("s"), "sample_idx").alias("sample"), "sample_idx", F.lit(0).alias("a1"), F.lit(1).alias("a2"), F.lit(False).alias("phased"), F.lit("0/1").alias("fmt"), *(F.lit(1.0).alias(c) for c in ("dp", "gq", "adr")))
    return ingest(variants, gt, people)


def test_wide_layouts_are_linear_in_samples(spark):
    """Ten times the samples take about ten times as long at most; a lookup per sample would take a hundred."""
    seconds = {}
    for n in (3_000, 3_000, 30_000):
        d = wide(spark, n)
        start = time.time()
        texts = [r["line"] for r in exports.snmf(d).collect()]
        assert all(len(t) == n and t.count("1") == n // 2 and t.count("9") == n // 2 for t in texts)
        written_lines = [r["line"] for r in vcf.vcf_lines(d, updated=False).collect()]
        assert all(len(t.split("\t")) == n + 9 and t.count("0/1") == n // 2 for t in written_lines)
        seconds[n] = time.time() - start
    assert seconds[30_000] < 25 * max(seconds[3_000], 0.4)


def test_sizing():
    assert sizing.chunk_size_for(4, 100) == int(4 * 2**30 / 2 / (100 * (44.125 + 35)))
    assert sizing.chunk_size_for(0.001, 10**6) == 1_000 and sizing.chunk_size_for(10**6, 1) == 500_000
    assert sizing.chunk_size_for(8, 100, workers=4) == int(8 * 2**30 / 2 / 4 / (100 * (44.125 + 35 + 52)))


def test_memory_estimate_and_plots(spark, tmp_path):
    data = grid(spark, tmp_path)
    assert sizing.memory_estimate(data, chunk_size=10) == {"n_var": 3, "n_samples": 4, "n_pops": 2, "chunk_bytes": 800, "matrix_bytes": 96, "peak_bytes": 896}
    assert sizing.memory_estimate(data, ["x"], "pop", 10)["matrix_bytes"] == 24 and sizing.memory_estimate(data, format="chunk", chunk_size=10)["peak_bytes"] == 1600
    plots.assess_missing(data, str(tmp_path), "p")
    xml.dom.minidom.parse(str(tmp_path / "p_missing.svg"))
    assert (tmp_path / "p_missing.csv").read_text().startswith("sample,group,missing_n,missing_p,total_loci\n")
    with pytest.raises(ValueError):
        plots.assess_coverage(data, str(tmp_path), "p")
    deep = read(spark, tmp_path, [line(fmt="GT:DP", cells=("0/1:9", "1/1:<3", "0/0:100"))], name="d.vcf")
    assert plots.assess_coverage(deep, str(tmp_path), "a<b").count() == 2
    assert xml.dom.minidom.parse(str(tmp_path / "a<b_coverage.svg")).getElementsByTagName("polygon").length == 2


def test_reports_and_renaming(spark, tmp_path):
    data = read(spark, tmp_path, [line(fmt="GT:DP:AD", cells=("0/1:9:99,1", "1/1:30:0,9", ".:3:1,1")), line(fmt="GT:DP:AD", cells=("0/1::5,5", "0/1:10:1,99", "0/0:1:9,0"))])
    assert filters.coverage_report(data) == {"masked": 3, "called": 5} and filters.adr_report(data) == {"low": 1, "high": 1, "heterozygotes": 3}
    with pytest.warns(UserWarning, match="no samples"):
        moved = samples.rename_samples(data, [{"id": " A ", "new_id": "B", "pop": "p"}, {"id": "B", "new_id": "A", "pop": ""}, {"id": "zz", "new_id": "q", "pop": None}], update_groups=True)
    assert [tuple(r) for r in moved.samples.orderBy("sample_idx").select("sample", "grp").collect()] == [("B", "p"), ("A", None), ("C", None)]
    with pytest.warns(UserWarning, match="no group"):
        samples.set_groups(data, spark.createDataFrame([("A", "x"), ("B", "NA"), ("C ", " y ")], "id STRING, pop STRING"))
    for bad in ([{"id": "A", "new_id": "x"}, {"id": "A", "new_id": "y"}], {"A": "B"}, {"A": "x\ty"}, {"A": ""}):
        with pytest.raises(ValueError):
            samples.rename_samples(data, bad)


def test_chrom_numbers(spark, tmp_path):
    data = samples.set_groups(read(spark, tmp_path, [line(chrom="chr7", pos="1"), line(chrom="Chr_12", pos="2"), line(chrom="3", pos="3")]), [{"id": s, "pop": "g"} for s in "ABC"])
    assert [r["line"].split("\t")[0] for r in exports.plink_bim(data).orderBy("row_id").collect()] == ["7", "12", "3"]
    assert {r["line"] for r in exports.chrom_map_lines(data).collect()} == {"chr7\t7", "Chr_12\t12", "3\t3"}


def test_parts_make_up_the_file(spark, tmp_path):
    data = read(spark, tmp_path, [line(pos=str(i)) for i in range(1, 300)])
    for name in ("a.vcf", "b.vcf.gz"):
        vcf.write_vcf(data, str(tmp_path / name), updated=False)
        vcf.write_vcf(data, str(tmp_path / f"parts.{name}"), updated=False, parts=True)
        joined = b"".join(p.read_bytes() for p in sorted((tmp_path / f"parts.{name}").glob("*/part-*")))
        text = lambda b: gzip.decompress(b) if name.endswith("gz") else b
        assert text(joined) == text((tmp_path / name).read_bytes())


def test_copy_keeps_what_filters_hid(spark, tmp_path):
    data = filters.filter_indels(grid(spark, tmp_path))
    copied = data.with_samples(data.samples.where("sample <> 'B'")).copy()
    assert copied.live().count() == 12 and copied.gt.count() == 15 and copied.variants.count() == 4 and copied.loci.count() == 5
