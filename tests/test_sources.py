"""Readers of text formats, on files."""

import pytest

from splicelake.operators import sequences as Q
from splicelake.sources import text as T


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "16"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def record(file, i):
    bases = "ACGT"[i % 4] * (10 + i % 7)
    return f"{file}_{i}", bases, "I" * len(bases)


def test_fastq_of_several_files_and_splits(spark, tmp_path, small_splits):
    """Lines keep their record however splits are packed: long and short files, one without a last line end."""
    sizes = {"a": 100, "b": 180, "c": 1, "d": 950}
    for name, n in sizes.items():
        text = "\n".join(f"@{x} more\n{s}\n+\n{q}" for x, s, q in (record(name, i) for i in range(n)))
        (tmp_path / f"{name}.fq").write_text(text + ("\n" if name != "b" else ""))
    lines = T.read_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 5
    got = T.read_fastq(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r.number, r.name, r.seq, r.qual) for r in got] == [(k, *x) for k, x in enumerate(record(name, i) for name, n in sizes.items() for i in range(n))]
    (tmp_path / "e.fa").write_text("\n \n>x\nACGT\n")
    kinds = {r.file.rsplit("/", 1)[1]: r.format for r in T.formats(T.read_lines(spark, str(tmp_path))).collect()}
    assert kinds == {"a.fq": "fastq", "b.fq": "fastq", "c.fq": "fastq", "d.fq": "fastq", "e.fa": "fasta"}


def test_sam_with_read_groups(spark, tmp_path):
    body = "\t".join(["r1", "0", "c", "5", "9", "4M", "*", "0", "0", "ACGT", "IIII"])
    (tmp_path / "a.sam").write_text(f"@HD\tVN:1.0\n@RG\tID:g\tSM:one\tLB:lib\n@RG\tSM:none\n{body}\tRG:Z:g\tNM:i:1\n{body}\n")
    (tmp_path / "b.sam").write_text(f"@RG\tID:g\tSM:two\n{body}\tRG:Z:g\n")
    got = {(r.file.rsplit("/", 1)[1], r.tags.get("RG"), r.pos, r.sample, r.library) for r in T.read_sam(spark, str(tmp_path)).collect()}
    assert got == {("a.sam", "g", 4, "one", "lib"), ("a.sam", None, 4, None, None), ("b.sam", "g", 4, "two", None)}


def test_bed_and_vcf_files(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track x\nc\t5\t9\tname\nc\t7\n")
    assert {tuple(r) for r in T.read_bed(spark, str(tmp_path / "x.bed")).collect()} == {("c", 5, 9), ("c", 6, 7)}
    (tmp_path / "x.vcf").write_text("##x\n#CHROM\nc\t10\trs\tA\tC\t3.5\tPASS\tDP=4\tGT\t0/1\n")
    assert [(r.contig, r.pos, r.alt, r.samples) for r in T.read_vcf(spark, str(tmp_path / "x.vcf")).collect()] == [("c", 9, ["C"], [{"GT": "0/1"}])]


GFF3 = """##gff-version 3
c1	x	gene	1	1000	.	+	.	ID=g1;Name=one
c1	x	mRNA	1	1000	.	+	.	ID=t1;Parent=g1
c1	x	mRNA	1	1000	.	+	.	ID=t2;Parent=g1
c1	x	exon	11	20	.	+	.	Parent=t1,t2
c1	x	exon	24	40	.	+	.	Parent=t1
c1	x	exon	101	200	.	+	.	Parent=t2
c1	x	CDS	12	35	.	+	0	Parent=t1
c1	x	gene	5001	5100	.	-	.	ID=g2
c2	x	gene	1	900	.	-	.	ID=g3
c2	x	mRNA	1	900	.	-	.	ID=t3;Parent=g3
c2	x	CDS	51	90	.	-	0	Parent=t3
c2	x	CDS	201	290	.	-	0	Parent=t3
c2	x	region	1	2
##FASTA
>c1
"""
GTF = """#x
c1	y	exon	1	50	.	+	.	gene_id "G"; transcript_id "T";
c1	y	exon	101	150	.	+	.	gene_id "G"; transcript_id "T";
c1	y	CDS	1	60	.	+	.	gene_id "G"; transcript_id "T";
"""


def test_gff3_parents_and_gtf(spark, tmp_path):
    (tmp_path / "x.gff3").write_text(GFF3)
    (tmp_path / "y.gtf").write_text(GTF)
    plain = lambda df: {r.tx_id: (r.gene, r.contig, r.strand, [(e.start, e.end) for e in r.exons]) for r in df.collect()}
    want = {
        "t1": ("g1", "c1", "+", [(10, 40)]), "t2": ("g1", "c1", "+", [(10, 20), (100, 200)]), "g2": ("g2", "c1", "-", [(5000, 5100)]),
        "t3": ("g3", "c2", "-", [(50, 90), (200, 290)]), "T": ("G", "c1", "+", [(0, 50), (100, 150)]),
    }
    assert plain(T.read_gff(spark, str(tmp_path))) == want
    apart = plain(T.read_gff(spark, str(tmp_path), merge=None))
    assert apart["t1"][3] == [(10, 20), (23, 40)] and apart["T"] == want["T"]
    spans = {r.tx_id: (r.start, r.end) for r in T.read_gff(spark, str(tmp_path)).collect()}
    assert spans["t1"] == (10, 40) and spans["t3"] == (50, 290)


@pytest.mark.parametrize("width", [1, 3, 20])
def test_words_and_tiles_of_any_length(spark, monkeypatch, width):
    monkeypatch.setattr(Q, "TILE", 64)
    seqs = {f"s{n}": ("ACGTTGCAAC" * 40)[:n] for n in (0, 1, 2, 19, 20, 63, 64, 65, 83, 84, 127, 128, 129, 300)}
    genome = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    got = sorted((r.contig, r.at, r.bases) for r in Q.words(genome, width, size=24).collect())
    assert got == sorted((c, i, s[i : i + width]) for c, s in seqs.items() for i in range(len(s) - width + 1))
    cut = sorted((r.contig, r.tile, r.seq) for r in Q.tiles(genome, size=24).collect())
    assert cut == sorted((c, i // 24, s[i : i + 24]) for c, s in seqs.items() for i in range(0, len(s), 24))
