"""Readers and writers of text formats. Each parser takes rows of ``value``; ``read_*`` apply it to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicelake.operators.reads import numbered


def _field(k: int) -> Column:
    return F.get(F.split("value", "\t"), k)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``value``, with the ``file`` and the ``block`` (first byte of the split) that each comes from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def formats(lines: DataFrame) -> DataFrame:
    """``file`` and ``format``: ``fasta`` or ``fastq`` by the first character of the file's first line that is not blank, null
    for others. Lines have ``file``, ``block`` and ``value``, in order within a block."""
    shown = lines.where(F.length(F.trim("value")) > 0).select("file", F.substring("value", 1, 1).alias("_c"), F.struct("block", F.monotonically_increasing_id().alias("id")).alias("_at"))
    first = shown.groupBy("file").agg(F.min_by("_c", "_at").alias("_c"))
    return first.select("file", F.when(F.col("_c") == ">", "fasta").when(F.col("_c") == "@", "fastq").alias("format"))


def fasta(records: DataFrame) -> DataFrame:
    """``name`` (up to the first blank), ``description``, ``seq`` (upper case, points as N) of records: a header line, with or
    without its mark, and any lines of sequence."""
    clean = F.regexp_replace("value", r"^>|\r|\n+$", "")
    head = F.substring_index(clean, "\n", 1)
    body = F.when(F.locate("\n", clean) > 0, F.expr("substr(_c, locate('\\n', _c) + 1)")).otherwise("")
    rows = records.withColumn("_c", clean).where(F.length(F.trim("_c")) > 0)
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*(.*)$", 1)).alias("description"), F.translate(F.upper(F.translate(body, "\n ", "")), ".", "N").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark.read.text(path, lineSep="\n>"))


def fastq(lines: DataFrame) -> DataFrame:
    """``number``, ``name``, ``seq``, ``qual`` of lines with the ``number`` of their record and their ``line`` (0 to 3) in it."""
    rows = lines.groupBy("number").pivot("line", [0, 1, 2, 3]).agg(F.first("value"))
    return rows.select("number", F.regexp_extract("0", r"^@(\S*)", 1).alias("name"), F.translate(F.upper("1"), ".", "N").alias("seq"), F.col("3").alias("qual")).where(F.length("seq") == F.length("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    return fastq(numbered(read_lines(spark, path), 4))


def to_fastq(reads: DataFrame) -> DataFrame:
    suffix = F.when(F.col("mate") > 0, F.concat(F.lit("/"), F.col("mate").cast("string"))).otherwise("")
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name", suffix), "seq", F.lit("+"), "qual").alias("value"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of files with their ``library`` and ``sample``, those of the read group that the tag RG names in the same
    file's header."""
    lines = read_lines(spark, path)
    groups = header_groups(lines).select("file", F.col("id").alias("_rg"), "library", "sample")
    rows = sam(lines, "file")
    return rows.withColumn("_rg", F.col("tags")["RG"]).join(F.broadcast(groups), ["file", "_rg"], "left").drop("_rg")


def header_groups(lines: DataFrame) -> DataFrame:
    """Read groups of header lines: ``file`` (if there), ``id``, ``library``, ``sample``."""
    field = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:([^\t]+)", 1), F.lit(""))
    kept = [c for c in lines.columns if c == "file"]
    return lines.where(F.col("value").startswith("@RG\t")).select(*kept, field("ID").alias("id"), field("LB").alias("library"), field("SM").alias("sample")).where("id is not null").dropDuplicates([*kept, "id"])


SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam(text: DataFrame, *kept: str) -> DataFrame:
    """Alignments, header lines left out; ``pos`` and ``pnext`` from 0, optional fields in the map ``tags``, and the columns
    ``kept``."""
    body = text.where(~F.col("value").startswith("@"))
    numbers = {"flag", "mapq", "tlen", "pos", "pnext"}
    columns = [(_field(k).cast("long") - (1 if n in ("pos", "pnext") else 0) if n in numbers else _field(k)).alias(n) for k, n in enumerate(SAM)]
    more = F.slice(F.split("value", "\t"), 12, 1 << 20)
    return body.select(*kept, *columns, F.map_from_entries(F.transform(more, lambda x: F.struct(F.substring(x, 1, 2), F.regexp_extract(x, r"^..:.:(.*)$", 1)))).alias("tags"))


def to_sam(rows: DataFrame, tags: Column | None = None) -> DataFrame:
    """SAM lines of alignments with the columns of ``SAM``; ``tags`` is text of optional fields."""
    parts = [(F.col(n) + 1 if n in ("pos", "pnext") else F.col(n)).cast("string") for n in SAM]
    return rows.select(F.concat_ws("\t", *parts, *([tags] if tags is not None else [])).alias("value"))


def header_contigs(text: DataFrame) -> DataFrame:
    line = text.where(F.col("value").startswith("@SQ"))
    return line.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def bed(text: DataFrame) -> DataFrame:
    """``contig``, ``start``, ``end`` of rows of three columns, or of two (a position from 1)."""
    rows = text.where(~F.col("value").rlike("^(#|track|browser|$)"))
    one = F.size(F.split("value", "\t")) == 2
    return rows.select(_field(0).alias("contig"), F.when(one, _field(1).cast("long") - 1).otherwise(_field(1).cast("long")).alias("start"), F.when(one, _field(1).cast("long")).otherwise(_field(2).cast("long")).alias("end"))


def junctions(text: DataFrame) -> DataFrame:
    """Rows of contig, left, right, strand."""
    return text.select(_field(0).alias("contig"), _field(1).cast("long").alias("left"), _field(2).cast("long").alias("right"), (_field(3) == "-").alias("antisense"))


def deletions(text: DataFrame) -> DataFrame:
    """Rows of contig, left + 1, right."""
    return text.select(_field(0).alias("contig"), (_field(1).cast("long") - 1).alias("left"), _field(2).cast("long").alias("right"))


def insertions(text: DataFrame) -> DataFrame:
    """Rows of contig, left, left, bases; those with unknown bases are left out."""
    return text.select(_field(0).alias("contig"), _field(1).cast("long").alias("left"), _field(3).alias("bases")).where("not contains(bases, 'N')")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed(read_lines(spark, path))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return vcf(read_lines(spark, path))


def read_gff(spark: SparkSession, path: str, *, merge: int | None = 5) -> DataFrame:
    """Transcripts of GFF3 or GTF files; names count within a file."""
    return gff(read_lines(spark, path), merge=merge)


#: Features that are parts of a transcript.
_PARTS = ("exon", "CDS", "five_prime_UTR", "three_prime_UTR", "start_codon", "stop_codon")


def gff(lines: DataFrame, *, merge: int | None = 5, levels: int = 8) -> DataFrame:
    """Transcripts of GFF3 or GTF rows: ``tx_id``, ``gene``, ``contig``, ``strand``, ``start``, ``end`` and ``exons`` (half open,
    from 0, in order).

    In GFF3 a part names its parents, several with commas, and these theirs: the gene of a transcript is the topmost of its
    ancestors, found by a join a level, up to ``levels``. In GTF, parts name transcript and gene. A transcript has its exons,
    or where it has none its coding parts; a feature other than a part that nothing names as parent and that has no parts
    itself (a gene without children) is a transcript of one exon. Transcripts shrink to the span of their exons; exons up
    to ``merge`` bases apart are one, overlapping ones always. Rows of one transcript on several contigs or strands are a
    transcript on each. Features that only come as parents of others are left out, and so are rows of fewer than nine
    columns and comments; what follows a line ##FASTA has no columns.
    """
    text = lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))
    f = F.split("value", "\t")
    rows = text.where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    gff3 = lambda name: F.nullif(F.regexp_extract(F.get(f, 8), rf"(?:^|;)\s*{name}=([^;]*)", 1), F.lit(""))
    old = lambda name: F.nullif(F.regexp_extract(F.get(f, 8), rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))
    rows = rows.select(
        "file", F.get(f, 0).alias("contig"), F.get(f, 2).alias("kind"), (F.get(f, 3).cast("long") - 1).alias("start"), F.get(f, 4).cast("long").alias("end"), F.get(f, 6).alias("strand"),
        gff3("ID").alias("id"), F.coalesce(gff3("Parent"), old("transcript_id")).alias("parents"), gff3("Parent").isNull().alias("gtf"), old("gene_id").alias("gene"),
    ).where("start < end")
    parts = rows.where(F.col("kind").isin(*_PARTS)).withColumn("tx_id", F.explode(F.split("parents", ",")))
    features = rows.where(~F.col("kind").isin(*_PARTS) & F.col("id").isNotNull())
    links = features.where("parents is not null").select("file", "id", F.explode(F.split("parents", ",")).alias("parent")).distinct()
    # the topmost ancestor of each feature, by a join a level
    tops = links.groupBy("file", "id").agg(F.min("parent").alias("top"))
    up = tops.select("file", F.col("id").alias("top"), F.col("top").alias("_next"))
    for _ in range(levels - 1):
        tops = tops.join(up, ["file", "top"], "left").select("file", "id", F.coalesce("_next", "top").alias("top"))
    exons = parts.where("kind in ('exon', 'CDS')").select("file", "contig", "strand", "tx_id", "gene", "start", "end", (F.col("kind") == "exon").alias("exon"))
    lonely = features.join(parts.select("file", F.col("tx_id").alias("id")).distinct(), ["file", "id"], "left_anti").join(links.select("file", F.col("parent").alias("id")).distinct(), ["file", "id"], "left_anti")
    exons = exons.unionByName(lonely.select("file", "contig", "strand", F.col("id").alias("tx_id"), "gene", "start", "end", F.lit(True).alias("exon")))
    key = ["file", "contig", "tx_id", "strand"]
    w = Window.partitionBy(*key)
    exons = exons.withColumn("_has", F.max("exon").over(w)).where("exon or not _has")
    ordered = w.orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") >= reach if merge is None else F.col("start") - reach > merge
    joined = exons.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("_g", F.sum("_new").over(ordered)).groupBy(*key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("gene").alias("gene"))
    found = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("gene").alias("gene"))
    named = found.join(tops.withColumnRenamed("id", "tx_id"), ["file", "tx_id"], "left")
    return named.select("tx_id", F.coalesce("gene", "top", "tx_id").alias("gene"), "contig", "strand", "start", "end", "exons")


def gtf(text: DataFrame, *, merge: int = 5) -> DataFrame:
    """Transcripts of exon rows: ``tx_id``, ``gene``, ``contig``, ``strand``, ``exons`` (half open, from 0, in order); exons up
    to ``merge`` bases apart are one."""
    attribute = lambda name: F.regexp_extract("value", rf'{name} "([^"]*)"', 1)
    rows = text.where(~F.col("value").startswith("#")).where(_field(2) == "exon")
    exon = rows.select(attribute("transcript_id").alias("tx_id"), attribute("gene_id").alias("gene"), _field(0).alias("contig"), _field(6).alias("strand"), (_field(3).cast("long") - 1).alias("s"), _field(4).cast("long").alias("e"))
    key = ["contig", "tx_id", "gene", "strand"]
    w = Window.partitionBy(*key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = exon.withColumn("_f", F.when(F.col("s") - reach > merge, 1).otherwise(0)).withColumn("_g", part).groupBy(*key, "_g").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))


def refgene(text: DataFrame) -> DataFrame:
    """Genes of rows of sixteen columns with arrays of exon starts and ends."""
    longs = lambda k: F.transform(F.filter(F.split(_field(k), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return text.select(_field(1).alias("tx_id"), _field(2).alias("contig"), _field(3).alias("strand"), _field(4).cast("long").alias("start"), _field(5).cast("long").alias("end"), longs(9).alias("ex_starts"), longs(10).alias("ex_ends"), _field(12).alias("gene"))


def repeats(text: DataFrame) -> DataFrame:
    """Intervals of repeat rows: blank separated, contig in the fifth column, start (from 1) and end after it; rows of fewer
    than seven columns are left out."""
    f = F.split(F.trim("value"), r"\s+")
    return text.where(F.size(f) >= 7).select(F.get(f, 4).alias("contig"), (F.get(f, 5).cast("long") - 1).alias("start"), F.get(f, 6).cast("long").alias("end")).where("start is not null and end is not null")


def vcf(text: DataFrame) -> DataFrame:
    """Sites with ``info`` as a map and ``samples`` as an array of maps from format to value; ``pos`` from 0."""
    rows = text.where(~F.col("value").startswith("#"))
    names = F.split(_field(8), ":")
    per = F.transform(F.slice(F.split("value", "\t"), 10, 1 << 20), lambda s: F.map_from_arrays(F.slice(names, F.lit(1), F.size(F.split(s, ":"))), F.split(s, ":")))
    return rows.select(_field(0).alias("contig"), (_field(1).cast("long") - 1).alias("pos"), _field(2).alias("id"), _field(3).alias("ref"), F.split(_field(4), ",").alias("alt"), _field(5).cast("double").alias("qual"), _field(6).alias("filter"), F.str_to_map(_field(7), F.lit(";"), F.lit("=")).alias("info"), per.alias("samples"))
