"""Alignment, read, interval and variant tables derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BASES = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_TO_BASES = """regexp_replace(translate({text},
  'bdefhijklmopqrsuvwxyzacgtBDEFHIJKLMOPQRSUVWXYZ .,',
  'ACGTACGTACGTACGTACGTAACGTACGTACGTACGTACGTACGTA'), '[^ACGT]', 'N'@G@)"""

#: A row's number in its order: order and line number alone do not name a row.
_ROW = """cast(row_number() over (partition by l_orderkey order by
      l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as bigint)"""

#: Name -> SQL. Tables and views stand in braces; @G@ is the flag that DuckDB needs to replace all matches, @EACH@(n) gives a
#: row for each number from 0 to n.
VIEWS: dict[str, str] = {
    # one row an alignment: match, intron (0: none), match
    "v_hits": """select l_orderkey as insert_id, @ROW@ as ord, l_linenumber % 2 + 1 as mate, 'c' || (l_suppkey % 5) as contig,
      cast((l_partkey * 131 + l_linenumber * 977) % 20000 as bigint) as lft, cast(5 + cast(floor(l_quantity) as bigint) % 40 as bigint) as m1,
      case when l_linenumber % 3 = 0 then 50 + l_partkey % 400 else cast(0 as bigint) end as intron, 5 + l_partkey % 30 as m2,
      l_linenumber % 2 = 1 as antisense_aln, l_suppkey % 2 = 0 as antisense_splice,
      cast(floor(l_discount * 100 + 0.5) as bigint) % 4 as edit_dist, -6 * (cast(floor(l_discount * 100 + 0.5) as bigint) % 4) as as_score
      from {lineitem}""",
    # donors fall on few places, so junctions have support
    "v_dense_hits": """select l_orderkey as insert_id, @ROW@ as ord, l_linenumber % 2 + 1 as mate, 'c' || (l_suppkey % 5) as contig,
      100 + (l_partkey % 40) * 25 - (5 + cast(floor(l_quantity) as bigint) % 40) + 1 as lft, 5 + cast(floor(l_quantity) as bigint) % 40 as m1,
      60 + l_partkey % 3 as intron, 5 + l_partkey % 30 as m2, l_linenumber % 2 = 1 as antisense_aln, l_suppkey % 2 = 0 as antisense_splice,
      cast(floor(l_discount * 100 + 0.5) as bigint) % 4 as edit_dist, -6 * (cast(floor(l_discount * 100 + 0.5) as bigint) % 4) as as_score
      from {lineitem}""",
    # SAM rows; pos from 0
    "v_sam": """select l_orderkey as insert_id, @ROW@ as ord, 'r' || l_orderkey as qname,
      cast(1 + case when l_returnflag = 'A' then 2 else 0 end + case when l_partkey % 17 = 0 then 4 else 0 end
        + case when l_suppkey % 19 = 0 then 8 else 0 end + case when l_suppkey % 2 = 0 then 16 else 0 end
        + case when l_partkey % 3 = 0 then 32 else 0 end + case when l_linenumber % 2 = 1 then 64 else 128 end
        + case when l_linenumber > 4 then 256 else 0 end + case when l_linestatus = 'O' and l_partkey % 13 = 0 then 512 else 0 end
        + case when l_partkey % 11 = 0 then 1024 else 0 end as bigint) as flag,
      'c' || (l_suppkey % 5) as rname, cast((l_partkey * 131 + l_linenumber * 977) % 20000 as bigint) as pos, l_partkey % 60 as mapq,
      case when l_partkey % 10 = 0 then (5 + l_partkey % 30) || 'M' || (1 + l_suppkey % 3) || 'I20M'
        when l_partkey % 10 = 1 then (5 + l_partkey % 30) || 'M' || (1 + l_suppkey % 3) || 'D20M'
        when l_partkey % 10 = 2 then '3S' || (5 + l_partkey % 30) || 'M'
        when l_linenumber % 3 = 0 then (5 + l_suppkey % 20) || 'M' || (50 + l_partkey % 400) || 'N' || (5 + l_partkey % 30) || 'M'
        else (20 + l_partkey % 30) || 'M' end as cigar,
      case when l_suppkey % 19 = 0 then '*' when l_suppkey % 7 = 0 then 'c' || (l_partkey % 5) else '=' end as rnext,
      cast((l_partkey * 131 + l_linenumber * 977 + 150) % 20000 as bigint) as pnext,
      cast(case when l_suppkey % 19 = 0 then 0 else 150 + cast(floor(l_quantity) as bigint) end as bigint) as tlen,
      substr(repeat(translate(md5('s' || l_orderkey || ':' || l_linenumber), '0123456789abcdef', 'ACGTACGTACGTACGN'), 3), 1, cast(20 + l_partkey % 30 as int)) as seq,
      substr(repeat(translate(md5('q' || l_orderkey || ':' || l_linenumber), '0123456789abcdef', '56789ABCDEFGHIJK'), 3), 1, cast(20 + l_partkey % 30 as int)) as qual,
      'rg' || (l_partkey % 4) as rg, -(cast(floor(l_tax * 100 + 0.5) as bigint) % 9) as as_score, cast(floor(l_discount * 100 + 0.5) as bigint) % 4 as nm,
      case when l_partkey % 5 = 0 then null when l_suppkey % 2 = 0 then '+' else '-' end as xs
      from {lineitem}""",
    # whole texts, cut into reads of 120 characters, and whole pages
    "v_reads": f"""select read_id, mate, name, seq, substr(repeat(translate(md5('q' || read_id), '0123456789abcdef', '56789ABCDEFGHIJK'), 4), 1, length(seq)) as qual
      from (select doc_id * 1000000 + k as read_id, cast(1 + (doc_id + k) % 2 as int) as mate, 'read' || (doc_id * 1000000 + k) as name, {_TO_BASES.format(text="substr(text, cast(k * 120 + 1 as int), 120)")} as seq
        from (select doc_id, text, @EACH@(cast(floor((length(text) - 1) / 120.0) as bigint)) as k from {{documents}} where length(text) > 0) c) x""",
    "v_genome": f"""select 'p' || page_id as contig, {_TO_BASES.format(text="html")} as seq from {{pages}}""",
    # three segments of 25 bases, planted in each 500 bases of a contig: d bases behind the first seam an intron (N), a deletion
    # (D), an insertion (I) of n bases or nothing (=) lies; l1, l2, l3 are where the segments are, r1, r2, r3 the genome there
    "v_planted": """select contig, k, a, kind, d, n, bases, a as l1, case when kind = 'I' then a + 25 - n else a + 25 + n end as l2, case when kind = 'I' then a + 50 - n else a + 50 + n end as l3,
      substr(seq, cast(a + 1 as int), 25) as r1, substr(seq, cast(case when kind = 'I' then a + 26 - n else a + 26 + n end as int), 25) as r2, substr(seq, cast(case when kind = 'I' then a + 51 - n else a + 51 + n end as int), 25) as r3
      from (select contig, seq, k, a, kind, d, n, substr(seq, cast(a + 1 as int), cast(25 + d as int)) || case when kind = 'I' then substr('TGCATGCA', cast(1 + k % 4 as int), cast(n as int)) || substr(seq, cast(a + 26 + d as int), cast(50 - d - n as int))
          else substr(seq, cast(a + 26 + d + n as int), cast(50 - d as int)) end as bases
        from (select contig, seq, k, 40 + 500 * k as a, kind, case when kind = '=' then cast(0 as bigint) when kind = 'I' then (id + 3 * k) % 5 - 2 else (id + 3 * k) % 8 - 3 end as d,
            case when kind = 'N' then 60 + (7 * id + k) % 200 when kind = '=' then cast(0 as bigint) else 1 + (id + k) % 3 end as n
          from (select contig, seq, id, k, substr('NDI=', cast(1 + (id + k) % 4 as int), 1) as kind
            from (select contig, seq, cast(substr(contig, 2) as bigint) as id, @EACH@(cast(floor((length(seq) - 400) / 500.0) as bigint)) as k from
              (select 'p' || page_id as contig, @PAGE@ as seq from {pages}) p where length(seq) >= 400) q) x) y) z""",
    "v_intervals": """select event_id, 'u' || (user_id % 8) as chrom, event_id * 37 % 50000 as iv_begin,
      event_id * 37 % 50000 + 1 + cast(floor(abs(value)) as bigint) % 500 as iv_end from {events}""",
    "v_regions": """select o_orderkey, 'u' || (o_custkey % 8) as chrom, o_orderkey * 53 % 50000 as iv_begin,
      o_orderkey * 53 % 50000 + 200 + o_custkey % 800 as iv_end from {orders}""",
    # exons of transcripts, half open
    "v_exons": """select 'tx' || l_partkey as tx_id, 'g' || (l_partkey % 50) as gene, 'c' || (l_partkey % 5) as contig,
      case when l_partkey % 2 = 0 then '+' else '-' end as strand,
      cast((l_partkey * 977) % 100000 + l_linenumber * 700 as bigint) as ex_start, cast((l_partkey * 977) % 100000 + l_linenumber * 700 + 80 + max(l_suppkey % 120) as bigint) as ex_end
      from {lineitem} group by l_partkey, l_linenumber""",
    # variant sites and genotypes
    "v_variants": """select p_partkey as site, p_brand as contig, cast(p_partkey * 97 % 200000 as bigint) as pos,
      case when p_size % 7 = 0 then 'AC' else substr('ACGT', cast(1 + p_size % 4 as int), 1) end as ref,
      case when p_size % 5 = 0 then 'ACG' else substr('ACGT', cast(1 + (p_size + 1 + p_partkey % 3) % 4 as int), 1) end as alt,
      floor(p_retailprice) / 10 as qual, cast(p_size as bigint) as depth, cast(p_partkey % 60 as bigint) as mq, p_partkey % 6 = 0 as known from {part}""",
    "v_genotypes": """select l_partkey as site, l_suppkey % 4 as sample, cast(max(cast(floor(l_quantity) as bigint)) as bigint) as pl0,
      cast(max(cast(floor(l_discount * 100 + 0.5) as bigint) * 5) as bigint) as pl1, cast(max(cast(floor(l_tax * 100 + 0.5) as bigint) * 7) as bigint) as pl2,
      cast(max(l_linenumber) * 3 as bigint) as dp from {lineitem} group by l_partkey, l_suppkey % 4""",
    # bases over positions
    "v_pileup": """select l_orderkey as read_no, l_linenumber as ord, 'c' || (l_suppkey % 3) as contig, cast(l_partkey % 200 as bigint) as pos, 's' || (l_suppkey % 2) as sample,
      substr('ACGT', cast(1 + (l_partkey + case when l_linenumber % 5 = 0 then 1 else 0 end) % 4 as int), 1) as base, substr('ACGT', cast(1 + l_partkey % 4 as int), 1) as ref,
      cast(5 + cast(floor(l_quantity) as bigint) % 36 as bigint) as base_q, cast(l_orderkey % 60 as bigint) as map_q, l_linenumber % 2 = 0 as reverse,
      cast(l_linenumber * 6 % 40 as bigint) as qpos, 40 as read_len, cast(case when l_orderkey % 29 = 0 then 1 + l_linenumber % 2 when l_orderkey % 31 = 0 then -1 else 0 end as bigint) as indel,
      l_orderkey % 37 = 0 as is_del from {lineitem}""",
    "v_fusions": """select o_orderkey as fusion_id, 'c' || (o_custkey % 5) as contig1, 'c' || (o_orderkey % 5) as contig2,
      cast(o_orderkey * 131 % 900000 as bigint) as lft, cast(o_custkey * 977 % 900000 as bigint) as rgt,
      substr('fffrrfrr', cast(1 + 2 * (o_orderkey % 4) as int), 2) as dir, cast(1 + o_orderkey % 9 as bigint) as n_reads, cast(o_custkey % 7 as bigint) as n_pairs,
      cast(o_custkey % 5 as bigint) as n_span, cast(10 + o_orderkey % 40 as bigint) as left_ext, cast(10 + o_custkey % 40 as bigint) as right_ext,
      substr(repeat(translate(md5('l' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTACGT'), 2), 1, 46) as left_seq,
      substr(repeat(translate(md5('r' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTACGT'), 2), 1, 46) as right_seq from {orders}""",
}
VIEWS = {name: sql.replace("@ROW@", _ROW).replace("@PAGE@", _TO_BASES.format(text="html")) for name, sql in VIEWS.items()}


class Tables:
    """The tables in ``sf_dir`` and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            return self.over(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def over(self, name: str, **given: DataFrame) -> DataFrame:
        """The view ``name``; tables that are ``given`` stand for those of the folder."""
        sql = re.sub(r"@EACH@(\(.*\)) as k", r"explode(sequence(cast(0 as bigint), \1)) as k", VIEWS[name].replace("@G@", ""))
        return self.spark.sql(sql, **{t: given[t] if t in given else getattr(self, t) for t in re.findall(r"\{(\w+)\}", sql)})


def _duck(view: str) -> str:
    rows = re.sub(r"@EACH@(\(.*\)) as k", r"unnest(generate_series(0, \1)) as k", view.replace("@G@", ",'g'"))
    return re.sub(r"[{}]", "", rows)


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it names in front."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = ", ".join(f"{v} AS ({_duck(VIEWS[v])})" for v in names)
    body = sql.strip()
    if not views:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
