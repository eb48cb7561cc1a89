"""The registered queries of the numbered operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm import lexical, linededup, media, mixing, onebit, packing, passages, quality, sharding, simhash, spelling, tokenids, toxicity
from splicelake.llm.common import checkpointed, table, word_count, written

SHARDS = 16
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(checkpointed(docs))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER up, 0)) / sum(w) OVER down AS level
  FROM c
  WINDOW up AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    down AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
    length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)),
    (((coalesce(doc_id, size) % {1 << 31} + {1 << 31}) % {1 << 31}) * {mixing.SPREAD} % {1 << 32}) // {(1 << 32) // mixing.SALTS},
    size, doc_id NULLS FIRST) - 1 AS k,
    CAST(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce('=' || source, '')), 1, 12) AS BIGINT) AS DOUBLE) / {16**12} AS offset_
  FROM d)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CAST(r.size * CASE WHEN t.source_size > 0 THEN
    floor((r.k + 1) * (t.target / t.source_size) + offset_) - floor(r.k * (t.target / t.source_size) + offset_) ELSE 0 END AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""


#: Labels with this remainder of crc32(doc_id as text) by 3 are held out of training.
HELD_OUT = 1


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == HELD_OUT


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), only=~held_out())
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line occurrence that fuzzy line deduplication removes, and the one that stays for it."""
    removed = linededup.removed_lines(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "line", "kept_doc_id", "kept_line", "exact")


def op5_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.shard(checkpointed(docs), [1.0] * SHARDS, grown="grown_shard", slot="slot")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenids.write(table(spark, sf_dir, "documents"), TOKENIZER)
    return tokenids.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees).select("doc_id", *quality.BASE, "base_failed", "kept", "quality")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op10_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads and tensors are both stored and read back; figures from floats are rounded, so they agree between machines."""
    found = media.analyse(media.store(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "n_frames", "spans", "tensors", "segments",
    )
    stored = media.read_bands(written(found, "features"))
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    loud = F.array_join(F.transform("segments", lambda s: F.concat(ms(s["start_s"]), F.lit("-"), ms(s["end_s"]))), ",")
    bands = F.array_join(F.transform("means", lambda b: F.round(b * 10).cast("long").cast("string")), ",")
    parts = {"frames": F.col("n_frames"), "spans": F.size("spans"), "end_ms": ms(F.element_at("spans", -1)["end_s"]), "loud_ms": loud, "bands": bands, "tensors": F.concat_ws("x", "n_tensors", "shape")}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), x) for name, x in parts.items()])
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{"".join(map(chr, range(65, 91)))}', '{"".join(map(chr, range(97, 123)))}'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{"".join(map(chr, range(65, 91)))}', '{"".join(map(chr, range(97, 123)))}'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * CAST(len(t) AS BIGINT) * nn) // ll AS m FROM d, c),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {lexical.TOP}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_ids": op2_token_ids,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_shared_passages": op5_shared_passages,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_media_features": op10_media_features,
    "op11_one_bit_neighbours": op11_one_bit_neighbours,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op13_ranked_search": OP13_SQL}
