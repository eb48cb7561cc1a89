"""The numbered operators: edge cases, and brute force or exact round trips on small tables."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from splicelake.llm import graph, linededup, media, mixing, packing, passages, quality, sharding, simhash, tokenids, toxicity
from splicelake.llm.queries import QUERIES, TOKENIZER
from splicelake.llm.tokenizer import WordEncoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, ties and repeated rows.
EDGES = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45), (2, None, None, "a", None), (3, "", "en", None, 0), (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 45),
    (4, LONG, "en", "b", len(LONG)), (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45), (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45), (6, " \n\t \n", "fr", "", 5),
    (7, "É ﬁ 日本 <|endoftext|> don't\x1c 12½", "fr", "c", 20), (None, None, None, None, None), (8, "one\n" * 50 + "alpha beta gamma delta epsilon zeta", "en", "c", 235),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def edges(spark):
    """The edge rows with columns whose names operators use."""
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({"score": F.lit("x"), "size": F.lit(3).cast("long"), "target": F.lit("t"), "shard": F.lit(-1), "kept": F.lit(None).cast("boolean")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_covers_its_table(spark, docs, name):
    rows = QUERIES[name](spark, SF)
    if name.startswith(("op4_", "op5_", "op12_")):
        assert rows.count() > 0
    elif name.startswith("op11_"):
        assert rows.count() == 5 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    elif name.startswith("op13_"):
        items = spark.read.parquet(f"{SF}/benchmark.parquet").count()
        per = [r["count"] for r in rows.groupBy("item_id").count().collect()]  # few documents: some items match fewer
        assert len(per) == items and max(per) == 50 and sum(per) > 45 * items
    elif name.startswith("op9_"):
        assert rows.where("piece = 0").count() == docs.count()
    else:
        assert rows.count() == docs.count() and rows.select("doc_id").distinct().count() == docs.count()


# mixing


def test_targets_share_by_weight_below_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 50), ("c", 50), ("d", 100), (None, 99)], "s string, n long")
    got = {r.s: (r._source_size, r._target) for r in mixing.targets(sizes, source="s", size="n").collect()}
    # 300 in all, weights 5 2 1 5 2: a stops at 3, the rest share 297 by 2 1 5 2
    assert got["a"] == (1, 3.0)
    assert [round(got[k][1], 6) for k in ("b", "c", "d", None)] == [59.4, 29.7, 148.5, 59.4]


def test_mix_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, "abc"[i % 3] if i % 3 else "hot", rng.randint(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) <= 3
    for source, group in itertools.groupby(sorted(got, key=lambda r: r.source), key=lambda r: r.source):
        group = list(group)
        assert abs(sum(r.copies * r.size for r in group) - group[0].target) <= 120
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.emit(mixing.mix(df)).count() == sum(r.copies for r in got)


def test_mix_edges(edges, empty):
    got = mixing.mix(edges)
    assert got.count() == len(EDGES) and got.where("source_size is null or copies is null").count() == 0
    assert mixing.mix(empty.withColumn("size", F.lit(1).cast("long"))).count() == 0
    zero = mixing.mix(edges.withColumn("size", F.lit(None).cast("long")))
    assert zero.agg(F.sum("copies")).first()[0] == 0


# sharding


def test_rendezvous_law(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(rows, [1.0] * 4 + [4.0], grown="grown", slot="slot").collect()
    counts = np.bincount([r.shard for r in got])
    assert abs(counts[4] / 4000 - 0.5) < 0.05 and all(abs(c / 4000 - 0.125) < 0.03 for c in counts[:4])
    assert all(r.grown in (r.shard, 5) for r in got) and 0 < sum(r.grown == 5 for r in got) < 1000
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))

    def brute(key, weights):
        u = [((xxhash.xxh64_intdigest(f"={key}:{i}".encode(), 42) >> 11) + 0.5) * 2.0**-53 for i in range(len(weights))]
        return max(range(len(weights)), key=lambda i: (-weights[i] / np.log(u[i]), i))

    assert all(r.shard == brute(r.doc_id, [1.0] * 4 + [4.0]) for r in got[:300])


def test_shard_edges(edges, empty):
    got = sharding.shard(edges, [1.0] * 3, slot="slot").collect()
    assert len(got) == len(EDGES) and {r.shard for r in got if r.doc_id == 5} == {next(r.shard for r in got if r.doc_id == 5)}
    assert sharding.shard(empty, [1.0], slot="slot").count() == 0
    with pytest.raises(ValueError):
        sharding.shard(empty, [])


# tokens


def test_encoder_equals_tokenizer(texts):
    odd = [t for _, t, *_ in EDGES] + ["a b  c\x1cd <|endoftext|>x", "don't I'll we've x's't 's 't", "́x É ẛ̣", "ΑΣ Σ\nΣΑΣ", "_a_b __ ´ \x7f 12a3 İstanbul ªº µ 12½ \"q\"...", "\x00 日本語 １２３", "x" * 3000]
    given = [*texts.values(), *odd]
    want = Tokenizer.from_file(TOKENIZER)
    got = list(WordEncoder(TOKENIZER).documents(given, 9))
    for text, ids in zip(given, got, strict=True):
        assert ids.tolist() == [*want.encode(text or "", add_special_tokens=False).ids, 9]


def test_encoder_forgets(monkeypatch, texts):
    given = list(texts.values())
    want = [x.tolist() for x in WordEncoder(TOKENIZER).documents(given, 1)]
    monkeypatch.setattr("splicelake.llm.tokenizer.REMEMBERED", 50)
    monkeypatch.setattr("splicelake.llm.tokenizer.SLICE_BYTES", 2000)
    assert [x.tolist() for x in WordEncoder(TOKENIZER).documents(given, 1)] == want


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70_000, 7))])
def test_rank_codec_round_trip(values):
    x = np.array(values, np.uint32)
    control, data = tokenids.encode_ranks(x)
    assert len(control) == -(-len(x) // 4)
    assert tokenids.decode_ranks(control, data, len(x)).tolist() == values


def test_token_files(spark, docs, texts, edges, empty):
    got = {r.doc_id: r for r in tokenids.read(spark, tokenids.write(docs, TOKENIZER)).collect()}
    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    for doc_id in sorted(texts):
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        row = got[doc_id]
        assert (row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    rows = tokenids.read(spark, tokenids.write(edges, TOKENIZER)).orderBy("start").collect()
    assert len(rows) == len(EDGES) and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert tokenids.read(spark, tokenids.write(empty, TOKENIZER)).count() == 0


# packing


def test_packing(spark, edges, empty):
    parts = packing.pieces(edges, TOKENIZER)
    got = packing.pack(parts).collect()
    assert len(got) == parts.count() and {r.length for r in got if r.doc_id == 2} == {1}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [*tokenizer.encode(LONG, add_special_tokens=False).ids, 1]
    mine = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    assert [r.length for r in mine] == [min(4096, len(ids) - k) for k in range(0, len(ids), 4096)]
    assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine]
    assert packing.pack(packing.pieces(empty, TOKENIZER)).count() == 0


def check_sequences(rows, capacity):
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing_is_tight_and_groups_are_even(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice([rng.randint(1, 100), rng.randint(1, 4096)])) for i in range(3000)]  # one hot key
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for size in (3000, 700):
        got = packing.pack(df, group_rows=size).collect()
        check_sequences(got, 4096)
        assert len({r.sequence_id for r in got}) <= 1.03 * sum(r[2] for r in rows) / 4096 + 5
        assert sorted((r.piece, r.length) for r in got) == sorted((r[1], r[2]) for r in rows)


def test_sum_of_squares_is_greedy():
    rng, capacity = np.random.default_rng(3), 20
    lengths = rng.integers(1, capacity + 1, 300)
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    level: dict[int, int] = {}
    for s, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        assert level.get(b, 0) == at and at + s <= capacity
        cost = lambda lv: sum(c * c for c in np.bincount([x for x in lv if 0 < x < capacity], minlength=1))
        choices = [cost([*level.values(), s])] + [cost([*(v for k, v in level.items() if k != o), level[o] + s]) for o in level if level[o] + s <= capacity and level[o] < capacity]
        level[b] = at + s
        assert cost(level.values()) == min(choices)


# toxicity and quality


def test_toxicity_learns_words(spark, edges, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + (" vile" if i % 4 == 0 else "")) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, only=F.col("doc_id") % 3 != 0)
    assert len(model.at) < 2000
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [i for i in range(0, 1200, 3)]
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert toxicity.fit(df, labels, only=F.col("doc_id") % 3 != 0).weight.tolist() == model.weight.tolist()
    scored = toxicity.score(edges, model).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip()}) == 1
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(df, labels.where("false"))
    assert {r.score for r in toxicity.score(df, blank).collect()} == {0.5}


def brute_statistics(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)]


def test_quality_statistics(texts):
    odd = [t for _, t, *_ in EDGES if t != LONG] + ["a b c d e f a b c d e", "x " * 9, "x y\x1cz\x0bq", "#|<> \n#|<>\n\n \n"]
    for text in [*list(texts.values())[:120], *odd]:
        if len(text or "") < 6000:
            assert quality.statistics(text)[0] == brute_statistics(text)


def test_trees_keep_their_order():
    rng = np.random.default_rng(5)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * rng.random(2000) < 0.6).astype(float)
    trees = quality.boost(x, y, [-1, 0, 1], trees=30)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    for j, sign in ((0, -1), (2, 1)):
        line = np.repeat(x[:50], 40, 0)
        line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.score(line).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert quality.boost(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_edges(spark, edges, empty, docs):
    trees = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = quality.judge(edges, trees).collect()
    assert len(got) == len(EDGES) and all(r.base_failed and not r.kept for r in got if not (r.text or "").split())
    assert quality.judge(empty, trees).count() == 0


# near-duplicates


def brute_components(prints, distance):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def brute_fingerprint(text, shingle=4):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("compared", [2048, 3])
def test_simhash_equals_brute_force(docs, texts, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = brute_components(prints, 4)
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == want


@pytest.mark.parametrize("compared", [2048, 4])
def test_links_of_close_fingerprints(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(150):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        if x not in prints.values():
            prints[i] = x
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()], "_node long, _fp long")
    found = graph.components(simhash.links(df), "a", "b").collect()
    root = {r.node: r.root for r in found}
    assert {k: root.get(k, k) for k in prints} == brute_components(prints, 4)


def test_simhash_edges(edges, empty):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert len({c for (d, f), c in by.items() if d in (1, 5)}) == 1
    assert simhash.near_duplicates(empty).count() == 0
    stays = simhash.one_of_each(edges)
    assert sorted(r.doc_id for r in stays.where("doc_id is not null").collect()) == [1, 2, 4, 7, 8]
    assert stays.where("doc_id is null").count() == 2 and stays.columns == edges.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (300, 299)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)} | {300: 299}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# lines


def brute_removed(rows):
    """Exact groups only."""
    seen, gone = set(), set()
    for doc_id, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            norm = " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in line.lower()).split())
            if len(norm.split()) >= 5:
                if norm in seen:
                    gone.add((doc_id, i))
                seen.add(norm)
    return gone


def test_line_dedup_equals_brute_force_on_exact_lines(spark):
    rng = random.Random(6)
    lines = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**9)}" for _ in range(rng.randint(2, 12))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(["", ".", " !"]) for _ in range(6))) for i in range(60)]
    got = {(r.doc_id, r.line) for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


def test_fuzzy_lines(spark, monkeypatch):
    base = " ".join(f"passage{i}" for i in range(120))
    family = [(i, base.replace("passage7 ", f"changed{i} ")) for i in range(12)]
    other = [(50 + i, " ".join(f"other{i}x{k}" for k in range(30))) for i in range(12)]
    df = spark.createDataFrame(family + other + [(90, LONG), (91, LONG + " tail")], "doc_id long, text string")
    for compared, rows in ((64, 100), (2, 0)):
        monkeypatch.setattr(linededup, "COMPARED", compared)
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", rows)
        removed = linededup.removed_lines(df)
        assert sorted(r.doc_id for r in removed.collect()) == [*range(1, 12), 91]
        assert {r.kept_doc_id for r in removed.collect()} == {0, 90}


def test_lines_with_changed_words_are_found(spark):
    """One word in eight, and short words only: the fingerprints of such lines are far apart or there are none."""
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(low, high)))
    rows = []
    for i in range(200):
        words = [word(*((5, 8) if i % 2 else (2, 4))) for _ in range(rng.randint(8, 40))]
        rows.append((i, " ".join(words)))
        for at in range(3, len(words), 8):
            words[at] = word(len(words[at]), len(words[at]))
        rows.append((1000 + i, " ".join(words)))
    gone = {r.doc_id for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone & set(range(1000, 1200))) >= 198 and not gone & set(range(200))


def test_lines_of_crowded_keys_are_all_compared(spark, monkeypatch):
    """All lines have one fingerprint and one phrase, and most are unlike; each has one partner."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=4)) for _ in range(900)]
    rows = []
    for i in range(30):
        line = ["encyclopaedias", "of", "the", *rng.sample(words, 12)]
        rows += [(i, " ".join(line)), (100 + i, " ".join([*line[:8], "new", *line[9:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linededup, "COMPARED", 4)
    assert sorted(r.doc_id for r in linededup.removed_lines(df).collect()) == [*range(100, 130)]


def test_edit_similarity(spark):
    pairs = [("abcde", "abcdx", True), ("abcde", "abxyz", False), ("a" * 5000, "a" * 4500 + "b" * 400, True), ("a" * 5000, "b" * 5000, False), ("a" * 2500, "a" * 1000, False)]
    df = spark.createDataFrame(pairs, "x string, y string, want boolean").select("want", linededup.similar("x", "y", 0.8).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_edit_similarity_of_repetitive_lines(spark):
    """Lines that repeat their words, with words put in, left out and changed: the same verdict as the distance's."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows = []
    for i in range(300):
        few = [word() for _ in range(rng.choice([2, 5, 500]))]
        line = [few[k % len(few)] if i % 2 else rng.choice(few) for k in range(rng.randint(60, 160))]
        other, rate = [], rng.uniform(0.03, 0.12)
        for w in line:
            kind = rng.random()
            other += [] if kind < rate else [word()] if kind < 2 * rate else [w, word()] if kind < 3 * rate else [w]
        rows.append((" ".join(line), " ".join(other)))
    apart = "levenshtein(x, y) <= floor(0.2 * greatest(length(x), length(y)) + 1e-9)"
    got = spark.createDataFrame(rows, "x string, y string").select(linededup.similar("x", "y", 0.8).alias("got"), F.expr(apart).alias("want")).collect()
    assert all(r.got == r.want for r in got) and 50 < sum(r.want for r in got) < 250


def test_lines_of_one_template(spark):
    """Two hundred lines of the same twelve words and an id; ids differ in one letter in pairs, else altogether."""
    rng = random.Random(14)
    template = " ".join(f"template{c}" for c in "abcdefghijkl")
    rows = []
    for i in range(100):
        name = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=50))
        at = rng.randrange(50)
        rows += [(i, f"{template} {name}"), (1000 + i, f"{template} {name[:at]}{'#' if name[at] == 'z' else chr(ord(name[at]) + 1)}{name[at + 1 :]}".replace("#", "a"))]
    gone = [(r.doc_id, r.kept_doc_id) for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(gone) == [(1000 + i, i) for i in range(100)]


def test_no_pair_of_a_crowded_block_is_left_out(spark):
    """Pairs of lines that share one phrase and nothing else that another line has not too, among two hundred others that have it."""
    rng = random.Random(15)
    phrase, rows = "encyclopaedias notwithstanding", []
    for i in range(100):
        words = ["".join(rng.choices("abcdefghijklmnopqrst", k=7)) for _ in range(5)]
        changed = [w[:3] + ("u" if w[3] != "u" else "v") + w[4:] for w in words]
        rows += [(i, " ".join([phrase, *words])), (1000 + i, " ".join([phrase, *changed]))]
    gone = [(r.doc_id, r.kept_doc_id) for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(gone) == [(1000 + i, i) for i in range(100)]


def test_line_edges(edges, empty, spark):
    removed = linededup.removed_lines(edges)
    assert sorted((r.doc_id, r.line) for r in removed.collect()) == [(1, 0), (5, 0), (5, 0)]  # the null doc_id comes first
    out = linededup.without(edges, removed)
    assert out.columns == edges.columns and out.count() == len(EDGES)
    by = {r.doc_id: r for r in out.collect()}
    assert (by[1].text, by[1].n_chars, by[2].text, by[4].text) == ("", 0, None, LONG)
    assert linededup.removed_lines(empty).count() == 0


# passages


def test_shared_passages_catch_runs_of_51_words(spark, docs, texts):
    found = passages.shared_passages(docs).collect()
    hit = {r.doc_id for r in found} | {r.source_doc_id for r in found}
    holders: dict[tuple, set] = {}
    for k, text in texts.items():
        words = text.encode().lower().split()
        for i in range(len(words) - 50):
            holders.setdefault(tuple(words[i : i + 51]), set()).add(k)
    must = set().union(*(s for s in holders.values() if len(s) > 1))
    assert must <= hit
    for r in found:
        a, b = (texts[d].encode().translate(passages._FOLD).split() for d in (r.doc_id, r.source_doc_id))
        a, b = a[r.start_word :][: r.n_words], b[r.source_start_word :][: r.source_n_words]
        assert len(a) == r.n_words >= 40 and len(b) == r.source_n_words >= 40 and r.identity >= 0.8


def test_passage_in_strange_texts(spark, edges, empty):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passage = fresh(60)
    fuzzy = [w if (i + 10) % 30 else "changed" for i, w in enumerate(passage)]
    rows = [(i, " ".join([*fresh(80), *(passage if i % 2 else fuzzy), *fresh(50)])) for i in range(8)] + [(100 + i, " ".join(fresh(200))) for i in range(5)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} | {r.source_doc_id for r in found} == set(range(8)) and len(found) == 7
    assert all(abs(r.start_word - 80) <= 2 and 55 <= r.n_words <= 64 for r in found)
    assert passages.shared_passages(edges).count() == 0 and passages.shared_passages(empty).count() == 0


def test_chains_are_collinear_and_best():
    query, source = np.array([0, 8, 16, 24, 9, 300]), np.array([50, 58, 66, 74, 5, 52])
    found = list(passages.chains(query, source))
    assert [f.tolist() for f in found] == [[0, 1, 2, 3]]


# media


def test_media_round_trip(spark, edges, empty):
    stored = media.store(edges)
    got = media.analyse(stored).collect()
    assert len(got) == len(EDGES)
    for r in got:
        text = next((t or "").encode() for d, t, *_ in EDGES if d == r.doc_id and len((t or "").encode()) == r.n_bytes)
        assert r.payload[: r.n_bytes] == text and set(r.payload[r.n_bytes :]) <= {255}
        assert len(r.payload) % 576 == 0 and len(r.payload) > 0 and media.from_wav(bytes(r.media)) == (8000, bytes(r.payload))
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert table.schema.field("log_mel").type.shape == [media.SPAN_FRAMES, media.BANDS] and table.num_rows == len(r.spans)
        assert sum(s.frames for s in r.spans) == r.n_frames
        assert [s.start_s for s in r.spans] == table["start_s"].to_pylist()
    same = [hashlib.md5(bytes(r.tensors)).hexdigest() for r in got if r.doc_id in (1, 5)]
    assert len(set(same)) == 1
    assert media.analyse(media.store(empty)).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = media.resample(np.sin(2 * np.pi * 440 * t), 8000, 6000)
    assert len(y) == 6000
    inner = y[100:-100]
    spectrum = np.abs(np.fft.rfft(inner * np.hanning(len(inner))))
    assert abs(spectrum.argmax() * 6000 / len(inner) - 440) < 2
    assert abs(float(np.sqrt((inner**2).mean())) - 0.5**0.5) < 0.01
    aliased = media.resample(np.sin(2 * np.pi * 3700 * t), 8000, 6000)  # above half the new rate
    assert float(np.abs(aliased[100:-100]).max()) < 0.1


def test_hysteresis():
    energy = np.array([0, 0, 3, 1, 1, 3, -3, 1, 1, -3, 3.0])
    assert media.segments(energy) == [(2, 6), (10, 11)]
    assert media.segments(np.ones(5)) == []


# pipeline


def test_pipeline_stages(spark, edges, empty):
    for table in (edges.drop("score", "size", "target", "shard", "kept"), empty):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == table.columns, name
            rows = rows.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).where("piece = 0").count() == rows.count()


def test_pipeline_equals_its_stages(spark, docs):
    kept = docs.where(F.col("doc_id") >= 0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept.collect())
    packed = corpus_pipeline.run(spark, SF).collect()
    check_sequences(packed, 4096)
    lengths = sorted((r.doc_id, r.length) for r in packed)
    assert sum(n for _, n in lengths) == sum(n for _, n in want)
    assert {d for d, _ in lengths} == {d for d, _ in want}


# faults that were mended


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_recall_of_similar_lines_against_brute_force(spark):
    """Lines of 5 to 40 words with words changed, left out or put in: nine in ten pairs of 0.8 or more are connected, and none
    of less are linked."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9)))
    rows, true = [], 0
    for i in range(120):
        a = [word() for _ in range(rng.randint(5, 40))]
        b = list(a)
        for _ in range(max(1, round(len(a) * rng.choice((0.05, 0.1, 0.15))))):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice(([word()], [], [b[at], word()]))
        a, b = " ".join(a), " ".join(b)
        if len(b.split()) < 5 or a == b:
            continue
        rows += [(i, a), (1000 + i, b)]
        true += _distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    text = dict(rows)
    removed = linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.kept_doc_id, r.doc_id) for r in removed}
    assert all(b == a + 1000 and _distance(text[a], text[b]) <= int(0.2 * max(len(text[a]), len(text[b])) + 1e-9) for a, b in pairs)
    assert len(pairs) >= 0.9 * true > 80


def test_two_families_of_one_vocabulary(spark):
    """Lines that share long words, block for block, are linked within their families whatever the size of the block."""
    rng = random.Random(22)
    word = lambda low, high: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(low, high)))
    long_words = [word(8, 10) for _ in range(12)]
    bases = [[w for x in long_words for w in (x, *(word(2, 4) for _ in range(4)))] for _ in range(2)]
    rows = [(1000 * f + i, " ".join([*base, word(2, 4), word(2, 4)])) for f, base in enumerate(bases) for i in range(70)]
    gone = [r.doc_id for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(gone) == [*range(1, 70), *range(1001, 1070)]


def test_text_put_in_front_of_a_long_line(spark):
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=8)) for _ in range(1300)]
    rows = [(1, " ".join(words[90:])), (2, " ".join(words))]
    assert [r.doc_id for r in linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [2]


def test_packing_keeps_null_and_large_ids(spark):
    big = 2**60
    parts = spark.createDataFrame([(None, 0, 5, "x"), (big + 1, 0, 4, "y"), (big + 3, 0, 4000, "z")], "doc_id long, piece int, length long, offset string")
    out = packing.pack(parts)
    assert out.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert {(r.doc_id, r.length) for r in out.collect()} == {(None, 5), (big + 1, 4), (big + 3, 4000)}


def test_near_dedup_decides_by_row(spark):
    t1, t2 = "one two three four five six seven eight nine", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(1, t2), (5, t2), (5, t1), (None, t2), (5, t1)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, t2), (1, t2), (5, t1)]


def test_null_is_no_id_for_passages(spark):
    text = " ".join(f"w{i}" for i in range(80))
    assert passages.shared_passages(spark.createDataFrame([(None, text), (-1, text)], "doc_id long, text string")).count() == 1


def test_stored_tensors_give_the_means(spark):
    found = media.analyse(media.store(spark.createDataFrame([(1, "tone " * 900), (2, None)], "doc_id long, text string")))
    for r in media.read_bands(found).collect():
        assert r.shape == f"{media.SPAN_FRAMES}x{media.BANDS}" and r.n_tensors == len(r.spans)
        assert max(abs(a - b) for a, b in zip(r.means, r.bands, strict=True)) < 1e-3


def test_toxicity_features_and_steps_equal_plain_ones():
    text, mask = "You, SILLY silly goose", (1 << 64) - 1
    words = ["you", "silly", "silly", "goose"]
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    want = [x * 0x9E3779B97F4A7C15 & mask for x in h]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        want += [((a * odd & mask) ^ ((b >> 29) + b & mask)) * 0x9E3779B97F4A7C15 & mask for a, b in zip(h, h[gap:])]
    got = toxicity.Features(20).of([text])[0].tolist()
    assert sorted(got) == sorted(x >> 44 for x in want)

    model, z, n, b = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2), [0.0] * 4, [0.0] * 4, [0.0, 0.0]
    weight = lambda i: 0.0 if abs(z[i]) <= 0.1 else -(z[i] - (0.1 if z[i] > 0 else -0.1)) / ((1 + n[i] ** 0.5) / 0.5 + 0.2)
    for at, label in (([0, 1], 1), ([1, 2], 0), ([0, 3], 1), ([0, 1, 2, 3], 0)) * 3:
        w, bias = {i: weight(i) for i in at}, -b[0] / ((1 + b[1] ** 0.5) / 0.5)
        g = 1 / (1 + math.exp(-sum(w.values()) - bias)) - label
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
            n[i] += g * g
        b = [b[0] + g - ((b[1] + g * g) ** 0.5 - b[1] ** 0.5) / 0.5 * bias, b[1] + g * g]
        model.learn(np.array(at), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose([model.bias_z, model.bias_n], b)


def test_recall_of_fuzzy_passages(spark):
    """Passages of 45 to 100 words with words changed, of which 0.8 or more are equal, in unlike surroundings."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(20000)]
    draw = lambda n: rng.choices(vocabulary, k=n)
    rows, planted = [], {0.0: set(), 0.05: set(), 0.1: set()}
    for share in planted:
        for n in (45, 60, 100):
            for _ in range(40):
                mine, i = draw(n), len(rows)
                other = [rng.choice(vocabulary) if rng.random() < share else w for w in mine]
                if sum(x == y for x, y in zip(mine, other, strict=True)) >= 0.8 * n:
                    planted[share].add((i, i + 1))
                    rows += [(i, " ".join(draw(80) + mine + draw(80))), (i + 1, " ".join(draw(33) + other + draw(50)))]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(min(r.doc_id, r.source_doc_id), max(r.doc_id, r.source_doc_id)) for r in found}
    recall = {share: len(found & pairs) / len(pairs) for share, pairs in planted.items()}
    assert recall[0.0] == 1 and recall[0.05] >= 0.9 and recall[0.1] >= 0.7, recall
    assert found <= set().union(*planted.values())


@pytest.mark.parametrize("decoys", [0, 9, 30])
def test_passages_whose_parts_others_hold(spark, decoys):
    """Pairs that share sixty words, and others that hold 22 of these; who holds the parts does not matter."""
    rng = random.Random(31)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, n = [], 30
    for i in range(n):
        passage = some(60)
        rows += [(i, some(30) + passage + some(20)), (100 + i, some(10) + passage + some(45))]
        for k in range(decoys):
            at = rng.randrange(39)
            rows.append((1000 + 40 * i + k, some(40) + passage[at : at + 22] + some(40)))
    found = passages.shared_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    pairs = {(min(r.doc_id, r.source_doc_id), max(r.doc_id, r.source_doc_id)) for r in found}
    assert pairs == {(i, 100 + i) for i in range(n)}
