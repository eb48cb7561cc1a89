"""Nearest neighbours, spelling variants and ranked search against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicelake.llm import lexical, onebit, spelling

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum " * 9_000 + "abcdefghij" * 300
TEXTS = [
    (1, "Grüße colour colours color COLOUR"), (2, None), (3, ""), (None, "colour colours"), (4, LONG), (5, "colour colours"), (5, "colour colours"), (6, " \n\t "), (None, None), (7, "Дом 日本 ÷×÷×÷×÷ don't"),
]


def with_others(df):
    """Columns whose names the operators use."""
    return df.withColumns({"n": F.lit("x"), "word": F.lit(1), "m": F.lit("m"), "score": F.lit(2), "name": F.lit("q"), "first": F.lit(None).cast("string"), "rank": F.lit(0)})


# nearest neighbours


def plain_neighbours(rows, asked, k):
    """(query, rank, id, score) over rows of (id, vector), all distinct ids."""
    out = []
    for i, q in rows:
        if i in asked:
            q = np.array(q, float)
            scored = [(-(np.dot(q, v) / (math.sqrt(np.dot(q, q)) * math.sqrt(np.dot(v, v)))), j) for j, v in ((j, np.array(v, float)) for j, v in rows if j != i)]
            out += [(i, r + 1, j) for r, (_, j) in enumerate(sorted((round(s, 12), j) for s, j in scored)[:k])]
    return out


def test_neighbours_equal_brute_force(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = onebit.neighbours(vectors, F.col("vec_id") % 10 == 0).collect()
    want = set(plain_neighbours(rows, {i for i, _ in rows if i % 10 == 0}, 5))
    assert len(got) == len(want) and len({(r.query_id, r.rank, r.vec_id) for r in got} & want) >= 0.97 * len(want)
    of = {i: np.array(v, float) for i, v in rows}
    for r in got:
        a, b = of[r.query_id], of[r.vec_id]
        assert abs(r.score - np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))) < 1e-12


def test_neighbours_of_copies_and_near_copies(spark):
    """Forty equal vectors, forty that are nearly equal, and others in other directions."""
    rng = np.random.default_rng(5)
    base, near = rng.standard_normal(24), rng.standard_normal(24)
    rows = [(i, base.tolist()) for i in range(40)] + [(40 + i, (near + 1e-3 * rng.standard_normal(24)).tolist()) for i in range(40)] + [(80 + i, rng.standard_normal(24).tolist()) for i in range(60)]
    got = onebit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, bits=256).collect()
    by = {(r.query_id, r.rank): r.vec_id for r in got}
    assert [by[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [by[7, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    want = plain_neighbours(rows, {i for i in range(140) if i % 7 == 0}, 5)
    assert sum(by.get((q, k)) == v for q, k, v in want) >= 0.97 * len(want)


def test_neighbours_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [inf, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1e-200, 1e-200]), (8, [1e200, 0.0]), (9, [1.0, 2.0, 3.0]), (8, [1e200, 0.0])]
    vectors = with_others(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.rank, r.vec_id): r.score for r in onebit.neighbours(vectors, F.col("vec_id") == 8).collect()}
    assert set(got) == {(8, 1, 0), (8, 2, 7), (8, 3, 0)} and math.isclose(got[8, 1, 0], 1) and math.isclose(got[8, 2, 7], math.sqrt(0.5)) and got[8, 3, 0] == 0
    assert onebit.neighbours(vectors.limit(0), F.col("vec_id") == 8).count() == 0
    assert onebit.neighbours(vectors, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 32)), onebit.unit(rng.standard_normal((50, 32)))
    middle, turn = onebit.centres(onebit.unit(x[:500]), 8), onebit.rotation(32, 128)
    own, packed, shift, scale, slack = onebit.encode(x, middle, turn)
    signs = np.unpackbits(packed, axis=1) * 2.0 - 1
    estimate = (q @ turn.T) @ signs.T / math.sqrt(128) * scale + shift + (q @ middle.T)[:, own]
    apart = np.sqrt(((q[:, None] - middle[own][None]) ** 2).sum(2))
    assert (np.abs(estimate - q @ onebit.unit(x).T) <= apart * slack).mean() > 0.99


# spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, min_length=7, min_count=2, ratio=10):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v and counts[v] >= ratio * counts[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), form[w] or "", counts[form[w]] if form[w] else -1, root(w)) for w, n in counts.items())


def told(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abcé"
    base = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(25)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = base[min(int(rng.expovariate(0.3)), 24)]
            if rng.random() < 0.3:
                at, kind = rng.randrange(len(w)), rng.random()
                w = w[:at] + (w[at + 1 :] if kind < 0.4 else rng.choice(letters) + w[at + (kind < 0.7) :])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(words)))
    want = plain_variants(docs, min_length=7)
    assert len(want) > 100 and any(w[5] != w[0] for w in want)
    assert told(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_variants_of_repeated_letters_and_chains(spark):
    """Runs of one letter, edits at both ends, and forms of forms."""
    words = {"aaaaaaa": 1000, "aaaaaaaa": 90, "aaaaaaaaa": 8, "baaaaaaaa": 2, "aaaaaaab": 3, "zzzzzzzz": 2, "zzzzzzzy": 2}
    docs = [(i, w) for i, (w, n) in enumerate((w, n) for w, n in words.items() for _ in range(n))]
    assert told(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == plain_variants(docs)


def test_variants_edges(spark):
    docs = with_others(spark.createDataFrame(TEXTS * 3, "doc_id long, text string"))
    assert told(spelling.variants(docs)) == plain_variants(TEXTS * 3)
    assert spelling.variants(docs.limit(0)).count() == 0


# ranked search


def plain_search(docs, items, top):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(d, words(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    counts = [(d, len(w), Counter(w)) for d, w in held]
    df = Counter(t for _, _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, n, c in counts:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(str(i), r + 1, "None" if no else str(d), -s) for r, (s, no, d) in enumerate(sorted(found)[:top])]
    return sorted(out)


def listed(df):
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in df.collect())


@pytest.mark.parametrize("block_terms", [10, 1 << 18])
def test_search_equals_brute_force(spark, block_terms):
    rng = random.Random(8)
    text = lambda n: " ".join(f"W{min(int(rng.expovariate(0.08)), 60)}é"[: rng.choice([3, 9])] for _ in range(rng.randint(0, n)))
    docs = [(i, text(40)) for i in range(150)] + [(200 + i, "same words here w1 w2 w3") for i in range(90)] + TEXTS
    items = [(i, text(25)) for i in range(12)] + [(50, "w1 same colour"), (None, "日本 don"), (51, None), (52, ""), (3, "here")]
    got = lexical.search(with_others(spark.createDataFrame(docs, "doc_id long, text string")), with_others(spark.createDataFrame(items, "item_id long, text string")), top=7, block_terms=block_terms)
    assert listed(got) == plain_search(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
