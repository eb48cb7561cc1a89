"""Places of k-mers with several mismatches, and the k-mers that the queries look for."""

import random

import pytest

from splicelake import queries
from splicelake.operators import discovery as D


def off(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("size", "mismatches", "exact"), [(23, 3, 4), (23, 3, 3), (20, 1, 3), (12, 0, 3)])
def test_equals_brute_force(spark, size, mismatches, exact):
    rng = random.Random(size)
    text = "".join(rng.choices("ACGTN", k=400))
    genome = {"a": text, "b": text[50:200] + "ACGT" * 30, "c": "AC", "d": "A" * 200}
    kmers = [None, "ACG", "A" * size, ("ACGT" * size)[:size]]
    for _ in range(120):
        at = rng.randrange(len(text) - size)
        word = [*text[at : at + size]]
        for i in rng.sample(range(size), rng.randint(0, mismatches + 1)):
            word[i] = rng.choice("ACGT")
        kmers.append("".join(word))
    want = []
    for k in {k for k in kmers if k and len(k) == size}:
        near = [(k, c, i, off(k, s[i : i + size])) for c, s in genome.items() for i in range(len(s) - size + 1) if off(k, s[i : i + size]) <= mismatches]
        want += near if len(near) <= 60 else []
    got = D.kmer_map(spark.createDataFrame([(k,) for k in kmers], "kmer string"), spark.createDataFrame([*genome.items()], "contig string, seq string"), size=size, mismatches=mismatches, exact=exact, most=60)
    assert sorted(map(tuple, got.select("kmer", "contig", "at", "errors").collect())) == sorted(want)
    assert any(k == kmers[3] for k, *_ in want) and not any(k == kmers[2] for k, *_ in want)


def test_queries_look_for_all_of_reads_and_contigs(spark, tmp_path):
    rng = random.Random(5)
    html = "".join(rng.choices("acgt", k=900))
    spark.createDataFrame([(0, html[700:760] + html[300:340])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    at = {r.at for r in queries.QUERIES["kmer_map"](spark, str(tmp_path)).where("errors = 0").collect()}
    assert {700, 720, 740, 300, 320} <= at
    assert {20 * k for k in range(45)} <= {r.at for r in queries.QUERIES["kmer_map"](spark, str(tmp_path)).collect()}
    found = queries.QUERIES["fp_kmer_map"](spark, str(tmp_path)).collect()
    assert len(found) >= 2 and {len(r.kmer) for r in found} == {23} and {r.errors for r in found} <= {0, 1, 2, 3}
