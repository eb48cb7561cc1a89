"""Words of reads with their surroundings, and their numbers, against plain versions."""

import random
from collections import Counter

import pytest

from splicelake.operators import sequences as Q


def reads_of(spark, seqs):
    return spark.createDataFrame([(x,) for x in seqs], "seq string").repartition(3)


def some_reads():
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGTN", k=rng.choice([0, 1, 9, 10, 11, 12, 18, 40, 120]))) for _ in range(150)]
    return [*seqs, *seqs[:30], *(x[5:70] for x in seqs), "A" * 300, "AC" * 100, None]


@pytest.mark.parametrize("reach", [4, 14])
def test_extended_words(spark, reach):
    seqs = some_reads()
    got = sorted(map(tuple, Q.extended(reads_of(spark, seqs), 10, reach).select("kmer", "left_ext", "right_ext").collect()))
    want = {(x[i : i + 10], x[max(i - reach, 0) : i], x[i + 10 : i + 10 + reach]) for x in seqs if x for i in range(len(x) - 9)}
    assert got == sorted(want) and len(want) > 2000


def test_extended_words_are_not_shuffled_one_by_one(spark):
    df = Q.extended(reads_of(spark, some_reads()), 10, 14)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [x for x in lines if "hashpartitioning" in x]
    assert len(dealt) == 1 and "_part" in dealt[0] and "kmer" not in dealt[0]


def test_kmer_counts(spark):
    seqs = some_reads()
    got = {r.kmer: r.n for r in Q.kmer_counts(reads_of(spark, seqs), 10).collect()}
    assert got == Counter(x[i : i + 10] for x in seqs if x for i in range(len(x) - 9))
    with pytest.raises(Exception, match="letters other than"):
        Q.kmer_counts(reads_of(spark, ["ACGTACGTACGx"]), 10).collect()
