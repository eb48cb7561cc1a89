"""Spelling variants: words one edit apart, found by walking a trie that is a distributed table of edges."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import checkpointed, written
from splicelake.llm.graph import fresh

#: Code points and occurrences that a word needs; how many times as frequent as a word its form must be.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many, by hash, loses a code point before it is counted.
THINNED = 31
#: Words that a task counts before it hands them on.
COUNTED = 400_000
#: Marks the end of a word; no word holds it.
END = " "
#: Latin-1 letters (and the signs among them), A-Z lower-cased; a space for the rest.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def counted(doc_id: int | None, text: str | None, *, min_length: int = MIN_LENGTH, thinned: int = THINNED) -> Iterator[tuple[bytes, int]]:
    """The words of a document, as Latin-1 bytes, and how often it holds them.

    A run's hash is the crc32 of ``<doc_id>:<run>`` in UTF-8; where ``thinned`` divides it, the code point at the hash
    modulo the run's length is left out.
    """
    seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in Counter((text or "").encode("latin-1", "replace").translate(_FOLD).split()).items():
        if len(run) < min_length:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % thinned == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        yield run, n


def vocabulary(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, thinned: int = THINNED) -> DataFrame:
    """``word`` and ``n``, its occurrences in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in counted(doc_id, text, min_length=min_length, thinned=thinned):
                    total[word] += n
                if len(total) > COUNTED:
                    yield flushed()
        yield flushed()

    each = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _paths(words: DataFrame) -> DataFrame:
    """The lower half of each word's path in the trie of words, and in the trie of reversed words: one row for each place
    ``d`` there, with its ``node``, the next two letters and the nodes that these lead to. A node's name is a hash of the
    letters above it."""
    half = F.floor(F.length("word") / 2).cast("int")
    way = lambda n, text, since: F.struct(F.lit(n).alias("way"), F.concat(text, F.lit(END)).alias("text"), since.alias("since"))
    ways = F.array(way(0, F.col("word"), half), way(1, F.reverse("word"), F.length("word") - half))
    each = words.select("id", F.length("word").alias("len"), F.inline(ways))
    node = lambda d: F.xxhash64("way", F.substring(F.col("text"), F.lit(1), d))
    step = lambda d: F.struct(d.alias("d"), node(d).alias("node"), F.substring(F.col("text"), d + 1, F.lit(1)).alias("c"), F.substring(F.col("text"), d + 2, F.lit(1)).alias("c2"), node(d + 1).alias("child"), node(d + 2).alias("child2"))
    return each.select("id", "way", "len", F.inline(F.transform(F.sequence("since", "len"), step)))


def neighbours(words: DataFrame) -> DataFrame:
    """``a`` and ``b``: the ids of words that differ by one inserted, deleted or replaced code point, both ways round.

    ``words`` has ``id`` (long, unique), ``word`` (distinct). A walk's state is a word, its place there, a node of the trie
    and whether an edit was made. Until the edit a word follows its own path, so the walk starts with the edit: it deletes
    a letter or puts another one in its place (insertions are deletions of the longer word), in the second half of the
    word on the trie of words, in the first half on the trie of reversed words. Edits near the root, where nodes have many
    children, do not occur so. Then states join the edges at their node by the word's next letter, level by level, until
    none is left. A node that only one word passes leads to that word, so what is left of it is not walked; the distance
    of the words themselves decides.

    Nodes that a single word passes have no neighbours below and no states. A state has at most as many successors as
    the alphabet has letters, and levels are at most half the longest word.
    """
    paths = _paths(words)
    busy = paths.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(fresh("node").alias("node"))
    paths = written(paths.join(busy, "node", "left_semi"), "paths")
    below = [F.count(F.lit(1)).alias("words"), F.min("id").alias("only")]
    edges = paths.groupBy("node", F.col("c").alias("next"), "child").agg(*below)
    edges = checkpointed(edges.select(fresh("node").alias("node"), "next", "child", "words", "only"))
    # edges over any one letter to the next
    over = paths.where(F.col("d") < F.col("len")).groupBy("node", F.col("c").alias("passed"), F.col("c2").alias("next"), F.col("child2").alias("child")).agg(*below)
    over = over.select(fresh("node").alias("node"), "passed", "next", "child", "words", "only")

    begun = paths.where(F.col("d") < F.col("len")).select("id", "way", "node", "c", F.col("c2").alias("next"), (F.col("d") + 2).alias("at"))
    state = ["id", "way", "at", "child", "words", "only"]
    deleted = begun.where("c != next").join(edges, ["node", "next"]).select(*state)
    replaced = begun.join(over, ["node", "next"]).where("c != passed").select(*state)
    states = written(deleted.unionByName(replaced), "states")
    met = [states.where("words = 1").select("id", "only")]
    while True:
        going = states.where("words > 1").select("id", "way", "at", F.col("child").alias("node"))
        if going.isEmpty():
            break
        text = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
        letter = F.substring(F.concat(text, F.lit(END)), F.col("at") + 1, F.lit(1))
        going = going.join(words.select(fresh("id").alias("id"), "word"), "id").select("id", "way", (F.col("at") + 1).alias("at"), "node", letter.alias("next"))
        states = checkpointed(going.join(edges, ["node", "next"]).select(*state))
        met.append(states.where("words = 1").select("id", "only"))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.where("id != only").select(F.least("id", "only").alias("a"), F.greatest("id", "only").alias("b")).distinct()
    named = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"_{x}"))
    near = pairs.select(fresh("a").alias("a"), fresh("b").alias("b")).join(named("a"), "a").join(named("b"), "b").where(F.levenshtein("_a", "_b", 1) == 1)
    return checkpointed(near.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))


def _last(forms: DataFrame) -> DataFrame:
    """``id`` and ``root``: where following ``form`` from ``id`` ends. Each round doubles the steps taken."""
    held = checkpointed(forms.select("id", F.col("form").alias("root")))
    while True:
        onward = held.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        held = checkpointed(held.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if held.where("_moved").isEmpty():
            return held.select("id", "root")
        held = held.select("id", "root")


def variants(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, thinned: int = THINNED) -> DataFrame:
    """``word``, ``n``, ``n_near`` (words one edit apart), ``form`` and ``form_n`` (of these the most frequent, by code points
    the first of equal ones, where it is ``ratio`` times as frequent or more, else null) and ``root`` (where forms end).

    Words are runs of ASCII letters and of U+00C0 to U+00FF, A-Z lower-cased, of whole texts; one run in ``thinned``, by a
    hash of doc_id and run, loses a code point. They have ``min_length`` code points and ``min_count`` occurrences or more.

    Null and empty texts have no words. A null doc_id is written as nothing before the colon. Repeated rows count each.
    Words of any length are walked whole; naming the nodes takes time by the square of a word's length. Other columns are
    left out; an empty table gives an empty one.
    """
    words = vocabulary(docs, min_length=min_length, min_count=min_count, thinned=thinned)
    words = written(words.withColumn("id", F.monotonically_increasing_id()), "words")
    near = neighbours(words.select("id", "word"))
    met = near.select("a", fresh("b").alias("b")).join(words.select(F.col("id").alias("b"), F.col("n").alias("_n"), F.col("word").alias("_word")), "b")
    most = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_word").alias("word"), F.col("b").alias("id")))
    best = met.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), most.alias("_most")).select(fresh("a").alias("id"), "n_near", "_most")
    held = words.join(best, "id", "left")
    is_form: Column = -F.col("_most.n") >= ratio * F.col("n")
    held = checkpointed(held.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(is_form, F.col(f"_most.{x}")).alias(y) for x, y in (("id", "_form"), ("word", "form"), ("n", "_n")))))
    roots = _last(held.where("_form is not null").select("id", F.col("_form").alias("form")))
    roots = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    return held.join(roots, "id", "left").select("word", "n", "n_near", "form", (-F.col("_n")).alias("form_n"), F.coalesce("_root", "word").alias("root"))
