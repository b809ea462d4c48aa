"""Spelling variants by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. An
inserted or deleted letter flips one bit and a replaced one two, so of three bands of the mask
one at least stays as it is: words one edit apart are met where a band is equal and lengths
differ by one at most, and the edit distance confirms them. An edit also leaves the first or
the last half of the shorter word alone; that half is part of the join's key, which divides a
band's bucket (there are only so many values of a band) without losing a pair.

Words come from the texts with a known corruption: of a run whose hash with the document's id
97 divides, one letter is left out. Occurrences are summed in each task before they are
shuffled. A word's form is its most frequent near word, if that is at least twice as frequent;
frequencies double along forms, so there are no cycles, and pointer doubling finds the last.

Defined cases: null and empty texts have no runs; a null doc_id counts as an empty one; a very
long text is cut into runs by one task, and a very long run is a word like any other; repeated
rows count again; of equally frequent forms the one least in code points holds; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, hubs, join_split, materialise, stored

#: One run in CORRUPT, by its hash, loses a letter. Words have LEAST code points and MIN_COUNT occurrences.
CORRUPT, LEAST, MIN_COUNT = 97, 5, 3
BANDS = 3
#: Distinct results that a task sums up before it passes them on.
HELD = 200_000

#: Latin-1 bytes: a letter as it is, A-Z in lower case, anything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The lower-cased runs of a text, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def _count(found: Counter, doc_id: object, text: str | None) -> None:
    """Adds a document's results to found."""
    words = runs(text)
    found.update(words)
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word in set(words):
        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % CORRUPT == 0:
            at, n = h % len(word), words.count(word)
            found[word] -= n
            found[word[:at] + word[at + 1 :]] += n


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: every distinct result and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed_on() -> pa.RecordBatch:
            kept = {w: n for w, n in found.items() if n}
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                _count(found, doc_id, x.as_py())
                if len(found) >= HELD:
                    yield passed_on()
                    found = Counter()
        yield passed_on()

    return docs.select(id_col, text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parity(word: Column, band: int) -> Column:
    """The bits of the letters that belong to a band, dealt out in turn: a to z, then U+00C0 to U+00FF."""

    def flipped(mask: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        nth = F.when(code < 0xC0, code - 97).otherwise(code - 0xC0 + 26)
        return F.when(nth % BANDS == band, mask.bitwiseXOR(F.pow(F.lit(2.0), F.floor(nth / BANDS)).cast("long"))).otherwise(mask)

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(flipped(m, c)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: each pair of distinct words (word) that differ by one edit, once."""
    masked = words.select("word", F.length("word").alias("len"), *[parity(F.col("word"), b).alias(f"band_{b}") for b in range(BANDS)])

    def keyed(shorter: Column, role: str) -> DataFrame:
        """A row for each band and half, for a word that an edit leads to `shorter` letters or one of as many."""
        half = F.expr("len div 2") if role == "same" else F.expr("(len - 1) div 2")
        halves = F.array(F.substr("word", F.lit(1), half), F.substr("word", F.col("len") - (shorter - half) + 1, shorter - half))
        keys = F.array(*[F.xxhash64(F.lit(b), F.col(f"band_{b}"), shorter, F.lit(side), halves[side]) for b in range(BANDS) for side in (0, 1)])
        return masked.select(F.explode(keys).alias("key"), "word", F.lit(role).alias("role"))

    same = keyed(F.col("len"), "same")
    left = same.select("key", F.col("word").alias("a"))
    right = same.union(keyed(F.col("len") - 1, "longer")).select("key", F.col("word").alias("b"), "role")
    met = left.join(right, "key").where((F.col("role") == "longer") | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    words = stored(occurrences(docs, id_col, text).where((F.length("word") >= LEAST) & (F.col("n") >= MIN_COUNT)))
    pairs = stored(near_pairs(words))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = join_split(both.withColumnRenamed("b", "word"), words.withColumnRenamed("n", "near_n"), "word", "a", hubs(both.withColumnRenamed("b", "word"), "word"))
    # the most frequent one, then the least in code points
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("word").alias("near")))
    near = named.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    holds = -F.col("best.down") >= 2 * F.col("n")
    rows = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.down")).alias("form_n")))
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """word, root for each word that has a form: rounds of looking up the form's own form."""
    (jump,) = fresh(links, "jump")
    at = links.select("word", F.col("form").alias("root"))
    while True:
        at = materialise(at)
        step = at.select(F.col("word").alias("root"), F.col("root").alias(jump))
        on = join_split(at, step, "root", "word", hubs(at, "root"), "left")
        moved = materialise(on.select("word", F.coalesce(jump, "root").alias("root"), F.col(jump).isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at
