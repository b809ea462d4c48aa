"""Phrase collocations by hierarchical pair naming.

Texts are cut into blocks of about BLOCK words, each an array of positions. A frequent word has
an id; where two adjacent positions hold ids of frequent (k-1)-grams, that pair is a k-gram, and
the frequent pairs get ids in turn. A part of a frequent phrase is frequent, so nothing else is
ever looked at. The two ids that a phrase was named after are its parents: following them down
gives every part that a cut makes, and a phrase is subsumed if it is a parent of one that is
nearly as frequent (a longer phrase further up is no more frequent than the one between).

Only the distinct pairs of a block leave it, packed by bucket (a hash of the pair).
The entries of a bucket in all blocks meet once: counts are summed, rare pairs dropped and the rest
named, and the names go back to the blocks, which replace their positions. The number of buckets
grows with the texts, so a bucket doesn't; a pair that is everywhere has one entry for each
block. Nothing is broadcast but tables of a checked size.

Defined cases: a null text is empty, and a null lang is `und`; texts without words add nothing;
a very long text is spread over blocks, broken only between pieces, and a piece is whole; all
ties are broken; repeated rows count again; a language without phrases has no rows; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import hubs, join_split, materialise, small_or_not, stored

#: Phrases have 2 to LONGEST words and at least MIN_COUNT occurrences; TOP of each language are reported.
LONGEST, MIN_COUNT, TOP = 4, 30, 2000
#: A phrase goes if one that holds it has this share of its occurrences, in hundredths.
SUBSUMED = 80
#: A block is closed at the end of the piece with which it has so many words.
BLOCK = 500_000
#: There are BUCKETS buckets and one more for each BUCKET_BYTES of text.
BUCKETS, BUCKET_BYTES = 64, 32 << 20
#: A task numbers its blocks below TASK_BLOCKS; ids of a length of phrase are the bucket times
#: BUCKET_IDS and a number within it.
TASK_BLOCKS, BUCKET_IDS = 1 << 32, 1 << 36

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_MARKS = bytes.maketrans(_BREAKS, b"\xff" * len(_BREAKS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """A number for each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _pieces(text: bytes) -> list[bytes]:
    """The lower-cased words of a text; byte 255 stands between pieces."""
    return text.lower().translate(_MARKS).replace(b"\xff", b" \xff ").split()


def _bytes(values: np.ndarray | list[str]) -> bytes:
    """Numbers by the significance of their bytes, so that small ones compress to nothing; words by line."""
    if isinstance(values, list):
        return "\n".join(values).encode()
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers of each row."""
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel() for b in column.to_pylist()]


#: The columns that hold a row's numbers, and their types.
_KINDS = {"places": np.int32, "counts": np.int64, "ids": np.int64, "totals": np.int64, "lefts": np.int64, "rights": np.int64}


def _packed(block: int, codes: np.ndarray, bucket: np.ndarray, counts: np.ndarray, keys: dict, sums: np.ndarray = np.zeros(0, np.int64), own: dict = {}) -> pa.RecordBatch:  # noqa: B006, B008
    """The rows of a block: under bucket -1 its positions (with sums for counts, and keys of its own), then its entries by bucket."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    parts = np.split(order, starts[1:]) if len(found) else []
    columns = {"block": pa.array([block] * (len(found) + 1), pa.int64()), "bucket": pa.array([-1, *found], pa.int32())}
    columns["places"] = pa.array([_bytes(codes.astype(np.int32)), *[_bytes(p.astype(np.int32)) for p in parts]], pa.binary())
    columns["counts"] = pa.array([_bytes(sums), *[_bytes(counts[p].astype(np.int64)) for p in parts]], pa.binary())
    for name, values in keys.items():
        columns[name] = pa.array([_bytes(own.get(name, np.zeros(0, np.int64))), *[_bytes([values[i] for i in p] if isinstance(values, list) else values[p]) for p in parts]], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def word_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, places, counts, words. Under bucket -1 places has an entry's number for each
    position, and -1 between pieces, and words and counts are those of whole languages; else they
    are the numbers, words and counts of entries. A word is a language in JSON, a tab and the word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray]] = []
        tables: dict[str, _Codes] = {}
        size, block = 0, TaskContext.get().partitionId() * TASK_BLOCKS

        def passed_on() -> pa.RecordBatch:
            first, n = {}, 0
            for lang, codes in tables.items():
                first[lang] = n
                n += len(codes) - 1
            positions = np.concatenate([np.where(own > 0, own - 1 + first[lang], -1) for lang, own in held])
            keys, bucket = [], np.zeros(n, np.int64)
            for lang, codes in tables.items():
                words = list(codes)[1:]
                bucket[first[lang] : first[lang] + len(words)] = [crc32(w) % buckets for w in words]
                name = json.dumps(lang)
                keys += [f"{name}\t{w.decode()}" for w in words]
            counts = np.bincount(positions[positions >= 0], minlength=n)
            sums = np.array([counts[first[lang] : first[lang] + len(codes) - 1].sum() for lang, codes in tables.items()], np.int64)
            return _packed(block, positions, bucket, counts, {"words": keys}, sums, {"words": [json.dumps(lang) for lang in tables]})

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for lang, text in zip(langs.to_pylist(), texts):
                words = [b"\xff", *_pieces(text.as_py() or b"")]
                while len(words) > 1:
                    stop = len(words)
                    if size + stop > BLOCK:  # closed at the end of a piece, if there is one
                        try:
                            stop = words.index(b"\xff", max(1, BLOCK - size)) + 1
                        except ValueError:
                            pass
                    codes = tables.setdefault(lang, _Codes({b"\xff": 0}))
                    held.append((lang, np.fromiter(map(codes.__getitem__, words[:stop]), np.int32, stop)))
                    size += stop
                    words = [b"\xff", *words[stop:]] if stop < len(words) else []
                    if size >= BLOCK:
                        yield passed_on()
                        held, tables, size, block = [], {}, 0, block + 1
        if held:
            yield passed_on()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(cut, "block long, bucket int, places binary, counts binary, words binary"))


def _same_words(table: pa.Table) -> tuple[np.ndarray, dict]:
    """A number for each entry of a bucket, equal for equal ones, and the keys by number."""
    coded = pa.array([w for b in table["words"].to_pylist() for w in b.decode().split("\n")], pa.string()).dictionary_encode()
    return coded.indices.to_numpy(), {"words": coded.dictionary.to_pylist()}


def _same_pairs(table: pa.Table) -> tuple[np.ndarray, dict]:
    left, right = (np.concatenate(_numbers(table[k], np.int64)) for k in ("lefts", "rights"))
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, {"lefts": left[order][new], "rights": right[order][new]}


def named(blocks: DataFrame, same: Callable, *keys: str) -> DataFrame:
    """For each block (block, places, ids) the entries that are frequent overall and their ids; and
    under block -1 all ids of a bucket with their counts (in totals) and keys."""

    def name(table: pa.Table) -> pa.Table:
        number, by_number = same(table)
        totals = np.zeros(len(by_number[keys[0]]), np.int64)
        np.add.at(totals, number, np.concatenate(_numbers(table["counts"], np.int64)))
        frequent = np.flatnonzero(totals >= MIN_COUNT)
        ids = np.full(len(totals), -1, np.int64)
        ids[frequent] = table["bucket"][0].as_py() * BUCKET_IDS + np.arange(len(frequent))
        columns, at = {k: [] for k in ("block", "places", "ids", "totals", *keys)}, 0
        for block, places in zip(table["block"].to_pylist(), _numbers(table["places"], np.int32)):
            own = ids[number[at : at + len(places)]]
            at += len(places)
            if (own >= 0).any():
                columns["block"].append(block)
                columns["places"].append(_bytes(places[own >= 0]))
                columns["ids"].append(_bytes(own[own >= 0]))
        if len(frequent):
            columns["block"].append(-1)
            columns["places"].append(None)
            columns["ids"].append(_bytes(ids[frequent]))
            for k, values in (("totals", totals), *by_number.items()):
                values = [values[i] for i in frequent] if isinstance(values, list) else values[frequent]
                columns[k] = [None] * (len(columns["block"]) - 1) + [_bytes(values)]
        n = len(columns["block"])
        return pa.table({k: pa.array(v or [None] * n, pa.int64() if k == "block" else pa.binary()) for k, v in columns.items()})

    rows = blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(name, f"block long, places binary, ids binary, totals binary, {', '.join(f'{k} binary' for k in keys)}")
    return stored(rows)


def firsts(names: DataFrame, *keys: str) -> DataFrame:
    """id, a and the keys: one row for each id."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                columns = []
                for k in batch.schema.names:
                    part = batch.column(k).slice(row, 1)
                    columns.append(pa.array(_numbers(part, _KINDS[k])[0]) if k in _KINDS else pa.array(part[0].as_py().decode().split("\n"), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "a", *keys])

    arrays = [f"{k}s" for k in keys]
    kinds = ", ".join(f"{k} {'long' if f'{k}s' in _KINDS else 'string'}" for k in keys)
    return names.where("block = -1").select("ids", "totals", *arrays).mapInArrow(flat, f"id long, a long, {kinds}")


def pair_blocks(blocks: DataFrame, names: DataFrame, buckets: int) -> DataFrame:
    """The blocks with pairs of adjacent ids in place of entries: block, bucket, places, counts, lefts, rights."""

    def paired(held: pa.Table, named: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("places", "counts", "lefts", "rights")]])
        if not held.num_rows or not named.num_rows:
            return schema.empty_table()
        codes = _numbers(held["places"], np.int32)[0]
        place, name = (np.concatenate(_numbers(named[k], _KINDS[k])) for k in ("places", "ids"))
        rank = np.full(max(int(codes.max(initial=0)), int(place.max())) + 2, -1, np.int64)  # the last is for -1
        rank[place] = np.arange(len(place))
        at = rank[codes]
        both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        keys, number, counts = np.unique(at[both] * len(place) + at[both + 1], return_inverse=True, return_counts=True)
        out = np.full(len(codes), -1, np.int64)
        out[both] = number
        left, right = (name[k] for k in np.divmod(keys, len(place)))
        mixed = (left.astype(np.uint64) * _ODD ^ right.astype(np.uint64)) * _ODD
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        return pa.Table.from_batches([_packed(held["block"][0].as_py(), out, bucket, counts, {"lefts": left, "rights": right})])

    own = blocks.where("bucket = -1").select("block", "places").groupBy("block")
    back = names.where("block >= 0").select("block", "places", "ids").groupBy("block")
    return stored(own.cogroup(back).applyInArrow(paired, "block long, bucket int, places binary, counts binary, lefts binary, rights binary"))


def _wide(count: Column, digits: int = 20) -> Column:
    """A count as a decimal, whose products don't overflow."""
    return count.cast(f"decimal({digits},0)")


def _cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)), exactly: the remainder goes before the division."""
    above, below = _wide(F.lit(2_000_000), 10) * _wide(a), _wide(left) + _wide(right)
    return ((above - F.pmod(above, below)) / below).cast("long")


def phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All candidates (id, lang, phrase, a, left, right, heads, tails, words), and lang, n. heads has
    the occurrences of the first word, the first two and so on, tails those of the last ones."""
    buckets = BUCKETS + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    blocks = word_blocks(docs, buckets)
    lang = lambda key: F.from_json(F.concat(F.lit("["), F.substring_index(key, "\t", 1), F.lit("]")), "array<string>")[0]
    word = F.substring_index("word", "\t", -1)
    sums = firsts(blocks.where("bucket = -1").select(F.lit(-1).alias("block"), F.col("counts").alias("ids"), F.col("counts").alias("totals"), "words"), "word")
    totals = materialise(sums.groupBy(lang("word").alias("lang")).agg(F.sum("a").alias("n")))
    names = named(blocks, _same_words, "words")
    none = F.array().cast("array<long>")
    known = materialise(firsts(names, "word").select("id", lang("word").alias("lang"), word.alias("phrase"), word.alias("last"), "a", none.alias("heads"), none.alias("tails")))
    found = []
    for words in range(2, LONGEST + 1):
        blocks = pair_blocks(blocks, names, buckets)
        names = named(blocks, _same_pairs, "lefts", "rights")
        own = materialise(firsts(names, "left", "right"))
        side = lambda key, *cols: small_or_not(known.select(F.col("id").alias(key), *cols))  # noqa: E731, B023
        one = join_split(own, side("left", "lang", "phrase", F.concat("heads", F.array("a")).alias("heads")), "left", "right", hubs(own, "left"))
        both = join_split(one, side("right", "last", F.concat("tails", F.array("a")).alias("tails")), "right", "left", hubs(own, "right"))
        known = materialise(both.withColumn("phrase", F.concat_ws(" ", "phrase", "last")).select("id", "lang", "phrase", "last", "a", "heads", "tails", "left", "right"))
        found.append(known.drop("last").withColumn("words", F.lit(words)))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows, totals


def best_cut(words: int) -> Column:
    """The least (score, k, l, r) over the cuts of phrases of so many words."""
    cuts = []
    for k in range(1, words):
        left, right = F.element_at("heads", k), F.element_at("tails", words - k)
        cuts.append(F.struct(_cut_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame) -> DataFrame:
    """The TOP phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows, totals = phrases(docs)
    shorter = (F.col("words") - 1).alias("words")
    above = rows.select(shorter, F.col("left").alias("id"), F.col("a").alias("above")).union(rows.select(shorter, "right", "a")).groupBy("words", "id").agg(F.max("above").alias("above"))
    subsumed = _wide(F.lit(100), 3) * _wide(F.col("above")) >= _wide(F.lit(SUBSUMED), 3) * _wide(F.col("a"))
    kept = rows.join(above, ["words", "id"], "left").where(F.col("above").isNull() | ~subsumed)
    cut = F.when(F.col("words") == 2, best_cut(2))
    for words in range(3, LONGEST + 1):
        cut = cut.when(F.col("words") == words, best_cut(words))
    scored = kept.withColumn("cut", cut).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
