"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised in Arrow batches; a document of more than `limit` tokens is cut into
full pieces and a rest. Only the histogram of piece lengths (at most `limit` numbers) goes to
the driver. There, lengths are placed from the longest to the shortest: pieces of one length
go, many at a time, to the open packing patterns with the fewest tokens so far, and the
patterns' counts are updated. A pattern is a list of runs (length, times), and each run takes
a range of the ranks of its length, so pieces find their sequence by (length, rank).

Ranks are given without gathering a length in one task: rows of a length are dealt into
buckets by hash, numbered there, and shifted by a running sum of the buckets' counts.

Defined cases: a null or empty text is a document of one token, the end mark; rows that agree
in doc_id and text are packed like any other two; a very long text is cut into full pieces and
a rest; an empty table gives no rows; other columns are ignored. Every token lies in exactly one piece.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialise

LIMIT, END = 4096, 2
#: About as many rows of a length are numbered in one group.
BUCKET = 20_000
#: Words, and runs of letters or marks, whose tokens a worker keeps at most.
CACHED_WORDS, CACHED_RUNS = 250_000, 400_000

_SPACE = re.compile(r"[ \t-\r]+")
# How this vocabulary's tokenizer splits lower-case text, and the characters for
# which its other steps (composition, lower case by character) have nothing else to do.
_RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SIMPLE = re.compile(r"[!-~\u00c0-\u012f\u0131-\u017f]+")
#: Marks that make a run of their own behind a word, and what str.split takes for white space besides _SPACE.
_STOPS, _SEPARATORS = frozenset(".,;:!?"), "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


#: Texts on which a vocabulary shows whether its words can be encoded one by one.
PROBES = ("The quick brown fox, isn't it?", "  two  spaces\n\nand lines\t", "don't we'll I'm 3.14e-10 0xFF", "naïve café ÀÉÎ ſtraße ŒUVRE", "a_b-c/d=e+f (g) [h] {i} <j> \"k\"", "http://a.b/c?d=e&f=1#g AKIA0123", "東京 привет مرحبا", "x" * 40 + " y", "")


class Words(dict):
    """Token ids of words as little-endian bytes.

    Where a vocabulary never joins characters over white space, a text's ids are its words'
    ids; its special tokens have none in them, and are recognised where a text spells them out.
    A new word is split into runs, most of which are known; only new runs are merged. A full
    cache of words takes no more (frequent words come early), one of runs starts anew. That all
    this holds is checked on PROBES when the file is loaded; of a vocabulary for which it
    doesn't, the library encodes whole words, or whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.runs, self.letters = Tokenizer.from_file(path), {}, _byte_letters()
        self.model, known = self.tokenizer.model, json.loads(self.tokenizer.to_str())
        pre, self.special = known["pre_tokenizer"], [x["content"] for x in known["added_tokens"]]
        # special tokens might lie within a word; those that no letters and mark can spell out need no search
        self.by_letters = not any(re.fullmatch(r"[A-Za-z]*[.,;:!?]?", x) for x in self.special)
        self.by_runs = [x.get("pattern", {}).get("Regex") for x in (pre or {}).get("pretokenizers", [])][:1] == [_RUN.pattern]
        self.by_words = True
        same = lambda: all(_ids(text, self) == self.whole(text) for text in PROBES)
        if self.by_runs and not same():
            self.by_runs = False
            self.clear()
        if not same():
            self.by_words = False
        self.clear()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        body, stop = (word[:-1], word[-1]) if word[-1] in _STOPS else (word, "")
        if self.by_runs and self.by_letters and body.isalpha() and (body.isascii() or _SIMPLE.fullmatch(body)):
            # one run of letters, and perhaps one mark
            run = body.lower()
            ids = self.runs.get(run) or self._merged(run)
            if stop:
                ids += self.runs.get(stop) or self._merged(stop)
        elif self.by_runs and _SIMPLE.fullmatch(word) and not any(s in word for s in self.special):
            ids = b"".join(self.runs.get(r) or self._merged(r) for r in _RUN.findall(word.lower()))
        else:
            ids = self.whole(word)
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def _merged(self, run: str) -> bytes:
        letters = run if run.isascii() else run.encode("utf-8").decode("latin-1").translate(self.letters)  # no run has white space
        found = [t.id for t in self.model.tokenize(letters)]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.runs) >= CACHED_RUNS:
            self.runs.clear()
        self.runs[run] = ids
        return ids


@functools.cache
def _words(path: str) -> Words:
    """Shared by the tasks of a worker."""
    return Words(path)


def _ids(text: str, words: Words) -> bytes:
    """A text's token ids, little-endian, of four bytes each."""
    if not words.by_words:
        return words.whole(text)
    # str.split is the faster one, where it means the same white space
    plain = text.isascii() and not any(c in text for c in _SEPARATORS)
    return b"".join(map(words.__getitem__, text.split() if plain else filter(None, _SPACE.split(text))))


def token_count(text: str, tokenizer: str) -> int:
    return len(_ids(text, _words(tokenizer))) // 4


def tokenised(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mark = _words(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), []
            for k, text in enumerate(batch.column(1)):
                data = _ids(text.as_py() or "", words) + mark
                for at in range(0, len(data), 4 * limit):
                    part = data[at : at + 4 * limit]
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            out = [ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:5])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.binary())] * with_ids, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, runs) for each packing pattern; runs are (length, times), longest length first.

    Shortest-pack-first: pieces of the length in hand go to the pattern with the most room,
    as often as it takes to bring it level with the next. Where none has room, the rest of
    them open new sequences, as many to each as fit.
    """
    room: dict[int, list[tuple[int, tuple]]] = {}  # by free tokens
    widest = []  # a heap of their negatives

    def put(gap: int, count: int, runs: tuple) -> None:
        if count:
            if gap not in room:
                heapq.heappush(widest, -gap)
            room.setdefault(gap, []).append((count, runs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if widest and -widest[0] >= length:
                gap = -widest[0]
                count, runs = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                    heapq.heappop(widest)
                level = -widest[0] if widest else 0
                times = max(1, (gap - level) // length)
                times = min(times, max(1, left // count))
            else:
                gap, runs, times = limit, (), min(limit // length, left)
                count = left // times
            used = min(count, left // times)
            put(gap, count - used, runs)
            left -= used * times
            again = bool(runs) and runs[-1][0] == length
            put(gap - length * times, used, runs[:-1] + ((length, runs[-1][1] + times),) if again else (*runs, (length, times)))
    return [(count, list(runs)) for gap in sorted(room) for count, runs in room[gap]]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Columns length, first rank, first sequence, first offset, times; a row for each run of a pattern.

    Each length opens or splits a few patterns at most, and a pattern has at most ninety runs
    (ninety different lengths already hold 4095 tokens), whatever the number of documents.
    """
    rows, rank, sequence = [], {}, 0
    for count, runs in found:
        offset = 0
        for length, times in runs:
            at = rank.get(length, 0)
            rows.append((length, at, sequence, offset, times))
            rank[length] = at + count * times
            offset += length * times
        sequence += count
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank, 0 to n - 1 among the n pieces of a length."""
    buckets = pieces.groupBy("length").count().select("length", F.ceil(F.col("count") / BUCKET).alias("buckets"))
    # at most one row for each length, LIMIT in all
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "buckets")).drop("buckets")
    upto = Window.partitionBy("length").orderBy("bucket")
    firsts = dealt.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(upto) - F.col("count")).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return dealt.withColumn("rank", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "bucket")


def placed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (materialised) with sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(slots(patterns(histogram, limit)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset, times = table.value.T
        keys = (length << 44) + first
        for batch in batches:
            own, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, (own << 44) + rank, side="right") - 1
            nth = rank - first[at]
            got = [sequence[at] + nth // times[at], offset[at] + own * (nth % times[at])]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(x, pa.int64()) for x in got], keep + ["sequence_id", "offset"])

    rows = ranked(pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    rows = placed(materialise(tokenised(docs, tokenizer, limit, end, with_ids)), limit)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, tokens, doc_ids, lengths; ids as concatenated bytes.

    packed comes from pack(..., with_ids=True); a sequence gathers at most LIMIT tokens.
    """
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", F.hex("ids").alias("ids")))).alias("parts"))
    field = lambda name: F.transform("parts", lambda p: p[name])
    return parts.select("sequence_id", "tokens", field("doc_id").alias("doc_ids"), field("length").alias("lengths"), F.unhex(F.array_join(field("ids"), "")).alias("ids"))
