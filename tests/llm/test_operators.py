"""The numbered operators against brute force on a small table with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planimetra.llm import chat, exact_dedup, matroska, minhash, mixing, packing, quality, secret_scan, sharding, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: The extra columns clash with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, hash string, shard string, size string, label string, bucket int"


def rows() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(900)]
    texts = [None, "", "  \n\t ", "one", "One two", "ß İ é  ǅ", "x<|endoftext|>y"]
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([6, 30, 90, 300]))
        texts += [" ".join(words), "\n".join(words), "  ".join(words).upper()]
        for changes in (1, 3, 9):
            near = list(words)
            for _ in range(changes):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    texts.append(" ".join(rng.choices(vocabulary, k=30_000)))
    texts += ["user: bob\npassword = hunter2hunter2 AKIA" + "A1" * 8, "AKIA12345678 is alone", "0123456789abcdef0 key_id=abcd\n\nhttps://a.b/c pwd: qwert", "secret: short token='" + "k" * 12]
    out = [(i, t, "xx", (None, "b", "a", "hot", "hot", "hot")[i % 6], 0, i, "h", "s", "z", "l", 1) for i, t in enumerate(texts)]
    return out + [out[8], out[8], (None, texts[8], "xx", "a", 0, 1, "h", "s", "z", "l", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text: str | None) -> str:
    return SPACE.sub(" ", text or "")


def by_id(found) -> dict:
    return {r.doc_id: r for r in found}


def test_secret_scan(docs, empty):
    found = secret_scan.scan(docs).collect()
    assert len(found) == len(rows())
    for r in found:
        text = next(x[1] for x in rows() if x[0] == r.doc_id) or "" if r.doc_id is not None else rows()[8][1]
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = ",".join(x[2] for x in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if re.match("(assign|access|hex):", x)] == [x[2] for x in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
    linked = {r.doc_id: r.spans for r in found}
    pair = next(x[0] for x in rows() if (x[1] or "").startswith("user: bob"))
    assert "weak_access:0:9" in linked[pair]
    assert linked[pair + 1] == ""
    assert "weak_access" in linked[pair + 2] and "endpoint" not in linked[pair + 2]
    assert secret_scan.scan(empty).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://net/x", "http://NET", "https://a.net/?q=1", "http://example.net/en/a", "http://www.Example.net/en/", "http://example.net/de", "ftp://example.com/de/x#y", "http://example.com/fr/", "http://w.org/fr/1?x=/", "http://borg/fr/", "x://y://net/", "http://a.b/c\n://d"] * 3
    found = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "1 as label")).collect()}
    assert len(found) == len(urls)
    for k, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(rule), rule, says) for says, rule in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        rule, says = (max(fits)[1:]) if fits else (None, found[k].verdict)
        assert (found[k].host, found[k].path, found[k].rule, found[k].verdict) == (host, path, rule, says)
        assert says in ("allow", "block")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in rows():
        groups[normal(r[1])].append(r[0])
    order = lambda x: (x is None, x)
    want = sorted(((i, min(ids, key=order), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == len(groups)
    rest = exact_dedup.drop_exact_duplicates(docs)
    assert rest.columns == docs.columns and rest.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])
    found = packing.pack(docs, VOCABULARY).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = texts[r.doc_id][0]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, lists in texts.items():
        assert sorted(k for start, n in pieces[i] for k in range(start, start + n)) == sorted(list(range(len(lists[0]))) * len(lists))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 4096
        assert all(at == sum(n for other, n in parts if other < at) for at, _ in parts)
    assert len(sequences) <= -(-sum(r.length for r in found) // 4096) + 1
    assert packing.pack(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacings(lacing):
    frames = [bytes([k]) * (300 if lacing == matroska.FIXED else 1 + 290 * k) for k in range(1 if lacing == matroska.NO_LACING else 5)]
    block = matroska._block(frames, 7, lacing)
    (_, _, start, stop), = matroska.elements(memoryview(block), 0, len(block))
    track, offset, _, found = matroska._frames(memoryview(block), start, stop)
    assert (track, offset, [block[at : at + n] for at, n in found]) == (1, 7, frames)


def test_matroska(docs, empty):
    found = matroska.digests(docs).collect()
    assert len(found) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    packets = matroska.packets(matroska.media_column(docs)).collect()
    assert sum(p.length for p in packets) == sum(r.payload_bytes for r in found)
    assert all(p.cued and p.track == 1 for p in packets)
    assert matroska.digests(empty).count() == 0 and matroska.parse(None) == [] and matroska.parse(b"\x1a\x45") == []


def test_near_dedup(docs, empty):
    sets = {}
    for n, r in enumerate(rows()):
        words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) if w]
        sets[n] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = [r[0] for r in rows()]
    parent = list(range(len(ids)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    named = [n for n in sets if sets[n] and ids[n] is not None]
    for n in named:
        for m in named:
            both = len(sets[n] & sets[m])
            if n < m and (ids[n] == ids[m] or 100 * both >= 75 * (len(sets[n]) + len(sets[m]) - both)):
                parent[max(root(n), root(m))] = min(root(n), root(m))
    least = defaultdict(lambda: 10**9)
    for n in named:
        least[root(n)] = min(least[root(n)], ids[n])
    want = sorted(((ids[n], len(sets[n]), least[root(n)] if n in named else ids[n]) for n in sets), key=str)
    found = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash.drop_near_duplicates(docs).columns == docs.columns
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_mixing(docs, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows())
    sources, total = defaultdict(list), 0
    for r in found:
        sources[r.source].append(r)
        total += r.size
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    size = {s: sum(r.size for r in sources[s]) for s in names}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # those above the most stop there, the rest share what is left
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        stop = {s for s in open_ if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in stop} if stop else share
        open_ = open_ - stop if stop else set()
    for s in names:
        assert sources[s][0].target == pytest.approx(target[s]) and sources[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in sources[s]) - target[s]) <= len(sources[s])
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_chat(spark):
    rng, tricky = random.Random(5), ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\/INST]", "<\\\\/s>", "[INST", None, "", "plain words here\n"]
    data = [(c, t, ("system", "user", "assistant")[min(t, 2) if t < 2 else 1 + t % 2], rng.choice(tricky) if rng.random() < 0.5 else "word " * rng.randint(0, 700)) for c in (1, 2, 3, -7) for t in range(rng.randint(1, 14))]
    data.append((None, 0, None, "x"))
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as before").repartition(3)
    found = {r.conv_id: r for r in chat.read_back(chat.windows(turns)).collect()}
    assert len(found) == 5
    for c, r in found.items():
        own = sorted((x for x in data if x[0] == c), key=lambda x: x[1])
        says = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(says.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.windows(turns.where("false"))).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    found = by_id(quality.scores(documents, labels.select("doc_id", "quality")).collect())
    assert len(found) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.values())
    judged = [(found[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in found and found[r.doc_id].held_out]
    assert sum(p == q for p, q in judged) >= 0.9 * len(judged)


def test_quality_defined_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.scores(docs, none).collect()} == {(0.7, 1)}
    assert quality.good_documents(docs, none).columns == docs.columns
    assert quality.scores(empty, none).count() == 0


def test_sharding(docs, empty):
    found = sharding.shard_documents(docs).collect()
    texts, shards = {r[0]: r[1] for r in rows()}, defaultdict(list)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
    assert len(found) == len(rows()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert sharding.shard_documents(empty).count() == 0


def test_hypergeometric_law():
    rng = random.Random(1)
    drawn = [sharding.hypergeometric(rng, 30, 70, 40) for _ in range(4000)]
    assert abs(np.mean(drawn) - 12) < 0.2 and abs(np.var(drawn) - 40 * 0.3 * 0.7 * 60 / 99) < 0.5
    matrix = sharding.communication_matrix([7, 0, 90, 3], 6)
    assert [sum(r) for r in matrix] == [7, 0, 90, 3] and [sum(c) for c in zip(*matrix)] == [17, 17, 17, 17, 16, 16]


def test_words_have_the_librarys_ids():
    """Words encoded one by one or by runs, against the library on whole texts; caches empty and full."""
    words = packing._words(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "don't I'll. DON'T! a\x1cb c\x1dd\x1f \x1e", "\x0b\x0cword, Word; WORD: word? it's. 'S . ,", "naïve. É, ǅ ×x x÷! ÀÉÎ: straße ŒUVRE? ñar.!!",
        "<|startoftext|> hello<|endoftext|>there x<|endoftext|>.", "a. .a !! ?x x? ''' 's's l'été", "İstanbul ſ. K ıi.", "é.  x y　z\x85w",
        "in### tion*** 3.14. x1 1x. " * 40, "Onheth, onheth, ONHETH", "﻿word. ‍x", "東京。 привет, мир!",
    ]
    for _ in range(2):
        assert [packing._ids(t, words) for t in texts] == [words.whole(t) for t in texts]
    full, packing.CACHED_WORDS = packing.CACHED_WORDS, 0
    try:
        words.clear()
        words.runs.clear()
        assert [packing._ids(t, words) for t in texts] == [words.whole(t) for t in texts]
    finally:
        packing.CACHED_WORDS = full
