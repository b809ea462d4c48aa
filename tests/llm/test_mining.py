"""Collocations and spelling variants against plain Python, on whole tables and on odd rows."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from planimetra.llm import collocations, queries, spelling

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, differences  # noqa: E402

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_collocations_as_sql(spark):
    con = connect("/root/testdata/sf0.001")
    assert differences(queries.op11_collocations(spark, "/root/testdata/sf0.001"), con, queries.OP11_SQL) == ""


def mined(docs, top: int) -> list[tuple]:
    """Counts everything there is: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        rows = []
        for p, a in found.items():
            if not any(inside(p, q) and 100 * b >= 80 * a for q, b in found.items()):
                score, _, le, ri = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), le, ri))
        for rank, (score, a, p, le, ri) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, ri, n[lang], -score))
    return sorted(out)


def odd_texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "The", "of", "über", "ÜBER", "x-1", "日本", "a\x0bb", "stop.", "go,", "\tand", "the the", "new york city"]
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40])))) for _ in range(300)]
    return [*docs, ("en", None), (None, ""), ("fr", "only once"), ("und", "the of " * 4000), ("en", "no end " + "the " * 3000), ("en", ".;.")]


@pytest.mark.parametrize("block", [collocations.BLOCK, 50])
def test_collocations_of_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)  # tasks are forked from this process or import their own
    docs = odd_texts()
    df = spark.createDataFrame([(i, t, lang, "p", 7) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, a long").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df).collect())
    assert got == mined(docs, 2000) and len(got) > 10
    assert collocations.collocations(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 10)
    words = collocations._pieces(b"a b c. d e f g! h i")
    assert words == [b"a", b"b", b"c", b"\xff", b"d", b"e", b"f", b"g", b"\xff", b"h", b"i"]


def near_words(docs) -> dict[str, tuple]:
    """word: form, root, n, n_near, form_n; by the words with one letter left out."""
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for alike in holes.values():
        for w in alike:
            near[w] |= alike - {w}
    form = {w: best for w in words if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words}


def variants_of(spark, df) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def test_spelling_of_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = near_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert variants_of(spark, df) == want and sum(v[0] is not None for v in want.values()) > 100


def test_spelling_of_odd_texts(spark):
    rng = random.Random(4)
    letters = "abcçéÿ×÷z"
    base = ["".join(rng.choices(letters, k=rng.choice([5, 6, 9, 14]))) for _ in range(60)] + ["aaaaa", "aaaaaa", "a" * 400, "Été", "ÉTAIT", "naïve", "colour", "color"]
    edits = []
    for w in base * 4:
        at = rng.randrange(len(w))
        edits.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]]))
    docs = [(i, "日本-".join(rng.choices(base * 3 + edits, k=30))) for i in range(400)]
    docs += [(None, "colour COLOUR colour2color"), (7, None), (8, ""), (9, "!!"), (3, docs[3][1]), (11, "y" * 300_000 + " colour")] + [(k, "chain chaina") for k in range(500, 503)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(3)
    assert variants_of(spark, df) == near_words(docs)
    assert variants_of(spark, df.limit(0)) == {}


def test_forms_lead_to_the_last(spark):
    chain = [f"w{k:03}" for k in range(70)]
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {w: chain[-1] for w in chain[:-1]}
