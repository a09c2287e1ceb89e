"""Operator 11 against brute force: every pair of words, by the definition of one edit."""

import random
import zlib
from collections import Counter

import pytest
import regex
from conftest import SMALL
from fixtures import documents
from oracle import database, same_rows

from weftline.llm import queries, spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute(rows, letters=6, least=5, factor=5, damage=199):
    count = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= letters and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    top = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in top.items() if words[v] >= factor * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def variants(seed: int, n: int = 60) -> list[tuple]:
    """Texts of a few words, their variants, runs of one letter, and letters beyond ASCII."""
    rng = random.Random(seed)
    words = ["colour", "éclair", "aaaaaaa", "aaaaaa", "Àbcdef", "ÀBCDEF", "preaching", "preaches", "ÿÿÿÿÿÿÿ"] + ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    out = []
    for k in range(n):
        text = []
        for _ in range(60):
            w = rng.choice(words[: rng.choice((3, 9, len(words)))])
            p = rng.randrange(len(w))
            text.append(rng.choice((w, w, w, w.upper(), w[:p] + w[p + 1 :], w[:p] + rng.choice("aéz") + w[p:], w[:p] + "ß" + w[p + 1 :])))
        out.append((k, rng.choice((" ", ", ", "1", "\n")).join(text)))
    return out + [(None, out[0][1]), (5, None), (6, ""), (7, "colour " * 3000)]


@pytest.mark.parametrize(("block", "damage"), [(2048, 199), (16, 7), (3, 2)])
def test_brute_force(spark, block, damage):
    rows = variants(block)
    docs = documents(spark, [(d, t, None, None, None) for d, t in rows])
    got = [tuple(r) for r in spelling.spelling_groups(docs, damage=damage, factor=2, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, damage=damage, factor=2)


def test_long_ways(spark):
    words = ["abcdefgh"[:6] + "x" * k for k in range(6)]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(5 * 2**k)))]
    got = {r.word: r.root for r in spelling.spelling_groups(documents(spark, [(1, rows[0][1], None, None, None)]), damage=10**9, factor=2).collect()}
    assert set(got.values()) == {words[-1]}


def test_no_rows(spark):
    assert spelling.spelling_groups(documents(spark, [])).count() == 0
    assert spelling.spelling_groups(documents(spark, [(1, None, None, None, None)])).count() == 0


def test_sql(spark):
    assert same_rows(queries.QUERIES["op11_spelling_variants"](spark, SMALL), database(SMALL), spelling.ORACLE)
