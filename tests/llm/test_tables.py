"""Operators on documents against brute force, with hard cases and empty tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from fixtures import SCHEMA, documents, texts
from pyspark.sql import functions as F

from weftline.llm import dac, decontaminate, pieces, sharding, simhash, suffixes


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- sharding ----------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_curve_steps_to_a_neighbour(bits):
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.curve_index(list(points.T), bits)
    assert sorted(index) == list(range(side**3))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_keep_the_law(spark):
    rows = texts()
    got = sharding.document_shards(documents(spark, rows), 24).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    by_place = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert by_place == sorted(by_place)
    assert sharding.document_shards(empty(spark)).count() == 0


def test_text_dimensions_share_long_prefixes(spark):
    rows = [(k, None if k % 9 == 0 else f"https://source_{k % 80:03}", "old") for k in range(800)]
    got = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, source string, shard string"), "doc_id", ["source"], 8).collect()
    assert len({r.curve for r in got}) == 16 and {r.shard for r in got} == set(range(8))
    in_order = [r.source or "" for r in sorted(got, key=lambda r: (r.curve, r.source or ""))]
    assert in_order == sorted(in_order)
    with pytest.raises(ValueError):
        sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, source string, shard string"), "doc_id", ["shard"], 8)


def test_written_shards(spark, tmp_path):
    out = sharding.document_shards(documents(spark), 4)
    sharding.write_shards(out, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 4


# --- token files -------------------------------------------------------------------------------

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = texts()
    got = dac.token_report(documents(spark, rows), BPE, file_ids=500).collect()
    ids = {(d, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in rows}
    want = Counter((d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for (d, t, *_), x in zip(rows, (ids[r[0], r[1]] for r in rows), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert dac.token_report(empty(spark), BPE).count() == 0


def test_random_access():
    rng = np.random.default_rng(3)
    ids = (rng.integers(0, 2**32, 9000, dtype=np.uint32) >> rng.integers(0, 32, 9000).astype(np.uint32)).astype(np.uint32)
    raw, reads = dac.pack(ids), []

    def read_at(n, at):
        reads.append(n)
        return raw[at : at + n]

    reader = dac.Reader(read_at)
    reads.clear()
    assert all(reader[k] == ids[k] for k in range(0, 9000, 101))
    assert max(reads) <= 72  # no read is larger than a block of a bitmap
    assert (reader.read(1234, 5000) == ids[1234:6234]).all() and not len(reader.read(9000, 0))
    with pytest.raises(IndexError):
        reader.read(8999, 2)
    with pytest.raises(ValueError):
        dac.Reader(lambda n, at: b"x" * n)


# --- decontamination ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(item)
    out = Counter()
    for d, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[x]
        named = sorted(str(i) for i in found if i is not None)
        out[d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination(spark):
    rows = texts()
    body = [r[1] for r in rows]
    piece = lambda k, a, b: " ".join(body[k].split()[a:b])
    items = [(1, piece(45, 20, 60)), (2, piece(2, 3, 16)), (3, piece(7, 0, 5)), (4, "x"), (5, ""), (6, None), (7, "word " * 30), (8, piece(45, 30, 43).upper() + "!"), (9, "word word word"), (None, piece(9, 0, 14)), (1, piece(11, 1, 15)), (10, "nowhere to be found at all")]
    for some in (items, items[:2]):
        got = decontaminate.contamination(documents(spark, rows), spark.createDataFrame(some, "item_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(rows, some)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark), none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), none).count() == 0
    kept = decontaminate.decontaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    bad = sum(n for k, n in brute_contamination(rows, items).items() if k[-1])
    assert kept.count() == len(rows) - bad and kept.columns == documents(spark).columns


def test_contamination_beyond_small_sides(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    rows = texts()
    items = [(1, " ".join(rows[45][1].split()[20:60])), (2, "word word")]
    got = decontaminate.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(rows, items)


# --- SimHash -----------------------------------------------------------------------------------


def brute_fingerprint(text, shingle=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
    votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_groups(marks, distance):
    """Smallest id reachable for each (id, fingerprint)."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(marks)]


def test_simhash_groups(spark):
    rows = texts()
    marks = [(r[0], brute_fingerprint(r[1])) for r in rows]
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == Counter(brute_groups(marks, 4))
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 20, 2])
def test_links_of_many_near_fingerprints(spark, bucket):
    """Groups larger than a bucket, chains of links, and points far apart."""
    rng = np.random.default_rng(5)
    bits = {0, 2**64 - 1}
    for _ in range(6):
        at = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(60):
            at ^= 1 << int(rng.integers(64))
            bits.add(at)
            bits.add(at ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    marks = [(k, b) for k, b in enumerate(sorted(bits))]
    points = spark.createDataFrame([(k, int(np.uint64(b).astype(np.int64))) for k, b in marks], "node long, fingerprint long")
    from weftline.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.fingerprint_links(points, 4, bucket)).collect()}
    assert {k: found.get(k, k) for k, _ in marks} == {d: c for d, _, c in brute_groups(marks, 4)}


def test_segment_counts_bound_the_distance(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    bound = np.bitwise_count(simhash._unary(a) ^ simhash._unary(b))
    counts = lambda x: np.stack([(x >> np.uint64(2 * k) & np.uint64(1)) + (x >> np.uint64(2 * k + 1) & np.uint64(1)) for k in range(32)]).astype(int)
    assert (bound == np.abs(counts(a) - counts(b)).sum(axis=0)).all() and (bound <= np.bitwise_count(a ^ b)).all()
    df = spark.createDataFrame([(int(x.astype(np.int64)),) for x in a], "f long").select(simhash.segment_counts(F.col("f")).alias("c"))
    assert [np.int64(r.c).astype(np.uint64) for r in df.collect()] == simhash._unary(a).tolist()


# --- suffixes ----------------------------------------------------------------------------------


def brute_removal(rows, length):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "group"), [(400, 1 << 16), (400, 2), (100, 3)])
def test_removal(spark, length, group):
    rows = texts()
    got = suffixes.removal_report(documents(spark, rows), length, group).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(rows, length)


def test_removal_keeps_whole_characters(spark):
    a, b = "é" * 150, "è" * 150
    rows = [(1, "x" + a + b + "1", "en", "s", 1), (2, "yy" + a + b + "2", "en", "s", 1), (3, None, "en", "s", None)]
    out = {r.doc_id: r.text for r in suffixes.without_repeats(documents(spark, rows), 400).collect()}
    assert out == {1: "x1", 2: "yy2", 3: None}
    assert suffixes.removal_report(empty(spark)).count() == 0 and suffixes.without_repeats(empty(spark)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(2)
    words, group = rng.integers(0, 3, (500, 6)).astype(np.uint64), rng.integers(0, 4, 500)
    order = suffixes.multikey_order(group, words)
    assert [(group[k], *words[k]) for k in order] == sorted((g, *w) for g, w in zip(group, words, strict=True))


# --- pieces ------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    rows = texts()
    got = pieces.encode(documents(spark, rows).select("doc_id", "text"), MODEL).collect()
    want = Counter((d, tuple(library.encode(t or ""))) for d, t, *_ in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got) == want
    report = pieces.piece_report(documents(spark, rows), MODEL).collect()
    assert len(report) == len(rows) and all(r.round_trip for r in report)
    assert pieces.piece_report(empty(spark), MODEL).count() == 0


def test_relational_lattice_gives_the_same_ids(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(["hello world  x", "été à Paris", "日本 😀", "a\nb", "the quick brown", "   x", "", None])]
    fast = {r.doc_id: tuple(np.frombuffer(r.ids, "<u2").tolist()) for r in pieces.encode(documents(spark, rows).select("doc_id", "text"), MODEL).collect()}
    slow = {r.doc_id: tuple(r.ids) for r in pieces.encode_relational(documents(spark, rows), MODEL).collect()}
    assert {k: v for k, v in fast.items() if v} == slow


def test_viterbi_finds_the_best_path(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.2, "ba": -1.7, "aab": -3.9, "bb": -9.0}
    words = ["a", "ab", "aab", "abab", "bbab", "abba", "aabba", "aca"]

    def best(word):
        def walk(k):
            if k == len(word):
                return (0.0, ())
            options = [(table.get(word[k:j], -1e6 if j == k + 1 else None), j) for j in range(k + 1, len(word) + 1)]
            return max((s + walk(j)[0], (j - k, *walk(j)[1])) for s, j in options if s is not None)

        return walk(0)[0]

    df = spark.createDataFrame([(k, p, s, None) for k, (p, s) in enumerate(table.items())], "id int, piece string, score double, byte int")
    got = pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), df).select("word", pieces.viterbi(F.col("edges"), F.col("n")).alias("v")).collect()
    for r in got:
        cuts = np.cumsum([0, *r.v])
        parts = [r.word[a:b] for a, b in zip(cuts, cuts[1:])]
        assert "".join(parts) == r.word and sum(table.get(p, -1e6) for p in parts) == pytest.approx(best(r.word))
