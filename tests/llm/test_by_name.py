"""Every corpus query without a SQL form, run by its registered name over the whole small tables."""

import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from conftest import SMALL
from test_tables import brute_fingerprint, brute_groups, brute_removal

from weftline.llm import queries


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


def test_op1(spark, docs):
    got = rows_of(spark, "op1_hilbert_shards")
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d, t in sorted(docs, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op2_dac_tokens")) == sorted(want)


def test_op3(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = rows_of(spark, "op3_language_fusion")
    assert sorted(r.page_id for r in got) == sorted(pages)


def test_op7(spark, docs):
    want = Counter(brute_groups([(d, brute_fingerprint(t)) for d, t in docs], 4))
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows_of(spark, "op7_simhash_groups")) == want


def test_op8(spark, docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, "op8_suffix_removal"))
    assert got == brute_removal(docs, 400)


def test_op9(spark, docs):
    got = rows_of(spark, "op9_piece_lattice")
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)


def test_op13(spark, docs):
    got = rows_of(spark, "op13_quality_trees")
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL).collect()
    text = dict(docs)
    assert out and all(r.doc_id in text and r.round_trip for r in out) and len({r.doc_id for r in out}) == len(out)
