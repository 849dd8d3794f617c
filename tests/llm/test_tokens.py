"""Token files and packing against the library and an exact round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF
from odd_rows import none, odd  # noqa: F401
from wakeframe.llm import packed_ids, packing, queries, tokens
from wakeframe.llm.words import blocks
from wakeframe.session import scratch

PATH = queries.vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_librarys_ids(library):
    own = tokens.Encoder(PATH)
    rng = random.Random(5)
    signs = "aZé ßŁɐДж中  \n\t\r\x0b\x0c\x00\x1c\x1f\x85\xa0 '’sdtll12٣.,!?…×÷ÿªº​　😀|-_<>`{~endoftext"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", "x<|endoftext|>y", "don't we'll ''s", "a  b   c \n\n d", "é ×÷ é×", " lead", "trail  "]
    got = [x for _, _, data, at in blocks(pa.array(texts)) for x in own.encode(data, at)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_pieces_are_learnt_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 5)
    monkeypatch.setattr(tokens, "FRESH_PIECES", 2)
    own = tokens.Encoder(PATH)
    for text in ["one two three four five six", "six five one", "seven one two"] * 2:
        _, _, data, at = next(blocks(pa.array([text])))
        assert np.frombuffer(own.encode(data, at)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_bits_round_trip(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert packed_ids.unpack(data, len(ids), bits).tolist() == ids.tolist()


def test_an_id_beyond_the_vocabulary_fails():
    assert packed_ids.id_bits(50257) == 16 and packed_ids.id_bits(1) == 1 and packed_ids.id_bits(49408) == 16 and packed_ids.id_bits(32000) == 15
    with pytest.raises(ValueError):
        packed_ids.pack(np.array([8], np.uint32), 3)


@pytest.mark.parametrize("vocabulary,block", [(50257, 64), (60_000_0, 7), (50257, 8192)])
def test_files_read_back_and_at_random(spark, odd, library, vocabulary, block):
    folder = scratch(spark, "test-ids")
    docs = packed_ids.in_order(odd)
    packed_ids.write_ids(tokens.tokenize(docs, PATH), folder, vocabulary, block)
    got = packed_ids.read_ids(spark, folder).orderBy("start").collect()
    want = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids)) for r in got) == sorted((str(d), len(i), np.array(i, "<u4").tobytes()) for d, i in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    listed = packed_ids.manifest(folder)
    assert listed["ids"] == len(flat)
    for f in listed["files"]:
        one = packed_ids.PackedFile(f"{folder}/{f['file']}")
        for a, z in [(0, 1), (3, 200), (f["ids"] - 1, f["ids"]), (f["ids"] // 2, f["ids"])]:
            assert one.read(a, z).tolist() == flat[f["start"] + a : f["start"] + min(z, f["ids"])].tolist()
        assert one.document(0).tolist() == flat[f["start"] : f["start"] + one.first[1]].tolist()


def test_texts_give_the_files_of_their_ids(spark, odd):
    a, b = scratch(spark, "test-ids"), scratch(spark, "test-ids")
    packed_ids.write_ids(tokens.tokenize(packed_ids.in_order(odd), PATH), a, 50257)
    packed_ids.write_texts(packed_ids.in_order(odd), b, PATH)
    rows = lambda f: sorted((str(r.doc_id), r.n_tokens, bytes(r.ids)) for r in packed_ids.read_ids(spark, f).collect())
    assert rows(a) == rows(b)


def test_an_empty_table_gives_an_empty_folder(spark, none):
    folder = scratch(spark, "test-ids")
    packed_ids.write_ids(tokens.tokenize(packed_ids.in_order(none), PATH), folder, 50257)
    assert packed_ids.read_ids(spark, folder).count() == 0
    texts = scratch(spark, "test-ids")
    packed_ids.write_texts(packed_ids.in_order(none), texts, PATH)
    assert packed_ids.read_ids(spark, texts).count() == 0
    assert queries.packed(none).count() == 0


def test_op1_matches_the_library(spark, library):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    start = 0
    for r in queries.op1(spark, SF).orderBy("doc_id").collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_packing(rows, ids, capacity):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for places in bins.values():
        reached = 0
        for offset, length in sorted(places):
            assert offset == reached
            reached += length
        assert reached <= capacity
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == crc(ids[d][r.start : r.start + r.length])
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids[d])
    return len(bins)


def test_op10_packs_every_piece_tightly(spark, library):
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in queries.table(spark, SF, "documents").collect()}
    n = check_packing(queries.op10(spark, SF).collect(), ids, queries.SEQUENCE)
    assert n <= -(-sum(map(len, ids.values())) // queries.SEQUENCE) + 1


def test_packing_of_odd_rows(odd):
    rows = queries.packed(odd).collect()
    assert sum(r.length == 1 for r in rows) == 3  # two null texts and an empty one
    used = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len({(s, o) for s, o, _ in used}) == len(used)
    assert all(o + n <= queries.SEQUENCE for _, o, n in used)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 30), st.data())
def test_fullest_is_fullest(room, data):
    counts = data.draw(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5))
    got = packing.fullest(counts, sorted(counts, reverse=True), room)
    assert all(got.count(n) <= counts[n] for n in set(got))
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    assert sum(got) == max(sums)


def test_plan_places_each_rank_once():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 60)}
    plan = packing.Plan(counts, 100)
    length = np.array([n for n, c in counts.items() for _ in range(c)])
    rank = np.array([k for c in counts.values() for k in range(c)])
    bins, offset = plan.place(length, rank)
    filled = np.zeros((plan.bins, 100), int)
    for b, o, n in zip(bins, offset, length):
        filled[b, o : o + n] += 1
    assert filled.max() == 1 and filled.sum() == length.sum()
    room = []
    for n in sorted(length.tolist(), reverse=True):  # first fit, longest first
        k = next((i for i, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(100 - n)
        else:
            room[k] -= n
    assert plan.bins <= len(room)


def test_a_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 50)
    items = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 7, 11 + id % 5) AS length")
    rows = packing.pack(items, 64, ["id"]).collect()
    assert len(rows) == 1000 and len({(r.sequence_id, r.offset) for r in rows}) == 1000
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 64) + 2


def test_a_length_beyond_the_capacity_fails(spark):
    with pytest.raises(Exception, match="length is not from 1"):
        packing.pack(spark.range(3).selectExpr("id", "id * 40 + 1 AS length"), 64, ["id"]).collect()


def test_sequences_join_their_pieces(spark, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six " * 30)], "doc_id bigint, text string")
    pieces = tokens.tokenize(docs, PATH, max_length=16)
    made = packing.sequences(packing.pack(pieces, 16, ["doc_id", "piece"], carry=["ids"])).collect()
    all_ids = sorted(i for t in ("one two three", "four five", "six " * 30) for i in [*library.encode(t, add_special_tokens=False).ids, 0])
    assert sorted(i for r in made for i in tokens.unpack_le(r.ids).tolist()) == all_ids
    assert all(r.n_tokens <= 16 and len(r.ids) == 4 * r.n_tokens for r in made)
