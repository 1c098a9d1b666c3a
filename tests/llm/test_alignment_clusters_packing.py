"""Operators 11 to 13: kernels against plain Python, queries against brute force, awkward tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from statelake.llm import alignment, clustering, packing, token_ids
from statelake.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
BYTE_FILE, PIECE_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def file(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    made = {plain: Tokenizer.from_file(BYTE_FILE) for plain in (False, True)}
    made[True].encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()]


# -- ids -------------------------------------------------------------------------------------------------------------

ODD = "\t\n\x0b\x0c\r \x1c\x1f\x85\xa0  ​  　﻿ab'ts1.é中<|>"


@pytest.mark.parametrize("plain", [False, True])
def test_ids_in_blocks_are_those_of_the_library(plain, library, monkeypatch):
    monkeypatch.setattr(token_ids.blocks, "__defaults__", (5,))
    made, rng = token_ids.Encoder(file(BYTE_FILE), plain), random.Random(3)
    assert made.ranked is not None
    for _ in range(4000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            text = text[:7] + "<|endoftext|>" + text[7:]
        assert made(text).tolist() == library[plain].encode(text, add_special_tokens=False).ids


def test_ids_of_files_without_ranks(library):
    spec = json.loads(file(BYTE_FILE))
    spec["model"]["merges"] = spec["model"]["merges"][:300][::-1]
    other = json.dumps(spec).encode()
    made = token_ids.Encoder(other)
    assert made.ranked is None
    text = "the thing in the other tin " * 3
    assert made(text).tolist() == Tokenizer.from_buffer(other).encode(text, add_special_tokens=False).ids


def test_long_runs_go_to_the_library(library):
    text = "abc" * 3000 + " tail"
    assert token_ids.Encoder(file(BYTE_FILE))(text).tolist() == library[False].encode(text, add_special_tokens=False).ids


# -- alignment -------------------------------------------------------------------------------------------------------


def plain_alignment(pairs, library):
    """Every number of the alignment by loops over all tokens."""
    left, right = alignment.ByteLevelSide(file(BYTE_FILE)), alignment.PieceSide(file(PIECE_FILE))
    docs, held = [], defaultdict(set)
    for number, (doc_id, text) in enumerate(pairs):
        a = library[True].encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.made.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(left.bytes_of[i] for i in a) != raw or b"".join(right.bytes_of[i] for i in b) != raw:
            a, b = [], []
        spans = []
        for ids, side in ((a, left), (b, right)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(side.bytes_of[i])))
                at = out[-1][1]
            spans.append(out)
        found, low = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while low < len(b) and spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(b) and spans[1][j][0] < e:
                found.append((a[i], b[j]))
                j += 1
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in shared:
            groups.append("|".join(
                ",".join(str(i) for i, (s, e) in zip(ids, span) if begin <= s and e <= end) for ids, span in zip((a, b), spans)
            ))
            begin = end
        for pair in found:
            held[pair].add(number)
        docs.append((doc_id, len(a), len(b), len(groups), found, ";".join(groups)))
    count = {p: len(s) for p, s in held.items()}
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (i, na, nb, g, len(found), sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found), text)
        for i, na, nb, g, found, text in docs
    ]


def found_rows(rows):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((tuple(r[n] for n in names) for r in rows.collect()), key=repr)


def test_op11_query(spark, library, texts):
    hashed = [
        (*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "") for row in plain_alignment(texts, library)
    ]
    mine = QUERIES["op11_token_alignment"](spark, ROOT)
    assert sorted(map(tuple, mine.collect())) == sorted(hashed)
    assert sum(r[1] > 0 for r in hashed) > 100


def test_alignment_of_awkward_rows(spark, awkward, pairs, nothing, library, monkeypatch):
    some = [(i, t if t is None else t[:3000]) for i, t in pairs] + [
        (20, "▁ piece sign"), (21, "a  b\tc\x00d"), (22, "<|endoftext|><s></s><0x41><unk>"), (23, " led by a blank"), (24, "ｆｕｌｌ ﬁ"),
    ] + [(30 + k, "the same words " * (k % 5)) for k in range(40)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    rows = alignment.score_links(alignment.alignments(docs, BYTE_FILE, PIECE_FILE))
    assert found_rows(rows) == sorted(plain_alignment(some, library), key=repr)
    assert alignment.score_links(alignment.alignments(awkward, BYTE_FILE, PIECE_FILE)).count() == awkward.count()
    assert alignment.score_links(alignment.alignments(nothing, BYTE_FILE, PIECE_FILE)).count() == 0


def test_chunks_do_not_change_scores(library, texts):
    """Small chunks: postings of many chunks, counted and returned, against one chunk."""
    left, right = alignment.side(alignment.ByteLevelSide, file(BYTE_FILE)), alignment.side(alignment.PieceSide, file(PIECE_FILE))
    held = [alignment._block([t or "" for _, t in texts[k:k + 9]], left, right, k)[1] for k in range(0, 90, 9)]
    whole, many = Counter(), len(right.bytes_of)
    for batch in alignment._postings(0, held, many):
        for row in batch.to_pylist():
            for place in alignment.places_of(row["bitmap"]).tolist():
                whole[row["pair"], place] += 1 << max(row["plane"], 0)
    by_loops = Counter()
    for keys, n_links in held:
        for key, n in zip(keys.tolist(), n_links.tolist()):
            a, b = divmod(key >> 16, many)
            by_loops[a << 32 | b, key & 0xFFFF] += n
    assert whole == by_loops and sum(whole.values()) > 1000


@given(st.lists(st.integers(0, 3000), min_size=1, unique=True), st.lists(st.integers(0, 70), min_size=1, unique=True))
@settings(deadline=None, max_examples=60)
def test_bitmaps(one, two):
    places = [sorted(one), sorted(two), list(range(200))]
    starts = np.cumsum([0, *map(len, places[:-1])])
    made = alignment.bitmaps(np.array(sum(places, [])), starts)
    assert [alignment.places_of(m).tolist() for m in made] == places
    assert [alignment.popcount(m) for m in made] == [len(p) for p in places]
    assert made[2][:1] == alignment.BITS and len(made[2]) == 26


# -- clusters --------------------------------------------------------------------------------------------------------


@given(st.lists(st.lists(st.sampled_from([0, 1, -1, 2, -2, 255, -256, 77, (1 << 27) - 1, -(1 << 27)]), min_size=64, max_size=64),
                min_size=1, max_size=5))
@settings(deadline=None, max_examples=60)
def test_planes(rows):
    values = np.array(rows, np.int64)
    planes = clustering.planes_of(values)
    assert (clustering.values_of(planes) == values).all()
    assert (clustering.dots(planes, planes) == values @ values.T).all()
    assert (clustering.squares(planes) == (values * values).sum(1)).all()


def plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centroids = [q for _, q in first]

    def assign():
        out = []
        for _, q in kept:
            far = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            members = [q for (_, q), (at, _) in zip(kept, own) if at == c]
            if members:
                centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((i, c, d) for (i, _), (c, d) in zip(kept, assign())), key=repr), centroids


def test_clusters_against_plain_python(spark):
    rng = random.Random(8)
    near = [[rng.choice([-1.0, 0.5, 0.25, 2.0]) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.choice([0, 0.01, -0.02]) for x in rng.choice(near)]) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (7, near[0]), (70, None), (71, near[0][:63]), (72, near[0] + [1.0]),
             (73, [None] + near[0][1:]), (74, [float("nan")] + near[0][1:]), (75, [float("inf")] + near[0][1:]), (76, [])]
    rows += [(100 + k, near[1]) for k in range(50)] + [(200, [1000.0] * 64)]
    df = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, planes string"
    ).repartition(4)
    mine, centroids = clustering.cluster(df, k=7, rounds=4)
    expected, own = plain_clusters(rows, 7, 4)
    assert centroids == own
    assert sorted(map(tuple, mine.select("vec_id", "cluster", "distance").collect()), key=repr) == expected


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(5, [0.5] * 64)], schema)
    rows, centroids = clustering.cluster(one)
    assert [tuple(r) for r in clustering.with_inertia(rows, centroids).collect()] == [
        (5, 0, 0, 0, 0, hashlib.sha256(",".join(["128"] * 64).encode()).hexdigest())
    ]
    rows, centroids = clustering.cluster(spark.createDataFrame([], schema))
    assert clustering.with_inertia(rows, centroids).collect() == []
    with pytest.raises(Exception, match="do not fit 64 bits"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema))


# -- packing ---------------------------------------------------------------------------------------------------------


@given(st.integers(0, 9000), st.sampled_from([2048, 100, 7]))
@settings(deadline=None)
def test_cuts(length, capacity):
    parts = packing.cuts(length, capacity)
    assert sum(parts) == length and all(1 <= p <= capacity for p in parts)
    assert len(parts) <= length // capacity + 8


def held_against(rows, docs, library, capacity=2048):
    """Pieces cover every document once, sequences are filled in order; returns tokens and padded length."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for doc_id, text in docs:
        ids = library[False].encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            raw = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padded += at if at & (at - 1) == 0 else capacity
    return sum(r.length for r in rows), padded


def test_op13_query(spark, library, texts):
    tokens, padded = held_against(QUERIES["op13_packing"](spark, ROOT).collect(), texts, library)
    assert padded < 1.02 * tokens


def test_packing_in_groups_of_tasks(spark, library, texts, monkeypatch):
    monkeypatch.setattr(packing, "TASKS_PER_GROUP", 3)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(11)
    rows = packing.pack(docs, BYTE_FILE).withColumn("ids_crc32", packing.F.crc32("ids")).drop("ids").collect()
    tokens, padded = held_against(rows, texts, library)
    assert padded < 1.02 * tokens
    counts = Counter(r.sequence_id for r in rows if r.sequence_id >> 56 == 0)
    for r in rows:
        if r.sequence_id >> 56 == 0:  # bins of tasks hold the fixed number of their class
            assert counts[r.sequence_id] == 2048 // r.length


def test_packing_of_awkward_rows(spark, awkward, pairs, nothing):
    rows = packing.pack(awkward, BYTE_FILE, capacity=64)
    kept = rows.collect()
    assert sum(r.length for r in kept) == sum(r.doc_tokens for r in kept if r.start == 0)
    assert sum(r.start == 0 for r in kept) == len(pairs)
    padded = packing.sequences(rows, 64, pad_id=9).collect()
    assert all(len(r.ids) == (4 * r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 256) for r in padded)
    assert all(sum(r.lengths) == r.n_tokens for r in padded)
    assert packing.pack(nothing, BYTE_FILE).count() == 0
