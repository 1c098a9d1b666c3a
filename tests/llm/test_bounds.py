"""Bounds of memory and of models: repetitive texts, short items, many tokens, late parts of long texts."""

import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from statelake.llm import decontaminate, quality


def fewest_edits(text, pattern):
    """Edits of the best place of `pattern` in `text`."""
    before = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        now = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            now[j] = min(before[j - 1] + (text[j - 1] != pattern[i - 1]), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def test_leaks_with_all_kinds_of_edits():
    rng = random.Random(2)
    for _ in range(120):
        m, letters = rng.choice([20, 25, 40, 80]), rng.choice(["ab", "abcd", "abcdefghijklmnop ", "_"])
        item = "".join(rng.choice(letters) for _ in range(m))
        place = list(item)
        for _ in range(rng.randint(0, int(m * 0.13) + 1)):
            at, kind = rng.randrange(len(place)), rng.randrange(3)
            if kind == 0:
                place[at] = rng.choice("xyz")
            elif kind == 1:
                place.insert(at, rng.choice("xyz"))
            else:
                del place[at]
        ends = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(2)]
        text = ends[0] + "".join(place) + ends[1]
        found, edits = decontaminate.Index([(1, item)]).find_in([text])[0], fewest_edits(text, item)
        assert bool(found) == (edits <= m // 10)
        if found:
            assert min(h[3] for h in found) == edits
            assert all(fewest_edits(text[h[1]:h[2]], item) <= h[3] for h in found)


def test_repetitive_text_stays_small():
    item = "question number one: " + "_" * 80 + " please write the answer of the second exercise into the field above"
    index = decontaminate.Index([(1, item), (2, "- " * 30), (3, "-- x " * 9)])
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    for text in ("_" * 300_000, "- " * 100_000 + "y", "abc " * 100_000):
        index.regions(decontaminate.folded(text))
    assert index.find_in(["_" * 60_000 + item + "_" * 40_000])[0] == [(0, 60_000, 60_000 + len(item), 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert time.time() - start < 60


def test_many_items_share_a_run(monkeypatch):
    items = [(k, f"item {k} has a line " + "=" * 60 + f" and an end {k * k} of its own") for k in range(60)]
    text = "=" * 500 + "".join(t for _, t in items[7:9]) + "=" * 500
    found = decontaminate.Index(items).find_in([text])[0]
    monkeypatch.setattr(decontaminate, "MATCHES", 50)
    assert decontaminate.Index(items).find_in([text])[0] == found
    assert {h[0] for h in found if h[3] == 0} == {7, 8}


def test_short_items_stand_between_word_ends(spark):
    docs = spark.createDataFrame(
        [(1, "Say YES please"), (2, "yesterday and eyes"), (3, "the answer is forty-two."), (4, "the answers forty-twos"), (5, "?!"), (6, "yes")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, "yes"), (2, "forty-two"), (3, "?!"), (4, ""), (5, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.edits, r.short) for r in decontaminate.hits(docs, bench).collect()}
    assert found == {(1, 1, 0, True), (6, 1, 0, True), (3, 2, 0, True), (5, 3, 0, True)}
    assert decontaminate.clean(docs, bench).count() == 6
    assert {r.doc_id for r in decontaminate.clean(docs, bench, with_short=True).collect()} == {2, 4}


def test_pieces_come_from_the_whole_length(spark):
    size = quality.PIECE_BYTES
    text = "".join(str(k) * size for k in range(9)) + "end"
    rows = [(i, text) for i in range(200)] + [(200, "short"), (201, "x" * size)]
    found = {r.id: [bytes(p).decode() for p in r.p] for r in spark.createDataFrame(rows, "id long, text string").select(
        "id", quality.drawn_pieces("id", "text").alias("p")).collect()}
    assert found[200] == ["short"] and found[201] == ["x" * size]
    drawn = [p for i in range(200) for p in found[i]]
    assert {p[0] for p in drawn} == set("012345678e") and len(drawn) == 200 * quality.PIECES
    assert all(p == "end" or p == p[0] * size for p in drawn) and all(found[i] == sorted(found[i]) for i in range(200))
