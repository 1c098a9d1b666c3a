"""Registered queries: against their SQL, or against plain Python where SQL has no words for them."""

import base64
import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from statelake.llm.oracles import ORACLES
from statelake.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations embeddings".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{ROOT}/{name}.parquet')")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def by_id(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, ROOT).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, duck):
    df = QUERIES[name](spark, ROOT)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert mine == sorted(found.fetchall(), key=repr)


def test_op2_against_tiktoken(spark, texts):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(spark, "op2_bpe")
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = plain.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name, label, folds, held, bound", [
    ("op3_quality", "quality", 5, 0, 0.3), ("op6_toxicity", "toxic", 3, 1, 0.7),
])
def test_scores(spark, duck, texts, name, label, folds, held, bound):
    rows = by_id(spark, name)
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= bound)


def test_op3_and_op6_hold_out_accuracy(spark, duck):
    """At ten thousand documents the held-out rows are enough to say something."""
    root = "/root/testdata/sf0.1"
    for name, label, least in (("op3_quality", "quality", 0.96), ("op6_toxicity", "toxic", 0.95)):
        true = dict(duckdb.sql(f"select doc_id, {label} from '{root}/labels.parquet'").fetchall())
        rows = [r for r in QUERIES[name](spark, root).collect() if r.held_out and r.doc_id in true]
        assert sum(r.predicted == true[r.doc_id] for r in rows) >= least * len(rows)


def test_op5_law(spark, texts):
    rows = by_id(spark, "op5_sharding")
    assert rows.keys() == texts.keys()
    order = sorted(texts, key=lambda i: (hashlib.md5(texts[i].encode()).hexdigest(), i))
    total, before, slots = sum(len(t.encode()) + 1 for t in texts.values()), 0, [0] * 16
    for i in order:
        size = len(texts[i].encode()) + 1
        shard = before * 16 // total
        assert (rows[i]["size"], rows[i].text_crc32) == (size, zlib.crc32(texts[i].encode()))
        assert (rows[i].law, rows[i].shard, rows[i].slot, rows[i].grown_shard) == ("bytes", shard, slots[shard], None)
        before, slots[shard] = before + size, slots[shard] + 1


def test_op7_base_spans(spark, texts):
    import re

    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = by_id(spark, "op7_secret_scan")
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert {s for s in rows[i].spans.split(",") if s and "novel" not in s} == {s for s in base.split(",") if s}


def test_op8_against_all_pairs(spark, texts):
    from collections import Counter

    classes = all_pairs_classes(texts)
    sizes = Counter(classes.values())
    assert {i: (r.class_id, r.class_size, r.kept) for i, r in by_id(spark, "op8_near_dedup").items()} == {
        i: (c, sizes[c], i == c) for i, c in classes.items()
    }


def test_op1_against_plain_search(spark, duck, texts):
    items = duck.execute("select item_id, text from benchmark").fetchall()
    found = {(r.doc_id, r.item_id): r for r in QUERIES["op1_decontamination"](spark, ROOT).collect()}
    exact = {(i, k) for i, t in texts.items() for k, item in items if item.lower() in t.lower()}
    assert exact and exact <= found.keys()
    for (i, k), r in found.items():
        item = dict(items)[k].lower()
        assert edits(item, texts[i][r.start:r.end].lower()) == r.edits <= len(item) // 10


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_op10_read_back(spark, duck):
    rows = by_id(spark, "op10_chat_format", "conv_id")
    turns = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for i, role, text in duck.execute("select conv_id, role, coalesce(text, '') from conversations order by conv_id, turn").fetchall():
        turns.setdefault(i, []).append((role, text))
    assert rows.keys() == turns.keys()
    for i, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert rows[i].n_turns == len(said) and rows[i].loss_chars == len(loss)
        assert rows[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert rows[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def all_pairs_classes(texts):
    """Least id of the class of every id, by comparing all pairs."""
    from statelake.llm.near_dedup import WORD

    words = {i: WORD.findall(t.lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if texts[i] == texts[j] or shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, ROOT).columns == docs.columns


@pytest.mark.parametrize("given, most", [("10000", 1000), ("0", 1000), ("300", 300)])
def test_pipeline_sends_small_batches_to_python(spark, given, most):
    import corpus_pipeline

    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
    docs = session.read.parquet(f"{ROOT}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    corpus_pipeline.encoding_stage(session, docs, ROOT)
    rows = session.range(0, 2500, numPartitions=1).mapInArrow(sizes, "n long").collect()
    assert max(r["n"] for r in rows) == most and sum(r["n"] for r in rows) == 2500


def test_pipeline_against_plain_python(spark, duck, texts):
    """The whole chain by hand; only the scores of the trained classifier are taken from its own query."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    held = {i: texts[i] for i, r in by_id(spark, "op3_quality").items() if r.predicted == 1}
    first = {}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i in sorted(held):
        kept = []
        for line in held[i].split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(fold)
            if len(key) < 10 or first.setdefault(key, i) == i:
                kept.append(line)
        held[i] = "\n".join(kept)
    classes = all_pairs_classes(held)
    held = {i: t for i, t in held.items() if classes[i] == i}
    items = [t.lower() for t, in duck.execute("select text from benchmark").fetchall()]
    held = {i: t for i, t in held.items() if not any(item in t.lower() for item in items)}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, ROOT).collect()} == {
        i: plain.encode_ordinary(t) for i, t in held.items()
    }
