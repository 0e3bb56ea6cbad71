"""Fill-in-middle, sharding by histogram sort and the prefix trie against brute force on odd, repeated and large rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import infill, sharding, trie

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ------------------------------------------------------------------ fill in the middle


def test_runs_and_cuts_of_many_small_texts():
    rng = random.Random(1)
    for _ in range(400):
        texts = ["".join(rng.choice("ab \n\té中\U0001f600 <\x0b") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(5))]
        raw = [t.encode() for t in texts]
        data, at = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw])
        for units in ("words", "points"):
            tokens = [TOKEN.findall(t) if units == "words" else list(t) for t in texts]
            runs = infill.Runs(data, at, units)
            assert list(runs.units) == [len(t) for t in tokens]
            u = np.array([rng.randrange(len(t) + 1) for t in tokens], dtype=np.int64)
            byte, point = runs.cut(u)
            heads = ["".join(t[:k]) for t, k in zip(tokens, u, strict=True)]
            assert list(point) == [len(h) for h in heads] and list(byte) == [len(h.encode()) for h in heads]


def infill_by_hand(doc_id, text):
    text = text or ""
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}".encode())[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, sha(text.encode()), sha(text.encode())
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(tokens), "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), sha(out.encode()), sha(text.encode())


def test_infill_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["word", "é中", "\U0001f600x", "<", "<P", "S>", "\n"]) for _ in range(rng.randrange(30)))) for k in range(300)]
    rows += [(None, "null id <b> text"), (7, None), (8, ""), (9, "has <M> inside"), (10, " \t "), (11, "a" * 300_000), (12, "ab " * 400_000), (13, "<P"), (13, "<P"), (-5, "negative id, two rows"), (-5, "negative id, two rows")]
    df = spark.createDataFrame([(a, b, k, "x") for k, (a, b) in enumerate(rows)], "doc_id long, text string, infill int, n string").repartition(3)
    got = sorted(map(tuple, infill.fill_in_middle(df).collect()), key=str)
    assert got == sorted((infill_by_hand(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    out, name = infill.rearranged(df)
    assert out.columns == ["doc_id", "text", "infill", "n", "infill_"] and name == "infill_"
    assert sorted((r.infill, r.text) for r in out.collect() if r.text is not None) == [(k, b) for k, (_, b) in enumerate(rows) if b is not None]
    assert infill.fill_in_middle(df.where("false")).collect() == []


def test_infill_of_code_points_and_other_marks(spark):
    df = spark.createDataFrame([(k, "aé中\U0001f600 b" * (k % 7)) for k in range(60)], "doc_id long, text string")
    out, m = infill.rearranged(df, marks=("[pre]", "[suf]", "[mid]"), rate=100, spm_rate=50, units="points")
    rows = out.select("text", f"{m}.*", infill.restored(F.col(f"{m}.output"), F.col(f"{m}.form"), ("[pre]", "[suf]", "[mid]")).alias("back")).collect()
    assert all(r.back == r.text and r.n == len(r.text) for r in rows)
    assert {r.form for r in rows if r.text} == {"psm", "spm"}


# ------------------------------------------------------------------ shards


def digit(x):
    return -1 if x is None else int(hashlib.md5(str(x).encode()).hexdigest()[:15], 16)


def shards_by_hand(rows, n, together=0.02):
    """Each row where its middle lies in the order of text and id; copies of few bytes where their middle lies."""
    sized = sorted(((digit(t), digit(i), len((t or "").encode()) + 1, i, t) for i, t in rows), key=lambda r: r[:3])
    total = sum(r[2] for r in sized)
    copies = defaultdict(int)
    for r in sized:
        copies[r[0]] += r[2]
    out, below, first = [], 0, {}
    for a, _, size, i, t in sized:
        start = first.setdefault(a, below)
        middle = 2 * start + copies[a] if copies[a] * n <= together * total else 2 * below + size
        out.append((i, size, zlib.crc32((t or "").encode()), middle * n // (2 * total)))
        below += size
    return out


def checked(got, rows, n):
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32, r.shard) for r in got))) == sorted(map(str, shards_by_hand(rows, n)))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}


def test_shards_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, "x" * int(rng.expovariate(0.01))) for k in range(500)] + [(k, "one copied text of some length " * 3) for k in range(500, 900)]
    rows += [(None, None), (None, "null id"), (1000, None), (1001, ""), (-3, "é中 negative"), (4, "a second text of id 4"), (1002, "long " * 2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    checked(sharding.sharded(df).collect(), rows, 8)
    assert sharding.sharded(df.where("false")).collect() == []
    checked(sharding.sharded(df.where("doc_id = 1001")).collect(), [(1001, "")], 8)


def test_shards_of_rows_that_a_third_repeats(spark):
    rng = random.Random(4)
    rows = [(k, "y" * rng.randrange(200)) for k in range(600)] + [(5, "z" * 90)] * 900 + [(None, None)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.sharded(df).collect()
    checked(got, rows, 8)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 201


def test_shards_keep_other_columns_and_take_other_orders(spark):
    df = spark.createDataFrame([(k % 3, f"t{k}", k, "b") for k in range(400)], "doc_id long, text string, shard_bucket int, sharding string")
    out, name = sharding.shards(df, n_shards=3, digits=[F.col("shard_bucket")], tolerance=0.01)
    assert out.columns == [*df.columns, "sharding_"] and name == "sharding_"
    got = sorted(out.select("shard_bucket", "sharding_.shard", "sharding_.slot").collect())
    assert [(r.shard, r.slot) for r in got] == sorted((r.shard, r.slot) for r in got), "the order of the digit"
    sizes = [sum(len(f"t{r.shard_bucket}") + 1 for r in got if r.shard == s) for s in range(3)]
    assert max(sizes) < 1.03 * min(sizes)


def test_shards_use_no_python_and_exchange_texts_once(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k % 50}") for k in range(2_000)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    out = sharding.sharded(spark.read.parquet(str(tmp_path / "d")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan and plan.count("Exchange hashpartitioning(shard_bucket") == 1


# ------------------------------------------------------------------ prefix trie


def trie_by_hand(sequences):
    """{id: [(label, weight)]} to node rows, by prefix."""
    members = defaultdict(list)
    for i, s in sequences:
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append((i, len(s) == d))
    out = []
    for k, who in members.items():
        below = [x for x in members if x[: len(k)] == k]
        out.append((
            min(i for i, _ in who), len(k), min(i for i, _ in members[k[:-1]]) if k else None, len(who), sum(x[:-1] == k and len(x) == len(k) + 1 for x in below), sum(not any(y[:-1] == x and len(y) == len(x) + 1 for y in below) for x in below),
            sum((len(members[x]) - 1) * x[-1][1] for x in below if x), sha(",".join(str(i) for i in sorted(i for i, end in who if end)).encode()),
        ))
    return sorted(out, key=str)


def as_sequences(spark, sequences, parts=7):
    rows = [(i, b"".join(hashlib.md5(str(label).encode()).digest() for label, _ in s), [w for _, w in s]) for i, s in sequences]
    return spark.createDataFrame(rows, "id long, key binary, weights array<long>").repartition(parts)


@pytest.mark.parametrize("seed", range(4))
def test_trie_over_many_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_BLOCK", 2)
    rng = random.Random(seed)
    letters = [(x, len(x)) for x in ("a", "bb", "ccc")][: 1 + seed % 3]
    sequences = [(i, [rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))]) for i in rng.sample(range(-500, 500), 60 + 40 * seed)]
    if seed == 3:  # each a prefix of the next, and one that a third repeats
        sequences += [(1_000 + i, [("chain", 2)] * i) for i in range(50)] + [(2_000 + i, [("hot", 7)] * 4) for i in range(100)]
    got = sorted(map(tuple, trie.trie_nodes(as_sequences(spark, sequences)).collect()), key=str)
    assert got == trie_by_hand(sequences)


def test_trie_of_few_sequences(spark):
    for sequences in ([(5, [])], [(5, [("a", 1)])], [(5, []), (4, [])], [(9, [("a", 3), ("b", 2)]), (2, [("a", 3), ("b", 2)])]):
        assert sorted(map(tuple, trie.trie_nodes(as_sequences(spark, sequences, 1)).collect()), key=str) == trie_by_hand(sequences)
    assert trie.trie_nodes(as_sequences(spark, [(1, [])]).where("false")).collect() == []


def test_trie_of_conversations_with_nulls(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", None, "", "é" * 9])) for c in [*range(-120, 30, 7), *range(100, 260, 3), 100, 200, 0] for _ in range(rng.randrange(1, 9))]
    rows += [(c, 1, "user", "hi") for c in range(901, 915)]  # no first conversation, and mostly fewer turns than are shared
    rows += [(100, 3, "user", "tie"), (100, 3, "user", "tie"), (None, 1, "user", "of nobody"), (103, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    sequences = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        sequences.append((c, [((r, t), len(t)) for r, t in own.get(base, [])[:h] + turns[h:]]))
    got = sorted(map(tuple, trie.prefix_trie(df).collect()), key=str)
    assert got == trie_by_hand(sequences)
    assert any(not s for _, s in sequences), "a turnless conversation is among them"
    assert trie.prefix_trie(df.where("false")).collect() == []
