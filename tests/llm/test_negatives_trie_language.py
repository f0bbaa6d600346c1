"""Hard negatives, the prefix trie and language profiles against brute force, and their defined cases."""

import collections
import hashlib
import heapq
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF

from fleetlens.llm import hyperdim, negatives, queries, trie


def sql_rows(query, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return collections.Counter(con.sql(query).fetchall())


# ---------------------------------------------------------------- hard negatives
VECTORS = "vec_id bigint, embedding array<double>, label int, rank int, block int, q string, aid string"


def brute_negatives(rows, k=5):
    usable = set()
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            q = tuple(int(np.floor(256 * v)) for v in x)
            usable.add((i, (label + 1) % 10 if i % 7 == 0 else label, q + (0,) * (8 - len(q))))
    out = collections.Counter()
    for a, own, x in (r for r in usable if r[0] % 100 == 0):
        scored = sorted((-sum(u * v for u, v in zip(x, y)), i, label) for i, label, y in usable if i != a)
        for minus, positive, _ in [s for s in scored if s[2] == own][:k]:
            fit = [(s, i) for s, i, label in scored if label != own and -80 * minus <= -100 * s <= -100 * minus]
            for rank, (s, i) in enumerate(fit[:k], 1):
                out[a, positive, rank, i, -minus, -s] += 1
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8)) * 2
    rows = [(i, (middles[i % 12] + rng.normal(size=8) * 0.3).tolist(), int(rng.integers(0, 4))) for i in range(1200)]
    return rows + [rows[100], rows[105], (1300, [0.5] * 3, 1), (1301, None, 1), (1302, [0.1, None], 1), (1303, [float("nan")] * 8, 2), (1304, [1.0] * 8, None), (None, [1.0] * 8, 2), (1400, [], 3), (1500, [0.0] * 8, 0)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("rows_per_block", [1024, 16])
def test_negatives_equal_brute_force(spark, clustered, rows_per_block):
    found = negatives.mine(vectors(spark, clustered), rows_per_block=rows_per_block).collect()
    assert collections.Counter(map(tuple, found)) == brute_negatives(clustered)


def test_zone_maps_exclude_blocks(spark, clustered):
    rows = negatives.scaled(vectors(spark, clustered), 256, 7, 10)
    width, mean, deviation = negatives._spread(rows)
    blocks = negatives.write_blocks(rows, width, mean, deviation, 16)
    one = np.array([r.q + [0] * (width - len(r.q)) for r in rows.where("vec_id = 100").select("q").collect()][:1], np.int64)
    got = blocks.collect()
    lo, hi = (np.stack([np.frombuffer(r[c], np.int64) for r in got]) for c in ("lo", "hi"))
    low, high = negatives.bounds(one, lo, hi)
    inside = 0
    for j, r in enumerate(got):
        q = np.frombuffer(r["q"], f"<i{r['size']}").reshape(r.n, -1).astype(np.int64)
        scores = q @ one[0]
        assert low[0, j] <= scores.min() and scores.max() <= high[0, j] and r.label_lo <= r.label_hi
        inside += high[0, j] >= np.sort(np.concatenate([np.frombuffer(x["q"], f"<i{x['size']}").reshape(x.n, -1).astype(np.int64) @ one[0] for x in got]))[-5]
    assert sum(r.n for r in got) == len({str(r) for r in rows.collect()}) and inside < len(got) / 2  # most blocks need no reading


def test_hilbert_is_a_path():
    points = np.array([*itertools.product(range(8), repeat=3)])
    place = negatives.hilbert(points, 3)
    assert sorted(place) == [*range(512)] and (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_op11(spark):
    want = sql_rows(negatives.ORACLE, {"embeddings": f"{SF}/embeddings.parquet"})
    assert collections.Counter(map(tuple, queries.op11_hilbert_negatives(spark, SF).collect())) == want
    assert negatives.mine(vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0


# ---------------------------------------------------------------- prefix trie
TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, part int, total string, k1 string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, totals = collections.Counter(), {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode("utf-8").split()) if node else 0
        leaves = sum(totals[x][0] for x in children[node]) or 1
        saved = sum(totals[x][1] for x in children[node]) + (len(members[node]) - 1) * words
        totals[node] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], TURNS).repartition(5)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a b", "c", "", "long text\there"])) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(9)]  # copies
    rows += [(400, t, "user", f"word {t}") for t in range(40)] + [(-21, 3, None, None), (-20, 1, "user", "a b"), (None, 1, "user", "x")]
    return rows + [(7, None, None, "null turn"), (7, None, None, "null turn"), (7, 1, "user", None), (8, 2, "tie", "b"), (8, 2, "tie", "a"), (9, 1, "user", "é€😀 " * 20_000)]


@pytest.mark.parametrize("block,memory", [(trie.BLOCK, trie.MEMORY), (3, 4), (1, 1)])
def test_trie_equals_brute_force(spark, talks, block, memory):
    found = trie.prefix_trie(conversations(spark, talks), block, memory).collect()
    assert collections.Counter(map(tuple, found)) == brute_trie(talks)


def test_spilling_queue_is_ordered():
    rng, queue, plain = random.Random(1), trie.SpillingQueue(7), []
    for step in range(3000):
        if plain and rng.random() < 0.45:
            assert queue.peek() == plain[0] and queue.pop() == heapq.heappop(plain)
        else:
            m = (rng.randint(-50, 0), rng.randint(-(2**62), 2**62), step, 1, 2, 3)
            queue.push(m)
            heapq.heappush(plain, m)
    while plain:
        assert queue.pop() == heapq.heappop(plain)
    assert queue.peek() is None


def test_op12(spark):
    want = sql_rows(trie.ORACLE, {"conversations": f"{SF}/conversations.parquet"})
    assert collections.Counter(map(tuple, queries.op12_prefix_trie(spark, SF).collect())) == want
    given = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in given]) == want
    assert trie.prefix_trie(conversations(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


# ---------------------------------------------------------------- languages
DOCS = "doc_id bigint, text string, lang string, source string, score double, held_out int, key string"


def brute_vector(text):
    letters = [c if c.isalpha() else " " for c in text.lower()]
    line = " " + " ".join("".join(letters).split(" ")).strip() + " "
    while "  " in line:
        line = line.replace("  ", " ")
    total = np.zeros(hyperdim.DIMENSIONS, np.int64)
    for a, b, c in zip(line, line[1:], line[2:]):
        total += np.roll(hyperdim.letter_vector(ord(a)), 2).astype(np.int64) * np.roll(hyperdim.letter_vector(ord(b)), 1) * hyperdim.letter_vector(ord(c))
    return total


def test_languages_equal_brute_force(spark):
    rows = [(i, t, l, "s", 0.5, 1, "k") for i, (t, l) in enumerate([
        ("The cat sat on the mat, and the dog ran.", "en"), ("Der Hund und die Katze sind im Haus.", "de"), ("und der Mann ist nicht da", "de"),
        ("the end of the day", None), (None, "en"), ("", "de"), ("12 !? 3", "fr"), ("x", "en"), ("Ça va? ÉTÉ ı", "fr"), ("the cat " * 30_000, None), ("日本語 abc", "ja"), ("the cat", "en"),
    ])] + [(None, "der die das", "de", None, None, None, None), (3, "the end of the day", None, "s", 0.5, 1, "k")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    languages = {}
    for i, text, lang, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang and text and any(c.isalpha() for c in text):
            languages[lang] = languages.get(lang, 0) + brute_vector(text)
    learned = hyperdim.learn(docs.where(~hyperdim.held_out(docs["doc_id"])))
    assert {k: v.tolist() for k, v in learned.items()} == {k: v.tolist() for k, v in languages.items()}
    found = collections.Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in hyperdim.identified(docs).collect())
    want = collections.Counter()
    for i, text, *_ in rows:
        out = ("und", 0.0)
        if text and any(c.isalpha() for c in text):
            v = brute_vector(text)
            cosine = {k: float(v @ u) / np.sqrt(float(v @ v) * float(u @ u)) for k, u in languages.items()}
            best = min(cosine, key=lambda k: (-cosine[k], k))
            out = (best, round(max(0.0, cosine[best]), 9))
        want[i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, *out] += 1
    assert found == want
    nothing = hyperdim.identified(docs.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)} and hyperdim.identified(docs.limit(0)).count() == 0


def test_op13_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op13_hyperdimensional_language(spark, folder)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    held = [r.lang_pred == lang[r.doc_id] for r in found.collect() if r.held_out]
    assert found.count() == len(lang) and sum(held) >= 0.98 * len(held)
