"""The operators on vectors against plain versions, on ordinary and on odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlens.llm import embedding_dedup, hard_negatives, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, q string, node int, _row string, score int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, "y", 2) for i, v, c in rows], SCHEMA).repartition(4)


def _sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _ints(v, scale=256):
    return [math.floor(scale * float(np.float32(x))) for x in v]


@pytest.fixture(scope="module")
def rows():
    """Ordinary vectors, copies, ties, nulls, non-finite components, empty and shorter vectors, null and repeated ids."""
    r = np.random.default_rng(5)
    out = [(i, r.normal(0, 0.2, 20).tolist(), int(r.integers(0, 4))) for i in range(300)]
    out += [(i, out[i % 7][1], i % 4) for i in range(300, 340)]
    out += [(400, None, 1), (401, [], 2), (402, [0.0] * 20, 1), (403, [None] + [0.1] * 19, 0), (404, [float("nan")] * 20, 3), (405, [float("inf")] + [0.0] * 19, 3),
            (406, [0.3] * 5, None), (407, [0.25] * 7, 2), (None, [0.125] * 20, 1), (408, [-0.0] * 20, 0), (14, [0.2] * 20, 1), (450, out[0][1], 9), (14, [0.2] * 20, 1)]
    return out


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def _negatives(rows, every, k, m):
    live = [(i, _ints(v), c) for i, v, c in rows if c is not None and _sound(v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (a, q, c) in enumerate(live):
        if a is None or a % every:
            continue
        scored = [(_dot(q, w), i, d) for j, (i, w, d) in enumerate(live) if j != n]
        for p, pi, _ in sorted((x for x in scored if x[2] == c), key=key)[:k]:
            hard = sorted((x for x in scored if x[2] != c and 50 * p <= 100 * x[0] <= 95 * p), key=key)[:m]
            out += [(a, pi, rank + 1, x[1], p, x[0]) for rank, x in enumerate(hard)]
    return sorted(out, key=repr)


def test_hard_negatives(spark, rows, monkeypatch):
    for block, chunk, sums in ((2048, 4096, 1 << 21), (50, 3, 1 << 8)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
        monkeypatch.setattr(hard_negatives, "SUMS", sums)
        df = _frame(spark, rows)
        out = hard_negatives.mine_hard_negatives(df, df["vec_id"] % 10 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        got = sorted((tuple(x) for x in out.collect()), key=repr)
        assert got == _negatives(rows, 10, 5, 3) and len(got) > 100
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine_hard_negatives(_frame(spark, [(0, [1e9], 1)]), F.lit(True)).collect()


def test_scores_of_bit_planes():
    r = np.random.default_rng(1)
    for width, most, dtype in ((1, 1, np.int32), (8, 130, np.int32), (19, 5000, np.int64)):
        a, c = r.integers(-most, most + 1, (7, width)), r.integers(-most, most + 1, (50, width))
        tables = hard_negatives.subset_sums(a.astype(dtype), -(-width // 8), dtype)
        assert np.array_equal(hard_negatives.scores(tables, hard_negatives.planes(c, most.bit_length() + 1)), c @ a.T)


def _codes(rows, parts, entries, rounds, width):
    pad = lambda q: q + [0] * (parts * width - len(q))
    live = sorted(((i, c, _ints(v)) for i, v, c in rows if _sound(v)), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    q = np.array([pad(x[2]) for x in live]).reshape(len(live), parts, width)
    books = q[:entries].copy()
    for k in range(rounds + 1):
        far = ((q[:, None] - books[None]) ** 2).sum(axis=3)  # rows, entries, parts
        near = far.argmin(axis=1)
        if k < rounds:
            for e in range(len(books)):
                for p in range(parts):
                    if (mine := near[:, p] == e).any():
                        books[e, p] = q[mine, p].sum(axis=0) // mine.sum()
    error, by_label = far.min(axis=1).sum(axis=1).tolist(), defaultdict(int)
    for (_, c, _), x in zip(live, error):
        by_label[c] += x
    return sorted(((i, bytes(n.tolist()).hex(), x, by_label[c]) for (i, c, _), n, x in zip(live, near, error)), key=repr), vector_codes.digest(books.transpose(1, 0, 2))


def test_vector_codes(spark, rows):
    df = _frame(spark, rows)
    for parts, entries, rounds in ((5, 16, 2), (16, 64, 2), (3, 256, 1), (20, 3, 0)):
        width = -(-20 // parts)
        out = vector_codes.encode_vectors(df, parts=parts, entries=entries, rounds=rounds).collect()
        want, sha = _codes(rows, parts, entries, rounds, width)
        assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=repr) == want
        assert {r.codebooks_sha256 for r in out} == {sha}
    assert vector_codes.encode_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(df, entries=257)


def test_walsh_and_ties():
    h = vector_codes.walsh(8)
    assert np.array_equal(h @ h.T, 8 * np.eye(8)) and [int((x[1:] != x[:-1]).sum()) for x in h] == list(range(8))
    r = np.random.default_rng(2)
    x, e = r.integers(-3, 4, (500, 3)), r.integers(-3, 4, (30, 3))  # many ties
    far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    entry, d = vector_codes.nearest(x, e, vector_codes.walsh(4))
    assert np.array_equal(entry, far.argmin(axis=1)) and np.array_equal(d, far.min(axis=1))


def _linked(rows, threshold):
    unit = []
    for _, v, _ in rows:
        x = np.zeros(20)
        if _sound(v):
            x[: len(v)] = np.asarray(v, np.float32)
        unit.append(x / np.linalg.norm(x) if x.any() else x)
    near = np.array(unit) @ np.array(unit).T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        root[find(i)] = find(j)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        least[find(i)].append(row[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(rows[i][0], int(near[i].sum()), least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows))]


def test_near_vectors(spark, rows, monkeypatch):
    r = np.random.default_rng(9)
    centre, chain = r.normal(0, 1, 20), r.normal(0, 1, 20)
    more = [(1000 + i, (centre + r.normal(0, s, 20)).tolist(), 1) for i, s in enumerate(np.linspace(0.01, 0.3, 260))]  # a core, a rim, strays
    more += [(2000 + i, (chain * (1 - i / 60) + centre * i / 60).tolist(), 1) for i in range(60)]  # each near the next only
    more += [(3000 + i, [1e-30 * (j + 1) for j in range(20)], 1) for i in range(5)] + [(3100, [1e30 * (j + 1) for j in range(20)], 1)]
    every = rows + more
    want = _linked(every, 0.95)
    for whole, cell in ((2048, 2048), (20, 2048), (20, 30)):  # the other ways count crowds by their cores
        monkeypatch.setattr(embedding_dedup, "WHOLE", whole)
        monkeypatch.setattr(embedding_dedup, "CELL", cell)
        out = embedding_dedup.near_vectors(_frame(spark, every))
        assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
        got = [tuple(x) for x in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_vectors(_frame(spark, every).limit(0)).count() == 0
    assert {tuple(x) for x in embedding_dedup.near_vectors(_frame(spark, [(None, None, 1), (3, [], 1)])).collect()} == {(None, 0, None, True), (3, 0, 3, True)}


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold, the hardest to bring together, and no others."""
    r = np.random.default_rng(4)
    rows, turn = [], math.acos(0.951)
    for i in range(1500):
        a, b = r.normal(0, 1, (2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (a * math.cos(turn) + b * math.sin(turn)).tolist(), 0)]
    out = {x.vec_id: x for x in embedding_dedup.near_vectors(_frame(spark, rows)).collect()}
    found = sum(out[2 * i + 1].component_id == 2 * i for i in range(1500))
    assert found >= 0.93 * 1500
    assert all(x.component_id in (x.vec_id, x.vec_id - x.vec_id % 2) and x.n_links <= 1 for x in out.values())
    # more vectors, more passes
    assert [embedding_dedup.passes_for(n, 0.95) for n in (10, 10**4, 10**7)] == sorted({embedding_dedup.passes_for(n, 0.95) for n in (10, 10**4, 10**7)})


def test_registered(spark):
    data = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    queries = __spark_entry__.queries()
    noisy = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in data]
    assert sorted((tuple(x) for x in queries["op11_hard_negatives"](spark, SF).collect()), key=repr) == _negatives(noisy, 50, 5, 3)
    want, sha = _codes(data, 16, 64, 2, 4)
    out = queries["op12_vector_codes"](spark, SF).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=repr) == want and {r.codebooks_sha256 for r in out} == {sha}
    assert {tuple(x) for x in queries["op13_near_vectors"](spark, SF).collect()} == {(i, 0, i, True) for i, _, _ in data}
