import hashlib
import zlib

import numpy as np
import pytest

from fundweave.llm import runs


def plain_lyndon(w):
    """End of the longest Lyndon word at each position: the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]


def plain_runs(w):
    out, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e - s + q >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(s, e + q - d)) for d in range(1, q)):
                out.add((s, e - s + q, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = np.random.default_rng(3)
    for _ in range(400):
        k, n = rng.integers(1, 5), rng.integers(0, 60)
        yield rng.integers(0, k, n).tolist()
    for _ in range(200):
        w = []
        while len(w) < 80:
            w += rng.integers(0, 6, rng.integers(0, 6)).tolist() + rng.integers(0, 3, rng.integers(1, 6)).tolist() * int(rng.integers(1, 7))
        yield w
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    yield b
    yield [0] * 500
    yield (list(range(40)) * 9)[:345]


def test_lyndon_array_equals_next_smaller_suffix():
    for w in texts():
        for v in (w, [max(w, default=0) - x for x in w]):
            assert runs.lyndon([0, *(x + 1 for x in v)])[1:] == [e + 1 for e in plain_lyndon(v)]


@pytest.mark.parametrize("collide", [False, True])
def test_runs_equal_brute_force(monkeypatch, collide):
    """One by one and all in one block; also where all hashes are alike."""
    if collide:
        monkeypatch.setattr(runs, "PRIMES", (7, 5))
    all_texts = list(texts())
    for w in all_texts:
        assert list(map(tuple, runs.find(np.array(w, np.int64), np.zeros(len(w), np.int64)).tolist())) == plain_runs(w), w
    ends = np.cumsum([len(w) for w in all_texts])
    got = runs.find(np.concatenate([np.array(w, np.int64) for w in all_texts]), np.repeat(np.arange(len(all_texts)), [len(w) for w in all_texts]))
    want = [(s + int(e) - len(w), n, q) for w, e in zip(all_texts, ends, strict=True) for s, n, q in plain_runs(w)]
    assert list(map(tuple, got.tolist())) == want


def plain(doc_id, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (str(doc_id), len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query_equals_brute_force(spark, tmp_path):
    """Given documents; nulls, empty and long texts, repeats, odd white space, a clashing extra column; an empty table."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 8000").collect()]
    odd = [(None, "a b " * 9), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "x y x y\n" * 8), (1003, "x y x y\n" * 8), (1004, "É z\x1c " * 300)]
    odd += [(k, " ".join(map(str, w))) for k, w in enumerate(texts(), 2000)][::7]
    docs = spark.createDataFrame([(*r, 1) for r in real + odd], "doc_id long, text string, runs int").repartition(3)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = runs.op12_runs(spark, f"{tmp_path}/a").collect()
    assert sorted(map(repr, ((str(r[0]), *r[1:]) for r in got))) == sorted(repr(plain(*r)) for r in real + odd)
    assert runs.op12_runs(spark, f"{tmp_path}/b").count() == 0


def test_long_text(spark):
    text = "head " + "a b c " * 100_000 + "tail " + " ".join(f"w{k % 5000}" for k in range(30_000))
    row = runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 300_000, 3), (300_002, 30_000, 5000)]
    assert row.collapsed == "head a b c tail " + " ".join(f"w{k}" for k in range(5000))
