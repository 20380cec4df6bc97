import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fundweave.llm import jaccard_join as jj


def plain_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 85 * len(a | b)] for a in sets]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for (k, _), c in zip(rows, label, strict=True):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    return sorted((str(k), len(s), str(least.get(c))) for (k, _), s, c in zip(rows, sets, label, strict=True))


def rows():
    """Groups of near copies, some linked through others; a passage that unlike texts share; texts at and next to the threshold."""
    rng, texts = np.random.default_rng(9), []
    passage = [f"p{i}" for i in range(60)]
    for k in range(8):
        base = [f"w{x}" for x in rng.integers(0, 4000, 160)]
        for copy in range(14):
            w = list(base)
            for at in rng.choice(160, rng.integers(0, 7), replace=False):
                w[at] = f"e{k}x{copy}x{at}"
            texts.append(" ".join(w))
    texts += [" ".join([*passage, *(f"u{k}x{i}" for i in range(int(rng.integers(2, 80))))]) for k in range(60)]
    for n in range(1, 26):  # a text and its first words: n - 3 of n + m - 3 shingles in common
        texts += [" ".join(f"t{n}x{i}" for i in range(n)), " ".join(f"t{n}x{i}" for i in range(n + n // 6)).upper()]
    texts += [None, "", " \n", "one", "One", "one two", "a b c", "a b c d", "a b c d a b c d", "x " * 3000, "X " * 9, "É b c d e", "é b c d e"]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "z y x w v"), (None, "z y x w v")]


ROWS = rows()
DDL = "doc_id long, text string, size int, node string"


@pytest.mark.parametrize("wide,late", [(256, 32), (3, 32), (5, 2), (256, 10**9)])
def test_equals_brute_force(spark, monkeypatch, wide, late):
    """Also with blocks of a few nodes, and with many or no shingles that come late."""
    monkeypatch.setattr(jj, "LATE", late)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], DDL).repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join(docs, wide).collect())
    assert got == plain(ROWS)


def test_empty_table_and_one_row(spark):
    docs = spark.createDataFrame([(*ROWS[0], 1, "x")], DDL)
    assert jj.join(docs.limit(0)).count() == 0
    assert [tuple(r) for r in jj.join(docs).collect()] == [(0, len(plain_set(ROWS[0][1])), 0)]


def test_blocks_alone_find_all_links():
    """Without the rounds before them; nodes of different blocks only where there are two."""
    sets = [s for _, t in ROWS[:180] if len(s := jj.shingles(t))]
    nodes = list(range(len(sets)))
    some = jj._mixed(np.unique(np.concatenate(sets))[::7], 0) >> jj.CUT
    late = jj.Late(some, np.arange(len(some)) % 3 + 1)
    for block in ([0] * len(sets), [k % 2 for k in nodes]):
        got = jj.block_links(nodes, nodes, block, sets, late)
        label = np.arange(len(sets))
        for a, b in got:
            assert jj.linked(len(sets[a]), len(sets[b]), jj.overlap(sets[a], sets[b])) and (len(set(block)) == 1 or block[a] != block[b])
            label[label == label[b]] = label[a]
        for a in nodes:
            for b in nodes:
                if jj.linked(len(sets[a]), len(sets[b]), jj.overlap(sets[a], sets[b])) and (len(set(block)) == 1 or block[a] != block[b]):
                    assert label[a] == label[b]


def test_linked_sets_share_a_prefix_under_every_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 120), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.08], rng.integers(0, 2**64, rng.integers(0, 6), dtype=np.uint64)])
        if not len(b) or not jj.linked(len(a), len(b), jj.overlap(a, b)):
            continue
        late = jj.Late(jj._mixed(a[::3], 0) >> jj.CUT, np.arange(len(a[::3])) % 4 + 1)
        for k in range(jj.ORDERS + 1):
            for held in (None, late):
                assert np.isin(jj.prefix(a, k, held), jj.prefix(b, k, held)).any()


def test_linked_sets_share_enough_of_the_wide_prefix(spark):
    rng, n = np.random.default_rng(6), 400
    need = [r[0] for r in spark.range(n).select(jj.shared_at_least(jj.F.col("id"))).collect()]
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, n), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 2**64, rng.integers(0, 20), dtype=np.uint64)])
        if len(b) and jj.linked(len(a), len(b), jj.overlap(a, b)):
            both = np.isin(jj.prefix(a, 0, size=jj.wide_prefix_size(len(a))), jj.prefix(b, 0, size=jj.wide_prefix_size(len(b)))).sum()
            assert both >= max(need[len(a)], need[len(b)] if len(b) < n else 0)


def test_packing_keeps_the_words():
    for text in ("a", "a b c d e", "É  b\nc\td E", "x " * 5000):
        z = jj.zstandard.ZstdCompressor().compress(b" ".join(jj.words_of(text)))
        assert (jj.unpacked(z) == jj.shingles(text)).all()


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in ROWS])
    assert sorted((str(r[0]), r[1], str(r[2])) for r in con.execute(jj.SQL).fetchall()) == plain(ROWS)


def test_sets_whose_prefix_no_other_set_holds_meet_nobody(spark):
    """A family below the threshold: each text has a tenth to a fifth of shingles of its own. Only those with few enough stay, and they share what others hold."""
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(12):
        texts.append(" ".join([*base, *(f"u{k}x{i}" for i in range(24 if k < 6 else 60))]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "not wanted"])], "doc_id long, text string")
    size = F.when(F.col("doc_id") < 6, 221).otherwise(257).cast("long")
    want = docs.where("doc_id < 12").select(F.col("doc_id").alias("id"), size.alias("size"), F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_hash"))
    sets = jj.packed(docs, want)
    assert sets.count() == 12 and np.unpackbits(jj.marks(want)).sum() == 12
    got = {r.id: r for r in jj.with_lone(sets, jj.held_by(sets)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    for k, r in got.items():
        h, n = jj.common(r.z, r.lone)
        assert n == len(jj.shingles(texts[k])) and len(h) == 197 and len(r.lone) == n - 197
        for order in range(1, jj.ORDERS + 1):
            assert len(jj.prefix_of_common(h, n, order, jj.Late(np.empty(0, np.uint64), np.empty(0, np.int32)))) == jj.prefix_size(n) - len(r.lone)
    a, b = (jj.shingles(t) for t in texts[:2])
    assert not jj.linked(len(a), len(b), jj.overlap(a, b))
