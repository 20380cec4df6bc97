import hashlib
import zlib

import duckdb
import pytest

from fundweave.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string, top int, level0 string"


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return plain_hash(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def plain_tree(leaves):
    """The top, and for each leaf its siblings (left, right) level by level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, way in enumerate(ways):
            run = at[k] // 8 * 8
            way.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 8])))
            at[k] //= 8
        level = [plain_hash(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], ways


def plain(rows):
    langs = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4]))):
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([plain_leaf(r, r[4]) for r in langs[g]]) for g in order}
    root, over = plain_tree([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, over, strict=True):
        for row, own in zip(langs[g], trees[g][1], strict=True):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf(row, text)
            for left, right in own + upper:
                node = plain_hash(left, node, right)
            out.append((str(row[0]), plain_leaf(row, row[4]), trees[g][0], root, plain_hash(*(x + y for x, y in own + upper)), node, node == root))
    return sorted(out)


ROWS = [(k, "s", "en", 3, f"Text {k}") for k in range(75)] + [(k, None, None, None, None if k % 2 else "") for k in range(9)] + [(7, "s", "", 1, "É ß"), (8, "s", "de", 1, "Ab " * 50_000), (8, "s", "de", 1, "Ab " * 50_000), (None, "s", "de", 1, "Null id"), (None, None, "zz", None, None)]
ROWS += [(100 + k, "s", f"l{k}", 1, "Abc") for k in range(10)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_brute_force(spark, levels):
    """Nulls in every column, repeats, ties, empty and long texts, ten langs of one row, clashing extra columns; several rounds of blocks."""
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], DDL).repartition(3)
    rows = merkle.manifest(docs, levels)
    from pyspark.sql import functions as F

    got = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(), merkle.fold(F.coalesce("changed", "leaf"))).collect()
    assert sorted((str(r[0]), *r[1:], r[5] == r[3]) for r in got) == plain(ROWS)
    assert merkle.manifest(docs.limit(0)).count() == 0 and merkle.manifest(docs.limit(1)).count() == 1


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    rows = [r for r in ROWS if r[0] is not None]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted((str(r[0]), *r[1:]) for r in con.execute(merkle.sql()).fetchall()) == plain(rows)
