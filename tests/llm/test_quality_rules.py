"""Quality rules: fences that follow their group, against the SQL and on small cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fundweave.llm import quality_rules as q

SF = "/root/testdata/sf0.1"


def words(n, size, rng):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), max(1, int(size + d)))) for d in rng.integers(-1, 2, n))


@pytest.fixture(scope="module")
def judged(spark):
    return q.judge(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()


def test_fences_differ_and_no_constant_gives_the_same_verdicts(judged):
    good = judged[~judged.base_failed]
    off = {}
    for f, low in [(f, False) for f in q.RULES] + [(f, True) for f in q.LOWER_FENCED]:
        fence = good[("lo_" if low else "hi_") + f]
        assert good.assign(x=fence).groupby(["lang", "source"]).x.first().nunique() >= 20, f
        over = (lambda x, v=good[f], low=low: (v < x) if low else (v > x))
        out = over(fence)
        # a constant's verdicts change at a value of the feature only
        off[f, low] = min(int((out != over(x)).sum()) for x in np.unique(np.r_[good[f], fence]))
    assert off["dup_line_ratio", False] >= 5 and off["repeat_ratio", False] >= 10 and off["mean_word_chars", True] >= 20, off
    assert not good[good.kept & (good.symbol_ratio > 0.2)].shape[0]


def test_equals_sql_and_labels(judged):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(q.sql()).df().set_index("doc_id").kept
    got = judged.set_index("doc_id").kept
    assert len(got) == len(want) and (got.sort_index() == want.sort_index()).all()
    labels = c.sql("SELECT doc_id, quality FROM labels").df().set_index("doc_id").quality
    passed = judged[~judged.base_failed].set_index("doc_id").join(labels, how="inner")
    assert not passed[passed.quality == 0].kept.any() and passed[passed.quality == 1].kept.mean() > 0.99


def test_a_text_is_judged_by_its_group(spark):
    rng = np.random.default_rng(0)
    rows = [(k, words(120, 4, rng), "short", "a") for k in range(60)] + [(100 + k, words(120, 9, rng), "long", "a") for k in range(60)]
    rows += [(200, words(120, 9, rng), "short", "a"), (201, words(120, 4, rng), "long", "a"), (202, words(120, 9, rng), "long", "new")]  # the last: a source of one text takes its lang's fences
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[200] and not got[201] and got[202] and all(got[k] for k in (*range(60), *range(100, 160)))


def test_edges(spark):
    rng = np.random.default_rng(1)
    same = words(60, 5, rng)
    rows = [(k, same, None, None, 1, True, 0.0) for k in range(40)] + [(50, None, None, None, 1, True, 0.0), (51, "", "en", None, 1, True, 0.0), (52, "x " * 300_000, "en", "s", 1, True, 0.0), (None, same, None, None, 1, True, 0.0)]
    # columns with the names of the operator's own
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean, hi_symbol_ratio double")
    got = q.judge(d).collect()
    assert len(got) == len(rows) and len({r.kept for r in got if r.n_words == 60}) == 1 and all(r.kept for r in got if r.n_words == 60)  # ties at every fence
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (50, 51, 52)) and {r.doc_id: r.n_words for r in got}[52] == 300_000
    assert q.judge(d.limit(0)).count() == 0
    only_bad = q.judge(d.where(F.col("doc_id") >= 50)).collect()
    assert len(only_bad) == 3 and all(r.hi_symbol_ratio is None and not r.kept for r in only_bad)
