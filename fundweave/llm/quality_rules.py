"""Quality rules with adaptive thresholds, in DataFrame operations only.

Features and sizes of each text go into mergeable KLL quantile sketches for each (lang, source). The
sketches merge into one for each lang and one for all. Fences come from the sketches alone (RULES): a
feature's upper fence is outer + REACH * max(outer - inner, units / typical size), with two of its
quantiles and the median size of the group's texts. Word length has a lower fence alike. The last term
is what a few symbols, lines or words make of a typical text of the group: most texts have no symbols
or repeated lines, so both quantiles may be zero, and texts of a group of long ones are held to less.
A (lang, source) with fewer than LEAST_ROWS sketched texts takes its lang's fences, such a lang those of
all. A source of which most is junk would widen its own fences, so a source's fence is held within SLACK
times its lang's reach. The verdict comes from joining texts with their group's fences.

Null text: no words, base_failed. Null lang or source is a group of its own. Repeated rows are judged
alike. Ties at a fence are kept. With no sketched text, or an empty table, there are no fences and
base_failed decides. Only doc_id, text, lang and source are read: other columns, whatever their names,
do not matter and are not returned. A text is one row whatever its length; its words and windows are
arrays of that row alone.
KLL keeps groups of up to SKETCH_K rows whole; beyond that its rank error is about 1/SKETCH_K.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, materialise, table, text_of

#: feature -> (inner quantile, outer quantile, units, size): all have upper fences, LOWER_FENCED also lower ones.
#: Symbols take a lower outer quantile, since junk that consists of them may be a twentieth of a group.
RULES = {"symbol_ratio": (0.5, 0.9, 3, "n_words"), "dup_line_ratio": (0.5, 0.95, 0.5, "n_lines"), "repeat_ratio": (0.5, 0.95, 8, "n_words"), "mean_word_chars": (0.25, 0.75, 10, "n_words")}
SIZES = ("n_words", "n_lines")
LOWER_FENCED = ("mean_word_chars",)
REACH, SLACK, LEAST_ROWS, SKETCH_K, MOST_BROADCAST = 4.0, 2.0, 30, 2000, 100_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeat_words(places: Column) -> Column:
    """Words under 3-word windows that start at the sorted places."""
    state = F.struct(F.lit(0).alias("done"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("done"), (a["n"] + p + 3 - F.greatest(a["done"], p)).alias("n"))
    return F.aggregate(places, state, step, lambda a: a["n"])


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the features of every row."""
    space = rf"[\x20\x09-\x0D]"
    text = F.col("t")
    d = docs.select("doc_id", "lang", "source", text_of().alias("t"))
    d = d.select("*", F.array_remove(F.split(text, space + "+"), "").alias("w"))
    w = F.col("w")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    # a window is known by the 64-bit hash of its three words
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    d = d.select(
        "doc_id", "lang", "source",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.array_sort(windows).alias("s"),
    )
    s = F.col("s")
    found = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
    d = d.select("*", F.array_sort(F.array_compact(found)).alias("p")).drop("s")
    d = d.withColumn("n_repeat_words", F.when(F.size("p") > 0, _repeat_words(F.col("p"))).otherwise(F.lit(0).cast("long"))).drop("p")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return d.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
    })


def _quantiles(sketches: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    at = lambda c, q: F.kll_sketch_get_quantile_double(f"k_{c}", F.lit(q))
    got = [c for f, (inner, outer, _, _) in RULES.items() for c in (at(f, inner).alias(f"{prefix}_{f}_inner"), at(f, outer).alias(f"{prefix}_{f}_outer"))]
    return sketches.select(*keys, F.col("n").alias(f"{prefix}_n"), *got, *(at(c, 0.5).alias(f"{prefix}_{c}") for c in SIZES))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row for each (lang, source) seen: hi_<feature> and lo_<feature>, null where nothing was sketched."""
    good = ~F.col("base_failed")
    null_safe = {"g_lang": F.struct("lang"), "g_source": F.struct("source")}  # a struct that holds null is not null
    kept = (*RULES, *SIZES)
    by_source = measured.withColumns(null_safe).groupBy("g_lang", "g_source").agg(
        F.count_if(good).alias("n"), *(F.kll_sketch_agg_double(F.when(good, F.col(c).cast("double")), F.lit(SKETCH_K)).alias(f"k_{c}") for c in kept)
    )
    by_source = materialise(by_source, "quality-sketches")
    merged = [F.kll_merge_agg_double(f"k_{c}").alias(f"k_{c}") for c in kept]
    some = by_source.where("n > 0")
    by_lang = _quantiles(some.groupBy("g_lang").agg(F.sum("n").alias("n"), *merged), ["g_lang"], "l")
    of_all = _quantiles(some.agg(F.sum("n").alias("n"), *merged).where("n > 0"), [], "a")
    source = _quantiles(some, ["g_lang", "g_source"], "s")
    joined = by_source.select("g_lang", "g_source").join(source, ["g_lang", "g_source"], "left").join(by_lang, "g_lang", "left")
    joined = joined.join(F.broadcast(of_all), F.lit(True), "left")  # one row: the sketch of everything
    out = []
    for f, (_, _, units, size) in RULES.items():
        def fence(prefix: str, sign: int, f=f, units=units, size=size) -> Column:
            inner, outer = F.col(f"{prefix}_{f}_inner"), F.col(f"{prefix}_{f}_outer")
            least = F.lit(float(units)) / F.greatest(F.col(f"{prefix}_{size}"), F.lit(1.0))
            return (outer if sign > 0 else inner) + sign * REACH * F.greatest(outer - inner, least)

        def held(sign: int, f=f, fence=fence) -> Column:
            many, edge = F.col("l_n") >= LEAST_ROWS, "outer" if sign > 0 else "inner"
            lang = F.when(many, fence("l", sign)).otherwise(fence("a", sign))
            mid = F.when(many, F.col(f"l_{f}_{edge}")).otherwise(F.col(f"a_{f}_{edge}"))
            most = mid + SLACK * (lang - mid)
            own = F.when(F.col("s_n") >= LEAST_ROWS, fence("s", sign)).otherwise(lang)
            return F.least(own, most) if sign > 0 else F.greatest(own, most)

        out.append(held(1).alias(f"hi_{f}"))
        if f in LOWER_FENCED:
            out.append(held(-1).alias(f"lo_{f}"))
    return joined.select("g_lang", "g_source", *out)


def judge(docs: DataFrame) -> DataFrame:
    """metrics() of every row, its group's fences, and kept."""
    measured = materialise(metrics(docs), "quality-metrics")
    fences = materialise(thresholds(measured), "quality-fences")
    if fences.count() <= MOST_BROADCAST:  # a row for each (lang, source); a hot one then needs no shuffle
        fences = F.broadcast(fences)
    keyed = measured.withColumns({"g_lang": F.struct("lang"), "g_source": F.struct("source")})
    ok = ~F.col("base_failed")
    for f in RULES:
        ok = ok & (F.col(f"hi_{f}").isNull() | (F.col(f) <= F.col(f"hi_{f}")))
        if f in LOWER_FENCED:
            ok = ok & (F.col(f"lo_{f}").isNull() | (F.col(f) >= F.col(f"lo_{f}")))
    return keyed.join(fences, ["g_lang", "g_source"], "left").withColumn("kept", ok).drop("g_lang", "g_source")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    """The same with exact quantiles: equal to the sketches while groups have at most SKETCH_K rows."""
    at = lambda c, v, name: f"quantile_disc({c}, {v}) FILTER (WHERE NOT base_failed) AS {name}"
    q = ", ".join([*(at(f, v, f"{f}_{name}") for f, (inner, outer, _, _) in RULES.items() for v, name in ((inner, "inner"), (outer, "outer"))), *(at(c, 0.5, f"typical_{c}") for c in SIZES)])
    n = "count(*) FILTER (WHERE NOT base_failed) AS n"

    def fence(p: str, f: str, sign: int) -> str:
        _, _, units, size = RULES[f]
        return f"({p}.{f}_{'outer' if sign > 0 else 'inner'} + {sign * REACH}::DOUBLE * greatest({p}.{f}_outer - {p}.{f}_inner, {units}::DOUBLE / greatest({p}.typical_{size}, 1)::DOUBLE))"

    tests = ["NOT base_failed"]
    for f in RULES:
        for sign in (1, -1) if f in LOWER_FENCED else (1,):
            lang = f"(CASE WHEN l.n >= {LEAST_ROWS} THEN {fence('l', f, sign)} ELSE {fence('a', f, sign)} END)"
            quart = f"{f}_{'outer' if sign > 0 else 'inner'}"
            mid = f"(CASE WHEN l.n >= {LEAST_ROWS} THEN l.{quart} ELSE a.{quart} END)"
            own = f"(CASE WHEN s.n >= {LEAST_ROWS} THEN {fence('s', f, sign)} ELSE {lang} END)"
            edge = f"{'least' if sign > 0 else 'greatest'}({own}, {mid} + {SLACK}::DOUBLE * ({lang} - {mid}))"
            tests.append(f"({edge} IS NULL OR m.{f} {'<=' if sign > 0 else '>='} {edge})")
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT row_number() OVER () AS r, * FROM w),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM g WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS pos FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1) GROUP BY r),
b AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN rep USING (r)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
 n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars FROM b),
s AS (SELECT lang, source, {n}, {q} FROM m GROUP BY ALL), l AS (SELECT lang, {n}, {q} FROM m GROUP BY ALL), a AS (SELECT {n}, {q} FROM m)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ({' AND '.join(tests)}) AS kept
FROM m JOIN s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""
