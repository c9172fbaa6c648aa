"""Quality rules with risk-controlled thresholds. DataFrame functions only.

The rules' cutoffs come from fixed grids of equal length; a level takes the cutoff of one
place from each grid, so that the levels run from loose to strict. In every stratum
(language) the labelled good texts that pass the base rules are counted, and those that a
level rejects by any rule. A level holds if, were its true rate of false rejection ``alpha``
or more, so few rejections would have a probability (exact binomial tail) of at most
``delta`` / (number of strata). Levels are tested from the loosest on, and the first that
does not hold ends the sequence: testing in a fixed order needs no further correction, so
with probability 1 - ``delta`` no stratum loses more than the share ``alpha`` of its good
texts. A stratum whose loosest level does not hold (too few labels) rejects by the base
rules only. Copies of a text are one trial: its copies are not independent of it.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, unwrapped, utf8, wrapped

#: Rule -> cutoffs by level, strictest first; a document is rejected if its figure is above.
GRIDS = {
    "symbols": [5, 10, 20, 40, 80, 160, 320, 640],  # per 1000 characters in words
    "dup_lines": [2, 4, 8, 16, 32, 64, 128, 256],  # per 1000 words
    "repeats": [50, 100, 150, 200, 250, 300, 350, 400],  # words per 1000 words
    "word_length": [550, 600, 700, 800, 1000, 1400, 2000, 4000],  # characters per 100 words
}
ALPHA, DELTA = 0.04, 0.05


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    Null text has no words. Texts are taken whole; of a long one the row holds its words and
    one number pair per window of three, which stand for the window by 64-bit hashes. Rows
    that repeat are each kept. Columns of ``docs`` with these names give way to them.
    """
    spaces = F.lit(" \t\n\x0b\x0c\r")
    rows = wrapped(docs, _t=F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("_words", F.filter(F.split("_t", SPACES), lambda w: w != ""))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.trim(x, spaces) != ""))
    # Windows of three words as (hash, place), sorted: equal ones lie side by side.
    part = lambda i: F.slice("_hashes", i, n - 2).alias("abc"[i - 1])
    rows = rows.withColumn("_windows", F.when(n >= 3, F.arrays_zip(part(1), part(2), part(3))))
    rows = rows.withColumn("_sorted", F.sort_array(F.transform("_windows", lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("i")))))
    more = F.size("_sorted") - 1
    same = F.zip_with(F.slice("_sorted", 1, more), F.slice("_sorted", 2, more), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_starts", F.when(F.size("_sorted") > 1, F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    covered = F.zip_with("_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return unwrapped(
        rows, docs,
        n_words=n.cast("long"),
        word_chars=F.char_length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=(F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=F.coalesce(F.aggregate(covered, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long"),
    )


def figures() -> dict[str, Column]:
    """Each rule's whole number, exact in any engine."""
    per = lambda k, a, b: F.floor(k * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "symbols": per(1000, "n_symbols", "word_chars"), "dup_lines": per(1000, "n_dup_lines", "n_words"),
        "repeats": per(1000, "n_repeat_words", "n_words"), "word_length": per(100, "word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms; 1 where k / n >= p."""
    step = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + step
        high, low = F.greatest(term, acc["sum"]), F.least(term, acc["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    few = k < n * p
    terms = F.when(few & (k >= 1), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(few, F.exp(F.aggregate(terms, start, add, lambda acc: acc["sum"]))).otherwise(1.0)


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum, good, level`` and one column per rule: the cutoffs of the strictest level
    that holds, null where none does (``level``: places from the strict end).

    ``rows`` has ``doc_id, stratum, text_key, base_failed`` and the rules' figures. Labels
    that are null, other than 0 and 1, or contradict each other are left out, and so are
    texts that are labelled both ways.
    """
    sure = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("z")).where("q = z").drop("z")
    held = rows.where("not base_failed").join(sure, "doc_id").groupBy("stratum", "text_key", *GRIDS).agg(F.min("q").alias("q")).where("q = 1")
    places = range(max(map(len, GRIDS.values())))
    over = lambda i: reduce(or_, (F.col(r) > grid[i] for r, grid in GRIDS.items()))
    counts = held.groupBy("stratum").agg(F.count("*").alias("good"), *(F.count_if(over(i)).alias(f"over_{i}") for i in places))
    # One row per stratum from here on.
    every = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata"))))
    bound = delta / F.greatest(F.col("strata"), F.lit(1))
    holds = lambda i: binomial_tail(F.col("good"), F.col(f"over_{i}"), alpha) <= bound
    every = every.select("stratum", "good", F.array(*(holds(i) for i in reversed(places))).alias("held"))
    stop = F.array_position("held", False)
    level = len(places) - F.when(stop > 0, stop - 1).otherwise(len(places))
    every = every.select("stratum", "good", F.when(level < len(places), level).cast("int").alias("level"))
    return every.select("*", *(F.get(F.array(*map(F.lit, grid)), F.col("level")).cast("long").alias(f"{r}_cutoff") for r, grid in GRIDS.items()))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: ``doc_id``, the base figures, ``base_failed``, ``kept``, the
    rules' figures and the cutoffs that held. Null text has no words and fails the base; a
    null language is a stratum. Texts are read whole, also long ones; rows that repeat are each
    judged, alike, and copies of a text count as one trial. An empty table gives no rows. Other
    columns are not read, so no name can clash."""
    text = F.coalesce("text", F.lit(""))
    base = base_columns(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"), F.md5(utf8("text")).alias("text_key"))).drop("text")
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = materialize(base.withColumns(figures()), "rules")
    bounds = materialize(cutoffs(rows, labels, alpha, delta), "cutoffs")
    judged = rows.join(bounds, "stratum", "left")
    failed = reduce(or_, (F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in GRIDS), F.col("base_failed"))
    return judged.withColumn("kept", ~failed)


def oracle_sql() -> str:
    """The same rows in DuckDB."""
    places = len(next(iter(GRIDS.values())))
    grid = " UNION ALL ".join("SELECT {} AS i, {}".format(i, ", ".join(f"{g[i]} AS {r}_cutoff" for r, g in GRIDS.items())) for i in range(places))
    over = " OR ".join(f"{r} > {r}_cutoff" for r in GRIDS)
    ws = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT r, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM u WINDOW w AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
m AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM h, range(3) AS x(j) GROUP BY r),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x, {ws}) <> '') AS ls FROM t),
b AS (SELECT l.doc_id, l.stratum, md5(l.t) AS k, len(l.ws)::BIGINT AS n_words, length(array_to_string(l.ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(l.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN m USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  floor(1000 * n_symbols / greatest(word_chars, 1))::BIGINT AS symbols, floor(1000 * n_dup_lines / greatest(n_words, 1))::BIGINT AS dup_lines,
  floor(1000 * n_repeat_words / greatest(n_words, 1))::BIGINT AS repeats, floor(100 * word_chars / greatest(n_words, 1))::BIGINT AS word_length FROM b),
sure AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
held AS (SELECT stratum, k, any_value(symbols) AS symbols, any_value(dup_lines) AS dup_lines, any_value(repeats) AS repeats, any_value(word_length) AS word_length FROM f JOIN sure USING (doc_id) WHERE NOT base_failed GROUP BY stratum, k HAVING min(q) = 1),
n AS (SELECT stratum, i, count(*) AS n, count(*) FILTER (WHERE {over}) AS k, (SELECT count(DISTINCT stratum) FROM held) AS strata FROM held, ({grid}) GROUP BY stratum, i),
p AS (SELECT *, CASE WHEN k < n * {ALPHA} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM unnest(range(0, k + 1)) AS r(i)) ELSE 1 END <= {DELTA} / strata AS ok FROM n),
lev AS (SELECT stratum, min(i) AS i FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY i DESC) AS all_ok FROM p) WHERE all_ok GROUP BY stratum),
cuts AS (SELECT stratum, c.* EXCLUDE (i) FROM lev JOIN ({grid}) c USING (i))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce({over}, false)) AS kept
FROM f LEFT JOIN cuts USING (stratum)"""
