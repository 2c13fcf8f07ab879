"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize, narrow

_BLANK = r"[\x20\x09-\x0D]"
GRAM = 8
#: The transformed statistics, and the least standard deviation that each one is given credit for.
VECTOR = {
    "v_word": ("ln(word_chars / n_words)", 0.05),
    "v_symbol": ("sqrt(n_symbols / word_chars)", 0.03),
    "v_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.15),
    "v_repeat": ("sqrt(n_repeat_words / n_words)", 0.15),
}
#: Share of a group's rows that the determinant is minimised over: up to as many others do no harm.
#: Tail probability at which a row goes.  It was set on the labelled rows of even doc_id at 0.1, where 1e-6 to 1e-15
#: give one and the same verdict on all but one row; on those of odd doc_id, of the rows that pass the base rules,
#: all 1,694 of quality 1 are kept and 163 of 168 of quality 0 go.
SHARE, TAIL = 0.5, 1e-15
#: Rows that a group needs to be fitted alone: five for each dimension, the usual rule for this estimator.
#: A smaller one is fitted together with the other small groups of its language, and what is left then together.
LEAST_ROWS = 5 * len(VECTOR)
#: Ways to begin, after the medians: deviations in medians alone, covariances of their hyperbolic tangents, of their spatial signs.
STARTS = 3
#: Steps after which a group goes on from its best start alone; least fall of a log determinant that counts.
TRIED, FALL = 2, 1e-6
_UNIT = 1_000_000
#: Groups up to which a table of one row for each (some 200 bytes) is broadcast; beyond it rows and groups are joined by shuffle.
BROADCAST_GROUPS = 50_000


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (text string) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words in place of text.

    A null or empty text has zeros.  The 8-word windows of a text are told apart by
    64-bit hashes built from word hashes by doubling; nothing is exploded, so a row
    is worked on alone, whatever its length.
    """
    strip = F.expr(r"trim(BOTH ' \u0009\u000A\u000B\u000C\u000D' FROM text)")
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumns(
        {
            "_words": F.when(strip == "", F.array().cast("array<string>")).otherwise(F.split(strip, f"{_BLANK}+")),
            "_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    ).drop("text")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.when(F.size("_words") >= GRAM, F.transform("_words", lambda w: F.xxhash64(w))),
        }
    ).drop("_words", "_lines")
    for step in (1, 2, 4):
        ahead = F.slice("_h", step + 1, F.size("_h"))
        out = out.withColumn("_h", F.zip_with(F.slice("_h", 1, F.size("_h") - step), ahead, lambda a, b: F.xxhash64(a, b)))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    beside = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    again = F.filter("_s", lambda x, i: F.coalesce(beside(x, i), F.get("_s", i - 1)["h"] == x["h"], F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_s")
    gaps = F.zip_with(F.slice("_at", 1, F.size("_at") - 1), F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(b - a, F.lit(GRAM)))
    covered = F.when(F.size("_at") > 0, F.lit(GRAM) + F.aggregate(gaps, F.lit(0), lambda a, b: a + b)).otherwise(0)
    return out.withColumn("n_repeat_words", covered.cast("long")).drop("_at")


def chi2_upper(x: float, p: int) -> float:
    """P(chi-square with an even number ``p`` of degrees of freedom > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(tail: float, p: int) -> float:
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_upper(mid, p) > tail else (lo, mid)
    return hi


def _at_share(rows: DataFrame, keys: list[str], value: str, share: float, run: int) -> DataFrame:
    """(keys, at, part): the smallest ``value`` (long) at which ``share`` of each group's rows are reached, and the part of that value's rows that it takes.

    Exact on counts.  Equal values are counted before the shuffle; runs of ``run``
    values are looked through first, then the values of one run, so that a group that
    holds a third of all rows is a few hundred rows in a window.
    """
    counts = materialize(rows.groupBy(*keys, value).agg(F.count("*").alias("n")), "quality-counts")
    counts = counts.withColumn("_run", F.floor(F.col(value) / run))
    order = lambda c: Window.partitionBy(*keys).orderBy(c)
    runs = counts.groupBy(*keys, "_run").agg(F.sum("n").alias("n"))
    runs = runs.withColumns({"_upto": F.sum("n").over(order("_run")), "_need": F.ceil(F.sum("n").over(Window.partitionBy(*keys)) * share)})
    border = runs.where("_upto >= _need").groupBy(*keys).agg(F.min(F.struct("_run", (F.col("_upto") - F.col("n")).alias("before"), "_need")).alias("_b"))
    fine = counts.join(border, keys).where("_run = _b._run").withColumn("_upto", F.sum("n").over(order(value)) + F.col("_b.before"))
    reached = fine.where("_upto >= _b._need").groupBy(*keys).agg(F.min(F.struct(value, "_upto", "n", "_b._need")).alias("_r"))
    return reached.select(*keys, F.col(f"_r.{value}").alias("at"), ((F.col("_r._need") - F.col("_r._upto") + F.col("_r.n")) / F.col("_r.n")).alias("part"))


def _groups(rows: DataFrame) -> DataFrame:
    """``rows`` with ``g``: language and source, or what small groups are fitted with; null where no row passes the base rules."""
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumns({"_l": tag("lang"), "_s": tag("source")})
    counts = rows.where("NOT base_failed").groupBy("_l", "_s").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\n", F.lit("both"), "_l", "_s"))
    by_language = F.sum(F.when(own.isNull(), F.col("n"))).over(Window.partitionBy("_l"))
    counts = counts.withColumn("own", own).withColumn("rest", by_language)
    counts = counts.withColumn("g", F.coalesce("own", F.when(F.col("rest") >= LEAST_ROWS, F.concat_ws("\n", F.lit("language"), "_l"))))
    counts = counts.withColumn("g", F.coalesce("g", F.lit("rest")))
    return rows.join(counts.select("_l", "_s", "g"), ["_l", "_s"], "left").drop("_l", "_s")


def _whole(c: Column) -> Column:
    """Sums of whole numbers don't depend on the order of rows."""
    return c.cast("decimal(20,0)")


def _factor(est: DataFrame, cov, keep: list) -> DataFrame:
    """``keep`` and l_ij: the Cholesky factor of the matrix that ``cov(i, j)`` gives, column by column."""
    p = range(len(VECTOR))
    for i in p:
        for j in range(i + 1):
            c = cov(i, j)
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-6))) if i == j else c / F.col(f"l{j}{j}"))
    return est.select(*keep, *(f"l{i}{j}" for i in p for j in range(i + 1)))


def _estimates(subset: DataFrame, names: list[str], floors: list[float], correction: float) -> DataFrame:
    """(g, s, m_i, l_ij, logdet): mean and Cholesky factor of the regularised covariance of each group's subset.

    ``subset`` has ``edge`` and ``part``: rows at the edge of the subset count in part.
    """
    p = range(len(names))
    terms = {"n": F.lit(1)} | {f"s{i}": F.col(names[i]) for i in p} | {f"s{i}{j}": F.col(names[i]) * F.col(names[j]) for i in p for j in p if j <= i}
    sums = [F.sum(_whole(F.when(F.col("edge") == e, t))).alias(f"{k}_{int(e)}") for k, t in terms.items() for e in (False, True)]
    est = subset.groupBy("g", "s").agg(F.max("part").alias("part"), *sums)
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    est = est.select("g", "s", *((double(f"{k}_0") + F.col("part") * double(f"{k}_1")).alias(k) for k in terms))
    mean = lambda i: F.col(f"s{i}") / F.col("n")

    def cov(i: int, j: int) -> Column:
        c = (F.col(f"s{i}{j}") / F.col("n") - mean(i) * mean(j)) * correction
        return F.greatest(c, F.lit(0.0)) + (floors[i] * _UNIT) ** 2 if i == j else c

    est = _factor(est, cov, ["g", "s", *(mean(i).alias(f"m{i}") for i in p)])
    return est.withColumn("logdet", sum((F.log(F.col(f"l{i}{i}")) for i in p), F.lit(0.0)))


def _starts(fit: DataFrame, names: list[str], floors: list[float], mark) -> DataFrame:
    """(g, s, m_i, l_ij): each group's medians with ``STARTS`` scatters, of its rows in median deviations.

    Medians and deviations are taken of thousandths, which are few; they only begin the search.
    """
    p = range(len(names))
    coarse = lambda c: (F.floor(F.col(c) / 1000) * 1000).cast("long")
    long = fit.select("g", F.posexplode(F.array(*map(coarse, names))).alias("i", "x"))
    middle = materialize(_at_share(long, ["g", "i"], "x", 0.5, 64_000).select("g", "i", F.col("at").alias("mid")), "quality-mid")
    off = long.join(mark(middle), ["g", "i"]).select("g", "i", F.abs(F.col("x") - F.col("mid")).alias("off"))
    scale = middle.join(_at_share(off, ["g", "i"], "off", 0.5, 64_000).withColumnRenamed("at", "mad"), ["g", "i"])
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    start = scale.groupBy("g").agg(
        *(pick(i, "mid").cast("double").alias(f"m{i}") for i in p),
        *((pick(i, "mad") * 1.4826 + floors[i] * _UNIT).alias(f"d{i}") for i in p),
    )
    start = materialize(start, "quality-start")
    z = [(F.col(names[i]) - F.col(f"m{i}")) / F.col(f"d{i}") for i in p]
    norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    kinds = [[F.tanh(v) for v in z], [F.when(norm > 0, v / norm).otherwise(0.0) for v in z]]
    moved = fit.join(mark(start), "g").select("g", F.posexplode(F.array(*(F.array(*k) for k in kinds))).alias("s", "z"))
    each = {f"c{i}{j}": F.sum(_whole(F.round(F.get("z", F.lit(i)) * F.get("z", F.lit(j)) * _UNIT))) for i in p for j in range(i + 1)}
    scatter = moved.groupBy("g", (F.col("s") + 1).alias("s")).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in each.items()))
    plain = start.select("g", F.lit(0).alias("s"), F.lit(1).alias("n"), *(F.lit(_UNIT if i == j else 0).cast("decimal(30,0)").alias(f"c{i}{j}") for i in p for j in range(i + 1)))
    all_of = plain.unionByName(scatter).join(start, "g")
    cov = lambda i, j: F.col(f"c{i}{j}").cast("double") / F.col("n") / _UNIT + (0.01 if i == j else 0.0)
    found = _factor(all_of, cov, ["g", "s", *(f"m{i}" for i in p), *(f"d{i}" for i in p)])
    return found.select("g", "s", *(f"m{i}" for i in p), *((F.col(f"l{i}{j}") * F.col(f"d{i}")).alias(f"l{i}{j}") for i in p for j in range(i + 1)))


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the joined estimates."""
    y: list[Column] = []
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m{i}")
        for j, done in enumerate(y):
            rest = rest - F.col(f"l{i}{j}") * done
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def robust_distance(rows: DataFrame, *, share: float = SHARE) -> DataFrame:
    """``rows`` (g and the vector's columns, as whole millionths) with ``d2``, null where g is null.

    Minimum covariance determinant for each group.  From each of ``STARTS`` first
    scatters, the subset moves to the ``share`` of rows nearest under its own mean and
    covariance, which never raises the determinant; after ``TRIED`` steps the best
    start goes on until no group's determinant falls any more.  Distances are told
    apart in bins of 1/256 of an octave; of the bin at the limit all rows count in part.
    """
    names, floors = list(VECTOR), [v[1] for v in VECTOR.values()]
    p = len(names)
    inner = chi2_quantile(1 - share, p)
    correction = share / (1 - chi2_upper(inner, p + 2))
    fit = rows.where("g IS NOT NULL AND NOT base_failed").select("g", *names)
    few = fit.select("g").distinct().count() <= BROADCAST_GROUPS
    mark = F.broadcast if few else lambda groups: groups
    columns = ["g", "s", *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)), "logdet"]

    def moved(est: DataFrame) -> DataFrame:
        bins = F.floor(F.log2(_distance(names) + 1e-9) * 256).cast("long")
        far = fit.join(mark(est.drop("logdet")), "g").select("g", "s", *names, bins.alias("bin"))
        limit = materialize(_at_share(far, ["g", "s"], "bin", share, 256), "quality-limit")
        subset = far.join(mark(limit), ["g", "s"]).where("bin <= at").withColumn("edge", F.col("bin") == F.col("at"))
        return materialize(_estimates(subset, names, floors, correction).select(*columns), "quality-estimates")

    best_of = lambda e: e.groupBy("g").agg(F.min_by(F.struct(*columns[1:]), F.struct("logdet", "s")).alias("e")).select("g", "e.*")
    est = materialize(_starts(fit, names, floors, mark), "quality-starts")
    for _ in range(TRIED):
        est = moved(est)
    best = materialize(best_of(est), "quality-best")
    while True:
        now = moved(best)
        fell = now.join(best.select("g", F.col("logdet").alias("was")), "g").where(F.col("logdet") < F.col("was") - FALL)
        if fell.isEmpty():
            break
        best = materialize(best_of(best.unionByName(now)), "quality-best")
    return rows.join(mark(best.drop("s", "logdet")), "g", "left").select(*rows.columns, _distance(names).alias("d2"))


def judge(docs: DataFrame, *, tail: float = TAIL) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang, source): its statistics, base_failed, d2, kept.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated
    windows.  A row that passes goes when its squared robust distance within its
    language and source lies beyond the chi-square quantile at ``tail``.  A null
    language or source is a group of its own; groups under ``LEAST_ROWS`` rows are fitted by
    language, then together, however few those are.  Null and empty texts fail; null
    and repeated doc_ids are judged like any other; a very long text is one row's arrays;
    rows at equal distances share a verdict.  Other columns are ignored.
    """
    stats = text_statistics(docs.select("doc_id", "lang", "source", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scaled = {k: F.when(F.col("n_words") > 0, F.round(F.expr(v[0]) * _UNIT).cast("long")) for k, v in VECTOR.items()}
    stats = materialize(stats.withColumn("base_failed", failed).withColumns(scaled), "quality-statistics")
    far = robust_distance(materialize(_groups(stats), "quality-groups"))
    limit = chi2_quantile(tail, len(VECTOR))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))
    return far.select("doc_id", *counts, "base_failed", kept.alias("kept"), "d2", *(k for k in VECTOR), "g")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows of equal doc_id, language, source and text share one verdict.
    """
    key = F.xxhash64("doc_id", "lang", "source", "text")
    verdict = judge(docs.select(key.alias("doc_id"), "lang", "source", "text"), **options)
    out = materialize(verdict.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "quality-rejected")
    return docs.join(narrow(out), key == out["key"], "left_anti")
