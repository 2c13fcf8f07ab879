"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 20240501
#: Documents that share a slice of a pattern's seeded order; a slice is the most that one task gathers.
SLICE = 512
#: Slices that are summed together before single slices are looked at.
RUN = 1024
#: Slices taken in part up to which their list is broadcast (about 5 MB); beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Membership patterns that the driver routes; they are combinations of sources, so they don't grow with the documents.
MAX_PATTERNS = 200_000
_SEP, _NULL, _SOME = "\x01", "-", "="


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """``total`` shared by weight; what lies above ``cap`` times a source's size is shared again among the others."""
    out, free, left = {}, {k for k in sizes if weights[k] > 0}, float(total)
    while free:
        unit = left / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * unit > cap * sizes[k]}
        if not full:
            out.update((k, weights[k] * unit) for k in free)
            break
        for k in full:
            out[k] = float(cap * sizes[k])
            left -= out[k]
        free -= full
    return {k: out.get(k, 0.0) for k in sizes}


def route(capacity: dict[tuple, int], quotas: dict, epochs: int) -> dict[tuple, int]:
    """Words that each pattern gives: a maximum flow of patterns to the quotas of their sources at the least cost.

    A pattern's n-th pass over its documents costs n - 1 a word, so that
    repetition is spread.  As only the arcs into patterns cost anything, the cheapest
    flow is a maximum flow over first passes, then grown by the second ones, and so
    on; each by blocking flows on the levels of the residual network.
    """
    patterns, sources = sorted(capacity), sorted({s for p in capacity for s in p})
    number = {p: i + 1 for i, p in enumerate(patterns)} | {s: len(patterns) + 1 + i for i, s in enumerate(sources)}
    end = len(patterns) + len(sources) + 1
    arcs: list[list] = [[] for _ in range(end + 1)]  # [to, what is left, place of the reverse arc]

    def arc(a: int, b: int, most: int):
        arcs[a].append([b, most, len(arcs[b])])
        arcs[b].append([a, 0, len(arcs[a]) - 1])

    for p in patterns:
        arc(0, number[p], 0)
        for s in p:
            arc(number[p], number[s], epochs * capacity[p])
    for s in sources:
        arc(number[s], end, round(quotas[s]))
    for _ in range(epochs):
        for p, own in zip(patterns, arcs[0]):
            own[1] += capacity[p]
        while (level := _levels(arcs, end))[end] >= 0:
            _block(arcs, level, end)
    return {p: arcs[number[p]][own[2]][1] for p, own in zip(patterns, arcs[0])}


def _levels(arcs: list[list], end: int) -> list[int]:
    """Steps from node 0 over arcs with something left; -1 beyond reach."""
    level, now = [0] + [-1] * end, [0]
    while now and level[end] < 0:
        after = []
        for a in now:
            for b, most, _ in arcs[a]:
                if most > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    after.append(b)
        now = after
    return level


def _block(arcs: list[list], level: list[int], end: int) -> None:
    """Push along paths of rising levels until each is blocked; an arc that is passed by isn't looked at again."""
    at, path = [0] * (end + 1), []
    while True:
        a = path[-1][0] if path else 0
        if a == end:
            least = min(x[1] for x in path)
            for x in path:
                x[1] -= least
                arcs[x[0]][x[2]][1] += least
            cut = next(i for i, x in enumerate(path) if x[1] == 0)
            del path[cut:]
            continue
        while at[a] < len(arcs[a]):
            x = arcs[a][at[a]]
            if x[1] > 0 and level[x[0]] == level[a] + 1:
                break
            at[a] += 1
        if at[a] < len(arcs[a]):
            path.append(arcs[a][at[a]])
        elif path:
            path.pop()
            at[path[-1][0] if path else 0] += 1
        else:
            return


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one slice, in seeded order, every document that still fits into what is left."""
    pdf = pdf.sort_values(["h", "doc_id"], na_position="first")
    left, taken = int(pdf["left"].iloc[0]), []
    for size in pdf["size"]:
        taken.append(size <= left)
        left -= size if size <= left else 0
    return pdf.loc[taken, ["pattern", "h", "doc_id", "slice", "size"]]


_CHOSEN = "pattern string, h long, doc_id long, slice long, size long"


def _first_over(sums: DataFrame, by: str) -> DataFrame:
    """(pattern, by, before) of ``sums`` (pattern, by, words, left): the first ``by`` that ends beyond what is left, and the words before it."""
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy(by))
    last = sums.withColumn("upto", upto).where("upto > left").groupBy("pattern").agg(F.min(F.struct(by, "upto", "words")).alias("s"))
    return last.select("pattern", f"s.{by}", (F.col("s.upto") - F.col("s.words")).alias("before"))


def _border(rows: DataFrame) -> DataFrame:
    """(pattern, border, before) of ``rows`` (pattern, slice, size, left): the first slice that ends beyond what is left.

    Runs of ``RUN`` slices are looked through first, then the slices of one run, so
    that a pattern of a third of all documents has few rows in a window.
    """
    sums = materialize(rows.groupBy("pattern", "slice", "left").agg(F.sum("size").alias("words")), "mix-sums")
    run = F.floor(F.col("slice") / RUN)
    coarse = _first_over(sums.groupBy("pattern", run.alias("run"), "left").agg(F.sum("words").alias("words")), "run")
    inner = sums.join(coarse.withColumnRenamed("before", "passed"), "pattern").where(run == F.col("run"))
    fine = _first_over(inner.select("pattern", "slice", "words", (F.col("left") - F.col("passed")).alias("left")), "slice")
    both = fine.join(coarse.select("pattern", F.col("before").alias("passed")), "pattern")
    return both.select("pattern", F.col("slice").alias("border"), (F.col("before") + F.col("passed")).alias("before"))


def _filled(edge: DataFrame) -> DataFrame:
    """The documents that ``_fill`` takes of the border slices (pattern, h, doc_id, slice, size, left)."""
    return materialize(edge.groupBy("pattern").applyInPandas(_fill, _CHOSEN), "mix-chosen")


def _left_over(start: DataFrame, chosen: DataFrame) -> DataFrame:
    """(pattern, left, after): what the documents of the border slices left of ``start`` (pattern, border, left)."""
    used = chosen.groupBy("pattern").agg(F.sum("size").alias("used"))
    left = F.col("left") - F.coalesce("used", F.lit(0))
    return materialize(start.join(used, "pattern", "left").select("pattern", left.alias("left"), F.col("border").alias("after")), "mix-left")


def _rest(small: DataFrame, state: DataFrame) -> DataFrame:
    """What is taken after the border slices: the seeded order goes on until no document fits into what is left.

    Each round takes whole slices of the documents that fit, up to a border
    slice, which is filled and leaves less than one of its documents.  As the order
    is independent of sizes, few rounds are needed.
    """
    rows = small.groupBy("pattern", "h", "doc_id", "slice").agg(F.sum("size").alias("size"))
    chosen = None
    while True:
        fits = "slice > after AND size > 0 AND size <= left"
        rows = materialize(rows.join(state, "pattern").where(fits).drop("after"), "mix-rest")
        if rows.isEmpty():
            return chosen
        last = materialize(_border(rows), "mix-border")
        placed = rows.join(last, "pattern", "left")
        edge = placed.where("slice = border").withColumn("left", F.col("left") - F.col("before"))
        filled = _filled(edge.drop("border", "before"))
        whole = placed.where("border IS NULL OR slice < border").select("pattern", "h", "doc_id", "slice", "size")
        both = whole.unionByName(filled)
        chosen = both if chosen is None else chosen.unionByName(both)
        start = rows.groupBy("pattern").agg(F.min("left").alias("left")).join(last, "pattern")
        start = start.select("pattern", "border", (F.col("left") - F.col("before")).alias("left"))
        state, rows = _left_over(start, filled), rows.drop("left")


def mix(
    docs: DataFrame, *, members: Column, size: Column, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """(row, size, members, target, source_size, times) for each row of ``docs``: how often the mix takes it.

    ``members`` is an array of the names of the sources that a document belongs
    to (null: a source of its own, last in order), ``size`` its words.  Sources in
    code-point order have the ``weights``, repeating; together they get ``share``
    times the words of all documents with members, none more than ``cap`` times its own.  Patterns of membership
    are routed to the sources on the driver; each pattern then takes whole passes
    over its documents, and for the rest the first slices of its seeded order, and
    of those that follow every document that still fits.  ``target`` and ``source_size`` are the
    first member's.  No document is taken more than ``cap`` times; one without
    members is never taken.  Repeated rows of a doc_id are taken together, as are
    rows without a doc_id of equal members and size; equal hashes go by doc_id.  An
    empty or null text has no words and is taken with the passes of its pattern; a text
    of more words than its source still needs is left to the passes.  The
    result depends on the rows and the seed alone, not on their order.
    """
    spark = docs.sparkSession
    name = lambda x: F.coalesce(F.concat(F.lit(_SOME), x), F.lit(_NULL))
    work = docs.select(F.struct("*").alias("row"), F.col("doc_id"), members.alias("members"), size.alias("size"))
    keys = F.array_sort(F.array_distinct(F.transform("members", name)))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("members", "size", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    work = work.withColumns({"pattern": F.array_join(keys, _SEP), "h": own})
    totals = work.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = totals.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r["pattern"].split(_SEP)): r["words"] for r in found if r["pattern"]}
    sizes: dict[str, int] = {}
    for p, words in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    order = sorted(sizes, key=lambda s: (s == _NULL, s))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = targets(sizes, weigh, share * sum(capacity.values()), cap)
    given = route(capacity, target, cap)
    rows = []
    for r in found:
        words, p = r["words"], tuple(r["pattern"].split(_SEP))
        passes, left = divmod(given.get(p, 0), words) if words else (0, 0)
        first = min(p, key=order.index) if r["pattern"] else None
        rows.append(
            {"pattern": r["pattern"], "passes": passes, "left": left, "slices": max(1, r["n"] // SLICE), "target": target.get(first, 0.0), "source_size": sizes.get(first, 0)}
        )
    kinds = [("pattern", pa.string()), *((c, pa.int64()) for c in ("passes", "left", "slices")), ("target", pa.float64()), ("source_size", pa.int64())]
    plan = spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(kinds)))

    where = F.floor(F.shiftrightunsigned("h", 11) / F.lit(2.0**53) * F.col("slices"))
    small = work.select("pattern", "doc_id", "size", "h").join(plan.where("left > 0"), "pattern").withColumn("slice", where)
    small = materialize(small.select("pattern", "doc_id", "size", "h", "slice", "left"), "mix-sizes")
    last = materialize(_border(small), "mix-border")
    edge = small.join(last, "pattern").where("slice = border").groupBy("pattern", "h", "doc_id", "slice")
    edge = edge.agg(F.sum("size").alias("size"), F.min(F.col("left") - F.col("before")).alias("left"))
    chosen = _filled(edge)
    start = plan.join(last, "pattern").select("pattern", "border", (F.col("left") - F.col("before")).alias("left"))
    later = small.drop("left").join(last.drop("before"), "pattern").where("slice > border").drop("border")
    more_chosen = _rest(later, _left_over(start, chosen))
    if more_chosen is not None:
        chosen = chosen.unionByName(more_chosen)

    # a row for each pattern, 200,000 at most: texts stay where they are
    wide = work.join(F.broadcast(plan.join(last.drop("before"), "pattern", "left")), "pattern").withColumn("slice", where)
    more = F.col("left") > 0
    parted = chosen.select("pattern", "slice").unionByName(last.select("pattern", F.col("border").alias("slice"))).distinct()
    parted = materialize(parted.withColumn("parted", F.lit(True)), "mix-parted")
    few = parted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wide = wide.join(F.broadcast(parted) if few else parted, ["pattern", "slice"], "left")
    inner = wide.where("parted IS NULL")
    inner = inner.withColumn("times", F.col("passes") + F.when(more & (F.col("slice") < F.col("border")), 1).otherwise(0))
    picked = chosen.select(F.col("pattern").alias("p"), F.col("h").alias("ph"), F.col("doc_id").alias("pd"), F.lit(1).alias("one"))
    same = (F.col("pattern") == F.col("p")) & (F.col("h") == F.col("ph")) & F.col("doc_id").eqNullSafe(F.col("pd"))
    outer = wide.where("parted").join(picked, same, "left")
    outer = outer.withColumn("times", F.col("passes") + F.coalesce("one", F.lit(0)))
    columns = ["row", "size", "members", "target", "source_size", "times"]
    return inner.select(*columns).unionByName(outer.select(*columns))


def mix_by_source(docs: DataFrame, **options) -> DataFrame:
    """``mix`` of documents (doc_id, text, source) whose only source is their own; sizes in words."""
    return mix(docs, members=F.array("source"), size=word_count(), **options)


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of the input as often as it is taken."""
    return mixed.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
