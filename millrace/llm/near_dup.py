"""MinHash near-dedup: many universal hash minima, banding, verification on full sets, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import M1, M2, M3, common_count, distinct_sorted, forget, materialize, mix, narrow, released, slices, word_hashes
from millrace.llm.components import connected_components

#: 26 bands of 5 minima: a pair at similarity 0.85 is missed with probability (1 - 0.85^5)^26 = 2.4e-7.
BANDS, ROWS = 26, 5
SHINGLE, PERCENT = 3, 85
#: Cells of the table that orders shingles by their counts: its size bounds what is broadcast (8 MB).
ORDER_CELLS = 1 << 20
#: Words taken together by the vectorised code: bounds a task's memory whatever the batch.
BLOCK_WORDS = 500_000
#: Partners of a text that are verified together.
PARTNERS = 256


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, ASCII letters lower-cased.

    Null, empty and blank texts have the empty set; one with fewer than ``k``
    words has the whole sequence as its one shingle.
    """
    flat, _, ends, _ = word_hashes(texts)
    sets, start = [], 0
    turn = mix(np.arange(1, k + 1, dtype=np.uint64) * M1) | np.uint64(1)
    rolled = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    for i in range(k):
        rolled += mix(flat[i : len(rolled) + i] ^ turn[i]) * turn[i]
    rolled = mix(rolled)
    for end in ends.tolist():
        n = end - start
        if n >= k:
            sets.append(distinct_sorted(rolled[start : end - k + 1]))
        elif n:
            own = hashlib.blake2b(flat[start:end].tobytes(), digest_size=8, person=b"short").digest()
            sets.append(np.frombuffer(own, np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
        start = end
    return sets


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` minima of each non-empty set under the universal hashes (a x + b) mod 2^64, high half."""
    draw = np.random.default_rng(20240501).integers(0, 2**64, (count, 2), np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), count), np.uint32)
    for i, (a, b) in enumerate(draw):
        hashed = ((flat * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), (b + 1) * int(M2) % 2**64, np.uint64)
        for r in range(rows):
            h = mix(h * M3 + signature[:, b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


def _sketches(batches, k: int, bands: int, rows: int):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        lengths = [len(t) // 6 + 1 if (t := x.as_py()) else 1 for x in texts]
        for lo, hi in slices(lengths, BLOCK_WORDS):
            sets = shingle_sets(texts.slice(lo, hi - lo), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                found = band_keys(minima([sets[i] for i in full], bands * rows), bands, rows)
                for i, own in zip(full, found):
                    keys[i] = own
            whole = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            both = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(both[:, 0]),
                    pa.array(both[:, 1]),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "bands"],
            )


def _verified(batches, k: int, percent: int):
    """The pairs that are near, of rows in order (u, part, v, text), each part of a u led by the rows of its own text, without v."""
    leads, led = [], False
    for part, sets in _set_blocks(batches, k):
        near = []
        for v, s in zip(part.column("v").to_pylist(), sets):
            if v is None:
                leads = [s] if led else [*leads, s]
            led = v is not None
            found = False
            for own in leads if led else ():
                both = common_count(own, s)
                found |= both > 0 and 100 * both >= percent * (len(own) + len(s) - both)
            near.append(found)
        kept = part.filter(pa.array(near, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("u"), kept.column("v")], ["u", "v"])


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are near enough.

    The texts of a u's partners follow its own in a sorted task, ``PARTNERS`` or so for
    each part of them: a hub's text is sent once for each part, not once for each partner.
    """
    parts = pairs.groupBy("u").agg(F.expr(f"1 + count(*) DIV {PARTNERS}").alias("n"))
    pairs = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "n").alias("part"), "v")
    side = lambda c: texts.select(F.col("doc_id").alias(c), "text")
    leads = pairs.select("u", "part").distinct().join(side("u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    rows = leads.unionByName(pairs.join(side("v"), "v").select("u", "part", "v", "text"))
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return rows.mapInArrow(lambda it: released(_verified(it, k, percent)), "u long, v long")


def near_duplicates(
    docs: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text string).

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of
    ``k``-word shingles.  Texts with equal sets count as one from the first step
    on, so exact copies never meet in pairs.  Each band bucket tests its members
    against its smallest.  Members of buckets that then still hold more than one
    component are settled by an exact prefix-filter join.  No bucket is dropped or capped.

    Null, empty and blank texts have no shingles and link with nothing.  Rows
    that share a doc_id are one node.  A null doc_id takes no part: its
    component_id is null and kept is false.  A very long text is one set in one task.
    Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sketch = materialize(
        docs.mapInArrow(
            lambda it: released(_sketches(it, k, bands, rows)),
            "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>",
        ),
        "near-sketch",
    )
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    heads = full.join(classes, ["h1", "h2"]).where("doc_id = rep")
    buckets = heads.select(F.explode("bands").alias("key"), "rep").distinct()
    shared = buckets.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets.join(shared, "key").select("key", "rep", "least"), "near-buckets")

    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(docs.join(ids, "doc_id", "left_semi"), "near-texts")
    star = buckets.where("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    links = materialize(_verify(star, texts, k, percent), "near-links")
    components = connected_components(links, "near-star")

    missed = _cross_pairs(_open_nodes(buckets, components), texts, k, percent)
    more = materialize(_verify(missed.join(star, ["u", "v"], "left_anti"), texts, k, percent), "near-more")
    if not more.isEmpty():
        forget(components)
        components = connected_components(links.unionByName(more), "near-all")
    forget(buckets, texts, links, more)

    least = components.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    groups = classes.join(least, "rep", "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("group"))
    groups = sketch.where("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2").join(groups, ["h1", "h2"], "left")
    bare = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("group"))
    rows_ = groups.select("doc_id", "n_shingles", F.expr("IF(doc_id IS NULL, NULL, group)").alias("group"))
    return rows_.unionByName(bare).select(
        "doc_id",
        "n_shingles",
        F.col("group").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("group"), F.lit(False)).alias("kept"),
    )


def _open_nodes(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(doc_id, comp) of the nodes in buckets that hold more than one component."""
    comp = components.withColumnRenamed("node", "rep")
    placed = buckets.join(comp, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return placed.join(mixed, "key").select(F.col("rep").alias("doc_id"), "comp").distinct()


def _cell_counts(batches, k: int):
    """How many of the shingles of the batches fall to each cell of the order table."""
    for part, sets in _set_blocks(batches, k):
        counts = np.bincount((np.concatenate(sets) & np.uint64(ORDER_CELLS - 1)).astype(np.int64), minlength=ORDER_CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])


def _prefixes(batches, k: int, percent: int, table):
    """A set's rarest shingles, as many as must hold one that any near enough set holds too."""
    counts = table.value
    for part, sets in _set_blocks(batches, k):
        tokens = []
        for s in sets:
            order = np.lexsort((s, counts[s & np.uint64(ORDER_CELLS - 1)]))
            tokens.append(s[order[: len(s) - -(-percent * len(s) // 100) + 1]].view(np.int64))
        m, sizes = [len(t) for t in tokens], np.array([len(s) for s in sets])
        rest = np.concatenate([n - np.arange(k) for n, k in zip(sizes, m)])
        columns = [np.repeat(part.column(c).to_numpy(), m) for c in ("doc_id", "comp")]
        columns += [np.repeat(sizes, m), np.concatenate(tokens), rest]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "comp", "n", "token", "rest"])


def _set_blocks(batches, k: int):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for lo, hi in slices([n // 6 + 1 for n in sizes], BLOCK_WORDS):
            yield batch.slice(lo, hi - lo), shingle_sets(texts.slice(lo, hi - lo), k)


def _cross_pairs(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes in different components that may be near enough: an exact prefix-filter join.

    Shingles are ordered by how common they are.  Two near sets share a shingle of
    both prefixes, and at the first such one the rests of both are long enough.
    Whether any node of another component can meet this at a shingle is known from
    the longest rests for each set size, so a shingle that thousands of near copies
    hold is dropped for all those that it can't link, before any pair is made.
    """
    spark = texts.sparkSession
    open_texts = materialize(texts.join(nodes, "doc_id"), "near-open")
    cells = open_texts.mapInArrow(lambda it: _cell_counts(it, k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(ORDER_CELLS, np.int64)
    found = cells.toArrow()
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    schema = "doc_id long, comp long, n long, token long, rest long"
    rows = materialize(open_texts.mapInArrow(lambda it: _prefixes(it, k, percent, shared), schema), "near-prefixes")
    return prefix_pairs(rows, percent)


def prefix_pairs(rows: DataFrame, percent: int, also: str = "TRUE") -> DataFrame:
    """Pairs (u, v) of different components that meet at a token of both prefixes (doc_id, comp, n, token, rest) and for which ``also`` holds."""
    enough = lambda a, b: f"{100 + percent} * least({a}.rest, {b}.rest) >= {percent} * ({a}.n + {b}.n)"
    longest = rows.groupBy("token", "n", "comp").agg(F.max("rest").alias("rest"))
    first = longest.groupBy("token", "n").agg(F.max_by("comp", F.struct("rest", "comp")).alias("comp"), F.max("rest").alias("rest"))
    second = longest.join(first.select("token", "n", F.col("comp").alias("top")), ["token", "n"]).where("comp <> top")
    second = second.groupBy("token", "n").agg(F.max("rest").alias("rest"))
    rivals = first.select("token", "n", "comp", "rest").unionByName(second.withColumn("comp", F.lit(None).cast("long")), True)
    other = f"a.token = b.token AND (b.comp IS NULL OR a.comp <> b.comp) AND {enough('a', 'b')}"
    live = materialize(rows.alias("a").join(rivals.alias("b"), F.expr(other), "left_semi"), "near-live")
    near = f"a.token = b.token AND a.doc_id < b.doc_id AND a.comp <> b.comp AND {enough('a', 'b')} AND {also}"
    pairs = live.alias("a").join(live.alias("b"), F.expr(near))
    return pairs.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id.

    Rows that repeat a kept doc_id go too (the smallest text stays); rows with a
    null doc_id go.  Null, empty and blank texts are alone and stay.
    """
    found = materialize(near_duplicates(docs, **options).where("doc_id IS NOT NULL").select("doc_id", "kept"), "near-found")
    gone = materialize(found.where("NOT kept").select("doc_id").distinct(), "near-gone")
    out = docs.where("doc_id IS NOT NULL").join(narrow(gone), "doc_id", "left_anti").select(*docs.columns)
    if found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out
    rest = [c for c in docs.columns if c != "doc_id"]
    least = out.groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in rest if c != "text"))).alias("row"))
    return least.select("doc_id", "row.*").select(*docs.columns)


def keep_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but those of a group of near-duplicates other than its first: smallest doc_id, those without or with a repeated one last.

    A row without a doc_id, or whose doc_id another row has with another text, is a
    document of its own: it gets a key beyond all ids from a hash of both, and stays unless its
    text is near to one that stays.  Of rows with equal doc_id and text one stays.
    Ids are under 2^62.  Null, empty and blank texts are near to nothing.
    """
    columns = docs.columns
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return keep_one(docs, **options)
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"))
    odd = own.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most OR doc_id IS NULL")
    odd = odd.select(F.col("doc_id").alias("_id"), "least")
    keyed = docs.withColumn("_h", F.xxhash64("doc_id", "text")).join(odd, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    apart = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("_h") != F.col("least")))
    key = F.lit(1 << 62) + F.col("_h").bitwiseAND(F.lit((1 << 62) - 1))
    keyed = keyed.select(F.when(apart, key).otherwise(F.col("doc_id")).alias("doc_id"), *(c for c in columns if c != "doc_id"), F.col("doc_id").alias("_own"))
    kept = keep_one(materialize(keyed, "near-keyed"), **options)
    return kept.withColumn("doc_id", F.col("_own")).select(*columns)
