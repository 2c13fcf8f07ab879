"""Content-addressed store of token ids: rolling-hash chunks, document recipes, Merkle manifests.

A store is a folder with three Parquet tables:

* ``objects/kind=chunk``: each distinct chunk once (``digest``, ``n``, ``ids``: one
  byte with the width, then that many little-endian bytes an id);
* ``recipes``: in ascending doc_id order through the files (null last), the chunk
  digests that make up each document, its Merkle root, and its place (``part``,
  ``pos``, ``start`` in ids) within its file;
* ``manifest``: for each recipe file its documents, ids and a hash tree over its roots.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import chunk_encoder, text_blocks
from millrace.llm.common import byte_strings, exists, mix, released, remove

#: Mean, least and most ids of a chunk; ids that the rolling hash spans.
MEAN, LEAST, MOST, SPAN = 512, 64, 4096, 16

#: Chunks of text that a worker remembers the ids of.
REMEMBERED = 600_000
#: Documents under one inner node of the manifest's tree.
FAN = 1024

LANDED = "own long, kind string, digest binary, n int, ids binary, doc_id long, n_tokens long, root binary, digests array<binary>, lens array<int>"
_SCHEMA = pa.schema(
    [
        ("own", pa.int64()), ("kind", pa.string()), ("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("lens", pa.list_(pa.int32())),
    ]
)
CHUNK, RECIPE = "digest binary, n int, ids binary", "part int, pos long, start long, doc_id long, n_tokens long, root binary, digests array<binary>, lens array<int>"


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is."""
    level = leaves or [_hash(b"")]
    while len(level) > 1:
        pairs = [_hash(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[2 * len(pairs) :]
    return level[0]


@functools.lru_cache(2)
def _id_hashes(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64))


def breaks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last ``SPAN`` ids asks for a cut."""
    h = _id_hashes(1 << int(ids.max(initial=0)).bit_length())[ids]
    step = 1
    while step < SPAN:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    return np.flatnonzero(h >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + 1


def cuts(found: list[int], n: int) -> list[int]:
    """The ends of the chunks of ``n`` ids: at ``found`` places, ``LEAST`` to ``MOST`` ids each."""
    out, start = [], 0
    for p in [*found, n]:
        while p - start > MOST:
            start += MOST
            out.append(start)
        if p - start >= LEAST and p < n:
            out.append(p)
            start = p
    return [*out, n] if start < n else out


def pack(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def _rows(kind: str, **columns) -> pa.RecordBatch:
    """Rows of one kind; the other kind's columns are null."""
    n = len(next(iter(columns.values())))
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _land(batches, path: str, split: str, end_id: int):
    """The recipes of the texts, each with a number of its own, and the chunks that this task hasn't sent yet."""
    encoder, seen, number = chunk_encoder(path, split, REMEMBERED), set(), TaskContext.get().partitionId() << 40
    for part, texts in text_blocks(batches, "text"):
        ids, ends = encoder.encode_array(texts)
        flat = np.insert(ids, ends, end_id)
        ends = (ends + np.arange(1, len(ends) + 1)).tolist()
        found, start = breaks(flat), 0
        new, counts, packs, sizes, roots, lists, lens = [], [], [], [], [], [], []
        cut = np.searchsorted(found, [[a + LEAST, b] for a, b in zip([0, *ends], ends)]).tolist()
        for end, (lo, hi) in zip(ends, cut):
            digests, own, at = [], [], start
            for stop in cuts((found[lo:hi] - start).tolist(), end - start):
                packed = pack(flat[at : start + stop])
                digest = _hash(packed)
                digests.append(digest)
                own.append(start + stop - at)
                if digest not in seen:
                    seen.add(digest)
                    new.append(digest)
                    counts.append(own[-1])
                    packs.append(packed)
                at = start + stop
            sizes.append(end - start)
            roots.append(merkle(digests))
            lists.append(digests)
            lens.append(own)
            start = end
        yield _rows("recipe", own=range(number, number + len(sizes)), doc_id=part.column("doc_id"), n_tokens=sizes, root=roots, digests=lists, lens=lens)
        yield _rows("chunk", digest=new, n=counts, ids=packs)
        number += len(sizes)


def _placed(batches):
    """The rows of a task with the number of the task, of the row in it, and of the ids before it."""
    part, pos, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        upto = start + np.cumsum(n)
        own = [pa.array(np.full(len(n), part, np.int32)), pa.array(pos + np.arange(len(n))), pa.array(upto - n)]
        yield pa.RecordBatch.from_arrays([*own, *batch.columns], ["part", "pos", "start", *batch.schema.names])
        pos, start = pos + len(n), int(upto[-1]) if len(n) else start


def write_store(docs: DataFrame, folder: str, vocabulary: str, *, split: str = "lead", end_id: int = 2) -> None:
    """Encode every text of ``docs`` (doc_id long, text string), append ``end_id`` and write the store.

    A task sends each chunk once, so a chunk that every document holds reaches the
    shuffle once for each task.  Null and empty texts hold the end id alone; rows
    with a null or repeated doc_id are documents of their own; other columns are
    ignored.  A very long text is encoded in one task, in one block of its own.
    """
    spark = docs.sparkSession
    landed = docs.select("doc_id", "text").mapInArrow(lambda it: released(_land(it, vocabulary, split, end_id)), LANDED)
    # duplicates go by sorting, which may spill; the sort is also the one that writing by kind needs
    landed = landed.repartition("digest", "own").dropDuplicates(["kind", "digest", "own"]).drop("own")
    landed.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/objects")
    own = RECIPE.removeprefix("part int, pos long, start long, ")
    recipes = _read(spark, f"{folder}/objects", "recipe", own) or spark.createDataFrame([], own)
    order = [F.asc_nulls_last("doc_id"), F.asc("root")]
    recipes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_placed, RECIPE).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    remove(spark, f"{folder}/objects/kind=recipe")
    _manifest(_recipes(spark, folder)).write.parquet(f"{folder}/manifest")


def _read(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame | None:
    """The rows of one kind; None where no row of it was written."""
    path = f"{folder}/kind={kind}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"{folder}/recipes")


def _manifest(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_ids, root): counts of each recipe file, and the hash over those of its runs of ``FAN`` roots.

    A group gathers ``FAN`` roots, or one hash for each run of a file.
    """
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: F.hex(x[c])), "")
    runs = recipes.select("part", "root", "n_tokens", F.col("pos").alias("at")).groupBy("part", F.floor(F.col("at") / FAN).alias("run"))
    runs = runs.agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.sha1(text("root")).alias("hash"))
    runs = runs.withColumn("hash", F.unhex("hash")).withColumnRenamed("run", "at").groupBy("part")
    return runs.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), F.sha1(text("hash")).alias("root"))


def _file():
    return F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int")


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNK).parquet(f"{folder}/objects")


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, root, digests, lens): ``start`` counts the ids of all documents before.

    The driver sums one number a file.  The manifest is computed anew from the
    recipes: a recipe that was lost, added or changed raises an error.
    """
    stored = spark.read.schema("part int, n_docs long, n_ids long, root string").parquet(f"{folder}/manifest")
    found = {r["part"]: tuple(r) for r in _manifest(_recipes(spark, folder)).collect()}
    if found != {r["part"]: tuple(r) for r in stored.collect()}:
        raise ValueError(f"the recipes in {folder} don't match their manifest")
    offsets, total = [], 0
    for part in sorted(found):
        offsets.append((part, total))
        total += found[part][2]
    if not offsets:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, root binary, digests array<binary>, lens array<int>")
    recipes = _recipes(spark, folder).join(spark.createDataFrame(offsets, "part int, offset long"), "part")
    return recipes.select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "root", "digests", "lens")


def _checked(batches):
    for batch in batches:
        crcs = []
        for digest, data in zip(byte_strings(batch.column("digest")), byte_strings(batch.column("ids"))):
            if _hash(data) != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            crcs.append(zlib.crc32(unpack(data).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64())], ["digest", "crc"])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of crc32 (bit 31: x^0), pair by pair."""
    out, top, one = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.uint32), np.uint32(1 << 31), np.uint32(1)
    for _ in range(32):
        out ^= np.where(a & top > 0, b, np.uint32(0))
        a, b = a << one, (b >> one) ^ np.where(b & one > 0, np.uint32(0xEDB88320), np.uint32(0))
    return out


@functools.lru_cache(64)
def _shift_by(bit: int) -> np.ndarray:
    """x^(8 * 2^bit) modulo the polynomial of crc32."""
    power = np.array([1 << 30], np.uint32)
    for _ in range(bit + 3):
        power = _times(power, power)
    return power


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """crc32 of joined byte strings from each one's (crc32, length)."""
    crcs, sizes = (np.array(x, np.int64) for x in zip(*parts))
    return int(crc_of_runs(crcs, sizes, np.array([len(crcs)]))[0])


def crc_of_runs(crcs: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 (as uint32) of each run of joined byte strings from the strings' own (crc32, bytes); a run ends at each of ``ends``, and none is empty.

    A string's crc32 counts in the whole one as its product with x^(8 * bytes after it).
    """
    upto = np.cumsum(sizes)
    after = np.repeat(upto[ends - 1], np.diff(ends, prepend=0)) - upto
    out, bit = crcs.astype(np.uint32), 0
    while (after >> bit).any():
        some = np.flatnonzero(after >> bit & 1)
        out[some] = _times(out[some], _shift_by(bit))
        bit += 1
    return np.bitwise_xor.reduceat(out, np.append(0, ends[:-1])) if len(ends) else out


def _rebuilt(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("parts")
        counts = parts.value_lengths().fill_null(0).to_numpy()
        flat = parts.flatten()
        doc, pos = np.repeat(np.arange(len(counts)), counts), flat.field("pos").to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, doc))
        digests, n = byte_strings(flat.field("digest").take(pa.array(order))), flat.field("n").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        crcs, ends = flat.field("crc").take(pa.array(order)), np.cumsum(counts)
        tokens = np.add.reduceat(n, ends - counts) if counts.all() else np.array([-1])
        same = counts.all() and not crcs.null_count and (tokens == batch.column("n_tokens").to_numpy()).all()
        roots = byte_strings(batch.column("root"))
        if not same or any(merkle(digests[e - c : e]) != root for c, e, root in zip(counts.tolist(), ends.tolist(), roots)):
            raise ValueError("a document doesn't match its recipe")
        crc = crc_of_runs(crcs.to_numpy(), 4 * n, ends)
        columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _parts(recipes: DataFrame) -> DataFrame:
    each = F.posexplode(F.arrays_zip("digests", "lens")).alias("pos", "part")
    return recipes.select("start", each).select("start", "pos", "part.digests", "part.lens").toDF("start", "pos", "digest", "n")


def verify_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    Every chunk is read once, held against its digest and given its crc32; a
    document's crc32 follows from those of its chunks in recipe order, so no ids
    are moved.  A damaged chunk, or a document that doesn't match its Merkle root
    or its count, raises an error.
    """
    recipes = read_recipes(spark, folder)
    chunks = _objects(spark, folder).where("digest IS NOT NULL").select("digest", "ids")
    crcs = chunks.mapInArrow(_checked, "digest binary, crc long")
    parts = _parts(recipes).join(crcs, "digest", "left").groupBy("start")
    parts = parts.agg(F.collect_list(F.struct("pos", "digest", "n", "crc")).alias("parts"))
    whole = recipes.select("doc_id", "start", "n_tokens", "root").join(parts, "start", "left")
    return whole.mapInArrow(_rebuilt, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _assembled(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = [unpack(p["ids"]) for p in sorted(r.pop("parts"), key=lambda p: p["pos"])]
            row = r | {"ids": np.concatenate(ids).astype("i4")}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<int>): the documents' ids themselves."""
    recipes = read_recipes(spark, folder)
    chunks = _objects(spark, folder).where("digest IS NOT NULL").select("digest", "ids")
    parts = _parts(recipes).join(chunks, "digest").groupBy("start").agg(F.collect_list(F.struct("pos", "ids")).alias("parts"))
    return recipes.select("doc_id", "start").join(parts, "start").select("doc_id", "start", "parts").mapInArrow(_assembled, "doc_id long, start long, ids array<int>")
