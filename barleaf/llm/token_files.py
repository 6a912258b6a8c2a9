"""Token-id files with a minimal perfect hash index for constant-time keyed access.

Format.  A folder holds

* ``shards/part-NNNNN*``: raw little-endian 16-bit ids of the documents in
  ascending document id, each closed by the end id, and after them a footer: an
  Arrow stream of ``(doc_id, n_tokens)`` in file order, its length (8 bytes) and
  a magic word (8 bytes).  Spark's text sink writes them, with the end id as its
  line separator, so a lost task leaves no half-written file behind;
* ``manifest``: one row per shard, ``(shard, path, base)``; ``base`` counts the
  ids of all shards before it;
* ``index``: one row per hash bucket of about ``BUCKET`` keys: a minimal perfect
  hash (level by level, keys alone on their place in a level keep it, the others
  go on) and, by its slot, a stored fingerprint, shard, offset and count.

Access.  A key goes to its bucket, the perfect hash names its one slot, the
stored fingerprint rejects keys that were never written, and the ids are read at
their offset.  Nothing is scanned.

Edge cases.  Null and empty texts hold the end id alone.  Null ids come first.
Repeated ids are kept, in the order of their ids' bytes, and are keyed by (id,
number of the copy).  Empty tables make an empty folder that looks up nothing.
Other columns are ignored; ids are integers.  The shared folder must be one that pyarrow.fs opens
(local or network mount, hdfs, s3, gs); inputs may lie anywhere Spark reads.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barleaf.llm.common import fresh, parts
from barleaf.llm.encoders import crc, encoder

MAGIC = b"TOKSHRD1"
BUCKET = 512
GAMMA = 1.5
LEVELS = 40
_READ = 8 << 20
KEEP = 1_000_000  # pieces a worker remembers, about 200 bytes each


# ---- writing -------------------------------------------------------------


def encoded(docs: DataFrame, path: str, bounds: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, shard)``: the 16-bit ids of every whole text, without the end id.

    ``shard`` is the number of ``bounds`` below the id; null ids go to the first.
    """
    borders = np.array(bounds, np.int64)

    def work(batches):
        tokens = encoder(path, KEEP)
        for batch in batches:
            ids = tokens.encode(batch.column(1))
            keys = batch.column(0).cast(pa.int64())
            shard = np.searchsorted(borders, keys.fill_null(np.iinfo(np.int64).min).to_numpy())
            for at in range(0, len(ids), 2048):
                some = slice(at, at + 2048)
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], pa.array(ids[some], pa.binary()), pa.array(shard[some], pa.int32())], ["doc_id", "ids", "shard"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, shard int")


def write(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> str:
    """Encode ``docs`` and write shards, manifest and index; returns the folder."""
    spark = docs.sparkSession
    end = struct.pack("<H", end_id)
    if max(end) > 127:
        raise ValueError("the end id's two bytes must be below 128 to serve as separator")
    folder = folder or fresh(spark, "tokens")
    n = parts(spark)
    # Shard borders from the id column alone, so the texts are encoded once and sent once.
    share = F.array(*(F.lit(i / n) for i in range(1, n)))
    found = docs.agg(F.percentile_approx(doc_id, share, 100 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(found or []))
    dealt = encoded(docs, path, bounds, doc_id, text).repartitionById(n, F.col("shard")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")

    def shard(batches):
        ids, counts, kind = [], [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids.append(batch.column(0))
            counts.append(np.array([len(x) // 2 + 1 for x in batch.column(1).to_pylist()], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["value"])
        if ids and sum(map(len, ids)):
            out = io.BytesIO()
            rows = pa.table({"doc_id": pa.chunked_array(ids, kind), "n_tokens": np.concatenate(counts)})
            with pa.ipc.new_stream(out, rows.schema) as sink:
                sink.write_table(rows)
            stream = out.getvalue()
            yield pa.RecordBatch.from_arrays([pa.array([stream + struct.pack("<Q", len(stream)) + MAGIC], pa.binary())], ["value"])

    payload = dealt.select("doc_id", "ids").mapInArrow(shard, "value binary").select(F.col("value").cast("string"))
    payload.write.option("lineSep", end.decode("ascii")).text(f"{folder}/shards")
    _index(spark, folder, docs.schema[doc_id].dataType.simpleString())
    return folder


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _footer(source) -> pa.Table | None:
    size = source.size()
    if size < 18:
        return None
    tail = source.read_at(18, size - 18)[:16]  # the separator stands after the footer, too
    if tail[8:] != MAGIC:
        raise ValueError("not a token shard")
    length = struct.unpack("<Q", tail[:8])[0]
    return pa.ipc.open_stream(source.read_at(length, size - 18 - length)).read_all()


def directory(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``(shard, path, doc_id, nth, at, n_tokens)`` of every document, from the shards' footers."""

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as source:
                    rows = _footer(source)
                if rows is None:
                    continue
                n = rows.column("n_tokens").to_numpy()
                ids = rows.column("doc_id").combine_chunks()
                codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()  # equal ids stand together
                start = np.maximum.accumulate(np.where(np.r_[True, codes[1:] != codes[:-1]], np.arange(len(n)), 0))
                columns = [pa.array([int(path.rsplit("part-", 1)[1][:5])] * len(n), pa.int32()), pa.array([path] * len(n)), ids, pa.array(np.arange(len(n)) - start), pa.array(np.cumsum(n) - n), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "doc_id", "nth", "at", "n_tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards").select("path")
    return files.repartition(parts(spark)).mapInArrow(work, f"shard int, path string, doc_id {kind}, nth long, at long, n_tokens long")


# ---- minimal perfect hash -------------------------------------------------


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of 64-bit hashes in a level: a multiply-and-shift mix, seeded by the level."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits, and the hashes that no level took (equal ones only)."""
    sizes, bits, left = [], [], h
    while len(left) and len(sizes) < LEVELS:
        size = max(1, int(GAMMA * len(left)))
        place = _place(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), left


def slots(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each hash among the set bits, -1 where no level takes it."""
    rank = np.cumsum(bits) - 1
    out = np.full(len(h), -1, np.int64)
    open_, base = np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        place = base + _place(h[open_], level, size)
        hit = bits[place]
        out[open_[hit]] = rank[place[hit]]
        open_, base = open_[~hit], base + size
    return out


def _hashed(rows: DataFrame, buckets) -> DataFrame:
    """Adds the key's hash, its fingerprint from a second hash, and its bucket."""
    rows = rows.withColumn("h", F.xxhash64("doc_id", "nth"))
    rows = rows.withColumn("f", F.shiftrightunsigned(F.xxhash64("nth", "doc_id", F.lit("fingerprint")), 32))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit("bucket")), F.lit(buckets)))


_INDEX = "bucket long, sizes array<int>, bits binary, rest array<struct<h:long,f:long,slot:int>>, f binary, shard binary, at binary, n binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h = pdf["h"].to_numpy().view(np.uint64)
    sizes, bits, _ = perfect_hash(h)
    slot = slots(h, sizes, bits)
    over = np.flatnonzero(slot < 0)
    slot[over] = int(bits.sum()) + np.arange(len(over))
    rest = [{"h": int(pdf["h"].iloc[i]), "f": int(pdf["f"].iloc[i]), "slot": int(slot[i])} for i in over]

    def by_slot(column: str, kind: str) -> bytes:
        out = np.empty(len(h), kind)
        out[slot] = pdf[column].to_numpy()
        return out.tobytes()

    return pd.DataFrame([(int(pdf["bucket"].iloc[0]), sizes, np.packbits(bits).tobytes(), rest, by_slot("f", "<u4"), by_slot("shard", "<u4"), by_slot("at", "<u8"), by_slot("n_tokens", "<u4"))], columns=["bucket", "sizes", "bits", "rest", "f", "shard", "at", "n"])


def _index(spark: SparkSession, folder: str, kind: str) -> None:
    rows = directory(spark, folder, kind)
    rows.write.option("compression", "zstd").parquet(f"{folder}/directory")
    rows = spark.read.parquet(f"{folder}/directory")
    totals = rows.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    totals = totals.withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))  # a row per shard
    totals.write.parquet(f"{folder}/manifest")
    docs = spark.read.parquet(f"{folder}/manifest").agg(F.sum("docs")).first()[0] or 0
    buckets = docs // BUCKET + 1
    keys = _hashed(rows, buckets)
    keys.groupBy("bucket").applyInPandas(_build, _INDEX).withColumn("buckets", F.lit(buckets)).write.option("compression", "zstd").parquet(f"{folder}/index")


# ---- reading ---------------------------------------------------------------


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = keys[["doc_id", "nth"]].assign(shard=np.int32(-1), at=np.int64(0), n_tokens=np.int64(0))
    if len(index) and len(keys):
        row = index.iloc[0]
        sizes = list(row["sizes"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        slot = slots(keys["h"].to_numpy().view(np.uint64), sizes, bits)
        for x in row["rest"]:
            slot[((keys["h"] == x["h"]) & (keys["f"] == x["f"])).to_numpy()] = x["slot"]
        known = np.frombuffer(row["f"], "<u4")
        ok = slot >= 0
        ok[ok] = known[slot[ok]] == keys["f"].to_numpy()[ok]
        out = out[ok]
        slot = slot[ok]
        for name, column, kind in (("shard", "shard", "<u4"), ("at", "at", "<u8"), ("n_tokens", "n", "<u4")):
            out[name] = np.frombuffer(row[column], kind)[slot].astype(out[name].dtype)
        return out
    return out[:0]


def locate(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, nth, shard, at, n_tokens)`` of the keys ``(doc_id, nth)`` that the index holds."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    row = index.select("buckets").first()
    kind = keys.schema["doc_id"].dataType.simpleString()
    hashed = _hashed(keys.select("doc_id", F.col("nth").cast("long")), row[0] if row else 1)
    return hashed.groupBy("bucket").cogroup(index.drop("buckets").groupBy("bucket")).applyInPandas(lambda a, b: _find(a, b), f"doc_id {kind}, nth long, shard int, at long, n_tokens long")


def read(keys: DataFrame, folder: str, make, schema: str) -> DataFrame:
    """Read the located keys' ids and pass them on.

    ``make(rows, payloads)`` gets ``(doc_id, start, n_tokens)`` as an Arrow table
    and the raw ids of each row, and returns a record batch of ``schema``.
    """
    spark = keys.sparkSession
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "path", "base")
    found = locate(keys, folder).join(manifest, "shard").withColumn("start", F.col("base") + F.col("at"))

    def work(batches):
        path, source = None, None
        for batch in batches:
            names, at, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            payloads, held, first = [], b"", 0
            for i, name in enumerate(names):
                if name != path:
                    if source:
                        source.close()
                    path, source, held = name, _open(name), b""
                lo, hi = 2 * int(at[i]), 2 * int(at[i] + n[i])
                if lo < first or hi > first + len(held):  # neighbours share one read
                    j = i
                    while j + 1 < len(names) and names[j + 1] == name and 2 * at[j + 1] == 2 * (at[j] + n[j]) and 2 * (at[j + 1] + n[j + 1]) - lo <= _READ:
                        j += 1
                    first, held = lo, source.read_at(2 * int(at[j] + n[j]) - lo, lo)
                payloads.append(held[lo - first : hi - first])
            yield make(pa.table({"doc_id": batch.column(3), "start": batch.column(4), "n_tokens": batch.column(2)}), payloads)
        if source:
            source.close()

    order = found.repartitionByRange(parts(spark), "start").sortWithinPartitions("start")
    return order.select("path", "at", "n_tokens", "doc_id", "start").mapInArrow(work, schema)


def keys_of(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One key ``(doc_id, nth)`` for each row."""
    n = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("n"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids array<int>)`` of the keys that were written."""

    def make(rows, payloads):
        ids = pa.array([np.frombuffer(x, "<u2").astype(np.int32) for x in payloads], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns] + [ids], ["doc_id", "start", "n_tokens", "ids"])

    return read(keys, folder, make, f"doc_id {keys.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids array<int>")


def checksums(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the keys that were written."""

    def make(rows, payloads):
        sums = pa.array([crc(x) for x in payloads], pa.int64())
        return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns] + [sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(keys, folder, make, f"doc_id {keys.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
