"""SimHash near-duplicate detection with multi-index hashing.

Each fingerprint is cut into segments. A table holds every fingerprint under its segment
values; a probe enumerates the small Hamming ball around each of its own segment values,
fetches what the table has there and checks the complete distance. If two fingerprints
differ in at most ``d`` bits, one of ``m`` segments differs in at most ``d // m``, so the
balls miss nothing.

``neardup`` searches sets of shingles by it, for near duplicates by their similarity.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import connected_components

#: Segments of 32 bits.
SEGMENT_BITS = 32
#: A table bucket with more fingerprints than this is searched by finer keys instead.
DENSE = 64
#: For those: blocks of a 64-bit fingerprint. All but ``d`` blocks of a pair agree.
BLOCKS = 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of each run of n words joined by a space (of the whole text if it has fewer words)."""
    text = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(text, seed)], dtype=np.uint64)
    ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size, initial=-1))[1:]
    begins = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[b:e], seed) for b, e in zip(begins, ends[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per column of an (n, w) array of hashes, the 64 bits that are set in over half of them."""
    n, width = hashes.shape
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, n, 65280):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 65280], "<u8").view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: bytes | None, n: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    return int(majority(shingle_hashes(words, n, seed)[:, None])[0]) if words else 0


def _fingerprint_batches(batches, n: int):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = pa.array([_signed(fingerprint(t, n)) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's whole text, as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_fingerprint_batches, n=words), "doc_id long, fp long")


def _ball(radius: int) -> list[int]:
    """The differences of at most ``radius`` bits within a segment."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), r)]


def _segments(words: list[Column]) -> list[Column]:
    return [part for w in words for part in (w.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(w, 32))]


def _differing(seg: int, part: Column):
    """Function of a difference: the segment number and value with that difference."""
    return lambda x: F.struct(F.lit(seg).alias("seg"), part.bitwiseXOR(x).alias("val"))


def candidates(prints: DataFrame, node: str, words: list[str], radius: int, dense: int = DENSE, keep: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Multi-index search among distinct rows.

    Returns stored pairs (a, b), a < b, of nodes that meet in a bucket of at most ``dense``
    table entries (and pass ``keep`` over a and b); the (seg, val, node) rows of fuller
    buckets, probes included; and all table rows. No bucket gives more than ``dense`` pairs a probe, and
    a fuller one gives one row a probe, so the caller's finer search sees every member.
    """
    parts = _segments([F.col(w) for w in words])
    table = prints.select(F.col(node).alias("b"), F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), p.alias("val")) for i, p in enumerate(parts)])).alias("k")).select("b", "k.seg", "k.val")
    full = table.groupBy("seg", "val").count().where(F.col("count") > dense).select("seg", "val")
    entries = table.join(full, ["seg", "val"], "left_anti").select("seg", "val", "b").union(full.select("seg", "val", F.lit(None).cast("long")))
    ball = F.array(*[F.lit(x).cast("long") for x in _ball(radius)])
    around = [F.transform(ball, _differing(i, p)) for i, p in enumerate(parts)]
    probes = prints.select(F.col(node).alias("a"), F.explode(F.concat(*around)).alias("k")).select("a", "k.seg", "k.val")
    meets = F.col("b") > F.col("a") if keep is None else (F.col("b") > F.col("a")) & keep
    p, e = probes.alias("p").hint("merge"), entries.alias("e")  # by the size of ``prints`` Spark would broadcast all balls
    hits = stored(p.join(e, (F.col("p.seg") == F.col("e.seg")) & (F.col("p.val") == F.col("e.val")) & (F.col("b").isNull() | meets)).select("p.seg", "p.val", "a", "b"))
    return hits.where("b is not null").select("a", "b").distinct(), hits.where("b is null").select("seg", "val", F.col("a").alias("node")), table


def hamming_links(prints: DataFrame, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of ``fp`` that differ in 1 to max_bits bits (1 to 3).

    Members of crowded buckets are searched by finer keys: the fingerprint with ``max_bits``
    of its 16 blocks blanked out. Such a key leaves 4 * max_bits bits open, so no bucket
    can hold more than 2 ** (4 * max_bits) fingerprints, however many copies there are.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    prints = prints.select("fp").where("fp is not null").distinct()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    sparse, crowded, _ = candidates(prints, "fp", ["fp"], max_bits // 2, dense, near)
    if crowded.isEmpty():
        return sparse
    width = 64 // BLOCKS
    masks = [_signed(((1 << 64) - 1) ^ sum(((1 << width) - 1) << (width * b) for b in out)) for out in combinations(range(BLOCKS), max_bits)]
    keys = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m, i: F.struct(i.alias("i"), F.col("node").bitwiseAND(m).alias("key")))
    finer = crowded.select("node").distinct().select("node", F.explode(keys).alias("k")).select("node", "k.i", "k.key")
    left, right = finer.select("i", "key", F.col("node").alias("a")).alias("l"), finer.select("i", "key", F.col("node").alias("b")).alias("r")
    rest = left.join(right, (F.col("l.i") == F.col("r.i")) & (F.col("l.key") == F.col("r.key")) & (F.col("b") > F.col("a")) & near).select("a", "b")
    return sparse.union(rest).distinct()


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is
    the least doc_id that a row reaches. Equal fingerprints are one node. A null or blank
    text has fingerprint zero; repeated rows each get their row; a null doc_id gets its
    group's id and names no group (null where all ids of the group are null); other columns
    are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(hamming_links(nodes, max_bits, dense))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    groups = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(groups, "root").select("fp", "component_id")
    ids = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
