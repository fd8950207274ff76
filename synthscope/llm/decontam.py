"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity says nothing, and a
fixed number of min-hashes of a document would miss the item. The search is one-sided: items
are dealt into partitions by their number of shingles (doubling), an item is signed by its k
least hashes - a uniform sample of its shingles - with k set by its partition, and each
document is asked which of its own hashes are in a signature. The share found estimates the
containment. A document with a share t of an item lacks at most q - ceil(t * q) of its q
shingles, so it holds at least k less that many of the signature: with that as the threshold
no contained item is missed. Candidates are verified by exact containment of the shingles.
"""

from __future__ import annotations

from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slot_filter, stored
from .shingles import run_hashes, word_hashes

#: Least share of an item's shingles, and words of a shingle.
CONTAINED, SHINGLE = 0.8, 5
#: Slots of the filter of signature hashes, as a power of two: 8 MB, whatever the number of items.
FILTER_BITS = 26


def shingles(text: bytes | None, n: int) -> set[bytes]:
    """The distinct n-word runs of a lower-cased text; all its words, if it has fewer; none without words."""
    words = (text or b"").lower().split()
    n = min(n, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def least_shared(q: int, t: float) -> int:
    return max(1, ceil(t * q - 1e-9))


def signature_length(q: int, t: float) -> int:
    """k of the partition of items with as many binary digits of q: what the largest may lack, and a quarter of the smallest."""
    low, high = 1 << (q.bit_length() - 1), (1 << q.bit_length()) - 1
    return min(q, high - least_shared(high, t) + max(1, low // 4))


def _sign_batches(batches, n: int, t: float):
    """Items (item_id, item_tid, text) -> their signature hashes, with how many of them a match must hold at least."""
    for batch in batches:
        out = []
        for item, tid, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            words = word_hashes(text)
            own = np.unique(run_hashes(words, min(n, len(words))))
            q = len(own)
            if q:
                k = signature_length(q, t)
                need = k - (q - least_shared(q, t))
                out += [(item, tid, min(n, len(words)), max(1, need), h) for h in own[:k].view(np.int64).tolist()]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "item_tid", "width", "need", "h"])


def _hit_batches(batches, widths: list[int], wanted):
    """Documents (doc_id, tid, text) -> their distinct hashes of runs of the widths that may be in a signature."""
    held = wanted.value
    for batch in batches:
        rows, hashes = [], []
        for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            words = word_hashes(text)
            for width in widths:
                h = run_hashes(words, width)
                slot = h & np.uint64((1 << FILTER_BITS) - 1)  # the lower bits, as signatures are least hashes
                h = np.unique(h[(held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0])
                if len(h):
                    rows.append(np.full(len(h), i))
                    hashes.append(h.view(np.int64))
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))], names=["doc_id", "tid", "h"])


def _verify_batches(batches, n: int, t: float):
    """Candidates (doc_id, tid, text, item_id, item_text) that hold at least a share t of the item's shingles."""
    last: tuple = (None, 0, set())
    for batch in batches:
        out = []
        texts, items = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 4))
        for doc, tid, text, item, own_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), items, strict=True):
            own = shingles(own_text, n)
            width = min(n, len(own_text.split()))
            if last[:2] != (text, width):
                last = (text, width, shingles(text, width))
            shared = len(own & last[2])
            if shared >= least_shared(len(own), t):
                out.append((doc, tid, item, shared, len(own)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "tid", "item_id", "n_shared", "n_item"])


def _leaks(docs: DataFrame, benchmark: DataFrame, n: int, t: float) -> DataFrame:
    """(doc_id, tid, item_id, n_shared, n_item), where ``tid`` tells the texts of a repeated or null doc_id apart."""
    spark = docs.sparkSession
    item_text, text = F.col("text").cast("string"), F.col("text").cast("string")
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(item_text).alias("item_tid"), item_text.alias("text")).where("item_id is not null and text is not null").distinct())
    signed = stored(items.mapInArrow(partial(_sign_batches, n=n, t=t), "item_id long, item_tid long, width long, need long, h long"))
    widths = sorted(r["width"] for r in signed.select("width").distinct().collect())  # n and those of shorter items: n values at most
    wanted = spark.sparkContext.broadcast(slot_filter(signed.select(F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("slot")), FILTER_BITS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    hits = texts.where("text is not null").mapInArrow(partial(_hit_batches, widths=widths, wanted=wanted), "doc_id long, tid long, h long")
    counted = hits.distinct().join(signed, "h").groupBy("doc_id", "tid", "item_id", "item_tid").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    found = stored(counted.where("n >= need").select(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid"), "item_id", "item_tid"))
    wanted.unpersist()
    # the stored list of candidates first: where it is small no document is shuffled
    held = texts.join(found, (F.col("tid") == F.col("of_tid")) & F.col("doc_id").eqNullSafe(F.col("of")))
    both = held.join(items.withColumnRenamed("text", "item_text"), ["item_id", "item_tid"]).select("doc_id", "tid", "text", "item_id", "item_text")
    return both.mapInArrow(partial(_verify_batches, n=n, t=t), "doc_id long, tid long, item_id long, n_shared long, n_item long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, t: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that contains an item.

    Documents are read once for the search, however many items there are, and once more for
    the texts of candidates; what is sent to the executors is a filter of one size. Null or blank
    texts contain nothing and are contained in nothing; an item of fewer than ``n`` words is one shingle, found
    wherever its words stand in a row; rows with a null item_id are no items, while documents
    without an id report null; repeated rows report once; texts of any length are searched
    whole, a piece at a time; other columns are ignored; an empty table on either side gives no rows.
    """
    best = _leaks(docs, benchmark, n, t).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, t: float = CONTAINED) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all columns; each row is judged by its own text.

    The list of texts to drop is stored first, so where it is small no document is shuffled.
    Nulls, blanks, repeats and empty tables as in ``find_leaks``.
    """
    doc, tid = fresh("leak", docs.columns), fresh("leak_tid", docs.columns)
    leaks = stored(_leaks(docs, benchmark, n, t).select(F.col("doc_id").alias(doc), F.col("tid").alias(tid)).distinct())
    return docs.join(leaks, (F.xxhash64(F.col("text").cast("string")) == F.col(tid)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_anti")
