"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. All
suffixes of a corpus are too many to move, so the array is sparse: of every 50-byte window,
the least hash among its 27 strings of 24 bytes marks an anchor. Equal windows have equal
anchors at equal offsets, so it is enough to compare what surrounds anchors:

1. anchors are grouped by hash; those of one document only are dropped;
2. anchors with the whole context (26 bytes to the left, 50 to the right) of a smaller
   document are settled: their context goes;
3. the others, where contexts of one anchor string differ, are sorted as suffixes and as
   reversed prefixes: multikey quicksort on 8-byte words to a shallow depth, then blind tries
   for the groups that still tie. Common prefix lengths of neighbours give, for each of the
   27 windows around an anchor, the class of equal windows and its least document.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, slot_filter, stored

#: Length of the strings; of the anchor strings; windows that hold an anchor string at a place.
LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM
#: Bytes hashed at once; slots of the filter of shared hashes, as a power of two: 8 MB, whatever the size of the corpus.
CHUNK, FILTER_BITS = 1 << 18, 26
_TABLE = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return op(x[:-rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of texts of 50 bytes or more each."""
    lens = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(lens)])
    with np.errstate(over="ignore"):
        h, have = _TABLE[buf], 1
        eight = None
        for _ in range(4):  # strings of 2, 4, 8 and 16 bytes
            h = h[:-have] * _power(have) + h[have:]
            have *= 2
            eight = h if have == 8 else eight
        h = h[: len(buf) - GRAM + 1] * _power(8) + eight[16 : 16 + len(buf) - GRAM + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h[h == 0] = 1
    least = _slide(h, REACH + 1, np.minimum)  # of each window; 0 for those that pass a text's end
    valid = np.ones(len(least), bool)
    for e in begin[1:-1]:
        valid[max(0, e - LENGTH + 1) : e] = False
    least[~valid] = 0
    pad = np.zeros(REACH, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)[: len(h)]
    at = np.flatnonzero(most == h)
    no = np.searchsorted(begin, at, side="right") - 1
    return no, at - begin[no], h[at]


def _anchored(batches):
    """(ids, text numbers, positions, hashes, texts, text ids) of pieces of rows (doc_id, text, tid), texts of 50 bytes or more."""
    for batch in batches:
        ids, tids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
        at = 0
        while at < len(long):
            part, total = [], 0
            while at < len(long) and (total < CHUNK or not part):
                part.append(long[at])
                total += len(texts[long[at]])
                at += 1
            own = [texts[i] for i in part]
            no, pos, h = anchors(own)
            yield np.array([ids[i] for i in part], np.int64), no, pos, h, own, np.array([tids[i] for i in part], np.int64)


def _anchor_batches(batches):
    """Hashes of anchors, and the documents that hold them."""
    for ids, no, _, h, _, _ in _anchored(batches):
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[no])], names=["h", "doc_id"])


def _keyed_batches(batches, wanted):
    """Anchors whose slot is in the filter, with hashes of the anchor string and of its context."""
    for ids, no, pos, h, texts, tids in _anchored(batches):
        slot = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)  # the lower bits: anchors are least hashes, so their upper ones are mostly 0
        keep = (wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
        no, pos, h = no[keep], pos[keep], h[keep]
        contexts = np.zeros(len(no), np.int64)
        for k, (i, p) in enumerate(zip(no.tolist(), pos.tolist(), strict=True)):
            low = max(0, p - REACH)
            context = texts[i][low : p + LENGTH]
            contexts[k] = xxhash.xxh64_intdigest(context, p - low + 64 * len(context)) - (1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(contexts), pa.array(ids[no]), pa.array(tids[no]), pa.array(pos.astype(np.int32))], names=["h", "c", "doc_id", "tid", "pos"])


SHIPPED = "h long, doc_id long, tid long, pos int, suffix binary, prefix binary, after int"
WINDOWS = "doc_id long, tid long, pos int, o int, h long, w long"


def _ship_batches(batches, windows: bool):
    """Anchors of texts at given positions: what is around them, as bytes; or the hashes of the 50-byte windows that hold them."""
    names, kinds = (["doc_id", "tid", "pos", "o", "h", "w"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]) if windows else (["h", "doc_id", "tid", "pos", "suffix", "prefix", "after"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()])
    for batch in batches:
        ids, tids, texts, places = (batch.column(i).to_pylist() for i in range(4))
        at = 0
        while at < len(ids):
            rows: list[tuple] = []
            while at < len(ids) and len(rows) < 50_000:
                b, d, t = texts[at], ids[at], tids[at]
                for p in places[at]:
                    low = max(0, p - REACH)
                    key = xxhash.xxh64_intdigest(b[p : p + GRAM], 1) - (1 << 63)
                    if windows:
                        rows += [(d, t, p, p - x, key, xxhash.xxh64_intdigest(b[x : x + LENGTH], p - x) - (1 << 63)) for x in range(low, min(p, len(b) - LENGTH) + 1)]
                    else:
                        rows.append((key, d, t, p, b[p : p + LENGTH], b[low:p][::-1], min(REACH, len(b) - p - GRAM)))
                at += 1
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


# --- deep-shallow sorting ---------------------------------------------------------------

#: Words of 8 bytes that the quicksort looks at; groups this small go to a blind trie at once.
SHALLOW, SMALL = 2, 24


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Members in the order of their strings, by a blind (Patricia) trie.

    A node is (depth, {byte: child}), a leaf the list of members with one string. An
    insertion walks down blindly to any leaf, finds the common prefix with that one string,
    and only then knows where its branch is.
    """
    size = len(strings[members[0]])
    root: tuple | list = [members[0]]
    for m in members[1:]:
        s, node = strings[m], root
        while type(node) is tuple:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0]]
        if s == other:
            node.append(m)
            continue
        common = size - ((int.from_bytes(s) ^ int.from_bytes(other)).bit_length() + 7) // 8
        above, node = None, root
        while type(node) is tuple and node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == common:
            node[1][s[common]] = [m]
            continue
        branch = (common, {other[common]: node, s[common]: [m]})
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_order(strings: list[bytes]) -> np.ndarray:
    """Indices of strings of one length in their order: multikey quicksort, then blind tries."""
    if not strings:
        return np.zeros(0, np.int64)
    size, n = len(strings[0]), len(strings)
    raw = np.frombuffer(b"".join(strings), np.uint8).reshape(n, size)
    wide = np.zeros((n, 8 * SHALLOW), np.uint8)
    wide[:, : min(size, 8 * SHALLOW)] = raw[:, : 8 * SHALLOW]
    words = wide.view(">u8").astype(np.uint64)
    out, stack = [], [(np.arange(n), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            out.append(group)
        elif depth == SHALLOW or len(group) <= SMALL:
            out.append(np.array(blind_trie(strings, group.tolist()), np.int64))
        else:
            key = words[group, depth]
            pivot = np.partition(key, len(key) // 2)[len(key) // 2]
            stack += [(group[key > pivot], depth), (group[key == pivot], depth + 1), (group[key < pivot], depth)]
    return np.concatenate(out)


def prefix_classes(strings: list[bytes], size: int) -> np.ndarray:
    """(size + 1, n) classes of equal prefixes: row d numbers the distinct first d bytes."""
    n = len(strings)
    padded = [s.ljust(size, b"\0") for s in strings]
    order = deep_shallow_order(padded)
    rows = np.frombuffer(b"".join(padded), np.uint8).reshape(n, size)[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    out = np.zeros((size + 1, n), np.int64)
    for d in range(1, size + 1):
        out[d, order[1:]] = np.cumsum(common < d)
    return out


def window_masks(suffixes: list[bytes], prefixes: list[bytes], after: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each anchor, bit o set if the window that begins o bytes before it also occurs in a smaller document."""
    n = len(suffixes)
    right, left = prefix_classes(suffixes, LENGTH), prefix_classes(prefixes, REACH)
    before = np.array([len(p) for p in prefixes])
    mask = np.zeros(n, np.int64)
    for o in range(REACH + 1):
        ok = np.flatnonzero((before >= o) & (after >= REACH - o))
        if not len(ok):
            continue
        key = left[o, ok] * n + right[LENGTH - o, ok]
        order = np.argsort(key, kind="stable")
        key, own = key[order], docs[ok[order]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.concatenate([first, [len(key)]])))
        mask[ok[order]] |= (least < own).astype(np.int64) << o
    return mask


#: Contexts sorted at once: whole groups of one anchor string, this many rows or one group.
SORT_ROWS = 40_000


def _mask_batches(batches):
    """Rows (h, doc_id, tid, pos, suffix, prefix, after) in the order of h -> (doc_id, tid, pos, mask)."""
    held: list[list] = [[] for _ in range(7)]

    def solved(upto: int):
        part = [c[:upto] for c in held]
        for c in held:
            del c[:upto]
        masks = window_masks(part[4], part[5], np.array(part[6]), np.array(part[1], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int32()), pa.array(masks)], names=["doc_id", "tid", "pos", "mask"])

    for batch in batches:
        for i, c in enumerate(held):
            c.extend(batch.column(i).to_pylist())
        if len(held[0]) >= SORT_ROWS:
            upto = len(held[0])
            while upto and held[0][upto - 1] == held[0][-1]:
                upto -= 1  # the last group may go on
            if upto:
                yield solved(upto)
    if held[0]:
        yield solved(len(held[0]))


#: Mask of an anchor whose whole context occurs in a smaller document.
WHOLE = (1 << (REACH + 1)) - 1


def removed_runs(size: int, places: list[int], masks: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows of some anchors cover."""
    spans = []
    for p, mask in zip(places, masks, strict=True):
        if mask == WHOLE:
            low, high = max(0, p - REACH), min(size, p + LENGTH)
            if high - low >= LENGTH:
                spans.append((low, high))
            continue
        while mask:
            o = mask.bit_length() - 1
            spans.append((p - o, p - o + LENGTH))
            mask &= ~(1 << o)
    spans.sort()
    runs: list[list[int]] = []
    for low, high in spans:
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(high, runs[-1][1])
        else:
            runs.append([low, high])
    return [(a, b) for a, b in runs]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for low, high in runs:
        out.append(text[at:low])
        at = high
    return b"".join([*out, text[at:]])


def _result_batches(batches):
    for batch in batches:
        out = []
        for d, text, places, masks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = removed_runs(len(text), places or [], masks or [])
            out.append((d, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(text, runs)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in RESULT.split(", ")])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))


def _shared_hashes(texts: DataFrame):
    """The filter of anchor hashes that occur in two documents, as a broadcast. They are counted with a
    combine in each task, so a hash that most documents have costs a row a task."""
    found = texts.where("doc_id is not null").mapInArrow(_anchor_batches, "h long, doc_id long").groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return texts.sparkSession.sparkContext.broadcast(slot_filter(found.select(F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("slot")), FILTER_BITS))


def _judged_anchors(texts: DataFrame, wanted) -> DataFrame:
    """(doc_id, tid, pos, whole, n): anchors that a smaller document has with their whole context, and
    those of strings with several contexts, with the number of such anchors of the string. The others
    (and those that only share a slot of the filter) have nothing to lose."""
    keyed = texts.where("doc_id is not null").mapInArrow(partial(_keyed_batches, wanted=wanted), "h long, c long, doc_id long, tid long, pos int").repartition("h")
    by_context, by_string = W.partitionBy("h", "c"), W.partitionBy("h")
    whole = keyed.withColumn("whole", F.min("doc_id").over(by_context) < F.col("doc_id"))
    judged = whole.select("doc_id", "tid", "pos", "whole", F.min("c").over(by_string).alias("c0"), F.max("c").over(by_string).alias("c1"), F.count(F.when(~F.col("whole"), 1)).over(by_string).alias("n"))
    return stored(judged.where("whole or c0 <> c1").select("doc_id", "tid", "pos", "whole", "n"))


def _shipped(texts: DataFrame, judged: DataFrame, windows: bool) -> DataFrame:
    places = judged.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("places"))
    # rows that repeat a text of a doc_id give the same anchors again, which count once
    joined = texts.where("doc_id is not null").join(places, ["doc_id", "tid"]).select("doc_id", "tid", F.encode("text", "UTF-8").alias("text"), "places")
    return joined.mapInArrow(partial(_ship_batches, windows=windows), WINDOWS if windows else SHIPPED)


def _split_masks(windows: DataFrame) -> DataFrame:
    """Masks (doc_id, tid, pos, mask) of anchors whose strings have too many contexts for one task: a window's class is
    told by hashes of its anchor string and of its bytes, and its least document by a combined minimum."""
    least = windows.groupBy("h", "o", "w").agg(F.min("doc_id").alias("least"))
    hit = windows.join(least, ["h", "o", "w"]).where("least < doc_id")
    return hit.groupBy("doc_id", "tid", "pos").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))


def repeated_windows(docs: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """(doc_id, tid, pos, mask): anchors with at least one 50-byte window that also occurs in a document with a
    smaller doc_id. ``tid`` tells the texts of a repeated doc_id apart. Strings with more than
    ``sort_rows`` contexts are not sorted in one task but split by their windows. Shuffle files of a step go once its result is stored."""
    texts = _texts(docs)
    wanted = _shared_hashes(texts)
    release(docs.sparkSession)
    judged = _judged_anchors(texts, wanted)
    wanted.unpersist()
    release(docs.sparkSession)
    rows = _shipped(texts, judged.where(f"not whole and n <= {sort_rows}"), False)
    partly = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_mask_batches, "doc_id long, tid long, pos int, mask long").where("mask <> 0")
    crowded = judged.where(f"not whole and n > {sort_rows}")
    if not crowded.isEmpty():
        partly = partly.unionByName(_split_masks(_shipped(texts, crowded, True)))
    return judged.where("whole").select("doc_id", "tid", "pos", F.lit(WHOLE).cast("long").alias("mask")).union(partly)


def _cuts(docs: DataFrame, sort_rows: int) -> DataFrame:
    """(doc_id, tid, cuts): the anchors and masks of each document that loses something."""
    return stored(repeated_windows(docs, sort_rows).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("pos", "mask")).alias("cuts")))


def remove_repeats(docs: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. A document without an id neither gives nor loses bytes; rows that
    repeat a doc_id do not count against each other; texts under 50 bytes stay whole; a long text
    is read at once; other columns are ignored; an empty table gives no rows.
    """
    cuts = _cuts(docs, sort_rows)
    release(docs.sparkSession)
    joined = _texts(docs).join(cuts, ["doc_id", "tid"], "left")
    return joined.select("doc_id", "text", F.col("cuts.pos").alias("places"), F.col("cuts.mask").alias("masks")).mapInArrow(_result_batches, RESULT)
