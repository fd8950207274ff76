"""Document fingerprints by randomised edit embedding.

A walk reads the text: at time j it stands on one character, and a random bit that all walks
share, r(j, character), says whether it steps on. The characters seen over time are the
embedding; texts at small edit distance soon walk in step again, so edit distance becomes
Hamming distance. The fingerprint keeps one hashed bit of the embedding at sampled times, 64
in each octave of time, so texts of any length are covered to their end.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slot_filter, stored
from .graph import connected_components

#: Times after which the shared bits repeat; first octave's length; bits an octave; fixed seed.
PERIOD, FIRST, BITS, SEED = 4096, 128, 64, 20240229
#: Characters that step together, rows handled at once, and walks so few that each goes on alone.
STEP_BYTES, STEP_ROWS, FEW = 1 << 22, 2048, 12


@lru_cache(maxsize=1)
def _tables() -> tuple[list[list[int]], np.ndarray]:
    """How many times the walk stands on a character that it reaches at a time, and the bits that samples keep."""
    rng = np.random.default_rng(SEED)
    steps = rng.integers(0, 2, (256, PERIOD)).astype(bool)
    steps[:, -1] = True
    stay = np.zeros((256, PERIOD), np.int64)
    after = np.zeros(256, np.int64)
    for t in range(PERIOD - 1, -1, -1):
        after = np.where(steps[:, t], 1, after + 1)
        stay[:, t] = after
    return stay.tolist(), rng.integers(0, 2, (PERIOD, 256)).astype(np.uint8)


@lru_cache(maxsize=64)
def _times(octave: int) -> np.ndarray:
    begin, size = (0, FIRST) if octave == 0 else (FIRST << (octave - 1), FIRST << (octave - 1))
    jitter = np.random.default_rng([SEED, octave]).random(BITS)
    return begin + ((np.arange(BITS) + jitter) * size / BITS).astype(np.int64)


def codes(text: str) -> bytes:
    """One byte a code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points ^ (points >> 7) ^ (points >> 14)) & 0xFF).astype(np.uint8).tobytes()


def walk(chars: bytes, start: int = 0) -> np.ndarray:
    """Times at which one walk reaches each character and, last, the end."""
    stay, _ = _tables()
    mask = PERIOD - 1
    return np.fromiter(accumulate(chars, lambda t, c: t + stay[c][t & mask], initial=start), np.int64, len(chars) + 1)


@lru_cache(maxsize=1)
def _flat_stay() -> np.ndarray:
    return np.array(_tables()[0], np.int64).ravel()


def walks(chars: list[bytes], starts: list[int]) -> list[np.ndarray]:
    """``walk`` of many texts: those of like length step together, a character at a time."""
    stay, mask, out = _flat_stay(), PERIOD - 1, [None] * len(chars)
    order = sorted(range(len(chars)), key=lambda i: -len(chars[i]))
    at = 0
    while at < len(order):
        lanes, total = [], 0
        while at < len(order) and (total < STEP_BYTES or not lanes):
            lanes.append(order[at])
            total += len(chars[order[at]])
            at += 1
        lens = [len(chars[i]) for i in lanes]
        rows = np.frombuffer(b"".join(chars[i] for i in lanes), np.uint8).astype(np.int64) * PERIOD
        begin = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        goes = begin + np.arange(len(begin))  # each walk has one time more than characters
        times = np.empty(len(rows) + len(lanes), np.int64)
        t = np.array([starts[i] for i in lanes], np.int64)
        times[goes[:-1]] = t
        reads, writes, live, step = begin[:-1].copy(), goes[:-1] + 1, len(lanes), 0
        while True:
            while live and lens[live - 1] <= step:
                live -= 1
            if live <= FEW:
                break
            r, w, now = reads[:live], writes[:live], t[:live]
            now += stay[rows[r] + (now & mask)]
            times[w] = now
            r += 1
            w += 1
            step += 1
        for k in range(live):  # the few longest go on alone
            rest = walk(chars[lanes[k]][step:], int(t[k]))
            times[goes[k] + step : goes[k + 1]] = rest
        for k, i in enumerate(lanes):
            out[i] = times[goes[k] : goes[k + 1]]
    return out


def _n_octaves(end: int) -> int:
    n = 1
    while FIRST << (n - 1) < end:
        n += 1
    return n


@lru_cache(maxsize=64)
def _all_times(octaves: int) -> np.ndarray:
    return np.concatenate([_times(o) for o in range(octaves)])


def _print(chars: np.ndarray, times: np.ndarray) -> str:
    _, keep = _tables()
    end = int(times[-1])
    at = _all_times(_n_octaves(end))
    bits = np.zeros(len(at), np.uint8)
    live = np.searchsorted(at, end) if len(chars) else 0
    here = chars[np.searchsorted(times, at[:live], side="right") - 1] if live else chars
    bits[:live] = keep[at[:live] & (PERIOD - 1), here]
    return f"{end:x}:{np.packbits(bits).tobytes().hex()}"


def fingerprint(text: str) -> str:
    """Length of the walk in hex, a colon, and 16 hex digits an octave. Equal texts have equal fingerprints."""
    c = codes(text)
    return _print(np.frombuffer(c, np.uint8), walk(c))


def likeness(a: str, b: str) -> float:
    """Agreement of the sampled bits beyond chance, 0 to 1, each octave weighing the time that it covers."""
    if a == b:
        return 1.0
    (ea, xa), (eb, xb) = (x.split(":") for x in (a, b))
    ea, eb = int(ea, 16), int(eb, 16)
    n = min(len(xa), len(xb)) // 16
    differ = np.unpackbits(np.frombuffer(bytes.fromhex(xa[: 16 * n]), np.uint8) ^ np.frombuffer(bytes.fromhex(xb[: 16 * n]), np.uint8))
    low, high = min(ea, eb), max(ea, eb)
    if not low:
        return 0.0
    octaves = _n_octaves(high)
    at = _all_times(octaves)
    both = np.searchsorted(at, low)  # where one text has ended, nothing is alike
    score = np.zeros(octaves * BITS)
    score[:both] = 1.0 - 2.0 * differ[:both]
    alike = score.reshape(-1, BITS).sum(axis=1) / np.maximum((at < high).reshape(-1, BITS).sum(axis=1), 1)
    ends = np.minimum(FIRST << np.arange(octaves), high)
    spans = np.diff(np.concatenate([[0], ends]))
    return float(min(1.0, max(0.0, (alike * spans).sum() / spans.sum())))


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(rows: list[list]) -> list[tuple]:
    """Results of consecutive documents [doc_id, text, codes, times, fingerprint] but the last, which is only a successor."""
    pairs = [(doc, ahead, len(doc[1]) - len(doc[1]) // 2, len(doc[1]) // 2) for doc, ahead in zip(rows, rows[1:], strict=False)]
    ends = walks([ahead[2][:half] for _, ahead, _, half in pairs], [int(doc[3][keep]) for doc, _, keep, _ in pairs])
    out = []
    for (doc, ahead, keep, half), rest in zip(pairs, ends, strict=True):
        other = _print(np.frombuffer(doc[2][:keep] + ahead[2][:half], np.uint8), np.concatenate([doc[3][:keep], rest]))
        digest = hashlib.sha256(edited(doc[1], ahead[1]).encode()).hexdigest()
        out.append((doc[0], len(doc[1]), digest, doc[4], other, likeness(doc[4], other), likeness(doc[4], ahead[4])))
    return out


def buckets(ids: pa.Array, ties: np.ndarray, cuts: np.ndarray, parts: int) -> np.ndarray:
    """The range of each row in the order of ids downwards, then rows without one by ``ties``. An id that several
    cuts fall on is cut by ``ties`` itself."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    down = ~ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(cuts, down, "left"), np.searchsorted(cuts, down, "right")
    share = (ties.view(np.uint64) ^ np.uint64(1 << 63)) / 2.0**64  # rises with the tie
    inside = np.where(high - low > 1, low + 1 + np.minimum((share * (high - low)).astype(np.int64), high - low - 1), high)
    return np.where(known, inside, len(cuts) + 1 + np.minimum((share * parts).astype(np.int64), parts - 1)).astype(np.int32)


def _place_batches(batches, cuts: np.ndarray, parts: int):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets(batch.column(0), batch.column(1).to_numpy(), cuts, parts))], names=["doc_id", "tie", "bucket"])


def _deal_batches(batches, cuts: np.ndarray, parts: int, hosts: dict):
    """Rows (doc_id, tie, text) with their range, the text compressed so that less is shuffled; the head of a range also as a guest of the range before."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        place = buckets(batch.column(0), batch.column(1).to_numpy(), cuts, parts)
        texts = pa.array([pack.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        keys = zip(place.tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        heads = [(i, hosts[k]) for i, k in enumerate(keys) if k in hosts]
        rows = pa.array([*range(batch.num_rows), *[i for i, _ in heads]], pa.int64())
        place = pa.array(np.concatenate([place, np.array([h for _, h in heads], np.int32)]))
        guest = pa.array(np.repeat(np.array([0, 1], np.int32), [batch.num_rows, len(heads)]))
        yield pa.RecordBatch.from_arrays([place, guest, batch.column(0).take(rows), batch.column(1).take(rows), texts.take(rows)], names=["bucket", "guest", "doc_id", "tie", "text"])


def _stream(batches):
    """Rows (bucket, guest, doc_id, packed text) in order; each document's successor is the next row of its bucket."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    unpack = zstandard.ZstdDecompressor()
    run, bucket, closed = [], None, True  # closed: the bucket's guest has come
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(at, STEP_ROWS)
            places, guests, ids, packed = (part.column(i).to_pylist() for i in range(4))
            texts = [unpack.decompress(x).decode() for x in packed]
            chars = [codes(t) for t in texts]
            out = []
            for b, guest, doc_id, text, c, times in zip(places, guests, ids, texts, chars, walks(chars, [0] * len(chars)), strict=True):
                if b != bucket:
                    out += _results(run)
                    run, bucket, closed = [], b, False
                if closed:
                    continue
                run.append([doc_id, text, c, times, _print(np.frombuffer(c, np.uint8), times)])
                closed = bool(guest)
            out += _results(run)
            run = run[-1:]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: fingerprints of the text and of its edited text, and how alike they are.

    The successor of a document is the next in descending doc_id (nulls last, ties by a hash
    of the text), and of the last one the first. Ids are cut into ranges with about as many rows
    each, at quantiles; a range is sorted and streamed, and gets the head of the next range as a
    guest, so texts are shuffled once, and a task holds a batch of rows and long texts one by one.
    Null texts are empty; a single row follows itself; repeated rows follow each other; other
    columns are ignored; an empty table gives no rows.
    """
    parts = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    down = F.bitwise_not("doc_id")  # rises as the id falls, and no id overflows
    got = rows.agg(F.percentile_approx(down, [i / parts for i in range(1, parts)], 10 * parts).alias("cuts")).first()["cuts"]
    cuts = np.sort(np.array(got or [], np.int64))
    # one row per range: as many as cuts, and as many for rows without an id
    placed = rows.select("doc_id", "tie").mapInArrow(partial(_place_batches, cuts=cuts, parts=parts), "doc_id long, tie long, bucket int")
    heads = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min(F.struct(down.alias("down"), "tie")).alias("head")).select("bucket", F.bitwise_not("head.down"), "head.tie").collect())
    hosts = {h: heads[k - 1][0] for k, h in enumerate(heads)}
    dealt = rows.mapInArrow(partial(_deal_batches, cuts=cuts, parts=parts, hosts=hosts), "bucket int, guest int, doc_id long, tie long, text binary")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", down.asc_nulls_last(), "tie", "text")
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(_stream, RESULT)


#: Bits of a band, and bands for each of the two classes of length that a text has keys for: two
#: texts of one class whose bits agree in nineteen of twenty share none with probability (1 - 0.95 ** 24) ** 24 = 0.0003.
BAND_BITS, BANDS = 24, 12
#: Likeness from which two fingerprints are linked.
ALIKE = 0.8
#: Slots of the filter of keys that several texts have: a prime below what a filter holds.
SLOTS = 8_388_593


@lru_cache(maxsize=512)
def _sampled(length: int, least: float) -> np.ndarray:
    """For each band the bits it holds, drawn evenly over the time that every walk of a class of length covers."""
    end = (1 / least) ** length
    at = np.random.default_rng([SEED, 1000 + length]).random((BANDS, BAND_BITS)) * end
    return np.maximum(np.searchsorted(_all_times(_n_octaves(int(end) + 1)), at, side="right") - 1, 0)


def band_keys(fingerprint: str, least: float = ALIKE) -> np.ndarray:
    """Keys of the bands of a fingerprint, for the class of its walk's length and for the one below: walks
    of likeness ``least`` or more differ by one class at most, so they have one in common. None for an empty text."""
    end, digits = fingerprint.split(":")
    end = int(end, 16)
    if not end:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8)).astype(np.int64)
    length = int(np.log(end) / -np.log(least) + 1e-9)
    place = 1 << np.arange(BAND_BITS, dtype=np.int64)
    return np.concatenate([((k * BANDS + np.arange(BANDS)) << BAND_BITS) + bits[np.minimum(_sampled(k, least), len(bits) - 1)] @ place for k in (length, length - 1) if k >= 0])


def _band_batches(batches, least: float, wanted=None):
    """Keys of rows (id, fingerprint); with a filter, those whose slot is in it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            keys = [band_keys(x, least) for x in part.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            if wanted is not None:
                slot = flat % SLOTS
                keep = (wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                rows, flat = rows[keep], flat[keep]
            yield pa.RecordBatch.from_arrays([pa.array(flat), part.column(0).take(pa.array(rows))], names=["key", "id"])


def _alike_batches(batches, least: float):
    for batch in batches:
        keep = [likeness(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        part = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])


#: Members of a bucket that one task compares with as many others.
BLOCK = 256


def pairs_apart(keyed: DataFrame, hubs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of members of one bucket (key, id) that ``groups`` (node, root) leaves apart; without its ``hub`` and
    ``pick``, which have met all others. Large buckets are compared block by block, so no task has all pairs of one."""
    members = keyed.select("key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = members.join(hubs, "key").where("id <> hub and id <> pick").select("key", "id", "root")
    apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low <> high").select("key", "blocks")
    placed = stored(members.join(apart, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")))
    meets = lambda a, first, last: placed.select("key", F.col("id").alias(a), F.col("root").alias(f"{a}_root"), F.col("block").alias(f"{a}_block"), F.explode(F.sequence(first, last)).alias("other"))
    left = meets("a", F.col("block"), F.col("blocks") - 1).withColumnsRenamed({"a_block": "i", "other": "j"})
    right = meets("b", F.lit(0).cast("long"), F.col("block")).withColumnsRenamed({"b_block": "j", "other": "i"})
    met = left.join(right, ["key", "i", "j"]).where((F.col("a_root") != F.col("b_root")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(prints: DataFrame, least: float = ALIKE) -> DataFrame:
    """(fingerprint, group) of distinct fingerprints, by bit-sampled banding and verification: ``group`` is one number for
    what is connected by pairs of likeness ``least`` or more.

    Bands hold bits at times that all texts of about that length reach. Each member of a bucket is first compared
    with two others: the one whose own buckets are the fullest, and one picked by a hash. Where that leaves a bucket in
    several groups, all pairs of its members from different groups follow, so no two that meet and are alike stay apart; that
    costs pairs only where a bucket's members are not alike. Nulls are no fingerprints.
    """
    one = stored(prints.select("fingerprint").where("fingerprint is not null").distinct().select(F.xxhash64("fingerprint").alias("id"), "fingerprint"))
    kinds = "key long, id long"
    shared = stored(one.mapInArrow(partial(_band_batches, least=least), kinds).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # most keys are a text's own: they are passed over where they are made
    wanted = one.sparkSession.sparkContext.broadcast(slot_filter(shared.select((F.col("key") % SLOTS).cast("int").alias("slot"))))
    keyed = stored(one.mapInArrow(partial(_band_batches, least=least, wanted=wanted), kinds).join(shared, "key"))
    wanted.unpersist()
    score = keyed.groupBy("id").agg(F.sum("n").alias("score"))
    hubs = stored(keyed.join(score, "id").groupBy("key").agg(F.max_by("id", F.struct("score", "id")).alias("hub"), F.min_by("id", F.xxhash64("key", "id")).alias("pick")))
    met = keyed.join(hubs, "key").select("id", F.explode(F.array("hub", "pick")).alias("other")).where("id <> other")
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        strings = pairs.join(one.select(F.col("id").alias("a"), F.col("fingerprint").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("fingerprint").alias("y")), "b").select("a", "b", "x", "y")
        return strings.mapInArrow(partial(_alike_batches, least=least), "a long, b long")

    groups = stored(connected_components(alike(pairs)))
    rest = stored(pairs_apart(keyed, hubs, groups))
    if not rest.isEmpty():
        groups = stored(connected_components(alike(rest).union(groups.where("node <> root").select("node", "root"))))
    return one.join(groups.withColumnRenamed("node", "id"), "id", "left").select("fingerprint", F.coalesce("root", "id").alias("group"))


def grouped_fingerprints(docs: DataFrame, least: float = ALIKE) -> DataFrame:
    """The rows of ``edit_fingerprints`` with ``group_id``: the least doc_id among the texts that
    like fingerprints connect with the row's (null where none of them has an id)."""
    rows = stored(edit_fingerprints(docs))
    groups = similar_groups(rows, least)
    first = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).join(groups, "fingerprint")
    named = first.groupBy("group").agg(F.min("first").alias("group_id"))
    return rows.join(first.join(named, "group").select("fingerprint", "group_id"), "fingerprint").select(*rows.columns, "group_id")
