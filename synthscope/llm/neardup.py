"""Near duplicates among whole texts: Jaccard similarity of their sets of five-word shingles.

Sets are searched by SimHash first: the multi-index search of ``simhash`` finds the fingerprints that differ in a few
bits, and pairs of sets that are similar enough are linked. 64 bits show no more than the nearest pairs, so
sets meet by a second kind of keys too, bands of min-hashes; what is in one group by then is not compared again.
A bucket's members are compared with its hub - the member whose
own buckets are the fullest, so an original goes before its edited copies - and linked where
the sets are similar enough. That costs a pair a key, however full a bucket is. Members that
this leaves in different groups meet again by finer keys: their rarest shingles, so many that two
sets which share none of them cannot reach the limit. Shingles of hubs come last in that order, so
edited copies that are alike with their original only have no key in common. Finer buckets have a hub
in turn, and only what that leaves in different groups is compared pair by pair.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_slots, mapped, slot_filter, stored
from .graph import connected_components
from .shingles import mixed, shingles
from .simhash import hamming_links, majority

#: Sets meet by SimHash where their fingerprints differ in so many bits at most.
MAX_BITS = 2
#: Two texts of Jaccard similarity 0.8 share none of the 24 keys with probability (1 - 0.8 ** 5) ** 24 = 7e-5.
BANDS, ROWS = 24, 5
#: Sizes of sets fall into classes by this ratio; classes of shingles that bound from above what two sets have in common.
STEP, CLASSES = 1.05, 256
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(1, 1 << 63, (1, BANDS * ROWS), np.uint64) | np.uint64(1)
_BAND_FACTORS = _RNG.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def set_id(own: np.ndarray) -> int:
    """One signed long for a set of shingles: equal sets, and so equal texts, are one node."""
    return xxhash.xxh64_intdigest(own.tobytes(), 7) - (1 << 63)


def set_fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed long; 0 for the empty set."""
    return int(majority(own.view(np.uint64)[:, None]).view(np.int64)[0]) if len(own) else 0


def band_keys(own: np.ndarray) -> np.ndarray:
    """One long a band: a hash of the band's number and its min-hashes over the shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        low = np.minimum(low, (own[at : at + 1024, None] * _FACTORS).min(axis=0))
    bands = (mixed(low).reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1)
    return mixed(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *[r.view(np.int64) for r in rows]])))


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield batch.slice(at, 500)


def _key_batches(batches, n: int):
    for part in _parts(batches):
        sets = [shingles(t, n) for t in part.column(1).cast(pa.binary()).to_pylist()]
        cols = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(set_fingerprint, sets), pa.int64()), _lists([band_keys(s) if len(s) else s for s in sets])]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "node", "size", "fp", "keys"])


def _set_batches(batches, n: int, wanted):
    """Sets of the rows (slot, text) whose slot is in the filter."""
    for part in _parts(batches):
        slots = part.column(0).to_numpy()
        texts = part.column(1).filter(pa.array((wanted.value[slots >> 3] >> (slots & 7)) & 1 > 0))
        sets = [shingles(t, n) for t in texts.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), _lists(sets)], names=["node", "shingles"])


def _node_batches(batches, at: int, n: int, name: str):
    for batch in batches:
        ids = [set_id(shingles(t, n)) for t in batch.column(at).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, name])


def _tally_batches(batches):
    """How many shingles of a set fall into each of some classes."""
    for batch in batches:
        tally = [np.bincount(own.values.to_numpy() & (CLASSES - 1), minlength=CLASSES).tolist() for own in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tally, pa.list_(pa.int32()))], names=["node", "tally"])


def size_class(size: int) -> int:
    return math.floor(math.log(size) / math.log(STEP) + 1e-9)


def prefix_keys(size: int, order: list[int], similarity: float) -> list[tuple[int, int, int]]:
    """(key, role, place) of a set: for each class of sizes that a similar set can have, its first shingles in ``order`` -
    so many that a set of that class which shares none of them is too far. A key is of a shingle and the two classes;
    the role is 0 where they are the same, else 1 for the smaller and 2 for the larger sets, which meet only each other."""
    own, out = size_class(size), []
    for other in range(size_class(max(1, math.ceil(size * similarity - 1e-9))), size_class(math.floor(size / similarity + 1e-9)) + 1):
        least = max(STEP**other - 1e-6, size * similarity)
        n = size - math.ceil(similarity / (1 + similarity) * (size + least) - 1e-6) + 1
        pair = xxhash.xxh64_intdigest(f"{min(own, other)},{max(own, other)}")
        role = 0 if own == other else 1 if own < other else 2
        out += [((pair ^ s) * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63), role, place) for place, s in enumerate(order[: max(n, 0)]) if s is not None]
    return out


def _prefix_batches(batches, similarity: float):
    """Members (node, size, root, shingles, rare: (df, shingle) of those that no hub has) -> their finer keys."""
    for batch in batches:
        rows = []
        for node, size, root, own, rare in zip(*(batch.column(i) for i in range(3)), batch.column(3), batch.column(4), strict=True):
            first = sorted((r["n"], r["s"]) for r in rare.as_py() or [])
            most = size.as_py() - math.ceil(size.as_py() * similarity - 1e-9) + 1
            order = [s % (1 << 64) if n > 1 else None for n, s in first[:most]]  # what no other member has leads nowhere
            if len(order) < most:
                own = own.values.to_numpy()
                common = np.setdiff1d(own, np.array([s for _, s in first], np.int64))[: most - len(order)]
                order += [s % (1 << 64) for s in common.tolist()]
            rows += [(key, role, node.as_py(), size.as_py(), root.as_py(), place) for key, role, place in prefix_keys(size.as_py(), order, similarity)]
            if len(rows) > 50_000:
                yield _key_rows(rows)
                rows = []
        yield _key_rows(rows)


def _key_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = {"key": pa.int64(), "role": pa.int32(), "node": pa.int64(), "size": pa.int32(), "root": pa.int64(), "place": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _finer_keys(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, role, node, size, root, place) of members (node, size, root, hub), by their rarest shingles.

    All members' shingles have one order: those that no hub has by the number of members that have them, then the hubs'. Two
    sets that are similar enough share one of their first, so members that have only their hub's text in common don't meet.
    """
    hubs = sets.join(apart.select(F.col("hub").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
    known = hubs.select(F.explode("hub_shingles").alias("s")).distinct()
    rest = apart.select("node", "hub").join(sets, "node").join(hubs, "hub", "left").select("node", F.explode(F.array_except("shingles", F.coalesce("hub_shingles", F.array().cast("array<long>")))).alias("s"))
    rest = stored(rest.join(known, "s", "left_anti"))
    counts = rest.groupBy("s").agg(F.count("*").alias("n"))
    rare = rest.join(counts, "s").groupBy("node").agg(F.collect_list(F.struct("n", "s")).alias("rare"))
    keys = apart.select("node", "size", "root").join(sets, "node").join(rare, "node", "left").select("node", "size", "root", "shingles", "rare")
    keys = stored(keys.mapInArrow(partial(_prefix_batches, similarity=similarity), "key long, role int, node long, size int, root long, place int"))
    ends = keys.groupBy("key").agg(*[f(c).alias(f"{e}_{c}") for c in ("root", "role") for f, e in ((F.min, "low"), (F.max, "high"))])
    return keys.join(ends.where("low_root <> high_root and (high_role = 0 or low_role <> high_role)").select("key"), "key")


def _reach(shared: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of sizes x and y that share so many shingles are similar enough."""
    return shared >= (x + y - shared) * similarity - 1e-9


def _fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Stored pairs (a, b), a < b, of sets (node, size, fp) that SimHash brings together and whose sizes let them be similar.

    The sets of one fingerprint meet its least set, and so do those of fingerprints that differ in up to MAX_BITS bits.
    """
    first = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("f")).select("fp", "f.node", "f.size"))
    end = lambda of: first.select(F.col("fp").alias(of), F.col("node").alias(f"{of}_node"), F.col("size").alias(f"{of}_size"))
    near = hamming_links(first, MAX_BITS).join(end("a"), "a").join(end("b"), "b").select("a_node", "a_size", "b_node", "b_size")
    same = nodes.select("fp", F.col("node").alias("b_node"), F.col("size").alias("b_size")).join(end("a").withColumnRenamed("a", "fp"), "fp").where("a_node <> b_node")
    both = near.unionByName(same.select(*near.columns)).where(_reach(F.least("a_size", "b_size"), F.col("a_size"), F.col("b_size"), similarity))
    return stored(both.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def _stars(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that lead each node to the one of its partners that has the most partners."""
    both = pairs.union(pairs.select("b", "a"))
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    best = both.join(degree, "b").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one group yet."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _with_bounds(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (key, role, node, place, ...) with what bounds the number of shingles that two have in common: the keys
    before this one, and the tally. Both are wide, so the tables are merged; no relation of them goes through the driver."""
    earlier = rest.groupBy("node").agg(F.collect_list(F.struct("place", "key")).alias("all_keys"))
    tallies = sets.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(_tally_batches, "node long, tally array<int>")
    before = F.transform(F.filter("all_keys", lambda k: k["place"] < F.col("place")), lambda k: k["key"])
    return rest.join(earlier.hint("merge"), "node").join(tallies.hint("merge"), "node").withColumn("before", before).drop("all_keys")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _groups(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Stored rows (doc_id, node, ...) of the rows with a doc_id, where a node is a distinct set of
    shingles, and (node, root) of the nodes that are connected to others by similar pairs."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    prints = stored(texts.mapInArrow(partial(_key_batches, n=words), "doc_id long, node long, size int, fp long, keys array<long>"))
    nodes = stored(prints.where("size > 0").dropDuplicates(["node"]))
    table = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = stored(table.join(shared, "key"))
    score = keyed.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = keyed.join(score, "node").groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("score", "node")).alias("hub"))
    keyed = stored(keyed.join(hubs, "key").select("key", "node", "size", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")))

    close = _fingerprint_pairs(nodes, similarity)
    met = keyed.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(slot_filter(nodes.join(met, "node", "left_semi").select(id_slots(F.col("doc_id")).alias("slot"))))
    held = texts.select(id_slots(F.col("doc_id")).alias("slot"), "text").mapInArrow(partial(_set_batches, n=words, wanted=wanted), "node long, shingles array<long>")
    sets = stored(held.join(met, "node", "left_semi").dropDuplicates(["node"]))
    reach = partial(_reach, similarity=similarity)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return stored(pairs.join(a, "a").join(b.hint("merge"), "b").where(reach(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"))

    near_hub = keyed.where((F.col("node") != F.col("hub")) & reach(F.least("size", "hub_size"), F.col("size"), F.col("hub_size")))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = lambda: roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = stored(connected_components(verified(_stars(close))))
    more = verified(_still_apart(near_hub.select(*pair("node", "hub")).union(close).distinct(), roots))
    if not more.isEmpty():
        roots = stored(connected_components(more.union(links())))

    # buckets with several groups: their members but the hub meet again by finer keys
    members = _rooted(keyed, roots)
    mixed_up = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    apart = stored(members.where("node <> hub").join(mixed_up, "key").groupBy("node", "size", "root").agg(F.mode("hub").alias("hub")))
    finer = stored(_finer_keys(apart, sets, similarity))
    first = finer.groupBy("key").agg(F.min(F.struct("root", "node", "size")).alias("f")).select("key", F.col("f.node").alias("hub"), F.col("f.root").alias("hub_root"), F.col("f.size").alias("hub_size"))
    near_first = finer.join(first, "key").where((F.col("root") != F.col("hub_root")) & reach(F.least("size", "hub_size"), F.col("size"), F.col("hub_size")))
    more = verified(near_first.select(*pair("node", "hub")).distinct())
    if not more.isEmpty():
        roots = stored(connected_components(more.union(links())))
    rest = _rooted(finer.drop("root"), roots)
    major = rest.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count("*").alias("groups")).where("groups > 1").select("key", "major")
    rest = rest.join(major, "key").withColumn("in_major", F.col("root") == F.col("major")).select("key", "role", "node", "size", "place", "root", "in_major")
    rest = stored(_with_bounds(stored(rest), sets))
    side = lambda df, a, role="role": df.select("key", F.expr(role).alias("role"), *[F.col(c).alias(f"{a}_{c}") for c in ("node", "size", "place", "root", "in_major", "tally", "before")])
    differ = F.col("a_root") != F.col("b_root")
    # two members are compared at the first key that they share: what stands before it is not shared, and class by class they share the lesser number at most
    at_most = F.aggregate(F.zip_with("a_tally", "b_tally", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    able = reach(F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")), F.col("a_size"), F.col("b_size")) & ~F.arrays_overlap("a_before", "b_before") & reach(at_most, F.col("a_size"), F.col("b_size"))
    met = side(rest.where("not in_major"), "a").join(side(rest, "b", "case role when 1 then 2 when 2 then 1 else 0 end").hint("merge"), ["key", "role"]).where(differ & able)
    more = verified(met.select(*pair("a_node", "b_node")).distinct())
    if not more.isEmpty():
        roots = stored(connected_components(more.union(links())))
    wanted.unpersist()
    return prints, roots


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of every distinct non-null doc_id: near-duplicate groups of whole texts.

    Texts are linked where the Jaccard similarity of their sets of ``words``-word shingles is
    ``similarity`` or more, computed from the sets. group_id is the least doc_id reached.
    Blank and null texts form one group; the rows of a repeated doc_id with different texts
    join their groups; repeated rows count once; texts of any length are read whole, a piece at
    a time; other columns are ignored; an empty table gives no rows.
    """
    prints, roots = _groups(docs, words, similarity)
    rows = _rooted(prints.select("doc_id", "node").distinct(), roots)
    several = rows.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("doc_id", "a")
    joined = rows.join(several, "doc_id").select("a", F.col("root").alias("b"))
    rows = rows.join(connected_components(joined).select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("doc_id", F.coalesce("top", "root").alias("root"))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("doc_id", "group_id").distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of near-duplicate texts the row with the least doc_id, with all columns.

    Rows without a doc_id stay, since nothing can name them; of the blank and null texts one
    stays. Different texts under one doc_id are judged each by itself; of rows with one doc_id and one set of
    shingles, the one with the least hash of all columns stays, so reruns agree. An empty table
    gives no rows. Texts are not shuffled where the lists of dropped and repeated ids are small.
    """
    prints, roots = _groups(docs, words, similarity)
    rows = _rooted(prints.select("doc_id", "node").distinct(), roots)
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("f")).select("f.doc_id", "f.node")
    dropped = stored(rows.join(first, ["doc_id", "node"], "left_anti").select("doc_id").distinct())
    repeated = stored(prints.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    here = F.col("doc_id").cast("long")
    within = lambda df, ids, how: df.join(ids.select(F.col("doc_id").alias(key)), here == F.col(key), how)
    key = fresh("id", docs.columns)
    plain = within(within(docs, repeated, "left_anti"), dropped, "left_anti")  # a null id matches nothing and stays
    again, node = within(docs, repeated, "left_semi"), fresh("node", docs.columns)
    told = mapped(again, partial(_node_batches, at=docs.columns.index("text"), n=words, name=node), T.StructType([*again.schema.fields, T.StructField(node, T.LongType())]))
    told = told.join(first.select(F.col("doc_id").alias(key), F.col("node").alias(f"{key}_node")), (here == F.col(key)) & (F.col(node) == F.col(f"{key}_node")), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = told.groupBy(here, F.col(node)).agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64(*columns), F.col("text"))).alias("row")).select("row.*")
    return plain.select(*columns).unionByName(one)
