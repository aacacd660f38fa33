"""Jaccard self-join of documents on word shingles, by chosen paths.

Words are runs of digits, letters and non-ASCII characters of the text lower-cased in A-Z; a document's set has its
shingles of `words` words (a shorter text that has words is one shingle). Equal sets are one node. Two nodes are linked
if the Jaccard similarity of their sets is at least `least`; linked nodes are of one class.

A repetition begins with one token of each set, sampled by a minimum hash; nodes that share it form a bucket. A bucket of
more than SPLIT nodes is split again by BRANCH sampled tokens, so that each node goes on along BRANCH longer paths, up
to DEPTH tokens or until a token splits off no half of its bucket. A pair of similarity s shares the first token with
probability s. The tokens of further levels come from a pool that all repetitions share, so a pair whose tokens in the pool
differ is unlucky in all of them; recall_of() counts with that. There are as many repetitions, and tokens in the pool, as it
takes for a pair of similarity `least` to meet with probability `recall` even if every bucket is split to the last level (8
and 24 for 0.8 and 0.9999, 43 and 80 for 0.5).
Buckets of equal members are compared once. A bucket is compared exactly, on the sets themselves, by products of presence
matrices; it gives numbers of links and the edges of a spanning star, never pairs. A pair that shares several buckets counts
in the first of them only.

What cannot be split is a group of near copies: such buckets, over all repetitions, are united where they overlap. In a union
of more nodes than one task compares, each set is sent once and compared with one of them (the base): its size and its
overlap with the base are its profile. Two profiles often decide at once for all pairs of their nodes, since two sets have at
least overlap + overlap - |base| and at most the smaller overlap and the smaller remainder in common; such links are counted
by numbers of nodes. Only nodes whose profile leaves a pair open are dealt to tiles of bounded size, every tile with every
other, and only open pairs count there. So nothing is capped, and the work grows with the square of what is open.

Defined cases: a null text or one without words has no set and is its own class; null ids come after all others;
repeated rows and copies are of one class and no link; an empty table gives an empty one; one_of_each_class keeps all columns,
whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LAST_ID, id_order, joined_spread, mark, release, stored, unused
from ._text import mixed, position_keys, steps, window_hashes
from .decontamination import alnum_words
from .graph import connected_components

WORDS, LEAST, RECALL = 5, 0.8, 0.9999
SPLIT, BRANCH, DEPTH = 256, 2, 4
#: Repetitions, at most.
MOST = 512
#: Nodes and shingles in one tile; profiles of a union that are decided pair by pair.
TILE, TILE_SHINGLES, PROFILES = 2048, 1 << 20, 4096


def recall_of(least: float, first: int, later: int) -> float:
    """Probability that a pair of similarity `least` meets in one of `first` repetitions, when all buckets are split to the
    last level. A branch takes its token from its own share of the pool: of these m are the same in both sets, binomially."""
    share = later // BRANCH
    same = np.arange(share + 1)
    odds = np.array([math.comb(share, m) * least**m * (1 - least) ** (share - m) for m in same.tolist()])
    on, weight = np.ones([share + 1] * BRANCH), functools.reduce(np.multiply.outer, [odds] * BRANCH)
    for _ in range(DEPTH - 1):
        lost = [1 - np.moveaxis(np.broadcast_to(same / share, on.shape), -1, axis) * on for axis in range(BRANCH)]
        on = 1 - functools.reduce(np.multiply, lost)
    return 1 - float((weight * (1 - least * on) ** first).sum())


@functools.cache
def sampled(least: float, recall: float) -> tuple[int, int]:
    """First tokens (repetitions) and tokens of further levels that give the recall. A repetition is a path to be dealt, a
    later token only a number in a signature: one is worth four of the other."""
    first, best = MOST, None
    for later in range(BRANCH * 4, BRANCH * 128, BRANCH * 4):
        # more tokens in the pool never ask for more repetitions
        while first > 1 and recall_of(least, first - 1, later) >= recall:
            first -= 1
        if recall_of(least, first, later) >= recall and (best is None or 4 * first + later <= 4 * best[0] + best[1]):
            best = first, later
    if best is None:
        raise ValueError(f"more than {MOST} repetitions for the recall {recall} at {least}")
    return best


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and the offsets of each."""
    found = alnum_words(texts)
    h, n = found.hashes(), found.counts()
    keys = position_keys(words, 21)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    sets, size = [], np.zeros(len(n), np.int64)
    for d in np.flatnonzero(n).tolist():
        lo = int(found.first[d])
        if n[d] >= words:
            s = np.unique(window_hashes(h, np.arange(lo, lo + int(count[d])), keys))
        else:
            s = window_hashes(h, np.array([lo]), keys[: int(n[d])]) ^ np.uint64(n[d])
        sets.append(s)
        size[d] = len(s)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)])


def _digests(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16 bytes for each set, the same for equal sets."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(flat ^ np.uint64(x)), dtype=np.uint64)]) for x in (0x1234567, 0x89ABCDEF012)]
    return np.stack([s[ends[1:]] - s[ends[:-1]] for s in sums], axis=1)


def _nodes(words: int, tokens: int):
    keys = position_keys(tokens, 22)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            flat, ends = shingle_sets(batch.column("text"), words)
            size = np.diff(ends)
            some = np.flatnonzero(size)
            node = _digests(flat, ends)
            least = np.stack([np.minimum.reduceat(mixed(flat * k + (k >> np.uint64(7))), ends[:-1][some]) for k in keys], axis=1) if len(some) else np.zeros((0, tokens), np.uint64)
            names = [node[d].tobytes() if size[d] else None for d in range(len(size))]
            begin = np.concatenate([[0], np.cumsum(size > 0)]).astype(np.int32) * tokens
            sig = pa.ListArray.from_arrays(pa.array(begin), pa.array(least.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("th"), pa.array(names, pa.binary()), pa.array(size), sig], ["_id", "th", "node", "n", "sig"])

    return run


def _held_sets(words: int, rows_of):
    """For each text of a node, the rows that rows_of(its buckets) asks for, with its set. Columns: those of rows_of, node, held, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            flat, ends = shingle_sets(batch.column("text"), words)
            node = _digests(flat, ends)
            for d, (name, buckets) in enumerate(zip(batch.column("node").to_pylist(), batch.column("buckets").to_pylist(), strict=True)):
                if node[d].tobytes() != name:  # another text of the same id and digest
                    continue
                held = flat[ends[d] : ends[d + 1]].tobytes()
                rows, ids = rows_of(buckets), sorted(x["bucket"] for x in buckets)
                most = max(1, min(64, (8 << 20) // max(1, len(held))))  # copies of a long set in one batch
                for lo in range(0, len(rows), most):
                    part = rows[lo : lo + most]
                    own = [pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), *[pa.int32()] * 5))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([name] * len(part), pa.binary()), pa.array([held] * len(part), pa.binary()), pa.array([ids] * len(part), pa.list_(pa.int64()))], SET_NAMES)

    return run


SET_NAMES = ["bucket", "ti", "tj", "own", "c", "bn", "node", "held", "ids"]
SETS = "bucket long, ti int, tj int, own int, c int, bn int, node binary, held binary, ids array<long>"


def _in_tiles(buckets: list[dict]) -> list[tuple]:
    """A row for each pair of tiles that the node takes part in."""
    return [(x["bucket"], min(x["tile"], t), max(x["tile"], t), x["tile"], x["c"], x["bn"]) for x in buckets for t in range(x["tiles"])]


def _beside_base(buckets: list[dict]) -> list[tuple]:
    """A row for the node's own tile; the base (own: 0) goes to every tile."""
    rows = []
    for x in buckets:
        rows += [(x["bucket"], t, 0, 0, -1, -1) for t in range(x["tiles"])] if x["is_base"] else []
        rows.append((x["bucket"], x["tile"], 0, 1, -1, -1))
    return rows


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and tile, the base first. Size, overlap with the base and the base's size for each node."""
    base = np.zeros(0, np.uint64)
    for batch in batches:
        out: list[tuple] = []
        for bucket, own, node, held in zip(*(batch.column(c).to_pylist() for c in ("bucket", "own", "node", "held")), strict=True):
            x = np.frombuffer(held, np.uint64)
            if own == 0:
                base = x
            else:
                at = np.minimum(np.searchsorted(base, x), len(base) - 1)
                out.append((bucket, node, len(x), int((base[at] == x).sum()), len(base)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()))], ["bucket", "node", "n", "c", "bn"])


def _reached(common, total, least: float):
    """Whether sets of `total` members together have the similarity `least`, `common` of them being shared."""
    return common >= least * (total - common) - 1e-4


def _bounds(n: np.ndarray, c: np.ndarray, n2: np.ndarray, c2: np.ndarray, bn, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of profiles: whether their sets are linked for certain, and whether they may be."""
    total = n[:, None] + n2
    low = np.maximum(c[:, None] + c2 - bn, 0)
    high = np.minimum(c[:, None], c2) + np.minimum((n - c)[:, None], n2 - c2)
    return _reached(low, total, least), _reached(high, total, least)


def _decided(least: float):
    """For each profile of a union: links that are certain, a node of their component, and whether a pair is left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, bn, rows in zip(*(batch.column(x).to_pylist() for x in ("bucket", "bn", "profiles")), strict=True):
                n, c, k = (np.array([r[x] for r in rows], np.int64) for x in ("n", "c", "k"))
                p = len(rows)
                links, label, still = np.zeros(p, np.int64), np.arange(p), np.ones(p, bool)
                if p <= PROFILES:
                    sure, may = np.zeros((p, p), bool), np.zeros((p, p), bool)
                    for lo in range(0, p, 256):
                        hi = min(p, lo + 256)
                        sure[lo:hi], may[lo:hi] = _bounds(n[lo:hi], c[lo:hi], n, c, bn, least)
                    links = sure @ k - np.diag(sure)
                    still = may & ~sure
                    still[np.arange(p), np.arange(p)] &= k > 1
                    still = still.any(1)
                    label = _components(sure)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(p, bucket)), *(pa.array(x.astype(np.int32)) for x in (n, c)), pa.array(links), pa.array([rows[int(x)]["rep"] for x in label], pa.binary()), pa.array(still), pa.array(np.full(p, p <= PROFILES))],
                    ["bucket", "n", "c", "links", "root", "still", "bounded"],
                )

    return run


def _components(linked: np.ndarray) -> np.ndarray:
    label = np.arange(len(linked))
    while True:
        near = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _links(held: list[bytes], own: np.ndarray, c: np.ndarray, bn: int, ids: list[list[int]], key: tuple[int, int, int], least: float) -> np.ndarray:
    """Boolean matrix of the pairs that count here."""
    bucket, ti, tj = key
    size = np.array([len(x) // 8 for x in held])
    g = len(size)
    flat = np.frombuffer(b"".join(held), np.uint64)
    owner = np.repeat(np.arange(g), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    if len(column):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]))
    both = np.zeros((g, g), np.float32)
    wide = max(256, min(4096, (1 << 23) // g))
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        x = np.zeros((g, min(wide, top - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    linked = _reached(both, size[:, None] + size[None, :], least)
    np.fill_diagonal(linked, False)
    if ti != tj:
        linked &= own[:, None] != own[None, :]
    if (c >= 0).all():  # pairs that the profiles have decided are counted already
        for lo in range(0, g, 256):
            hi = min(g, lo + 256)
            sure, may = _bounds(size[lo:hi], c[lo:hi], size, c, bn, least)
            linked[lo:hi] &= may & ~sure
    lower: dict[int, list[int]] = {}
    for k, x in enumerate(ids):
        for i in x:
            if i < bucket:
                lower.setdefault(i, []).append(k)
    for members in lower.values():
        if len(members) > 1:
            linked[np.ix_(members, members)] = False
    return linked


def _compared(least: float):
    """Rows sorted by bucket and tiles; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("held", "own", "c", "bn", "ids", "node")
        key, group = None, {x: [] for x in names}
        out: list[tuple] = []

        def close():
            nodes = group["node"]
            if len(nodes) > 1:
                linked = _links(group["held"], np.array(group["own"]), np.array(group["c"]), group["bn"][0], group["ids"], key, least)
                n, label = linked.sum(1), _components(linked)
                for k in np.flatnonzero(n).tolist():
                    out.append((nodes[k], nodes[int(label[k])], int(n[k])))

        def table():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], ["a", "b", "n"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "ti", "tj", *names)]
            for b, ti, tj, *rest in zip(*cols, strict=True):
                if (b, ti, tj) != key:
                    close()
                    key, group = (b, ti, tj), {x: [] for x in names}
                for x, value in zip(names, rest, strict=True):
                    group[x].append(value)
            if len(out) > 5000:
                yield table()
                out.clear()
        close()
        yield table()

    return run


def _sized(rows: DataFrame) -> DataFrame:
    """(path, node, ...) of paths with several nodes, with their number c."""
    return joined_spread(rows, rows.groupBy("path").agg(F.count("*").alias("c")).filter("c > 1"), "path", "c")


def _buckets(nodes: DataFrame, first: int, later: int) -> DataFrame:
    """(bucket, node): the leaves of all chosen paths; negative buckets are unions of those that cannot be split. first: number of
    first tokens in a node's signature; the `later` others are those of further levels."""
    begun = F.transform(F.slice("sig", 1, first), lambda x, i: F.xxhash64(i, x))
    level = stored(_sized(nodes.select(F.explode(begun).alias("path"), "node")), "paths")
    leaves, dense = [level.filter(F.col("c") <= SPLIT).select("path", "node")], []
    parent = level.filter(F.col("c") > SPLIT)
    each = later // BRANCH
    for depth in range(1, DEPTH):
        if parent.isEmpty():
            break
        further = parent.join(nodes.select("node", "sig"), "node")
        for k in range(BRANCH):
            # the path itself chooses the next tokens, the same for all its nodes
            at = F.pmod(F.xxhash64("path", F.lit(k)), F.lit(each)).cast("int") + first + k * each
            token = F.xxhash64("path", at, F.get("sig", at)).alias("path")
            step = further.select(token, "node", F.col("c").alias("above"))
            further_k = step if k == 0 else further_k.unionByName(step)
        level = stored(_sized(stored(further_k, "further")), "paths")
        leaves.append(level.filter(F.col("c") <= SPLIT).select("path", "node"))
        stuck = (F.col("c") > SPLIT) & ((F.col("c") * 2 > F.col("above")) if depth < DEPTH - 1 else F.lit(True))
        dense.append(level.filter(stuck).select("path", "node"))
        parent = level.filter((F.col("c") > SPLIT) & ~stuck).select("path", "node", "c")
    found = leaves[0]
    for x in leaves[1:]:
        found = found.unionByName(x)
    found = found.select(F.shiftrightunsigned("path", 1).alias("bucket"), "node")
    # buckets of the same members: one of them
    same = found.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    found = found.join(same.groupBy("c", "s", "s2").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")
    if dense:
        hard = dense[0]
        for x in dense[1:]:
            hard = hard.unionByName(x)
        least = hard.groupBy("path").agg(F.min("node").alias("b"), F.count("*").alias("c"))
        stars = joined_spread(hard, least, "path", "c").select(F.col("node").alias("a"), "b")
        united = connected_components(stars)
        found = found.unionByName(united.select((-F.shiftrightunsigned(F.xxhash64("root"), 1) - 1).alias("bucket"), "node"))
    return found


def _tiled(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, n, ...) with the number of tiles of their bucket, their own tile, and the bucket's least node."""
    tiles = F.greatest(F.lit(1), F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = rows.groupBy("bucket").agg(tiles.alias("tiles"), F.count("*").alias("many"), F.min("node").alias("base"))
    return joined_spread(rows, sizes, "bucket", "many").withColumn("tile", F.pmod(F.xxhash64("node", "bucket"), F.col("tiles")).cast("int"))


def _sets_of(texts: DataFrame, nodes: DataFrame, entries: DataFrame, words: int, rows_of) -> DataFrame:
    """entries: node and what its bucket struct holds."""
    packed = entries.groupBy("node").agg(F.collect_list(F.struct(*(c for c in entries.columns if c != "node"))).alias("buckets"))
    placed = packed.join(nodes.select("node", "m._id", "m.th"), "node")
    return texts.join(placed, ["_id", "th"]).select("text", "node", "buckets").mapInArrow(_held_sets(words, rows_of), SETS)


def _by_profile(texts: DataFrame, nodes: DataFrame, large: DataFrame, words: int, least: float) -> DataFrame:
    """large: _tiled rows of unions of several tiles. (bucket, node, n, c, bn, links, root, still): links that the profiles decide."""
    entries = large.select("node", "bucket", "tiles", "tile", (F.col("node") == F.col("base")).alias("is_base"))
    sets = _sets_of(texts, nodes, entries, words, _beside_base).repartition("bucket", "ti").sortWithinPartitions("bucket", "ti", "own")
    found = stored(sets.mapInArrow(_profiled, "bucket long, node binary, n int, c int, bn int"), "profiles")
    counts = found.groupBy("bucket", "n", "c").agg(F.count("*").alias("k"), F.min("node").alias("rep"), F.first("bn").alias("bn"))
    unions = counts.groupBy("bucket").agg(F.first("bn").alias("bn"), F.collect_list(F.struct("n", "c", "k", "rep")).alias("profiles"))
    decided = unions.mapInArrow(_decided(least), "bucket long, n int, c int, links long, root binary, still boolean, bounded boolean")
    key = F.struct("bucket", "n", "c").alias("key")
    facts = decided.select(key, "links", "root", "still", "bounded").join(counts.select(key, "k"), "key")
    rows = joined_spread(found.select("*", key), facts, "key", "k")
    # of a union with too many profiles nothing is decided
    return stored(rows.select("bucket", "node", "n", F.when(F.col("bounded"), F.col("c")).otherwise(-1).alias("c"), "bn", "links", "root", "still"), "decided")


def _joined(rows: DataFrame, words: int, least: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: _id, text. Returns members (_id, th, node), nodes (node, m: its smallest row, c: its rows, root: of its class, null
    if it has no link) and links (node, n_links), of linked nodes only."""
    spark, since = rows.sparkSession, mark()
    first, later = sampled(least, recall)
    rows = rows.withColumn("th", F.xxhash64("text"))
    members = stored(rows.mapInArrow(_nodes(words, first + later), "_id long, th long, node binary, n long, sig array<long>"), "members")
    nodes = stored(members.filter("node is not null").groupBy("node").agg(F.min(F.struct("_id", "th")).alias("m"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("c")), "nodes")
    buckets = stored(_buckets(nodes, first, later).join(nodes.select("node", "n"), "node"), "buckets")
    release(spark, since, members, nodes, buckets)
    tiled = stored(_tiled(buckets), "tiled")
    # one row for each text of an id; repeated rows meet where they are first
    texts = rows.groupBy("_id", "th").agg(F.first("text").alias("text"))
    entries = tiled.filter("tiles = 1").select("node", "bucket", "tiles", "tile", F.lit(-1).alias("c"), F.lit(-1).alias("bn"))
    sure = None
    large = tiled.filter("tiles > 1")
    if not large.isEmpty():
        profiles = _by_profile(texts, nodes, large, words, least)
        sure = profiles.filter("links > 0").select(F.col("node").alias("a"), F.col("root").alias("b"), F.col("links").alias("n"))
        still = _tiled(profiles.filter("still").select("bucket", "node", "n", "c", "bn")).select("node", "bucket", "tiles", "tile", "c", "bn")
        # nodes of which all pairs are decided still say that they share the bucket
        done = profiles.filter("not still").select("node", "bucket", F.lit(0).alias("tiles"), F.lit(0).alias("tile"), "c", "bn")
        entries = entries.unionByName(still).unionByName(done)
    sets = _sets_of(texts, nodes, entries, words, _in_tiles)
    sets = sets.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj", "node")
    found = sets.mapInArrow(_compared(least), "a binary, b binary, n long")
    found = stored(found if sure is None else found.unionByName(sure), "links")
    release(spark, since, members, nodes, found)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return members.select("_id", "th", "node"), nodes.select("node", "m", "c").join(connected_components(found), "node", "left"), links


def _classes(nodes: DataFrame) -> DataFrame:
    """(node, c, class): class is the smallest (_id, th) of the class."""
    linked = nodes.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("m").alias("class"), F.count("*").alias("many"))
    found = joined_spread(linked.select("root", "node", "c"), least, "root", "many").select("node", "c", "class")
    return found.unionByName(nodes.filter("root is null").select("node", "c", F.col("m").alias("class")))


def similar_documents(docs: DataFrame, words: int = WORDS, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id (the smallest doc_id of its class), n_links (other texts linked to
    it). recall: the chance of finding a pair of similarity `least`."""
    members, nodes, links = _joined(docs.select(id_order().alias("_id"), F.col("text").cast("string").alias("text")), words, least, recall)
    facts = _classes(nodes).join(links, "node", "left")
    out = joined_spread(members.filter("node is not null"), facts, "node", "c").select("_id", F.col("class._id").alias("of"), "n_links")
    out = out.unionByName(members.filter("node is null").select("_id", F.col("_id").alias("of"), F.lit(None).cast("long").alias("n_links")))
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(known("_id").alias("doc_id"), known("of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each_class(docs: DataFrame, words: int = WORDS, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class, that of the smallest id; rows without words all stay."""
    names = docs.columns
    own, th = unused(names, "id"), unused(names, "th")
    text = F.col("text").cast("string")
    given = docs.withColumns({own: id_order(), th: F.xxhash64(text)})
    _, nodes, _ = _joined(given.select(F.col(own).alias("_id"), text.alias("text")), words, least, recall)
    kept = _classes(nodes).select(F.col("class._id").alias(own), F.col("class.th").alias(th)).distinct()
    worded = F.coalesce(F.rlike(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")), F.lit(False))
    # repeated rows: one stays, unless they have no words
    alone = given.filter(worded).dropDuplicates([own, th]).join(kept, [own, th], "left_semi")
    return alone.unionByName(given.filter(~worded)).select(*(F.col(f"`{c}`") for c in names))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM w WHERE len(ws) > 0)
), keyed AS (
  SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS node, count(*) AS n FROM sh GROUP BY doc_id
), nodes AS (
  SELECT node, min(doc_id) AS rep, any_value(n) AS n FROM keyed GROUP BY node
), ns AS (
  SELECT nodes.rep, n, s FROM nodes JOIN sh ON sh.doc_id = nodes.rep
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM ns AS a JOIN ns AS b ON a.s = b.s AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 0.0001
), reach AS (
  SELECT rep AS x, rep AS y FROM nodes UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a
), cls AS (SELECT x, min(y) AS c FROM reach GROUP BY x), deg AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT w.doc_id, coalesce(c, w.doc_id) AS class_id, coalesce(k, 0)::BIGINT AS n_links
FROM w LEFT JOIN keyed ON w.doc_id = keyed.doc_id LEFT JOIN nodes ON keyed.node = nodes.node
LEFT JOIN cls ON cls.x = nodes.rep LEFT JOIN deg ON deg.a = nodes.rep
"""
