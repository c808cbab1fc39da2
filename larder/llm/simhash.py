"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has a bit for each bit position that is 1 in over half of the shingles' hashes (XXH64,
seed 42; wider fingerprints mix the same hash into further lanes). Fingerprints are dealt into shards
by the values of chosen bands of their bits; each shard is a BK-tree whose children are keyed by the
integer Hamming distance to their parent. Every member searches its shard's tree, following only the
edges within the radius of its distance to the parent, whole levels of many trees at a time. Shards
are shuffled to where they are searched, not broadcast: together they hold the fingerprints of all
documents, which neither have a size bound nor may pass through the driver. A shard over SHARD_ROWS is
split into blocks, and each pair of blocks is searched by itself.

With radius r, r + j bands of which j must agree hold every pair within the radius (j of them are
untouched by r differing bits), so links are exact. j is the least that leaves SHARD_MEAN fingerprints
or fewer to a shard on average, so that trees don't grow with the table.

near_duplicates() takes the pairs within a wide radius as candidates only, and links those whose sets of
shingles (as 64-bit hashes) have a Jaccard similarity of at least `least`. There a pair must agree in one
of many sets of bits, which grow in size and number with the table so that its work doesn't grow by the
square and the share MISSED of the pairs at the least similarity isn't found. A shard is searched by its BK-tree too: for
the nearest candidate the radius shrinks to the nearest found so far; beside that, a wide radius prunes little. Each text first tries its nearest candidate of
another component, ROUNDS times; then all candidates still apart are tried, so that a large group of
near copies is not compared pair by pair once it hangs together. From the second round on, pairs are left
out before their sets are fetched where tallies of their hashes by bucket already bound the similarity
below `least`, and a text is dealt only under the keys where the round before met another component
within the radius; neither loses a link.

Null texts count as empty; texts without words have fingerprint zero; texts under the shingle's length
are one shingle; texts of any length are hashed whole, in chunks; repeated rows, and texts that share a
doc_id, count as linked; of a group the smallest id stands for it; rows without a doc_id take part, and
their component is the smallest id reachable, or null; an empty table gives an empty one; other columns,
whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import as_bytes, broadcast_if_small, holding, join_counted, map_batches, materialize, release

SEED = 42
#: Rows of a shard, or of a block of it, at most; members of a shard on average, at most, where links are exact.
SHARD_ROWS, SHARD_MEAN = 2048, 64
#: Pairs of a member and a tree's node that are visited at a time.
VISITS = 1 << 20
#: Hot shards, and classes, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Nodes of candidate pairs that may be broadcast, with their ids and digests (56 bytes each, so 30 MB), lest texts be shuffled.
CANDIDATE_ROWS = 1 << 19
CHUNK = 1 << 16
#: Rounds of nearest candidates; texts of a side of a cell of pairs compared by their shingles.
ROUNDS, CELL = 2, 512
#: Candidates: members of a shard on average, at most; the least bits that must agree; share of the pairs of the least similarity that may agree in no set of bits.
CANDIDATE_MEAN, LEAST_BITS, MISSED = 1024, 12, 0.002
#: Buckets of a tally of a text's shingle hashes.
BUCKETS = 128


def shingle_hashes(raw: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of the ASCII-lower-cased words, in chunks."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: max(1, len(words) - width + 1)], ends[min(width, len(words)) - 1 :]
    for k in range(0, len(starts), CHUNK):
        spans = map(slice, starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())
        yield np.array([digest(s, SEED) for s in map(joined.__getitem__, spans)], np.uint64)


def lanes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The hashes and count - 1 remixes of them (n x count); the mixer's constants are those of SplitMix64."""
    out = [hashes]
    for lane in range(1, count):
        x = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(raw: bytes, width: int = 4, bits: int = 64) -> bytes:
    total, ones = 0, np.zeros(bits, np.int64)
    for hashes in shingle_hashes(raw, width):
        total += len(hashes)
        mixed = lanes(hashes, bits // 64).astype(">u8").view(np.uint8)
        ones += np.unpackbits(mixed, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, bits: int = 64, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append fingerprint (binary, highest bit first)."""

    def make():
        return lambda batch: [pa.array([fingerprint(raw, width, bits) for raw in as_bytes(batch.column(text))], pa.binary())]

    return map_batches(docs, make, "fingerprint binary", keep)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """BK-trees of groups of fingerprints, and components of the members found by searching them."""

    def __init__(self, prints: np.ndarray, first: np.ndarray, sizes: np.ndarray, radius: int):
        """first and sizes: where each group starts among the prints, and its members."""
        self.prints, self.radius = prints, radius
        self.root, self.visited = np.repeat(first, sizes), 0
        self.parent = np.arange(len(prints))
        self.grow()

    def grow(self) -> None:
        """Nodes by level: a group's first member is its root; the others go below it, by their distance to it."""
        self.wide = self.prints.shape[1] * 64 + 1  # distances are smaller
        members, top = np.arange(len(self.prints)), self.root
        keys, nodes = [], []
        while True:
            below = members != top
            members, top = members[below], top[below]
            if not len(members):
                break
            edge = _distances(self.prints[members], self.prints[top])
            group = top * self.wide + edge
            order = np.argsort(group, kind="stable")  # members of a group keep their order
            members, group = members[order], group[order]
            new = np.diff(group, prepend=-1) != 0
            keys.append(group[new])
            nodes.append(members[new])
            top = np.repeat(members[new], np.diff(np.append(np.flatnonzero(new), len(members))))
        key, node = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*nodes, np.zeros(0, np.int64)])
        order = np.argsort(key)
        #: Each child, by its parent and edge.
        self.edges, self.children = key[order], node[order]

    def search(self, sizes: np.ndarray) -> None:
        """Link every member to those of its tree within the radius; sizes: of each member's group."""
        for member in self.some(sizes):
            self.follow(member, self.root[member], self.link)

    def some(self, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """All members, so many at a time that VISITS nodes are visited about at once."""
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + VISITS)))
            yield np.arange(start, stop)
            start = stop

    def link(self, member: np.ndarray, node: np.ndarray, apart: np.ndarray) -> int:
        near = (apart <= self.radius) & (member != node)
        self.union(member[near], node[near])
        return self.radius

    def follow(self, member: np.ndarray, node: np.ndarray, met: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray | int]) -> None:
        """Visit nodes, level by level, following the edges within a radius of the member's distance: what met(member, node, apart) gives."""
        while len(member):
            self.visited += len(member)
            apart = _distances(self.prints[member], self.prints[node])
            reach = met(member, node, apart)
            low = np.searchsorted(self.edges, node * self.wide + np.maximum(apart - reach, 0))
            high = np.searchsorted(self.edges, node * self.wide + np.minimum(apart + reach, self.wide - 1), side="right")
            count = high - low
            member = np.repeat(member, count)
            node = self.children[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(member))]

    def roots(self, members: np.ndarray) -> np.ndarray:
        at = self.parent[members]
        while not np.array_equal(above := self.parent[at], at):
            at = above
        self.parent[members] = at
        return at

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[i] with b[i]: the higher roots move below the lower ones until none differ."""
        while True:
            one, other = self.roots(a), self.roots(b)
            apart = one != other
            if not apart.any():
                return
            a, b, one, other = a[apart], b[apart], one[apart], other[apart]
            np.minimum.at(self.parent, np.maximum(one, other), np.minimum(one, other))


#: Places of the bits that make up each shard key, one after another.
Keys = list[list[int]]


def exact_keys(bits: int, radius: int, number: int) -> Keys:
    """Keys of which two fingerprints within the radius share one: j of radius + j bands, for the least j that leaves small shards."""
    for joint in range(1, bits - radius + 1):
        count = radius + joint
        cuts = [bits * k // count for k in range(count + 1)]
        if number <= SHARD_MEAN << (bits * joint // count) or joint == 4 or bits * (joint + 1) // (count + 1) > 48:
            break
    bands = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(some, []) for some in combinations(bands, joint)]


def candidate_keys(bits: int, least: float, number: int) -> Keys:
    """Keys of which two texts of the least similarity share one but for the share MISSED, drawn at random."""
    width = max(LEAST_BITS, ceil(log2(max(1, number) / CANDIDATE_MEAN)))
    # a bit agrees if no random plane parts the texts' shingle vectors
    agrees = 1 - acos(2 * least / (1 + least)) / pi
    count = ceil(log(MISSED) / log1p(-(agrees**width)))
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(bits) for _ in range(ceil(count * width / bits))])
    return [order[k * width : (k + 1) * width].tolist() for k in range(count)]


def shard_keys(prints: np.ndarray, keys: Keys) -> np.ndarray:
    """The shard keys of each fingerprint (n x keys): which key, then the values of its bits."""
    on = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
    out = []
    for number, places in enumerate(keys):
        own = np.full(len(prints), number, np.int64)
        for k in range(0, len(places), 16):
            some = places[k : k + 16]
            own = (own << len(some)) | (on[:, some].astype(np.float32) @ (2.0 ** np.arange(len(some), dtype=np.float32)[::-1])).astype(np.int64)
        out.append(own)
    return np.stack(out, axis=1)


def _prints(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").reshape(len(column), -1).astype(np.uint64)


def classes(prints: DataFrame) -> DataFrame:
    """A row for each fingerprint: rep, its smallest doc_id, and n, its rows."""
    return prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))


def _search(found: DataFrame, keys: Keys, found_in: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """What found_in() finds in whole blocks of shards of found (fingerprint, rep and any others), ordered by key, block, side and rep.

    at: the numbers of the keys under which a row is dealt; all of them without that column.
    """
    number, carried, all_keys = len(keys), [c for c in found.columns if c != "at"], "at" not in found.columns

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK // 4):
                part = batch.slice(at, CHUNK // 4)
                own = shard_keys(_prints(part.column("fingerprint")), keys)
                rows, which = np.repeat(np.arange(part.num_rows), number), np.tile(np.arange(number), part.num_rows)
                if not all_keys:
                    asked = part.column("at")
                    rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(asked).to_numpy())
                    which = asked.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(own[rows, which]), *(part.column(c).take(pa.array(rows)) for c in carried)], names=["key", *carried])

    rows = found.where("rep IS NOT NULL").mapInArrow(dealt, T.StructType([T.StructField("key", T.LongType()), *(found.schema[c] for c in carried)]))
    hot = rows.groupBy("key").count().where(F.col("count") > SHARD_ROWS).select("key", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("parts"))
    hot = materialize(hot, "hot-shards")
    if hot.isEmpty():
        blocked = rows.select("key", F.lit(0).alias("block"), F.lit(0).alias("side"), *carried)
    else:
        own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        spread = rows.join(broadcast_if_small(hot, BROADCAST_ROWS), "key", "left").withColumns({"parts": F.coalesce("parts", F.lit(1))}).withColumn("side", own)
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        spread = spread.select("key", "side", "parts", *carried, other.alias("other"))
        blocked = spread.select("key", (F.least("side", "other") * F.col("parts") + F.greatest("side", "other")).alias("block"), "side", *carried)
    dealt_rows = blocked.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "side", "rep")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            if not whole.num_rows:
                continue
            group = np.stack([whole.column("key").to_numpy(), whole.column("block").to_numpy().astype(np.int64)], axis=1)
            last = int(np.flatnonzero((group != group[-1]).any(axis=1)).max(initial=-1)) + 1
            yield from found_in(whole.slice(0, last))
            held = [whole.slice(last)]
        if held:
            yield from found_in(pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0])

    return dealt_rows.mapInArrow(searched, out)


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the blocks of shards in a batch."""
    key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
    return first, np.diff(np.append(first, len(key)))


def links(found: DataFrame, radius: int, bits: int) -> DataFrame:
    """Pairs (a, b) of reps that connect all classes (fingerprint, rep) within the radius of each other; not all such pairs."""

    def found_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows < 2:
            return
        prints, rep = _prints(batch.column("fingerprint")), batch.column("rep").to_numpy()
        forest = Forest(prints, *_blocks(batch), radius)
        sizes = np.bincount(forest.root, minlength=len(prints))[forest.root]
        forest.search(sizes)
        at = np.arange(len(prints))
        root = forest.roots(at)
        moved = root != at
        yield pa.RecordBatch.from_arrays([pa.array(rep[moved], pa.int64()), pa.array(rep[root[moved]], pa.int64())], names=["a", "b"])

    pairs = _search(found.select("fingerprint", "rep"), exact_keys(bits, radius, found.count()), found_in, "a bigint, b bigint").where("a <> b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def first_met(prints: np.ndarray, a: np.ndarray, b: np.ndarray, earlier: Keys) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) share none of the earlier keys, and so haven't been met before."""
    new = np.ones(len(a), bool)
    if not earlier or not len(a):
        return new
    rows = np.unique(np.concatenate([a, b]))
    own = shard_keys(prints[rows], earlier)
    for k in range(0, len(a), CHUNK):
        part = slice(k, k + CHUNK)
        new[part] = ~(own[np.searchsorted(rows, a[part])] == own[np.searchsorted(rows, b[part])]).any(axis=1)
    return new


def tally(hashes: np.ndarray) -> bytes:
    """How many of the distinct hashes fall into each bucket, 255 at most."""
    return np.minimum(np.bincount(hashes & np.uint64(BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def may_be_alike(tallies: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) may have that similarity: two sets share no more of a bucket than the lesser count there."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), CHUNK):
        part = slice(k, k + CHUNK)
        lesser = np.minimum(tallies[a[part]], tallies[b[part]])
        both = lesser.sum(axis=1, dtype=np.int64)
        total = tallies[a[part]].sum(axis=1, dtype=np.int64) + tallies[b[part]].sum(axis=1, dtype=np.int64)
        # of counts cut off in both sets, nothing is known
        out[part] = (both * (1 + least) >= least * total - 1e-6) | (lesser == 255).any(axis=1)
    return out


def candidates(found: DataFrame, radius: int, keys: Keys, nearest: bool, least: float = 0.0) -> DataFrame:
    """Pairs (a, b) of nodes within the radius, of different components, that share one of the keys, each pair at its first key only.

    found: (fingerprint, node, component), perhaps tally, by which pairs that can't have the least
    similarity are left out, and perhaps at, the numbers of the keys to look under. All such pairs (a > b);
    or a row (a, b, at) for each a with any other component within the radius: the nearest b, or null where
    that is left out, and the keys that a shares with any such node. Components only grow together, so
    no later round needs another key.
    """

    def found_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows < 2:
            return
        prints = _prints(batch.column("fingerprint"))
        node, component, side, key = (batch.column(c).to_numpy() for c in ("rep", "component", "side", "key"))
        tallies = np.frombuffer(b"".join(batch.column("tally").to_pylist()), np.uint8).reshape(-1, BUCKETS) if tallied else None
        out, held = [], 0

        def ended() -> pa.RecordBatch:
            nonlocal out, held
            one, two, bits_apart, number, fit = map(np.concatenate, zip(*out, strict=True))
            out, held = [], 0
            columns = [pa.array(one, pa.int64()), pa.array(two, pa.int64(), mask=~fit), pa.array(bits_apart, pa.int64()), pa.array(number, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "apart", "at"])

        first, sizes = _blocks(batch)
        sides = np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first)
        forest = Forest(prints, first, sizes, radius)
        split, sizes, numbers = np.repeat(sides, sizes), np.repeat(sizes, sizes), key >> len(keys[0])
        #: The nearest so far: its distance, then its row.
        best = np.full(len(prints), (radius + 1) << 32, np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def met(member: np.ndarray, at: np.ndarray, apart: np.ndarray) -> np.ndarray | int:
            # of two blocks, each is compared with the other
            fits = np.flatnonzero((apart <= radius) & (component[member] != component[at]) & (~split[member] | (side[member] != side[at])))
            if nearest:
                np.minimum.at(best, member[fits], apart[fits] << 32 | at[fits])
                return np.minimum(best[member] >> 32, radius)
            fits = fits[node[member[fits]] > node[at[fits]]]
            pairs.append((member[fits], at[fits], apart[fits]))
            return radius

        for members in forest.some(sizes):
            forest.follow(members, forest.root[members], met)
            if nearest:
                one = members[best[members] >> 32 <= radius]
                two, bits_apart = best[one] & 0xFFFFFFFF, best[one] >> 32
            else:
                one, two, bits_apart = map(np.concatenate, zip(*pairs, strict=True))
                pairs.clear()
            for number in np.unique(numbers[one]).tolist():
                some = numbers[one] == number
                x, y, apart = one[some], two[some], bits_apart[some]
                # at the first key that a text shares with its nearest, its nearest is as near
                fit = first_met(prints, x, y, keys[:number])
                if tallies is not None:
                    fit[fit] = may_be_alike(tallies, x[fit], y[fit], least)
                if not nearest:
                    x, y, apart, fit = x[fit], y[fit], apart[fit], fit[fit]
                if len(x):
                    out.append((node[x], node[y], apart, np.full(len(x), number), fit))
                    held += len(x)
                if held >= CHUNK:
                    yield ended()
        if held:
            yield ended()

    tallied = "tally" in found.columns
    rows = found.select("fingerprint", F.col("node").alias("rep"), "component", *(c for c in ("tally", "at") if c in found.columns))
    pairs = _search(rows, keys, found_in, "a bigint, b bigint, apart bigint, at int")
    if nearest:
        closest = F.min(F.when(F.col("b").isNotNull(), F.struct("apart", "b")))["b"]
        return pairs.groupBy("a").agg(closest.alias("b"), F.collect_set("at").alias("at"))
    return pairs.select("a", "b").distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that connect all nodes whose pairs have at least that similarity; sets: (node, hashes).

    Pairs are dealt into cells by both their nodes, and each set goes once to each cell that needs it;
    pairs that a cell's earlier ones connect are left out.
    """
    parts = max(1, -(-sets.count() // CELL))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    pairs = pairs.withColumn("cell", own("a") * parts + own("b"))
    # the ids are broadcast, lest the sets be shuffled once more
    needed = sets.join(broadcast_if_small(pairs.select(F.col("cell").alias("to"), F.col("a").alias("node")).union(pairs.select("cell", "b")).distinct(), CANDIDATE_ROWS), "node").select("to", "node", "hashes")

    def compared(links: pa.Table, rows: pa.Table) -> pa.Table:
        hashes = {n: np.frombuffer(h, np.uint64) for n, h in zip(rows.column("node").to_pylist(), rows.column("hashes").to_pylist(), strict=True)}
        parent = {n: n for n in hashes}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        kept = []
        for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True):
            one, other = root(a), root(b)
            if one != other and similarity(hashes[a], hashes[b]) >= least:
                parent[max(one, other)] = min(one, other)
                kept.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    return pairs.groupBy("cell").cogroup(needed.groupBy("to")).applyInArrow(compared, "a bigint, b bigint")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): each id of the pairs (a > b) with the smallest id it is connected to.

    Large-star and small-star steps: neighbours above an id are moved to the least of its neighbours,
    then neighbours below it, until no pair changes; each round is written out.
    """

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))

    def state(rows: DataFrame):
        return rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(pairs, "links")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).withColumn("least", F.least("a", "least"))
        large = join_counted(both.where("b > a"), low, "a", 2 * before[0]).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = materialize(large, "links")
        low = least(large)
        small = join_counted(large, low, "a", 2 * before[0]).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(low.select("a", F.col("least").alias("b")))
        after = materialize(small.distinct(), "links")
        release(now)
        release(large)
        now, was, before = after, before, state(after)
        if was == before:
            break
    return holding(now.select(F.col("a").alias("id"), F.col("b").alias("component")), now)


def cluster(docs: DataFrame, width: int = 4, bits: int = 64, radius: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    prints = materialize(fingerprints(docs.select("doc_id", text), width, bits, text, ["doc_id"]), "fingerprints")
    found = materialize(classes(prints), "classes")
    labels = components(links(found, radius, bits))
    # ids that stand for several fingerprints join them
    named = found.join(labels, found["rep"] == labels["id"], "left").select("fingerprint", "n", F.coalesce("component", "rep").alias("component_id"))
    return holding(join_counted(prints, named, "fingerprint", prints.count()).select("doc_id", "fingerprint", "component_id"), prints, found, labels)


def digest(raw: bytes) -> bytes:
    """Equal for texts of the same ASCII-lower-cased words."""
    return hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest()


def near_duplicates(docs: DataFrame, width: int, bits: int, radius: int, least: float, text: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text): components of texts whose shingle sets are at least so similar."""

    def printed():
        return lambda batch: [
            pa.array([fingerprint(raw, width, bits) for raw in as_bytes(batch.column(text))], pa.binary()),
            pa.array([digest(raw) for raw in as_bytes(batch.column(text))], pa.binary()),
        ]

    def hashed():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            raws = as_bytes(batch.column(text))
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(raw, width)])).tobytes() for raw in raws]
            tallies = [tally(np.frombuffer(s, np.uint64)) for s in sets]
            return [pa.array([digest(raw) for raw in raws], pa.binary()), pa.array(sets, pa.binary()), pa.array(tallies, pa.binary())]

        return run

    prints = materialize(map_batches(docs.select("doc_id", text), printed, "fingerprint binary, digest binary", ["doc_id"]), "fingerprints")
    found = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("fingerprint").alias("fingerprint"), F.count("*").alias("n"))
    found = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = candidate_keys(bits, least, found.count())
    nodes, labels, sets, linked, pairs, held = found.where("rep IS NOT NULL").withColumn("component", F.col("rep")), None, None, None, None, []
    for turn in range(ROUNDS + 1):
        before, pairs = pairs, materialize(candidates(nodes.drop("digest", "rep", "n"), radius, keys, turn < ROUNDS, least), "candidates")
        if before is not None:
            release(before)
        if pairs.isEmpty():
            break
        if sets is None:
            # every node of a pair has a nearest one
            met = broadcast_if_small(pairs.select(F.col("a").alias("node")), CANDIDATE_ROWS)
            nodes = materialize(nodes.drop("component").join(met, "node", "left_semi"), "candidate-nodes")
            known = nodes
            wanted = broadcast_if_small(nodes.select(F.col("rep").alias("doc_id"), "node", F.col("digest").alias("node_digest")), CANDIDATE_ROWS)
            near = docs.select("doc_id", text).join(wanted, "doc_id")
            near = map_batches(near, hashed, "digest binary, hashes binary, tally binary", ["node", "node_digest"])
            sets = materialize(near.where("digest = node_digest").select("node", "hashes", "tally"), "shingles")
            if sets.count() > nodes.count():  # rows of one id and text
                repeated = sets
                sets = materialize(repeated.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("tally").alias("tally")), "shingles")
                release(repeated)
            held += [known, sets]
        new = alike(pairs.where("b IS NOT NULL").select("a", "b"), sets.select("node", "hashes"), least)
        rep = known.select("node", "rep")
        new = new.join(rep.toDF("a", "rep_a"), "a").join(rep.toDF("b", "rep_b"), "b").where("rep_a <> rep_b")
        new = new.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b"))
        linked = materialize((new if linked is None else new.union(linked)).distinct(), "alike")
        labels = components(linked)
        held += [linked, labels]
        nodes = known.join(labels, known["rep"] == labels["id"], "left").select(*known.columns, F.coalesce("component", "rep").alias("component"))
        if turn < ROUNDS:
            nodes = nodes.join(sets.select("node", "tally"), "node").join(pairs.select(F.col("a").alias("node"), "at"), "node")
    named = found.select("digest", "rep", "n")
    if labels is not None:
        named = named.join(labels, named["rep"] == labels["id"], "left").select("digest", F.coalesce("component", "rep").alias("rep"), "n")
    out = join_counted(prints, named.withColumnRenamed("rep", "component_id"), "digest", prints.count()).select("doc_id", "component_id")
    return holding(out, prints, found, pairs, *held)
