"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct k-word shingles.  Two documents link when their Jaccard
similarity reaches a threshold.  The join is exact; nothing is sampled or capped:

1. *Routes.*  What links meets under a common key.  A set of over ``SMALL`` shingles is hashed
   into groups.  A link of sets with at most t differences leaves all but t groups equal, so
   with more than t groups some group has equal content on both sides (pigeonhole).  The number
   of groups is fixed per band of set sizes; a set near a band's lower end also enters the band
   below.  Small groups say little, so there are some groups to spare, s + c, and each set leaves
   out its s smallest ones.  At least s + c + 1 groups of a linked pair are equal; equal groups rank
   alike on both sides, so the c + 1 largest of them have s equal ones below them and are entered
   by both.  Groups of less than ``LEAST`` shingles are never entered: if one of those c + 1 is
   such, both sets hold it among those to enter, and so both go the second way as well.  Of the
   groups that other sets have too, each set then leaves out the c that most sets have: the rarest
   of the c + 1 is kept by both sides.  So sets that share a passage or some frequent shingles, and
   with them no more than c groups, don't tie, and ties don't chain the corpus to one block.
2. *The second way* is for small sets, sets whose partners may be small, and sets with groups
   that are too small.  Shingles have one order, by how often a table of counts of fixed size
   has seen their hash over all documents, the rarest first.  Of linked sets, the first
   ``n - least overlap + 1`` shingles have one in common, which is the key.  Many short texts
   share a phrase, so a key alone says little: an entry carries its set's counts by group, and
   only those tie whose overlap bound reaches what the threshold asks for.
3. *Blocks.*  Ties (stars or forests, not all pairs) have connected components, which are parted
   by sizes to blocks: what links is in one of them.  Equal sets are one member throughout.
4. *R-tree.*  Within a block, members' group counts are points of an R-tree.  A node's or a
   point's overlap is at most the sum of coordinate minima; what reaches the needed overlap is
   verified on the shingles.  Pairs already connected are not verified again.  A block over
   ``TILE`` members or ``TILE_BYTES`` is dealt out in tiles.  Each tile is linked by itself, then
   the tiles' connected groups by one member each; only where that leaves a block in several
   parts are all pairs of its tiles looked at, less those within a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Router, checkpoint, components, lean, lean_group, parts, sieve, spread_join, star_forest, text_bytes, unpack, width, written
from .textkit import Words, byte_values, mix, not_space, runs

RATIO = 1.3
SMALL = 64
LEAST = 1
TILE, TILE_BYTES = 600, 16 << 20
CROWD = 2000
HELD_BYTES = 8 << 20
COUNTS = 64
LEAF, FAN = 16, 16
SEEN, PIECE = 1 << 20, 1 << 12
U = np.uint64
_A, _B, _C = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; fewer than k words make one shingle."""
    is_word, values = not_space(), byte_values(lower=True)
    for i, j, data, offsets in runs(texts):
        w = Words(data, offsets, is_word, values)
        grams = w.grams(k)
        for d in range(j - i):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                yield i + d, s[np.r_[True, s[1:] != s[:-1]]]
            elif b > a:
                yield i + d, np.array([w.sequence_hash(a, b) ^ _C], np.uint64)
            else:
                yield i + d, np.zeros(0, np.uint64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(s ^ _A).sum(dtype=np.uint64) + U(len(s)), mix(s ^ _B).sum(dtype=np.uint64)], np.uint64)).view(np.int64)
    return int(x[0]), int(x[1])


class Bands:
    """Bands of set sizes over ``SMALL`` and the number of groups in each, for a threshold of ``percent``."""

    def __init__(self, percent: int):
        self.percent, self.known = percent, {}
        self.edges = [SMALL + 1]

    def at(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * RATIO)))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def groups(self, band: int) -> tuple[int, int, int]:
        """(groups, small ones that are left out, common ones that are left out) of a band."""
        if band not in self.known:
            most = (self.edges[band + 1] - 1) * (100 - self.percent) // self.percent  # differences of a linked pair whose smaller set is in the band
            spare = -(-(most + 1) // 4) if most else 0
            self.known[band] = (most + 1 + spare, spare // 2, spare - spare // 2)
        return self.known[band]

    def partner(self, n: int) -> int:
        """The least size of a linked set."""
        return max(1, -(-n * self.percent // 100))

    def of(self, n: int) -> list[int]:
        """The own band, and the bands below in which a smaller partner may be; none for a small set."""
        return list(range(self.at(max(SMALL + 1, self.partner(n))), self.at(n) + 1)) if n > SMALL else []


def signatures(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, bool]:
    """(keys of the groups to enter, whether all of these are large enough)."""
    out, whole = [np.zeros(0, np.uint64)], True
    for band in bands.of(len(s)):
        m, small, _ = bands.groups(band)
        with np.errstate(over="ignore"):
            g = ((mix(s ^ (_B * U(band + 1))) >> U(33)) % U(m)).astype(np.int64)
            content = np.zeros(m, np.uint64)
            np.add.at(content, g, mix(s ^ _C))
            sig = (mix(content ^ mix(np.arange(m, dtype=np.uint64) + (U(band + 1) << U(32)))) >> U(8)) | (U(min(band, 255)) << U(56))
        sizes = np.bincount(g, minlength=m)
        chosen = np.lexsort((sig, sizes))[small:]
        large = sizes[chosen] >= LEAST
        out.append(sig[chosen[large]])
        whole &= bool(large.all())
    return np.concatenate(out), whole


def seen_at(s: np.ndarray) -> np.ndarray:
    """Where the table of counts has a shingle."""
    return (mix(s ^ _B) >> U(20)).astype(np.int64) % SEEN


def prefix(s: np.ndarray, bands: Bands, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that a linked set has one of them among its own rarest."""
    order = np.lexsort((s, often[seen_at(s)]))
    return s[order[: len(s) - bands.partner(len(s)) + 1]]


NIBBLES = 32


def nibbles(s: np.ndarray) -> tuple[int, int]:
    """Counts of 32 groups in 4 bits each, the most 15."""
    c = np.minimum(np.bincount((mix(s ^ _A) >> U(40)).astype(np.int64) % NIBBLES, minlength=NIBBLES), 15).astype(np.uint64)
    shift = np.arange(16, dtype=np.uint64) * U(4)
    return int((c[:16] << shift).sum(dtype=np.uint64)), int((c[16:] << shift).sum(dtype=np.uint64))


def spread_counts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The counts as rows; 15 may be any more, so it bounds nothing."""
    shift = np.arange(16, dtype=np.uint64) * U(4)
    c = np.hstack([(x[:, None] >> shift) & U(15) for x in (low, high)]).astype(np.int32)
    return np.where(c == 15, 1 << 20, c)


def _describe(k: int, percent: int):
    """Rows of documents (kind 0), and pieces of the task's table of counts (kind 1, doc_id the piece)."""

    def run(batches):
        often, some = np.zeros(SEEN, np.int64), False
        for batch in batches:
            n, k1, k2 = [], [], []
            for _, s in shingle_sets(batch.column("text"), k):
                a, b = identity(s)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                if 0 < len(s) * percent <= SMALL * 100:
                    np.add.at(often, seen_at(s), 1)
                    some = True
            rows = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.nulls(rows, pa.binary())], names=DESCRIBED)
        for a in range(0, SEEN if some else 0, PIECE):
            part, null = often[a : a + PIECE], pa.nulls(1, pa.int64())
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([a // PIECE], pa.int64()), null, null, null, null, pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=DESCRIBED)

    return run


DESCRIBED = ["kind", "doc_id", "th", "n_shingles", "k1", "k2", "packed"]
DESCRIPTION = "kind int, doc_id long, th long, n_shingles long, k1 long, k2 long, packed binary"


def _total(group: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.int64)
    for p in group.column("packed"):
        total += np.frombuffer(zlib.decompress(p.as_py()), np.int64)
    return pa.table({"piece": group.column("piece").slice(0, 1), "salt": group.column("salt").slice(0, 1), "packed": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def order_of_shingles(described: DataFrame) -> np.ndarray:
    """The table of counts over all documents: ``SEEN`` numbers, whatever the corpus.

    Tasks' tables add up in two steps, so that no task takes those of all.  An order needs no
    more than magnitudes: two bytes hold a sum's logarithm."""
    schema = "piece long, salt int, packed binary"
    pieces = described.where("kind = 1").select(F.col("doc_id").alias("piece"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"), "packed")
    pieces = pieces.groupBy("piece", "salt").applyInArrow(_total, schema).withColumn("salt", F.lit(0)).groupBy("piece", "salt").applyInArrow(_total, schema)
    often = np.zeros(SEEN, np.uint16)
    for r in pieces.collect():  # SEEN / PIECE rows at most
        total = np.frombuffer(zlib.decompress(r["packed"]), np.int64)
        often[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.rint(np.log2(total + 1) * 1024).astype(np.uint16)
    return often


GROUP = ["u8", "i8"]
SHARED = ["u8", "i8", "u2"]
RARE = ["u8", "i8", "u4", "u8", "u8"]
TIE = ["i8", "i8"]
CROWDED = (1 << 32) - 1


class Entries:
    """Entries by group, by rare shingle, and ties, in three ranges of ``buckets`` buckets.

    Before they are sent, entries of one key meet.  Those by rare shingle tie here to the least of
    them if they are a crowd, so that a key which most documents share costs no more than an entry
    for each flush.  Those by group go on, as it counts how many sets have a group."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.held: tuple[list, list] = ([], [])
        self.bytes = [0, 0]
        self.out = [Router(3 * buckets, f, HELD_BYTES) for f in (TIE, GROUP, RARE)]

    def add(self, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held[kind].append(columns)
        self.bytes[kind] += len(columns[0]) * (16, 36)[kind]
        if self.bytes[kind] >= HELD_BYTES:
            yield from self.meet(kind)

    def meet(self, kind: int) -> Iterator[pa.RecordBatch]:
        if not self.held[kind]:
            return
        columns = [np.concatenate(c) for c in zip(*self.held[kind], strict=True)]
        self.held[kind].clear()
        self.bytes[kind] = 0
        sig, key, *more = _distinct(columns)
        cuts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[cuts, len(sig)])
        crowd = (sizes > CROWD) & (kind == 1)
        head = np.repeat(cuts, sizes)
        tied = np.repeat(crowd, sizes)
        a, b = key[tied], key[head[tied]]
        a, b = a[a != b], b[a != b]
        send = ~tied
        send[cuts] = True
        if more:
            more[0] = np.where(tied, CROWDED, more[0])
        bucket = (sig[send] % U(self.buckets)).astype(np.int32)
        yield from self.out[1 + kind].add(bucket + kind * self.buckets, *(c[send] for c in (sig, key, *more)))
        yield from self.out[0].add((a.view(np.uint64) % U(self.buckets)).astype(np.int32) + 2 * self.buckets, a, b)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            yield from self.meet(kind)
        for router in self.out:
            yield from router.flush()


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns (sig, key, ...) in order, each (sig, key) once."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])][: len(order)]
    return [c[new] for c in columns]


def _enter(k: int, percent: int, buckets: int, often):
    def run(batches):
        bands, entries, last, order = Bands(percent), Entries(buckets), set(), often.value
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if not len(s):
                    continue
                key = identity(s)[0]
                if key in last:
                    continue
                if len(last) >= 200_000:  # copies that come after are entered again, which changes nothing
                    last.clear()
                last.add(key)
                sig, whole = signatures(s, bands)
                if len(sig):
                    yield from entries.add(0, sig, np.full(len(sig), key, np.int64))
                if not whole or bands.partner(len(s)) <= SMALL:
                    first = mix(prefix(s, bands, order) ^ _A)
                    n, (low, high) = len(first), nibbles(s)
                    yield from entries.add(1, first, np.full(n, key, np.int64), np.full(n, len(s), np.uint32), np.full(n, low, np.uint64), np.full(n, high, np.uint64))
        yield from entries.flush()

    return run


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties the sets that share a key to the least of them; rows are in order."""
    head = key[np.maximum.accumulate(np.where(np.r_[True, sig[1:] != sig[:-1]][: len(sig)], np.arange(len(sig)), 0))]
    return key[key != head], head[key != head]


def _packed(buckets: int, fields: list[str], at: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Entries for a next shuffle, as a Router packs them."""
    router = Router(buckets, fields)
    router.held.append((at.astype(np.int32), *columns))
    return pa.Table.from_batches(router.flush(), pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))


def _shared(percent: int, buckets: int):
    """Of entries by group, those that several sets have, by set; else ties, in the second range of ``buckets``."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("bucket")[0].as_py() // buckets
        if kind == 2:
            a, b = unpack(group.column("packed"), TIE)
        elif kind == 0:
            sig, key = _distinct(unpack(group.column("packed"), GROUP))
            sizes = np.diff(np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])) if len(sig) else np.zeros(0, np.int64)
            sets = np.repeat(sizes, sizes)
            sig, key, sets = (c[sets > 1] for c in (sig, key, sets))
            return _packed(2 * buckets, SHARED, key.view(np.uint64) % U(buckets), sig, key, np.minimum(sets, 65535))
        else:
            columns = unpack(group.column("packed"), RARE)
            order = np.argsort(-columns[2].astype(np.int64), kind="stable")  # of one key's entries, that of a crowd counts
            sig, key, size, low, high = _distinct([c[order] for c in columns])
            cuts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True]) if len(sig) else np.zeros(0, np.int64)
            pairs: list[tuple[int, int]] = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > CROWD or (size[x:y] == CROWDED).any():  # a star ties them all, which loses nothing
                    pairs += [(i, x) for i in range(x + 1, y)]
                elif y - x > 1:
                    pairs += [(x + i, x + j) for i, j in forest(spread_counts(low[x:y], high[x:y]), size[x:y].astype(np.int64), percent)]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            a, b = key[at[:, 0]], key[at[:, 1]]
        a, b = star_forest(a, b)
        return _packed(2 * buckets, TIE, a.view(np.uint64) % U(buckets) + U(buckets), a, b)

    return run


def _rarest(percent: int, buckets: int):
    """Entries by group without those that each set leaves out in each band, by group; ties as they are."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= buckets:
            return group.select(["bucket", "packed"])
        sig, key, sets = unpack(group.column("packed"), SHARED)
        band = (sig >> U(56)).astype(np.int64)
        order = np.lexsort((sig, -sets.astype(np.int64), band, key))
        sig, key, band = sig[order], key[order], band[order]
        start = np.r_[True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])][: len(key)]
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
        bands = Bands(percent)
        bands.at(1 << 40)
        out = np.array([bands.groups(b)[2] if b < 255 else 0 for b in range(int(band.max(initial=0)) + 1)])
        kept = place >= out[band]
        sig, key = sig[kept], key[kept]
        return _packed(2 * buckets, GROUP, sig % U(buckets), sig, key)

    return run


def _ties(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= buckets:
            a, b = unpack(group.column("packed"), TIE)
        else:
            a, b = _stars(*_distinct(unpack(group.column("packed"), GROUP)))
        a, b = star_forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def forest(points: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose overlap bound reaches what the threshold asks for."""
    parent, out, tree = Parents(len(sizes)), [], CountTree(points, sizes)
    for i in range(len(sizes)):
        found = tree.search(points[i], int(sizes[i]), percent)
        out += [(i, j) for j in found[found < i].tolist() if parent.join(i, j)]
    return out


class Parents:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


class CountTree:
    """R-tree over points of group counts: leaves of ``LEAF`` points, nodes of ``FAN`` children up to one root.

    A node knows the most of each coordinate and the range of sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upper, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while True:
            cuts = np.arange(0, len(low), step)
            upper, low, high = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((upper, low, high))
            if len(cuts) <= FAN:
                break
            step = FAN

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose overlap bound reaches the overlap that the threshold asks for, from the root down."""
        nodes = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            upper, low, high = (x[nodes] for x in self.levels[level])
            bound = np.minimum(np.minimum(upper, point).sum(1), np.minimum(size, high))
            nodes = nodes[((100 + percent) * bound >= percent * (size + low)) & (size * 100 >= low * percent)]
            step = FAN if level else LEAF
            below = len(self.levels[level - 1][1]) if level else len(self.sizes)
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < below]
        bound = np.minimum(np.minimum(self.points[nodes], point).sum(1), np.minimum(size, self.sizes[nodes]))
        return self.order[nodes[(100 + percent) * bound >= percent * (size + self.sizes[nodes])]]


def counts(sets: list[np.ndarray]) -> np.ndarray:
    points = np.zeros((len(sets), COUNTS), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((mix(s ^ _A) >> U(40)).astype(np.int64) % COUNTS, minlength=COUNTS)
    return points


def link(sets: list[np.ndarray], side: np.ndarray, two: bool, percent: int, whole: bool = False) -> list[tuple[int, int, int]]:
    """Links (row, row, overlap) between side 0 and 1 if there are ``two``, else between all rows.

    What is returned connects whatever is linked: at most one link less than there are rows.  With
    ``whole``, all links are returned."""
    parents = Parents(len(sets))
    sizes, points = np.array([len(s) for s in sets]), counts(sets)
    held = np.flatnonzero(side == 0) if two else np.arange(len(sets))
    asking = np.flatnonzero(side == 1) if two else np.arange(len(sets))
    if not len(held):
        return []
    tree, out = CountTree(points[held], sizes[held]), []
    for i in asking.tolist():
        found = held[tree.search(points[i], int(sizes[i]), percent)]
        for j in (found if two else found[found < i]).tolist():
            if not whole and parents.find(i) == parents.find(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if (100 + percent) * both >= percent * (sizes[i] + sizes[j]):
                parents.join(i, j)
                out.append((i, j, both))
    return out


def doublings(n: int, bands: Bands) -> range:
    """The powers of two below the sizes of a set and of its smaller partners."""
    return range(bands.partner(n).bit_length() - 1, n.bit_length())


def _sets(k: int, percent: int):
    """Sets of blocks.  A block is parted by sizes: a set goes where its size is and where smaller partners may be."""

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            k1, k2, block = (batch.column(c).to_numpy() for c in ("k1", "k2", "block"))
            kept, blocks, sizes, packed = [], [], [], []
            for row, s in shingle_sets(batch.column("text"), k):
                if identity(s) == (k1[row], k2[row]):  # texts meet their classes by a hash
                    for size in doublings(len(s), bands):
                        kept.append(row)
                        blocks.append(int(block[row]) ^ size)
                        sizes.append(size)
                        packed.append(s.tobytes())
            blocks = mix(np.array(blocks, np.int64).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in ("rep", "k1", "k2")), pa.array(blocks), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["rep", "k1", "k2", "block", "size", "packed"])

    return run


TILED = "a long, b long, shared long, n_a long, n_b long, k1 long, k2 long, block long, size int, packed binary"


def _tiles(percent: int, whole: bool, heads: bool):
    """Links within tiles; rows come sorted by tile, and one tile is held at a time.

    A member is known by its set's key (k1, k2): repeated rows are one, texts that share a doc_id are
    not.  With ``heads``, a tile by itself also tells one member of each of its connected parts:
    with its set if the block has other tiles."""

    def close(tile: tuple | None, held: dict) -> list[tuple]:
        rows, keys = list(held.values()), list(held)
        if not rows:
            return []
        two, sets = tile[1] != tile[2], [np.frombuffer(r["packed"], np.uint64) for r in rows]
        found = link(sets, np.array([int(r["chunk"] != tile[1]) for r in rows]), two, percent, whole) if len(rows) > 1 else []
        own = [len(s).bit_length() - 1 for s in sets]  # a pair is told where the smaller set's size is
        out = [(rows[i]["rep"], rows[j]["rep"], both, len(sets[i]), len(sets[j]), *[None] * 5) for i, j, both in found if not whole or min(own[i], own[j]) == rows[i]["size"]]
        if heads and not two:
            parents = Parents(len(rows))
            for i, j, _ in found:
                parents.join(i, j)
            out += [(r["rep"], None, None, None, None, *keys[i], tile[0], r["size"], r["packed"] if r["tiles"] > 1 else None) for i, r in enumerate(rows) if parents.find(i) == i]
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=[f.split()[0] for f in TILED.split(", ")])

    def run(batches):
        now, held = None, {}
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                key = (r["block"], r["ti"], r["tj"])
                if key != now:
                    out += close(now, held)
                    now, held = key, {}
                held[r["k1"], r["k2"]] = r
            yield batch_of(out)
        yield batch_of(close(now, held))

    return run


def _deal(sets: DataFrame, tiles: DataFrame, percent: int, pairs: str, whole: bool = False, heads: bool = False) -> DataFrame:
    """What tiles of sets(rep, k1, k2, block, size, packed) tell: ``pairs`` is "none" for each tile by
    itself, "two" for each two tiles, "all" for both.

    ``tiles`` has the number of tiles of each block.  Where tiles meet two by two, each goes to as
    many places as its block has tiles."""
    placed = _of_blocks(sets, tiles).withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), "tiles").cast("int"))
    placed = placed.withColumn("other", F.col("chunk") if pairs == "none" else F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    if pairs == "two":
        placed = placed.where("chunk <> other")
    out = placed.select("block", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"), "rep", "k1", "k2", "chunk", "tiles", "size", "packed")
    return out.repartition(width(sets.sparkSession), "block", "ti", "tj").sortWithinPartitions("block", "ti", "tj").mapInArrow(lean(_tiles(percent, whole, heads)), TILED)


def _tile_counts(sets: DataFrame) -> DataFrame:
    """(block, n, tiles) of blocks with two sets at least: so many tiles that one holds about ``TILE`` sets and ``TILE_BYTES``."""
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.octet_length("packed")) / TILE_BYTES))
    return checkpoint(sets.groupBy("block").agg(F.count("*").alias("n"), tiles.cast("int").alias("tiles")).where("n > 1"))


def _of_blocks(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``sets`` of the blocks, with the blocks' other columns but n; a block may hold most sets."""
    rows = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    return spread_join(sets, blocks, rows, ["block"]).drop("n")


def _prepare(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every row with its set's key, distinct sets with their least doc_id and number of rows, sets of blocks)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    p = width(spark)
    known = docs.where("doc_id IS NOT NULL")
    buckets = parts(text_bytes(known), 4 << 20)
    described = checkpoint(docs.mapInArrow(lean(_describe(k, percent)), DESCRIPTION))
    every = described.where("kind = 0").drop("kind", "packed")
    often = spark.sparkContext.broadcast(order_of_shingles(described))  # 2 * SEEN bytes
    entered = known.select("text").mapInArrow(lean(_enter(k, percent, buckets, often)), Router.SCHEMA)
    for step in (_shared(percent, buckets), _rarest(percent, buckets)):
        entered = entered.repartition(p, "bucket").groupBy("bucket").applyInArrow(lean_group(step), Router.SCHEMA)
    ties = entered.repartition(p, "bucket").groupBy("bucket").applyInArrow(lean_group(_ties(buckets)), "a long, b long")
    blocks = components(ties).select(F.col("node").alias("k1"), F.col("component").alias("block"))
    first = every.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.count("*").alias("n"))
    classes = checkpoint(first.select("k1", "k2", "n", F.col("f.doc_id").alias("rep"), F.col("f.th").alias("th")))
    placed = checkpoint(classes.drop("n").join(blocks, "k1"))
    asked = sieve(placed.select(F.xxhash64("rep", "th")), placed.count())  # texts of no block aren't shuffled
    texts = known.withColumnRenamed("doc_id", "rep").where(asked(F.xxhash64("rep", "th")))
    placed = placed.join(texts, ["rep", "th"]).select("rep", "block", "k1", "k2", "text")
    return every, classes.drop("th"), written(placed.mapInArrow(lean(_sets(k, percent)), "rep long, k1 long, k2 long, block long, size int, packed binary"))


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever is linked."""
    tiles = _tile_counts(sets)
    wide = tiles.where("tiles > 1")
    first = checkpoint(_deal(sets, tiles, percent, "none", heads=True))
    links = first.where("b IS NOT NULL").select("a", "b")
    if not wide.limit(1).count():
        return links
    heads = first.where("packed IS NOT NULL").select(F.col("a").alias("rep"), "k1", "k2", "block", "size", "packed")
    several = _tile_counts(heads)
    second = checkpoint(_deal(heads, several, percent, "all", heads=True))
    left = second.where("k1 IS NOT NULL").groupBy("block").agg(F.count("*").alias("parts")).where("parts > 1").select("block")
    torn = checkpoint(wide.join(left, "block", "left_semi"))  # still in parts, as far as the heads tell: all pairs of tiles
    links = links.unionByName(second.where("b IS NOT NULL").select("a", "b"))
    if torn.limit(1).count():
        links = links.unionByName(checkpoint(_deal(sets, torn, percent, "two")).select("a", "b"))
    return links


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``.

    ``docs`` needs doc_id (integer) and text; other columns, whatever their names, are ignored.
    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.  Null and empty texts have no
    shingle and link with nothing.  Rows that share a doc_id count as one document, whatever
    their texts: what one of them links with, all of them do.  Rows without doc_id link with
    nothing; their component_id is null.  An empty table gives an empty result.
    """
    every, classes, sets = _prepare(docs, k, percent)
    # A document with several texts ties their sets' least doc_ids to its own.
    known = every.where("doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x <> y").select("doc_id")
    tied = known.join(several, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = checkpoint(components(_linked(sets, percent).unionByName(tied)))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    texts = known.where("n_shingles > 0")
    told = spread_join(texts, named, texts.count(), ["k1", "k2"])
    empty = known.where("n_shingles = 0").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = told.unionByName(empty, allowMissingColumns=True).unionByName(every.where("doc_id IS NULL"), allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", F.least(F.coalesce("component", "doc_id"), "doc_id").alias("component_id"))


def ngram_jaccard_links(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(links, members): all links between different texts, and whose texts those are.

    links has rows (a, b, shared, n_a, n_b): a and b are the least doc_ids that have the texts (equal
    where one doc_id has both), ``shared`` the shingles in both sets, n_a and n_b the sets' sizes;
    each pair is there once, in either order.  members has a row (doc_id, rep, n_shingles) per row
    of ``docs``, rep null where there are no shingles or no doc_id.  Copies are not expanded into
    pairs.  There are as many rows as links: n * (n - 1) / 2 in a group of n near copies.
    """
    every, classes, sets = _prepare(docs, k, percent)
    links = _deal(sets, _tile_counts(sets), percent, "all", whole=True).select("a", "b", "shared", "n_a", "n_b")
    texts = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    others = every.where("n_shingles = 0 OR doc_id IS NULL")
    members = spread_join(texts, classes, texts.count(), ["k1", "k2"]).unionByName(others, allowMissingColumns=True)
    return links, members.select("doc_id", "rep", "n_shingles")
