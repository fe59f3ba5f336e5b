"""N-gram Jaccard join: size-banded tiles with bitmap signatures, exact, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, bounded_broadcast, discard, prepare, small, written

WORDS, PERCENT = 4, 85
#: Text that is hashed at a time, in bytes.
SLICE = 1 << 18
#: Signatures (16 bytes) that a task gathers before it sends them on, and that a bucket holds on average.
FLUSH, BUCKET = 1 << 17, 1 << 18
#: Sets of a task with one signature from which on they make a piece of its tile; members of a signature that a bucket's task holds.
HOT_IN_TASK, HELD = 64, 4096
BITS = 2048
#: Members (in MB of shingles) that are checked against one copy of their partner.
MEMBERS_MB = 8
#: Members of a tile's block, and elements of theirs in all (8 bytes each): a task compares two blocks at a time.
BLOCK, BLOCK_ELEMENTS = 2048, 2 << 20
#: Edges of a graph that a task connects at a time.
EDGES = 1_000_000
MAX_BROADCAST_IDS = 2_000_000
#: 64-bit names that unlike sets may share (they get others): chance makes some hundred among 10^11 sets.
MAX_SHARED = 10_000

# ---- shingles

_r = np.random.default_rng(77)
_TABLE = _r.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ODD = _r.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in bytes, with A-Z in lower case, and where each word starts."""
    white = _WHITE[data]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[_LOWER[data]] * _powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]), starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, of none has none."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= SLICE):
            size += len(raws[end]) + 1
            end += 1
        some = raws[at:end]
        h, starts = word_hashes(np.frombuffer(b" ".join(some), np.uint8))
        offsets = np.cumsum([0, *[len(x) + 1 for x in some]])
        first = np.searchsorted(starts, offsets)
        n = len(h) - words + 1
        grams = mix(sum((h[k : n + k] * _ODD[k] for k in range(words)), np.zeros(n, np.uint64))) if n > 0 else np.zeros(0, np.uint64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * _ODD[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
            else:
                out.append(np.zeros(0, np.uint64))
        at = end
    return out


def set_id(u: np.ndarray) -> int:
    """Order-free 64-bit name of a set."""
    return int((mix(u ^ _ODD[20]).sum(dtype=np.uint64, keepdims=True) * _ODD[21] + np.uint64(len(u))).view(np.int64)[0]) if len(u) else 0


def set_check(u: np.ndarray) -> int:
    """64 bits more: with them a name has 128."""
    return int((mix(u ^ _ODD[22]).sum(dtype=np.uint64, keepdims=True) * _ODD[23] + np.uint64(len(u))).view(np.int64)[0]) if len(u) else 0


def set_name(u: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The 64-bit name; where sets with other 128-bit names share it, the one that both halves make."""
    own = set_id(u)
    return own ^ set_check(u) if own in shared else own


# ---- signatures

def _level(n: int) -> int:
    """0 below 8 shingles, then one level for each doubling."""
    return max(0, n.bit_length() - 3)


def most_apart(n: int, percent: int, smaller: bool) -> int:
    """The most elements in which a set of n differs from a partner (both sides counted): from any, or from a smaller one."""
    rest = 100 - percent
    return 2 * rest * n // (100 + percent) if smaller else rest * n // percent


@cache
def parts_of(level: int, percent: int) -> int:
    """Parts of the hash space at a level: a tenth more than its sets (also those from the level above) may differ from partners."""
    top = (8 << level) - 1
    return 11 * max(most_apart(top, percent, False), most_apart(100 * top // percent, percent, True)) // 10 + 2


def signatures(u: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set such that any two unlike sets with enough Jaccard similarity share one.

    Let J >= percent / 100 and d be the most elements in which a set may differ from a partner. At each level the hash
    space is cut into more than d parts. A part's signature is the sum of its elements, or says that it is empty. Two
    partners differ in d parts at most, so all but d of their signatures are the same; with one order for all, the
    lowest one they share is among the d + 1 first of both. That order has parts of many elements first, for they
    seldom meet by a passage that many documents share, and empty ones last. A pair meets at the level of its smaller
    set: each set stands at its own level, and at those below where a partner may be. Sets too small to differ from a
    partner have no signature: their partners are equal sets, which are one class.
    """
    n = len(u)
    out = []
    own = _level(n)
    for level in range(_level(-(-percent * n // 100)), own + 1) if n else ():
        d = most_apart(n, percent, level < own)
        if not d:
            continue
        parts = parts_of(level, percent)
        part = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        salt = mix(_ODD[35:36] + np.uint64(level))
        s = mix(np.add.reduceat(mix(u ^ _ODD[31]), starts) + part[starts] * _ODD[32] + salt)
        s = s[np.lexsort((s, -np.diff(np.append(starts, n))))][: d + 1]
        if len(s) <= d:
            bare = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts])[: d + 1 - len(s)]
            s = np.concatenate([s, mix(bare * _ODD[34] + salt)])
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def width(n: int) -> int:
    """Bits for a set of n, four to eight for each element: unlike sets of n then differ in 1.5 n bits or more, partners in 0.25 n at
    most (at 80 %), and few elements that differ are hidden by others."""
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(u: np.ndarray, bits: int = BITS) -> bytes:
    """Each bit tells whether an odd number of elements hash to it: what two sets share cancels in their xor."""
    place = (u & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (last axis: uint64) as they are with fewer words: the xor of their pieces."""
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def may_link(a_n, b_n, a_bits: np.ndarray, b_bits: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Sizes and bitmaps (rows of uint64) that allow a link. A bit that differs needs an element that differs, so the
    count of differing bits bounds the overlap from above: both <= (a + b - differing bits) / 2."""
    apart = np.bitwise_count(a_bits ^ b_bits).sum(-1, dtype=np.int64)
    both = (a_n + b_n - apart) // 2
    return (100 * np.minimum(a_n, b_n) >= percent * np.maximum(a_n, b_n)) & ((100 + percent) * both >= percent * (a_n + b_n))


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


# ---- tasks

def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            columns = [pa.array([f(u) for u in sets], pa.int64()) for f in (len, set_id, set_check)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", "n", "set_id", "check"])

    return run


#: What a packed row holds: members of signatures, pieces of a hot signature's members, one member for each such piece.
PLAIN, PIECE, HOT = 0, 1, 2


def _signature_rows(words: int, percent: int, buckets: int, shared: frozenset[int], many: int):
    """bucket, kind, packed: signatures and the sets that have them, by ranges of signatures.

    A set that stands several times in a task is sent once. Where many sets of a task share a signature, only one of
    them goes to the signature's bucket; the others stay together as a piece of the tile, sent anywhere.
    """

    def packed(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(starts, len(sig)))
        rows: list[tuple[int, int, bytes]] = []
        for at, k in zip(starts[size >= many].tolist(), size[size >= many].tolist(), strict=True):
            for a in range(at, at + k, FLUSH):
                rows.append((int(ids[a]) % buckets, PIECE, sig[at : at + 1].tobytes() + ids[a : min(a + FLUSH, at + k)].tobytes()))
        hot = np.repeat(size >= many, size)
        first = np.zeros(len(sig), bool)
        first[starts] = True
        for kind, chosen in ((PLAIN, ~hot), (HOT, hot & first)):
            s, i = sig[chosen], ids[chosen]
            bucket = (((s >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(s)]
            rows += [(int(bucket[a]), kind, s[a:b].tobytes() + i[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["bucket", "kind", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, ids, size = [], [], 0
        for batch in small(batches):
            for u in shingle_sets(batch.column("text").to_pylist(), words):
                own = set_name(u, shared)
                if not len(u) or own in seen:
                    continue
                if len(seen) > FLUSH:
                    seen.clear()
                seen.add(own)
                s = signatures(u, percent)
                sigs.append(s)
                ids.append(np.full(len(s), own, np.int64))
                size += len(s)
            if size > FLUSH:
                yield packed(np.concatenate(sigs), np.concatenate(ids))
                sigs, ids, size = [], [], 0
        if size:
            yield packed(np.concatenate(sigs), np.concatenate(ids))

    return run


def pivot_order(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) ^ _ODD[50])


def _tiles(bucket: int, most: int):
    """Tiles (tile, set_id, hot): members of each signature that two sets or more have, from one or more buckets.

    A tile is named by its pivot, the member whose mixed id is lowest, so that the signatures that a group of similar sets
    shares are one tile. Hot signatures give their own name here, and their members go on as they come: no more of one
    are held than the limit.
    """
    name_of = lambda sig: mix(sig ^ _ODD[51]).view(np.int64)
    batch_of = lambda tile, ids, hot: pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), hot))], ["tile", "set_id", "hot"])

    def settled(sig, ids, hot):
        """Sorted without repeats; starts and sizes of signatures, and which are hot."""
        order = np.lexsort((ids, sig))
        sig, ids, hot = sig[order], ids[order], hot[order]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        any_hot = np.logical_or.reduceat(hot, starts) if len(sig) else hot
        marked = np.repeat(any_hot, np.diff(np.append(starts, len(sig))))
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])]) if len(sig) else np.zeros(0, bool)
        sig, ids, marked = sig[new], ids[new], marked[new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else starts
        size = np.diff(np.append(starts, len(sig)))
        return sig, ids, marked, starts, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, limit = 0, 4 * bucket

        def joined():
            cat = [np.concatenate([h[k] for h in held]) if held else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, bool))]
            return settled(*cat)

        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if kind == PIECE:
                    ids = np.frombuffer(raw, np.int64, offset=8)
                    yield batch_of(np.repeat(name_of(np.frombuffer(raw, np.uint64, 1)), len(ids)), ids, True)
                    continue
                half = len(raw) // 2
                ids = np.frombuffer(raw[half:], np.int64)
                held.append((np.frombuffer(raw[:half], np.uint64), ids, np.full(len(ids), kind == HOT)))
                count += len(ids)
            if count > limit:  # of signatures with many members one member stays
                sig, ids, marked, starts, size = joined()
                many = np.repeat(size > most, size)
                if many.any():
                    yield batch_of(name_of(sig[many]), ids[many], True)
                first = np.zeros(len(sig), bool)
                first[starts] = True
                keep = ~many | first
                held = [(sig[keep], ids[keep], (marked | many)[keep])]
                count = int(keep.sum())
                limit = max(limit, 2 * count)
        sig, ids, marked, starts, size = joined()
        if len(sig):
            yield batch_of(name_of(sig[marked]), ids[marked], True)
            keep = np.repeat(size > 1, size) & ~marked
            rank = pivot_order(ids)
            low = np.minimum.reduceat(rank, starts)
            pivot = ids[np.flatnonzero(rank == np.repeat(low, size))]  # ids of a signature differ, so do their ranks
            pairs = np.unique(np.stack([np.repeat(pivot, size)[keep], ids[keep]], 1), axis=0)
            yield batch_of(pairs[:, 0].copy(), pairs[:, 1].copy(), False)

    return run


def _full_sets(words: int, shared: frozenset[int]):
    """Rows (text, set_id): set_id, n, bits, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            if batch.column("set_id").to_pylist() != [set_name(u, shared) for u in sets]:
                raise RuntimeError("the documents changed between two reads")
            bits = [bitmap(u, width(len(u))) for u in sets]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array([len(u) for u in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in (bits, [u.tobytes() for u in sets])]], ["set_id", "n", "bits", "shingles"])

    return run


def _by_bits(percent: int):
    """Pairs (a, a_n, a_bits, b, b_n, b_bits) whose whole bitmaps allow a link: a, b, part.

    A part of the partners of b is as many as MEMBERS_MB of shingles hold, of one task.
    """

    def run(batches):
        from pyspark import TaskContext

        task, given = TaskContext.get().partitionId() << 32, {}
        for batch in small(batches, 1024):
            a_n, b_n = (np.asarray(batch.column(c)) for c in ("a_n", "b_n"))
            ok = 100 * np.minimum(a_n, b_n) >= percent * np.maximum(a_n, b_n)
            for i in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("a_bits", "b_bits"))
                words = min(len(x), len(y))
                ok[i] = may_link(a_n[i], b_n[i], folded(x, words), folded(y, words), percent)
            kept = batch.select(["a", "b"]).filter(pa.array(ok))
            parts = []
            for b, n in zip(kept.column("b").to_pylist(), a_n[ok].tolist(), strict=True):
                given[b] = given.get(b, 0) + 8 * n
                parts.append(task + (given[b] >> 20) // MEMBERS_MB)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(parts, pa.int64())], ["a", "b", "part"])

    return run


def _against_pivot(percent: int):
    """Rows (b, part, a, shingles) by b and part, that of b itself (a is null) first: the pairs (a, b) that link. One set is held at a time."""

    def run(batches):
        key = pivot = None
        for batch in small(batches, 1024):
            columns = [batch.column(c).to_pylist() for c in ("b", "part", "a", "shingles")]
            found = []
            for b, part, a, raw in zip(*columns, strict=True):
                if a is None:
                    key, pivot = (b, part), np.frombuffer(raw, np.uint64)
                elif key != (b, part):
                    raise RuntimeError(f"set {b} isn't there")
                elif links(pivot, np.frombuffer(raw, np.uint64), percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _allowed(comp: np.ndarray, n: np.ndarray, block: np.ndarray, bits: list[np.ndarray], percent: int):
    """Members of a tile by size: the place of each one, and of those after it from other components (and blocks, in a
    tile of two) whose bitmaps allow a link. comp is read anew for each."""
    two = (block != block[0]).any()
    size = np.array([len(x) for x in bits])
    tables = {}  # width in words: all rows of that width or the next, folded to it
    for w in np.unique(size).tolist():
        at = np.flatnonzero((size == w) | (size == 2 * w))
        tables[w] = (at[0], np.stack([bits[i] if size[i] == w else folded(bits[i], w) for i in at]))
    ends = np.searchsorted(n, 100 * n // percent, side="right")
    for i in range(len(n) - 1):
        first, table = tables[int(size[i])]
        j = np.arange(i + 1, max(i + 1, min(int(ends[i]), first + len(table))))
        j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) if two else True)]
        if len(j):
            j = j[may_link(n[j], n[i], table[j - first], table[i - first], percent)]
        if len(j):
            yield i, j


def _by_tile(batches, last: str, compare) -> Iterator[list]:
    """Rows come by tile: what compare(tile, rows by size) gives, some thousand at a time."""
    at, rows, out = None, [], []
    for b in (x for batch in batches for x in small([batch])):
        for tile, *row in zip(*[b.column(c).to_pylist() for c in ("tile", "set_id", "comp", "n", "block", last)], strict=True):
            if tile != at and rows:
                out += compare(at, sorted(rows, key=lambda r: r[2]))
                rows = []
            at = tile
            rows.append(row)
            if len(out) > 10_000:
                yield out
                out = []
    if rows:
        out += compare(at, sorted(rows, key=lambda r: r[2]))
    yield out


def _tile_members(percent: int):
    """Rows by tile (bits): tile, set_id, comp, block of those whose bitmap allows a link with a member of another component."""

    def compare(tile, rows):
        ids, comp, n, block = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        hit = np.zeros(len(rows), bool)
        for i, j in _allowed(comp, n, block, [np.frombuffer(r[4], np.uint64) for r in rows], percent):
            hit[i] = hit[j] = True
        return [(tile, *rows[i][:2], rows[i][3]) for i in np.flatnonzero(hit).tolist()]

    def run(batches):
        for out in _by_tile(batches, "bits", compare):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["tile", "set_id", "comp", "block"])

    return run


def _tile_links(percent: int):
    """Rows by tile (shingles): links (a, b) that connect what all links of a tile's members connect; two members of one component aren't checked."""

    def compare(tile, rows):
        ids, comp, n, block = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        found = []
        for i, j in _allowed(comp, n, block, [np.frombuffer(bitmap(u, width(len(u))), np.uint64) for u in sets], percent):
            for x in j.tolist():
                if comp[x] != comp[i] and links(sets[i], sets[x], percent):
                    found.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
                    comp[comp == comp[x]] = comp[i]
        return found

    def run(batches):
        for out in _by_tile(batches, "shingles", compare):
            yield _pairs_batch(out)

    return run


def _pairs_batch(pairs) -> pa.RecordBatch:
    unique = sorted({(int(a), int(b)) for a, b in pairs})
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in unique], pa.int64()), pa.array([p[1] for p in unique], pa.int64())], ["a", "b"])


def _blocks(block: int, elements: int):
    """Rows in order of tile: the number of each one's block, at most so many rows of one tile, and elements of theirs."""

    def run(batches):
        from pyspark import TaskContext

        at, inside, held, number = None, 0, 0, TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for tile, n in zip(b.column("tile").to_pylist(), b.column("n").to_pylist(), strict=True):
                if tile != at or inside == block or held + n > elements:
                    at, inside, held, number = tile, 0, 0, number + 1
                inside += 1
                held += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "block"])

    return run


# ---- components

def _hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, total: int) -> DataFrame:
    """Left join with a written table of groups by a long key, whatever part of the rows one key holds."""
    return attach_groups(rows, groups, key, size, total, F.xxhash64(F.lit("spread"), spread))


def _stars(most: int):
    """Edges (u, v) as edges from each node to the smallest one it reaches, by so many of them at a time."""

    def solved(held: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.concatenate(held)
        nodes, at = np.unique(pair, return_inverse=True)
        at = at.reshape(-1, 2)
        low = np.arange(len(nodes))
        while True:
            # each node takes the least label around it, then labels are followed to their end
            least = np.minimum(low[at[:, 0]], low[at[:, 1]])
            new = low.copy()
            for k in (0, 1):
                np.minimum.at(new, low[at[:, k]], least)
                np.minimum.at(new, at[:, k], least)
            while (new[new] != new).any():
                new = new[new]
            if (new == low).all():
                break
            low = new
        far = low != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[low[far]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([np.asarray(batch.column(c)) for c in ("u", "v")], 1))
                count += batch.num_rows
            if count >= most:
                yield solved(held)
                held, count = [], 0
        if count:
            yield solved(held)

    return run


def components(edges: DataFrame, name: str = "components", rounds: int | None = None) -> DataFrame:
    """node, root: for edges (a, b) each node's smallest reachable node.

    Tasks make stars of the edges they hold (some EDGES each), which is all where one task holds them. Beyond that large
    and small stars take turns over all edges. Each round writes its edges to the shared folder. A node with very many
    neighbours gets its row by broadcast, see attach_groups(). Rounds go on until the edges stop changing; where a
    bound on them is given and reached before, that is an error.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    n = e.count()
    whole = n < EDGES
    first, e = e, written(e.coalesce(n // EDGES + 1).mapInArrow(_stars(EDGES), "u long, v long"), name)
    discard(first)
    mark, done = None, 0
    while not whole:
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        done += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).withColumn("m", F.least("u", "m")), name)
        used = [e, low]
        large = _hot_join(both, low, "u", "deg", "v", 2 * e.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), name)
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")), name)
        few = _hot_join(large, low, "u", "deg", "v", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        few = few.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = written(few.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(*used, large, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _merged(comp: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components (node, root) with the links found between them."""
    if comp is None:
        first = written(components(found), "ngram_parts")
        discard(found)
        return first
    named = found
    for c in ("a", "b"):
        of = comp.select(F.col("node").alias(c), F.col("root").alias("r"))
        named = named.join(of, c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    new = components(named).withColumnsRenamed({"node": "old", "root": "new"})
    moved = comp.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = new.join(comp, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    merged = written(moved.union(fresh), "ngram_parts")
    discard(comp, found)
    return merged


# ---- join

def tile_table(docs: DataFrame, total_shingles: int, words: int, percent: int, shared: frozenset[int] = frozenset()) -> DataFrame:
    """tile, set_id: sets that share a signature, once for each pivot of theirs."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, int(total_shingles * 1.2 * (100 - percent) / percent) // BUCKET)
    packed = docs.mapInArrow(_signature_rows(words, percent, buckets, shared, HOT_IN_TASK), "bucket long, kind int, packed binary")
    tiles = written(packed.repartition(buckets, "bucket").mapInArrow(_tiles(BUCKET, HELD), "tile long, set_id long, hot boolean").distinct(), "ngram_tiles")
    hot = tiles.where("hot").select("tile", "set_id")
    total = hot.count()
    if not total:
        return tiles.select("tile", "set_id")
    named = written(hot.groupBy("tile").agg(F.min_by("set_id", F.struct(F.xxhash64("set_id"), "set_id")).alias("pivot"), F.count("*").alias("size")), "ngram_hot")
    by_pivot = _hot_join(hot, named, "tile", "size", "set_id", total).select(F.col("pivot").alias("tile"), "set_id")
    out = written(by_pivot.union(tiles.where("not hot").select("tile", "set_id")).distinct(), "ngram_tiles")
    discard(tiles, named)
    return out


def blocked(members: DataFrame, big: DataFrame, n: int, percent: int) -> DataFrame:
    """Members of tiles (tile, set_id, comp, n, bits) with block: the n big tiles (of over BLOCK members or BLOCK_ELEMENTS) become pairs of blocks.

    Blocks follow sizes, with the tile's largest component apart. Two blocks meet only if their sizes allow a link
    and they don't hold one component alone; each meets itself.
    """
    if not n:
        return members.withColumn("block", F.lit(0).cast("long"))
    few = bounded_broadcast(big, n, MAX_BROADCAST_IDS)
    small = members.join(few, "tile", "left_anti").withColumn("block", F.lit(0).cast("long"))
    large = written(members.join(few, "tile", "left_semi"), "ngram_large")
    top = large.groupBy("tile", "comp").agg(F.count("*").alias("k")).groupBy("tile").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"))
    large = large.join(bounded_broadcast(top, n, MAX_BROADCAST_IDS), "tile").withColumn("apart", F.col("comp") != F.col("top")).drop("top")
    ordered = large.repartitionByRange("tile", "apart", "n", "set_id").sortWithinPartitions("tile", "apart", "n", "set_id")
    large = written(ordered.mapInArrow(_blocks(BLOCK, BLOCK_ELEMENTS), "tile long, set_id long, comp long, n long, bits binary, apart boolean, block long").drop("apart"), "ngram_blocks")
    ranges = written(large.groupBy("tile", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c"), F.max("comp").alias("d")), "ngram_ranges")
    x, y = (ranges.select("tile", *[F.col(c).alias(f"{p}_{c}") for c in ("block", "lo", "hi", "c", "d")]) for p in "xy")
    meet = f"x_block <= y_block and 100 * x_hi >= {percent} * y_lo and 100 * y_hi >= {percent} * x_lo and not (x_c = x_d and y_c = y_d and x_c = y_c)"
    sides = x.join(y, "tile").where(meet).select("tile", F.explode(F.array_distinct(F.array("x_block", "y_block"))).alias("block"), "x_block", "y_block")
    pieces = large.join(sides, ["tile", "block"]).withColumn("tile", F.xxhash64("tile", "x_block", "y_block")).select(*members.columns, "block")
    return small.unionByName(pieces)


class Linker:
    """Links between sets that share tiles. tiles: tile, set_id; sets: set_id, n, bits, shingles."""

    def __init__(self, tiles: DataFrame, sets: DataFrame, percent: int):
        self.tiles, self.sets, self.percent = tiles, sets, percent
        self.total = tiles.count()

    def mixed(self, comp: DataFrame | None, turn: int) -> DataFrame:
        """tile, set_id, comp, pivot (by turns another member): of tiles that hold members of different components. Components
        only grow, so from now on no other tiles are read."""
        named = self.tiles.select("tile", "set_id", F.col("set_id").alias("comp"))
        if comp is not None:
            named = named.drop("comp").join(comp, F.col("set_id") == F.col("node"), "left").select("tile", "set_id", F.coalesce("root", "set_id").alias("comp"))
            named = written(named, "ngram_named")
        pivot = F.struct(F.xxhash64("comp", F.lit(turn)).alias("order"), F.col("comp").alias("other"), F.col("set_id").alias("b"))
        groups = named.groupBy("tile").agg(F.min(pivot).alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
        groups = written(groups.where("low <> high").drop("low", "high"), "ngram_pivots")
        live = _hot_join(named, groups, "tile", "size", "set_id", self.total).where("size is not null").drop("size")
        live = written(live, "ngram_live")
        discard(self.tiles, named, groups)
        self.tiles, self.total = live, live.count()
        return live

    def hooks(self, comp: DataFrame | None, turn: int) -> DataFrame:
        """a, b: each set and one pivot of its tiles, a member of another component."""
        near = self.mixed(comp, turn).where("comp <> pivot.other")
        return near.groupBy(F.col("set_id").alias("a")).agg(F.min("pivot").alias("pivot")).select("a", "pivot.b")

    def between(self, comp: DataFrame | None) -> DataFrame:
        """Links (a, b) between different components that connect what all links of the tiles connect.

        Bitmaps tell which members of each tile may have a link to another component. Those come again with their
        shingles, and each tile connects its members by exact checks: one pass, however near to the threshold they are.
        """
        live = self.mixed(comp, 0).select("tile", "set_id", "comp")
        members = written(live.join(self.sets.select("set_id", "n", "bits"), "set_id").select("tile", "set_id", "comp", "n", "bits"), "ngram_members")
        big = members.groupBy("tile").agg(F.count("*").alias("size"), F.sum("n").alias("elements")).where((F.col("size") > BLOCK) | (F.col("elements") > BLOCK_ELEMENTS))
        big = written(big.select("tile"), "ngram_big")
        tiled = blocked(members, big, big.count(), self.percent).select("tile", "set_id", "comp", "n", "block", "bits")
        tiled = tiled.repartition("tile").sortWithinPartitions("tile", "set_id")
        chosen = written(tiled.mapInArrow(_tile_members(self.percent), "tile long, set_id long, comp long, block long"), "ngram_chosen")
        discard(members, big, live)
        full = chosen.join(self.sets.select("set_id", "n", "shingles"), "set_id").select("tile", "set_id", "comp", "n", "block", "shingles")
        full = full.repartition("tile").sortWithinPartitions("tile", "set_id")
        found = written(full.mapInArrow(_tile_links(self.percent), "a long, b long").distinct(), "ngram_links")
        discard(chosen)
        return found

    def exact(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: by whole bitmaps, then by intersecting sorted arrays.

        Each set a is sent to its partner b; a partner of many is sent once for every part of them, to different tasks.
        """
        one, two = (self.sets.select(F.col("set_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
        allowed = pairs.join(one, "a").join(two, "b").select("a", "a_n", "a_bits", "b", "b_n", "b_bits")
        allowed = written(allowed.mapInArrow(_by_bits(self.percent), "a long, b long, part long"), "ngram_allowed")
        n = allowed.count()
        if not n:
            return allowed.select("a", "b")
        full = self.sets.select("set_id", "shingles")
        here = lambda left, key: full.join(bounded_broadcast(left, n, MAX_BROADCAST_IDS), F.col("set_id") == F.col(key))
        members = here(allowed, "a").select("b", "part", "a", "shingles")
        pivots = here(allowed.select("b", "part").distinct(), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "shingles")
        rows = members.union(pivots).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        links_ = written(rows.mapInArrow(_against_pivot(self.percent), "a long, b long"), "ngram_links")
        discard(allowed)
        return links_


def similar_sets(tiles: DataFrame, sets: DataFrame, percent: int, turns: int = 6) -> DataFrame | None:
    """node, root: components of sets by links. None without any link.

    First every set is checked against one pivot of its tiles, by turns while that joins many, and what links becomes
    one component: a large group of near copies is joined by as many checks as it has members. Then only tiles with
    members of different components matter, and each connects its own by exact checks, so that no link between
    components is missed.
    """
    linker = Linker(tiles, sets, percent)
    comp, n = None, sets.count()
    for turn in range(turns):
        found = linker.exact(linker.hooks(comp, turn))
        k = found.count()
        if not k:
            break
        comp = _merged(comp, found)
        if 100 * k < n:
            break
    found = linker.between(comp)
    return _merged(comp, found) if found.limit(1).count() else comp


def linked_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """For docs (row, doc_id, text): its rows (row, doc_id, n, set_id), the classes of equal sets (set_id, rep, row,
    copies), and components of linked sets (node, root) or None.

    docs is read three times and must give the same rows each time, as a table does.
    """
    rows = written(docs.mapInArrow(_set_rows(words), "row long, doc_id long, n long, set_id long, check long"), "ngram_rows")
    total = rows.agg(F.sum("n")).first()[0]
    low = [F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.count("*").alias("copies"), F.min("check").alias("c0"), F.max("check").alias("c1")]
    classes = written(rows.where("n > 0").groupBy("set_id").agg(*low), "ngram_classes")
    clash = [r[0] for r in classes.where("c0 <> c1").select("set_id").limit(MAX_SHARED + 1).collect()]
    if len(clash) > MAX_SHARED:
        raise RuntimeError(f"over {MAX_SHARED} names of sets are shared by unlike sets")
    shared = frozenset(clash)
    if shared:
        rows = rows.withColumn("set_id", F.when(F.col("set_id").isin(clash) & (F.col("n") > 0), F.col("set_id").bitwiseXOR(F.col("check"))).otherwise(F.col("set_id")))
        classes = written(rows.where("n > 0").groupBy("set_id").agg(*low), "ngram_classes")
    rows, classes = rows.drop("check"), classes.drop("c0", "c1")
    if not total:
        return rows, classes, None
    tiles = tile_table(docs.select("text"), int(total), words, percent, shared)
    wanted = written(classes.join(tiles.select("set_id").distinct(), "set_id", "left_semi").select("row", "set_id"), "ngram_wanted")
    n = wanted.count()
    # all columns are read, as for rows: with others, a plan that deals rows out by their values would number them anew
    texts = docs.join(bounded_broadcast(wanted, n, MAX_BROADCAST_IDS), "row")
    sets = written(texts.mapInArrow(_full_sets(words, shared), "set_id long, n long, bits binary, shingles binary"), "ngram_sets")
    comp = similar_sets(tiles, sets, percent) if n else None
    discard(tiles, sets, wanted)
    return rows, classes, comp


def ngram_jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents link when the Jaccard similarity of their sets of distinct shingles is percent / 100 or more. Equal
    sets are one class, told by 128 bits of sums over the set; only one set per class goes on. Sets that may link share
    a signature, which makes a tile. Bitmaps, whose width follows the set's size, bound the overlap of two members from
    above; pairs they allow are checked by intersecting sorted arrays. See similar_sets() for the order of the
    checks: no link between components is lost, and a large group of copies costs about as much as its members,
    not their pairs.

    Null and empty texts have no shingles and link with nothing. Rows that repeat an id stand for their texts each;
    a null id is named by the smallest other id of its component, or stays null. Empty tables give empty results;
    other columns are not read. docs is read several times: let it be a table or another plan that gives the same
    rows in the same order whenever it is read.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, sets, comp = linked_sets(narrow, words, percent)
    total = rows.count()
    classes = sets.select(F.hex("set_id").alias("g"), "rep", "copies")
    if comp is not None:
        of = written(sets.join(comp, F.col("set_id") == F.col("node"), "left").select("set_id", "rep", "copies", F.coalesce("root", "set_id").alias("root")), "ngram_named")
        low = written(of.groupBy("root").agg(F.min("rep").alias("low"), F.count("*").alias("size")), "ngram_low")
        classes = _hot_join(of, low, "root", "size", "set_id", total).select(F.hex("set_id").alias("g"), F.col("low").alias("rep"), "copies")
    classes = written(classes, "ngram_named")
    keyed = rows.drop("row").withColumn("g", F.when(F.col("n") > 0, F.hex("set_id")).otherwise(F.concat(F.lit("empty "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    out = attach_groups(keyed, classes, "g", "copies", total, F.concat(F.lit("row "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("component_id"))


def is_table(df: DataFrame) -> bool:
    """Whether df is a table of files as it was read: then its rows have the same partitions and places whenever it is read."""
    return df._jdf.queryExecution().optimizedPlan().toString().startswith("Relation [")


def first_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null ids come last), of rows with one id that of the
    lowest row key. Rows that link with nothing all stay, whatever their ids, and so do rows without words.

    A verdict holds for a row, by its place in the table, and not for all that share its id; docs that aren't a table as it
    was read are written first, for another plan may number its rows anew. Texts are not shuffled while the rows that go are within the bound of a broadcast. Columns of any name pass through; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = "_row"
    while key in docs.columns:
        key = "_" + key
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    if not is_table(docs):
        keyed = written(keyed, "ngram_keyed")
    narrow = keyed.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, sets, comp = linked_sets(narrow, words, percent)
    rows = rows.where("n > 0")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("low")
    kept = rows.groupBy("set_id").agg(order)
    if comp is not None:
        kept = kept.join(comp, F.col("set_id") == F.col("node"), "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("low").alias("low"))
    gone = written(rows.select("row").join(kept.select(F.col("low.row").alias("row")), "row", "left_anti").select(F.col("row").alias("_gone")), "ngram_gone")
    gone = bounded_broadcast(gone, gone.count(), MAX_BROADCAST_IDS)
    return keyed.join(gone, F.col(key) == F.col("_gone"), "left_anti").drop(key)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""
