"""Line dedup: sharded cuckoo filters over the frequent lines, backed by exact reference-count tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach_groups, prepare, small, written

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Keys per filter shard, on average: a shard is built by one task.
SHARD_KEYS = 500_000
#: Filters travel to every worker up to this size; larger ones stay sharded and lines go to them by shuffle.
MAX_FILTER_BYTES = 64 << 20
MAX_EXCEPTIONS = 1_000_000
SLOTS = 4


# ---- keys

def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line without white space at its ends and with A-Z in lower case; None for short ones."""
    key = line.strip().lower()
    if not key or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _as_pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return a[:, 0], a[:, 1]


def _reference_batches(min_chars: int, sign: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2048):
            counts: dict[bytes, int] = {}
            for text in (t.as_py() for t in batch.column("text")):
                for key in {line_key(x, min_chars) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")}:
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
            if counts:
                hi, lo = _as_pairs(list(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts)) * sign
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(n)], ["hi", "lo", "n"])

    return run


def references(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, sign: int = 1) -> DataFrame:
    """hi, lo, n: in how many rows of docs each line key stands. Counted per some thousand rows, per task, then by key."""
    prepare(docs.sparkSession)
    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_reference_batches(min_chars, sign), "hi long, lo long, n long")
    return part.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


# ---- cuckoo filter

def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Cuckoo:
    """Cuckoo filter with 32-bit fingerprints and four slots a bucket: keys can be inserted and deleted.

    The other bucket of a fingerprint is its bucket xor a hash of it, so both are known without the key.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85))))))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> Cuckoo:
        table = np.frombuffer(b, np.uint32).reshape(-1, SLOTS)
        return cls(len(table), table.copy())

    def _places(self, hi: np.ndarray, lo: np.ndarray):
        print_ = (_mix(hi) >> np.uint64(32)).astype(np.uint32)
        print_[print_ == 0] = 1
        one = _mix(lo) & self.mask
        return print_, one.astype(np.int64), self._other(one.astype(np.int64), print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ _mix(print_.astype(np.uint64))) & self.mask).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hi, lo)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray, tries: int = 500) -> bool:
        """All keys, in rounds: each round places what fits, a bucket taking one key a round, and moves others on. False if full."""
        p, at, other = self._places(hi, lo)
        rng = np.random.default_rng(7)
        if not len(p):
            return True
        for turn in range(tries):
            _, first = np.unique(at, return_index=True)
            free = self.table[at[first]] == 0
            can = free.any(1)
            who = first[can]
            self.table[at[who], free[can].argmax(1)] = p[who]
            left = np.ones(len(p), bool)
            left[who] = False
            p, at, other = p[left], at[left], other[left]
            if not len(p):
                return True
            if turn % 4 < 3:
                at, other = other, at
                continue
            _, first = np.unique(at, return_index=True)
            who = first[(self.table[at[first]] != 0).all(1)]
            slot = rng.integers(0, SLOTS, len(who))
            out = self.table[at[who], slot].copy()
            self.table[at[who], slot] = p[who]
            p[who], other[who] = out, at[who]
            at[who] = self._other(at[who], out)
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Keys that were inserted; one fingerprint each goes."""
        for p, a, b in zip(*self._places(hi, lo), strict=True):
            for bucket in (a, b):
                slot = np.flatnonzero(self.table[bucket] == p)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


def build_filter(hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
    size = len(hi)
    while True:
        c = Cuckoo.for_keys(size)
        if c.insert(hi, lo):
            return c
        size *= 2


# ---- index

def _shards_for(keys: int) -> int:
    return 1 + keys // SHARD_KEYS


def shard_of(hi, shards: int):
    """Shard by the key's first half; numpy's mod gives the same."""
    return F.pmod(hi, F.lit(shards)).cast("int")


class LineIndex:
    """Reference counts of line keys, and cuckoo filters of those found in at least min_documents rows.

    insert() and delete() take documents and give a new index: counts are added or taken back exactly, keys that
    reach the threshold enter their shard's filter, keys that fall below leave it. Deleting what was inserted
    gives back the former counts and answers; deleting lines that the index lacks is an error. When the frequent keys
    need twice as many shards, the filters are built anew from the exact table. Tables are written to the shared
    folder; an index is never changed.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, min_documents: int, min_chars: int):
        self.counts, self.filters, self.shards, self.min_documents, self.min_chars = counts, filters, shards, min_documents, min_chars

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> LineIndex:
        counts = written(references(docs, text_col, min_chars), "line_counts")
        shards = _shards_for(counts.where(F.col("n") >= min_documents).count())
        empty = docs.sparkSession.createDataFrame([], "shard int, filter binary")
        index = cls(counts, empty, shards, min_documents, min_chars)
        index.filters = written(index._changed(counts.select("hi", "lo", F.lit(0).cast("long").alias("old"), "n"), empty), "line_filters")
        return index

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> LineIndex:
        return cls.build(spark.createDataFrame([], "text string"), **options)

    def _changed(self, changes: DataFrame, filters: DataFrame) -> DataFrame:
        """Filters after keys went from old to n references."""
        least = self.min_documents
        crossed = changes.where(((F.col("old") < least) & (F.col("n") >= least)) | ((F.col("old") >= least) & (F.col("n") < least)))
        crossed = crossed.select(shard_of(F.col("hi"), self.shards).alias("shard"), "hi", "lo", (F.col("n") >= least).alias("enters"))

        def renew(key, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            c = Cuckoo.from_bytes(old["filter"].iloc[0]) if len(old) else None
            enters = keys["enters"].to_numpy(bool)
            hi, lo = keys["hi"].to_numpy(np.int64), keys["lo"].to_numpy(np.int64)
            if c is not None:
                c.delete(hi[~enters], lo[~enters])
                if not c.insert(hi[enters], lo[enters]):
                    return pd.DataFrame({"shard": [key[0]], "filter": [b""]})  # full: built anew from the exact table
            else:
                c = build_filter(hi[enters], lo[enters])
            return pd.DataFrame({"shard": [key[0]], "filter": [c.to_bytes()]})

        prepare(self.counts.sparkSession)
        return crossed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(renew, "shard int, filter binary")

    def _with(self, docs: DataFrame, sign: int, text_col: str) -> LineIndex:
        delta = references(docs, text_col, self.min_chars, sign).withColumnRenamed("n", "d")
        merged = self.counts.withColumnRenamed("n", "o").join(delta, ["hi", "lo"], "full")
        old, d = F.coalesce("o", F.lit(0).cast("long")), F.coalesce("d", F.lit(0).cast("long"))
        merged = written(merged.select("hi", "lo", old.alias("old"), (old + d).alias("n")), "line_changes")
        if merged.where("n < 0").limit(1).count():
            raise ValueError("documents to delete aren't all in the index")
        new = LineIndex(merged.where("n > 0").select("hi", "lo", "n"), self.filters, self.shards, self.min_documents, self.min_chars)
        needed = _shards_for(new.frequent().count())
        grown = needed >= 2 * self.shards
        if grown:  # shards stay within twice the keys that one task builds
            new.shards = needed
        filters = None if grown else written(new._changed(merged, self.filters), "line_filters")
        if grown or filters.where(F.length("filter") == 0).limit(1).count():
            every = merged.where(F.col("n") > 0).select("hi", "lo", F.lit(0).cast("long").alias("old"), "n")
            filters = written(new._changed(every, self.filters.where("false")), "line_filters")
        new.filters = filters
        return new

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._with(docs, 1, text_col)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._with(docs, -1, text_col)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_documents).select("hi", "lo")

    def apply(self, docs: DataFrame, text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
        """docs with three more columns: _n_lines, _n_dropped, _kept (the text without the frequent lines).

        With filters within a size bound (checked here), workers get them: a line that its filter lacks stays, a
        line that it holds goes, but for the exceptions: counted keys below the threshold that a filter holds all
        the same. Those are found by running the whole exact table through the filters. Texts are not shuffled.
        Beyond the bound the lines go to the exact table by shuffle, and each document gets its own list back.
        """
        prepare(docs.sparkSession)
        schema = _plus(docs)
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= max_filter_bytes:
            shards: list[bytes | None] = [None] * self.shards
            for r in self.filters.collect():  # within max_filter_bytes
                shards[r["shard"]] = bytes(r["filter"])
            sc = docs.sparkSession.sparkContext
            held = sc.broadcast(shards)
            rest = self.counts.where(F.col("n") < self.min_documents).select("hi", "lo")
            wrong = written(rest.mapInArrow(_held_batches(held), "hi long, lo long"), "line_exceptions")
            if wrong.count() <= MAX_EXCEPTIONS:
                found = wrong.toPandas().sort_values("hi")  # within MAX_EXCEPTIONS, 16 bytes each
                keys = sc.broadcast((found["hi"].to_numpy(np.int64), found["lo"].to_numpy(np.int64)))
                return docs.mapInArrow(_dropping(text_col, self.min_chars, held, keys), schema)
        return self._apply_by_shuffle(docs, text_col, schema)

    def _apply_by_shuffle(self, docs: DataFrame, text_col: str, schema) -> DataFrame:
        """Equal texts are looked up once. Keys and texts with over a thousandth of all rows don't go to one task, see attach_groups()."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        keyed = docs.withColumn("_doc", F.sha2(text, 256))
        texts = written(keyed.groupBy("_doc").agg(F.first(text).alias("text"), F.count("*").alias("size")), "line_texts")
        lines = written(texts.select("_doc", "text").mapInArrow(_line_batches(self.min_chars), "_doc string, hi long, lo long"), "line_places")
        lines = lines.select("_doc", F.struct("hi", "lo").alias("key"))
        frequent = written(self.counts.where(F.col("n") >= self.min_documents).select(F.struct("hi", "lo").alias("key"), "n"), "line_frequent")
        spread = F.struct(F.xxhash64("_doc", "key").alias("hi"), F.xxhash64("key", "_doc").alias("lo"))
        known = attach_groups(lines, frequent, "key", "n", lines.count(), spread).where("n is not null")
        lists = known.groupBy("_doc").agg(F.collect_set("key").alias("_drop"))  # no more than the lines of one text
        found = written(texts.select("_doc", "size").join(lists, "_doc"), "line_lists")
        with_lists = attach_groups(keyed, found, "_doc", "size", docs.count(), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
        return with_lists.drop("_doc", "size").mapInArrow(_dropping(text_col, self.min_chars, None, None), schema)


def _plus(docs: DataFrame):
    return T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType()), T.StructField("_kept", T.StringType())])


_filters: dict = {}


def _opened(held) -> list[Cuckoo | None]:
    """The filters of a broadcast, opened once per worker."""
    value = held.value
    if _filters.get("of") is not value:
        _filters["of"] = value
        _filters["opened"] = [None if b is None else Cuckoo(len(b) // (4 * SLOTS), np.frombuffer(b, np.uint32).reshape(-1, SLOTS)) for b in value]
    return _filters["opened"]


def _holds(filters: list, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    found = np.zeros(len(hi), bool)
    shard = np.mod(hi, len(filters))
    for s, f in enumerate(filters):
        if f is not None:
            own = np.flatnonzero(shard == s) if len(filters) > 1 else slice(None)
            found[own] = f.contains(hi[own], lo[own])
    return found


def _held_batches(held):
    def run(batches):
        filters = _opened(held)
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo"))
            yield batch.filter(pa.array(_holds(filters, hi, lo)))

    return run


def _line_batches(min_chars: int):
    def run(batches):
        for batch in small(batches):
            docs, keys = [], []
            for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {k for x in text.encode("utf-8", "surrogatepass").split(b"\n") if (k := line_key(x, min_chars)) is not None}
                docs += [doc] * len(own)
                keys += own
            if keys:
                hi, lo = _as_pairs(keys)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(hi), pa.array(lo)], ["_doc", "hi", "lo"])

    return run


def _dropping(text_col: str, min_chars: int, held, exceptions):
    """Appends line counts and the kept text; drops lines by filters and exceptions, or by each row's own _drop list."""

    def run(batches):
        filters = _opened(held) if held is not None else None
        wrong_hi, wrong_lo = exceptions.value if exceptions is not None else (np.zeros(0, np.int64),) * 2
        run_of = int(np.unique(wrong_hi, return_counts=True)[1].max(initial=0))  # exceptions with one first half: one, but for chance
        for batch in small(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text_col).to_pylist()]
            lines = [t.split(b"\n") for t in texts]
            keys = [line_key(x, min_chars) for own in lines for x in own]
            known = [k for k in keys if k is not None]
            if filters is not None:
                drop = np.zeros(len(keys), bool)
                if known:
                    hi, lo = _as_pairs(known)
                    hit = _holds(filters, hi, lo)
                    at = np.searchsorted(wrong_hi, hi)
                    for k in range(run_of):
                        near = np.minimum(at + k, len(wrong_hi) - 1)
                        hit &= (wrong_hi[near] != hi) | (wrong_lo[near] != lo)
                    drop[np.fromiter((k is not None for k in keys), bool, len(keys))] = hit
                drop = drop.tolist()
            else:
                lists = [frozenset((x["hi"], x["lo"]) for x in own or ()) for own in batch.column("_drop").to_pylist()]
                drop, i = [], 0
                for own, gone in zip(lines, lists, strict=True):
                    for k in keys[i : i + len(own)]:
                        drop.append(bool(gone) and k is not None and tuple(np.frombuffer(k, "<i8").tolist()) in gone)
                    i += len(own)
            n_lines, n_dropped, kept, i = [], [], [], 0
            for own, text in zip(lines, texts, strict=True):
                gone = drop[i : i + len(own)]
                i += len(own)
                n = sum(gone)
                n_lines.append(len(own))
                n_dropped.append(n)
                kept.append((text if not n else b"\n".join(x for x, g in zip(own, gone, strict=True) if not g)).decode("utf-8", "surrogatepass"))
            columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema) if f.name != "_drop" or filters is not None}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*columns, "_n_lines", "_n_dropped", "_kept"])

    return run


def line_dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    A line whose key stands in at least min_documents rows goes from every row; others stay in order. Each row is a
    document of its own, also if it repeats an id or is null; a line that a row repeats counts once for that row.
    Null or empty texts are one empty line, which has no key and stays. Empty tables give empty results; other
    columns are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = LineIndex.build(narrow, "text", min_documents, min_chars)
    out = index.apply(narrow, "text", max_filter_bytes)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"), F.col("_kept").alias("kept_text"))


def deduplicated_documents(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with all columns and rows, text without its frequent lines, n_chars (if there) counted anew.

    Null texts become empty ones. Rows that repeat are documents of their own, ids aren't read, columns of any name pass
    through, and an empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = LineIndex.build(whole, "text", min_documents, min_chars).apply(whole, "text")
    kind = docs.schema
    columns = {c: F.col("whole").getField(c) for c in docs.columns} | {text_col: F.col("_kept").cast(kind[text_col].dataType)}
    if chars_col in docs.columns:
        columns[chars_col] = F.length("_kept").cast(kind[chars_col].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.r, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM j GROUP BY r)
SELECT d.doc_id, a.n_lines, a.n_dropped, sha256(a.t) AS kept_sha256 FROM d JOIN a USING (r)
"""
