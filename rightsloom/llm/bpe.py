"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small, tokenizer_path
from .token_counts import counter

#: A chunk ends where so many high bits of the rolling hash over the last 32 bytes are 0 (once in 512 bytes), wherever in a
#: word that is, but has this many bytes at least.
CUT_BITS, LEAST = 9, 64
#: Characters of chunks that a worker remembers, in each of two generations (with their ids about twice as many bytes).
MEMO = 4_000_000
#: Pre-tokens that a worker remembers.
MEMO_PRE_TOKENS = 200_000
#: Characters of the right chunk that a join reads at first; of a chunk, those among which its first pre-tokens are noted.
WINDOW, HEAD = 48, 40
#: Text before a join up to which it is encoded anew with each window; longer text waits for white space, or the end.
WAITING = 4096

#: Stands for the end of a chunk among ids.
END_ID = 0xFFFFFFFF
END = END_ID.to_bytes(4, "little")

_GEAR = np.random.default_rng(20240901).integers(0, 2**32, 256, dtype=np.uint32)
_WHITE = " \n\t\r"


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte a gear hash of the last 32 bytes: sum of table[byte] << distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += moved
    return h


class Chunk:
    """A chunk encoded by itself: ids, where its first pre-tokens start (character: byte among the ids), and where the
    text after its last white space starts, in both."""

    __slots__ = ("text", "ids", "heads", "tail", "tail_at")

    def __init__(self, text: str, ids: bytes, heads: dict[int, int], tail_at: int):
        self.text, self.ids, self.heads, self.tail, self.tail_at = text, ids, heads, after_white(text), tail_at


def after_white(text: str) -> int:
    """Where the text after the last white space starts; 0 without any."""
    return max(map(text.rfind, _WHITE)) + 1


class ChunkEncoder:
    """Encodes texts as the library does with add_special_tokens=False, decodes as its decode() without decoder.

    Texts are cut where a rolling hash says so, also within words; the same passage gives the same chunks in whatever
    document it stands, and a chunk is encoded once per worker while it is remembered. Then joins are repaired, see
    joined().
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.library.id_to_token(i) for i in range(size)]
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = 0
        self.rules = counter(path)
        pattern = self.rules.split.__self__.pattern
        self.split = re.compile(pattern + "|\0").findall
        self.matches = re.compile(pattern).finditer
        self.pre_tokens: dict[str, bytes] = {"\0": END}
        self.looked_up = self.encoded = self.joins = self.repaired = 0

    @staticmethod
    def _value(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False) with a file without decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    # ---- chunks

    def chunks(self, text: str) -> list[str]:
        """The text cut at characters where the hash of the bytes before is 0, not within what normalises together."""
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
        if not len(cuts):
            return [text] if text else []
        if len(raw) != len(text):
            first = (data & 0xC0) != 0x80
            cuts = cuts[np.append(first, True)[cuts]]
            at = np.append(np.cumsum(first) - 1, len(text))[cuts]
        else:
            at = cuts
        plain = not self.rules.unsafe.search(text)
        out, start, begin = [], 0, 0
        for byte, cut in zip(cuts.tolist(), at.tolist(), strict=True):
            if byte - begin >= LEAST and cut < len(text) and (plain or self._stable(text, cut)):
                out.append(text[start:cut])
                start, begin = cut, byte
        out.append(text[start:])
        return out

    @staticmethod
    def _stable(text: str, cut: int) -> bool:
        """Normalising both sides alone is normalising them together."""
        a, b = text[max(0, cut - 32) : cut], text[cut : cut + 32]
        nfc = unicodedata.normalize
        return nfc("NFC", a + b) == nfc("NFC", a) + nfc("NFC", b)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers."""
        whole: dict[int, bytes] = {}
        parts, found, missing = [], {}, {}
        for k, t in enumerate(texts):
            if "<|" in t and any(s in t for s in self.specials):  # special strings are never cut
                whole[k] = self._value(self.library.encode(t, add_special_tokens=False).ids)
                parts.append([])
                continue
            own = self.chunks(t)
            parts.append(own)
            self.looked_up += len(own)
            for c in own:
                if c not in found:
                    chunk = self.young.get(c)
                    if chunk is None and (chunk := self.old.get(c)) is not None:
                        self._remember(chunk)
                    if chunk is None:
                        missing[c] = None
                    found[c] = chunk
        self.encoded += len(missing)
        for chunk in self._encoded(list(missing)):
            found[chunk.text] = chunk
            self._remember(chunk)
        return [whole[k] if k in whole else self.joined([found[c] for c in own]) for k, own in enumerate(parts)]

    def _remember(self, chunk: Chunk) -> None:
        if self.held > MEMO:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[chunk.text] = chunk
        self.held += len(chunk.text)

    def _encoded(self, texts: list[str]) -> Iterator[Chunk]:
        """New chunks: pre-tokens of plain texts are merged once per worker as well, other chunks go to the library."""
        unsafe = self.rules.unsafe.search
        plain = []
        for t in texts:
            if unsafe(t):
                ids, starts = self._spans(t)
                tail = after_white(t)
                heads = {p: at for p, at in starts if p <= HEAD}  # a character may start two pre-tokens: the last counts
                yield Chunk(t, ids, heads, next((at for p, at in starts if p >= tail), len(ids)))
            else:
                plain.append(t)
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            low = [t.lower() for t in some]
            pieces = self.split("\0".join(low))
            values = self._values(pieces)
            start = 0
            for t, lowered in zip(some, low, strict=True):
                try:
                    end = pieces.index("\0", start)
                except ValueError:
                    end = len(pieces)
                own = values[start:end]
                ids = b"".join(own)
                rest = self.split(lowered[after_white(t) :])
                tail_at = len(ids) - sum(map(len, own[len(own) - len(rest) :]))
                yield Chunk(t, ids, self._heads(lowered, own), tail_at)
                start = end + 1

    def _heads(self, lowered: str, values: list[bytes]) -> dict[int, int]:
        """Of the pre-tokens that start in the first characters: where, and how many bytes of ids come before. The text
        read ends WINDOW characters on: a start is right if the match before ended three characters before that."""
        heads, at, ended = {}, 0, 0
        for m, v in zip(self.matches(lowered, 0, WINDOW), values):  # noqa: B905
            if m.start() > HEAD or (ended > WINDOW - 3 and len(lowered) > WINDOW):
                break
            heads[m.start()] = at
            at += len(v)
            ended = m.end()
        return heads

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens of plain texts."""
        known = self.pre_tokens
        values = list(map(known.get, pieces))
        if None in values:
            fresh = list(dict.fromkeys([p for p, v in zip(pieces, values, strict=True) if v is None]))
            found = dict(zip(fresh, self._batch(fresh), strict=True))
            values = [found[p] if v is None else v for p, v in zip(pieces, values, strict=True)]
            if len(known) > MEMO_PRE_TOKENS:
                known.clear()
                known["\0"] = END
            known.update((p, v) for p, v in found.items() if len(p) <= 64)
        return values

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Texts go to the library many at a time, with a special token between that none of them contains."""
        out = []
        mark = self.specials[0]
        mark_id = self.library.token_to_id(mark)
        groups = [texts[i : i + 256] for i in range(0, len(texts), 256)]
        found = self.library.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            flat = np.asarray(e.ids, "<u4")
            raw, ends = flat.tobytes(), [*np.flatnonzero(flat == mark_id).tolist(), len(flat)]
            start = 0
            for _, end in zip(group, ends, strict=True):
                out.append(raw[4 * start : 4 * end])
                start = end + 1
        return out

    def _spans(self, text: str) -> tuple[bytes, list[tuple[int, int]]]:
        """Ids, and at which character and byte of the ids each pre-token starts."""
        if not self.rules.unsafe.search(text):
            low = text.lower()
            values = self._values(self.split(low))
            starts, at = [], 0
            for m, v in zip(self.matches(low), values, strict=True):
                starts.append((m.start(), at))
                at += len(v)
            return b"".join(values), starts
        e = self.library.encode(text, add_special_tokens=False)
        starts, before = [], None
        for i, (word, span) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word != before:
                starts.append((span[0], 4 * i))
            before = word
        return self._value(e.ids), starts

    # ---- joins

    def joined(self, chunks: list[Chunk]) -> bytes:
        """Ids of the chunks' joined text.

        White space belongs to no pre-token, ends every match of the pre-tokenizer, composes with nothing and stands
        in no special string: a chunk's ids are right up to its last white space, whatever follows, and a join at white
        space is right as it is. At other joins the text from there on is encoded anew with the beginning of the next
        chunk. Where that window and the next chunk's own ids start a pre-token at the same character, well inside
        the window (the pre-tokenizer reads two characters beyond a match at most), they agree for good. Without
        such a place the window grows: to the next chunk's last white space, or on through chunks that have none.
        """
        if not chunks:
            return b""
        out: list[bytes] = []
        cur, from_, place = chunks[0], 0, 0  # cur is right from that byte and character on
        left: str | None = None  # text that waits for an agreement, in place of cur
        for right in chunks[1:]:
            self.joins += 1
            white = right.text[0] in _WHITE
            if left is None:
                if white or cur.tail == len(cur.text):
                    out.append(cur.ids[from_:])
                    cur, from_, place = right, 0, 0
                    continue
                keep, left = (cur.tail_at, cur.text[cur.tail :]) if cur.tail > place else (from_, cur.text[place:])
                out.append(cur.ids[from_:keep])
            elif white:
                out.append(self._spans(left)[0])
                cur, from_, place, left = right, 0, 0, None
                continue
            self.repaired += 1
            if len(left) <= WAITING:
                ids, starts = self._spans(left + right.text[:WINDOW])
                shift, most = len(left), WINDOW - 3 if len(right.text) > WINDOW else WINDOW
                at = next(((p - shift, k) for p, k in dict(starts).items() if 0 <= p - shift <= most and p - shift in right.heads), None)
                if at is not None:
                    out.append(ids[: at[1]])
                    cur, from_, place, left = right, right.heads[at[0]], at[0], None
                    continue
            if right.tail:
                out.append(self._spans(left + right.text[: right.tail])[0])
                cur, from_, place, left = right, right.tail_at, right.tail, None
            else:
                left += right.text
        out.append(cur.ids[from_:] if left is None else self._spans(left)[0])
        return b"".join(out)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _encoded(docs: DataFrame, path: str | None, id_col: str, text_col: str, digests: bool) -> DataFrame:
    prepare(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in small(batches):
            found = own.encode([t or "" for t in batch.column("text").to_pylist()])
            n = pa.array([len(i) // 4 for i in found], pa.int64())
            if digests:
                columns = [pa.array([hashlib.sha256(i).hexdigest() for i in found]), pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in found])]
                names = ["ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in found], pa.list_(pa.int32())), pa.array([own.decode(i) for i in found])]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *columns], ["doc_id", "n_tokens", *names])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, decoded, exactly as the library gives them for the whole text.

    Null counts as empty: no ids, '' decoded. Texts may be of any length, with or without white space. Repeated rows
    and null ids are answered row by row; empty tables give empty results; other columns are not read.
    """
    return _encoded(docs, path, id_col, text_col, digests=False)


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode() with SHA-256 digests in place of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _encoded(docs, path, id_col, text_col, digests=True)
