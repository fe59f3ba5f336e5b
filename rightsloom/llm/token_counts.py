"""Token counts by the whole-token shortcut: pre-tokens proven to be one token are counted, only the rest is merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small, tokenizer_path

LIMIT = 2048
#: Merged pre-tokens that a worker remembers (about 100 bytes each).
MEMO = 300_000
#: Texts that the shortcut reads by itself: ASCII without control characters but tab and line ends, and Latin letters and
#: signs that normalise to themselves. Whatever else occurs, the library reads the whole text.
_SAFE_RANGES = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x12F), (0x132, 0x148), (0x14A, 0x17E))
#: Signs of typesetting that are safe as well.
_SAFE_SIGNS = "–—‘’“”…€"
_SUFFIXES = r"'s|'t|'re|'ve|'m|'ll|'d"


class Counter:
    """Exact token counts of texts as the library gives them, for a word-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        safe = "".join(chr(c) for a, b in _SAFE_RANGES for c in range(a, b + 1)) + _SAFE_SIGNS
        letters, numbers = self._classes(safe)
        self.unsafe = re.compile(f"[^{re.escape(safe)}]")
        white = r"\t\n\r \0"  # a zero is no safe character; encoders put it between texts
        l, n = re.escape("".join(letters)), re.escape("".join(numbers))
        self.split = re.compile(f"{_SUFFIXES}|[{l}]+|[{n}]|[^{white}{l}{n}]+").findall
        self.cost = _Costs(self.library, self.prove(safe))

    def _classes(self, safe: str) -> tuple[list[str], list[str]]:
        """Letters and numbers among safe characters, as the library itself splits them."""
        pre = self.library.pre_tokenizer.pre_tokenize_str
        letters, numbers = [], []
        for c in {x for c in safe for x in (c, c.lower())}:
            if not c.strip("\t\n\r "):
                continue
            if len(pre(f"{c}{c}")) == 2:
                numbers.append(c)
            elif len(pre(f"a{c}")) == 1:
                letters.append(c)
        return letters, numbers

    def prove(self, safe: str) -> frozenset[str]:
        """Vocabulary strings that stand alone as pre-tokens and that the library encodes as that one token."""

        back = {c: i for i, c in enumerate(_byte_alphabet())}
        known = set(safe)
        candidates = []
        for piece in self.library.get_vocab():
            if piece.endswith("</w>") and all(c in back for c in piece[:-4]):
                try:
                    word = bytes(back[c] for c in piece[:-4]).decode()
                except UnicodeDecodeError:
                    continue
                if word and word == word.lower() and set(word) <= known and self.split(word) == [word]:
                    candidates.append((word, self.library.token_to_id(piece)))
        found = self.library.encode_batch_fast([w for w, _ in candidates], add_special_tokens=False)
        return frozenset(w for (w, i), e in zip(candidates, found, strict=True) if e.ids == [i])

    def count(self, texts: list[str]) -> list[int]:
        out, slow = [0] * len(texts), []
        costs, split, unsafe, specials = self.cost, self.split, self.unsafe.search, self.specials
        for i, t in enumerate(texts):
            if unsafe(t) or any(s in t for s in specials):
                slow.append(i)
            else:
                out[i] = sum(map(costs.__getitem__, split(t.lower())))
        for i in range(0, len(slow), 64):
            some = slow[i : i + 64]
            for k, e in zip(some, self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = len(e.ids)
        return out


class _Costs(dict):
    """Tokens of a pre-token: 1 for the proven ones; others are merged by the library and remembered, up to a number."""

    def __init__(self, library, proven):
        super().__init__(dict.fromkeys(proven, 1))
        self.library, self.proven = library, proven

    def __missing__(self, pre_token: str) -> int:
        n = len(self.library.encode(pre_token, add_special_tokens=False).ids)
        if len(self) >= len(self.proven) + MEMO:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        if len(pre_token) <= 64:
            self[pre_token] = n
        return n


def _byte_alphabet() -> list[str]:
    """Characters for bytes in byte-level vocabularies: printable bytes are themselves, the others follow 255 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens (the library's, without added tokens), over_limit.

    Null counts as empty: no bytes, no tokens. Whole texts are read however long. Repeated rows and null ids are
    answered row by row; empty tables give empty results; other columns are not read. Each worker proves the
    vocabulary's whole tokens once, and holds a bounded memo of merged pre-tokens.
    """
    prepare(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = own.count(texts)
            size = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
