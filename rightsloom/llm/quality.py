"""Quality rules, line first: lines failing a rule go, documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, small

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document may lose this part of its word characters to line rules.
MAX_LOST = 0.4

#: Words of menus; a short line made mostly of them is navigation.
NAV_WORDS = frozenset("home about contact login logout register menu search help faq blog news next previous prev back top share follow us terms privacy sitemap careers cart account sign in up".split())
#: Phrases that make a short line boilerplate.
BOILERPLATE = re.compile(
    "(?:use[sd]? (?:of )?cookies|cookie policy|accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|terms (?:of use|and conditions|of service)"
    "|privacy policy|all rights reserved|subscribe (?:to|now)|click here|lorem ipsum|sign up for|read more|share this|follow us on|skip to (?:main )?content)",
    re.I,
)
BOILERPLATE_WORDS = 20
_SEPARATOR = re.compile(r"(?<!\S)[|»›•·>](?!\S)")
_SHOUT = re.compile(r"[!?]{2,}")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_STOP = re.compile("[.!?,;:…。！？、，।؟]")
_ALPHA = re.compile(r"[^\W\d_]")


def line_fails(line: str, n_words: int) -> str | None:
    """The rule that a line with words fails, or None. Each rule sees one line only."""
    if len(_SYMBOL.findall(line)) > 0.3 * n_words:
        return "navigation" if len(_SEPARATOR.findall(line)) >= 3 else "symbols"
    if ("!!" in line or "??" in line or "!?" in line or "?!" in line) and len(_SHOUT.findall(line)) > 0.2 * n_words:
        return "punctuation"
    if n_words >= 25 and not _STOP.search(line):
        return "punctuation"
    if n_words <= BOILERPLATE_WORDS:
        if BOILERPLATE.search(line):
            return "boilerplate"
        if n_words >= 3 and (len(_SEPARATOR.findall(line)) >= 3 or sum(w.strip(".,:|").lower() in NAV_WORDS for w in line.split()) >= 0.7 * n_words):
            return "navigation"
    if n_words >= 8 and line.upper() == line and line.lower() != line and len(_ALPHA.findall(line)) >= 20:
        return "capitals"
    return None


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of so many words that stand twice or more in the text, the first standing included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, v = codes[:n], len(ids)
    for i in range(1, window):
        if int(key.max()) >= 2**62 // (v + 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * v + codes[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # a word is covered if one of the windows that start at it or up to window - 1 before is repeated
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + n] |= twice
    return int(covered.sum())


def assess(text: str | None) -> dict:
    """All figures of one text, and the text without its failing lines."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_bytes = sum(map(len, words))
    word_chars = len(text) - (len(raw) - word_bytes)
    seen: set[str] = set()
    dup = lost = n_failed = 0
    kept_lines = []
    rules = set()
    for line in text.split("\n"):
        b = line.encode("utf-8", "surrogatepass").split()
        if not b:
            kept_lines.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        rule = line_fails(line, len(b))
        if rule:
            rules.add(rule)
            n_failed += 1
            lost += len(b"".join(b).decode("utf-8", "surrogatepass"))
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    n = len(words)
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": dup, "n_repeat_words": repeat,
        "base_failed": base_failed, "n_failed_lines": n_failed, "lost_chars": lost, "rules": ",".join(sorted(rules)),
        "kept": not base_failed and lost <= MAX_LOST * word_chars, "clean_text": "\n".join(kept_lines) if n_failed else text,
    }


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long, rules string"
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ") for f in _FIGURES.split(", ")]
    for batch in small(batches):
        found = [assess(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array([x[n] for x in found], _ARROW[t]) for n, t in names]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *[n for n, _ in names]])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base figures, kept, and what the line rules found.

    A null or empty text has no words and fails the base. Lines without words fail no rule. Each row stands for
    itself: repeated rows give repeated answers, ids may be null, an empty table gives an empty result, other
    columns are not read. Whole texts are read, one row after another, so a task holds one Arrow batch.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_batches, f"doc_id long, {_FIGURES}")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [assess(t) for t in batch.column("text").to_pylist()]
        keep = pa.array([x["kept"] for x in found], pa.bool_())
        clean = [x["clean_text"] for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(clean, pa.string()), pa.array(list(map(len, clean)), pa.int64())], ["whole", "text", "chars"]).filter(keep)


def cleaned_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The kept rows with all their columns; text without its failing lines, n_chars (if there) counted anew.

    Null and empty texts fail the base and go. Each row is judged by itself, whatever its id, so rows that repeat stay
    or go together; columns of any name pass through, and an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    chars = [f for f in docs.schema.fields if f.name == chars_col]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = whole.mapInArrow(_cleaned, T.StructType([*whole.schema.fields, T.StructField("chars", T.LongType())]))
    columns = {c: F.col("whole").getField(c) for c in docs.columns} | {text_col: F.col("text").cast(docs.schema[text_col].dataType)}
    if chars:
        columns[chars_col] = F.col("chars").cast(chars[0].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])
