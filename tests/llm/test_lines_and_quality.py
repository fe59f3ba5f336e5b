"""Quality rules and line dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rightsloom.llm import line_dedup, quality

from .conftest import prose

WHITE = " \t\n\r\x0b\x0c"


def split(t):
    return [w for w in "".join("\n" if c in WHITE else c for c in t or "").split("\n") if w]


def plain_base(t):
    words, t = split(t), t or ""
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_base_figures(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    assert got == Counter((i, *plain_base(t)) for i, t, _ in rows)
    assert quality.quality_rules(empty).count() == 0
    assert all(not (r.base_failed and r.kept) for r in quality.quality_rules(docs).collect())


def test_repeats_with_many_distinct_words():
    r = np.random.default_rng(1)
    words = [b"w%d" % i for i in r.integers(0, 40, 3000)]
    text = b" ".join(words).decode()
    assert quality.repeated_words(words) == plain_base(text)[4]


GOOD = "The quick brown fox jumps over the lazy dog, and then it rests for a while in the sun. " * 2


@pytest.mark.parametrize(
    "line,rule",
    [
        ("Home | About | Contact | Login | Search", "navigation"), ("buy### now&&& and$$$ save*** much%%%", "symbols"), ("BUY!! IT!! NOW!! OR!! NOT!!", "punctuation"),
        ("We use cookies to improve this site.", "boilerplate"), ("home about contact login", "navigation"), ("THIS IS ALL IN CAPITAL LETTERS AND SHOUTS AT YOU.", "capitals"), (GOOD, None), ("A title", None),
    ],
)
def test_line_rules(line, rule):
    assert quality.line_fails(line, len(line.split())) == rule


def test_documents_go_when_lines_take_too_much(spark):
    good = prose(random.Random(2), 144)
    bad = good + "\n" + "\n".join(f"pay{i}### off{i}&&& it{i}$$$ now{i}*** for{i}%%% me{i}### too{i}###" for i in range(30))
    df = spark.createDataFrame([(1, good, 5), (2, bad, 5), (3, None, 5), (4, good + "\nClick here", 5)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in quality.cleaned_documents(df).collect()}
    assert set(got) == {1, 4} and got[4].text == good and got[4].n_chars == len(good)


def plain_lines(rows, least):
    keys = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    count = Counter(k for _, t, _ in rows for k in {keys(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count.get(keys(x), 0) < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("least,most_bytes", [(10, 1 << 20), (3, 1 << 20), (3, 0)])
def test_line_dedup(docs, rows, empty, least, most_bytes):
    got = Counter(tuple(r)[:4] for r in line_dedup.line_dedup(docs, least, max_filter_bytes=most_bytes).collect())
    assert got == plain_lines(rows, least)
    assert line_dedup.line_dedup(empty, least, max_filter_bytes=most_bytes).count() == 0


def test_index_is_reversible(docs, rows):
    key = lambda index: ({(r.hi, r.lo): r.n for r in index.counts.collect()}, {(r.hi, r.lo) for r in index.frequent().collect()})
    one, two = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 or doc_id is null")
    first = line_dedup.LineIndex.build(one, min_documents=3)
    both = first.insert(two)
    assert key(both) == key(line_dedup.LineIndex.build(docs, min_documents=3))
    back = both.delete(two)
    assert key(back) == key(first)
    answers = lambda index: Counter((r.doc_id, r._kept) for r in index.apply(docs).collect())
    assert answers(back) == answers(first) and answers(both) == answers(line_dedup.LineIndex.build(docs, min_documents=3)) != answers(first)


def test_cuckoo_filter_holds_and_forgets():
    r = np.random.default_rng(3)
    hi, lo = r.integers(-(2**63), 2**63, (2, 50_000))
    c = line_dedup.build_filter(hi, lo)
    assert c.contains(hi, lo).all()
    other = r.integers(-(2**63), 2**63, (2, 50_000))
    assert c.contains(*other).sum() < 10
    c.delete(hi[:5000], lo[:5000])
    assert c.contains(hi[5000:], lo[5000:]).all() and c.contains(hi[:5000], lo[:5000]).sum() < 10
    assert line_dedup.Cuckoo.from_bytes(c.to_bytes()).contains(hi[5000:], lo[5000:]).all()


def test_exceptions_keep_lines_that_a_filter_holds_wrongly(spark, monkeypatch):
    """With all fingerprints equal every known line hits; only the exact table tells them apart."""
    real = line_dedup.Cuckoo._places

    def blunt(self, hi, lo):
        p, a, _ = real(self, hi, lo)
        return p * 0 + 1, a * 0, a * 0 + 1

    monkeypatch.setattr(line_dedup.Cuckoo, "_places", blunt)
    f = line_dedup.Cuckoo(4)
    f.table[0, 0] = 1
    assert f.contains(np.array([5]), np.array([6])).all()


def test_stage_keeps_columns(docs):
    out = line_dedup.deduplicated_documents(docs)
    assert out.schema == docs.schema and out.count() == docs.count()


def test_shards_follow_the_keys(spark, monkeypatch):
    """An index that starts empty gets shards as it grows; its answers are those of one built at once."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    docs = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i % 3, 300, 3))) for i in range(30)], "doc_id long, text string")
    empty = line_dedup.LineIndex.empty(spark, min_documents=3)
    grown = empty.insert(docs)
    assert empty.shards == 1 and grown.shards == 7 and grown.filters.count() > 4
    assert sorted(r._kept for r in grown.apply(docs).collect()) == sorted(r._kept for r in line_dedup.LineIndex.build(docs, min_documents=3).apply(docs).collect())


def test_deleting_what_is_not_there_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs, min_documents=1)
    with pytest.raises(ValueError, match="aren't all in the index"):
        index.delete(spark.createDataFrame([(2, "b\nc")], "doc_id long, text string"))


def test_large_groups_by_shuffle(spark):
    """One text in most rows, one line in all of them."""
    rows = [(i, "same\ncommon\nown text") if i % 10 else (i, f"common\nrow {i}") for i in range(400)]
    got = Counter((r.doc_id, r.kept_text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 10, max_filter_bytes=0).collect())
    assert got == Counter((i, "" if i % 10 else f"row {i}") for i, _ in rows)


def test_stages_with_columns_of_any_name(spark, docs):
    extra = {c: F.lit("x") for c in ("_n_lines", "_n_dropped", "_kept", "_doc", "_drop", "whole", "text ", "chars", "a.b", "key")}
    named = docs.withColumns(extra)
    for stage in (quality.cleaned_documents, line_dedup.deduplicated_documents):
        out = stage(named)
        assert out.schema.names == named.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in named.schema]
        assert Counter(tuple(r) for r in out.select(*docs.columns).collect()) == Counter(tuple(r) for r in stage(docs).collect())


def test_kept_against_a_plain_reading(docs, rows):
    """The verdict by rules written anew: what a line fails, what a document loses."""

    def fails(line):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        n = len(words)
        bars = sum(w in list("|»›•·>") for w in re.split(r"\s", line))
        if sum(line.count(c) for c in "#*$%&|<>") > 0.3 * n:
            return True
        if len(re.findall("[!?]{2,}", line)) > 0.2 * n or (n >= 25 and not any(c in line for c in ".!?,;:…。！？、，।؟")):
            return True
        if n <= 20 and quality.BOILERPLATE.search(line):
            return True
        if 3 <= n <= 20 and (bars >= 3 or sum(w.strip(".,:|").lower() in quality.NAV_WORDS for w in line.split()) >= 0.7 * n):
            return True
        return n >= 8 and line == line.upper() != line.lower() and sum(c.isalpha() for c in line) >= 20

    want = Counter()
    for i, t, _ in rows:
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        size = lambda x: sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x)))
        bad = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        want[(i, len(words), not bad and sum(size(x) for x in lines if fails(x)) <= 0.4 * size(t or ""))] += 1
    assert Counter((r.doc_id, r.n_words, r.kept) for r in quality.quality_rules(docs).collect()) == want
