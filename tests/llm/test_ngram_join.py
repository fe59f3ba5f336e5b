"""The n-gram join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rightsloom.llm import ngram_join as nj

from .conftest import prose


def plain_set(t, k=4):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain_components(rows, k=4, percent=85):
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_join(docs, rows, empty):
    got = Counter(tuple(r) for r in nj.ngram_jaccard_join(docs).collect())
    assert got == plain_components([(i, t) for i, t, _ in rows])
    assert nj.ngram_jaccard_join(empty).count() == 0


def hot_rows(n=260):
    """Copies of one text, each changed in a place of its own, and copies of those: links and near misses."""
    r = random.Random(8)
    base = prose(r, 120).split(" ")
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"w{r.random()}"
        rows.append((i, " ".join(words)))
    return rows + [(1000 + i, prose(r, 90)) for i in range(40)]


@pytest.mark.parametrize(("words", "percent"), [(5, 80), (3, 95)])
def test_other_words_and_similarity(spark, words, percent):
    rows = hot_rows(120)
    got = Counter(tuple(r) for r in nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect())
    assert got == plain_components(rows, words, percent)


@pytest.mark.parametrize("block", [2048, 16])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = hot_rows()
    got = Counter(tuple(r) for r in nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_components(rows)


def test_parts_that_are_mostly_empty(spark, monkeypatch):
    """Sets with fewer parts than they may differ in meet by what they both lack."""
    monkeypatch.setattr(nj, "parts_of", lambda level, percent: 400)
    rows = hot_rows(60)
    got = Counter(tuple(r) for r in nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_components(rows)
    r = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**64, 60, dtype=np.uint64))
        b = np.concatenate([a[4:], r.integers(0, 2**64, 4, dtype=np.uint64)])
        assert len(np.intersect1d(nj.signatures(a, 80), nj.signatures(np.unique(b), 80)))


@pytest.mark.parametrize(("hot", "held", "bucket"), [(4, 4096, 1 << 20), (1 << 30, 8, 16), (4, 8, 16)])
def test_hot_signatures_are_split(spark, monkeypatch, hot, held, bucket):
    """Pieces of a tile from the tasks, and members that a bucket's task doesn't hold."""
    for name, value in (("HOT_IN_TASK", hot), ("HELD", held), ("BUCKET", bucket)):
        monkeypatch.setattr(nj, name, value)
    rows = hot_rows(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in nj.ngram_jaccard_join(docs).collect()) == plain_components(rows)


def test_names_that_unlike_sets_share(spark, monkeypatch):
    real = nj.set_id
    monkeypatch.setattr(nj, "set_id", lambda u: real(u) % 5 if len(u) else 0)
    monkeypatch.setattr(nj, "prepare", lambda spark: None)
    rows = hot_rows(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = nj.linked_sets(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), 4, 85)
    sets = {frozenset(plain_set(t)) for _, t in rows}
    assert tables[1].count() == len(sets)


def test_long_unlike_sets_are_told_apart_by_bits():
    """Sets of 5000 shingles: partners pass, unlike ones and near misses don't, so that no shingles are sent for them."""
    r = np.random.default_rng(9)
    base = np.unique(r.integers(0, 2**64, 5000, dtype=np.uint64))
    rows = []
    for changed in (100, 500, 800, 1000, 5000):  # the last but one has Jaccard 0.67
        other = np.unique(np.concatenate([base[changed:], r.integers(0, 2**64, changed, dtype=np.uint64)]))
        x, y = (np.frombuffer(nj.bitmap(u, nj.width(len(u))), np.uint64) for u in (base, other))
        rows.append((nj.links(base, other, 80), bool(nj.may_link(len(base), len(other), x, y, 80))))
    assert rows == [(True, True), (True, True), (False, False), (False, False), (False, False)]


def test_many_near_copies_cost_their_number(spark):
    """5,000 near copies of one text: checks in proportion to the members, not to their pairs."""
    r = random.Random(3)
    base = prose(r, 200).split()
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(5_000) for k in [r.randrange(len(base))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    pairs = []
    real = nj.Linker.exact
    nj.Linker.exact = lambda self, p: (lambda w: (pairs.append(w.count()), real(self, w))[1])(nj.written(p, "counted"))
    try:
        out = nj.ngram_jaccard_join(docs)
        assert out.where("component_id <> 0").count() == 0 and out.count() == 5_000
    finally:
        nj.Linker.exact = real
    assert sum(pairs) <= 4 * len(rows)


def test_group_of_unequal_near_copies_is_joined_once(spark, monkeypatch):
    """Copies changed in few or many places, with many pairs just below the threshold: their tiles' members meet once, whatever fails there."""
    r = random.Random(12)
    base = prose(r, 150).split()
    rows = []
    for i in range(400):
        words = list(base)
        for k in r.sample(range(len(words)), r.randint(1, 9)):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    names = []
    real = nj.written
    monkeypatch.setattr(nj, "written", lambda df, name: (names.append(name), real(df, name))[1])
    monkeypatch.setattr(nj, "FEW_PAIRS", 0, raising=False)
    got = Counter(tuple(x) for x in nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_components(rows)
    assert names.count("ngram_members") == 1


@pytest.mark.parametrize("percent", [80, 85, 90])
@pytest.mark.parametrize("size", [1, 2, 6, 7, 20, 54, 55, 63, 64, 75, 76, 110, 127, 128, 150, 400, 1500, 6000])
def test_similar_sets_share_a_signature(size, percent):
    r = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        drop = r.integers(0, (100 - percent) * size // 100 + 1)
        add = r.integers(0, max(0, (100 * (len(a) - drop) - percent * len(a)) // percent) + 1)
        b = np.unique(np.concatenate([r.choice(a, len(a) - drop, replace=False), r.integers(0, 2**64, add, dtype=np.uint64)]))
        if not nj.links(a, b, percent):
            continue
        if not np.array_equal(a, b):
            assert len(np.intersect1d(nj.signatures(a, percent), nj.signatures(b, percent)))
        x, y = (np.frombuffer(nj.bitmap(u), np.uint64)[None] for u in (a, b))
        assert nj.may_link(np.array([len(a)]), np.array([len(b)]), x, y, percent)[0]


@pytest.mark.parametrize("at_once", [1_000_000, 9])
def test_components_of_chains_and_rings(spark, monkeypatch, at_once):
    monkeypatch.setattr(nj, "EDGES", at_once)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 140), (140, 120), (120, 100)] + [(500 + i, 500) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 140: 100, 120: 100} | {500 + i: 500 for i in range(30)}


def test_stage_keeps_one_of_each(docs, rows):
    """By rows: of each component the first by (id, null last), and every row that links with nothing."""
    out = nj.first_of_each(docs)
    assert out.schema == docs.schema
    texts = [t for _, t, _ in rows]
    numbered = [(i, t) for i, t in enumerate(texts)]
    root = {d: c for (d, _, c) in plain_components(numbered)}
    best = {}
    for i, (d, _, _) in enumerate(rows):
        best.setdefault(root[i], []).append((d is None, d or 0, i))
    want = Counter((rows[i][0], texts[i]) for _, _, i in (min(v) for v in best.values()))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert Counter(d for d, _ in got.elements()) == Counter(d for d, _ in want.elements())
    assert Counter(t for d, t in got.elements() if d is not None) == Counter(t for d, t in want.elements() if d is not None)


def test_stage_counts_rows_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [
        (1, text("a")), (None, text("a")), (None, text("b")), (None, ""), (None, None),  # a null id that links, one that doesn't, two without words
        (2, text("c")), (5, text("c")), (5, text("d")),  # one text of an id is a copy, the other is not
        (6, text("e")), (6, text("e")), (None, text("f")), (None, text("f")), (None, text("f")),  # whole rows that repeat, copies without any id
        (9, text("g")), (8, text("g") + " more"), (8, text("g")), (None, text("g")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("own")).repartition(3)
    out = nj.first_of_each(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) if r.text is None or "gword" not in r.text else r.doc_id for r in out.collect())
    assert got == Counter([(1, text("a")), (None, text("b")), (None, ""), (None, None), (2, text("c")), (5, text("d")), (6, text("e")), (None, text("f")), 8])


def test_components_that_still_change_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(nj, "EDGES", 4)
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        nj.components(chain, rounds=1)


def test_tables_as_read_need_no_copy(spark, docs, monkeypatch):
    """A table of many files keeps its rows' places between reads of different columns; other plans are written first."""
    names = []
    real = nj.written
    monkeypatch.setattr(nj, "written", lambda df, name: (names.append(name), real(df, name))[1])
    assert nj.is_table(docs) and not nj.is_table(docs.repartition(2)) and not nj.is_table(docs.where("doc_id > 3"))
    from_table = Counter(tuple(r) for r in nj.first_of_each(docs).collect())
    assert "ngram_keyed" not in names
    assert Counter(r.doc_id for r in nj.first_of_each(docs.repartition(2)).collect()) == Counter(r[0] for r in from_table.elements()) and "ngram_keyed" in names
