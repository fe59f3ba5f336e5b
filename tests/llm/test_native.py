"""Exact dedup, mixing and license scans: against plain Python and SQL, on odd texts, and on an empty table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rightsloom.llm import common, exact_dedup, licenses, mixing
from rightsloom.llm.common import attach_groups


def same(df, con, query):
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    cursor = con.execute(query)
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    want = sorted((tuple(r[order.index(c)] for c in names) for r in cursor.fetchall()), key=str)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if all(isinstance(v, (int, float)) for v in a) else a == b


def groups_of(rows):
    by = defaultdict(list)
    for i, t, _ in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return by


def check_dedup(found, rows):
    by = groups_of(rows)
    want = Counter()
    for t, ids in by.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter(tuple(r) for r in found) == want


def test_dedup(docs, rows, empty):
    check_dedup(exact_dedup.exact_dedup(docs).collect(), rows)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_dedup_survives_collisions(docs, rows):
    """With four hash values in all, only the comparison of bytes tells texts apart."""
    weak = lambda c: F.unhex(F.lpad(F.conv(F.substring(F.md5(c), 1, 1), 16, 4), 2, "0").substr(1, 1).cast("string"))
    check_dedup(exact_dedup.exact_dedup(docs, hash_fn=weak).collect(), rows)


def test_hot_groups_are_joined_in_both_ways(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("g"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    out = attach_groups(rows, groups, "g", "n", 5000, F.concat(F.lit("row "), "doc_id"))
    want = {r.g: (r.n, r.low) for r in groups.collect()}
    got = out.collect()
    assert len(got) == 5000 and all((r.n, r.low) == want[r.g] for r in got)


def plain_targets(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Shares by weight; what is above a cap is dealt again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(cap * sizes[s] for s in names if s not in free)
        target = {s: (rest * w[s] / sum(w[x] for x in free)) if s in free else cap * sizes[s] for s in names}
        over = {s for s in free if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        free -= over


def test_mix(docs, rows, empty, sql):
    out = mixing.mix(docs)
    got = out.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    taken = defaultdict(int)
    by_size = {v: s for s, v in sizes.items()}
    for r in got:
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[by_size[r.source_size]] += r.taken
        assert r.target == pytest.approx(target[by_size[r.source_size]])
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * 260
    assert Counter(mixing.mix(docs).collect()) == Counter(got)
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("text = ''")).count() == sum(t == "" for _, t, _ in rows)
    same(out.drop("rate"), sql[1], mixing.ORACLE)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, None: 9000}, {"x": 7}, {"a": 0, "b": 50}])
def test_targets_water_fill(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.token_targets(df).collect()}
    want = plain_targets(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_newton_solves_the_dual(spark):
    """Rates vary with the size, meet every target, and no other rates that do are closer to the documents as they are."""
    sizes = [(s, n, c) for s in ("low", "high", "same", "all") for n, c in ((0, 3), (1, 40), (30, 20), (400, 5), (9000, 2))]
    own = sum(n * c for _, n, c in sizes[:5])
    targets = {"low": own * 0.11, "high": own * 2.9, "same": own * 1.0, "all": own * 3.0}
    df = spark.createDataFrame(sizes, "source string, size long, n long")
    sources = spark.createDataFrame([(s, own, float(t)) for s, t in targets.items()], "source string, source_size long, target double")
    plan = mixing.newton_dual(df, sources, 3)
    rows = df.join(plan, "source").withColumn("rate", mixing.rate_of(F.col("size"), F.col("multiplier"), F.col("scale"), 3)).collect()
    for s, t in targets.items():
        mine = [r for r in rows if r.source == s]
        assert sum(r.n * r.size * r.rate for r in mine) == pytest.approx(t, rel=1e-8)
        assert all(0 <= r.rate <= 3 for r in mine)
    rates = {(r.source, r["size"]): r.rate for r in rows}
    assert rates["low", 9000] < rates["low", 400] < rates["low", 30] < rates["low", 0] == pytest.approx(1)
    assert rates["high", 9000] > rates["high", 30] > 1 and rates["same", 400] == pytest.approx(1) and rates["all", 1] == 3

    def distance(p):  # relative entropy to a third, by place
        return sum(n * (x * math.log(x * 3) + (1 - x) * math.log((1 - x) * 1.5)) for x, n in p)

    mine = {r["size"]: (r.rate / 3, r.n) for r in rows if r.source == "low" and r["size"]}
    for a, b in ((9000, 400), (400, 30), (30, 1)):
        for by in (1e-4, -1e-4):  # words moved from one size to another
            other = dict(mine)
            other[a] = (mine[a][0] + by / (a * mine[a][1]), mine[a][1])
            other[b] = (mine[b][0] - by / (b * mine[b][1]), mine[b][1])
            assert distance(other.values()) >= distance(mine.values()) - 1e-12


def test_mix_of_columns_with_the_same_names(spark, docs):
    extra = {c: F.lit(1) for c in ("_size", "_source", "_key", "_copies", "_copy", "_rate", "_whole", "a.b", "rate")}
    named = docs.withColumns(extra)
    out = mixing.mixed_documents(named)
    assert out.columns == named.columns and out.count() == mixing.mixed_documents(docs).count()


def test_mixed_documents_match_the_plan(docs):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_licenses(docs, empty, sql):
    same(licenses.license_scan(docs), sql[1], licenses.oracle())
    assert licenses.license_scan(empty).count() == 0


def test_license_phrases_across_lines_and_templates(spark):
    df = spark.createDataFrame([(1, "x ALL\nrights-reserved; cc by cc by"), (2, "under the Apache License version 2 licensed"), (3, "no license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (3, 1, 6, "cc-by,reserved")
    assert got[2].labels == "apache-2.0" and 0.8 <= got[2].score < 1 and got[3].labels == "" and got[3].score == 0


def test_license_notices_wrapped_over_lines(spark):
    wrapped = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the",
        "bsd": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted",
        "lgpl": "under the terms of the GNU Lesser General Public License as\npublished by the Free Software Foundation",
        "": "the MIT\n" + "other words " * 30 + "\nreleased under a license",
    }
    rows = [(i, "x y\n" + text + "\nz") for i, text in enumerate(wrapped.values())]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [",".join(x for x in got[i].labels.split(",") if x != "gpl") for i in range(5)] == list(wrapped)
    assert got[0].n_blocks == 1 and got[0].score == 1.0 and got[4].n_blocks == 0


def test_wrapped_and_scattered_licenses(spark):
    """Notices broken over lines and behind comment signs are found; their words scattered over a long line are not."""
    mit = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and\n# associated documentation files (the Software)"
    bsd = " * Redistribution and use in source and binary forms, with or without\n *\n * modification, are permitted provided that the following conditions\n * are met:"
    words = licenses.template_words(dict(licenses.TEMPLATES[3:4])["mit"])
    scattered = " ".join(f"{w} one two three four" for w in words)
    rows = [(1, "x = 1\n\n" + mit), (2, bsd), (3, scattered), (4, "before " * 500 + mit.replace("\n# ", " ") + " after" * 700), (5, "free of charge\n" * 40)]
    got = {r.doc_id: (r.labels, r.n_blocks) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1), 2: ("bsd", 1), 3: ("", 0), 4: ("mit", 1), 5: ("", 0)}


def test_long_texts_come_in_small_arrow_batches(spark):
    """Four megabytes or so at a time, however many rows; a session's own size stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        common.prepare(spark)
        docs = spark.range(300, numPartitions=1).selectExpr("repeat('x', 100000) AS text")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) >= 30_000_000 and max(r.n for r in sizes) < 8_000_000
        spark.conf.set(key, "1m")
        common.prepare(spark)
        assert spark.conf.get(key) in ("1m", "1048576b")
    finally:
        spark.conf.set(key, before)
