"""Tokenizers against the library; models on held-out data."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rightsloom.llm import bpe, secret_scan, token_counts, toxicity
from rightsloom.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_and_counts_equal_the_library(docs, rows, empty, library):
    enc = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows}
    dec = lambda ids: library.decode(ids, skip_special_tokens=False)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(enc[t]), sha(np.asarray(enc[t], "<u4").tobytes()), sha(dec(enc[t]).encode())) for i, t, _ in rows)
    assert Counter(tuple(r) for r in bpe.bpe_digests(docs).collect()) == want
    got = bpe.bpe_encode(docs.limit(20)).collect()
    assert all(r.decoded == dec(r.ids) for r in got)
    counts = Counter((i, len((t or "").encode()), len(enc[t]), len(enc[t]) > 2048) for i, t, _ in rows)
    assert Counter(tuple(r) for r in token_counts.token_counts(docs).collect()) == counts
    assert bpe.bpe_encode(empty).count() == 0 and token_counts.token_counts(empty).count() == 0


@pytest.mark.parametrize("alphabet", ["日本語カナ。、1aé", "ab'relsvt!.12é́", "abcdefgh", "한국어학x", "'rvelst", "ΣσςAİı̇ ", "　日 a'", "🙂áb "])
def test_joins_inside_long_runs(library, alphabet):
    r = random.Random(len(alphabet))
    c = bpe.ChunkEncoder(PATH)
    for size in (60, 700, 700, 700, 3000, 9000):
        text = "".join(r.choice(alphabet) for _ in range(size))
        assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert c.joins > 10


def test_joins_of_documents_are_repaired(spark, library):
    """On the documents of the small table: chunks of hundreds of bytes, many cut within words, some shared by documents."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    c = bpe.ChunkEncoder(PATH)
    got = c.encode(texts)
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.frombuffer(g, "<u4").tolist() == w.ids for g, w in zip(got, want, strict=True))
    size = sum(len(t.encode()) for t in texts) / c.looked_up
    assert 300 < size < 800 and c.repaired > 1000 and c.joins > 2 * c.repaired - c.joins // 2 and c.encoded < c.looked_up
    owners = Counter(x for t in texts for x in set(c.chunks(t)))
    assert sum(n > 1 for n in owners.values()) > 50


def test_chunks_are_reused():
    c = bpe.ChunkEncoder(PATH)
    text = "some words stand here again and again " * 50
    a = c.encode([text])
    done = c.encoded
    assert c.encode([text, text]) == a * 2 and c.encoded == done


def test_whole_tokens_are_proven(library):
    c = token_counts.counter(PATH)
    words = random.Random(2).sample(sorted(c.cost.proven), 500)
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in words)


def plain_spans(text):
    kinds = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("[0-9a-f]+", 0, lambda m: len(m[0]) >= 24)]
    found = [(m.start(), k, m.end()) for k, (p, flags, ok) in enumerate(kinds) for m in re.finditer(p, text or "", flags) if ok(m)]
    return sorted(found)


def test_secrets_base(docs, rows, empty, spark):
    extra = [(i, s) for i, s in enumerate(["Token: abcdef", "TOKEN='abc'", 'é api_key = "xYz-12.3=" apikey=aaaaaa', "0" * 23, "f" * 24 + "AKIA" + "Z" * 16, "secret:=aaaaaaa", "passſword=aaaaaaa", None])]
    names = ("assign", "access", "hex")
    for df, have in ((docs, [(i, t) for i, t, _ in rows]), (spark.createDataFrame(extra, "doc_id long, text string"), extra)):
        want = Counter()
        for i, t in have:
            s = plain_spans(t)
            joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
            want[(i, *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())] += 1
        got = secret_scan.secret_scan(df).collect()
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert secret_scan.secret_scan(empty).count() == 0


def test_secret_network_on_findings_it_never_saw():
    m = secret_scan.trained()
    x, y = secret_scan.labelled_findings(3000, 991)
    called = m.scores(secret_scan.windows(x)) >= m.threshold
    assert called[y == 1].mean() >= 0.97 and called[y == 0].mean() <= 0.02


def test_secret_model_adds_spans(spark):
    key = "q9ZxT2vB7nLw4KcR8mYp3HsD6fGj1AaE"
    df = spark.createDataFrame([(1, f"export credential={key}"), (2, "see www.someplace12.example.org/path for more")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(df).collect()}
    assert got[1].n_model == 1 and f"model:7:{7 + len('credential=') + len(key)}" in got[1].spans and got[2].spans == ""


def labelled(n, seed):
    r = random.Random(seed)
    bad = ["idiot", "moron", "scum", "trash"]
    neutral = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 7 == 0
        words = [r.choice(neutral) for _ in range(60)] + [r.choice(bad) for _ in range(r.randint(1, 6) if toxic else 0)]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rows = labelled(1200, 5)
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 700] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(texts, labels).collect()}
    held = [(got[i], y, t) for i, t, y in rows if i >= 700]
    assert sum(g.toxic == bool(y) for g, y, _ in held) / len(held) >= 0.99
    hits = lambda t: sum(t.split().count(w) for w in ("idiot", "moron", "scum", "trash"))
    many, few = [g.severity for g, y, t in held if hits(t) >= 5], [g.severity for g, y, t in held if hits(t) == 1]
    assert np.mean(many) > np.mean(few) > 0.3 and all(0 <= g.severity <= 3 for g in got.values())
    assert toxicity.toxicity(docs, labels).count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0
    assert not any(r.toxic for r in toxicity.toxicity(texts, labels.where("toxic = 0")).collect())


def test_ordinal_gradient():
    """Weights and cuts found are a stationary point of the likelihood, by finite differences."""
    r = np.random.default_rng(0)
    x = toxicity.Sparse([r.choice(6, 3, replace=False) for _ in range(300)], 6)
    grade = np.clip((x.dot(np.array([2.0, 1, 0, 0, -1, -2])) + r.logistic(size=300)).round().astype(int), 0, 3)
    w, cuts = toxicity.fit_ordinal(x, grade, steps=3000, l1=0.0, rate=0.02)

    def loss(w, cuts):
        f = np.concatenate([np.zeros((300, 1)), 1 / (1 + np.exp(-(cuts - x.dot(w)[:, None]))), np.ones((300, 1))], 1)
        return -np.log(f[np.arange(300), grade + 1] - f[np.arange(300), grade]).mean()

    base = loss(w, cuts)
    assert (np.diff(cuts) > 0).all()
    for i in range(6):
        assert loss(w + 0.05 * np.eye(6)[i], cuts) > base - 1e-5 and loss(w - 0.05 * np.eye(6)[i], cuts) > base - 1e-5


def test_secrets_late_in_long_runs(spark):
    key = "q7RtZ2mKx9LbVw4NcH8sJd3P"
    texts = [f"curl https://hooks.slack.com/services/T00000000/B00000000/{key}", f"set com.example.payments.production.gateway.client.credential={key}", "see /usr/share/doc/packages/" + "library/manual/" * 8 + f"{key}/index here"]
    got = secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_model for r in got] == [1, 1, 1]
    m = secret_scan.trained()
    x, y = secret_scan.long_findings(1000, 993)
    called = secret_scan.probabilities(m, [f[:3] for f in x]) >= m.threshold
    assert called[y == 1].mean() > 0.95 and called[y == 0].mean() < 0.05


def test_scores_against_a_plain_reading(spark, docs, rows):
    """Probability, severity and verdict of every row from the model's weights, word by word."""
    made = labelled(500, 8)
    texts = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")
    m = toxicity.train(texts, labels)
    want = Counter()
    for i, t in [(i, t) for i, t, _ in made] + [(None if i is None else i + 10_000, t) for i, t, _ in rows]:
        eta = sum(m.weights.get(w, 0.0) for w in {w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w})
        p = [1 / (1 + math.exp(-(eta - c))) for c in m.cuts]
        want[(i, round(p[0], 6), round(sum(p), 6), p[0] >= m.threshold)] += 1
    got = toxicity.toxicity(texts, labels).collect()
    assert Counter((r.doc_id, round(r.p_toxic, 6), round(r.severity, 6), r.toxic) for r in got) == want
    assert list(m.cuts) == sorted(m.cuts) and any(r.toxic for r in got)


def test_training_rows_are_bounded(spark):
    """Ids that repeat don't multiply the rows, and neither do long texts the bytes."""
    rows = [(i % 3, f"word{i} text of {'idiot' if i % 2 else 'friend'} and more words") for i in range(900)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity._best_threshold
    toxicity._best_threshold = lambda p, y: (seen.append(len(y)), real(p, y))[1]
    try:
        toxicity.train(texts, labels, max_rows=300)
        toxicity.train(texts, labels, max_rows=900, max_bytes=8 * 8 * 400)
    finally:
        toxicity._best_threshold = real
    assert all(n <= 400 for n in seen)


def independent_secrets(n, seed):
    """Findings in prose, settings and code by a generator that shares nothing with the training one: (text, start, end)."""
    r = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    s = lambda k, a=alphabet: "".join(r.choice(a) for _ in range(k))
    forms = [
        lambda: "glpat-" + s(20), lambda: "npm_" + s(36), lambda: "SG." + s(22) + "." + s(43), lambda: s(40, alphabet + "/+"), lambda: "dop_v1_" + s(64, "0123456789abcdef"), lambda: "pypi-" + s(60),
        lambda: "key-" + s(32, "0123456789abcdef"), lambda: s(32), lambda: s(24, alphabet[:52]), lambda: "xapp-1-" + s(11, alphabet[26:52]) + "-" + s(12, "0123456789") + "-" + s(40, "0123456789abcdef"), lambda: s(43) + "=", lambda: "hf_" + s(34, alphabet[:52]),
    ]
    places = [
        ("deploy with DEPLOY_AUTH=", " before the job"), ("  credentials: ", "\n  region: eu"), ("curl -H 'X-Auth: ", "' https://api.example.net"), ("I pasted my key ", " in the chat by mistake."), ('const k = "', '";'), ("login machine host account me value ", "\n"),
    ]
    out = []
    for i in range(n):
        before, after = r.choice(places)
        key = forms[i % len(forms)]()
        lead = "Some words come first, then it says:\n" + before
        out.append((lead + key + after, len(lead), len(lead) + len(key)))
    return out


def test_recall_on_independent_secrets(spark):
    """Recall of 0.9 or more where the base finds nothing, and few spans in the clean documents of the small table."""
    found = independent_secrets(600, 4)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(found)], "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in secret_scan.secret_scan(df).collect()}
    hit = [any(a < e and s < b for a, b in got[i]) for i, (_, s, e) in enumerate(found)]
    assert sum(hit) >= 0.9 * len(hit)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = secret_scan.secret_scan(docs).agg(F.sum("n_model")).first()[0]
    assert extra <= 0.02 * docs.count()


def test_many_assignments_in_one_text():
    """Spans and runs are merged in one pass: eight times the text costs some eight times the time."""
    import time

    took = []
    for n in (2000, 16_000):
        text = "\n".join(f"token = abcdef{i:08d}xyz and path/some{i}/file{i}name" for i in range(n))
        began = time.process_time()
        base, more = secret_scan.candidates(text)
        took.append(time.process_time() - began)
        assert len(base) == n and len(more) == n
    assert took[1] < 30 * took[0] + 0.2
