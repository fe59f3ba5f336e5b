"""The pipeline against its stages in plain Python."""

import hashlib
from collections import Counter

import numpy as np

from rightsloom.llm import mixing
from rightsloom.llm.common import tokenizer_path
from rightsloom.llm.quality import assess

from .conftest import COLUMNS, corpus, rows_of
from .test_ngram_join import plain_components


def test_run(spark, tmp_path):
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [(*r[:1], f"{r[1]}\nShared line of all.", *r[2:]) if r[1] and i % 2 else r for i, r in enumerate(rows_of(corpus(9, 40))) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [(r[0], assess(r[1])["clean_text"], r[3]) for r in rows if assess(r[1])["kept"]]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    count = Counter(k for _, t, _ in kept for k in {key(x) for x in t.split("\n")} if k)
    kept = [(i, "\n".join(x for x in t.split("\n") if count.get(key(x), 0) < 10), s) for i, t, s in kept]
    keep = {d for d, _, c in plain_components([(i, t) for i, t, _ in kept], 5, 80) if d == c}
    kept = [r for r in kept if r[0] in keep]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall()}
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        if copies[i]:
            want[(i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] = copies[i]
    assert got == want and len(kept) > 10 and len(keep) < len(rows)


def test_stages_keep_columns_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    df = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == empty.columns and df.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
