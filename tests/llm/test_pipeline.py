"""Stages on the small corpus, each held against its operator's rule on its own input."""

import public_tokenizers
import pytest

import corpus_pipeline as p
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_repeats import brute_bytes


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    corpus.write.parquet(f"{d}/documents.parquet")
    corpus.selectExpr("doc_id", "1 as quality", "0 as toxic").filter("doc_id % 2 = 0").write.parquet(f"{d}/labels.parquet")
    leak = corpus.filter("doc_id = 20").first()["text"]
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus, folder):
    docs = p.table(spark, folder, "documents")
    good = p.quality(spark, docs, folder)
    assert good.columns == p.COLUMNS
    near = p.near_duplicates(spark, docs, folder)
    kept = {d for d, _, c in brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80) if d == c}
    assert {r["doc_id"] for r in near.collect()} == kept and near.columns == p.COLUMNS
    cut = {r["doc_id"]: r for r in p.repeated_passages(spark, docs, folder).collect()}
    for d, size, gone, *_ in brute_bytes([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()], 200):
        left = len((cut[d]["text"] or "").encode())
        assert left == size if not gone else left <= size - gone
    clean = {r["doc_id"] for r in p.benchmark_leaks(spark, docs, folder).collect()}
    assert 20 not in clean and len(clean) >= docs.count() - 3
    tokens = p.tokens(spark, docs, folder)
    assert tokens.count() == docs.count() and public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_run_end_to_end(spark, corpus, tmp_path):
    """``run`` over tables with both labels gives what the rules give, one after the other, in plain Python."""
    import hashlib

    import tiktoken

    from tests.llm.test_native import brute as brute_items
    from tuplemill.llm.bpe import load_ranks

    d = str(tmp_path)
    rows = [tuple(r) for r in corpus.collect()]
    junk = [(900 + i, " ".join(["$$$###!!!"] * (20 + i)), "en", "s", 9) for i in range(60)]
    spark.createDataFrame(rows + junk, corpus.schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    marks = [(i, int(i < 900), 0) for i, *_ in rows + junk if i % 5 != 2]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    leak = next(t for i, t, *_ in rows if i == 20)
    items = [(0, leak), (1, "never found anywhere at all in here")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")

    kept = [(r["doc_id"], r["text"]) for r in p.quality(spark, p.table(spark, d, "documents"), d).collect()]
    assert 100 < len(kept) and not any(i >= 900 for i, _ in kept)
    alone = {i for i, _, c in brute_groups(kept, 5, 80) if i == c}
    kept = [(i, t) for i, t in kept if i in alone]
    cut = {i: row for i, *row in brute_bytes([(i, (t or "").encode()) for i, t in kept], 200)}
    texts = {i: None if cut[i][1] else (t or "").encode() for i, t in kept}
    stage = {r["doc_id"]: r["text"] for r in p.repeated_passages(spark, spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in kept], corpus.schema), d).collect()}
    for i, raw in texts.items():
        assert raw is None or (stage[i] or "").encode() == raw
    bad = {i for i, *_ in brute_items(list(stage.items()), items)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in stage.items():
        if i not in bad:
            ids = theirs.encode_ordinary(t or "")
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in p.run(spark, d).collect()}
    assert got == want and 20 not in got
