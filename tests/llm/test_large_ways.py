"""The ways beyond size checks: shuffle joins for large tables, pairs of blocks for large buckets."""

import random

from tessera.llm import near_dup, store

from .test_operators import brute_components, brute_hits, corpus, frame, prose


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(store, "SMALL_ROWS", -1)
    r = random.Random(19)
    base, out = prose(110, r).split(), []
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"other{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    found = near_dup.near_duplicates(spark, frame(spark, out)).collect()
    assert {tuple(x) for x in found} == brute_components(out)


def test_contamination_without_broadcast(spark, monkeypatch):
    from tessera.llm.decontaminate import contamination

    monkeypatch.setattr(store, "SMALL_ROWS", -1)
    monkeypatch.setattr(store, "BITS", 1 << 15)  # nearly every place passes the bitmap
    rows = corpus()
    items = [(1, rows[0][1][30:220]), (2, "one two"), (3, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in contamination(spark, frame(spark, rows), bench).collect())
    assert got == brute_hits(rows, items)


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps and drops what its operator says, judged on its own input."""
    import corpus_pipeline as pipeline

    r = random.Random(7)
    rows = [(d, t) for d, t in corpus() if d is not None]
    rows = list({d: (d, t) for d, t in rows}.values()) + [(100 + i, prose(40, r)) for i in range(30)]
    spark.createDataFrame([(d, t, "en" if d % 2 else "de", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[-1][1]), (2, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        before = {x["doc_id"]: x["text"] for x in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {x["doc_id"] for x in docs.select("doc_id").collect()}
        if name == "language_id":
            assert kept[name] == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
        if name == "line_dedup":
            assert kept[name] == set(before)
        if name == "near_dup":
            assert kept[name] == {d for d, _, c in brute_components(list(before.items())) if d == c}
        if name == "decontaminate":
            hits = brute_hits(list(before.items()), [(1, rows[-1][1]), (2, "no such words")])
            assert kept[name] == {d for _, d, n, hit, *_ in hits if not (hit and 20 * hit >= n)}
    assert kept["best_fit_packing"] == kept["decontaminate"]
    assert {x["doc_id"] for x in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept["best_fit_packing"]
