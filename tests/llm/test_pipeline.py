import corpus_pipeline
from sedimark.llm import queries


def test_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(100, 140)] + [(3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == frame.columns
            assert found.count() <= frame.count()
            frame = found
    assert found.count() > 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert set(queries.oracle_sql()) <= set(names)


def test_run_against_brute_force(spark):
    """Every stage's rows, each on what the one before kept, and the last one's pieces."""
    import zlib
    from collections import Counter

    import numpy as np

    from sedimark.llm import quality, secret_scan
    from tests.llm.test_operators import brute_components, plain_tokenizer

    sf_dir = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score_documents(frame, model).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in frame.collect() if r.doc_id in good]
    assert 0 < len(rows) < frame.count()
    newest = {}
    for doc, text in rows:
        newest[text or ""] = max(doc, newest.get(text or "", doc))
    rows = [(d, t) for d, t in rows if newest[t or ""] == d]
    named = {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    rows = [(d, t) for d, t in rows if d in named]
    scanner, plain, want, lengths = secret_scan.Scanner(secret_scan.ScanRules()), plain_tokenizer(), {}, Counter()
    for doc, text in rows:
        hidden = bytearray(len(text or ""))
        for a, b, _ in scanner.spans(text or ""):
            hidden[a:b] = b"\x01" * (b - a)
        # Spans that touch without overlapping are marked one by one.
        starts = {a for a, b, _ in scanner.spans(text or "")}
        clean, at = "", 0
        while at < len(hidden):
            if not hidden[at]:
                clean += text[at]
            elif at == 0 or not hidden[at - 1] or (at in starts and not any(a < at < b for a, b, _ in scanner.spans(text))):
                clean += "[SECRET]"
            at += 1
        want[doc] = np.array(plain.encode(clean, add_special_tokens=False).ids + [1], dtype="<u4")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    for r in pieces:
        lengths[r.doc_id] += r.length
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    assert lengths == Counter({d: len(ids) for d, ids in want.items()})


def test_run_over_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
