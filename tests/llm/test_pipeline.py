"""The pipeline's stages against plain Python on the smallest tables."""

import importlib.util

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    from gaugeworks.llm import quality

    from .test_jaccard import brute
    from .test_packing import check

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in quality.quality_rows(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("kept").collect()}
    assert set(seen[1]) == kept and 0 < len(kept) < len(seen[0])
    assert set(seen[2]) == {i for i, (_, c) in brute(seen[1]).items() if i == c}
    words = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(seen[3]) == {i for i, t in seen[2].items() if not any(x in words(t) for x in items)}
    assert set(seen[4]) == set(seen[3]) and all("[SECRET]" in seen[4][i] for i in seen[3] if seen[3][i] != seen[4][i])
    check(docs.collect(), seen[4])
    assert sorted(map(str, cp.run(spark, FOLDER).select("doc_id", "start", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "start", "ids_crc32").collect()))


CLASH = ["key", "row", "place", "y", "part", "kept", "words", "hash", "count", "first", "size", "band", "token", "item_id", "score"]


def test_edge_tables(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, a very long text and clashing names pass all stages, as does an empty table."""
    import random

    import corpus_pipeline as cp

    from .test_packing import check

    r = random.Random(1)
    prose = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(n))
    good, long = prose(120), prose(60_000)
    texts = [None, "", " \n\t", "short", good, good, prose(80) + ' password = "abcdefgh12345"', long, prose(90), good + " more words here", "same words again " * 100]
    rows = [(None if i == 8 else i, t, None if i % 3 else "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[4], (None, good, "de", "s", 5), (None, None, None, None, None)]
    documents = spark.createDataFrame([(*x, *("c" for _ in CLASH)) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    for name, docs in (("edge", documents), ("empty", documents.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1, 0), (4, 1, 0), (10, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x"), (2, prose(30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(cp.STAGES):
            stage(spark, out, folder).write.parquet(f"{folder}/out{k}")
            out = spark.read.parquet(f"{folder}/out{k}")
            if k < 4:
                assert out.columns == documents.columns
        kept = spark.read.parquet(f"{folder}/out3").collect()
        if name == "empty":
            assert not kept and out.count() == 0
            continue
        by = {x.doc_id: x.text for x in kept}
        assert len(kept) == len({x.text for x in kept}) and {6, 7} <= set(by) and len([x for x in kept if x.text and x.text.startswith(good[:40])]) == 1  # one of each group
        assert "[SECRET]" in by[6] and by[7] == long and not set(by) & {0, 1, 2, 3, 10}
        assert len(by) == len(kept)
        check(out.collect(), by)
