"""Each stage of the pipeline against brute force on its own input, with nulls, empty texts, repeats and empty tables."""

import corpus_pipeline
from tests.llm.test_text import brute_groups, brute_hits, brute_lines

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    t = rows[5][1]
    return rows + [(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "123 !?", "en", "s", 6),
                   (90_004, t + " end", None, None, None), (None, rows[7][1], "en", "s", 1), (90_005, "hello", "en", None, 5),
                   rows[9], rows[9]]


def key(rows):
    return sorted(rows, key=str)


def test_stages(spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = edge_rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        out = stage(spark, docs, SMALL)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        if name == "language_id":
            want = [r[:2] for r in rows if any(c.isalpha() for c in r[1] or "")]
            assert key(r[:2] for r in got) == key(want) and all(r[2] for r in got)
        elif name == "line_dedup":
            texts = brute_lines([r[:2] for r in rows])
            assert key(r[:2] for r in got) == key((r[0], texts[r[:2]]) for r in rows)
        elif name == "near_dedup":
            groups = brute_groups([r[:2] for r in rows])
            empty = [r for r in rows if not (r[1] or "").split()]
            assert len(got) == len({c for _, n, c in groups if n}) + len(empty)
            assert {r[0] for r in got} == {c for _, n, c in groups}
        elif name == "benchmark_decontamination":
            clean = [r for r in rows if not (lambda n, h, _: h and 20 * h >= n)(*brute_hits(r[1], bench))]
            assert key(r[0] for r in got) == key(r[0] for r in clean)
        else:
            fill = {}
            for r in sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
                assert fill.get(r["sequence_id"], 0) == r["offset"]
                fill[r["sequence_id"]] = r["offset"] + r["length"]
            assert max(fill.values()) <= 2048 and {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
        rows = got


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
