import re
from pathlib import Path

import corpus_pipeline
from quillon.llm.common import swept
from quillon.llm.decontaminate import contaminated_pairs
from quillon.llm.pii import find
from tests.llm.test_jaccard import brute


def test_stages_take_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], d).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(set(s.columns) == set(docs.columns) for s in seen[:5])
    sizes = [s.count() for s in seen]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert sorted(r["doc_id"] for r in seen[2].select("doc_id").collect()) == brute([(r["doc_id"], r["text"] or "") for r in seen[1].collect()])
    tests = spark.read.parquet(f"{d}/benchmark.parquet")
    hit = {r["doc_id"] for r in contaminated_pairs(seen[2], tests).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in seen[2:4])
    assert hit and set(after) == set(before) - hit
    spans = {r["id"]: r["base"] for r in find(seen[3]).collect()}
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[4].collect()}
    for key, (text, n) in clean.items():
        assert len(text) == n and (spans[key] or text == after[key])
        assert not re.search(r"[a-z.0-9]+@[a-z0-9]+\.example\.com", text)
    assert {r["doc_id"] for r in seen[5].collect()} == set(clean)


def test_stages_on_awkward_tables(spark, tmp_path):
    """Null texts and ids, empty and repeated rows, an empty table, and clashing names through all stages."""
    d = "/root/testdata/sf0.001"
    words = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").select("text").limit(40).collect()
    rows = [(k, r["text"]) for k, r in enumerate(words)] + [(None, words[0]["text"] + " and more"), (50, None), (51, ""), (0, words[0]["text"]), (0, words[0]["text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "'s' as source", "1L as n_chars", "1 as row", "2 as hash", "3 as salt", "4 as length", "5 as id", "6 as n", "7 as spans")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for name in ("some", "none"):
            own = docs if not k and name == "some" else docs.limit(0) if not k else spark.read.parquet(f"{tmp_path}/{name}{k - 1}")
            out = stage(spark, own, d)
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            n = spark.read.parquet(f"{tmp_path}/{name}{k}").count()
            assert n > 20 if name == "some" else n == 0


def test_run_gives_the_packed_pieces(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_row_stays_of_repeated_ids(spark):
    from quillon.llm.simhash import one_per_group

    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words are here now"), (2, "a b c d"), (None, "alone in the world of ids"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __n", "2 as fp")
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect())
    assert got == [(0, "alone in the world of ids"), (1, "a b c d"), (1, "other words are here now"), (3, None)]


def test_freed_native_memory_goes_back(spark):
    """What the driver's JVM has freed but the C library keeps, here below a block still in use, is given back between phases."""
    jvm = spark.sparkContext._jvm

    def held() -> float:
        of = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup").read_text()
        return int(re.search(r"\nPss_Anon:\s+(\d+)", of)[1]) / 1024

    swept(spark)
    before = held()
    blocks = [jvm.java.util.zip.Deflater() for _ in range(2000)]
    for block in blocks[:-1]:
        block.end()
    jvm.System.gc()
    kept = held() - before
    swept(spark)
    assert kept > 100 and held() - before < kept / 2
    blocks[-1].end()
