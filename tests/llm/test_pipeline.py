"""The pipeline's stages, each on its own input."""

import random

import corpus_pipeline as p

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, before, DATA).cache()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == p.COLUMNS
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
    n = {k: v.count() for k, v in kept.items()}
    assert n["language"] > 0.95 * spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert n["near_dedup"] == kept["near_dedup"].select("text").distinct().count()
    assert n["substring_dedup"] > 0.9 * n["near_dedup"]
    packed = kept["packing"]
    assert packed.select("doc_id").distinct().count() == n["decontamination"]


def test_run_equals_stages_and_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()}
    assert 5 in got and 7 in got and not got & {1, 2, 3, 6, 9}
    odd.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_recall(spark):
    """All pairs at or above the limit are found: short texts with a word more, and sets that only repeats tell apart."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for i in range(600):
        base = words(8 + i % 2)
        texts += [" ".join(base), " ".join([*base, *words(1)])]
    for _ in range(40):
        base, line = words(150), words(12)
        texts += [" ".join(base + n * line) for n in (2, 10)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in p.near_dedup(spark, table, DATA).select("doc_id").collect()}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = {i + 1 for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(alike) == 640 and kept == set(range(len(texts))) - alike
