"""Each stage on its own input, and the whole, against plain Python."""

from collections import Counter

import corpus_pipeline
from skymatch.llm import queries, toxicity
from skymatch.llm.common import held_out, stored

from .helpers import brute_groups
from .test_packing import place_check
from .test_text_rules import brute_lines, check_mix


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_neardup", "mixing", "best_fit_packing"]
    (_, toxic), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    a = stored(toxic(spark, docs, sf))
    assert a.columns == docs.columns
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).select("doc_id", "toxicity.score").collect()}
    assert {r["doc_id"] for r in a.collect()} == {i for i, s in score.items() if s < 0.5}
    b = stored(lines(spark, a, sf))
    assert b.schema == docs.schema
    want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in a.collect()], 3)
    assert {r["doc_id"]: r["text"] for r in b.collect()} == {i: t for i, (t, _, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in b.collect())
    c = stored(near(spark, b, sf))
    assert c.schema == docs.schema
    groups = brute_groups([(r["doc_id"], r["text"]) for r in b.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in c.collect()) == sorted({root for _, root in groups.values()})
    d = stored(mix(spark, c, sf))
    assert d.schema == docs.schema
    taken = Counter(r["doc_id"] for r in d.collect())
    rows = [(r["doc_id"], r["text"], r["source"]) for r in c.collect()]
    size = {i: len((t or "").split()) for i, t, _ in rows}
    from skymatch.llm import mixing
    from pyspark.sql import functions as F

    plan = mixing.mix(c, mixing.line_weight(F.col("text"))).collect()
    check_mix(plan, rows)
    assert taken == Counter({x["doc_id"]: x["copies"] for x in plan if x["copies"]})
    e = pack(spark, d, sf).collect()
    place_check(e, 2048)
    assert Counter(x["doc_id"] for x in e if x["piece"] == 0) == taken and sum(size.values()) > 0


def test_run_and_registration(spark, sf):
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and "pipeline" not in queries.ORACLE_SQL
    out = corpus_pipeline.run(spark, sf)
    place_check(out.collect(), 2048)
    names = sorted(n for n in queries.QUERIES if n.startswith("op"))
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_held_out(spark):
    import zlib

    ids = [*range(50), 10**12, -7]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert {r[0]: r[1] for r in df.select("doc_id", held_out(df["doc_id"])).collect()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_edges(spark, sf):
    """Nulls, repeated rows, extra columns and an empty table go through all stages."""
    from pyspark.sql import functions as F

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z " * 40, "en", "a", 240), (3, "x y z " * 40, "en", "a", 240), (None, "p q r s t u v w", "de", None, 16), (4, "w " * 9000, "fr", "b", 18000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_version", F.lit("clash"))
    for docs in (df.drop("_version"), df.drop("_version").limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf))
        docs.count()


def test_columns_of_operators_names_pass_through(spark, sf):
    from pyspark.sql import functions as F

    names = ("toxicity", "score", "n_lines", "n_removed", "kept", "component", "copies", "_row", "_version", "_hash", "_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    docs = stored(docs.withColumns({n: F.concat(F.lit(f"{n} of "), "doc_id") for n in names}))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)


def test_scratch_tables_are_released(spark):
    from skymatch.llm import common

    df = common.stored(spark.range(5))
    path = common.SCRATCH[-1]
    assert df.count() == 5 and common.release(spark) >= 1 and not common.SCRATCH
    import os

    assert not os.path.exists(path.removeprefix("file://"))
