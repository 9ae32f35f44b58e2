"""Small cases of the third round's findings."""

import os

from pyspark.sql import functions as F

from runfold.operators import registry
from runfold.operators import search_index as ix
from runfold.session import staging_path
from runfold.sources import files

SETTING = "tenant long, section string, key string, value string"


def test_defaults_of_several_words_without_a_join_or_wide_shuffle(spark):
    dflt = [(f"s{i % 5}", f"k{i}", str(i)) for i in range(70)] + [("s0", "k0", "z"), ("s0", "k0", None), (None, "k", "n")]
    loaded = spark.createDataFrame([(1, "s1", "k1", "a"), (1, "s1", "k1", "b"), (1, "s2", "new", None), (None, "s3", "k68", "x"), (9, "s4", "k", "y"),
                                    (1, None, "q", "w")], SETTING)
    tenants = spark.createDataFrame([(1,), (1,), (2,), (None,)], "tenant long")
    df = registry.layered_defaults(loaded, dflt, tenants, ["s1", "s3"])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    base = {(s, k): max((v for a, b, v in dflt if (a, b) == (s, k) and v is not None)) for s, k, _ in dflt}
    want = {(t, s, k): (v, 0) for t in (1, 2, None) for (s, k), v in base.items() if t != 1 or s not in ("s2", None)}
    want |= {(1, "s1", "k1"): ("b", 1), (1, "s2", "new"): (None, 1), (None, "s3", "k68"): ("x", 1), (9, "s4", "k"): ("y", 1), (1, None, "q"): ("w", 1)}
    got = df.collect()
    assert len(got) == len(want) and {(r.tenant, r.section, r.key): (r.value, r.layer) for r in got} == want


def test_update_sorts_in_a_given_number_of_tasks(spark):
    cur = spark.createDataFrame([(i, "preferences", "k", "v") for i in range(50)], SETTING)
    out = registry.settings_update(cur, cur.where("tenant < 5").withColumn("value", F.lit("w")))
    assert out.where("value = 'w' AND layer = 1").count() == 5 and out.count() == 50
    assert f", {registry.LAYER_TASKS})" in out._jdf.queryExecution().executedPlan().toString()


def test_index_holds_lists_of_paths(spark):
    corpus = spark.createDataFrame([("a", "abcabc"), ("b", "xabc"), (None, "abc😀"), ("c", None), ("d", "ab"), ("e", "")], "path string, content string")
    dest = staging_path(spark, "index")
    got = [(r.path, r.trigram) for r in ix.write_index(corpus.coalesce(1), dest).collect()]
    want = {(p, t[i:i + 3]) for p, t in [("a", "abcabc"), ("b", "xabc"), (None, "abc😀")] for i in range(len(t) - 2)}
    assert len(got) == len(want) and set(got) == want and spark.read.parquet(dest).count() == len({t for _, t in want})


def test_a_file_in_parts_is_numbered_through(spark, tmp_path):
    for name, text in [("x/part-0", "a\nb\n"), ("x/part-1", "c\n\n"), ("y/part-0", "d\ne")]:
        os.makedirs(tmp_path / name[0], exist_ok=True)
        (tmp_path / name).write_text(text)
    got = sorted((r.path[-1], r.line_no, r.line) for r in files.text_line_scan(spark, str(tmp_path), in_parts=True).collect())
    assert got == [("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c"), ("x", 4, ""), ("x", 5, ""), ("y", 1, "d"), ("y", 2, "e")]
