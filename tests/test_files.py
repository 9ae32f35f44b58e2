"""File sources and file jobs."""

from pyspark.sql import functions as F

from runfold.operators import policy, storage, text
from runfold.sources.versions import VersionedTable
from runfold.sources import files


def test_text_line_scan_and_grep(spark, tmp_path):
    d = tmp_path / "src"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("hello\n  find me@mail12  \n")
    (d / "sub" / "b.txt").write_text("x\r\nmail@mail3 here")
    (d / "empty.txt").write_text("")
    lines = files.text_line_scan(spark, str(d))
    assert lines.count() == 5                           # trailing newline → last empty line
    whole = files.text_line_scan(spark, str(d), whole_files=True)
    cols = ["path", "line_no", "line"]
    assert sorted(map(tuple, lines.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))
    g = text.regex_grep(lines, "@mail[0-9]+")
    got = sorted(r.match.split("/")[-1] for r in g.collect())
    assert got == ["a.txt:2: find me@mail12", "b.txt:2: mail@mail3 here"]
    capped = text.capped_matches(lines, ["path", "line_no"], 2)
    assert capped.count() == 2


def test_listing_binary_and_usage(spark, tmp_path):
    d = tmp_path / "store"
    (d / "p1").mkdir(parents=True)
    (d / "p2").mkdir()
    (d / "p1" / "t.txt").write_text("plain text")
    (d / "p1" / "b.bin").write_bytes(b"abc\x00def")
    (d / "p2" / "late.bin").write_bytes(b"a" * 5000 + b"\x00")   # NUL after the probe window
    lst = files.object_listing(spark, str(d))
    assert "content" not in lst.columns and lst.count() == 3
    flags = {r.path.split("/")[-1]: r.is_binary for r in files.binary_detect(lst).collect()}
    assert flags == {"t.txt": False, "b.bin": True, "late.bin": False}
    prefix = storage.relative_prefix(F.regexp_replace("path", "^file:(//)?", ""), str(d))
    use = {r.prefix: (r.n_objects, r.total_bytes) for r in storage.storage_usage(lst, prefix).collect()}
    assert use == {"p1": (2, 17), "p2": (1, 5001)}


def test_binary_detect_content_column(spark):
    df = spark.createDataFrame([(bytearray(b"ab\x00"),), (bytearray(b"abc"),)], "content binary")
    assert [r.is_binary for r in files.binary_detect_content(df).collect()] == [True, False]


def test_multi_read(spark):
    reqs = spark.createDataFrame([(1, "/w/CodeSandBox/a.py"), (2, "/w/CodeSandBox/empty.py"), (3, "/w/CodeSandBox/none.py"),
                                  (4, "/etc/passwd")], "req_id long, path string")
    fs = spark.createDataFrame([("/w/CodeSandBox/a.py", "print(1)"), ("/w/CodeSandBox/empty.py", "")],
                               "path string, content string")
    dec = policy.path_policy(reqs.withColumn("operation", F.lit("read")), existing=fs.select("path"))
    r = {x.req_id: x for x in files.multi_read(spark, reqs, fs, dec.select("path", "safe", "reason")).collect()}
    assert r[1].result == "--- BEGIN /w/CodeSandBox/a.py ---\nprint(1)\n--- END /w/CodeSandBox/a.py ---"
    assert "[File is empty]" in r[2].result
    assert r[3].status == "denied" and r[3].result.endswith("File does not exist.")
    assert r[4].result == "[/etc/passwd]: Access Denied - Path traversal detected."


def test_resolve_source(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    assert files.resolve_source(spark, "runfold_missing_tbl", p).count() == 3
    spark.createDataFrame([], "id long").write.mode("overwrite").saveAsTable("runfold_empty_tbl")
    assert files.resolve_source(spark, "runfold_empty_tbl", p).count() == 3   # empty table → path
    spark.range(5).write.mode("overwrite").saveAsTable("runfold_full_tbl")
    assert files.resolve_source(spark, "runfold_full_tbl", p).count() == 5


REGISTRY = """{"mcpServers": {
 "aws-api": {"command": "docker", "args": ["run"], "env": {"R": "us-east-1", "K": "$KEY"}, "includeTools": ["call_aws", "suggest_aws_commands"]},
 "aws-documentation": {"command": "docker", "args": ["run"], "includeTools": ["read_documentation", "read_sections", "recommend", "search_documentation"]},
 "x y": {"command": "node", "args": []}
}}"""


def test_registry_flatten(spark, tmp_path):
    p = tmp_path / "mcp-config.json"
    p.write_text(REGISTRY)
    flat = files.registry_flatten(spark, str(p))
    rows = {(r.server, r.tool) for r in flat.collect()}
    assert len(rows) == 7 and ("x y", None) in rows
    env = flat.where("server = 'aws-documentation'").first()["env"]
    assert env is None
    assert files.registry_flatten(spark, str(tmp_path / "nope.json")).count() == 0


def test_gated_write_and_delete(spark, tmp_path):
    b = spark.createDataFrame([(1, "/w/CodeSandBox/a/x.py", "a"), (2, "/w/CodeSandBox/a/y.py", "a"),
                               (3, "/w/CodeSandBox/b/ok.py", "b"), (4, "/w/CodeSandBox/b/run.sh", "b"),
                               (5, "/w/CodeSandBox/b/zz.exe", "b")], "ord long, path string, batch string")
    dest = str(tmp_path / "out")
    rep = {r.batch: r for r in policy.gated_write(b, "batch", "ord", dest).collect()}
    assert rep["a"].status == "written" and rep["b"].status == "refused"
    assert rep["b"].first_path == "/w/CodeSandBox/b/run.sh"
    assert VersionedTable(spark, dest, "batch").read().count() == 2
    table = b.select("path")
    reqs = b.where("batch = 'a'").unionByName(
        spark.createDataFrame([(9, "/w/CodeSandBox/c/missing.py", "c")], "ord long, path string, batch string"))
    remaining, drep = policy.delete_by_key(table, reqs, "batch", "ord")
    assert {r.batch: r.status for r in drep.collect()} == {"a": "deleted", "c": "refused"}
    assert remaining.count() == 3


def test_csv_roundtrip_keeps_spaces(spark, tmp_path):
    df = spark.createDataFrame([(1, " a@b.co ", " 1.50")], "id long, customer_email string, amount string")
    p = files.write_csv(df, str(tmp_path / "csv"))
    back = files.csv_scan(spark, p, columns=["id", "customer_email", "amount"]).first()
    assert back["customer_email"] == " a@b.co " and back["amount"] == " 1.50"


def test_line_scan_of_a_file_split_across_tasks(spark, tmp_path):
    d = tmp_path / "big"
    d.mkdir()
    body = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20000))
    (d / "big.txt").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")    # force many splits of one file
    try:
        lines = files.text_line_scan(spark, str(d))
        got = {r.line_no: r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = body.split("\n")
    assert len(got) == len(want) and all(got[i + 1] == want[i] for i in range(len(want)))
