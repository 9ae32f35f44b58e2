"""File sources: delimited text, text files as numbered lines, object
listings, binary probing, multi-path reads, catalog-or-path resolution and the
nested JSON tool registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.constants import BINARY_PROBE_BYTES, EMPTY_FILE_MARKER, SEARCH_CAP

#: The scan's own column for lines that don't fit.
RAW_LINE = "__raw_line"


# ---------------------------------------------------------------- S1 csv_scan
def csv_scan(spark: SparkSession, path: str, columns: list[str] | None = None,
             schema: str | T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV straight from a path/prefix, every column as STRING.

    Money and dates are *not* typed here: ``schema="amount DECIMAL"`` silently
    yields NULL for ``" 200.00"``. Clean with ``runfold.operators.clean``.
    White space is kept exactly as written. ``multi_line=True`` allows quoted
    fields that span lines (such files are then read one task per file)."""
    r = (spark.read.option("header", True).option("multiLine", multi_line)
         .option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False)
         .option("mode", "PERMISSIVE"))
    if schema is None and columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(path)


def csv_scan_checked(spark: SparkSession, path: str, columns: list[str], header: bool = True,
                     observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 with malformed lines set apart: ``(rows, quarantine)`` over one scan.

    ``rows`` are the lines with exactly ``columns`` (as STRING, white space kept).
    ``quarantine(file, line, n_fields, reason, fields)`` holds every other line as it
    stands in the file, with what could be read of it in ``fields`` (a struct of
    ``columns``, NULL where nothing was found). ``reason``: ``unclosed_quote`` (an odd
    number of quotes), ``missing_fields``, ``extra_fields``, else ``malformed``;
    ``n_fields`` counts separators outside quotes. An unclosed quote in the last field
    leaves the count right, so such a line is a row. Blank lines are skipped. With a
    header, files whose header differs from ``columns`` raise. No column may be named
    like ``RAW_LINE``. An ``observation`` gets ``n_malformed`` from the first action on
    ``rows``, so a load without a malformed line needn't read the files again."""
    if RAW_LINE in columns:
        raise ValueError(f"a column is named {RAW_LINE}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, RAW_LINE]])
    scan = (spark.read.schema(schema).option("header", header).option("enforceSchema", not header)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_LINE)
            .option("columnPruning", False).csv(path))  # fields are counted only where all are parsed
    raw, names = F.col(RAW_LINE), [F.col(f"`{c}`") for c in columns]
    pieces = F.split(F.regexp_replace("line", r"\\.", ""), '"', -1)  # those at odd places stand in quotes
    n_fields = F.size(F.split(F.array_join(F.filter(pieces, lambda _, i: i % 2 == 0), ""), ",", -1))
    reason = (F.when(F.size(pieces) % 2 == 0, "unclosed_quote").when(n_fields < len(columns), "missing_fields")
               .when(n_fields > len(columns), "extra_fields").otherwise("malformed"))
    # the raw line of a malformed line, else '': Spark refuses scans that use the raw line
    # alone (as a count would), so the text takes in nothing of the first column, too
    malformed = F.concat_ws("", raw, F.left(names[0], F.lit(0)))
    bad = (scan.where(malformed != "")
               .select(F.col("_metadata.file_path").alias("file"), raw.alias("line"), F.struct(*names).alias("fields"))
               .select("file", "line", n_fields.alias("n_fields"), reason.alias("reason"), "fields"))
    seen = scan if observation is None else scan.observe(observation, F.count(raw).alias("n_malformed"))
    return seen.where(malformed == "").select(*names), bad


def write_csv(df: DataFrame, path: str) -> str:
    """Write header CSV keeping leading/trailing spaces (the writer trims
    them by default)."""
    (df.write.mode("overwrite").option("header", True)
       .option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False)
       .csv(path))
    return path


# ------------------------------------------------------------ S3 text lines
def text_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, content)``: one row per file under ``root``, recursively."""
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    # the keyword (not .option) is needed: text() would reset wholetext to False
    return r.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def split_lines(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, line_no, line)``, lines numbered from 1, split on '\\n' only
    (a trailing newline gives a last empty line, as ``split("\\n")`` does)."""
    return df.select(F.col(path).alias("path"),
                     F.posexplode(F.split(F.col(content), "\n", -1)).alias("pos", "line")) \
             .select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def text_line_scan(spark: SparkSession, root: str, glob: str | None = None,
                   whole_files: bool = False, in_parts: bool = False) -> DataFrame:
    """S3: ``(path, line_no, line)`` for every text file under ``root``,
    split on '\\n' only, numbered from 1, as ``content.split("\\n")`` does
    (a file ending in '\\n' has a last empty line). Zero-byte files are
    not listed by Spark's file sources, so they yield no line.

    Default: a line-based read, so a file larger than one task's memory is
    split across tasks; line numbers are stitched together with a running
    count over (file, split start, position in split), where each split is
    one bucket of the scan. ``whole_files=True`` reads each file as one value
    instead (small files only). ``in_parts=True``: a folder of part files, as Spark
    writes them, is one file, its parts in order of their names; ``path`` is the folder.
    Only after the last part can there be a last empty line."""
    if whole_files:
        return split_lines(text_files(spark, root, glob))
    from runfold.operators.scan import Run, running
    r = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob)
    part = F.col("_metadata.file_path")
    raw = r.text(root).select((F.regexp_replace(part, "/[^/]*$", "") if in_parts else part).alias("path"),
                              part.alias("__part"),
                              F.col("_metadata.file_block_start").alias("__blk"),
                              F.col("_metadata.file_size").alias("__size"),
                              F.monotonically_increasing_id().alias("__pos"),
                              F.col("value").alias("line"))
    numbered = running(raw, ["path"], ["__part", "__blk", "__pos"], [Run("line_no", "count")], bucket=F.struct("__part", "__blk"))
    lines = numbered.select("path", F.col("line_no").cast("bigint").alias("line_no"), "line")
    # the reader drops the empty piece after a final '\n': add it back when the
    # line bytes plus one separator each add up to the file size
    per_part = (raw.groupBy("path", "__part")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("b"),
                        F.max("__size").alias("size")))
    per_file = per_part.groupBy("path").agg(F.sum("n").alias("n"), F.max_by(F.col("b") == F.col("size"), "__part").alias("ended"))
    tail = per_file.where("ended").select(
        "path", (F.col("n") + 1).cast("bigint").alias("line_no"), F.lit("").alias("line"))
    return lines.unionByName(tail)


# ------------------------------------------------------- S4 object listing
def object_listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, length, modificationTime)`` of every file under ``root``;
    the content column is pruned, so no file body is read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", "length", "modificationTime")


# ------------------------------------------------------- F2 binary detect
def binary_detect(listing: DataFrame) -> DataFrame:
    """``is_binary``: a NUL byte in the first 4,000 bytes, or unreadable.

    Reads only the probe bytes of each file: ``binaryFile`` would load whole
    bodies, which for a large corpus is the whole corpus in I/O. The listing
    is spread over tasks (Arrow batches into ``mapInPandas``), one small
    ranged read per file through Arrow's file systems (local, S3, HDFS, GCS).
    For a BINARY column already in a table, use ``binary_detect_content``."""
    n_bytes = BINARY_PROBE_BYTES

    # defined here so it is shipped to the Python workers by value: they need
    # no copy of this package on their path
    def probe(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        for pdf in batches:
            flags = []
            for p in pdf["path"]:
                try:
                    local = p[len("file:"):] if p.startswith("file:") and not p.startswith("file://") else p
                    if local.startswith("file://"):
                        local = local[len("file://"):]
                    for hadoop_scheme in ("s3a://", "s3n://"):        # Hadoop names for the same store
                        if local.startswith(hadoop_scheme):
                            local = "s3://" + local[len(hadoop_scheme):]
                    if "://" in local:
                        fs, rel = pafs.FileSystem.from_uri(local)
                    else:
                        fs, rel = pafs.LocalFileSystem(), local
                    with fs.open_input_stream(rel) as f:
                        head = f.read(n_bytes)
                    flags.append(b"\x00" in head)
                except Exception:
                    flags.append(True)  # unreadable counts as binary
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "is_binary": flags})

    return listing.select("path", "length").mapInPandas(probe, "path string, length bigint, is_binary boolean")


def binary_detect_content(df: DataFrame, content: str = "content") -> DataFrame:
    """Same rule on an in-table BINARY column (JVM-side, no Python)."""
    head = F.substring(F.col(content), 1, BINARY_PROBE_BYTES)
    return df.withColumn("is_binary", F.instr(F.decode(head, "ISO-8859-1"), "\u0000") > 0)


# ----------------------------------------------------------- S10 multi read
def multi_read(spark: SparkSession, requests: DataFrame, files: DataFrame,
               decisions: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Read a list of paths: one result row per request, never a failure.

    ``requests(req_id, path)``; ``files(path, content)`` (e.g. ``text_files``);
    ``decisions(path, safe, reason)`` from the path policy. A refused path
    gives ``Access Denied - reason``, a missing one an error row, an empty
    file the empty-file marker."""
    # only requested files' bodies move: the request list cuts them down first
    wanted = files.select(F.col("path").alias(key), "content").join(requests.select(key).distinct(), key, "left_semi")
    r = requests.join(wanted, key, "left")
    if decisions is not None:
        r = r.join(decisions.select(F.col("path").alias(key), "safe", "reason"), key, "left")
        safe, reason = F.coalesce(F.col("safe"), F.lit(True)), F.col("reason")
    else:
        safe, reason = F.lit(True), F.lit(None).cast("string")
    p = F.col(key)
    text = (F.when(~safe, F.concat(F.lit("["), p, F.lit("]: Access Denied - "), reason))
             .when(F.col("content").isNull(), F.concat(F.lit("["), p, F.lit("]: Error - file not found")))
             .otherwise(F.concat(F.lit("--- BEGIN "), p, F.lit(" ---\n"),
                                 F.when(F.col("content") == "", F.lit(EMPTY_FILE_MARKER)).otherwise(F.col("content")),
                                 F.lit("\n--- END "), p, F.lit(" ---"))))
    status = F.when(~safe, "denied").when(F.col("content").isNull(), "error").otherwise("ok")
    return r.select(*[c for c in requests.columns], status.alias("status"), text.alias("result"))


# ----------------------------------------------------------- corpus search
def corpus_search(corpus: DataFrame, pattern: str, extensions: list[str] | None = None, n: int = SEARCH_CAP,
                  root: str = "/w") -> DataFrame:
    """One job over ``corpus(path, content)``: paths that the read policy allows,
    with one of ``extensions`` (all if None), that hold text; their lines that
    match ``pattern``; the first ``n`` matches in path and line order. Filters run
    before the lines are split; the cap is the search's own."""
    from runfold.operators import policy, text
    d = policy.path_policy(corpus.withColumn("operation", F.lit("read")), root=root).where("safe")
    if extensions is not None:
        d = d.where(F.col("ext").isin(*extensions))
    d = binary_detect_content(d.withColumn("__bytes", F.encode("content", "UTF-8")), "__bytes").where(~F.col("is_binary"))
    return text.capped_matches(text.regex_grep(split_lines(d.select("path", "content")), pattern), ["path", "line_no"], n)


# ----------------------------------------------------------- S5 resolve
def resolve_source(spark: SparkSession, table_name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Use the catalog table only if it exists *and* holds a row; otherwise
    read the path directly."""
    if spark.catalog.tableExists(table_name):  # any other failure (no rights, a corrupt table) is raised
        found = spark.table(table_name)
        if not found.isEmpty():
            return found
    return spark.read.format(fmt).load(path)


# ------------------------------------------------------- S9 registry
SERVER_SCHEMA = ("struct<command:string,args:array<string>,env:map<string,string>,"
                 "includeTools:array<string>>")


def registry_flatten(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flatten a tool registry to ``(server, command, args, env, tool)``.

    ``multi_line=True`` reads the ``{"mcpServers": {name: {...}}}`` document
    form; ``False`` reads JSON lines ``{"name": ..., "command": ..., ...}``
    (one server per line, which splits across tasks at scale). A missing path
    is an empty registry. Servers without ``includeTools`` keep one row with
    ``tool = NULL`` (no filter = every tool)."""
    if multi_line:
        schema = f"mcpServers map<string,{SERVER_SCHEMA}>"
        try:
            doc = spark.read.schema(schema).option("multiLine", True).json(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return _empty_registry(spark)
            raise
        servers = doc.select(F.explode("mcpServers").alias("server", "s")).select(
            "server", "s.command", "s.args", "s.env", "s.includeTools")
    else:
        schema = ("name string, command string, args array<string>, env map<string,string>, "
                  "includeTools array<string>")
        try:
            servers = spark.read.schema(schema).json(path).withColumnRenamed("name", "server")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return _empty_registry(spark)
            raise
    return servers.select("server", "command", "args", "env",
                          F.explode_outer("includeTools").alias("tool"))


def _empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "server string, command string, args array<string>, "
                                     "env map<string,string>, tool string")
