"""File sources and sinks: inventory dumps (UTF-16 CSV), XML catalogues,
label CSVs, stage tables (Parquet) and report exports.

All readers take explicit schemas (no inference pass; versions such as
``10.10`` stay strings) and are splittable, so a large dump is read by many
tasks in parallel.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..operators import reports as R
from ..operators import rollup as RU
from ..session import materialize

SEP = "|"
RAW = "_raw_row"

HOSTS_SCHEMA = T.StructType([
    T.StructField("ResourceID", T.LongType()),
    T.StructField("Active0", T.IntegerType()),
    T.StructField("AD_Site_Name0", T.StringType()),
    T.StructField("Distinguished_Name0", T.StringType()),
    T.StructField("Resource_Domain_OR_Workgr0", T.StringType()),
])

SOFTWARE_SCHEMA = T.StructType([
    T.StructField("ResourceID", T.LongType()),
    T.StructField("AgentID", T.StringType()),
    T.StructField("DisplayName0", T.StringType()),
    T.StructField("GroupID", T.StringType()),
    T.StructField("InstallDate0", T.StringType()),
    T.StructField("ProdID0", T.StringType()),
    T.StructField("Publisher0", T.StringType()),
    T.StructField("RevisionID", T.StringType()),
    T.StructField("TimeStamp", T.StringType()),
    T.StructField("Version0", T.StringType()),
])

AD_GROUP_SCHEMA = T.StructType([T.StructField("distinguishedName", T.StringType())])

_LANG_TITLE = T.StructType([T.StructField("_VALUE", T.StringType()),
                            T.StructField("_xml:lang", T.StringType())])

CPE_XML_SCHEMA = T.StructType([
    T.StructField("_name", T.StringType()),
    T.StructField("_deprecated", T.StringType()),
    T.StructField("_deprecation_date", T.StringType()),
    T.StructField("title", T.ArrayType(_LANG_TITLE)),
    T.StructField("cpe-23:cpe23-item", T.StructType([T.StructField("_name", T.StringType())])),
])

_BASE_METRICS = T.StructType([
    T.StructField("cvss:score", T.StringType()),
    T.StructField("cvss:access-vector", T.StringType()),
    T.StructField("cvss:access-complexity", T.StringType()),
    T.StructField("cvss:authentication", T.StringType()),
    T.StructField("cvss:confidentiality-impact", T.StringType()),
    T.StructField("cvss:integrity-impact", T.StringType()),
    T.StructField("cvss:availability-impact", T.StringType()),
    T.StructField("cvss:source", T.StringType()),
])

CVE_XML_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("vuln:cve-id", T.StringType()),
    T.StructField("vuln:last-modified-datetime", T.StringType()),
    T.StructField("vuln:vulnerable-software-list", T.StructType([
        T.StructField("vuln:product", T.ArrayType(T.StringType()))])),
    T.StructField("vuln:cvss", T.StructType([T.StructField("cvss:base_metrics", _BASE_METRICS)])),
])


def _typed(schema: T.StructType) -> list:
    """The columns of a dump read as strings, without the NUL characters and carriage returns of the dump
    tooling (a CRLF line end stays on the last field of a row, also of a short one), in their types."""
    def clean(f: T.StructField):
        text = F.nullif(F.regexp_replace(F.translate(F.col(f.name), "\u0000", ""), "\r$", ""), F.lit(""))
        return (text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)).alias(f.name)
    return [clean(f) for f in schema.fields]


def _files(spark: SparkSession, path: str) -> list[tuple[object, str]]:
    """(file system, file) of a file, folder or pattern, as Spark's readers would list it."""
    conf, Path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    found = []
    for status in fs.globStatus(Path(path)) or ():
        found += fs.listStatus(status.getPath()) if status.isDirectory() else [status]
    visible = (x for x in found if not x.isDirectory() and x.getPath().getName()[0] not in "._")
    return [(fs, x.getPath().toString()) for x in visible if x.getLen()]


def _header(spark: SparkSession, fs, file: str, sep: str, comment: str | None, encoding: str) -> tuple[str, ...]:
    """Column names of a dump in file order: its first line that is not a comment. Reads no more of the file than it must."""
    size = 1 << 16
    while True:
        stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file))
        try:
            head = bytes(stream.readNBytes(size))
        finally:
            stream.close()
        whole = len(head) < size
        lines = head[:len(head) // 2 * 2 if encoding.startswith("UTF-16") else None].decode(encoding, "replace").split("\n")
        for line in lines if whole else lines[:-1]:
            line = line.strip("\ufeff\u0000\r\n ")
            if line and not (comment and line.lstrip('"').startswith(comment)):
                names = next(csv.reader([line.replace("\u0000", "")], delimiter=sep))
                return tuple(n.strip().strip('"') for n in names)
        if whole:
            raise ValueError(f"no header line in {file}")
        size *= 4


def _raw_dump(spark: SparkSession, path: str, schema: T.StructType, sep: str, comment: str | None,
              encoding: str) -> DataFrame:
    """The wanted columns of a dump as strings, with ``__wide`` for rows of more fields than their header, the raw
    row of rows of another width, and their file."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for fs, file in _files(spark, path):
        groups.setdefault(_header(spark, fs, file, sep, comment, encoding), []).append(file)
    if not groups:
        raise ValueError(f"no header line in {path}")
    wanted, out = [f.name for f in schema.fields], None
    for names, files in groups.items():
        missing = [n for n in wanted if n not in names]
        if missing:
            raise ValueError(f"{files[0]} lacks the columns {missing}; it has {list(names)}")
        # the first column of a name counts; a second one, and unnamed ones, get names of their own
        slots = [n if n and n not in names[:i] else f"__column_{i}" for i, n in enumerate(names)]
        full = T.StructType([T.StructField(n, T.StringType()) for n in [*slots, RAW]])
        # without column pruning every query sees the whole row and its width
        reader = (spark.read.option("sep", sep).option("quote", '"').option("encoding", encoding).option("lineSep", "\n")
                  .option("mode", "PERMISSIVE").schema(full).option("header", True)
                  .option("columnNameOfCorruptRecord", RAW).option("columnPruning", False))
        if comment:
            reader = reader.option("comment", comment)
        # the raw row is there only if its width is not the header's
        unquoted = F.regexp_replace(RAW, '"[^"]*"', "")
        width = F.char_length(unquoted) - F.char_length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
        part = reader.csv(files).select(*wanted, RAW, F.coalesce(width > len(names), F.lit(False)).alias("__wide"),
                                        F.input_file_name().alias("__file"))
        out = part if out is None else out.unionByName(part)
    return out


def _is_header(schema: T.StructType) -> "F.Column":
    """A header preceded by a comment line is read as data (the first line is the one skipped as header, and a
    byte-order mark hides its '#'): rows that repeat the column names."""
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    repeats = F.lit(bool(texts))
    for n in texts:
        repeats = repeats & F.coalesce(F.col(n) == F.lit(n), F.lit(False))
    return repeats


def read_dump(spark: SparkSession, path: str, schema: T.StructType, sep: str = SEP,
              comment: str | None = None, encoding: str = "UTF-16LE") -> DataFrame:
    """Delimited dump, a file or a folder of files with a header line each; columns are taken by name.

    The header of every file is read first and gives its width and order, so
    dumps may hold more columns than ``schema``, in any order, and a folder files
    of several layouts: files of one header go through one reader. A column that
    is missing is an error. Short rows are padded with nulls. Rows with more
    fields than their header are dropped, whether or not the surplus is empty
    (quoted separators do not count), and a value that is not of its column's
    type is null; ``split_dump`` returns such rows.

    ``UTF-16LE`` with ``lineSep='\\n'`` keeps the file splittable (plain
    ``UTF-16`` needs the unsplittable multi-line reader).
    """
    rows = _raw_dump(spark, path, schema, sep, comment, encoding).where(~F.col("__wide")).select(*_typed(schema))
    return rows.where(~_is_header(schema))


REJECTS_SCHEMA = "file string, reason string, row string"


def split_dump(spark: SparkSession, path: str, schema: T.StructType, sep: str = SEP, comment: str | None = None,
               encoding: str = "UTF-16LE") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a dump's rows that fit its header and ``schema``, and all others with file and reason.

    Every data row is in one of the two; write the second with ``save_stage``.
    """
    raw = _raw_dump(spark, path, schema, sep, comment, encoding)
    typed = {f.name: c for f, c in zip(schema.fields, _typed(schema))}
    reason = F.when(F.col("__wide"), F.lit("more fields than the header"))
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            text = F.trim(F.translate(F.col(f.name), "\u0000\r", ""))
            reason = reason.when((text != "") & typed[f.name].isNull(), F.lit(f"not a {f.dataType.simpleString()}: {f.name}"))
    judged = raw.withColumn("__reason", reason)
    good = judged.where(F.col("__reason").isNull()).select(*typed.values())
    row = F.coalesce(RAW, F.concat_ws(sep, *[F.coalesce(F.col(f.name), F.lit("")) for f in schema.fields]))
    bad = judged.where(F.col("__reason").isNotNull() & ~_is_header(schema)).select(
        F.col("__file").alias("file"), F.col("__reason").alias("reason"), row.alias("row"))
    return good.where(~_is_header(schema)), bad


def split_xml(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the elements ``tag`` that are well-formed and fit ``schema``, and the others.

    The parsed elements are written once; both tables read that copy.
    """
    full = T.StructType([*schema.fields, T.StructField(RAW, T.StringType())])
    read = (_xml(spark, tag, full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).load(path)
            .withColumn("__file", F.input_file_name()))
    read = materialize(read, f"parsed_{tag}")
    bad = read.where(F.col(RAW).isNotNull()).select(
        F.col("__file").alias("file"), F.lit(f"malformed {tag}").alias("reason"), F.col(RAW).alias("row"))
    return read.where(F.col(RAW).isNull()).select(*[f"`{f.name}`" for f in schema.fields]), bad


def scan_hosts(spark: SparkSession, path: str) -> DataFrame:
    return read_dump(spark, path, HOSTS_SCHEMA)


def scan_software(spark: SparkSession, x86: str, x64: str) -> DataFrame:
    """Both architecture dumps, tagged and unioned (not yet cleaned)."""
    return C.union_arch(read_dump(spark, x86, SOFTWARE_SCHEMA), read_dump(spark, x64, SOFTWARE_SCHEMA))


def scan_ad_group(spark: SparkSession, path: str) -> DataFrame:
    return read_dump(spark, path, AD_GROUP_SCHEMA, sep=",", comment="#")


def _xml(spark: SparkSession, tag: str, schema: T.StructType):
    """A reader of the elements ``tag``, each parsed alone: a malformed one loses nothing but itself.

    (The other parser reads a file in one go and gives up at the first error.)
    """
    return spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", "true").schema(schema)


def scan_cpe_xml(spark: SparkSession, path: str) -> DataFrame:
    """CPE dictionary, one row per ``cpe-item``."""
    return _xml(spark, "cpe-item", CPE_XML_SCHEMA).load(path)


def scan_cve_xml(spark: SparkSession, directory: str, prefix: str = "nvdcve-2.0-") -> DataFrame:
    """All yearly feed files of a directory in one multi-file scan, one row per ``entry``."""
    return _xml(spark, "entry", CVE_XML_SCHEMA).load(os.path.join(directory, f"{prefix}*.xml"))


def scan_labels(spark: SparkSession, path: str, keys: list[str], features: list[str],
                extra: list[str] | None = None) -> DataFrame:
    """Labelled pairs CSV (UTF-8, header); columns are taken by name, an unnamed row index is ignored."""
    wanted = [T.StructField(k, T.StringType()) for k in keys] + [T.StructField("match", T.IntegerType())]
    wanted += [T.StructField(f, T.IntegerType()) for f in features]
    wanted += [T.StructField(e, T.StringType()) for e in (extra or [])]
    return read_dump(spark, path, T.StructType(wanted), sep=",", encoding="UTF-8")


def scan_stop_words(spark: SparkSession, path: str) -> list[str]:
    """Stop-word list (``idx,word``): a short configuration list, collected to the driver."""
    schema = "idx int, word string"
    rows = spark.read.schema(schema).csv(path).where(F.col("word").isNotNull()).orderBy("idx").collect()
    return [r.word for r in rows]


#: Files that a task writing a partitioned stage keeps open, and the bytes of rows that each may hold.
OPEN_FILES, PARTITION_BLOCK = 64, 16 << 20


@contextmanager
def _open_files(spark: SparkSession):
    """A task of a partitioned write keeps a file open for each of its first ``OPEN_FILES`` values and
    sorts only the rows of further ones, instead of all its rows."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save_stage(df: DataFrame, directory: str, name: str, partition_by: list[str] | None = None,
               profile: bool = False) -> str:
    """Persist one stage table as Parquet (overwrite); with ``profile`` also its columns' mergeable profile."""
    path = os.path.join(directory, name)
    w = df.write.mode("overwrite")
    if partition_by:
        with _open_files(df.sparkSession):
            w.partitionBy(*partition_by).option("parquet.block.size", PARTITION_BLOCK).parquet(path)
    else:
        w.parquet(path)
    if profile:
        R.distinct_sketches(load_stage(df.sparkSession, directory, name, df.schema)) \
            .write.mode("overwrite").parquet(os.path.join(directory, "_profiles", name))
    return path


def load_profiles(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """The profiles kept with stage tables, one row per table and column."""
    return spark.read.parquet(*[os.path.join(directory, "_profiles", n) for n in names])


def save_bucketed(df: DataFrame, directory: str, name: str, keys: list[str], buckets: int) -> str:
    """Persist a stage table so that joins and aggregations on ``keys`` need no shuffle of it.

    Rows of keys that alone would fill a bucket (fewer than ``buckets`` such keys
    can exist) and rows with a null key, which no join meets, go to a part of
    their own without buckets, whose joins the planner is free to split.
    """
    spark, path = df.sparkSession, os.path.join(directory, name)
    df = materialize(df, "unbucketed")      # read four times below, computed once
    counts = df.where(_no_null(keys)).groupBy(*keys).agg(F.count("*").alias("__n"))
    limit = counts.agg(F.sum("__n").alias("s")).first().s or 0
    heavy = counts.where(F.col("__n") * buckets > limit).select(*keys)      # at most ``buckets`` rows
    heavy.write.mode("overwrite").parquet(os.path.join(path, "heavy_keys"))
    heavy = F.broadcast(spark.read.schema(heavy.schema).parquet(os.path.join(path, "heavy_keys")).withColumn("__heavy", F.lit(True)))
    marked = df.join(heavy, keys, "left").withColumn("__heavy", F.coalesce("__heavy", ~_no_null(keys))).select(*df.columns, "__heavy")
    marked.where("__heavy").drop("__heavy").write.mode("overwrite").parquet(os.path.join(path, "heavy"))
    light = _bucket_table(os.path.join(path, "light"))
    spark.sql(f"DROP TABLE IF EXISTS {light}")
    (marked.where("NOT __heavy").drop("__heavy").repartition(buckets, *keys).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).option("path", os.path.join(path, "light")).saveAsTable(light))
    layout = spark.createDataFrame([(keys, buckets, df.schema.json())], "keys array<string>, buckets int, schema string")
    layout.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "layout"))
    return path


def load_bucketed(spark: SparkSession, directory: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(light, heavy): the bucketed part of a stage table and the rows beside it."""
    path = os.path.join(directory, name)
    layout = spark.read.parquet(os.path.join(path, "layout")).first()
    schema = T.StructType.fromJson(json.loads(layout.schema))
    light, keys = _bucket_table(os.path.join(path, "light")), ", ".join(f"`{k}`" for k in layout["keys"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {light} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
              f"INTO {layout.buckets} BUCKETS LOCATION '{os.path.join(path, 'light')}'")
    return spark.table(light).select(schema.names), spark.read.schema(schema).parquet(os.path.join(path, "heavy"))


def _no_null(keys: list[str]) -> "F.Column":
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _bucket_table(path: str) -> str:
    """A catalogue name for a bucketed folder; the catalogue only remembers its layout."""
    return "cpelink_" + hashlib.md5(path.encode()).hexdigest()


def load_stage(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A stage table; its schema keeps the types of columns that it is partitioned by (and their order)."""
    path = os.path.join(directory, name)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path).select(schema.names)


#: Rows of one export file: compressed text cannot be split, so that its size bounds what a reading task gets.
EXPORT_FILE_ROWS = 2_000_000
#: Lines of one item that are written as one value.
EXPORT_RECORD_ROWS = 20


def export_raw_csv(df: DataFrame, path: str, compression: str = "gzip", products: DataFrame | None = None) -> None:
    """Full host x vulnerability table, '|' separated, UTF-8, header, no index column.

    An item has a row for each vendor of its title, one after the other, with the same host:
    plain text (``compression="none"``) takes some nineteen times the disk (tables 3 times sf0.1).

    With ``products``, the table is that of ``rollup.folded_hosts_with_vulns`` and ``df`` its items.
    All its rows are written as lines of the same text, but what an item and a product add to them
    is formatted once for each; the files are then named ``.txt``, with the ending of the compression.
    """
    if products is None:
        (df.write.mode("overwrite").option("header", True).option("sep", SEP).option("compression", compression)
         .option("maxRecordsPerFile", EXPORT_FILE_ROWS).csv(path))
        return
    names = [c for c in df.columns if c != RU.TIMES] + RU.product_columns(products)
    records = max(1, EXPORT_FILE_ROWS // EXPORT_RECORD_ROWS)
    # a task's rows are numbered as they are written: each file starts with the header
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % records == 0
    header = _csv_text([F.lit(c).alias(c) for c in names])
    (_export_records(df, products).select(F.when(first, F.concat(header, F.lit("\n"), "value")).otherwise(F.col("value")).alias("value"))
     .write.mode("overwrite").option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", records).text(path))
    if df.sparkSession.read.text(path).isEmpty():       # nor a header then
        export_raw_csv(RU.unfold(df, products).select(names).limit(0), path, compression)


def _csv_text(columns) -> "F.Column":
    """The columns as Spark writes them to CSV files, in one line without its end."""
    return F.to_csv(F.struct(*columns), {"sep": SEP})


def _export_records(items: DataFrame, products: DataFrame) -> DataFrame:
    """The lines of folded items and products, up to ``EXPORT_RECORD_ROWS`` of an item in one ``value``."""
    few = products.count() <= RU.LISTED_PRODUCTS
    # after an empty column: a tail starts with the separator, and is quoted as in the middle of a line
    tails = products.select(*RU.PRODUCT_KEYS, _csv_text([F.lit(None).cast("string"), *RU.product_columns(products)]).alias("tail"))
    lists = RU.product_lists(tails)
    piece, size = EXPORT_RECORD_ROWS, F.size(RU.NESTED)
    pieces = F.transform(F.sequence(F.lit(1), size, F.lit(piece)), lambda k: F.slice(F.col(RU.NESTED).getField("tail"), k, F.lit(piece)))
    lists = lists.select(*RU.PRODUCT_KEYS, F.explode(pieces).alias("tails"))
    heads = items.drop(RU.TIMES)
    heads = heads.select(*RU.PRODUCT_KEYS, _csv_text(heads.columns).alias("head"))
    lines = F.transform("tails", lambda tail: F.concat("head", tail))
    return heads.join(F.broadcast(lists) if few else lists, RU.PRODUCT_KEYS, "inner").select(F.array_join(lines, "\n").alias("value"))


def export_json_reports(reports: dict[str, DataFrame], directory: str) -> dict[str, str]:
    """Each report as JSON lines, written by as many tasks as Spark gives it."""
    out = {}
    for name, df in reports.items():
        path = os.path.join(directory, name)
        df.write.mode("overwrite").json(path)
        out[name] = path
    return out


# --- writers used to land fixture data in the original file formats ---------------

def write_dump(df: DataFrame, path: str, sep: str = SEP) -> str:
    """UTF-16LE, CRLF, header; the inverse of :func:`read_dump`."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-16LE")
     .option("lineSep", "\r\n").csv(path))
    return path


def xml_escape(c) -> "F.Column":
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                               F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _el(tag: str, value) -> "F.Column":
    """``<tag>value</tag>``, or null (skipped by concat_ws) when the value is null."""
    return F.concat(F.lit(f"<{tag}>"), xml_escape(value), F.lit(f"</{tag}>"))


CPE_ROOT = ('<cpe-list xmlns="http://cpe.mitre.org/dictionary/2.0" '
            'xmlns:cpe-23="http://scap.nist.gov/schema/cpe-extension/2.3">', "</cpe-list>")
NVD_ROOT = ('<nvd xmlns="http://scap.nist.gov/schema/feed/vulnerability/2.0" '
            'xmlns:vuln="http://scap.nist.gov/schema/vulnerability/0.4" '
            'xmlns:cvss="http://scap.nist.gov/schema/cvss-v2/0.2">', "</nvd>")


#: Elements of one XML document (some 600 bytes each).
DOCUMENT_ROWS = 50_000


def _write_xml_lines(lines: DataFrame, path: str, root: tuple[str, str]) -> str:
    """Write one XML document per partition: declaration and root around the row lines.

    A document is read by one task, so that more than ``DOCUMENT_ROWS`` rows are dealt to several.
    """
    rows = lines.count()
    if rows > DOCUMENT_ROWS:
        lines = lines.repartition(-(-rows // DOCUMENT_ROWS))
    return write_lines(lines, path, "<?xml version='1.0' encoding='UTF-8'?>\n" + root[0], root[1])


def write_lines(lines: DataFrame, path: str, head: str, tail: str | None = None) -> str:
    """Write one text file per partition: the lines between a head and a tail."""
    import pandas as pd

    def wrap(batches):
        yield pd.DataFrame({"value": [head]})
        for b in batches:
            yield b
        if tail is not None:
            yield pd.DataFrame({"value": [tail]})

    lines.mapInPandas(wrap, "value string").write.mode("overwrite").text(path)
    return path


def write_cpe_xml(shape: DataFrame, path: str) -> str:
    """Catalogue rows (XML row shape) as ``<cpe-item>`` elements, one per line."""
    titles = F.array_join(F.transform(F.col("title"), lambda t: F.concat(
        F.lit('<title xml:lang="'), xml_escape(t["_xml:lang"]), F.lit('">'), xml_escape(t["_VALUE"]),
        F.lit("</title>"))), "")
    attrs = F.concat_ws(
        "", F.concat(F.lit(' name="'), xml_escape(F.col("_name")), F.lit('"')),
        F.concat(F.lit(' deprecated="'), xml_escape(F.col("_deprecated")), F.lit('"')),
        F.concat(F.lit(' deprecation_date="'), xml_escape(F.col("_deprecation_date")), F.lit('"')))
    line = F.concat_ws(
        "", F.concat(F.lit("<cpe-item"), attrs, F.lit(">")), titles,
        F.concat(F.lit('<cpe-23:cpe23-item name="'), xml_escape(F.col("`cpe-23:cpe23-item`._name")), F.lit('"/>')),
        F.lit("</cpe-item>"))
    return _write_xml_lines(shape.select(line.alias("value")), path, CPE_ROOT)


def write_cve_xml(shape: DataFrame, path: str) -> str:
    """Feed rows (XML row shape) as ``<entry>`` elements, one per line."""
    prods = F.col("`vuln:vulnerable-software-list`.`vuln:product`")
    plist = F.when(prods.isNotNull(), F.concat(
        F.lit("<vuln:vulnerable-software-list>"),
        F.array_join(F.transform(prods, lambda p: _el("vuln:product", p)), ""),
        F.lit("</vuln:vulnerable-software-list>")))
    m = "`vuln:cvss`.`cvss:base_metrics`"
    metrics = F.concat_ws("", *[_el(f.name, F.col(f"{m}.`{f.name}`")) for f in _BASE_METRICS.fields])
    cvss = F.when(F.col("`vuln:cvss`").isNotNull(), F.concat(
        F.lit("<vuln:cvss><cvss:base_metrics>"), metrics, F.lit("</cvss:base_metrics></vuln:cvss>")))
    line = F.concat_ws(
        "", F.concat(F.lit('<entry id="'), xml_escape(F.col("_id")), F.lit('">')), plist,
        _el("vuln:cve-id", F.col("`vuln:cve-id`")),
        _el("vuln:last-modified-datetime", F.col("`vuln:last-modified-datetime`")), cvss, F.lit("</entry>"))
    return _write_xml_lines(shape.select(line.alias("value")), path, NVD_ROOT)
