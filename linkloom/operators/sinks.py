"""Finding records as JSON, text or bare payloads, and append sinks per host."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FINDING_COLUMNS
from ..session import materialized
from .joins import lookup_join

HOST_FILES = 8
FILE_BYTES = 128 << 20

# The label of a kind in text output, where it differs from the kind.
_LABELS = {"aws": "aws-s3", "raw": "Raw"}


def json_line() -> Column:
    """A finding as one JSON object, fields in record order."""
    return F.to_json(F.struct(*FINDING_COLUMNS))


def text_lines(with_length: bool = False) -> Column:
    """A finding as text lines; a subdomain is two."""
    label = F.col("kind")
    for kind, shown in _LABELS.items():
        label = F.when(F.col("kind") == kind, shown).otherwise(label)
    label = F.when(F.col("type") == "linkfinder", "linkfinder").otherwise(label)
    plain = F.concat(F.lit("["), label, F.lit("] - "), F.col("output"))
    code = F.concat(F.lit("[url] - [code-"), F.col("status").cast("string"), F.lit("] - "))
    if with_length:
        code = F.concat(code, F.lit("[len_"), F.col("length").cast("string"), F.lit("] - "))
    hosts = F.transform(
        F.array(F.lit("http://"), F.lit("https://")), lambda s: F.concat(F.lit("[subdomains] - "), s, F.col("output"))
    )
    return (
        F.when(F.col("kind") == "url", F.array(F.concat(code, F.col("output"))))
        .when(F.col("kind") == "subdomains", hosts)
        .otherwise(F.array(plain))
    )


def formatted(found: DataFrame, style: str = "text", with_length: bool = False) -> DataFrame:
    """Findings as ``line``; JSON wins over quiet, quiet over text."""
    if style == "json":
        return found.withColumn("line", json_line())
    if style == "quiet":
        return found.withColumn("line", F.col("output"))
    return found.withColumn("line", F.explode(text_lines(with_length)))


def host_key(host: Column) -> Column:
    """File name of a seed host."""
    return F.replace(F.replace(host, F.lit("."), F.lit("_")), F.lit("/"), F.lit("_"))


def write_by_host(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Append ``line`` under one folder per seed host.

    Rows are spread by host and a hash of the line, so that a host with most of
    the findings is written by several tasks and no host gets a file per task.
    """
    spread = lines.repartition(F.col("host_key"), F.pmod(F.xxhash64("line"), F.lit(HOST_FILES)))
    spread.select("host_key", "line").write.mode(mode).partitionBy("host_key").text(path)


def append_by_host(lines: DataFrame, path: str, run: str, file_bytes: int = FILE_BYTES) -> None:
    """Append the lines of one run under a folder per seed host, in files of about ``file_bytes``.

    The bytes of each host are measured first; a host is cut by a hash of its lines into as many files as it needs, so
    small hosts get one file and a host with most of the findings is written by many tasks. A run owns
    its folder: the same run again replaces what it wrote and adds nothing. Lines of no host go to ``_``.
    """
    lines = materialized(lines.select(F.coalesce("host_key", F.lit("_")).alias("host_key"), "line"))
    sizes = lines.groupBy("host_key").agg(F.ceil(F.sum(F.octet_length("line") + 1) / file_bytes).cast("int").alias("files"))
    dealt = lookup_join(lines, sizes, "host_key").withColumn("_file", F.pmod(F.xxhash64("line"), F.col("files")))
    whole = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // file_bytes))
    dealt.repartition(parts, F.xxhash64("host_key", "_file")).select("host_key", "line").write.mode("overwrite").partitionBy("host_key").text(f"{path}/run={run}")


def read_by_host(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """``line, run, host_key`` of all runs; of one host only its folders are read."""
    lines = spark.read.schema("line string, run string, host_key string").text(path)
    return lines if host is None else lines.where(F.col("host_key") == host)


def raw_bodies(bodies: DataFrame) -> DataFrame:
    """Decoded bodies of in-scope responses as raw records."""
    return bodies.select("seed_id", "page_id", "url", F.concat(F.lit("[Raw] - \n"), "decoded", F.lit("\n")).alias("line"))


