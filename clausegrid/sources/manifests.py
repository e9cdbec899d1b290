"""Corpus manifests in JSON lines, and the files they describe."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clausegrid.functions import text as T

REQUIRED = ("circular_number", "title", "issue_date", "department", "doc_type", "source_url", "pdf_filename")
OPTIONAL = ("page_url", "retrieved_on", "sha256", "note")
#: Bytes of a file that a task holds while hashing it.
HASHED_AT_ONCE = 1 << 20
MANIFEST = S.StructType([S.StructField(name, S.StringType()) for name in REQUIRED + OPTIONAL])


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(value) JSON lines → entries with a parsed issue date; blank lines are skipped."""
    rows = lines.where(T.strip(F.col("value")) != "").select(F.from_json("value", MANIFEST).alias("e"))
    return rows.select("e.*").withColumn("parsed_date", F.try_to_timestamp("issue_date", F.lit("yyyy-MM-dd")).cast("date"))


def manifest_scan(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def manifest_lines(entries: DataFrame) -> DataFrame:
    """Entries as JSON lines: required fields keep their nulls, optional ones are left out when null."""
    required = F.to_json(F.struct(*REQUIRED), {"ignoreNullFields": "false"})
    optional = F.to_json(F.struct(*OPTIONAL))
    both = F.when(
        optional != "{}",
        F.concat(F.regexp_replace(required, r"\}$", ","), F.regexp_replace(optional, r"^\{", "")),
    ).otherwise(required)
    return entries.select(both.alias("value"))


def manifest_sink(entries: DataFrame, path: str) -> None:
    manifest_lines(entries).write.mode("overwrite").text(path)


def document_scan(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files under ``path`` and in its folders with size and checksum, empty ones too.

    The driver sees the folders only: each is listed in a task, and the files are dealt over tasks that hash them
    in pieces. Names that begin with a dot or an underscore are no documents.
    """
    system, root = pafs.FileSystem.from_uri(path)
    inside = [f.path for f in system.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                files = [f for f in system.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File]
                names = [f.path for f in files if fnmatchcase(f.base_name, glob) and f.base_name[0] not in "._"]
                yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            sizes, sums = [], []
            for name in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(name, compression=None) as content:
                    while piece := content.read(HASHED_AT_ONCE):
                        digest.update(piece)
                        size += len(piece)
                sizes.append(size)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["path", "bytes", "checksum"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([(f,) for f in [root, *inside]], "folder string").repartition(min(parts, len(inside) + 1))
    files = folders.mapInArrow(listed, "path string").repartition(parts, "path").mapInArrow(hashed, "path string, bytes long, checksum string")
    return files.select(F.substring_index("path", "/", -1).alias("filename"), "bytes", "checksum")


def write_files(files: DataFrame, path: str) -> None:
    """(filename, content): every row becomes a file under ``path``, in the task that holds it.

    A filename may begin with a folder. Each file is written under a name of its attempt and moved into place, so that one that is written
    again after a failure is whole and there once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        made = {""}
        for batch in batches:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist()):
                folder, slash, base = name.rpartition("/")
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                part = f"{root}/{folder}{slash}.{base}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(content or b"")
                system.move(part, f"{root}/{name}")
            yield batch.select(["filename"])

    files.select("filename", "content").mapInArrow(run, "filename string").write.format("noop").mode("overwrite").save()


def attach_metadata(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with their manifest entry; a file without one is named after its stem."""
    stem = F.translate(F.regexp_replace("filename", r"\.[^.]*$", ""), "_", "/")
    entries = manifest.withColumnRenamed("pdf_filename", "filename")
    joined = files.join(entries, "filename", "left")
    return joined.withColumns(
        {"circular_number": F.coalesce("circular_number", stem), "title": F.coalesce("title", stem)}
    )


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per entry: verified, missing, or changed since its checksum was recorded."""
    held = files.select(F.col("filename").alias("pdf_filename"), F.col("checksum").alias("__held"))
    status = (
        F.when(F.col("__held").isNull(), "missing")
        .when(~F.col("__held").eqNullSafe(F.col("sha256")), "changed")
        .otherwise("verified")
    )
    return manifest.join(held, "pdf_filename", "left").select("pdf_filename", status.alias("status"))


def verification_totals(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("n"))


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the first reason): one bad record never stops the batch."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in checks.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def split_sink(rows: DataFrame, checks: dict[str, Column], good_path: str, bad_path: str) -> None:
    """Writes the rows that pass all checks to one place and the others, with the reason, to another."""
    good, bad = quarantine(rows, checks)
    good.write.mode("overwrite").parquet(good_path)
    bad.write.mode("overwrite").parquet(bad_path)


def parse_isolated(
    lines: DataFrame, fields: dict[str, str], required: tuple[str, ...] = (), date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """(value, …) JSON lines → the other columns, ``fields`` with their types, and ``reason``, null where all is well.

    A line that cannot be read fails alone: it is ``not JSON``, has ``no <field>`` though that is required, or its
    ``<field> is no <type>``; the first of these in the order of the fields is given. Types are Spark's names; dates
    must exist and follow ``date_format``. Fields that could be read keep their values beside a reason.
    """
    raw = S.StructType([*(S.StructField(f, S.StringType()) for f in fields), S.StructField("__bad", S.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    rest = [c for c in lines.columns if c != "value" and c not in fields]
    read = lines.select(*rest, F.from_json("value", raw, options).alias("__row"))

    def typed(name: str) -> Column:
        text = F.col(f"__row.{name}")
        if fields[name] == "date":
            return F.try_to_timestamp(text, F.lit(date_format)).cast("date")
        return text.try_cast(fields[name])

    reasons = [F.when(F.col("__row").isNull() | F.col("__row.__bad").isNotNull(), "not JSON")]
    for name, kind in fields.items():
        absent = F.col(f"__row.{name}").isNull()
        if name in required:
            reasons.append(F.when(absent, f"no {name}"))
        reasons.append(F.when(~absent & typed(name).isNull(), f"{name} is no {kind}"))
    return read.select(*rest, *(typed(f).alias(f) for f in fields), F.coalesce(*reasons).alias("reason"))


def isolated_sink(parsed: DataFrame, path: str) -> None:
    """Writes parsed rows in one pass, those with a reason apart: ``outcome=good`` and ``outcome=bad`` under ``path``."""
    outcome = F.when(F.col("reason").isNull(), "good").otherwise("bad")
    parsed.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(path)
