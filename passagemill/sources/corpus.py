"""Corpus sources: a folder of Markdown files, or the document table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import reduce
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.session import persist_table

#: Folders that a task of the listing keeps to itself, and rows that leave it at once.
DESCENDED, LISTED_ROWS = 1_000, 10_000
#: Files that a task reads about, and files and bytes that leave it at once.
TASK_FILES, READ_FILES, READ_BYTES = 5_000, 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table; a single file is one split, so its rows are spread over the cores."""
    documents = table(spark, sf_dir, "documents")
    if len(documents.inputFiles()) > 1:
        return documents
    return documents.repartition(spark.sparkContext.defaultParallelism, "doc_id")


def scan_corpus(spark: SparkSession, root: str, extensions: tuple[str, ...] = K.CORPUS_EXTENSIONS) -> DataFrame:
    """Files under ``root`` as ``(source_path, content, content_hash)``; paths are relative to it.

    Bytes that are no UTF-8 become replacement characters; the hash is over the raw bytes. Names that Spark's file listing hides
    (see ``hidden``) are left out. A file that is deleted between listing and reading is left out, too.

    Tasks list the folders and read the files, so the driver holds no path. A store that the tasks cannot open themselves is read
    by Spark, whose driver holds its listing.
    """
    skipped = F.exists(F.split("source_path", "/"), lambda part: part.isin(*K.SKIPPED_NAMES))
    wanted = F.lower("source_path").rlike(r"\.(" + "|".join(extensions) + ")$")
    listed = listed_files(spark, root) if opened_by_tasks(root) else None
    files = spark_files(spark, root).where(wanted & ~skipped) if listed is None else read_files(listed.where(wanted & ~skipped), root)
    return files.select(
        "source_path", F.expr("make_valid_utf8(cast(content AS string))").alias("content"), F.sha2("content", 256).alias("content_hash")
    )


def spark_files(spark: SparkSession, root: str) -> DataFrame:
    """``source_path`` and ``content`` of all files, listed and read by Spark."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    files = reader.load(root)
    base = root.rstrip("/")
    # Listed paths are URIs; what follows the root folder is the relative path.
    relative = F.expr("substring(path, instr(path, base) + length(base) + 1)")
    return files.withColumn("base", F.lit(base.removeprefix("file://"))).select(relative.alias("source_path"), "content")


def opened_by_tasks(root: str) -> bool:
    """Whether ``root`` is one folder in a store that Arrow opens by its URI."""
    if set(root) & set("*?[]{}\\" + ("%#" if ":" in root else "")):
        return False
    try:
        store, base = arrow_fs.FileSystem.from_uri(root)
        return store.get_file_info(base).type == arrow_fs.FileType.Directory
    except (ValueError, OSError, pa.ArrowException):
        return False


def hidden(name: str) -> bool:
    """Whether Spark's listing leaves out a file or folder of this name; names that are no text have no path in it."""
    if not name.isascii() and name.encode(errors="ignore").decode() != name:
        return True
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def folder_entries(store: arrow_fs.FileSystem, path: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder that are not hidden, and whether they are folders; nothing if it is gone."""
    if isinstance(store, arrow_fs.LocalFileSystem):
        with suppress(FileNotFoundError, NotADirectoryError), os.scandir(path) as entries:
            yield from ((entry.name, entry.is_dir()) for entry in entries if not hidden(entry.name) and (entry.is_dir() or entry.is_file()))
        return
    for info in store.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)):
        if not hidden(info.base_name) and info.type in (arrow_fs.FileType.Directory, arrow_fs.FileType.File):
            yield info.base_name, info.type == arrow_fs.FileType.Directory


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """``source_path`` of the files under ``root``, written to the scratch folder.

    A task descends into the folders that it finds, up to ``DESCENDED`` at once; more are dealt to the tasks of a further round.
    """
    schema = pa.schema([("source_path", pa.string()), ("folder", pa.bool_())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(root)
        found: list[tuple[str, bool]] = []
        for batch in batches:
            for start in batch["source_path"].to_pylist():
                waiting = [start]
                while waiting:
                    here = waiting.pop()
                    for name, folder in folder_entries(store, f"{base}/{here}" if here else base):
                        path = f"{here}/{name}" if here else name
                        if folder and len(waiting) < DESCENDED:
                            waiting.append(path)
                            continue
                        found.append((path, folder))
                        if len(found) >= LISTED_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*found)], schema=schema)
                            found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*found)], schema=schema)

    folders, rounds = spark.createDataFrame([("",)], "source_path string"), []
    while not rounds or not folders.isEmpty():
        dealt = folders.repartition(4 * spark.sparkContext.defaultParallelism, "source_path") if rounds else folders.coalesce(1)
        rounds.append(persist_table(dealt.mapInArrow(kernel, "source_path string, folder boolean"), "listing"))
        folders = rounds[-1].where("folder").select("source_path")
    return reduce(DataFrame.unionByName, rounds).where(~F.col("folder")).select("source_path")


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """``source_path`` and ``content``, the bytes, of listed files. A batch holds a bounded number of files and bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(root)
        names: list[str] = []
        contents: list[bytes] = []
        size = 0

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["source_path", "content"])

        for batch in batches:
            for name in batch["source_path"].to_pylist():
                try:
                    with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                        contents.append(stream.read())
                except FileNotFoundError:
                    continue
                names.append(name)
                size += len(contents[-1])
                if len(names) >= READ_FILES or size >= READ_BYTES:
                    yield held()
                    names, contents, size = [], [], 0
        if names:
            yield held()

    tasks = max(4 * listed.sparkSession.sparkContext.defaultParallelism, listed.count() // TASK_FILES)
    return listed.repartition(tasks, "source_path").mapInArrow(kernel, "source_path string, content binary")


def write_files(rows: DataFrame, root: str, text_col: str, *folders: str) -> None:
    """One text file for each value of the columns ``folders``, under folders ``name=value``; what ``root`` held before is replaced.

    A row is a line, a null text an empty one. Tasks write the files themselves, under hidden names until they are whole: a Spark
    writer would open one writer, and have its committer move one folder, for each file.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(place, True)
    store.mkdirs(place)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = arrow_fs.FileSystem.from_uri(root)
        lines = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        written = 0
        for values, own in groupby(lines, key=lambda row: row[:-1]):
            names = [quote(value, safe=" ") if value else "__HIVE_DEFAULT_PARTITION__" for value in values]
            folder = "/".join([base, *(f"{name}={value}" for name, value in zip(folders, names))])
            files.create_dir(folder, recursive=True)
            hidden = f"{folder}/_{uuid.uuid4().hex}"
            with files.open_output_stream(hidden, compression=None) as stream:
                for row in own:
                    stream.write((row[-1] or "").encode() + b"\n")
            files.move(hidden, f"{folder}/part.txt")
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    keys = [F.nullif(F.col(name).cast("string"), F.lit("")).alias(name) for name in folders]
    dealt = rows.select(*keys, F.col(text_col).alias("_text")).repartition(*folders).sortWithinPartitions(*folders)
    dealt.mapInArrow(kernel, "files bigint").agg(F.sum("files")).first()


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha2("content", 256))


def table_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table under the corpus contract."""
    return with_hash(
        texts(spark, sf_dir).select(
            F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_path"),
            F.col("text").alias("content"),
        )
    )


def library_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table under paths that show every naming convention, one per language."""
    month = F.lpad((1 + F.col("n_chars") % 12).cast("string"), 2, "0")
    day = F.lpad((1 + F.col("n_chars") % 28).cast("string"), 2, "0")
    doc = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("lang") == "en", F.concat("source", F.lit("-reports/2025-"), month, F.lit("-item-"), doc, F.lit(".md")))
        .when(
            F.col("lang") == "fr",
            F.concat(
                F.lit("guides/"), "source", F.lit("/note-"), doc, F.lit("-v"),
                (1 + F.col("n_chars") % 9).cast("string"), F.lit(".markdown"),
            ),
        )
        .when(
            F.col("lang") == "de",
            F.concat("source", F.lit("-"), doc, F.lit("-4."), (F.col("n_chars") % 10).cast("string"), F.lit(".md")),
        )
        .otherwise(F.concat(F.lit("meeting-notes/2025-"), month, F.lit("-"), day, F.lit("_"), doc, F.lit(".md")))
    )
    return with_hash(
        texts(spark, sf_dir).select(
            "doc_id", "source", "lang", "n_chars", path.alias("source_path"), F.col("text").alias("content")
        )
    )


def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library texts as Markdown: front matter, title, sections and, in one language, a code fence."""
    header = F.concat(
        F.lit("---\nowner: \""), "source", F.lit("\"\nlang: "), "lang", F.lit("\nlang: '"), "lang",
        F.lit("'\n# note\n\n  nested: x\nno pair\n---\n"),
    )
    fence = F.lit("\n```sh\n# not a heading\n```\n")
    title = F.concat(F.lit("# Text "), F.col("doc_id").cast("string"), F.lit(" #\n\nStatus: "),
                     F.when(F.col("lang") == "de", "Superseded").when(F.col("lang") == "es", "current").otherwise("open"),
                     F.lit("\n\n## Body\n\n"))
    # Every line becomes a paragraph of the body section.
    body = F.regexp_replace("content", "\n", "\n\n")
    closing = F.concat(F.lit("\n\n### Detail\n\nLength "), F.col("n_chars").cast("string"), F.lit("\n\n## Sign-off\n\nDone.\n"))
    return with_hash(
        library_corpus(spark, sf_dir)
        .withColumn(
            "content",
            F.concat(
                F.when(F.col("lang") == "fr", header).otherwise(""),
                F.when(F.col("lang") == "es", "").otherwise(title),
                body,
                F.when(F.col("lang") == "de", fence).otherwise(""),
                closing,
            ),
        )
        .select("doc_id", "source", "source_path", "content")
    )
