"""Text and compressed files in, per-file outputs out."""

from __future__ import annotations

import codecs
import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions import text as rules
from rankloom.operators import bulk, packed
from rankloom.sources.tables import written

#: Bytes of a file of texts, or of payloads, that a task reads at a time; a block is about as large.
TEXT, PAYLOAD = 1 << 20, 1 << 18
#: Bytes of files that become a partition of blocks, about.
SHARE = 8 << 20


def scan_bytes(spark: SparkSession, path: str | list[str], hidden: bool = False) -> DataFrame:
    """path, content and length of regular files; a folder is not searched below its first level.

    Names that begin with a dot are left out.  Spark leaves out names that begin with an underscore
    too; ``hidden`` reads those as well, file by file, for a folder that the driver can list.
    """
    listed = _listed(spark, path)
    if not hidden:
        rows = spark.read.format("binaryFile").load(path).select("path", "content", "length")
        # Spark's reader makes no row for an empty file.
        empty = [(p, bytearray(), 0) for p, size in listed if not size and not p.rsplit("/", 1)[1].startswith("_")]
        return rows.union(spark.createDataFrame(empty, rows.schema)) if empty else rows
    names = [p for p, _ in listed]
    found = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), 64)))

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(name if "://" in name else "file:///" + name.removeprefix("file:").lstrip("/"))
                with system.open_input_file(inner) as f:
                    raw = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([raw], pa.binary()), pa.array([len(raw)], pa.int64())], ["path", "content", "length"])

    return found.mapInArrow(read, "path string, content binary, length long")


def _listed(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Path and size of the regular files of folders, or files named alone; not those whose name begins with a dot."""
    jvm, out = spark.sparkContext._jvm, []
    for p in [path] if isinstance(path, str) else path:
        where = jvm.org.apache.hadoop.fs.Path(p)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for top in system.globStatus(where) or []:
            found = system.listStatus(top.getPath()) if top.isDirectory() else [top]
            out += [(s.getPath().toString(), s.getLen()) for s in found if s.isFile() and not s.getPath().getName().startswith(".")]
    return sorted(out)


def scan_texts(spark: SparkSession, path: str | list[str], preserve_newlines: bool = False, utf8_only: bool = False) -> DataFrame:
    """path, file_name, file_type, encoding, text, original_size (bytes) and content of each file.

    Bytes are UTF-8, or else Latin-1 as a whole; ``utf8_only`` leaves the text of such a file null.
    """
    rows = scan_bytes(spark, path)
    text = rules.decoded(F.col("content"))
    if utf8_only:
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), text)
    text = text if preserve_newlines else rules.newlines(text)
    return rows.select(
        "path", rules.base_name(F.col("path")).alias("file_name"), rules.file_type(F.col("path")).alias("file_type"),
        rules.encoding_of(F.col("content")).alias("encoding"), text.alias("text"), F.col("length").alias("original_size"), "content",
    )


def scan_payloads(spark: SparkSession, path: str | list[str], suffix: str = ".bin") -> DataFrame:
    """path, file_name (without the suffix) and payload of compressed files."""
    rows = scan_bytes(spark, path).where(F.col("path").endswith(suffix))
    return rows.select("path", F.regexp_replace(rules.base_name(F.col("path")), r"\Q" + suffix + r"\E$", "").alias("file_name"), F.col("content").alias("payload"))


def from_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """A column of strings as a source: its original size is its UTF-8 bytes."""
    return df.withColumn("original_size", F.octet_length(text).cast("long"))


def _place(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _opened(uri: str):
    system, inner = _place(uri)
    return system.open_input_stream(inner, compression=None)


def _direct(uri: str) -> bool:
    """Whether tasks can open a file themselves."""
    try:
        _place(uri)
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def each_file(spark: SparkSession, path: str | list[str], made: Callable[[int, Callable[[], io.RawIOBase]], Iterator[tuple]], schema: str) -> tuple[DataFrame, int]:
    """path and what ``made`` yields (tuples of ``schema``) of each file that ``scan_bytes`` reads, and the bytes of all files.

    ``made`` gets a file's size and a way to open it, and reads it piece by piece: a task holds no file as a whole.  Files in a
    store that only Spark reads come as whole rows.
    """
    names = (lambda p: p.rsplit("/", 1)[1])
    listed = sorted((x for x in _listed(spark, path) if not names(x[0]).startswith("_") and not names(x[0]).endswith("._COPYING_")), key=lambda x: -x[1])
    n = max(1, min(len(listed), 1 << 12))
    if all(_direct(p) for p, _ in listed[:1]):
        found = spark.createDataFrame(spark.sparkContext.parallelize(listed, n), "path string, length long")
    else:
        found = scan_bytes(spark, path).select("path", "length", "content").repartition(n)
    whole = T.StructType([T.StructField("path", T.StringType()), *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(whole)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, size = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                opened = (lambda: _opened(name)) if batch.num_columns < 3 else (lambda: io.BytesIO(batch.column(2)[i].as_py()))  # noqa: B023
                for row in made(size, opened):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, *row), arrow)], schema=arrow)

    return found.mapInArrow(run, whole), sum(size for _, size in listed)


def _pieces(f, size: int) -> Iterator[bytes]:
    while piece := f.read(size):
        yield piece


def _is_utf8(f, size: int) -> bool:
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for piece in _pieces(f, size):
            decoder.decode(piece)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return True


def _normal(f, utf8: bool, size: int) -> Iterator[tuple[bytes, bool]]:
    """A file's text as UTF-8 with newlines normalised, piece by piece, and whether these are the file's bytes."""
    held = b""
    for piece in _pieces(f, size):
        piece = held + piece
        held = b"\r" if piece.endswith(b"\r") else b""  # a line feed may follow
        piece = piece[: len(piece) - len(held)]
        own = utf8 and b"\r" not in piece
        piece = piece if utf8 else piece.decode("latin-1").encode()
        yield piece if own else piece.replace(b"\r\n", b"\n").replace(b"\r", b"\n"), own
    if held:
        yield b"\n", False


def _in_blocks(pieces: Iterator[tuple[bytes, bool]], least: int, cut: Callable[[bytes], int]) -> Iterator[tuple[bytes, bool]]:
    """Pieces put together to blocks of at least so many bytes that end where ``cut`` says; one block of nothing for nothing."""
    held, own, want = bytearray(), True, least
    for piece, same in pieces:
        held += piece
        own &= same
        if len(held) >= want:
            at = cut(bytes(held))
            if at:
                yield bytes(held[:at]), own
                del held[:at]
                own = same
            want = max(least, 2 * len(held))
    yield bytes(held), own


def scan_blocks(spark: SparkSession, path: str | list[str], least: int, most: int, utf8_only: bool = False) -> DataFrame:
    """doc_id, no, file_name, encoding, original_size, plain and text: the files of ``scan_texts`` in blocks with the chunks of the whole.

    A file has one block at least, and ends nowhere inside a chunk of ``least`` and ``most``; a text without blank lines or rules is one block.
    doc_id is a hash of the path; plain: whether a block is the file's own bytes.
    """

    def made(size, opened):
        with opened() as f:
            utf8 = _is_utf8(f, TEXT)
        encoding = "utf-8" if utf8 else "latin-1"
        if utf8_only and not utf8:
            yield 0, encoding, size, False, None
            return
        with opened() as f:
            for no, (block, own) in enumerate(_in_blocks(_normal(f, utf8, TEXT), TEXT, lambda x: bulk.closed(x, least, most))):
                yield no, encoding, size, own, block.decode()

    rows, total = each_file(spark, path, made, "no int, encoding string, original_size long, plain boolean, text string")
    rows = rows.select(F.xxhash64("path").alias("doc_id"), "no", rules.base_name(F.col("path")).alias("file_name"), "encoding", "original_size", "plain", "text")
    return _spread(rows, total)


def _spread(rows: DataFrame, total: int) -> DataFrame:
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARE), "doc_id", "no")


def scan_payload_blocks(spark: SparkSession, path: str | list[str], suffix: str = ".bin") -> DataFrame:
    """doc_id, no, file_name (without the suffix) and payload: the files of ``scan_payloads`` in blocks of whole chunks, each with the file's header."""

    def made(size, opened):
        head = b""
        with opened() as f:
            for no, (block, _) in enumerate(_in_blocks(((x, True) for x in _pieces(f, PAYLOAD)), PAYLOAD, packed.last_break)):
                if not no:
                    head = packed.head(int(packed.decode(block, np.array([0, len(block)]))[0][0]))
                yield no, block if not no else head + block.removeprefix(b"\xff")  # a block begins with the break before it

    rows, total = each_file(spark, path, made, "no int, payload binary")
    rows = rows.where(F.col("path").endswith(suffix))
    name = F.regexp_replace(rules.base_name(F.col("path")), r"\Q" + suffix + r"\E$", "")
    return _spread(rows.select(F.xxhash64("path").alias("doc_id"), "no", name.alias("file_name"), "payload"), 8 * total)


def text_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_name and md5 of the text of each file, as ``scan_texts`` has it."""

    def made(size, opened):
        with opened() as f:
            utf8 = _is_utf8(f, TEXT)
        told = hashlib.md5()
        with opened() as f:
            for piece, _ in _normal(f, utf8, TEXT):
                told.update(piece)
        yield (told.hexdigest(),)

    return each_file(spark, path, made, "md5 string")[0].select(rules.base_name(F.col("path")).alias("file_name"), "md5")


#: Folders of an output.
LAYOUT = {"compressed": "Compressed", "results": "Results", "debug": "Debug"}


def output_dirs(spark: SparkSession, root: str, debug: bool = False) -> dict[str, str]:
    """Makes the output folders and returns their paths."""
    out = {k: f"{root.rstrip('/')}/{v}" for k, v in LAYOUT.items() if debug or k != "debug"}
    for p in out.values():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return out


def write_files(df: DataFrame, folder: str, name: str, content: str, suffix: str = "") -> None:
    """One file for each row, named by a column, written by the tasks; the folder must be shared.

    A text column is written as UTF-8.  A file is written beside its place and moved there, so a task that
    runs twice leaves one whole file.
    """
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))

    def write(batches):
        import uuid

        from pyarrow import fs

        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = fs.FileSystem.from_uri(folder if "://" in folder else "file:///" + folder.removeprefix("file:").lstrip("/"))
                system.create_dir(inner, recursive=True)
                part = f"{inner}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(raw or b"")
                system.move(part, f"{inner}/{n}{suffix}")
            yield batch.slice(0, 0)

    rows.mapInArrow(write, rows.schema).count()


def write_parts(df: DataFrame, folder: str, suffix: str = "") -> DataFrame:
    """Files from rows (doc_id, file_name, no, part, between, error): the parts of a document by their number, one after the other; file_name and error of each.

    ``between`` stands before a part that is not the first; a null part is left out.  A document with an error has no file.
    A task holds a part at a time; files are moved to their place as in ``write_files``.
    """
    schema = T._parse_datatype_string("file_name string, error string")

    def write(batches):
        import uuid

        system, inner = _place(folder if "://" in folder or folder.startswith("file:") else f"file:{folder}")
        system.create_dir(inner, recursive=True)
        now, out, at, error, first = None, None, "", None, True

        def ended():
            out.close()
            if error is None:
                system.move(at, f"{inner}/{now[0]}{suffix}")
            else:
                system.delete_file(at)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([error], pa.string())], ["file_name", "error"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, doc, part, between, wrong = (batch.column(c)[i].as_py() for c in ("file_name", "doc_id", "part", "between", "error"))
                if (name, doc) != now:
                    if out:
                        yield ended()
                    now, at, error, first = (name, doc), f"{inner}/.{uuid.uuid4().hex}", None, True
                    out = system.open_output_stream(at, compression=None)
                error = error or wrong
                if part is not None and error is None:
                    out.write(part if first else between + part)
                    first = False
        if out:
            yield ended()

    rows = df.select("file_name", "doc_id", "no", F.col("part").cast("binary").alias("part"), F.col("between").cast("binary").alias("between"), "error")
    return written(rows.repartition("file_name").sortWithinPartitions("file_name", "doc_id", "no").mapInArrow(write, schema))
