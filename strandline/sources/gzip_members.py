"""Lines of gzip files that several tasks read at once.

A gzip file may be a chain of members, each compressed on its own.  Spark reads
such a file in one task; here its bytes are cut into ranges, and a task reads the
members that begin in its range.  Lines may cross members: as with plain text, a
task leaves out what stands before its first line break and reads on, past its end,
through the next one.

A place that looks like the start of a member counts as one only if it unpacks to
its end with the right checksum, and each task checks that the chain it followed
meets the start which the next range will find.  So a cut or damaged member stops
the job.  A file of one member is still one task's work; memory does not depend on
the length of members, only on that of lines.  Lines end with LF or CR LF.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.session import ship

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
RANGE_BYTES = 32 << 20


class DamagedFile(ValueError):
    """A file is no unbroken chain of gzip members."""


@dataclass
class ByteRange(InputPartition):
    path: str
    first: int
    last: int


def unpacked(file, at: int) -> Iterator[bytes]:
    """The text of the member at ``at``, in blocks; the generator's value is where the member ends."""
    file.seek(at)
    member, rest = zlib.decompressobj(31), b""
    while not member.eof:
        piece = rest or file.read(BLOCK)
        text = member.decompress(piece, BLOCK)
        if not piece and not text and not member.eof:
            raise zlib.error("a member is cut short")
        rest = member.unconsumed_tail
        yield text
    return file.tell() - len(member.unused_data)


def sound(file, at: int) -> bool:
    """Whether a whole member begins here."""
    try:
        for _ in unpacked(file, at):
            pass
    except zlib.error:
        return False
    return True


def first_member(file, first: int, last: int) -> int | None:
    """The first place in [first, last) where a whole member begins."""
    at = first
    while at < last:
        file.seek(at)
        block = file.read(min(BLOCK, last - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        while found >= 0:
            if sound(file, at + found):
                return at + found
            found = block.find(MAGIC, found + 1)
        at += BLOCK
    return None


class MemberChain:
    """The text of the members that begin in a range, then of those that follow."""

    def __init__(self, file, path: str, size: int, part: ByteRange):
        self.file, self.path, self.size, self.part = file, path, size, part
        self.at = first_member(file, part.first, part.last)
        if part.first == 0 and self.at != 0:
            raise DamagedFile(f"{path}: no whole member at the start")

    def _member(self) -> Iterator[bytes]:
        try:
            self.at = yield from unpacked(self.file, self.at)
        except zlib.error as error:
            raise DamagedFile(f"{self.path}: member at byte {self.at}: {error}") from error

    def own(self) -> Iterator[bytes]:
        while self.at < min(self.part.last, self.size):
            yield from self._member()
        if self.at < self.size and first_member(self.file, self.part.last, self.at + 1) != self.at:
            raise DamagedFile(f"{self.path}: no whole member at byte {self.at}")

    def following(self) -> Iterator[bytes]:
        while self.at < self.size:
            yield from self._member()


def text_blocks(chain: MemberChain) -> Iterator[bytes]:
    """Blocks of whole lines of a range."""
    if chain.at is None:
        return
    held: list[bytes] = []
    skipping = chain.part.first > 0
    for text in chain.own():
        if skipping:
            if b"\n" not in text:
                continue
            text, skipping = text[text.index(b"\n") + 1 :], False
        end = text.rfind(b"\n") + 1
        if end:
            yield b"".join([*held, text[:end]])
            held, text = [], text[end:]
        held.append(text)
    if skipping:
        return
    for text in chain.following():
        end = text.find(b"\n") + 1
        held.append(text[:end] if end else text)
        if end:
            break
    last = b"".join(held)
    if last:
        yield last


class GzipLinesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.header = str(options.get("header", "false")).lower() == "true"

    def partitions(self) -> list[ByteRange]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        step = self.range_bytes
        return [ByteRange(path, at, min(at + step, size)) for path, size in files for at in range(0, size, step)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.path) as file:
            first_line = self.header and part.first == 0
            for block in text_blocks(MemberChain(file, part.path, file.size(), part)):
                lines = block.decode("utf-8").replace("\r\n", "\n").split("\n")
                if lines[-1] == "":
                    lines.pop()
                lines = lines[1:] if first_line else lines
                first_line = False
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])


class GzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> GzipLinesReader:
        return GzipLinesReader(self.options)


def read_gzip_lines(spark: SparkSession, path: str, header: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per line (column ``value``); ``header`` leaves out the first line of each file.

    ``path`` is a file or a folder, on a file system that pyarrow opens by the same URI.
    """
    ship(spark)
    spark.dataSource.register(GzipLines)
    return spark.read.format("gzip_lines").options(header=header, rangebytes=range_bytes).load(path)


def write_gzip_members(df: DataFrame, path: str, header: str | None = None, lines: int = 100_000) -> None:
    """The column ``value`` as gzip files of many members, a file per partition.

    A file gets its name once it is whole, so a task that runs twice leaves one file.
    """
    ship(df.sparkSession)
    column = df.columns.index("value")

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        name, draft = f"{root}/part-{task.partitionId():06d}.gz", f"{root}/_draft-{task.taskAttemptId()}"
        count = 0
        with system.open_output_stream(draft, compression=None) as out:
            if header is not None:
                out.write(_member(header + "\n"))
            for batch in batches:
                values = batch.column(column)
                for first in range(0, len(values), lines):
                    some = values.slice(first, lines).to_pylist()
                    out.write(_member("".join(f"{v or ''}\n" for v in some)))
                    count += len(some)
        system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    df.mapInArrow(pack, "n long").agg({"n": "sum"}).collect()


def _member(text: str) -> bytes:
    packer = zlib.compressobj(wbits=31)
    return packer.compress(text.encode("utf-8")) + packer.flush()
