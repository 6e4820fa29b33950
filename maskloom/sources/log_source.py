"""Logs as a data source: `spark.read.format("log_lines")`, and `readStream` for logs that go on arriving.

Partitions are byte ranges whose borders are moved to line ends, and tasks give Arrow batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from maskloom.config import MASKED_LOG_ENDING
from maskloom.sources import store
from maskloom.sources.ranges import line_pieces

FORMAT = "log_lines"
#: A piece of a file: its URL, first byte and end, length that counts, and whether a line begins at the first byte.
Piece = tuple[str, int, int, int, bool]


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)


def dealt(files: Sequence[tuple[str, int, int]], range_bytes: int, open_bytes: int) -> list[Pieces]:
    """Partitions over (URL, first byte, length) of files, of about range_bytes, where a file costs open_bytes besides its own."""
    partitions, some, weight = [], [], 0
    for url, first, length in files:
        for start in range(first, length, range_bytes):
            piece = (url, start, min(start + range_bytes, length), length, start == first)
            cost = piece[2] - start + open_bytes
            if some and weight + cost > range_bytes:
                partitions.append(Pieces(some))
                some, weight = [], 0
            some.append(piece)
            weight += cost
    return partitions + ([Pieces(some)] if some else [])


def lines_of(partition: Pieces) -> Iterator[pa.RecordBatch]:
    for url, start, end, length, begins in partition.value:
        name = url.rpartition("/")[2]
        for _, data in line_pieces(url, start, end, begins, length):
            lines = [line.rstrip(b"\r\n") for line in data.splitlines(keepends=True)]
            yield pa.record_batch([pa.array(lines, pa.binary()), pa.repeat(pa.scalar(name), len(lines))],
                                  names=["value", "source_file"])


def wanted(url: str, extensions: Sequence[str]) -> bool:
    """Whether a file is a log with one of the extensions, and not an earlier output."""
    name = url.rpartition("/")[2].lower()
    dot = name.rfind(".")
    return dot >= 0 and name[dot:] in extensions and not name.endswith(MASKED_LOG_ENDING)


class LogSource(DataSource):
    """Options: path, a folder; extensions, a JSON list; and for streams state, a folder, and max_files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value binary, source_file string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArrivingReader(self.options)


class Listing:
    def __init__(self, options):
        self.folder, self.extensions = options["path"], json.loads(options["extensions"])
        self.sizes = int(options.get("range_bytes", 128 << 20)), int(options.get("open_bytes", 4 << 20))

    def entries(self) -> list[store.Entry]:
        found = [e for e in store.children(self.folder) if e.kind == "file" and wanted(e.url, self.extensions)]
        return sorted(found, key=lambda e: (e.time, e.url))


class FolderReader(DataSourceReader):
    """The logs right in a folder, once."""

    def __init__(self, options):
        self.listing = Listing(options)

    def partitions(self) -> list[InputPartition]:
        return dealt([(e.url, 0, e.size) for e in self.listing.entries()], *self.listing.sizes)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)


class SeenFiles:
    """What has been taken up of which file: a folder of numbered entries, each a list of (URL, first byte, length, time).

    An entry is whole or not there, and is written before Spark hears of its number; what Spark remembers is
    a number only.
    """

    def __init__(self, folder: str):
        self.folder, self.lengths, self.n = folder, {}, 0

    def _url(self, number: int) -> str:
        return f"{self.folder.rstrip('/')}/{number:012d}.json"

    def entry(self, number: int) -> list[list]:
        opened, path = store.store_of(self._url(number))
        with opened.open_input_file(path) as stream:
            return json.loads(stream.read())

    def load(self) -> None:
        numbers = [int(e.url.rpartition("/")[2].removesuffix(".json")) for e in store.children(self.folder) if e.url.endswith(".json")]
        for number in range(self.n + 1, max(numbers, default=0) + 1):
            self.lengths.update((url, length) for url, _, length, _ in self.entry(number))
            self.n = number

    def add(self, files: list[list]) -> None:
        store.make_folder(self.folder)
        draft = f"{self._url(self.n + 1)}.{uuid.uuid4().hex}"
        opened, path = store.store_of(draft)
        with opened.open_output_stream(path) as stream:
            stream.write(json.dumps(files).encode())
        store.move(draft, self._url(self.n + 1))
        self.lengths.update((url, length) for url, _, length, _ in files)
        self.n += 1


class ArrivingReader(DataSourceStreamReader):
    """The logs right in a folder and those that arrive, each byte once; a log that has grown is read on.

    A log that has become shorter is taken for another one and read from its start.
    """

    def __init__(self, options):
        self.listing, self.seen = Listing(options), SeenFiles(options["state"])
        self.max_files = int(options.get("max_files", 0))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.seen.load()
        found = []
        for e in self.listing.entries():
            known = self.seen.lengths.get(e.url, 0)
            if e.size != known:
                found.append([e.url, known if e.size > known else 0, e.size, e.time])
        if found:
            self.seen.add(found[:self.max_files or None])
        return {"n": self.seen.n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [(url, first, length) for number in range(start["n"] + 1, end["n"] + 1)
                 for url, first, length, _ in self.seen.entry(number)]
        return dealt(files, *self.listing.sizes)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        """Entries stay: they tell which files have been read."""
