"""The lines of byte ranges of files: each line belongs to the range it begins in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from maskloom.sources.store import store_of

#: Bytes that are read at a time; more for a line longer than that.
PIECE = 1 << 22
#: How often a range that can't be read is tried.
TRIES = 3
_LINE_END = re.compile(rb"\r\n|\n|\r")
_BOM = b"\xef\xbb\xbf"


def open_at(url: str, offset: int):
    """The file of a URL, opened for reading from an offset on."""
    store, path = store_of(url)
    stream = store.open_input_file(path)
    stream.seek(offset)
    return stream


def _first_line(data: bytes, at: int, ended: bool) -> int:
    """Where the first line begins in data at `at` or behind it, -1 if that isn't in data. A last \\r may go on with \\n."""
    if at <= 0:
        return 0
    found = _LINE_END.search(data, at - 1)
    if found is None or (not ended and found[0] == b"\r" and found.end() == len(data)):
        return -1
    return found.end()


def line_pieces(url: str, start: int, end: int, begins: bool = False, limit: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of runs of whole lines that begin in [start, end), without a byte order mark at the file's start.

    Lines end with \\n, \\r\\n or \\r. One byte before the range tells whether a line begins at its start; with `begins`,
    one does whatever stands before. Nothing is read from `limit` on.
    """
    inside = begins or start == 0
    at = start if inside else start - 1
    with open_at(url, at) as stream:
        data, ended = b"", False
        while not ended:
            most = max(PIECE, len(data))
            piece = stream.read(most if limit is None else min(most, limit - at - len(data)))
            ended = not piece
            data += piece
            if not inside:
                first = _first_line(data, start - at, ended)
                if first < 0:
                    kept = data[-1:] if data.endswith(b"\r") else b""
                    at, data, start = at + len(data) - len(kept), kept, at + len(data) - len(kept) + 1
                    continue
                at, data, inside = at + first, data[first:], True
            if at >= end:
                return
            cut = len(data) if ended else max(data.rfind(b"\n"), data.rfind(b"\r", 0, len(data) - 1)) + 1
            last = _first_line(data[:cut], end - at, True) if at + cut >= end else -1
            if last >= 0:
                cut, ended = last, True
            lines, bare = data[:cut], at == 0 and data.startswith(_BOM)
            if lines:
                yield (at + len(_BOM), lines[len(_BOM):]) if bare else (at, lines)
            at, data = at + cut, data[cut:]


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the ranges (part_path, start, end and any columns), each with its offset as line_id.

    A range that can't be read gives a row without a value and with the error as `problem`, behind the
    lines that could be read: one file that fails doesn't stop the others.
    """
    for batch in batches:
        for n in range(batch.num_rows):
            row = {name: batch.column(name)[n] for name in batch.schema.names}
            rest = {name: value for name, value in row.items() if name not in ("start", "end")}
            url, start, end = (row[name].as_py() for name in ("part_path", "start", "end"))
            done, tries = start, 0
            while True:
                try:
                    for offset, data in line_pieces(url, done, end):
                        yield _lines(rest, offset, data)
                        done = offset + len(data)
                    break
                except OSError as error:
                    tries += 1
                    if tries == TRIES:
                        yield _row(rest, str(error) or type(error).__name__)
                        break


def _lines(rest: dict[str, pa.Scalar], offset: int, data: bytes) -> pa.RecordBatch:
    lines = data.splitlines(keepends=True)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    starts = offset + np.concatenate([[0], ends[:-1]])
    values = pa.array([line.rstrip(b"\r\n") for line in lines], pa.binary())
    return pa.record_batch([*(pa.repeat(value, len(lines)) for value in rest.values()), pa.array(starts), values,
                            pa.nulls(len(lines), pa.string())], names=[*rest, "line_id", "value", "problem"])


def _row(rest: dict[str, pa.Scalar], problem: str) -> pa.RecordBatch:
    return pa.record_batch([*(pa.repeat(value, 1) for value in rest.values()), pa.nulls(1, pa.int64()),
                            pa.nulls(1, pa.binary()), pa.array([problem])], names=[*rest, "line_id", "value", "problem"])
