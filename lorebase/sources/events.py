"""Server-sent events as a streaming source: a log of bytes that grows, read in whole blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .documents import EventFeed

#: Bytes read at once to find the end of the last whole block.
STEP = 1 << 16


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    """Offsets are bytes. A batch ends with a block, so what a block holds is never split, wherever the log was cut when it was read."""

    def __init__(self, options: dict):
        self.where, self.most = options["path"], int(options.get("maxBytes", 1 << 26))
        self.at = 0

    def _file(self):
        if "://" not in self.where and not self.where.startswith("/"):
            raise ValueError("path must be absolute")
        return fs.FileSystem.from_uri(self.where) if "://" in self.where else (fs.LocalFileSystem(), self.where)

    def _bytes(self, start: int, end: int) -> bytes:
        place, path = self._file()
        with place.open_input_file(path) as f:
            return f.read_at(end - start, start)

    def _ended(self, start: int, size: int) -> int:
        """The end of the last whole block between ``start`` and ``size``; a block longer than a batch is read whole."""
        end = min(size, start + self.most)
        while True:
            at = end
            while at > start:
                low = max(start, at - STEP)
                piece = self._bytes(low, min(end, at + 3))  # two line ends may lie across
                if (k := max(piece.rfind(b"\n\n") + 2 if b"\n\n" in piece else 0, piece.rfind(b"\r\n\r\n") + 4 if b"\r\n\r\n" in piece else 0)) > 0:
                    return low + k
                at = low
            if end == size:
                return start
            end = min(size, end + self.most)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        place, path = self._file()
        info = place.get_file_info(path)
        self.at = self._ended(self.at, info.size or 0)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["at"])
        return [_Span(start["at"], end["at"])] if end["at"] > start["at"] else []

    def read(self, partition: _Span) -> Iterator[tuple]:
        feed, at = EventFeed(), partition.start
        while at < partition.end:
            end = min(partition.end, at + STEP)
            yield from feed.feed(self._bytes(at, end))
            at = end

    def commit(self, end: dict) -> None:
        pass


class ServerSentEvents(DataSource):
    """``spark.readStream.format("sse").option("path", ...)`` -> (event, data), after ``spark.dataSource.register``.

    ``path`` is a log that a client of the stream appends to, in a file system that driver and executors
    share; ``maxBytes`` bounds a batch. After a restart the checkpoint's offset tells where to go on.
    """

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "event string, data string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
