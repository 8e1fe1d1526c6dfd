"""Lines over TCP as a streaming source and sink, with offsets, retries and a note of what was sent.

    spark.dataSource.register(SocketLines)
    spark.readStream.format("eventweir_tcp").option("host", h).option("port", p).option("spool", folder).load()
    stream.writeStream.format("eventweir_tcp").option("host", h).option("port", p).option("ledger", folder).start()

Folders are URIs that pyarrow knows, which all machines reach.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

#: Lines that are sent, acknowledged and noted at once.
CHUNK = 500


class SocketLines(DataSource):
    """Column value, a line each. Options: host, port; retries and delay (seconds between them) of connecting; for reading: spool, a folder,
    and wait, for how many seconds without data a batch waits; for writing (lines that are not empty): ledger, a folder, and acknowledged: the other side
    answers each empty line, which ends a chunk, with a line of its own."""

    @classmethod
    def name(cls) -> str:
        return "eventweir_tcp"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return LinesIn(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return LinesOut(dict(self.options))


class Connection:
    """A socket that is opened when it is needed, and again when it has failed."""

    def __init__(self, options: dict):
        self.to = options["host"], int(options["port"])
        self.retries, self.delay = int(options.get("retries", 100)), float(options.get("delay", 5))
        self.open: socket.socket | None = None

    def get(self) -> socket.socket:
        for _ in range(self.retries):
            if self.open is not None:
                return self.open
            try:
                self.open = socket.create_connection(self.to, timeout=30)
            except OSError:
                time.sleep(self.delay)
        raise ConnectionError(f"no connection to {self.to} after {self.retries} tries")

    def drop(self) -> None:
        if self.open is not None:
            self.open.close()
        self.open = None


class Folder:
    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root, recursive=True)

    def names(self) -> list[str]:
        return sorted(i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.root)) if i.is_file and not i.base_name.startswith("."))

    def read(self, name: str) -> str | None:
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """Under another name first, so that a file that is there is whole."""
        with self.fs.open_output_stream(f"{self.root}/.{name}") as f:
            f.write(text.encode())
        self.fs.move(f"{self.root}/.{name}", f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")


class LinesIn(SimpleDataSourceStreamReader):
    """The offset is the number of lines read so far. Lines go to the spool, a file per batch, before a batch has them, so a batch can be read
    again after a failure; committed ones are deleted. One connection reads, on the driver."""

    def __init__(self, options: dict):
        self.connection, self.folder, self.wait = Connection(options), Folder(options["spool"]), float(options.get("wait", 0.2))
        self.rest = b""

    def initialOffset(self) -> dict:
        return {"line": 0}

    def _spooled(self, start: int, end: int | None = None) -> list[str]:
        found = []
        for name in self.folder.names():
            first = int(name)
            lines = self.folder.read(name).split("\n")[:-1]
            if first + len(lines) > start and (end is None or first < end):
                found += lines[max(start - first, 0) : None if end is None else end - first]
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["line"]
        lines = self._spooled(at)
        if not lines and (lines := self._received()):
            self.folder.write(f"{at:020}", "".join(f"{x}\n" for x in lines))
        return iter([(x,) for x in lines]), {"line": at + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self._spooled(start["line"], end["line"])])

    def commit(self, end: dict) -> None:
        for name in self.folder.names():
            if int(name) + self.folder.read(name).count("\n") <= end["line"]:
                self.folder.delete(name)

    def _received(self) -> list[str]:
        """What has come since; a connection that has ended is opened anew with the next batch."""
        got = [self.rest]
        try:
            own = self.connection.get()
            own.settimeout(self.wait)
            while data := own.recv(1 << 16):
                got.append(data)
            self.connection.drop()
        except TimeoutError:
            pass
        except OSError:
            self.connection.drop()
        *lines, self.rest = b"".join(got).split(b"\n")
        if self.connection.open is None and self.rest:  # the last line of a connection need not end
            lines, self.rest = [*lines, self.rest], b""
        return [x.decode("utf-8", "replace").rstrip("\r") for x in lines]


class LinesOut(DataSourceStreamWriter):
    """Each partition of a batch sends its lines in chunks, and notes in the ledger how many have gone. A batch that is run again skips what
    was noted, so it is not sent twice; with acknowledged chunks, one that a broken connection has swallowed is sent again.

    A chunk may come twice only if its task is lost between the answer and the note. The rows of a partition must come the same way again,
    as they do from sources with offsets; sort them before writing otherwise.
    """

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        folder, connection = Folder(self.options["ledger"]), Connection(self.options)
        name = f"{context.getLocalProperty('streaming.sql.batchId')}-{context.partitionId()}"
        sent, lines = int(folder.read(name) or 0), []
        skip = sent

        def send() -> None:
            nonlocal sent
            self._send(connection, lines)
            sent += len(lines)
            folder.write(name, str(sent))
            lines.clear()

        for row in iterator:
            if skip:
                skip -= 1
                continue
            lines.append(row[0] or "")
            if len(lines) == CHUNK:
                send()
        if lines:
            send()
        connection.drop()
        return WriterCommitMessage()

    def _send(self, connection: Connection, lines: list[str]) -> None:
        acknowledged = str(self.options.get("acknowledged", "false")).lower() == "true"
        data = "".join(f"{x}\n" for x in lines).encode() + (b"\n" if acknowledged else b"")
        for _ in range(connection.retries):
            own = connection.get()
            try:
                own.sendall(data)
                if not acknowledged or own.makefile("rb").readline().endswith(b"\n"):
                    return
            except OSError:
                pass
            connection.drop()
            time.sleep(connection.delay)
        raise ConnectionError(f"could not send to {connection.to}")

    def commit(self, messages: list, batchId: int) -> None:
        """Notes of earlier batches are no longer needed."""
        folder = Folder(self.options["ledger"])
        for name in folder.names():
            if int(name.split("-")[0]) < batchId:
                folder.delete(name)

    def abort(self, messages: list, batchId: int) -> None:
        """The notes stay: the batch is run again from them."""
