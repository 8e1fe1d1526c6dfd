"""Lines over TCP: a server that ends connections, a batch that is run twice, a reader that starts again."""

import socket
import threading
import time

import pytest

from eventweir.sources import sockets


class Server(threading.Thread):
    """Takes lines and answers empty ones; ends the connections whose numbers are in drops without an answer to their first chunk."""

    def __init__(self, drops=()):
        super().__init__(daemon=True)
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port, self.drops, self.kept, self.connections = self.socket.getsockname()[1], set(drops), [], 0
        self.start()

    def run(self):
        while True:
            own, _ = self.socket.accept()
            number, self.connections = self.connections, self.connections + 1
            with own, own.makefile("rb") as f:
                chunk = []
                for line in f:
                    if line != b"\n":
                        chunk.append(line.decode().rstrip("\n"))
                        continue
                    if number in self.drops:
                        break
                    self.kept += chunk
                    chunk = []
                    own.sendall(b"ok\n")


@pytest.fixture()
def lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(1400).selectExpr("concat('line ', id) AS value").repartition(3).write.text(path)
    return lambda: spark.readStream.text(path)


def sent(stream, server, tmp_path, check="check"):
    writer = stream.writeStream.format("eventweir_tcp").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / check))
    options = {"host": "127.0.0.1", "port": server.port, "delay": 0.05, "ledger": f"file://{tmp_path}/ledger", "acknowledged": "true"}
    writer.options(**options).start().awaitTermination()


def test_a_dropped_connection_is_made_good(spark, lines, tmp_path):
    spark.dataSource.register(sockets.SocketLines)
    server = Server(drops=[0, 2])
    sent(lines(), server, tmp_path)
    assert sorted(server.kept) == sorted(f"line {k}" for k in range(1400)) and server.connections >= 5


def test_a_batch_that_is_run_again_is_not_sent_again(spark, lines, tmp_path):
    """The same batch number once more, from a checkpoint that has lost its commit: the ledger knows what has gone."""
    spark.dataSource.register(sockets.SocketLines)
    server = Server()
    sent(lines(), server, tmp_path, "one")
    first = len(server.kept)
    (tmp_path / "one" / "commits" / "0").unlink()
    for crc in (tmp_path / "one" / "commits").glob(".0.crc"):
        crc.unlink()
    sent(lines(), server, tmp_path, "one")
    assert first == len(server.kept) == 1400


def serve(texts):
    """A server that gives each connection one text, then ends it."""
    own = socket.create_server(("127.0.0.1", 0))

    def run():
        for text in texts:
            with own.accept()[0] as c:
                c.sendall(text.encode())
        time.sleep(30)

    threading.Thread(target=run, daemon=True).start()
    return own.getsockname()[1]


def test_reader_has_offsets(tmp_path):
    port = serve(["a\nb\nc", "d\ne\n"])
    options = {"host": "127.0.0.1", "port": port, "spool": f"file://{tmp_path}/spool", "delay": 0.05}
    reader = sockets.LinesIn(options)
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["a", "b", "c"] and end == {"line": 3}
    # a reader that starts again finds what was read and not committed
    again = sockets.LinesIn(options)
    assert [r[0] for r in again.read({"line": 0})[0]] == ["a", "b", "c"]
    assert [r[0] for r in again.readBetweenOffsets({"line": 1}, {"line": 3})] == ["b", "c"]
    rows, end = again.read({"line": 3})
    assert [r[0] for r in rows] == ["d", "e"] and end == {"line": 5}
    again.commit({"line": 3})
    assert again.folder.names() == [f"{3:020}"] and [r[0] for r in again.readBetweenOffsets({"line": 3}, {"line": 5})] == ["d", "e"]


def test_stream_of_lines(spark, tmp_path):
    spark.dataSource.register(sockets.SocketLines)
    port = serve(["one\ntwo\n", "three\n"])
    source = spark.readStream.format("eventweir_tcp").option("host", "127.0.0.1").option("port", port).option("spool", f"file://{tmp_path}/spool").option("delay", 0.05).load()
    query = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if any((tmp_path / "out").glob("part-*")) and spark.read.schema("value string").parquet(str(tmp_path / "out")).count() == 3:
                break
    finally:
        query.stop()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "three", "two"]


def test_no_server(tmp_path):
    with pytest.raises(ConnectionError):
        sockets.Connection({"host": "127.0.0.1", "port": 1, "retries": 2, "delay": 0.01}).get()
