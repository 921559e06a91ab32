"""Server-sent events as a stream: the same events however the log grows, and after a restart."""

import random

import pytest

from lorebase.sources.documents import EventFeed
from lorebase.sources.events import ServerSentEvents, _Reader

LOG = b"".join(f"event: delta\ndata: {{\"n\": {k}}}\ndata: café {k}\n\n".encode() if k % 3 else f": ping\r\nevent: stop\r\ndata: {k}\r\n\r\n".encode() for k in range(60)) + b"event: open\ndata: unfinished"


def consume(spark, path, where, **options):
    out = []
    stream = spark.readStream.format("sse").options(path=str(path), **options).load()
    query = stream.writeStream.foreachBatch(lambda df, n: out.extend((r.event, r.data) for r in df.collect())).trigger(once=True).option("checkpointLocation", str(where)).start()
    query.awaitTermination()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_a_restart_give_the_same_events(spark, tmp_path, seed):
    spark.dataSource.register(ServerSentEvents)
    log, rng, got, at = tmp_path / "log", random.Random(seed), [], 0
    log.write_bytes(b"")
    for cut in [*sorted(rng.sample(range(1, len(LOG)), 5)), len(LOG)]:  # each time a new query goes on from the checkpoint
        with log.open("ab") as f:
            f.write(LOG[at:cut])
        at = cut
        got += consume(spark, log, tmp_path / "c")
    want = EventFeed().feed(LOG)
    assert got == want and len(want) == 60
    assert consume(spark, log, tmp_path / "c") == []
    with log.open("ab") as f:
        f.write(b"\n\n")
    assert consume(spark, log, tmp_path / "c") == [("open", "unfinished")]


def test_batches_end_with_blocks(tmp_path):
    log = tmp_path / "log"
    log.write_bytes(LOG)
    reader, got, start, spans = _Reader({"path": str(log), "maxBytes": "100"}), [], reader_start(), 0
    while (end := reader.latestOffset()) != start:
        for part in reader.partitions(start, end):
            got += list(reader.read(part))
        start, spans = end, spans + 1
    assert got == EventFeed().feed(LOG) and spans > 10
    assert _Reader({"path": f"file://{log}"}).latestOffset() == start
    long = tmp_path / "long"
    long.write_bytes(b"data: " + b"x" * 550 + b"\n\ndata: " + b"y" * 60 + b"\n\n")
    reader = _Reader({"path": str(long), "maxBytes": "100"})
    first = reader.latestOffset()
    assert [len(d) for _, d in reader.read(reader.partitions({"at": 0}, first)[0])] == [550]
    with pytest.raises(ValueError, match="absolute"):
        _Reader({"path": "log"}).latestOffset()


def reader_start():
    return {"at": 0}
