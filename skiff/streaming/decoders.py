"""The decoders under Structured Streaming: chunks of (conn_id, seq, data) in, rows out, state kept for each connection.

State is what the decoder has not finished, pickled, and goes when a connection has been silent for idle_ms."""

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNKS = "conn_id bigint, seq bigint, data binary"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Decode(StatefulProcessor):
    def __init__(self, start: Callable[[], object], names: list[str], idle_ms: int | None):
        self.start, self.names, self.idle_ms = start, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("decoder", T.StructType([T.StructField("value", T.BinaryType())]), self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        decoder = pickle.loads(bytes(self.held.get()[0])) if self.held.exists() else self.start()
        for r in sorted(rows, key=lambda r: r.seq):
            for made in decoder.feed(bytes(r.data or b"")):
                yield Row(conn_id=key[0], **{n: dict(v) if n == "headers" and v is not None else v for n, v in zip(self.names, made, strict=True)})
        self.held.update((pickle.dumps(decoder),))

    def close(self) -> None:
        pass


def decode_stream(chunks: DataFrame, start: Callable[[], object], schema: str, idle_ms: int | None = None) -> DataFrame:
    """The streaming form of skiff.sources.streams.decode. Needs the RocksDB state store (STORE)."""
    names = T._parse_datatype_string(schema).names
    return chunks.groupBy("conn_id").transformWithState(_Decode(start, names, idle_ms), f"conn_id bigint, {schema}", "Append", "None" if idle_ms is None else "ProcessingTime")


def read_chunks(spark, path: str, files_per_batch: int = 1) -> DataFrame:
    """Chunk files as a stream; files_per_batch keeps a slow sink from being flooded."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
