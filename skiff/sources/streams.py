"""Byte streams: rows (conn_id, seq, data) of chunks, decoded in order of seq for each connection.

A decoder is an object with feed(bytes) -> rows and finish() -> rows; it keeps only what is unfinished, so how a stream is
chunked never changes its rows. In batch, a connection's chunks stream through one task, one at a time."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_ROWS = 1000


def decode(chunks: DataFrame, start: Callable[[], object], schema: str) -> DataFrame:
    """conn_id, then the decoder's columns (a struct's fields in schema)."""
    kind = T._parse_datatype_string(f"conn_id bigint, {schema}")
    out = to_arrow_type(kind)
    rows = chunks.select("conn_id", "seq", "data").repartition("conn_id").sortWithinPartitions("conn_id", "seq")

    def run(batches):
        now, decoder, held = None, None, []

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], out.field(i).type) for i in range(out.num_fields)], names=[f.name for f in out])
            held.clear()
            return made

        for b in batches:
            for conn, data in zip(b.column("conn_id").to_pylist(), b.column("data"), strict=True):
                if decoder is None or conn != now:
                    if decoder is not None:
                        held += [(now, *r) for r in decoder.finish()]
                    now, decoder = conn, start()
                held += [(conn, *r) for r in decoder.feed(data.as_py() or b"")]
                if len(held) >= BATCH_ROWS:
                    yield flush()
        if decoder is not None:
            held += [(now, *r) for r in decoder.finish()]
        if held:
            yield flush()

    return rows.mapInArrow(run, f"conn_id bigint, {schema}")
