"""What the operators of this subpackage share: running Python over Arrow batches beside the other columns, words' keys,
bitmaps and splitting hot buckets; tables in the shared folder and connected components come from skiff.operators."""

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skiff.operators.graph import components  # noqa: F401
from skiff.operators.store import discard, new_folder, remove, shared_dir, stored  # noqa: F401

#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256
#: Bytes of an Arrow batch, unless the session says otherwise: whole texts by Spark's 10,000 rows a batch are held many times
#: over, in the JVM outside its heap and in Python.
BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle and broadcast files of steps that are over: it does when the driver collects its garbage,
    which it may not for long while executors' disks fill. For between large steps; it costs the driver about a second.

    Twice, as the first collection still finds the last query's shuffles held."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)


def utf8(column: Column | str) -> Column:
    """The text's UTF-8 bytes; null for null."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def crc_mod(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; the id null counts as an empty text, so its remainder is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def fresh(df: DataFrame, name: str) -> str:
    """name, or a variant of it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(schema: str) -> pa.DataType:
    return to_arrow_type(T._parse_datatype_string(schema))


def row_function(schema: str, start: Callable[[], Callable[[list], Sequence[Sequence]]]) -> Callable[..., Column]:
    """A column function. start() is called once in each worker and gives a function from a list of values
    (bytes, None, or dicts for structs) to one tuple for each of them; schema names the tuple's fields."""
    kind = T._parse_datatype_string(schema)
    out = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for batch in batches:
            parts = []
            for at in range(0, len(batch), SLICE_ROWS):
                rows = work(batch.slice(at, SLICE_ROWS).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], out.field(i).type) for i in range(out.num_fields)], fields=list(out)))
            yield pa.concat_arrays(parts) if parts else pa.array([], out)
        give_back()

    if spark := SparkSession.getActiveSession():
        bound_batches(spark)
    # not deterministic: else the optimizer may run it once for each use of its result
    return F.arrow_udf(run, kind).asNondeterministic()


def give_back() -> None:
    """At a task's end: memory that is free returns to the system, as Python workers live on beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]]) -> DataFrame:
    """mapInArrow with a state of its own in each task. start() gives a function from a batch to dicts of columns
    (lists, arrays); called with None at the end of the task."""
    names = [(f.name, f.type) for f in arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in _then_none(batches):
            for cols in work(batch) or ():
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) if not isinstance(cols[n], pa.Array) else cols[n].cast(t) for n, t in names], names=[n for n, _ in names])
        give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def hashed(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix (splitmix64's finalizer) of each of the uint64 values."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# The bytes between words, and A-Z as a-z; a random factor for each byte and for each place in a piece of text.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64, endpoint=False)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that become arrays at a time (more where a word is longer).
PIECE = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, 2 * PIECE)
        with np.errstate(over="ignore"):
            one, back = np.ones(n, np.uint64), np.ones(n, np.uint64)
            one[1:], back[1:] = _BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))
            _powers["up"], _powers["down"] = np.cumprod(one), np.cumprod(back)
    return _powers["up"], _powers["down"]


def _piece_keys(data: np.ndarray, starts_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' keys in a piece, and where they start; no word goes on over a place in starts_text."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts_text], edge[0], edge[-1] = True, True, True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    at, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space)
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum(_BYTE[data] * up[: len(data)])
        first = np.where(at > 0, sums[at - 1], np.uint64(0))
        return hashed((sums[end] - first) * down[at]), at


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit keys of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, of an array of bytes, one text after the other, and each text's
    number of words. A word's key is a mixed polynomial of its bytes, so no word becomes a Python object."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
    ends = ends - ends[0]
    keys, places, at = [], [], 0
    while at < len(data):
        # to the next text's start after PIECE bytes, or the next space in a long text
        stop = min(len(data), at + PIECE)
        if stop < len(data):
            cut = ends[np.searchsorted(ends, stop, "right") - 1]
            if cut > at:
                stop = int(cut)
            else:
                limit = int(ends[np.searchsorted(ends, stop)])
                while stop < limit and not (gap := _SPACE[data[stop : min(limit, stop + PIECE)]]).any():
                    stop = min(limit, stop + PIECE)
                if stop < limit:
                    stop += int(gap.argmax())
        a, b = np.searchsorted(ends, (at, stop))
        k, p = _piece_keys(data[at:stop], ends[a:b] - at)
        keys.append(k)
        places.append(p + at)
        at = stop
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(keys), np.diff(np.searchsorted(np.concatenate(places), ends))


def bitmap(keys: DataFrame, most: int = 28) -> np.ndarray:
    """A bit for the remainder of each of the column key's longs: 16 to 32 bits a key, 2 ** most bits (32 MB) at most. What
    it leaves out is not there; it only keeps work down, and with more keys than bits it does so less."""
    size = 1 << max(15, min(most, (16 * keys.count()).bit_length()))
    at = F.pmod("key", F.lit(size)) + 1
    out = np.zeros((size >> 15, 4096), np.uint8)
    for r in keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator():
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def matching(rows: DataFrame, by: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose long `by` may be among keys (column key), and the other rows, by a bitmap of keys: all that are
    among them are in the first part, whose join then moves few others. Each part reads rows."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(may_hold(shared.value, b.to_numpy(zero_copy_only=False).view(np.uint64)))

    bound_batches(rows.sparkSession)
    held = F.arrow_udf(run, "boolean")(by)
    return rows.where(held), rows.where(~held)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int = 1 << 18, limit: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole runs of equal keys in ordered batches of numbers, many at a time: columns, and where runs start and end. With a
    limit, a run of more rows may come in pieces, all but the last of which have more than limit rows."""
    held: list[dict[str, np.ndarray]] = []
    size, goal = 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)})
        size += batch.num_rows
        if size < goal:
            continue
        whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        cut = _starts(whole, keys)
        if last := int(cut[-1]):
            yield {k: v[:last] for k, v in whole.items()}, cut
        held, size = [{k: v[last:] for k, v in whole.items()}], size - last
        if limit is not None and size > limit:
            yield held[0], np.array([0, size])
            held, size = [], 0
        goal = max(most, 2 * size)
    if size:
        whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        yield whole, np.append(_starts(whole, keys), size)


def _starts(cols: dict[str, np.ndarray], keys: Sequence[str]) -> np.ndarray:
    return np.append(0, np.flatnonzero(np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])) + 1)


def in_blocks(rows: DataFrame, key: str, member: str, block: int, useful: Column, facts: DataFrame | None = None) -> DataFrame:
    """Deals out buckets for work on the pairs within each. A bucket is the rows of one key. A bucket of up to block rows
    is one task group; a larger one has its rows hashed into m = ceil(rows / block) blocks and becomes m * (m + 1) / 2
    groups, one for each pair of blocks, so that every pair of its rows meets, and in one group only (rows of one block
    meet in the group (i, i)). useful is an aggregate condition on a bucket; other buckets go. facts (by member) join the rows that
    are left, so that rows of no use move without them.

    Spark takes rows that Arrow functions have multiplied for no more than they were made of, and would broadcast them from the
    driver: the joins are sort-merge joins, whatever it guesses.

    Adds _lo, _hi, _blk and orders the rows by (key, _lo, _hi) within partitions dealt by the three."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), useful.alias("_use")).where("_use and _n > 1").select(key, F.ceil(F.col("_n") / block).cast("int").alias("_m"))
    rows = rows.join(sizes.hint("merge"), key)
    if facts is not None:
        rows = rows.join(facts.hint("merge"), member)
    blk = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_m")).cast("int")
    rows = rows.withColumn("_blk", blk).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    rows = rows.withColumn("_lo", F.least("_blk", "_other")).withColumn("_hi", F.greatest("_blk", "_other")).drop("_m", "_other")
    return rows.repartition(key, "_lo", "_hi").sortWithinPartitions(key, "_lo", "_hi")


def grouped(batches: Iterator[pa.RecordBatch | None], keys: Sequence[str], emit: Callable[[pa.Table], object]) -> Iterator:
    """emit(rows) for each run of equal keys in ordered batches; many small runs come as one table when emit takes them one by one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch is None or not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held:
            last = held[-1]
            if any(last.column(last.schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
                yield emit(pa.Table.from_batches(held))
                held = []
        at = 0
        for end in cut:
            held.append(batch.slice(at, end - at))
            yield emit(pa.Table.from_batches(held))
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield emit(pa.Table.from_batches(held))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and edges a-b: the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root
