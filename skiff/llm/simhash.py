"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of three words joined by a space (repeats count; fewer
words: the whole sequence; none, or a null text: fingerprint zero, linked like any other); bit b is 1 if set in over half
of the shingles' XXH64 (UTF-8, seed 42).

Links: the 64 bits are a ring of four segments of 16. For two fingerprints at most 3 apart, some segment starts a chain
whose first l segments differ by at most 3 * l / 4 bits together, for each l from 1 to 4: by 0, 1, 2 and 3. So a pair is
found from a start i where segment i is equal and segment i + 1 differs by one bit at most. Both are in the bucket's key
(i, segment i, segment i + 1): each fingerprint is filed under its own four keys, and probes those with one bit of the
second segment changed. In a bucket the chain's third sum is checked, then the full distance.

Only distinct fingerprints are compared. A bucket hands on the edges of a spanning forest of its links, never all pairs;
a bucket of over BLOCK fingerprints is worked on in pairs of blocks (common.in_blocks). Copies join their fingerprint's
component by an equi-join.

Cases: repeated documents are each answered; rows with equal ids are one document for component ids; documents whose id is
null link like others, and their group's smallest id that is not null stands for it (null if there is none).
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skiff.llm.common import components, discard, fresh, grouped, in_blocks, local_roots, map_batches, matching, row_function, stored, table, utf8

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in one block of a bucket.
BLOCK = 4096


def fingerprint(text: bytes | None) -> int:
    """As a signed 64-bit integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -SHINGLE].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the 64-bit numbers, as a signed integer."""
    if len(h) < 512:
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.stack([np.bincount(b, minlength=256) for b in h.view(np.uint8).reshape(-1, 8).T])
        ones = (counts @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def filed(prints: DataFrame) -> DataFrame:
    """(key, fp, ring, home) for each distinct fingerprint: under its own four keys (home) and the 64 that it probes."""

    def start():
        flips = np.concatenate([[0], 1 << np.arange(16, dtype=np.uint64)]).astype(np.uint64)

        def work(batch):
            if batch is None or not batch.num_rows:
                return
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(4):
                a, b = (fp >> np.uint64(16 * i)) & np.uint64(0xFFFF), (fp >> np.uint64(16 * ((i + 1) % 4))) & np.uint64(0xFFFF)
                key = (np.uint64(i) << np.uint64(32)) | (a[:, None] << np.uint64(16)) | (b[:, None] ^ flips)
                yield {"key": key.ravel().view(np.int64), "fp": np.repeat(fp, 17).view(np.int64), "home": np.tile(np.arange(17) == 0, len(fp))}

        return work

    return map_batches(prints, "key bigint, fp bigint, home boolean", start)


def _links(key: int, fp: np.ndarray, home: np.ndarray, blk: np.ndarray, lo: int, hi: int) -> np.ndarray | None:
    """For the rows of a bucket (or of two of its blocks): the row that stands for each row's local component."""
    i = key >> 32
    sides = [(np.flatnonzero(home & (blk == x)), np.flatnonzero(blk == y)) for x, y in {(lo, hi), (hi, lo)}]
    third = np.uint64(16 * ((i + 2) % 4))
    chain = (np.uint64(0xFFFF) << np.uint64(16 * ((i + 1) % 4))) | (np.uint64(0xFFFF) << third)
    a, b = [], []
    for at_home, others in sides:
        step = max(1, (1 << 22) // max(1, len(others)))
        for s in range(0, len(at_home), step):
            part = at_home[s : s + step]
            x = fp[part][:, None] ^ fp[others][None, :]
            ok = (np.bitwise_count(x & chain) <= 2) & (np.bitwise_count(x) <= RADIUS) & (x != 0)
            p, q = np.nonzero(ok)
            if len(p):
                local = local_roots(len(fp), part[p], others[q])
                a.append(np.flatnonzero(local != np.arange(len(fp))))
                b.append(local[a[-1]])
    return local_roots(len(fp), np.concatenate(a), np.concatenate(b)) if a else None


def links(prints: DataFrame) -> DataFrame:
    """(u, v): edges that connect distinct fingerprints (column fp) exactly as all pairs at most RADIUS apart would."""

    # each fingerprint becomes 68 rows: small as they are, they are dealt to as many tasks as a shuffle has
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.columns[0])
    rows = in_blocks(filed(prints), "key", "fp", BLOCK, F.max("home"))

    def run(batches):
        def emit(t: pa.Table):
            fp = t["fp"].to_numpy().view(np.uint64)
            root = _links(t["key"][0].as_py(), fp, t["home"].to_numpy(), t["_blk"].to_numpy(), t["_lo"][0].as_py(), t["_hi"][0].as_py())
            if root is None:
                return None
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)

        held = []
        for e in grouped(batches, ("key", "_lo", "_hi"), emit):
            if e is not None:
                held.append(e)
            if len(held) >= 4096:
                yield _edges(held)
                held = []
        if held:
            yield _edges(held)

    return rows.mapInArrow(run, "u bigint, v bigint").where("u <> v").distinct()


def _edges(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in held]), pa.int64()) for k in (0, 1)], names=["u", "v"])


def _start():
    return lambda rows: [(fingerprint(t),) for t in rows]


def _components_of(marked: DataFrame, linked=links) -> DataFrame:
    """marked: (_id, _fp, ...), stored. Adds the columns component (a fingerprint) and component_id. linked gives the edges
    of the distinct fingerprints."""
    groups = stored(marked.groupBy("_fp").agg(F.min("_id").alias("_least")))
    comp = components(linked(groups.select("_fp"))).withColumnRenamed("node", "_fp")
    named = groups.join(comp, "_fp", "left").withColumn("component", F.coalesce("component", "_fp"))
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    return marked.join(named.join(least, "component").select("_fp", "component", "component_id"), "_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint long, component_id): one row for each row of docs; component_id is the smallest id reachable
    over links of fingerprints at most RADIUS bits apart."""
    marked = stored(docs.select(F.col(id_col).alias("_id"), row_function("fp bigint", _start)(utf8(text_col))["fp"].alias("_fp")))
    return _components_of(marked).select(F.col("_id").alias(id_col), F.col("_fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One row of each component: the one with the smallest id (null last), and of those the smallest key of id and text; of
    rows that agree in both, the smallest by the hash of all columns. similarity None: links of fingerprints as above; 0.8: links of
    documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more (see shingles).

    Null and empty texts are told apart as rows, but have one fingerprint. Columns may be of any kind and have any name."""
    if similarity is not None:
        from skiff.llm import shingles

        if similarity != 0.8:
            raise ValueError("similarity is 0.8 or None")
        return shingles.deduplicate(docs, id_col, text_col)
    rows, key = keyed(docs, id_col, text_col)
    marked = stored(rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(key).alias("_key"), row_function("fp bigint", _start)(utf8(f"`{text_col}`"))["fp"].alias("_fp")))
    found = _components_of(marked).select(F.col("_id").alias("id"), F.col("_key").alias("key"), "component")
    return one_of_each(rows, key, found, docs.columns)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with a binary column that tells rows by id and text (128 bits of SHA-256 over both, with their lengths and nulls),
    and that column's name."""
    parts = [F.col(f"`{c}`").cast("string") for c in (id_col, text_col)]
    told = F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("null:")) for p in parts))
    key = fresh(docs, "_key")
    return docs.withColumn(key, F.unhex(F.substring(F.sha2(told, 256), 1, 32))), key


def one_of_each(rows: DataFrame, key: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that stay, with the columns. found: (id, key, component), a row for each row. Only rows of components of several
    rows are dealt out by key; the others stay where they are."""
    groups = stored(found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("w")))
    # rows of components of several, and by the bitmap a few others, which are their components' first ones
    several, _ = matching(found, F.col("component"), groups.where("n > 1").select(F.col("component").alias("key")))
    firsts = groups.select(F.col("w.key").alias("key"), F.lit(True).alias("stays")).distinct()
    judged = stored(several.select("key").distinct().join(firsts, "key", "left").select("key", F.coalesce("stays", F.lit(False)).alias("stays")))
    discard(groups)
    some, others = matching(rows, F.xxhash64(key), judged.select(F.xxhash64("key").alias("key")))
    stays, at = fresh(rows, "_stays"), fresh(rows, "_first")
    some = some.join(judged.select(F.col("key").alias(key), F.col("stays").alias(stays)), key, "left")
    kinds = dict(rows.dtypes)
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`") for c in columns]
    # a row in no group of several that has passed the bitmap is the only one of its key
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*plain)))
    some = some.where(f"{stays} is null or {stays}").withColumn(at, first).where(F.col(at) == 1)
    pick = [F.col(f"`{c}`") for c in columns]
    return others.select(*pick).unionByName(some.select(*pick))


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
