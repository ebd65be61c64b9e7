"""Embedding near-duplicates by lattice hashing.

Each of TABLES random projections takes a unit vector to PARTS blocks of eight dimensions, scaled by CELL, and decodes each to
the nearest point of the E8 lattice; the points together are a cell. A vector is filed under its own cell (home) and probes the
PROBES next nearest cells of each table; two vectors meet where one's home is the other's home or probe. Where they meet, their
cosine is computed in double precision, and they link at the threshold or above. Of random pairs at the threshold 99.97 % meet
(64 dimensions), of random vectors about one pair in 110,000.

Only equal, non-null labels are compared (the label is in the bucket's key, and so is the number of dimensions). Equal
vectors of one label are one representative with a count. A link is counted in one bucket only, the first in a fixed order
of those that both rows are in, which each row's list of keys tells; so buckets return a count for each row and the edges
of a spanning forest, never pairs. A bucket of over BLOCK rows is worked on in pairs of blocks (common.in_blocks).

Cases: a vector that is null, empty, all zero, or holds a null or non-finite component, and any vector whose label is null,
links with nothing and is its own component. Rows are vectors: repeated rows link each other; a component's id is its
smallest id that is not null.
"""

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import components, grouped, hashed, in_blocks, local_roots, map_batches, stored, table

THRESHOLD = 0.98
TABLES, PARTS, PROBES, CELL = 8, 2, 3, 0.7
BLOCK = 2048



def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule: (+-1, +-1, 0...) in all places, and halves with an even number of minuses."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            rows.append(v)
    rows += [[x / 2 for x in s] for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    gap = x[odd] - f[odd]
    worst = np.abs(gap).argmax(1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of D8, or of D8 moved by a half in each dimension."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def projections(dims: int) -> np.ndarray:
    return np.random.default_rng([8, dims]).standard_normal((TABLES, dims, PARTS, 8)) * CELL


def keys_of(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """(n, TABLES, 1 + PROBES) keys: the home, then the probes from the nearest. salt: a number for each row's label."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.uint64)
    for t, p in enumerate(projections(unit.shape[1])):
        # the nearest cells so far, and by how much each is farther than the home
        keys, far = hashed(np.uint64(t * 1000 + unit.shape[1]) ^ salt)[:, None], np.zeros((len(unit), 1))
        for part in range(PARTS):
            z = unit @ p[:, part]
            home = nearest_e8(z)
            more = 2 - 2 * ((z - home) @ ROOTS.T)
            near = np.argpartition(more, PROBES - 1, axis=1)[:, :PROBES]
            points = np.concatenate([home[:, None], home[:, None] + ROOTS[near]], axis=1)
            more = np.concatenate([np.zeros((len(unit), 1)), np.take_along_axis(more, near, 1)], axis=1)
            h = np.full(points.shape[:2], part, np.uint64)
            for d in range(8):
                h = hashed(h ^ (points[:, :, d] * 2).astype(np.int64).view(np.uint64))
            keys = hashed(keys[:, :, None] ^ h[:, None]).reshape(len(unit), -1)
            far = (far[:, :, None] + more[:, None]).reshape(len(unit), -1)
            best = np.argsort(far, axis=1, kind="stable")[:, : 1 + PROBES]
            keys, far = np.take_along_axis(keys, best, 1), np.take_along_axis(far, best, 1)
        out[:, t] = keys
    return out.view(np.int64)


def _start_keys(kind: str):
    def work(batch):
        if batch is None or not batch.num_rows:
            return
        ids, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        lists = batch.column(2)
        dims = np.asarray(pa.compute.list_value_length(lists))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        ends = np.cumsum(dims)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            e = flat[(ends[at] - d)[:, None] + np.arange(d)]
            x = e.astype(np.float64)
            x /= np.abs(x).max(1)[:, None]
            keys = keys_of(x / np.sqrt((x * x).sum(1))[:, None], salt[at]).reshape(len(at), -1)
            yield {"rep": ids[at], "vec": [r.tobytes() for r in e], "keys": [r.tobytes() for r in keys], "list": list(keys)}

    return work


def _verify(t: pa.Table, key: int, kind: str, threshold: float):
    """(rows' ids, links counted, local root ids) of one bucket or pair of its blocks; None without links."""
    n = t.num_rows
    rep, home, blk, weight = t["rep"].to_numpy(), t["home"].to_numpy(), t["_blk"].to_numpy(), t["n"].to_numpy()
    lo, hi = t["_lo"][0].as_py(), t["_hi"][0].as_py()
    vec = [np.frombuffer(v, kind) for v in t["vec"].to_pylist()]
    if len({len(v) for v in vec}) > 1:  # two keys of different dimensions hashed alike
        return None
    x = np.stack(vec).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64).reshape(n, TABLES, 1 + PROBES)
    count, a, b = np.zeros(n, np.int64), [], []
    for p_side, q_side in {(lo, hi), (hi, lo)}:
        ps, qs = np.flatnonzero(home & (blk == p_side)), np.flatnonzero(blk == q_side)
        step = max(1, (1 << 20) // max(1, len(qs)))
        for s in range(0, len(ps), step):
            part = ps[s : s + step]
            i, j = np.nonzero(x[part] @ x[qs].T >= threshold)
            i, j = part[i], qs[j]
            # two homes meet in both orders (lo == hi) or in one for each side: keep the order of ids
            live = (rep[i] != rep[j]) & (~home[j] | (rep[i] < rep[j]))
            i, j = i[live], j[live]
            if not len(i):
                continue
            local = local_roots(n, i, j)
            a.append(np.flatnonzero(local != np.arange(n)))
            b.append(local[a[-1]])
            for c in range(0, len(i), 1 << 16):
                ii, jj = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                own = _first_key(keys, rep, ii, jj) == key
                np.add.at(count, ii[own], weight[jj[own]])
                np.add.at(count, jj[own], weight[ii[own]])
    if not a:
        return None
    return rep, count, rep[local_roots(n, np.concatenate(a), np.concatenate(b))]


def _first_key(keys: np.ndarray, rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first key, by table, where a pair meets: in the home of the smaller id if the other is there, else in the other's."""
    swap = rep[i] > rep[j]
    small, large = np.where(swap, j, i), np.where(swap, i, j)
    out, open_ = np.zeros(len(i), np.int64), np.ones(len(i), bool)
    for t in range(TABLES):
        for a, b in ((small, large), (large, small)):
            home = keys[a, t, 0]
            meets = open_ & (keys[b, t] == home[:, None]).any(1)
            out[meets] = home[meets]
            open_ &= ~meets
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links long, component_id): one row for each row of vectors."""
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    usable = F.coalesce(F.col("label").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = stored(rows.withColumn("vec", F.when(usable, F.col("vec"))))
    reps = stored(rows.where("vec is not null").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    coded = map_batches(reps.select("rep", F.xxhash64("label").alias("salt"), "vec"), "rep bigint, vec binary, keys binary, list array<bigint>", lambda: _start_keys(kind))
    coded = stored(coded.join(reps.select("rep", "n"), "rep"))
    filed = coded.select("rep", F.posexplode("list").alias("_at", "key")).withColumn("home", F.col("_at") % (1 + PROBES) == 0).drop("_at")

    def run(batches):
        for found in grouped(batches, ("key", "_lo", "_hi"), lambda t: _verify(t, t["key"][0].as_py(), kind, threshold)):
            if found is not None:
                live = (found[1] > 0) | (found[2] != found[0])
                yield pa.RecordBatch.from_arrays([pa.array(c[live], pa.int64()) for c in found], names=["rep", "links", "root"])

    found = stored(in_blocks(filed, "key", "rep", BLOCK, F.max("home"), coded.drop("list")).mapInArrow(run, "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    named = reps.join(comp, "rep", "left").join(links, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.where("vec is not null").join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS w FROM e UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u),
c AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
