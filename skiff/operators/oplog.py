"""Mutations as an append-only log, folded into the two indexes.

Log: seq, op (save, remove, move, remove_hash), path, name, new_path, new_name, file_hash, file_size, content_type, file_time,
file_author. A log of saves, removes and moves to targets that no other operation touches folds with aggregations and windows over blocks
of each key. Any other log is replayed in order, in groups of keys that moves connect (and, for a hash that remove_hash names, all
keys that saved it); path_index, phys_index and ref_counts look which of the two a log needs.

ref_count is the number of saves of a hash less its successful removes (overwriting does not lower it); live_refs is the
number of paths that hold it now."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skiff.functions import scalars as S
from skiff.operators.graph import components
from skiff.operators.store import stored

LOG_SCHEMA = (
    "seq bigint, op string, path string, name string, new_path string, new_name string, file_hash string, "
    "file_size bigint, content_type string, file_time string, file_author string"
)
FACTS = ("file_hash", "file_size", "content_type")
#: Numbers of seq in one block of a window, so that a key with very many operations is not one task's.
BLOCK = 1 << 20


def keyed(log: DataFrame) -> DataFrame:
    """The log with its keys; an empty new name stands for the old one. Names with a slash are not entries."""
    name = F.coalesce("name", F.lit(""))
    to = F.when(F.coalesce("new_name", F.lit("")) == "", name).otherwise(F.col("new_name"))
    key = S.index_key(F.coalesce("path", F.lit("")), name)
    to_key = F.when(F.col("op") == "move", S.index_key(F.coalesce("new_path", F.lit("")), to))
    return log.where(~name.contains("/")).withColumn("key", key).withColumn("to_key", to_key)


def is_plain(log: DataFrame) -> bool:
    """Whether the log folds without replay: no remove_hash, and no move to a key that another operation names."""
    k = keyed(log).where(F.col("op").isin("save", "remove", "move"))
    if not log.where("op = 'remove_hash'").isEmpty():
        return False
    targets = k.where("op = 'move'").select(F.col("to_key").alias("key"), F.lit(1).alias("target"))
    if targets.isEmpty():
        return True
    touched = k.select("key", F.lit(0).alias("target")).unionByName(targets).groupBy("key")
    return touched.agg(F.sum("target").alias("targets"), F.count(F.lit(1)).alias("n")).where("targets > 0 and n > 1").isEmpty()


def applied(log: DataFrame) -> DataFrame:
    """For plain logs: each operation with the entry it met (prev_*) and whether it succeeded."""
    facts = ("op", *FACTS, "file_time", "file_author")
    met = keyed(log).withColumn("_b", F.floor(F.col("seq") / BLOCK)).withColumn("_own", F.struct(*facts))
    inside = met.withColumn("_prev", F.lag("_own").over(Window.partitionBy("key", "_b").orderBy("seq")))
    # a block's first operation met the last one of the block before
    ends = met.groupBy("key", "_b").agg(F.max_by("_own", "seq").alias("_last"))
    ends = ends.select("key", "_b", F.lag("_last").over(Window.partitionBy("key").orderBy("_b")).alias("_before"))
    met = inside.join(ends, ["key", "_b"]).withColumn("_prev", F.coalesce("_prev", "_before"))
    met = met.select(*keyed(log).columns, *(F.col(f"_prev.{c}").alias(f"prev_{c}") for c in facts))
    return met.withColumn("applied", (F.col("op") == "save") | (F.coalesce(F.col("prev_op"), F.lit("")) == "save"))


def path_index(log: DataFrame) -> DataFrame:
    """(key, file_hash, file_size, content_type, seq): the live entries; seq is of the operation that put an entry there."""
    if not is_plain(log):
        return replay(log).where("kind = 'path'").select("key", *FACTS, "seq")
    last = keyed(log).groupBy("key").agg(F.max_by(F.struct("op", *FACTS, "seq"), "seq").alias("last"))
    stay = last.where("last.op = 'save'").select("key", *(f"last.{c}" for c in (*FACTS, "seq")))
    moved = applied(log).where("op = 'move' and applied").select(F.col("to_key").alias("key"), *(F.col(f"prev_{c}").alias(c) for c in FACTS), "seq")
    return stay.unionByName(moved)


def deltas(log: DataFrame) -> DataFrame:
    """(file_hash, seq, d, file_size, content_type): what each operation adds to a hash's references."""
    if not is_plain(log):
        return replay(log).where("kind = 'ref'").select("file_hash", "seq", F.col("refs").alias("d"), "file_size", "content_type")
    met = applied(log)
    less = met.where("op = 'remove' and applied").select(
        F.col("prev_file_hash").alias("file_hash"), "seq", F.lit(-1).cast("bigint").alias("d"), F.lit(None).cast("bigint").alias("file_size"), F.lit(None).cast("string").alias("content_type")
    )
    return met.where("op = 'save'").select("file_hash", "seq", F.lit(1).cast("bigint").alias("d"), "file_size", "content_type").unionByName(less)


def phys_index(log: DataFrame) -> DataFrame:
    """(file_hash, file_size, content_type, ref_count): counts over 0; size and type are those of the first save since the
    count was last 0. The running count is summed in blocks of a hash, so that no hash is one task's."""
    rows = deltas(log).withColumn("_b", F.floor(F.col("seq") / BLOCK))
    sums = rows.groupBy("file_hash", "_b").agg(F.sum("d").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("file_hash").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("file_hash", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    run = F.sum("d").over(Window.partitionBy("file_hash", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    began = rows.withColumn("_n", run).join(sums, ["file_hash", "_b"]).withColumn("_n", F.col("_n") + F.col("_before"))
    began = began.withColumn("_first", F.when((F.col("d") == 1) & (F.col("_n") == 1), F.col("seq")))
    out = began.groupBy("file_hash").agg(F.max_by("file_size", "_first").alias("file_size"), F.max_by("content_type", "_first").alias("content_type"), F.sum("d").cast("int").alias("ref_count"))
    return out.where("ref_count > 0")


def ref_counts(log: DataFrame) -> DataFrame:
    """(file_hash, ref_count): phys_index without the facts, and so without windows over hashes."""
    return deltas(log).groupBy("file_hash").agg(F.sum("d").cast("int").alias("ref_count")).where("ref_count > 0")


class State:
    """The sequential meaning of the log, for replay. refs: what operations added to references, as (hash, d, size, type)."""

    def __init__(self):
        self.paths: dict[str, dict] = {}
        self.phys: dict[str, dict] = {}
        self.refs: list[tuple] = []

    def apply(self, op: str, key: str, to_key: str | None, file_hash: str | None, size: int | None, kind: str | None, seq: int = 0) -> bool:
        if op == "save":
            self.paths[key] = {"file_hash": file_hash, "file_size": size, "content_type": kind, "seq": seq}
            self.phys.setdefault(file_hash, {"file_size": size, "content_type": kind, "ref_count": 0})["ref_count"] += 1
            self.refs.append((file_hash, 1, size, kind))
            return True
        if op == "remove_hash":
            held = self.phys.pop(file_hash, None)
            if held is not None:
                self.refs.append((file_hash, -held["ref_count"], None, None))
            return held is not None
        entry = self.paths.get(key)
        if entry is None:
            return False
        if op == "move":
            del self.paths[key]
            self.paths[to_key] = entry | {"seq": seq}
            return True
        held = self.phys.get(entry["file_hash"])
        if held is None:
            return False
        del self.paths[key]
        self.refs.append((entry["file_hash"], -1, None, None))
        held["ref_count"] -= 1
        if held["ref_count"] <= 0:
            del self.phys[entry["file_hash"]]
        return True


def in_groups(log: DataFrame) -> DataFrame:
    """The keyed log with a column _group: the connected component of the operation's key, by moves and, for hashes that
    remove_hash names, by the hash."""
    k = keyed(log)
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    gone = k.where("op = 'remove_hash'").select("file_hash").distinct()
    moves = k.where("op = 'move'").select(node("key", "key").alias("u"), node("key", "to_key").alias("v"))
    saves = k.where("op = 'save'").join(gone, "file_hash", "left_semi").select(node("key", "key").alias("u"), node("hash", "file_hash").alias("v"))
    found = components(moves.unionByName(saves)).withColumnRenamed("component", "_component")
    k = k.withColumn("node", F.when(F.col("op") == "remove_hash", node("hash", "file_hash")).otherwise(node("key", "key")))
    return k.join(found, "node", "left").withColumn("_group", F.coalesce("_component", "node")).drop("node", "_component")


def replay(log: DataFrame, group: str | None = None) -> DataFrame:
    """The state after a log with any moves and remove_hash, as rows (kind, key, file_hash, file_size, content_type, refs, seq): of
    kind path, the live entries; hash, a group's references of a hash; ref, what each operation added to a hash's references.

    group: a column of the log that keeps together all keys that moves connect, and all keys of a hash where remove_hash
    occurs; in_groups() finds them where none is given. Each group's rows stream through one task in order of seq, as
    their meaning is serial; the state held is that group's live entries."""
    rows = keyed(log).withColumn("_group", F.col(group).cast("string")) if group else stored(in_groups(log))
    rows = rows.repartition("_group").sortWithinPartitions("_group", "seq")
    rows = rows.select(F.col("_group").cast("string").alias("g"), "op", "key", "to_key", *FACTS, "seq")
    names = ["kind", "key", "file_hash", "file_size", "content_type", "refs", "seq"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []

        def done():
            if state is not None:
                out.extend(("path", k, v["file_hash"], v["file_size"], v["content_type"], 1, v["seq"]) for k, v in state.paths.items())
                out.extend(("hash", None, k, v["file_size"], v["content_type"], v["ref_count"], None) for k, v in state.phys.items())

        for pdf in batches:
            for g, *op in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if state is None or g != now:
                    done()
                    now, state = g, State()
                state.apply(*op)
                out.extend(("ref", None, h, size, kind, d, op[-1]) for h, d, size, kind in state.refs)
                state.refs.clear()
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        done()
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, "kind string, key string, file_hash string, file_size bigint, content_type string, refs bigint, seq bigint")


def refs_after_replay(state: DataFrame) -> DataFrame:
    """(file_hash, ref_count, live_refs) from replay(): groups that share a hash add up."""
    refs = F.sum(F.when(F.col("kind") == "hash", F.col("refs")).otherwise(0))
    live = F.sum(F.when(F.col("kind") == "path", 1).otherwise(0))
    return state.where("kind <> 'ref'").groupBy("file_hash").agg(refs.alias("ref_count"), live.alias("live_refs"))


def check_moves(requests: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """requests: body (JSON). The four fields and the status that a move request gets: 400 without a required field; with an
    index (file_path, file_name) 404 where the source is not there; else 200. An empty new name stands for the old one."""
    f = {k: S.json_text("body", k) for k in ("old_path", "old_name", "new_path", "new_name")}
    bad = (f["old_path"] == "") | (f["old_name"] == "") | (f["new_path"] == "")
    new_name = F.when(f["new_name"] == "", f["old_name"]).otherwise(f["new_name"])
    out = requests.select("*", *(c.alias(k) for k, c in f.items() if k != "new_name"), new_name.alias("new_name"), F.when(bad, 400).otherwise(200).alias("status"))
    return out if index is None else _sought(out, "old_path", "old_name", index)


def check_deletes(requests: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """requests: query. Decoded path and name, and the status: 400 where either is missing; with an index 404 where the entry is
    not there; else 200."""
    p, n = S.url_decode(S.query_param("query", "path")), S.url_decode(S.query_param("query", "name"))
    out = requests.select("*", p.alias("path"), n.alias("name"), F.when((p == "") | (n == ""), 400).otherwise(200).alias("status"))
    return out if index is None else _sought(out, "path", "name", index)


def _sought(requests: DataFrame, path: str, name: str, index: DataFrame) -> DataFrame:
    """requests with status 404 for 200 where the index has no such entry. Requests that failed already are not joined."""
    there = index.select(S.index_key("file_path", "file_name").alias("_there")).distinct()
    ok = requests.where("status = 200").withColumn("_key", S.index_key(path, name))
    ok = ok.join(there, F.col("_key") == F.col("_there"), "left").withColumn("status", F.when(F.col("_there").isNull(), 404).otherwise(200))
    return ok.select(*requests.columns).unionByName(requests.where("status <> 200"))


def upload_counts(parts: DataFrame) -> DataFrame:
    """(conn_id, request, stored): how many parts each upload request stored; parts without a file name are not stored."""
    return parts.groupBy("conn_id", "request").agg(F.count_if(F.expr("error is null and filename <> ''")).alias("stored"))


def tally(results: DataFrame) -> DataFrame:
    """(succeeded, failed) over results with a status; below 400 is a success."""
    return results.agg(F.count_if(F.col("status") < 400).alias("succeeded"), F.count_if(F.col("status") >= 400).alias("failed"))


def uploads(parts: DataFrame, date: str) -> DataFrame:
    """Save operations (without seq) for uploaded parts (path, filename, content_type, data) on a given day."""
    return parts.where("filename <> ''").select(F.lit("save").alias("op"), S.normalize_path("path").alias("path"), F.col("filename").alias("name"), S.content_hash("data").alias("file_hash"), F.octet_length("data").cast("bigint").alias("file_size"), "content_type", F.lit(date).alias("file_time"), F.lit("").alias("file_author"))
