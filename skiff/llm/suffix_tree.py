"""LM scoring by a probabilistic suffix tree over words.

Symbols are lower-cased words [^\\x20\\x09-\\x0D]+ and one end of text. The root's distribution is
(c + 0.5) / (N + 0.5 * (V + 1)) from counts c of all training tokens. Contexts of up to ORDERS preceding words (the start of a
text is a word too) are states if they pass both tests: they occur LEAST times, and what follows them diverges from their
suffix's distribution: sum of count * ln(P(next | context) / P(next | suffix)) is at least GAIN for each next symbol kept,
where a next symbol is kept if it follows LEAST times and its probability differs by a factor of RATIO. Kept symbols have
absolutely discounted counts; the rest of a state's mass goes to its suffix's distribution, so every state is smoothed down
to the root. A token is scored in the state of the longest suffix of its history.

Counting: words and grams are 64-bit keys (common.word_keys, and a mix of the keys of a gram's two ends), so two of n
share one with a probability of about n * n / 2 ** 65. Tasks count their own first and deal sorted blocks of keys by key
range. A first pass counts words, and grams of two words by 40 bits of their keys; a second the longer grams, so too, whose grams of
two words may all occur LEAST times; a third counts what those leave, by bitmaps, with its ends.

Sizes: the tests are on counts, so words, states and kept symbols grow with the corpus. They are a table (key, n, value, word)
of what each adds to a token's logarithm: a word its root's, a state its backoff weight, a kept symbol the rest. The NEAR most
frequent of them are broadcast; groups of texts ask the table for the others, range by range, which two bitmaps of them
(32 MB each at most) keep small; a kept symbol is only asked for where its state may be there. Neither changes a result.

Cases: a null text is empty: one token, the end. With no training text, N and V are 0. A text of unknown words has known
probabilities from the root's share for unseen ones. Repeated documents are each answered (and each trained on). A very long
text is read in pieces; its keys are held at once. Ties do not occur: all tests are on each gram's own counts. Columns of docs
that are not asked for are ignored, so their names do not clash.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skiff.llm.common import bitmap, bound_batches, crc_mod, discard, give_back, may_hold, release, stored, table, utf8, word_keys

#: Groups whose sums a task holds (8 kB each); entries that are broadcast at most, at 24 bytes each; documents that ask for the others together (256 at most, as
#: their places take a byte).
SUMS, NEAR, GROUP = 8192, 200_000, 256
#: Parts in which documents are scored one after the other, as their requests are most of what is on disk at a time.
PARTS = 2
ORDERS, GAIN, RATIO, DISCOUNT, LEAST = 4, 3.0, 1.2, 0.5, 3
#: Keys that a task counts before it hands them on, and bytes of text for one range of keys.
HELD, RANGE_BYTES = 4_000_000, 4 << 20
#: Keys of a text's start and end, and of the symbol that stands for a state's own weight.
START, END, STATE = (np.uint64(k) for k in (0x7374617274000001, 0x656E640000000001, 0x7374617465000001))

#: By how many bits a key is shifted for its place in the second bitmap.
TURN = np.uint64(32)

_FIRST, _LAST = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_keys(context: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of the keys of a gram's two ends."""
    with np.errstate(over="ignore"):
        x = context * _FIRST + following * _LAST
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts one after the other, each between a start and an end: the words' keys, their places in their text, and
    where each text begins (one more at the end)."""
    keys, n = word_keys(texts)
    begin = np.append(0, np.cumsum(n + 2))
    out, word = np.empty(begin[-1], np.uint64), np.ones(begin[-1], bool)
    word[begin[:-1]] = word[begin[1:] - 1] = False
    out[begin[:-1]], out[begin[1:] - 1] = START, END
    out[word] = keys
    return out, np.arange(begin[-1]) - np.repeat(begin[:-1], n + 2), begin


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.Array]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.column(0).slice(at, rows)


_zstd: list = []


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers, byte by byte from the highest (the first bytes of all, then the second ones), compressed."""
    if not _zstd:
        _zstd.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _zstd[0].compress(np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), -1).T))


def _numbers(planes: bytes, n: int, kind: str) -> np.ndarray:
    if not _zstd:
        _zstd.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return np.ascontiguousarray(np.frombuffer(_zstd[1].decompress(planes), np.uint8).reshape(-1, n).T).view(f">{kind}").ravel().astype(kind)


def _blocks(order: int, order_by: np.ndarray, columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Columns, sorted by order_by, as one row for each range of its first bits."""
    part = (order_by >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    packed = [pa.array([_planes(c[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]] + (order << bits)), pa.array(np.diff(cut)), *packed], names=["part", "size", *(f"c{i}" for i in range(len(columns)))])


def _dealt(texts: DataFrame, start, kinds: list[str], merge, schema: str, bits: int) -> DataFrame:
    """start() in each task turns texts into batches of _blocks; the blocks of an order's range meet, and merge makes of the
    order and their columns the rows of schema, led by the order."""
    names = [f"c{i}" for i in range(len(kinds))]
    bound_batches(texts.sparkSession)
    made = texts.select("text").mapInArrow(lambda batches: start()(_slices(batches)), "part bigint, size bigint, " + ", ".join(f"{n} binary" for n in names))
    schema = f"order int, {schema}"
    out = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches):
        now, held = None, []

        def done():
            cols = merge(now >> bits, *(np.concatenate([h[i] for h in held]) for i in range(len(kinds))))
            cols = [np.full(len(cols[0]), now >> bits, np.int32), *(c.view(np.int64) if c.dtype == np.uint64 else c for c in cols)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=out)

        for b in batches:
            for k, part in enumerate(b.column(0).to_pylist()):
                if held and part != now:
                    yield done()
                    held = []
                now, n = part, b.column(1)[k].as_py()
                held.append([_numbers(b.column(2 + i)[k].as_py(), n, kind) for i, kind in enumerate(kinds)])
        if held:
            yield done()

    return made.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _held(start):
    """A task's work on slices of texts: start() gives (take, flush); take(texts) returns how many keys it now holds."""

    def begin():
        take, flush = start()

        def work(slices):
            size = 0
            for texts in slices:
                size = take(texts)
                if size > HELD:
                    yield from flush()
                    size = 0
            if size:
                yield from flush()
            give_back()

        return work

    return begin


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one of each, and their sums."""
    by = np.argsort(keys)
    keys = keys[by]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], by[at], np.add.reduceat(n[by], at)


def _counts(texts: DataFrame, orders: list[int], pairs, bits: int) -> DataFrame:
    """(order, key, n): for order 0 all words and ends; for the others the grams of order + 1 words by 40 bits of their keys,
    where those occur LEAST times. pairs: None, or a bitmap by 40 bits of what grams of two words others may be made of."""
    low = np.uint64(24)

    def start():
        held = {order: [] for order in orders}

        def take(texts):
            g, place, _ = laid_out(texts)
            if 0 in held:
                held[0].append(g[place > 0])
            there = None
            for order in range(1, max(orders) + 1):
                g = gram_keys(g[:-1], g[1:])
                if pairs is not None:
                    there = may_hold(pairs.value, g >> low) if order == 1 else there[:-1] & there[1:]
                if order in held:
                    ok = place[order:] >= order
                    held[order].append(g[ok if there is None else ok & there])
            return sum(len(k) for parts in held.values() for k in parts)

        def flush():
            for order, parts in held.items():
                keys = np.concatenate(parts)
                parts.clear()
                keys, n = np.unique(keys if order == 0 else keys >> low, return_counts=True)
                if len(keys):
                    yield _blocks(order, keys if order == 0 else keys << low, [keys, n.astype(np.uint32)], bits)

        return take, flush

    def merge(order, keys, n):
        keys, _, n = _summed(keys, n.astype(np.int64))
        keep = n >= (LEAST if order else 1)
        return keys[keep], n[keep]

    return _dealt(texts, _held(start), ["u8", "u4"], merge, "key bigint, n bigint", bits)


def _gram_counts(texts: DataFrame, heavy, bits: int) -> DataFrame:
    """(order, ctx, next, key, n): the grams that occur LEAST times, with the keys of their first and their last order words.
    heavy: by order, a bitmap of what may (for words by their keys, for grams by 40 bits of them)."""
    low = np.uint64(24)

    def start():
        maps = heavy.value
        held = [[] for _ in maps]

        def take(texts):
            g, place, _ = laid_out(texts)
            there = may_hold(maps[0], g)
            for order in range(1, len(maps)):
                at = np.flatnonzero(there[:-1] & there[1:] & (place[order:] >= order))
                key = gram_keys(g[at], g[at + 1])
                ok = may_hold(maps[order], key >> low)
                at, key = at[ok], key[ok]
                held[order].append((key, g[at], g[at + 1]))
                # the keys of grams that cannot occur often are not asked for
                longer, there = np.zeros(len(g) - 1, np.uint64), np.zeros(len(g) - 1, bool)
                longer[at], there[at] = key, True
                g = longer
            return 3 * sum(len(h[0]) for parts in held for h in parts)

        def flush():
            for order, parts in enumerate(held):
                if parts:
                    key, ctx, following = (np.concatenate([h[i] for h in parts]) for i in range(3))
                    parts.clear()
                    _, at, n = _summed(key, np.ones(len(key), np.uint32))
                    by = at[np.argsort(ctx[at])]
                    counted = np.empty(len(key), np.uint32)
                    counted[at] = n
                    if len(by):
                        yield _blocks(order, ctx[by], [ctx[by], following[by], counted[by]], bits)

        return take, flush

    def merge(order, ctx, following, n):
        keys, at, n = _summed(gram_keys(ctx, following), n.astype(np.int64))
        keep = n >= LEAST
        return ctx[at[keep]], following[at[keep]], keys[keep], n[keep]

    return _dealt(texts, _held(start), ["u8", "u8", "u4"], merge, "ctx bigint, next bigint, key bigint, n bigint", bits)


class Entries:
    """Values by key, in order of keys with an index of their first bits: found in about one step."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, word: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values, self.word = keys[by], values[by], word[by]
        self.bits = max(1, len(keys).bit_length())
        self.bitmap = np.zeros(1 << max(12, self.bits + 1), np.uint8)
        low = self.keys & np.uint64(len(self.bitmap) * 8 - 1)
        np.bitwise_or.at(self.bitmap, low >> np.uint64(3), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
        self.first = np.append(0, np.cumsum(np.bincount((self.keys >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits))).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places among keys that are found, and their places here."""
        asked = np.flatnonzero(may_hold(self.bitmap, keys))
        part = (keys[asked] >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        more = at < end
        asked, at, end = asked[more], at[more], end[more]
        found = []
        while len(asked):
            here = self.keys[at] == keys[asked]
            found.append((asked[here], at[here]))
            at = at + 1
            more = ~here & (at < end)
            asked, at, end = asked[more], at[more], end[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Tree:
    """What is broadcast: the most frequent entries, a bitmap of the others and the bits that tell their ranges, and the number of
    orders that have any."""

    def __init__(self, total: int, kinds: int):
        self.total, self.unit, self.orders = total, total + 0.5 * (kinds + 1), 0
        self.near = Entries(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
        self.far, self.bits = (np.zeros(1 << 12, np.uint8),) * 2, 4

    def may_ask(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be among the entries that are not here."""
        out = may_hold(self.far[0], keys)
        at = np.flatnonzero(out)
        out[at] = may_hold(self.far[1], keys[at] >> TURN)
        return out

    def score(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each text: tokens, known ones, sums of log10 P in the root and in the longest state as far as known here; and the
        keys to look up for the rest, with the text that each belongs to."""
        w, place, begin = laid_out(texts)
        value, base, known = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w), bool)
        where, more = [], []

        def add(keys: np.ndarray, at: np.ndarray, words: bool) -> np.ndarray:
            asked, found = self.near.find(keys)
            value[at[asked]] += self.near.values[found]
            if words:
                base[at[asked]], known[at[asked]] = self.near.values[found], True
            rest = np.ones(len(keys), bool)
            rest[asked] = False
            rest = np.flatnonzero(rest)
            rest = rest[self.may_ask(keys[rest])]
            where.append(at[rest])
            more.append(keys[rest])
            return np.append(asked, rest)

        at = np.flatnonzero(place > 0)
        add(w[at], at, True)
        g = w
        for order in range(1, self.orders + 1):
            at = np.flatnonzero(place[order:] >= order)
            state, g = g[:-1] ^ STATE, gram_keys(g[:-1], g[1:])
            # no state, no symbols of it
            at = at[add(state[at], at + order, False)]
            add(g[at], at + order, False)
        sums = [np.add.reduceat(x, begin[:-1]) if len(begin) > 1 else np.zeros(0, x.dtype) for x in (known.astype(np.int64), base, value)]
        text = np.searchsorted(begin, np.concatenate(where), "right") - 1
        return [np.diff(begin) - 1, *sums], text, np.concatenate(more)


def _grown(counted: DataFrame, known: DataFrame) -> DataFrame:
    """Of an order's grams (ctx, next, key, n), given the one before (key, n, lp): (ctx, key, n, times, lp: ln P(last word | the others),
    value: null unless kept, back: its state's backoff weight or null)."""
    grams = counted.join(known.select(F.col("key").alias("next"), F.col("lp").alias("lq")), "next")
    grams = grams.join(known.select(F.col("key").alias("ctx"), F.col("n").alias("times")), "ctx").withColumn("p", F.log((F.col("n") - DISCOUNT) / F.col("times")))
    keep = F.abs(F.col("p") - F.col("lq")) >= math.log(RATIO)
    over = Window.partitionBy("ctx")
    many, gain = F.count_if(keep).over(over), F.sum(F.when(keep, F.col("n") * (F.col("p") - F.col("lq")))).over(over)
    left = lambda c: F.greatest(1 - F.sum(F.when(keep, F.exp(c))).over(over), F.lit(1e-9))
    back = F.when((many > 0) & (gain >= GAIN * many), F.log(left("p") / left("lq")))
    out = grams.select("ctx", "key", "n", "times", "p", "lq", keep.alias("keep"), back.alias("back"))
    suffix = F.coalesce("back", F.lit(0.0)) + F.col("lq")
    kept = F.col("keep") & F.col("back").isNotNull()
    return out.select("ctx", "key", "n", "times", F.when(kept, F.col("p")).otherwise(suffix).alias("lp"), F.when(kept, F.col("p") - suffix).alias("value"), "back")


def _signed(key) -> int:
    return int(np.uint64(key).view(np.int64))


def train(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of the texts (column text: bytes or null), and the table (key, value, word) of the entries that are not in it."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // RANGE_BYTES).bit_length())
    counts = stored(_counts(texts, [0, 1], None, bits))
    tables = [counts]
    longer = list(range(2, ORDERS + 1))
    if longer:
        pairs = spark.sparkContext.broadcast(bitmap(counts.where("order = 1").select("key")))
        tables.append(stored(_counts(texts, longer, pairs, bits)))
        pairs.destroy()
    release(spark)
    words = counts.where("order = 0").select("key", "n")
    total, kinds, ends = words.agg(F.sum("n"), F.count(F.lit(1)), F.max(F.when(F.col("key") == _signed(END), F.col("n")))).first()
    tree = Tree(total or 0, kinds)
    root = F.log((F.col("n") + 0.5) / F.lit(tree.unit))
    ten = 1 / math.log(10)
    parts = [words.select("key", "n", (root * ten).alias("value"), F.lit(True).alias("word"))]
    known = words.select("key", "n", root.alias("lp"))
    known = known.unionByName(spark.createDataFrame([(_signed(START), ends or 0, 0.0)], known.schema)).where(F.col("n") >= LEAST)
    often = [known, *(tables[min(k, 2) - 1].where(F.col("order") == k) for k in range(1, ORDERS + 1))]
    heavy = spark.sparkContext.broadcast([bitmap(o.select("key")) for o in often])
    found = stored(_gram_counts(texts, heavy, bits))
    heavy.destroy()
    discard(*tables[1:])
    release(spark)
    tables = [counts, found]
    for order in range(1, ORDERS + 1):
        grams = stored(_grown(found.where(F.col("order") == order).drop("order"), known))
        tables.append(grams)
        kept = grams.where("value is not null")
        if kept.isEmpty():
            break
        tree.orders = order
        states = kept.groupBy("ctx").agg(F.max("times").alias("n"), F.max("back").alias("value")).withColumn("key", F.col("ctx").bitwiseXOR(F.lit(_signed(STATE))))
        entries = states.select("key", "n", "value").unionByName(kept.select("key", "n", "value"))
        parts.append(entries.select("key", "n", (F.col("value") * ten).alias("value"), F.lit(False).alias("word")))
        known = grams.select("key", "n", "lp")
        release(spark)
    whole = stored(reduce(DataFrame.unionByName, parts))
    discard(*tables)
    release(spark)
    # the lowest power of two from which on at most NEAR entries occur as often
    room, least = NEAR, 1 << 62
    for power, n in sorted(((r[0], r[1]) for r in whole.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = 1 << power
    near = whole.where(F.col("n") >= least).select("key", "value", "word").toArrow()
    tree.near = Entries(near["key"].to_numpy().view(np.uint64), near["value"].to_numpy(), near["word"].to_numpy())
    far = whole.where(F.col("n") < least).select("key", "value", "word")
    tree.far = bitmap(far), bitmap(far.select(F.shiftrightunsigned("key", int(TURN)).alias("key")))
    tree.bits = max(4, (far.count() >> 16).bit_length())
    return tree, far


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the ranges of their first bits that occur, and where each begins (one more at the end)."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    return part[cut[:-1]], cut


def score(docs: DataFrame, model: tuple[Tree, DataFrame], id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, the extra columns, n_tokens, n_known, base_score, score): one row for each row of docs.

    Documents go in PARTS, told by id and text; all but the last are scored and stored at once, and their shuffle files go. In a part
    they go in groups of GROUP. A group asks for its keys by range, as sorted blocks; where a range's entries and requests
    meet, what they find is summed by document, and a group's sums meet under the group's number."""
    tree, far = model
    shared, bits = docs.sparkSession.sparkContext.broadcast(tree), tree.bits
    bound_batches(docs.sparkSession)
    own = F.struct(F.col(id_col).alias("id"), *(c.alias(k) for k, c in (extra or {}).items()))
    kind = docs.select(own.alias("doc")).schema["doc"].dataType
    # part: a range; grp: a group of documents, or -1 for entries; a, b: keys and whose they are, entries' keys and values, or sums
    block = T.StructType([*T._parse_datatype_string("part bigint, grp bigint, size bigint, a binary, b binary"), T.StructField("docs", T.ArrayType(kind))])
    summed = T.StructType([*T._parse_datatype_string("grp bigint, size bigint, sums binary"), T.StructField("docs", T.ArrayType(kind))])

    def blocks(cut, keys, values, part, grp, docs_type):
        n = len(part)
        a = pa.array([_planes(keys[s:e]) for s, e in zip(cut, cut[1:])], pa.binary())
        b = pa.array([values[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(n, grp)), pa.array(np.diff(cut)), a, b, pa.nulls(n, docs_type)], names=block.names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                some = b.slice(at, GROUP)
                sums, where, keys = shared.value.score(some.column(0))
                grp, doc = some.column(1)[0].as_py(), some.column(2)
                lists = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
                by = np.argsort(keys)
                part, cut = _ranges(keys[by], bits)
                yield blocks(cut, keys[by], where[by].astype(np.uint8), part, grp, lists.type)
                start = pa.array([np.stack([x.astype(np.float64) for x in sums]).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([hash(grp) % (1 << bits)]), pa.array([grp]), pa.array([len(doc)]), start, pa.nulls(1, pa.binary()), lists], names=block.names)
        give_back()

    empty = to_arrow_type(T.ArrayType(kind))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            key, value, word = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
            key = key.view(np.uint64)
            by = np.argsort(key)
            part, cut = _ranges(key[by], bits)
            both = np.empty(len(key), np.dtype([("value", "f8"), ("word", "u1")]))
            both["value"], both["word"] = value[by], word[by]
            yield blocks(cut, key[by], both, part, -1, empty)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, sums, sizes = None, None, {}, {}

        def flush():
            if sums:
                made = [pa.array(list(sums)), pa.array([sizes[g] for g in sums]), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.nulls(len(sums), empty)]
                sums.clear()
                yield pa.RecordBatch.from_arrays(made, names=summed.names)

        for b in batches:
            parts, groups, n = (b.column(i).to_pylist() for i in range(3))
            for k, (part, grp) in enumerate(zip(parts, groups)):
                if part != now:
                    now, table = part, []
                if grp < 0:
                    table.append((_numbers(b.column(3)[k].as_py(), n[k], "u8"), np.frombuffer(b.column(4)[k].as_py(), np.dtype([("value", "f8"), ("word", "u1")]))))
                    continue
                if b.column(5)[k].is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([n[k]]), b.column(3).slice(k, 1), b.column(5).slice(k, 1).cast(empty)], names=summed.names)
                    continue
                if isinstance(table, list):
                    keys = np.concatenate([t[0] for t in table]) if table else np.zeros(0, np.uint64)
                    by = np.argsort(keys)
                    table = keys[by], np.concatenate([t[1] for t in table])[by] if table else None
                if not len(table[0]):
                    continue
                asked, whose = _numbers(b.column(3)[k].as_py(), n[k], "u8"), np.frombuffer(b.column(4)[k].as_py(), np.uint8)
                at = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
                ok = table[0][at] == asked
                found, whose = table[1][at[ok]], whose[ok]
                if grp not in sums:
                    if len(sums) >= SUMS:
                        yield from flush()
                    sums[grp], sizes[grp] = np.zeros((4, GROUP)), GROUP
                word = found["word"].astype(np.float64)
                sums[grp][1] += np.bincount(whose, word, GROUP)
                sums[grp][2] += np.bincount(whose, word * found["value"], GROUP)
                sums[grp][3] += np.bincount(whose, found["value"], GROUP)
        yield from flush()
        give_back()

    out = T.StructType([T.StructField("doc", kind), *T._parse_datatype_string("n_tokens bigint, n_known bigint, base_score double, score double")])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, docs = None, None, None

        def done():
            n = len(docs)
            whole = sums[:, :n]
            unseen = (whole[0] - whole[1]) * math.log10(0.5 / shared.value.unit)
            made = [docs, pa.array(whole[0].astype(np.int64)), pa.array(np.rint(whole[1]).astype(np.int64)), pa.array(whole[2] + unseen), pa.array(whole[3] + unseen)]
            return pa.RecordBatch.from_arrays(made, names=out.names)

        for b in batches:
            for k, (grp, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if grp != now:
                    if now is not None:
                        yield done()
                    now, sums, docs = grp, np.zeros((4, GROUP)), None
                sums[:, :n] += np.frombuffer(b.column(2)[k].as_py()).reshape(4, n)
                if b.column(3)[k].is_valid:
                    docs = b.column(3).slice(k, 1).flatten()
        if now is not None:
            yield done()

    def of(some: DataFrame) -> DataFrame:
        rows = some.select(utf8(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), own.alias("doc"))
        asked = rows.mapInArrow(ask, block).unionByName(far.select("key", "value", "word").mapInArrow(entries, block))
        met = asked.repartition("part").sortWithinPartitions("part", "grp").mapInArrow(meet, summed)
        return met.repartition("grp").sortWithinPartitions("grp").mapInArrow(total, out)

    part, done = F.pmod(F.xxhash64(id_col, text_col), F.lit(PARTS)), []
    for k in range(PARTS - 1):
        done.append(stored(of(docs.where(part == k))))
        release(docs.sparkSession)
    found = reduce(DataFrame.unionByName, [*done, of(docs.where(part == PARTS - 1))])
    return found.select(F.col("doc.id").alias(id_col), *(F.col(f"doc.{k}").alias(k) for k in extra or {}), "n_tokens", "n_known", "base_score", "score")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 1
    model = train(docs.where(~held).select(utf8("text").alias("text")))
    out = score(docs, model, extra={"held_out": held})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model[0].total).cast("long").alias("train_tokens"), "base_score", "score")
