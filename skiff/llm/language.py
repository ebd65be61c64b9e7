"""Language ID by compression.

Training keeps a bounded sample for each language: pieces of PIECE characters from places spread by hash over documents
spread by hash, DICT_BYTES of text a language (less when there are very many languages, so that all fit SAMPLE_BYTES). Each
language's sample is a zstandard raw-content dictionary.

A text is cut into blocks of BLOCK bytes (all of it, at characters' starts); each block is compressed with each language's
dictionary, and the sizes are summed by language. The smallest sum wins. The score is the winner's share of the evidence:
1 / (1 + sum over others of exp(-bits saved against it / TEMPERATURE)). A narrow margin (the next language within MARGIN of
the smallest size) sets `rejected`; the language stays named, for contracts that want one for each text with a letter.

Cases: `und` with score 0 for a null text and a text without a letter. Training rows with a null language or text are left
out; without any training rows every text is `und`. Ties go to the language with more training
rows. Repeated documents are each answered. Case does not count: sample and texts are lower-cased. A letter is a character of
a letter category (digits, number signs and fractions are none). A very long text is compressed block by block; an empty
table gives no rows; columns of docs are kept, and the result's column takes another name if docs has that one.
"""

import math

import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import crc_mod, fresh, row_function, table, utf8

#: The bound on the training sample: pieces of PIECE characters, DICT_BYTES bytes for each language, SAMPLE_BYTES for all.
PIECE, DICT_BYTES, SAMPLE_BYTES = 400, 128 << 10, 32 << 20
BLOCK, LEVEL, MIN_MATCH, MARGIN, TEMPERATURE = 2048, 3, 3, 0.01, 64.0
UND = "und"
_LETTER = regex.compile(r"\p{L}")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary content), the most frequent first, from the rows of docs with a language and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("language")).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    most = max(PIECE, min(DICT_BYTES, SAMPLE_BYTES // len(counts)))
    want = 2 * most // PIECE
    # each language's rows pass with its own probability, a function of the row's hash, so that about `want` do
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, want / n))))
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    at = F.greatest(F.lit(1), F.pmod(F.shiftright("h", 31), F.greatest(F.lit(1), F.length("text") - PIECE)) + 1)
    some = rows.where(unit <= F.element_at(share, F.col("lang"))).select("lang", "h", F.col("text").substr(at.cast("int"), F.lit(PIECE)).alias("piece"))
    pieces: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for r in sorted(some.collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        if sizes.get(r["lang"], 0) < most:
            pieces.setdefault(r["lang"], []).append(r["piece"].lower().encode())
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(pieces[r["lang"]][-1])
    return [(k, b"\n".join(v)) for k, v in sorted(pieces.items(), key=lambda x: (-counts[x[0]], x[0]))]


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.names, self.tools = [k for k, _ in model], []
        for _, content in model:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.tools.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how))

    def sizes(self, text: bytes) -> list[int]:
        total = [0] * len(self.tools)
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            block = text[at:end]
            for k, tool in enumerate(self.tools):
                total[k] += len(tool.compress(block))
            at = end
        return total

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        known = text.decode("utf-8", "replace").lower() if text else ""
        if not self.names or not _LETTER.search(known):
            return UND, 0.0, True
        sizes = self.sizes(known.encode())
        best = sizes.index(min(sizes))
        others = [s for k, s in enumerate(sizes) if k != best]
        score = 1 / (1 + sum(math.exp(-8 * (s - sizes[best]) / TEMPERATURE) for s in others))
        return self.names[best], score, bool(others) and min(others) - sizes[best] <= MARGIN * sizes[best]


def classify(docs: DataFrame, model: list[tuple[str, bytes]], text_col: str = "text", into: str = "language") -> tuple[DataFrame, str]:
    """docs with a struct column: lang, score, rejected. One pass; the model is at most SAMPLE_BYTES."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        classifier = Classifier(shared.value)
        return lambda rows: [classifier.predict(t) for t in rows]

    into = fresh(docs, into)
    return docs.withColumn(into, row_function("lang string, score double, rejected boolean", start)(utf8(text_col))), into


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    out, at = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col(f"{at}.lang").alias("lang_pred"), f"{at}.score", f"{at}.rejected")
