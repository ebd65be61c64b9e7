"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models over lower-cased words, one of toxic and one of ordinary documents. A bigram counts once for each distinct
word before it, as in the lower orders of a trigram model, so copied documents count once. In each model that count, less
a discount, backs off to the class's continuation counts (in how many distinct contexts of the class a word occurs), and both
levels, discounted, back off to what discounting took from the counts of the two classes together: what is rare in a class
is smoothed by counts that the classes share, so only words and expressions that the classes use differently move a score.
A word that is rare in both classes (a compound, an inflected form) backs off further, to its longest beginning of up to
STEM letters that is frequent in one of them: by the same rule, a beginning's count being that of the distinct words it has.

A document's log-likelihoods (of its distinct bigrams, as in training) under both are divided by their number; the difference of these, over the whole text
and over the PEAKS bigrams, wherever they are, that are most above the document's median (long texts dilute, toxic words may be scattered,
and a language or style shifts all words alike), are features of a logistic scale that is fitted on training documents which the models have not
seen; a third is their sum over the root of the number of words. No bigram counts for more than MOST either way, so that the
few expressions with large counts don't set a scale by which the many rarer ones are lost.

The training rows are a bounded sample: as many documents of either class, SAMPLE at most, spread by hash over all labelled
ones (classes of one size keep what is rare in both from telling them apart). Rows whose
label or text is null are left out. If either class has no training row, every score is 0.

How much is discounted depends on how much there is to learn from, so training tries each of DISCOUNTS and keeps the one whose
scale, fitted on one half of the training documents that the models have not seen, gives the other half the smallest log loss
(of equal ones the largest). The constants were chosen alike, by cross-validation inside the training rows.

Cases: a null text or one without words has the score that the fitted scale gives equal likelihoods. Words are
[^\\W\\d_]+ runs with inner apostrophes. Documents with several labels train once for each; repeated documents are each answered.
"""

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import crc_mod, discard, fresh, map_batches, row_function, stored, table, utf8

#: The bound on the training sample: documents of each class.
SAMPLE = 8000
DISCOUNTS, PEAKS, STEM, MOST = (2, 4, 8), 2, 8, 3.5
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
EDGE = ""


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower()) if text else []


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(label 0/1, fold, half, key, text bytes) of as many documents of either class, about SAMPLE at most, by a function of each id's
    hash; and the labels' counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    unit = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    most = min(SAMPLE, counts.get(0, 0), counts.get(1, 0))
    share = F.when(F.col("label") == 1, most / max(1, counts.get(1, 0))).otherwise(most / max(1, counts.get(0, 0)))
    # at most about 2 * SAMPLE rows of an id and a bit, whatever the table's size
    chosen = F.broadcast(known.where(unit < share))
    h = F.xxhash64(F.col("_id").cast("string"), F.lit("fold"))
    fold, half = F.pmod(h, F.lit(4)).cast("int"), F.pmod(F.shiftright(h, 2), F.lit(2)).cast("int")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), utf8(text_col).alias("text"))
    return texts.join(chosen, F.col("_doc") == F.col("_id")).select("label", fold.alias("fold"), half.alias("half"), h.alias("key"), "text"), counts


def smoothed(counts: dict[str, tuple[int, int]], totals: tuple[int, int], spared: int, discount: int) -> tuple[list[float], dict[str, tuple[float, ...]]]:
    """Each class's backoff weight, and its probability of each of counts, the entries with over the discount in a class.
    totals: the classes' sums over all entries; spared: the sum over all of what of both classes' counts is within the discount.
    Any other entry has its shared part times the weight, so that only the weights tell the classes apart there."""
    back = [1 - sum(max(0, k[c] - discount) for k in counts.values()) / max(1, totals[c]) for c in (0, 1)]
    back = [max(b, 1e-3) for b in back]
    return back, {w: tuple(max(0, k[c] - discount) / max(1, totals[c]) + back[c] * min(discount, sum(k)) / spared for c in (0, 1)) for w, k in counts.items()}


class Model:
    """Log-likelihood ratios: of heavy bigrams, and of words in other ones with the context's part added."""

    def __init__(self, words: dict[str, tuple[int, int]], totals: tuple[int, int], spared: int, contexts: dict[str, tuple[int, int]], heavy: list[tuple[str, str, int, int]], stems: dict[int, tuple], discount: int):
        """words: distinct contexts in either class of words with over the discount in one, totals and spared as in smoothed();
        contexts: bigrams by class that begin with a word; heavy: (first, second, n0, n1) of bigrams over it in a
        class; stems: smoothed()'s first three arguments for the words' beginnings of each length."""
        back, word = smoothed(words, totals, spared, discount)
        self.discount = discount
        self.new = math.log(back[1] / back[0])
        self.word = {w: math.log(p[1] / p[0]) for w, p in word.items()}
        self.stem = {b: math.log(p[1] / p[0]) for part in stems.values() for b, p in smoothed(*part, discount)[1].items()}
        left = [{a: 1.0 for a in contexts} for _ in (0, 1)]
        for a, _, *n in heavy:
            for c in (0, 1):
                left[c][a] -= max(0, n[c] - discount) / max(1, contexts[a][c])
        self.context = {a: math.log(max(left[1][a], 1e-3) / max(left[0][a], 1e-3)) for a in contexts}
        self.bigram = {}
        for a, b, *n in heavy:
            if b in words:
                both = min(discount, sum(n)) / sum(contexts[a])
                p = [max(0, n[c] - discount) / max(1, contexts[a][c]) + max(left[c][a], 1e-3) * (both + word[b][c]) / 2 for c in (0, 1)]
                self.bigram[a, b] = math.log(p[1] / p[0])

    def rare(self, word: str) -> float:
        """The ratio of a word that is rare in both classes."""
        for n in range(min(STEM, len(word) - 1), 0, -1):
            if (r := self.stem.get(word[:n])) is not None:
                return r
        return self.new

    def features(self, text: bytes | None) -> tuple[float, float, float]:
        """Differences of the length-normalised log-likelihoods of the distinct bigrams: by number, by the number's root, and
        of the worst PEAKS of them, from the median."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0, 0.0
        known, word, context = self.bigram.get, self.word.get, self.context.get
        ratio = []
        for p in dict.fromkeys(zip([EDGE, *words], words)):
            if (r := known(p)) is None:
                r = (self.rare(p[1]) if (r := word(p[1])) is None else r) + context(p[0], 0.0)
            ratio.append(max(-MOST, min(MOST, r)))
        ordered = np.sort(ratio)
        n, total = len(ordered), ordered.sum()
        return float(total / n), float(total / math.sqrt(n)), float(ordered[-PEAKS:].mean() - np.median(ordered))


def _trigrams(rows: DataFrame) -> DataFrame:
    """Distinct (label, before, first, second), made distinct in each task before they are dealt out."""

    def start():
        seen = set()

        def work(batch):
            if batch is not None:
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    seen.update((label, z, a, b) for z, a, b in zip([EDGE, EDGE, *words], [EDGE, *words], words))
            if seen and (batch is None or len(seen) > 500_000):
                yield dict(zip(("label", "before", "first", "second"), zip(*seen, strict=True), strict=True))
                seen.clear()

        return work

    return map_batches(rows.select("label", "text"), "label int, before string, first string, second string", start).distinct()


def _spared(discount: int, a: str, b: str):
    return F.sum(F.least(F.lit(discount), F.col(a) + F.col(b))).alias(f"s{discount}")


def _statistics(rows: DataFrame) -> dict[int, tuple] | None:
    """Model's arguments for each of DISCOUNTS, or None where a class has no word. What comes to the driver is bounded by the sample:
    the words, bigrams and beginnings of words that occur over the smallest discount in it."""
    least = min(DISCOUNTS)
    both = stored(_trigrams(rows).groupBy("first", "second").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")))
    kinds = stored(both.groupBy("second").agg(F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1")))
    t0, t1, *spared = kinds.agg(F.sum("k0"), F.sum("k1"), *(_spared(d, "k0", "k1") for d in DISCOUNTS)).first()
    if not (t0 and t1):
        discard(both, kinds)
        return None
    words = {r[0]: (r[1], r[2]) for r in kinds.where(F.greatest("k0", "k1") > least).collect()}
    heavy = [tuple(r) for r in both.where(F.greatest("n0", "n1") > least).select("first", "second", "n0", "n1").collect()]
    some = both.sparkSession.createDataFrame([(a,) for a in {h[0] for h in heavy}], "first string")
    contexts = {r[0]: (r[1], r[2]) for r in both.join(F.broadcast(some), "first").groupBy("first").agg(F.sum("n0"), F.sum("n1")).collect()}
    begin = kinds.where(F.length("second") > 1).select("k0", "k1", F.explode(F.expr(f"transform(sequence(1, least({STEM}, length(second) - 1)), n -> left(second, n))")).alias("stem"))
    begin = stored(begin.groupBy("stem").agg(F.count_if(F.col("k0") > 0).alias("k0"), F.count_if(F.col("k1") > 0).alias("k1")))
    sums = begin.groupBy(F.length("stem")).agg(F.sum("k0"), F.sum("k1"), *(_spared(d, "k0", "k1") for d in DISCOUNTS)).collect()
    stems = [tuple(r) for r in begin.where(F.greatest("k0", "k1") > least).collect()]
    discard(both, kinds, begin)
    out = {}
    for i, d in enumerate(DISCOUNTS):
        parts = {r[0]: ({}, (r[1], r[2]), r[3 + i]) for r in sums}
        for b, k0, k1 in stems:
            if max(k0, k1) > d:
                parts[len(b)][0][b] = (k0, k1)
        often = [h for h in heavy if max(h[2:]) > d]
        out[d] = {w: k for w, k in words.items() if max(k) > d}, (t0, t1), spared[i], {a: contexts[a] for a in {h[0] for h in often}}, often, parts, d
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, np.ndarray] | None:
    """The models and the fitted scale (weights of the features, and a constant), or None without both classes."""
    rows, counts = sample(docs, labels, id_col, text_col, label_col)
    rows = stored(rows)
    statistics = _statistics(rows.where("fold <> 0"))
    if statistics is None:
        discard(rows)
        return None
    models = [Model(*statistics[d]) for d in DISCOUNTS]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def start():
        return lambda texts: [tuple(x for m in shared.value for x in m.features(t)) for t in texts]

    names = [f"f{i}" for i in range(3 * len(models))]
    features = row_function(", ".join(f"{n} double" for n in names), start)("text")
    unseen = rows.where("fold = 0").orderBy("key").select("label", "half", features.alias("x")).select("label", "half", "x.*").toArrow().to_pydict()
    shared.unpersist()
    discard(rows)
    y, half = np.array(unseen["label"]), np.array(unseen["half"])
    if len(set(y)) < 2:
        return None
    x = [np.array([unseen[n] for n in names[3 * i : 3 * i + 3]]).T for i in range(len(models))]
    best = min(range(len(models)), key=lambda i: (_loss(x[i], y, half), -DISCOUNTS[i]))
    return models[best], fit(x[best], y, counts[1] / counts[0])


def _loss(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> float:
    """The log loss of each half's rows on a scale fitted on the other; 0 where a half has one class only."""
    if len(set(zip(y.tolist(), half.tolist(), strict=True))) < 4:
        return 0.0
    out = 0.0
    for h in (0, 1):
        w = fit(x[half != h], y[half != h], y.mean() / (1 - y.mean()))
        z = x[half == h] @ w[:-1] + w[-1]
        out += np.logaddexp(0, np.where(y[half == h] == 1, -z, z)).sum()
    return round(float(out), 9)


def fit(x: np.ndarray, y: np.ndarray, odds: float, pull: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps, slightly pulled to small weights; a feature with a negative weight is left out;
    the constant is moved from the sample's odds of label 1 to the given ones."""
    mean, sd, use = x.mean(0), x.std(0) + 1e-9, np.ones(x.shape[1], bool)
    while True:
        z, w = np.c_[((x - mean) / sd)[:, use], np.ones(len(x))], np.zeros(use.sum() + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + pull * np.eye(len(w)), z.T @ (y - p) - pull * w)
            w += step * min(1.0, 2 / max(abs(step).max(), 1e-12))  # short steps: classes that part cleanly have large weights
            if abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            break
        use[np.flatnonzero(use)[w[:-1].argmin()]] = False
    out = np.zeros(len(use) + 1)
    out[:-1][use] = w[:-1] / sd[use]
    out[-1] = w[-1] - (out[:-1] * mean).sum() + math.log(odds * (1 - y.mean()) / y.mean())
    return out


def score(docs: DataFrame, model: tuple[Model, np.ndarray] | None, text_col: str = "text", into: str = "toxicity") -> tuple[DataFrame, str]:
    """docs with a struct column: score, and the two features. One pass; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def one(text):
            if shared.value is None:
                return 0.0, 0.0, 0.0, 0.0
            models, w = shared.value
            x = models.features(text)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(w[:3] @ x + w[3]))))), *x

        return lambda rows: [one(t) for t in rows]

    into = fresh(docs, into)
    return docs.withColumn(into, row_function("score double, mean double, root double, peak double", start)(utf8(text_col))), into


def learned(spark, sf_dir):
    """The model for the documents in sf_dir, from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return train(docs, labels.where(crc_mod("doc_id", 5) != 0))


def query(spark, sf_dir):
    out, at = score(table(spark, sf_dir, "documents").select("doc_id", "text"), learned(spark, sf_dir))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), f"{at}.score", (F.col(f"{at}.score") >= 0.5).cast("int").alias("predicted"))
