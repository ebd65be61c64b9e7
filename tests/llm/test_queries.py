"""The registered queries: against SQL where there is some, else against brute force or on held-out rows."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from skiff.llm import bpe, common, decontaminate, queries, secrets, simhash, suffix_tree, toxicity
from tests.llm.test_cases import near_copies_by_brute_force, scored_by_brute_force, suffix_tree_by_brute_force, toxicity_by_brute_force
from tests.oracle import compare

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
Q = queries.queries()


def source(sf, columns="doc_id, text"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, Q[name], queries.oracle_sql()[name], SF)


def test_secrets(spark):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in Q["op2_secrets"](spark, SF).collect()}
    assert got == {i: secrets.brute_force(t) for i, t in source(SF)}


def by_brute_force(rows):
    fp = np.array([simhash.fingerprint((t or "").encode()) for _, t in rows], np.int64).view(np.uint64)
    ids = [i for i, _ in rows]
    order = np.argsort(ids)
    root = common.local_roots(len(ids), *np.nonzero(np.bitwise_count(fp[order][:, None] ^ fp[order]) <= 3))
    return {ids[order[k]]: (f"{int(fp[order[k]]):016x}", ids[order[root[k]]]) for k in range(len(ids))}


def test_simhash(spark):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op6_simhash_dedup"](spark, SF).collect()} == by_brute_force(source(SF))


def test_language_held_out(spark):
    lang = dict(source(SF, "doc_id, lang"))
    rows = [r for r in Q["op5_language_id"](spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95


def test_bpe(spark):
    import hashlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, text in source(TINY):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q["op9_bpe"](spark, TINY).collect()} == want


def test_toxicity_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.sample(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), "doc_id", "text", "toxic")[0].where("fold <> 0").select("label", "text").collect()
    model, w = toxicity.learned(spark, SF)
    features = toxicity_by_brute_force([(r.label, bytes(r.text)) for r in rows], model.discount)
    texts = dict(source(SF))
    got = Q["op8_toxicity"](spark, SF).collect()
    assert len(got) == len(texts) and min(r.predicted for r in got) == 0 < max(r.predicted for r in got)
    for r in got:
        want = 1 / (1 + np.exp(-(np.dot(w[:3], features((texts[r.doc_id] or "").encode())) + w[3])))
        assert np.isclose(r.score, want, atol=1e-9) and r.predicted == int(want >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_lm_by_brute_force(spark):
    docs = source(TINY)
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    lp, root = suffix_tree_by_brute_force(train, suffix_tree.ORDERS)
    n, v = sum(root.values()), len(root)
    for r in Q["op10_lm_score"](spark, TINY).collect():
        words = [*(dict(docs)[r.doc_id] or "").encode().lower().split(), b""]
        base = sum(np.log10((root.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in root for w in words), n)
        assert np.isclose(r.base_score, base, atol=1e-9) and np.isclose(r.score, scored_by_brute_force(lp, dict(docs)[r.doc_id]))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_lm_held_out(spark):
    rows = [r for r in Q["op10_lm_score"](spark, SF).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_pipeline(spark):
    docs = source(TINY)
    model = toxicity.learned(spark, TINY)
    score = lambda t: 0.0 if model is None else 1 / (1 + np.exp(-(model[1][:3] @ np.array(model[0].features(t.encode())) + model[1][3])))
    kept = [(i, t) for i, t in docs if score(t) < 0.5]
    # the near-duplicate stage: five-word shingles, a Jaccard similarity of 0.8 or more
    stay = near_copies_by_brute_force(kept)
    kept = [(i, t) for i, t in kept if i in stay]
    items = duckdb.sql(f"SELECT CAST(item_id AS VARCHAR), text FROM '{TINY}/benchmark.parquet'").fetchall()
    dirty = {r[0] for r in decontaminate.brute_force([(i, t.encode()) for i, t in kept], [(i, t.encode()) for i, t in items]) if r[5]}
    want = {}
    for i, t in kept:
        if i not in dirty:
            at, parts = 0, []
            for a, b, _ in secrets.scan(t.encode()):
                if a >= at:
                    parts += [t[at:a], "[REDACTED]"]
                at = max(at, b)
            want[i] = bpe.load(bpe.default_path()).encode("".join([*parts, t[at:]]))
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, TINY).collect()} == want and want
