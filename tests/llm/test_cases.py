"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skiff.llm import bpe, chat, common, decontaminate, embeddings, language, secrets, shingles, simhash, suffix_tree, toxicity, warc

LONG = "word " * 30000 + "x" * 100000
TEXTS = [None, "", " \n", "one", "one two", "one two three four", LONG, "é漢😀 <|endoftext|> a", "one two three four"]
DOCS = "doc_id long, text string, n_words string, fp long, tokens int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "keep", 7, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "keep", 7, 1)], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_decontaminate(spark, docs, empty):
    bench = [(1, "One two THREE"), (2, None), (3, ""), (4, "!!"), (5, "word " * 12), (1, "one two three"), (None, "one")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    out, at = decontaminate.mark(docs.withColumn("contamination", F.lit(1)), b)
    rows = out.select("doc_id", "text", f"{at}.*").collect()
    enc = lambda t: None if t is None else t.encode()
    for r, want in zip(rows, decontaminate.brute_force([(r.doc_id, enc(r.text[:2000] if r.text else r.text)) for r in rows], [(i, enc(t)) for i, t in bench]), strict=True):
        if r.text != LONG:
            assert (r.n_words, len(r["items"]), sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2]))) == (want[1], want[3], want[2])
        else:
            assert r.spans == [0, 30000]
    assert decontaminate.decontaminate(docs, b.limit(0)).columns == docs.columns
    assert decontaminate.decontaminate(empty, b).count() == 0
    kept = {r.text for r in decontaminate.decontaminate(docs, b).collect()}
    assert kept == {None, "", " \n", TEXTS[7]}


def test_decontaminate_in_parts(spark, docs, monkeypatch):
    b = spark.createDataFrame([(i, f"w{i} a b c d e f g h i j k") for i in range(40)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"x w{i} a b c d e f g h i j k y") for i in range(40)], "doc_id long, text string")
    want = sorted(map(repr, decontaminate.mark(d, b)[0].collect()))
    for n in (3000, 300, 100):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", n)
        assert sorted(map(repr, decontaminate.mark(d, b)[0].collect())) == want


def test_wu_manber_finds_all():
    r = random.Random(1)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(60)]
        m = r.randrange(1, 6)
        windows = {tuple(r.choice([b"a", b"b", b"c"]) for _ in range(m)) for _ in range(4)}
        want = [i for i in range(61 - m) if tuple(words[i : i + m]) in windows]
        flat = np.array([w[0] for t in windows for w in t])
        machine = decontaminate.WuManber(flat, np.arange(0, len(flat), m), m)
        found = list(machine.find([w[0] if w != b"c" or r.random() < 2 else -1 for w in words]))
        assert [i for i, _ in found] == want and all(tuple(flat[p : p + m]) == tuple(w[0] for w in words[i : i + m]) for i, p in found)


def test_machines_are_built_once_a_worker(spark, monkeypatch):
    """Time per document does not depend on how many items there are: 30,000 items, the same texts."""
    import time

    items = [(str(i), f"i{i} a b c d e f g h j{i % 9}".encode()) for i in range(30000)]
    small, large = decontaminate.Searcher(items[:300]), decontaminate.Searcher(items)
    words = [decontaminate.words_of(f"x y z i{i} a b c d e f g h j{i % 9} plain words follow here".encode()) for i in range(300)]
    took = []
    for searcher in (small, large):
        began = time.perf_counter()
        found = [searcher.find(w) for w in words]
        took.append(time.perf_counter() - began)
        assert all(str(i) in f[1] and f[0][0] == (3, 13) for i, f in enumerate(found))
    b = spark.sparkContext.broadcast(items[:3])
    assert decontaminate.built("a", b) is decontaminate.built("a", b)
    assert took[1] < 20 * took[0] + 0.5


def test_secrets(docs, empty):
    out, at = secrets.mark(docs)
    assert out.count() == 10 and secrets.mark(empty)[0].count() == 0
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice(["password", "TOKEN", "ApiKey", "=", ":", ' "', "'", "AKIA", "ABCDEFGH1234567890", "0a1b2c3d4e5f", " ", "é", "\n", "ſecret", "x.y"]) for _ in range(25))
        spans = secrets.scan(t.encode())
        base = [s for s in spans if s[2] < 3]
        assert secrets.brute_force(t) == (*(sum(s[2] == k for s in base) for k in range(3)), hashlib.sha256(secrets.joined(base).encode()).hexdigest())


def test_secret_lexer(spark):
    found = lambda t: [t[a:b] for a, b, k in secrets.scan(t.encode()) if k == 3]
    assert found('k = "sk_live_9aF3kQ2x"\né = 1\nDB_CREDENTIALS = k\n') == ["sk_live_9aF3kQ2x"]
    assert found('{"client_secret_key": "Zm9vYmFy123="}') == ["Zm9vYmFy123="]
    assert found('my_pass = "ab" + "Xy12cd34EF56"') == ["Xy12cd34EF56"]
    assert found('title = "Zm9vYmFy123="') == [] and found("see: the quick brown fox") == []
    d = spark.createDataFrame([(1, "a password=hunter22 b", 21), (2, "clean", 5)], "doc_id long, text string, n_chars long")
    assert secrets.redact(d, length_col="n_chars").orderBy("doc_id").collect() == [(1, "a [REDACTED] b", 14), (2, "clean", 5)]


def test_embeddings(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal((20, 16))
    rows = [(int(i), (base[i % 20] + 0.03 * g.standard_normal(16)).tolist(), int(i % 2)) for i in range(200)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)]  # copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, rows[0][1], None), (2005, [1.0] * 8, 0), (2006, [1.0, None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    ok = [r for r in rows if r[0] < 2000]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.98) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok]))
    root = common.local_roots(len(ok), *np.nonzero(link))
    assert {r[0]: got[r[0]] for r in ok} == {r[0]: (int(link[i].sum()) - 1, ok[root[i]][0]) for i, r in enumerate(ok)}
    assert all(got[k] == (0, k) for k in range(2000, 2007)) and len(got) == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    test_embeddings(spark)
    test_simhash_links(spark)


def test_buckets_are_not_broadcast(spark):
    # 68 rows come of each fingerprint, which Spark's estimate does not know
    plan = simhash.links(spark.range(50000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_e8():
    x = np.random.default_rng(1).standard_normal((300, 8)) * 2
    p = embeddings.nearest_e8(x)
    near = p[:, None] + embeddings.ROOTS
    assert len(embeddings.ROOTS) == 240 and (((x - p) ** 2).sum(1) <= ((x[:, None] - near) ** 2).sum(2).min(1) + 1e-9).all()


@pytest.mark.parametrize("dims", [16, 64, 384])
def test_cells_meet_near_vectors_and_few_others(dims):
    g = np.random.default_rng(dims)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(g.standard_normal((4000, dims)))
    away = g.standard_normal(a.shape)
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * unit(away - (away * a).sum(1)[:, None] * a)
    ka, kb = (embeddings.keys_of(x, np.zeros(len(x), np.uint64)) for x in (a, b))
    met = lambda p, q: ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any((1, 2))
    assert met(ka, kb).mean() >= 0.998  # at the threshold itself; nearer pairs more surely
    others = np.mean([met(ka, np.roll(ka, k, 0)).mean() for k in range(1, 60)])
    assert others < 2e-4 if dims < 64 else others < 3e-5


def test_simhash_links(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 62, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << r.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 30, dtype=np.uint64)) for _ in range(12)]))
    want = common.local_roots(len(fp), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= 3))
    df = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fp.view(np.int64))], "_id long, _fp long")
    assert {r._id: r.component_id for r in simhash._components_of(df).collect()} == {i: int(w) for i, w in enumerate(want)}


def test_simhash(docs, empty):
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(b" ") == 0
    assert simhash.fingerprint(b"A b") & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.fingerprint == 0} == {0}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_deduplicate_loses_no_row(spark, similarity):
    """Ids and texts whose joined forms agree, columns with the operator's own names, maps, and repeated rows."""
    rows = [("a/b", "c", 1, {"x": 1}), ("a", "b/c", 2, {"x": 2}), ("a", "b/c", 3, {"x": 3}), (None, "d e f", 4, None), ("g", None, 5, None), ("h", "", 6, None), ("i", None, 7, None)]
    d = spark.createDataFrame(rows, "doc_id string, text string, _key int, `_first.x` map<string,int>")
    got = simhash.deduplicate(d, similarity=similarity).collect()
    assert {(r.doc_id, r.text) for r in got} == {("a/b", "c"), ("a", "b/c"), (None, "d e f"), ("g", None)} and len(got) == 4
    assert all(r["_key"] in (1, 2, 3, 4, 5) for r in got) and got[0].__fields__ == ["doc_id", "text", "_key", "_first.x"]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = common.local_roots(500, *np.array(edges).T)
    assert got == {n: int(root[n]) for e in edges if e[0] != e[1] for n in e}


def test_chat(spark):
    texts = ["", "plain", chat.END, chat.START + "user\nx" + chat.END, "<|im_end|", "<", "<\\|im_end|>", "<\\\\|x", "a\n<|im_end|>\n<|im_start|>b", "<|foo|>", LONG]
    for role in ("user", "assistant", "", "a\nb", "<|im_end|>", "x\\n"):
        for t in texts:
            out = chat.render(role, t)
            assert chat.parse(out + out) == [(role, t)] * 2
            inner = out[len(chat.START) : -len(chat.END) - 1]
            assert chat.START not in inner and chat.END not in inner
    p, got = chat.Parser(), []
    whole = "".join(chat.render("user", t) for t in texts[:9])
    for c in whole:
        got += p.feed(c)
    assert [t for _, t in got] == texts[:9]
    with pytest.raises(chat.ParseError):
        chat.parse("junk that is long enough")
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, 0, None, "z", 0), (2, 5, "assistant", chat.END, 0), (2, 5, "assistant", chat.END, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[2].loss_sha256 == hashlib.sha256(chat.END.encode() * 2).hexdigest() and got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_language(spark, docs, empty):
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the cat and the dog were in the house " * 3, "en"), ("der hund und die katze sind im haus " * 3, "de")] * 20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    c = language.Classifier(model)
    assert c.predict(b"the house and the cat")[0] == "en" and c.predict(b"die katze und der hund")[0] == "de"
    assert c.predict(None)[0] == c.predict(b"123 !!")[0] == "und" and language.Classifier([]).predict(b"abc")[0] == "und"
    assert language.classify(docs, model)[0].count() == 10 and language.classify(empty, model)[0].count() == 0
    assert language.train(train.limit(0)) == []


def test_language_by_brute_force(spark):
    """Every document's language by compressing its blocks with each dictionary, straight from the sample."""
    import zstandard

    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    out, at = language.classify(docs.select("doc_id", "text"), model)
    how = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, min_match=language.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    tools = [(k, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)) for k, c in model]
    for r in out.collect():
        text = (r.text or "").lower()
        if not any(c.isalpha() for c in text):
            assert r[at].lang == "und"
            continue
        data, cut, sizes = text.encode(), [0], {}
        while cut[-1] < len(data):
            end = min(len(data), cut[-1] + language.BLOCK)
            while end < len(data) and 0x80 <= data[end] < 0xC0:
                end += 1
            cut.append(end)
        for k, tool in tools:
            sizes[k] = sum(len(tool.compress(data[a:b])) for a, b in zip(cut, cut[1:]))
        assert sizes[r[at].lang] == min(sizes.values())
    assert [language.Classifier(model).predict(t.encode())[0] for t in ("½", "²", "①", "123", "_")] == ["und"] * 5


def test_warc(spark):
    pages = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (2, "u", None), (None, "n", "<p>é</p>"), (None, "n", "only"), (9, "v", "a\r\n\r\nWARC/1.1\r\n\r\n" + LONG), (-7, "w", "neg"), (8, "w", "neg")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.write_archives(df.withColumn("digest", F.lit(1)), common.new_folder(spark, "t"))
    got = [(r.number is None, r.number or 0, r.type, r.refers_to, r.length) for r in warc.read_archives(spark, path).collect()]
    want = [(False, 3, "revisit", 1, 9), (False, 1, "response", None, 9), (False, 2, "response", None, 0), (False, 2, "response", None, 0), (False, 5, "revisit", 2, 0), (True, 0, "revisit", 1, 9), (True, 0, "response", None, 4), (False, 9, "response", None, len(pages[7][2])), (False, -7, "response", None, 3), (False, 8, "revisit", -7, 3)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), common.new_folder(spark, "t"))).count() == 0
    for v in (1, 2):
        records = [("http://x", "20200102030405", b"HTTP/1.1 200 OK\r\n\r\n\nbody\n\n"), ("y", "20200102030405", b"")]
        assert [r["block"] for r in warc.parse_arc(warc.arc_file(v, records))] == [r[2] for r in records]
        with pytest.raises(ValueError):
            list(warc.parse_arc(warc.arc_file(v, records[:1])[:-5]))
    assert all(warc.number_of(warc.record_id(n)) == n for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345))


def test_arc_files(spark, tmp_path):
    """Hand-made ARC files of both versions, as crawlers wrote them."""
    import gzip

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>caf\xe9</p>\n"
    dns = b"20020308193200\nexample.org.\t600\tIN\tA\t192.0.2.7"
    v1 = b"filedesc://IA-001.arc 0.0.0.0 20020308193200 text/plain 77\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n"
    v1 = v1.replace(b" 77\n", b" %d\n" % (len(v1) - v1.index(b"\n") - 2))
    v1 += b"dns:example.org 192.0.2.1 20020308193200 text/dns %d\n" % len(dns) + dns + b"\n"
    v1 += b"http://example.org/a b 192.0.2.7 20020308193201 text/html %d\n" % len(page) + page + b"\n"
    v1 += b"http://example.org/bare 192.0.2.7 20020308193202 text/plain 5\nhello\n"
    body = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = [b"filedesc://x.arc 0.0.0.0 20050101000000 text/plain 200 - - 0 x.arc %d\n" % len(body) + body + b"\n"]
    v2.append(b"http://example.org/copy 192.0.2.7 20050101000001 text/html 200 abc - 99 x.arc %d\n" % len(page) + page + b"\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.arc").write_bytes(v1)
    (tmp_path / "in" / "new.arc.gz").write_bytes(b"".join(map(gzip.compress, v2)))
    (tmp_path / "in" / "notes.txt").write_bytes(b"no archive")
    assert warc.read_arc(spark, str(tmp_path / "in")).count() == 6
    got = warc.read_archives(spark, warc.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))).collect()
    kinds = sorted((r.type, r.target) for r in got)
    response, revisit = ([r for r in got if r.type == t] for t in ("response", "revisit"))
    assert len(response) == len(revisit) == 1 and {response[0].target, revisit[0].target} == {"http://example.org/a%20b", "http://example.org/copy"}
    assert bytes(response[0].block) == page and response[0].digest == revisit[0].digest == warc.digest_of(b"<p>caf\xe9</p>\n")
    assert [k for k in kinds if k[0] == "resource"] == [("resource", "dns:example.org"), ("resource", "http://example.org/bare")] and [k[0] for k in kinds].count("warcinfo") == 2
    assert {bytes(r.block) for r in got if r.type == "resource"} == {dns, b"hello"} and len({r.id for r in got}) == 6


def test_files_are_rolled_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    pages = spark.createDataFrame([(i, "u", "x" * (100 * i)) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, str(tmp_path / "w"), compression="none")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("*.txt")]
    assert max(sizes) < 3000 + 4000 and len(sizes) > 10 and warc.read_archives(spark, path).count() == 30


def test_toxicity(spark, docs, empty):
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        t = [r.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            t[r.randrange(40)] = r.choice(["nasty", "vile"])
        rows.append((i, " ".join(t).replace("w", "word")))
        labels.append((i, int(bad)))
    letters = lambda s: "".join(c if not c.isdigit() else "abcdefghij"[int(c)] for c in s)
    d = spark.createDataFrame([(i, letters(t)) for i, t in rows] + [(999, None)], "doc_id long, text string")
    y = spark.createDataFrame(labels + [(999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    scored, at = toxicity.score(d.where("text is not null"), model)
    right = [(r[0] >= 0.5) == (r[1] % 4 == 0) for r in scored.select(f"{at}.score", "doc_id").collect()]
    assert sum(right) > 0.95 * len(right)
    assert all(0 <= r[0] <= 1 for r in toxicity.score(docs, model)[0].select("toxicity.score").collect())
    assert toxicity.score(empty, model)[0].count() == 0
    assert toxicity.train(d, y.limit(0)) is None and toxicity.score(docs, None)[0].select(F.max("toxicity.score")).first()[0] == 0


def toxicity_by_brute_force(sample, discount):
    """A function from a text to op8's features, by the definition, from (label, text) of the models' training rows."""
    seen = {(y, z, a, b) for y, t in sample for ws in [toxicity.words_of(t)] for z, a, b in zip(["", "", *ws], ["", *ws], ws)}
    grams = {(y, a, b): 0 for y, _, a, b in seen}
    for y, _, a, b in seen:
        grams[y, a, b] += 1
    kinds = {}
    for y, a, b in grams:
        kinds.setdefault(b, [0, 0])[y] += 1
    firsts = {}
    for (y, a, _), n in grams.items():
        firsts.setdefault(a, [0, 0])[y] += n
    begins = {}
    for w, k in kinds.items():
        for n in range(1, min(toxicity.STEM, len(w) - 1) + 1):
            for y in (0, 1):
                begins.setdefault(n, {}).setdefault(w[:n], [0, 0])[y] += k[y] > 0

    def level(counts):
        """Both classes' backoff weights, and the ratio of what is frequent in one."""
        total = [sum(k[y] for k in counts.values()) for y in (0, 1)]
        shared = sum(min(discount, sum(k)) for k in counts.values())
        back = [max(1e-3, 1 - sum(max(0, k[y] - discount) for k in counts.values()) / max(1, total[y])) for y in (0, 1)]
        return back, {w: [max(0, k[y] - discount) / max(1, total[y]) + back[y] * min(discount, sum(k)) / shared for y in (0, 1)] for w, k in counts.items() if max(k) > discount}

    back, word = level(kinds)
    begin = {b: p for part in begins.values() for b, p in level(part)[1].items()}
    heavy = {(a, b) for (_, a, b), n in grams.items() if n > discount}
    led = {a for a, _ in heavy}
    left = {a: [max(1e-3, 1 - sum(max(0, grams.get((y, a, b), 0) - discount) for f, b in heavy if f == a) / max(1, firsts[a][y])) for y in (0, 1)] for a in led}
    log = lambda p: np.log(p[1] / p[0])

    def ratio(a, b):
        if (a, b) in heavy and b in word:
            n = [grams.get((y, a, b), 0) for y in (0, 1)]
            return log([max(0, n[y] - discount) / max(1, firsts[a][y]) + left[a][y] * (min(discount, sum(n)) / sum(firsts[a]) + word[b][y]) / 2 for y in (0, 1)])
        known = word.get(b) or next((begin[b[:n]] for n in range(min(toxicity.STEM, len(b) - 1), 0, -1) if b[:n] in begin), back)
        return log(known) + (log(left[a]) if a in led else 0)

    def features(text):
        ws = toxicity.words_of(text)
        x = sorted(max(-toxicity.MOST, min(toxicity.MOST, ratio(a, b))) for a, b in set(zip(["", *ws], ws)))
        if not x:
            return 0.0, 0.0, 0.0
        return sum(x) / len(x), sum(x) / len(x) ** 0.5, np.mean(x[-toxicity.PEAKS :]) - np.median(x)

    return features


def test_toxicity_clashing_columns(spark):
    d = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words here", i, "x") for i in range(40)], "doc_id long, text string, label long, _id string")
    y = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (1, 0)], "doc_id long, toxic int")
    out, at = toxicity.score(d, toxicity.train(d, y))
    assert at == "toxicity" and out.count() == 40 and out.columns == [*d.columns, at]
    assert [r.label for r in out.orderBy("doc_id").collect()] == list(range(40))


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    r = random.Random(7)
    texts = [t or "" for t in TEXTS] + ["ab" * 3000, "\x1c\x1d a\x1e \x85 "]
    texts += ["".join(r.choice(["a", "the", " ", "  ", "\n", "\t", "'s", "é", "漢", "😀", "1", "<|endoftext|>", "​", "ſ", "!?", "\x1f"]) for _ in range(r.randrange(50))) for _ in range(1500)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    bad = [r.randrange(50257) for _ in range(300)]
    assert mine.decode(bad) == theirs.decode(bad, skip_special_tokens=False)
    for t in texts[:60]:
        piece = t.encode()[:400]
        if piece:
            assert mine._merge_long([mine.letter[b] for b in piece]) == mine.merge(piece[:256]) if len(piece) <= 256 else True
            assert b"".join(mine.fragments(piece)) == piece
    out, at = bpe.encode(docs)
    assert at == "tokens_" and out.count() == 10 and bpe.encode(empty)[0].count() == 0
    back, to = bpe.decode(out.select("doc_id", "text", F.col(at)["ids"].alias("ids")))
    assert all((r.text or "") == r[to] for r in back.collect())


def test_suffix_tree(spark, docs, empty):
    import math
    from collections import Counter

    train = spark.createDataFrame([(t,) for t in ["a b c a b c a b d", "a b c", None, "", LONG] * 5], "t string").select(common.utf8("t").alias("text"))
    model = suffix_tree.train(train)
    got = suffix_tree.score(docs, model).collect()
    c = Counter(w for t in ["a b c a b c a b d", "a b c", "", "", LONG] * 5 for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    assert model[0].total == n
    want = sorted(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").lower().split(), ""]) for t in [*TEXTS, TEXTS[5]])
    assert np.allclose(sorted(r.base_score for r in got), want)
    seen = suffix_tree.score(spark.createDataFrame([(1, "a b c a b c")], "doc_id long, text string"), model).first()
    assert seen.score > seen.base_score and seen.n_known == 7
    assert suffix_tree.score(empty, model).count() == 0
    none = suffix_tree.score(docs, suffix_tree.train(train.limit(0))).collect()
    assert len(none) == 10 and all(r.n_known == 0 and abs(r.base_score) < 1e-9 for r in none)


def suffix_tree_by_brute_force(texts, orders):
    """ln P(word | history) of a tree kept by counts alone, and its words."""
    import math
    from collections import Counter

    s, grams = suffix_tree, Counter()
    for t in texts:
        w = [None, *(t or "").encode().lower().split(), b""]
        grams.update(tuple(w[i : i + k + 1]) for k in range(orders + 1) for i in range(len(w) - k))
    root = {g[0]: n for g, n in grams.items() if len(g) == 1 and g[0] is not None}
    unit, states = sum(root.values()) + 0.5 * (len(root) + 1), {}

    def lp(history, word):
        if not history:
            return math.log((root.get(word, 0) + 0.5) / unit)
        back, kept = states.get(history, (0.0, {}))
        return kept[word] if word in kept else back + lp(history[1:], word)

    for k in range(1, orders + 1):
        after = {}
        for g, n in grams.items():
            if len(g) == k + 1 and n >= s.LEAST:
                p, q = math.log((n - s.DISCOUNT) / grams[g[:-1]]), lp(g[1:-1], g[-1])
                if abs(p - q) >= math.log(s.RATIO):
                    after.setdefault(g[:-1], []).append((g[-1], n, p, q))
        for c, kept in after.items():
            if sum(n * (p - q) for _, n, p, q in kept) >= s.GAIN * len(kept):
                left, suffix = (max(1 - sum(math.exp(x[i]) for x in kept), 1e-9) for i in (2, 3))
                states[c] = math.log(left / suffix), {x: p for x, _, p, _ in kept}
    return lambda history, word: lp(tuple([None, *history][-orders:]), word) / math.log(10), root


def scored_by_brute_force(lp, text):
    w = [*(text or "").encode().lower().split(), b""]
    return sum(lp(w[:i], w[i]) for i in range(len(w)))


def test_suffix_tree_sums_to_one(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices("abcdefg", [5, 4, 3, 2, 2, 1, 1], k=40)) + " x y x y x y" for _ in range(60)]
    model = suffix_tree.train(spark.createDataFrame([(t,) for t in texts], "t string").select(common.utf8("t").alias("text")))
    assert model[0].orders >= 2
    lp, words = suffix_tree_by_brute_force(texts, suffix_tree.ORDERS)
    words = [*words, b"unseen"]
    histories = [[], [b"x"], [b"x", b"y"], [b"a", b"b"], [b"unseen", b"x"]]
    asked = [*histories, *([*h, w] for h in histories for w in words if w)]
    got = suffix_tree.score(spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in enumerate(asked)], "doc_id long, text string"), model).collect()
    # a text's score without its end's
    before = {tuple(asked[x.doc_id]): x.score - lp(asked[x.doc_id], b"") for x in got}
    for h in histories:
        assert abs(sum(10 ** (before[*h, w] - before[tuple(h)]) if w else 10 ** lp(h, b"") for w in words) - 1) < 1e-6


@pytest.mark.parametrize("near, orders", [(0, 2), (10**6, 2), (60, 3)])
def test_suffix_tree_keeps_by_counts(spark, monkeypatch, near, orders):
    monkeypatch.setattr(suffix_tree, "ORDERS", orders)
    monkeypatch.setattr(suffix_tree, "NEAR", near)
    r = random.Random(9)
    texts = [" ".join(r.choices("abcdefghijklm", range(13, 0, -1), k=30)) + r.choice([" P q r", " s q t", " p q"]) for _ in range(80)] + ["p q r"] * 3
    model = suffix_tree.train(spark.createDataFrame([(t,) for t in texts], "t string").select(common.utf8("t").alias("text")))
    docs = [*texts[:20], "p q r s q t", "", "a p q r unseen q t", "unseen"]
    got = {x.doc_id: x for x in suffix_tree.score(spark.createDataFrame(enumerate(docs), "doc_id long, text string"), model).collect()}
    lp, _ = suffix_tree_by_brute_force(texts, orders)
    assert np.allclose([got[i].score for i in range(len(docs))], [scored_by_brute_force(lp, t) for t in docs])
    assert [got[i].n_tokens - got[i].n_known for i in range(20, 24)] == [0, 0, 1, 1]


def test_suffix_tree_scores_in_parts(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i % 150 if i % 50 else None, " ".join(r.choices("abcdefghij", k=r.randint(0, 30))) if i % 40 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_tree, "NEAR", 0)
    model = suffix_tree.train(docs.select(common.utf8("text").alias("text")))
    sizes, kept = [], suffix_tree.stored
    monkeypatch.setattr(suffix_tree, "stored", lambda df: (sizes.append((out := kept(df)).count()), out)[1])
    found = []
    for parts in (1, 2, 3):
        monkeypatch.setattr(suffix_tree, "PARTS", parts)
        found.append(sorted(str((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6))) for x in suffix_tree.score(docs, model).collect()))
    assert len(found[0]) == 300 and found[0] == found[1] == found[2]
    # the parts that were on disk before the last one
    assert len(sizes) == 3 and all(60 < n < 200 for n in sizes)


def shuffle_files(spark, want):
    """The shuffle files on disk, after up to 5 s of waiting for as many as wanted (Spark deletes in the background)."""
    import time

    for _ in range(50):
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        n = sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))
        if n == want:
            break
        time.sleep(0.1)
    return n


def test_shuffle_files_go_after_their_step(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    common.release(spark)
    before, setting = shuffle_files(spark, 0), spark.conf.get(conf)
    rows = spark.range(20000).selectExpr("id % 100 AS key").repartition("key").mapInArrow(lambda b: b, "key long")
    # those of a stored table without the driver's garbage collection
    kept = common.stored(rows.groupBy("key").count().repartition("key"))
    assert shuffle_files(spark, before) == before and kept.count() == 100 and spark.conf.get(conf) == setting
    common.release(spark)
    before = shuffle_files(spark, 0)
    # those of another step at the first release
    assert rows.groupBy("key").count().repartition("key").count() == 100 and shuffle_files(spark, -1) > before
    common.release(spark)
    assert shuffle_files(spark, before) <= before


def test_word_keys():
    r = random.Random(1)
    texts = [None, b"", b" ", b"One two", b"x" * 700000 + b" y", b"a b " * 200000 + b"z" * 900000]
    texts += ["".join(r.choice(["a", "B", "b", "\t", " ", "\n", "é", "the", "\x1c"]) for _ in range(r.randrange(4000))).encode() for _ in range(100)]
    keys, n = common.word_keys(pa.array(texts, pa.binary()))
    words = [(t or b"").lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    known = {}
    for w, k in zip([w for t in words for w in t], keys.tolist(), strict=True):
        assert known.setdefault(w, k) == k
    assert len(set(known.values())) == len(known)


def near_copies_by_brute_force(rows):
    """The ids that stay: five-word shingles, Jaccard similarity 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, k) for i, a in enumerate(sets) for k, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    root = common.local_roots(len(rows), *np.array(near).T)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(d, least.get(root[i], d))
    return set(least.values())


@pytest.mark.parametrize("block", [3, 4096])
def test_shingles(spark, empty, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    r = random.Random(3)
    rows = []
    for _ in range(12):
        base = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.choice([3, 5, 6, 9, 60, 200]))]
        rows += [" ".join(base)] * 2
        for changes in range(8):
            w = list(base)
            for _ in range(changes):
                w[r.randrange(len(w))] = "new" + str(r.randrange(9))
            rows.append(" ".join(w + ["more"] * (changes % 3)))
    rows = list(enumerate([*rows, None, "", " "]))
    r.shuffle(rows)
    got = shingles.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} == near_copies_by_brute_force(rows)
    assert shingles.deduplicate(empty).count() == 0


def test_runs_in_pieces():
    key = np.repeat(np.arange(8), [1, 30, 2, 3, 25, 1, 1, 9])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 4]), pa.array(np.arange(len(key))[i : i + 4])], names=["k", "at"]) for i in range(0, len(key), 4)]
    for limit in (None, 6):
        out = list(common.runs(iter(batches), ("k",), 8, limit))
        assert np.concatenate([c["at"] for c, _ in out]).tolist() == list(range(len(key)))
        ends = [(c["k"][a], b - a) for c, cut in out for a, b in zip(cut, cut[1:])]
        assert all(len(set(c["k"][a:b])) == 1 for c, cut in out for a, b in zip(cut, cut[1:]))
        for i, (k, n) in enumerate(ends[:-1]):
            if ends[i + 1][0] == k:
                assert limit and n > limit
    assert max(len(c["k"]) for c, _ in out) < 20


def test_shingles_are_dealt_out_once(spark, tmp_path):
    # keys that differ, though not in their last 28 bits
    path = str(tmp_path / "sets")
    spark.range(2000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), F.expr("transform(sequence(0, 49), x -> shiftleft(id * 50 + x, 28))").alias("first")).write.parquet(path)
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(store.executorList(False)))

    before = written()
    assert shingles.candidates(spark.read.parquet(path)).count() == 0
    once = written() - before
    before = written()
    spark.read.parquet(path).select("a", "b", F.explode("first").alias("key")).repartition("key").write.parquet(str(tmp_path / "dealt"))
    assert once < 1.2 * (written() - before)


def test_pipeline_drops_similar_documents(spark):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    got = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, None).select("doc_id").collect()}
    assert got == near_copies_by_brute_force([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize(
    "text, want",
    [
        ('config["db_pwd"] = "Xk9#fQ2!vLp7"', ["Xk9#fQ2!vLp7"]),
        ("os.environ['DB_PWD'] = 'Xk9#fQ2!vLp7'", ["Xk9#fQ2!vLp7"]),
        ('db_pwd: str = "Xk9#fQ2!vLp7"', ["Xk9#fQ2!vLp7"]),
        ('db_pwd: Optional[str] = "Xk9#fQ2!vLp7"', ["Xk9#fQ2!vLp7"]),
        ('db_pwd = shared = "Xk9#fQ2!vLp7"', ["Xk9#fQ2!vLp7"]),
        ('shared=db_pwd="Xk9#fQ2!vLp7"', ["Xk9#fQ2!vLp7"]),
        ('db_pwd = ("Xk9#fQ2!vLp7")', ["Xk9#fQ2!vLp7"]),
        ('db_pwds = pwd = [\n "Xk9#fQ2!vLp7",\n "Zk9#fQ2!vLp8"]', ["Xk9#fQ2!vLp7", "Zk9#fQ2!vLp8"]),
        ("db_pwd = `Xk9#fQ2!vLp7`", ["Xk9#fQ2!vLp7"]),
        ("db_pwd:\n  Xk9fQ2_vLp7\nx: 1", ["Xk9fQ2_vLp7"]),
        ('db_pwd: >\n  "Xk9#fQ2!vLp7"', ["Xk9#fQ2!vLp7"]),
        ('db_pwd = "Xk9#" + "fQ2!" + "vLp7"', ["Xk9#", "fQ2!", "vLp7"]),
        ('db_pwd = "correct horse battery staple"', ["correct horse battery staple"]),
        ('title = "correct horse battery staple"', []),
        ("if pwd:\n    process_this_9(x)", []),
        ("pwd:\n  name_of_it: 12", []),
        ("pwd = YWJjZGVmZ2hpSjk= other", ["YWJjZGVmZ2hpSjk="]),
    ],
)
def test_secrets_assignment_forms(text, want):
    assert [text[a:b] for a, b in secrets.lex(text.encode())] == want
