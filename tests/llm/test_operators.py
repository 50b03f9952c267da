import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspark.llm import ann, dedup, html, jaccard, language, mixing, pieces, sharding, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, __maybe int, score string, id int, word string"


def texts() -> list[str | None]:
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(12, 80))) for _ in range(40)]
    out: list[str | None] = list(base)
    for t in base[:12]:
        w = t.split()
        for _ in range(4):
            x = list(w)
            x[rng.randrange(len(x))] = "edited"
            out.append(" ".join(x))
        out += [t, t.replace(" ", "  \n"), t.upper()]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out += [f"{t} {passage}" for t in base[20:30]]
    return out + [None, "", " \n\t", "one", "one two", "ONE two", "x " * 30000, None, "é"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 1, "x", 2, "y") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "a text without an id", None, "s1", 1, "x", 2, "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact_dedup(docs, none):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), i is not None, i))
    want = {(i, (g := groups[re.sub(r"[\x20\x09-\x0D]+", "", t)]) and min(g)[2], len(g)) for i, t in rows}
    got = dedup.exact_dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == want and len(got) == len(rows)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.keep_id for r in got})
    assert dedup.exact_dedup(none).count() == 0


def test_exact_dedup_in_parts(docs, monkeypatch):
    want = Counter(dedup.exact_dedup(docs).collect())
    monkeypatch.setattr(dedup, "MOST_BITS", 512)  # a few dozen rows a part
    assert Counter(dedup.exact_dedup(docs).collect()) == want


def shingles(t: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


@pytest.mark.parametrize("crowd, large", [(64, 250_000), (2, 0)])
def test_jaccard_join(docs, none, crowd, large):
    sets = {r.doc_id: shingles(r.text) for r in docs.where("doc_id is not null").collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, crowd=crowd, large=large).collect()}
    assert {i: got[i] for i in sets} == {i: (len(sets[i]), find(i)) for i in sets}
    assert got[None][1] is None
    if crowd == 2:
        assert jaccard.join(none).count() == 0


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_structure_differ(spark):
    pairs = [(w, w.translate(str.maketrans("ab", "ba"))) for w in map(thue_morse, (64, 1024, 8192))]
    rows = [(i, w) for i, w in enumerate(x for p in pairs for x in p)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(6)]
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), tokens.counter(path)
    import pyarrow as pa

    texts = [" ".join(p) for p in pairs]
    assert own.count(pa.array(texts)).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_jaccard_cells_keep_every_link(spark):
    # many versions of a few texts, most of them out of reach of each other: regions are divided at once and again
    rng, rows = random.Random(12), []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(70):
            w = list(base)
            for k in rng.sample(range(120), rng.choice([1, 3, 4, 5, 6, 8])):
                w[k] = f"w{rng.randrange(5000)}"
            rows.append(" ".join(w))
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for crowd, large in ((64, 0), (2, 500)):
        assert {r.doc_id: r.component_id for r in jaccard.join(df, crowd=crowd, large=large).collect()} == dict(enumerate(root))


def test_jaccard_compares_in_rows_of_points_not_pairs(spark, monkeypatch):
    # a cell of versions of one text, within and a little out of each other's reach, so that only whole sets tell
    rng, rows = random.Random(5), []
    for _ in range(200):
        w = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(0, 120, 6), rng.choice([2, 3, 5])):
            w[k] = f"v{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert 1 < len(set(root)) < len(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    info = jaccard.prefixes(df, np.empty(0, np.uint64), 5).select(F.col("id").alias("node"), "n", "mask").cache()
    cells = df.selectExpr("1L AS cell", "id AS node", "0D AS lo", "1D AS hi", "id AS label", "-1L AS own", "200L AS points", "200L AS others")
    for side in (2048, 64):
        monkeypatch.setattr(jaccard, "SIDE", side)
        near = jaccard._compare(cells, info).cache()
        assert near.count() <= len(rows)
        links = jaccard._connect(near, df, 5)
        assert links.count() < len(rows) * (-(-len(rows) // side)) ** 2
        found = {r.node: r.label for r in jaccard.components(links).collect()}
        assert [found.get(i, i) for i in range(len(rows))] == root


def test_jaccard_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (5, b), (5, a), (7, c)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (5, 1), (7, 7)} and len(got) == 5


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs).collect())
    goal = mixing.targets({"a": 100, "b": 10, None: 50})
    assert goal["b"] == 20 and goal["a"] + goal[None] == pytest.approx(220)
    plan = mixing.Plan(docs)
    assert plan.mixed(docs).columns == docs.columns
    assert plan.mixed(docs).select(F.sum(mixing.n_words(F.col("text")))).head()[0] == sum(r.taken for r in rows)
    assert mixing.mix(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.propagate(docs, shards=7).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in rows)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) <= 2
    assert sharding.propagate(none).count() == 0


def test_sharding_does_not_depend_on_partitions(docs):
    def run(n):
        return Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.propagate(docs.repartition(n), shards=5).collect())

    assert run(2) == run(5)


@pytest.mark.parametrize("few", [64, 1])
def test_sharding_keeps_groups_together(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW", few)
    sizes = [400, 150, 110, *[55] * 3, *[12] * 10, *[3] * 40]
    rows = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    rows += [f"single {i}" for i in range(1200 - len(rows))]
    got = sharding.propagate(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shards=10).collect()
    assert len(got) == 1200 and set(Counter(r.shard for r in got).values()) == {120}
    where = defaultdict(set)
    for r in got:
        where[rows[r.doc_id]].add(r.shard)
    assert [len(where[f"group {g}"]) for g in range(len(sizes))] == [-(-n // 120) for n in sizes]


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    odd = ["it's we're 's\n's''s don'tx", "  a  b\n\n c\t", "a<|endoftext|> b <|endoftext|>", "x՘y\U0001f600 　z\x85 \x1c q", "''ll 've", "a 'll"]
    odd += ["".join(rng.choice("ab 1!'\n\tsrelvtmd՘Ⅷé") for _ in range(50)) for _ in range(300)]
    import pyarrow as pa

    assert tokens.counter(path).count(pa.array(odd)).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in odd]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokens.count_tokens(docs, path).collect():
        assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(lib.encode(text[r.doc_id], add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 1024)
    assert tokens.count_tokens(none, path).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    rng = random.Random(2)
    odd = ["  hello  world", "\n\nfoo", "x▁y", "hello<s>", "日本語", "\U0001f600é", " ", "a" * 500, "ab" * 200]
    odd += ["".join(rng.choice("abcdeth  \n.é日,<>s/0x") for _ in range(60)) for _ in range(300)]
    assert [own.encode(t) for t in odd] == [lib.encode(t) for t in odd]
    for t in odd:  # the streaming search, a character at a time, holds a bounded window
        search, out, most = pieces.Viterbi(own), [], 0
        for c in pieces.SPACE + t.replace(" ", pieces.SPACE):
            out += search.push(c)
            most = max(most, len(search.text))
        assert out + search.finish() == lib.encode(t) and most <= 4 * own.longest
        whole = pieces.SPACE + t.replace(" ", pieces.SPACE)
        assert own.segment(whole) == lib.encode(t)  # no boundary known beforehand
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(260), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == lib.decode(ids), ids
    coded = pieces.encode(docs.withColumn("a.b", F.lit(1)), path)
    back = pieces.decode(coded, path, text_col="back").collect()
    assert all(r.back == (r.text or "").replace(pieces.SPACE, " ") for r in back) and "a.b" in coded.columns
    rows = pieces.round_trip(docs, path).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.exact and list(r.ids) == lib.encode(text[r.doc_id]) for r in rows) and len(rows) == docs.count()
    assert pieces.encode(none, path).count() == 0


def test_pieces_in_blocks(monkeypatch):
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(11)
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    monkeypatch.setattr(pieces, "BLOCK", 40)
    for _ in range(500):
        t = "".join(rng.choice([" ", "  ", "\n", " \n", pieces.SPACE, "a", "the", "Über", "\t", "字", "🙂", "word,"]) for _ in range(rng.randrange(300)))
        assert own.encode(t) == lib.encode(t)


def test_unigram_pieces(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng, m = random.Random(21), proto.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.trainer_spec.unk_surface = " ? "
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for text, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=text, score=0, type=kind)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    words = {"a", "b", "c", pieces.SPACE} | {"".join(rng.choice("abc" + pieces.SPACE) for _ in range(rng.randint(2, 6))) for _ in range(150)}
    for w in sorted(words):
        m.pieces.add(piece=w, score=-rng.uniform(2, 12), type=1)
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=path.read_bytes()), pieces.model(str(path))
    for _ in range(500):
        t = "".join(rng.choice("aabbcc  é") for _ in range(rng.randrange(60)))
        assert own.encode(t) == lib.encode(t), t
        assert own.decode(lib.encode(t)) == lib.decode(lib.encode(t))


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        w = [rng.choice(vocab) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["VILE!!", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (99999, 1)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, y).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    # training against the same rule applied one row at a time, features and all
    texts = [r[1] for r in rows]
    plain = toxicity.sample(d, y).orderBy("row").collect()
    assert {r.row for r in plain} == set(range(len(plain))) and all(zlib.crc32(str(texts.index(r.text)).encode()) % 4 != 2 for r in plain)
    found = {r.row: r.features for r in toxicity.bags(toxicity.sample(d, y)).collect()}
    for r in plain[:50]:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[A-Za-z]+", r.text)]
        want = {(x,) for x in w} | set(zip(w, w[1:])) | set(zip(w, [None] * 99, w[2:])) | set(zip(w, w[1:], w[2:]))
        assert len(found[r.row]) == len(want)
    count = Counter(f for x in found.values() for f in x)
    bags = [np.array([f for f in found[r.row] if count[f] >= toxicity.SUPPORT], np.int32) for r in plain]
    at, weight, bias = toxicity.fit(d, y)
    z, n, z0, n0, a, l1 = defaultdict(float), defaultdict(float), 0.0, 0.0, 2.4, 8.0
    wz = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((1 + np.sqrt(n[f])) / a + 1)
    order = np.argsort(toxicity.K.mix(np.array([r.row for r in plain], np.uint64))).tolist()
    for _ in range(toxicity.EPOCHS):
        for i in order:
            own, b = {f: wz(f) for f in bags[i].tolist()}, -z0 / ((1 + np.sqrt(n0)) / a)
            g = 1 / (1 + np.exp(-(sum(own.values()) + b))) - plain[i].label
            if abs(g) >= 1e-4:
                for f, w in own.items():
                    z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / a * w
                    n[f] += g * g
                z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / a * b
                n0 += g * g
    assert {f for f in z if abs(z[f]) > l1} == set(at.tolist()) and np.allclose([wz(f) for f in at.tolist()], weight, atol=1e-4)
    model = toxicity.fit(docs, y.where("false"))
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0


def test_language(spark, none):
    rng = random.Random(8)
    roots = {"de": ["ung", "sch", "keit", "der"], "fr": ["eau", "tion", "oui", "les"], "en": ["the", "ing", "and", "ly"]}
    rows = [(i, " ".join("".join(rng.choice(roots[x]) for _ in range(rng.randint(1, 3))) for _ in range(40)), x) for i, x in enumerate(rng.choice(list(roots)) for _ in range(600))]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 ...", "en"), (None, "the and", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got if r.held_out and r.doc_id < 1000]) > 0.98
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language.identify(none).count() == 0
    # forward-backward against the sum over all label sequences
    crf = language.Crf(["a", "b"], np.empty(0, np.uint64), np.empty(0, np.int32))
    crf.step, crf.begin = np.array([[0.5, -1.0], [0.2, 0.3]]), np.zeros(2)
    e = np.random.default_rng(0).standard_normal((5, 2)).astype(np.float32)
    total, mass = 0.0, np.zeros((5, 2))
    for k in range(32):
        s = [k >> i & 1 for i in range(5)]
        p = np.exp(sum(e[i, x] for i, x in enumerate(s)) + sum(crf.step[a, b] for a, b in zip(s, s[1:])))
        total += p
        for i, x in enumerate(s):
            mass[i, x] += p
    assert np.allclose(crf.posteriors(e, np.array([0, 5])), mass / total, atol=1e-5)


def test_language_sample_is_not_a_prefix_of_the_ids(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_BYTES", 40_000)
    rng = random.Random(9)
    roots = {"de": ["ung", "sch", "keit", "der"], "fr": ["eau", "tion", "oui", "les"]}
    rows = [(i, " ".join("".join(rng.choice(roots[x]) for _ in range(2)) for _ in range(40)), x) for i, x in enumerate(["de"] * 300 + ["fr"] * 300, 10)]
    rows += [(0, "ungsch " * 6000, "de"), (1, "eauoui " * 5000, "fr")]
    crf = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert crf.labels == ["de", "fr"]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), crf).collect()
    assert np.mean([r.lang_pred == x for r, (_, _, x) in zip(sorted(got), sorted(rows))]) > 0.98
    sample = [{"id": i, "lang": x, "code": i, "size": n} for i, (x, n) in enumerate([("a", 90), ("a", 20), ("b", 30), ("a", 20), ("b", 30), ("a", 5)])]
    assert language.choose([*sample, sample[1]], 100) == [1, 2, 3, 5] and language.choose([], 100) == []


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/a">menu</a></li></ul></nav>
    <div class="ad">Buy, now.</div><article><h1>Head &amp; line</h1><p><b>First   para,\n one.<br>two<p>Second &lt;para&gt;.</p><aside>see also</aside><ul><li>point</ul></article>
    <div id="comments"><p>A comment, quite long, with many words, and commas, to look like text.</p></div><form>Name <input></form><footer>&copy; me</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (5, "u", page[:340]), (None, "u", "<p>a<p cla")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    assert got[1].text == "Head & line\n\nFirst para, one. two\n\nSecond <para>.\n\npoint" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text, got[None].text) == ("", "", "plain text", "a")
    assert "menu" not in got[5].text and html.extract(rows.where("false")).count() == 0


def test_html_keeps_all_of_the_article():
    long, short = "A long sentence, with some commas, and so on. " * 14, "Shorter words, in a paragraph. " * 10
    for tag in ("section", "div", "blockquote"):
        page = f"<body><article><h1>Head</h1><p>Lead.</p>{f'<p>{short}</p>' * 4}<{tag}>{f'<p>{long}</p>' * 2}</{tag}></article><div><p>Elsewhere.</p></div></body>"
        assert html.main_text(page).split("\n\n") == ["Head", "Lead.", *[short.strip()] * 4, *[long.strip()] * 2]
    page = f"<body><div><ul><li><a>one</a><li><a>two</a></ul></div><h1>Head</h1><p>Lead.</p><div class=content><p>{long}</p><p>{long}</p></div></body>"
    assert html.main_text(page).split("\n\n") == ["Head", "Lead.", *[long.strip()] * 2]


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "content-sidebar-wrap", "with-comments", "post-share-enabled", "main-banner-layout"])
def test_html_wrapper_names_do_not_empty_a_page(name):
    text, extra = "Some words of the page, and more of them. " * 5, '<div class="sidebar"><p>Aside.</p></div><div id="comments"><article class="comment"><p>I say.</p></article></div>'
    assert html.main_text(f'<body><div class="{name}"><article><p>{text}</p></article>{extra}</div></body>') == text.strip()
    assert html.main_text(f'<body><div id="{name.split()[-1]}"><p>{text}</p>{extra}</div></body>') == text.strip()
    assert html.main_text(f'<body><article><div class="{name}"><p>{text}</p></div>{extra}</article></body>') == text.strip()


def test_html_parsing_and_names():
    text = "Some words of the page, and more of them, to the end of it. " * 4
    page = lambda x: f"<body>{x}<p>{text}</p></body>"
    kept = {
        '<p title="the hidden cost">Cost.</p>': "Cost.", '<p data-id="ad">Data.</p>': "Data.", "<p title=it's>First</p><p>don't stop</p>": "First\n\ndon't stop",
        '<p title="a > b">Sign.</p>': "Sign.", "<p hidden>No.</p>": None, '<p class="hidden-fact">Yes.</p>': "Yes.",
    }
    for x, want in kept.items():
        assert html.main_text(page(x)) == "\n\n".join(filter(None, [want, text.strip()])), x
    for name in ("content with-sidebar", "comment-on-law", "no-ads"):
        assert html.main_text(f'<body><article><p>Lead.</p><div class="{name}"><p>{text}</p></div></article></body>').split("\n\n") == ["Lead.", text.strip()]
    assert html.main_text(f"<article><header><h1>Title</h1></header><div><p>{text}</p></div></article>") == f"Title\n\n{text.strip()}"


def test_html_ratios_choose():
    text = "Some words of the page, and more of them, to the end of it. " * 4
    cards = "".join(f'<article class="card"><h3>Card {i}</h3></article>' for i in range(3))
    page = f"<body><div>Plain chrome</div><div class=story><p>{text}</p><div class=mid>Amid</div><p>{text}</p></div><div>More chrome</div></body>"
    assert html.main_text(page).split("\n\n") == [text.strip(), "Amid", text.strip()]
    assert "chrome" in html.main_text(page, ratios=False)
    page = f"<body><article><h1>Head</h1><p>{text}</p></article>{cards}</body>"
    assert html.main_text(page).split("\n\n") == ["Head", text.strip()]
    assert "Card 1" in html.main_text(page, ratios=False)


def test_html_time_is_linear_in_depth():
    import time

    n = 5000
    began = time.time()
    assert html.main_text("".join(f"<div>w{i} " for i in range(n))).count("\n\n") == n - 1
    assert html.main_text("<div>" * n + "</p>" * n + "x" * 2_000_000).endswith("x")
    assert time.time() - began < 2


def test_html_rows(spark):
    page = "<body><p>One text, and some more of it.</p></body>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, "", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract(rows.withColumn("a.b", F.lit(1))).collect()) == [(1, "One text, and some more of it."), (1, "One text, and some more of it."), (2, "")]


def test_html_keeps_linked_blocks_of_the_article():
    text = "Some words of the page, and more of them. " * 5
    page = f'<body><article><h1><a href="/a">Head</a></h1><p>{text}</p><p><a href="/b">One linked sentence.</a></p><ul><li><a href="/c">Source</a></ul></article></body>'
    assert html.main_text(page).split("\n\n") == ["Head", text.strip(), "One linked sentence.", "Source"]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((5, 12))[rng.integers(5, size=900)] * 2 + rng.standard_normal((900, 12))
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)] + [(1000 + i, [1.0] * 12) for i in range(300)]
    rows += [(2000, None), (2100, [0.0] * 12), (2200, [None] * 12), (2300, [float("nan")] * 12), (2400, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, block_rows=100).collect()
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and i < 2000]
    hits = n = 0
    for q, x in good:
        if q % 100:
            continue
        want = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:10]
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        hits += len({i for _, i in want} & {r[2] for r in own}) if q < 1000 else 10 * (want[-1][0] == own[-1][1])
        n += 10
    assert hits / n >= 0.9 and not {r.query_id for r in got} & {2000, 2100, 2200, 2300, 2400}
    assert ann.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_stopping_test_verifies_a_part():
    rng = np.random.default_rng(10)
    v = rng.standard_normal((6000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    points = v @ np.random.default_rng(11).standard_normal((64, ann.DIMS))
    block, hits = ann.Block(np.arange(6000), v, points), 0
    for i in range(60):
        d, ids = block.search(i, v[i], points[i], 10, ann.chi2_quantile(ann.SURE, ann.DIMS), float("inf"))
        far = ((v - v[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 600 and block.verified < 60 * 6000 * 0.4


def test_nearest_neighbours_of_repeated_rows_and_ties(spark):
    rows = [(i, [float(i // 2), 1.0]) for i in range(40)] + [(100, [3.0, 1.0])] * 2 + [(200, [-1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=3)
    own = [(r.rank, r.vec_id, r.score) for r in got.where("query_id = 200").orderBy("rank").collect()]
    assert own == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 2.0)]
    assert got.where("query_id = 100 and vec_id in (6, 7) and score = 0").count() >= 2


def test_language_blocks_give_plain_forward_backward():
    rng = np.random.default_rng(3)
    crf = language.Crf(["a", "b", "c"], np.empty(0, np.uint64), np.empty(0, np.int32))
    crf.step[:], crf.begin[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [0, 1, language.BLOCK, 3 * language.BLOCK + 5, 0, language.BLOCK + 1, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission = rng.normal(size=(first[-1], 3)) * 3
    got = crf.posteriors(emission, first)
    for lo, hi in zip(first[:-1], first[1:]):
        p, go = np.exp(emission[lo:hi]), np.exp(crf.step)
        f, r = p.copy(), np.ones_like(p)
        for t in range(hi - lo):
            f[t] *= np.exp(crf.begin) if t == 0 else f[t - 1] @ go
            f[t] /= f[t].sum()
        for t in range(hi - lo - 2, -1, -1):
            r[t] = go @ (p[t + 1] * r[t + 1])
            r[t] /= r[t].sum()
        assert np.allclose(got[lo:hi], f * r / (f * r).sum(axis=1, keepdims=True), atol=1e-9)
