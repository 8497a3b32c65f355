"""BPE, fingerprints, media, page text, models and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, components, kneser_ney, mpeg, neighbours, ppm, simhash, site_tree
from millrace.llm.common import fold

SCHEMA = "doc_id long, text string, source string"
ODD = [None, "", " ", "one", "one two", "Ünïcödé Σίσυφος İ ſ", "a\u0085b​c\x1cd", "<|endoftext|> x <|startoftext|>", "th" * 3000, "it's he'll 1234 ½ 中文 🎉", "word " * 4000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, "one", "s"), (None, "one two", None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit(1), "held_out": F.lit(2), "score": F.lit("x"), "word": F.lit("y"), "label_id": F.lit(3), "toxic": F.lit(1), "quality": F.lit("z"), "root": F.lit(0), "gone doc_id": F.lit(1)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- BPE ------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, sf_dir, odd, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    reference.no_truncation()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text").where("doc_id is not null"))
    given = {r.doc_id: r.text or "" for r in texts.collect()}
    for r in bpe.encode(texts).collect():
        ids = reference.encode(given[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == reference.decode(ids, skip_special_tokens=False)
    for r in bpe.encode(texts, digests=True).collect():
        ids = reference.encode(given[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(nothing).count() == 0 and bpe.encode(odd).count() == odd.count()


def test_bpe_pairs_of_vocabulary_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference, own, rnd = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.WordBpe(bpe.vocabulary()), random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(own.tokens).replace("</w>", "") for _ in range(rnd.randint(1, 5)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


# -- SimHash ----------------------------------------------------------------------
def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("limit", [20_000, 4])
def test_simhash_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    for t in texts[:25]:
        for _ in range(4):
            w = t.split()
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    texts += [None, "", " \t", texts[0], texts[0], "solo"]
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    fps = [slow_fingerprint(t) for t in texts]
    label = slow_components(fps)
    least = defaultdict(lambda: 10**9)
    for i, c in zip(ids, label, strict=True):
        least[c] = min(least[c], i)
    want = {(i, f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, label, strict=True)}
    df = spark.createDataFrame([(i, t, "s") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    assert {tuple(r) for r in simhash.components(df).collect()} == want
    assert {r.doc_id for r in simhash.dedup(df).collect()} == set(least.values())


def test_simhash_dedup_goes_by_rows(spark):
    near = " ".join(f"w{i}" for i in range(300))
    rows = [(1, near, "a"), (7, near + " x", "b"), (7, "something else entirely that nothing is like", "c"), (7, "something else entirely that nothing is like", "d"), (None, near, "e"), (None, "a text of its own without any id at all", "f")]
    out = simhash.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out if r.doc_id is not None) == sorted((False, i, t) for i, t in {(1, near), (7, rows[2][1])})
    assert [r.text for r in out if r.doc_id is None] == [rows[5][1]]


def test_simhash_edges(odd, nothing):
    assert simhash.components(odd).count() == odd.count() and simhash.components(nothing).count() == 0
    assert simhash.dedup(odd).columns == odd.columns


def test_trie_join_on_planted_bits():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:30]:
        for _ in range(20):
            m = 0
            for k in rng.choice(64, rng.integers(0, 6), replace=False):
                m |= 1 << int(k)
            fps.add(int(b) ^ m)
    x = np.sort(np.array(sorted(fps), np.uint64))
    same = np.zeros(len(x), np.int64)
    got = simhash.join_block(np.zeros(1, np.int64), same, x, np.zeros(1, np.int64))
    assert got.tolist() == slow_components([int(v) for v in x])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[k] == 100 for k in range(101, 140)) and 200 not in got


# -- MPEG -----------------------------------------------------------------------------
@pytest.mark.parametrize("size", [0, 1, 64, 65, 1006, 1007, 50_000])
def test_mpeg_round_trip(size):
    payload = mpeg.padded(random.Random(size).randbytes(size))
    s = mpeg.parse(mpeg.build(payload))
    assert s.payload == payload and s.crc_ok == s.checked == s.frames == s.xing["frames"] and s.resyncs == 0
    assert s.samples == 1152 * s.frames and s.duration_us == s.samples * 10**6 // 44100


def test_mpeg_resynchronises_and_notices_damage():
    whole = mpeg.build(random.Random(1).randbytes(9000))
    s = mpeg.parse(whole)
    cut = mpeg.parse(whole[: s.offsets[2]] + b"\xff\xfbnoise\xff" + whole[s.offsets[2] :])
    assert cut.frames == s.frames and cut.resyncs == 1 and cut.payload == s.payload
    bad = bytearray(whole)
    bad[s.offsets[1] + 10] ^= 1
    assert mpeg.parse(bytes(bad)).crc_ok == s.frames - 1
    assert mpeg.parse(b"").frames == 0 and mpeg.parse(b"\xff" * 999).frames == 0
    assert all(mpeg.header(whole[o : o + 4]) for o in s.offsets.tolist())


def test_mpeg_reads_the_other_bitrate_table():
    import struct

    whole = mpeg.build(b"payload" * 900)
    _, tags = mpeg._id3v2(whole)
    at = next(i for i in range(len(whole)) if mpeg.header(whole[i : i + 4]) and whole[i : i + 200].find(b"Xing") > 0)
    h = mpeg.header(whole[at : at + 4])
    body = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 12345, 3, 2, 10, 2, 1) + struct.pack(">HH", 7, 9)
    other = whole[:at] + whole[at : at + 4] + (bytes(32) + body).ljust(h.length - 4, b"\0") + whole[at + h.length :]
    s = mpeg.parse(other)
    assert s.xing == {"kind": "VBRI", "frames": 3, "bytes": 12345, "quality": 75, "toc": [70, 90], "frames_per_entry": 1}
    assert s.payload == mpeg.parse(whole).payload and tags
    cut = other[: at + 50]
    assert mpeg.parse(cut).frames == 0


def test_mpeg_damaged_tags():
    whole = mpeg.build(b"payload" * 99)
    at = whole.index(b"payload_bytes\0") + len(b"payload_bytes\0")
    for damage in (b"x1", b"\xb2\xb2", b"-1"):
        s = mpeg.parse(whole[:at] + damage + whole[at + 2 :])
        assert s.frames and s.payload.startswith(b"payload") and mpeg.feature(s)


def test_mpeg_columns(odd, nothing):
    for r in mpeg.read(mpeg.store(odd)).collect():
        raw = (ODD[r.doc_id] or "").encode() if r.doc_id is not None else b"one two"
        kept = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-64:]))
    assert mpeg.read(mpeg.store(nothing)).count() == 0


# -- pages -------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>x</nav><article><h1>T</h1><p>a&nbsp;&amp;\n b<p>c</article><footer>f</footer>", "T\na & b\nc"), ("", ""), (None, ""), ("<p>a", "a"), ("1 < 2", "1 < 2"),
        ("<div class='side-bar sidebar'>s</div><div>m <i>n</i></div><script>if (a < b) x</script>", "m n"), ("<article>x<aside>y</aside><div id='comments'>c</div>z</article>", "x\nz"), ("<main><ul><li>a<li>b</ul><form>f<p>g</p></form></main>", "a\nb"),
    ],
)
def test_main_text(page, text):
    assert site_tree.main_text(page or "", frozenset(), "http://h/x") == text


def test_style_tree_removes_what_a_host_repeats(spark):
    rnd = random.Random(4)
    pages = [(i, f"http://h.example/{i}", f"<body><div><span>Read more on this site</span></div><div class='x'><p>{' '.join(rnd.choices(['aa', 'bb', 'cc', 'dd'], k=30))}</p></div></body>") for i in range(30)]
    pages += [(100 + i, f"http://copy.example/{i}", "<body><p>the very same article on every page</p></body>") for i in range(20)] + [(200, None, None), (200, None, None)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("Read more" not in got[i] and got[i] for i in range(30))
    assert all(got[100 + i] == "the very same article on every page" for i in range(20)) and got[200] == ""
    assert site_tree.extract(spark.createDataFrame([], "page_id long, url string, html string, low string")).count() == 0


def test_style_tree_counts_different_pages(spark):
    rnd = random.Random(6)
    said = lambda k: " ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee"], k=k))
    law = "all rights of every kind remain with the owner of this site " * 5  # longer than any article
    pages = [(i, f"http://law.example/{i}", f"<body><div class='x'><p>{said(30)}</p></div><div class='y'><p>{law}</p></div></body>") for i in range(30)]
    pages += [(100 + i, f"http://line.example/{i}", "<body><div class='x'>" + "".join(f"<p>{said(20)}</p>" for _ in range(10)) + "<p>Read more here</p></div></body>") for i in range(30)]
    pages += [(200 + i, f"http://copy.example/{i}", f"<body><p>one article on every page</p><div class='y'><p>hint {i % 3}</p></div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("rights" not in got[i] and got[i] for i in range(30))
    assert all("Read more" not in got[100 + i] and got[100 + i].count("\n") == 9 for i in range(30))
    assert all("one article" in got[200 + i] for i in range(20))


def test_pages_of_the_fixture(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    for r in site_tree.extract(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", given[r.page_id], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:h1|p|br)>", inside))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_main_text_keeps_what_only_sounds_like_noise():
    page = "<div class='reader'><article><h1>T</h1><figure><img src=x><figcaption>of it</figcaption></figure><h2 class='head'>H</h2><p class='alert'>A</p><p>a</p></article></div>"
    assert site_tree.main_text(page, frozenset(), None) == "T\nof it\nH\nA\na"
    assert site_tree.main_text("<div class='reader'><p>kept</p></div>", frozenset(), None) == "kept"


def test_pages_nested_deeply_take_linear_time():
    import time

    took = []
    for n in (5_000, 50_000):
        page = "<b>" + "<div>x</b><i>" * n + "<p>end" + "</div>" * n
        began = time.perf_counter()
        text = site_tree.main_text(page, frozenset({1}), "http://h/x")
        took.append(time.perf_counter() - began)
        assert text.count("x") == n and text.endswith("end")
    assert took[1] < 30 * took[0]


def neutral(pages):
    """The fixture's pages with tags and names that declare nothing."""
    html = F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|footer|article)\\b", "<$1div"), 'class="ad"', 'class="b"')
    for k, (begun, name) in enumerate((("<ul>", "a"), ("<h1>", "c"), ("&copy;", "d"))):
        html = F.regexp_replace(html, f"<div>{begun}", f'<div class="{name}">{begun}')
    return pages.withColumn("html", html)


def test_style_tree_decides_on_pages_that_declare_nothing(spark):
    """With the tree the articles, exactly; without it menus, adverts and footers stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    plain = neutral(pages)
    assert {r.page_id: r.text for r in site_tree.extract(plain).collect()} == want
    off = {r.page_id: site_tree.main_text(r.html, frozenset(), r.url) for r in plain.collect()}
    assert all(off[i] != want[i] for i in want)
    joined = site_tree.extract(plain, held=0)  # low items joined to pages instead of broadcast
    assert {r.page_id: r.text for r in joined.collect()} == want


def slow_importances(pages):
    """{(host, path): (m, presentation, content)} by dictionaries."""
    styles, texts, sizes, linked = defaultdict(dict), defaultdict(lambda: defaultdict(set)), defaultdict(dict), defaultdict(dict)
    for url, page in pages:
        at = site_tree.host(url)
        found, nodes = site_tree.parse(page or "")
        found = [b for b in found if not b.noise]
        size, said = Counter(), defaultdict(set)
        for b in found:
            size[b.path] += len(b.text)
            said[b.path].add(b.text)
        mark, left = [], 0.9 * size.total()
        for path, n in sorted(size.items(), key=lambda x: (-x[1], x[0])):
            if left > 0:
                mark.append((path, frozenset(said[path])))
            left -= n
        mark, style = frozenset(mark), defaultdict(list)
        for n in nodes:
            if not n.noise:
                style[n.path] += ["<", *n.children]
        for path, own in style.items():
            styles[at, path][mark, tuple(own)] = tuple(own)  # a page differs by its mark or by the node's style
        for b in found:
            texts[at, b.path][b.text].add(mark)
            sizes[at, b.path][b.text, mark] = len(b.text)
            linked[at, b.path][b.text, mark] = len(b.text) * b.linked
    first = {}
    for key, by in styles.items():
        m, total = len(by), sum(sizes[key].values())
        most = math.log(m)
        style = sum(-n / m * math.log(n / m) for n in Counter(by.values()).values()) / most if m > 1 else 1.0
        same = np.mean([math.log(len(marks)) for marks in texts[key].values()]) / most if m > 1 and texts[key] else 0.0
        first[key] = (m, style, max(0.0, 1 - same) * (1 - (sum(linked[key].values()) / total if total else 0)), total)
    weight = defaultdict(float)
    for (at, _), (_, _, content, total) in first.items():
        weight[at] += total * content
    second = {k: (m, max(s, n * c / weight[k[0]] if weight[k[0]] else 0.0), c) for k, (m, s, c, n) in first.items()}
    everywhere = defaultdict(lambda: np.zeros(3))
    for (_, path), (m, p, c) in second.items():
        everywhere[path] += (m - 1, (m - 1) * p, (m - 1) * c)
    out = {}
    for (at, path), (m, p, c) in second.items():
        w, wp, wc = everywhere[path]
        out[at, path] = (m, ((m - 1) * p + 4 * (wp + 4) / (w + 4)) / (m + 3), ((m - 1) * c + 4 * (wc + 4) / (w + 4)) / (m + 3))
    return out


def test_style_tree_equals_brute_force(spark, sf_dir):
    pages = neutral(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    given = [(r.url, r.html) for r in pages.orderBy("page_id").limit(50).collect()]
    given += given[:5] + [("http://one.example/1", "<p>once</p>"), (None, None)]
    want = {(site_tree._hash(at), path): v for (at, path), v in slow_importances(given).items()}
    got = site_tree.importances(spark.createDataFrame(given, "url string, html string"))[0].collect()
    assert {(r.host, r.path) for r in got} == set(want)
    assert all(np.allclose((r.m, r.presentation, r.content), want[r.host, r.path]) for r in got)


def test_quality_equals_brute_force(spark, sf_dir):
    """Votes of the nearest by plain sorting, ties to the smaller hashed id; copies tie exactly."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000))
    labels = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("quality", 1 - F.col("quality")))
    space = neighbours.train(docs, labels, 3, 1, "doc_id", "text")
    got = {r.doc_id: r.score for r in neighbours.score(docs, labels).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        tf = neighbours.terms((r.text or "").encode())[None, :]
        q = neighbours._unit(neighbours._weighted(tf, space.idf) @ space.basis)[0]
        near = [round(float(np.dot(q.astype(np.float64), v.astype(np.float64))), neighbours.DIGITS) for v in space.known]
        first = sorted(range(len(near)), key=lambda i: (-near[i], i))[: neighbours.NEIGHBOURS]  # noqa: B023
        w = [max(0.0, near[i]) ** 8 for i in first]
        vote = (sum(a * space.label[i] for a, i in zip(w, first, strict=True)) + 0.05 * space.share) / (sum(w) + 0.05)
        assert abs(got[r.doc_id] - (vote if tf.sum() else space.share)) < 0.07  # a tie of floats may fall either way


def test_nearest_gives_ties_to_the_first():
    near = np.array([[1, 2, 2, 2, 0], [5, 5, 5, 5, 5], [1, 2, 3, 4, 5]], np.float32)
    assert neighbours.nearest(near, 2).tolist() == [[1, 2], [0, 1], [3, 4]]
    assert neighbours.nearest(near, 5).tolist() == [[0, 1, 2, 3, 4]] * 3


def test_components_raise_when_rounds_run_out(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="still change"):
        components.roots(spark.createDataFrame([(i + 1, i) for i in range(50)], "a long, b long"))


# -- models ---------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = neighbours.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)


def toxic_corpus(spark):
    rnd = random.Random(9)
    plain = ["".join(rnd.choices(["ta", "ro", "mi", "lo", "ke"], k=3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words, toxic = [rnd.choice(plain) for _ in range(rnd.randint(20, 300))], i % 5 == 0
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["idiot", "scumbag", "scumball", "scumface"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, None if i % 50 == 1 else 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = toxic_corpus(spark)
    got = kneser_ney.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.predicted == r.toxic for r in got) and len(got) > 50
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxicity_of_expressions_in_few_documents(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghijklmnoprstuvz", k=9))
    plain, rare, rows, labels = [word() for _ in range(150)], [word() for _ in range(60)], [], []
    for i in range(800):
        said, toxic = rnd.choices(plain, k=25), i % 2
        rows.append((i, " ".join([*said, *rnd.choices(rare, k=toxic)]), "s"))  # each in about six of 400 documents
        labels.append((i, 1, toxic))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = kneser_ney.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got) > 100


def plain_kneser_ney(texts):
    """Both classes' probability of a word, by dictionaries: texts are (text, class)."""
    counts, children, vocabulary = [Counter(), Counter()], [defaultdict(set), defaultdict(set)], set()
    for text, y in texts:
        for w in set(kneser_ney.words(text)):
            vocabulary.add(w)
            above = ""
            counts[y][above] += 1
            for u in kneser_ney.chain(w):
                counts[y][u] += 1
                children[y][above].add(u)
                above = u
    kinds = Counter(u for w in vocabulary for u in ["", *kneser_ney.chain(w)])
    discounts = []
    for own in counts:
        times = Counter(n for u, n in own.items() if u)
        discounts.append(times[1] / (times[1] + 2 * times[2]) if times[1] else 0.5)

    def p(word, y):
        out, above = 1.0, ""
        for u in kneser_ney.chain(word):
            shared = (kinds[u] or 1) / (kinds[above] + 1)
            total, off = counts[y][above], discounts[y]
            out *= (max(counts[y][u] - off, 0) + off * len(children[y][above]) * shared) / total if total else shared
            if not kinds[u]:
                break
            above = u
        return out

    return p, vocabulary


@pytest.fixture(scope="module")
def small_models(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).collect()]
    rows = [(t, i % 2, i // 2 % 2) for i, t in enumerate(texts)]
    units, n = kneser_ney.learned(spark.createDataFrame(rows, "text string, toxic int, half int"))
    model = kneser_ney.Model(*units, [n["n00"] + n["n01"], n["n10"] + n["n11"]])
    return model, *plain_kneser_ney([r[:2] for r in rows])


def test_kneser_ney_equals_brute_force(small_models):
    model, p, vocabulary = small_models
    said = [*sorted(vocabulary), "neverseen", "the\u0001", "x"]
    want = np.log([[p(w, y) for w in said] for y in (0, 1)])
    assert np.allclose(model.log_p(said), want)


def test_kneser_ney_sums_to_one(small_models):
    """All known words, and one unseen continuation of each known beginning."""
    model, _, vocabulary = small_models
    begun = {u for w in vocabulary for u in kneser_ney.chain(w)[:-1]} | {""}
    said = [*vocabulary, *[b + "\u0001" * 9 for b in begun]]
    assert np.allclose(np.exp(model.log_p(said)).sum(1), 1)


def test_kneser_ney_reads_long_runs_whole():
    pieces = kneser_ney.words("x" * 40 + "schimpf" + "y" * 41)
    assert all(len(w) <= kneser_ney.PIECE for w in pieces) and pieces[-1].endswith("y") and any("him" in w for w in pieces)
    run = "abcdefghij" * 7 + "z"
    pieces = kneser_ney.words(run)
    assert pieces[0][:4] + "".join(w[4:] for w in pieces) == run


@pytest.mark.parametrize("model", [neighbours, kneser_ney])
def test_models_without_labels_or_documents(spark, odd, nothing, model):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert model.score(odd, labels).count() == odd.count() and model.score(nothing, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in model.score(odd, some).collect())


def slow_ppm(levels):
    kids = [defaultdict(dict) for _ in range(ppm.ORDER + 1)]
    for order, (codes, n) in enumerate(levels):
        for c, k in zip(codes.tolist(), n.tolist(), strict=True):
            kids[order][c >> ppm.BITS][c & 511] = k

    def score(text):
        history, total = [ppm.START] * ppm.ORDER, 0.0
        for s in [*text.lower(), ppm.END]:
            out, left = set(), 0.0
            for order in range(ppm.ORDER, -1, -1):
                context = 0
                for h in history[len(history) - order :]:
                    context = context << ppm.BITS | h
                seen = kids[order].get(context)
                if not seen:
                    continue
                rest = {k: v for k, v in seen.items() if k not in out}
                mass = sum(rest.values()) + len(rest)
                if s in rest:
                    left += math.log10(rest[s] / mass)
                    break
                if rest:
                    left += math.log10(len(rest) / mass)
                out |= set(seen)
            else:
                left += math.log10(1 / (ppm.SYMBOLS - len(out)))
            total += left
            history = [*history[1:], s]
        return total

    return score


def test_ppm_equals_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    given = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    train = [t for i, t in given.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = Counter(w for t in train for w in t.lower().split())
    n, v = sum(tokens.values()) + len(train), len(tokens) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    texts = docs.where(fold(F.col("doc_id"), 5) != 1).select(F.col("text").cast("binary").alias("text"))
    slow = slow_ppm(ppm._trained(texts))
    for r in ppm.score(docs).collect():
        words = given[r.doc_id].lower().split()
        assert (r.n_tokens, r.train_tokens) == (len(words) + 1, n) and r.n_known == 1 + sum(w in tokens for w in words)
        assert r.base_score == pytest.approx(log(len(train)) + sum(log(tokens[w]) for w in words), rel=1e-9)
        assert r.score == pytest.approx(slow(given[r.doc_id]), rel=1e-5)


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_ppm_knows_every_gram_however_rare(spark, monkeypatch, head):
    monkeypatch.setattr(ppm, "HEAD", head)
    rnd = random.Random(3)
    given = {i: " ".join(rnd.choices(["alpha", "beta", "gamma"], k=400)) for i in range(60)}  # far more than 2 ** 16 positions
    given |= {100 + i: f"{w} alpha" for i, w in enumerate(["quixotic", "zephyr", "quixotry", "zyx quip", ""])}
    counts = [Counter() for _ in range(ppm.ORDER + 1)]
    for i, t in given.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = [ppm.START] * ppm.ORDER + list(t.encode()) + [ppm.END]
            for at in range(ppm.ORDER, len(s)):
                for order in range(ppm.ORDER + 1):
                    counts[order][sum(v << ppm.BITS * k for k, v in enumerate(reversed(s[at - order : at + 1])))] += 1
    slow = slow_ppm([(np.array(list(c.keys())), np.array(list(c.values()))) for c in counts])
    docs = spark.createDataFrame([(i, t, "s") for i, t in given.items()], SCHEMA)
    for r in ppm.score(docs).collect():
        assert r.score == pytest.approx(slow(given[r.doc_id].encode()), rel=1e-5)


def test_ppm_edges(odd, nothing):
    assert ppm.score(nothing).count() == 0
    assert all(r.n_tokens >= 1 and r.score < 0 for r in ppm.score(odd).collect())


# -- pipeline ------------------------------------------------------------------------------
def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline
    from millrace.llm.common import keep, table

    docs, seen = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, sf_dir), "test")
        seen.append((name, docs, out))
        docs = out
    assert [len(o.columns) for _, _, o in seen] == [5, 5, 5, 5, 4]
    quality, exact, near, mix, last = (o for _, _, o in seen)
    labels = table(spark, sf_dir, "labels")
    wrong = quality.join(labels.where("quality = 0"), "doc_id").count()
    assert wrong <= 0.05 * labels.where("quality = 0").count()
    norm = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    assert exact.select(norm).distinct().count() == exact.count() == quality.select(norm).distinct().count()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in exact.collect()]
    label = slow_components([f for _, f in fps])
    assert near.count() == len(set(label))
    assert last.count() == mix.count() and mix.select("doc_id").distinct().join(near, "doc_id", "left_anti").count() == 0


def test_pipeline_stages_with_odd_rows(spark, sf_dir, odd, nothing):
    """Nulls in every column, repeated rows, long texts, clashing columns and empty tables pass each stage whole."""
    import corpus_pipeline

    wide = odd.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "kept doc_id": F.lit(1), "row": F.lit("r"), "size": F.lit(2), "own id": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf_dir)
        assert out.columns[0] == "doc_id" and out.count() <= 3 * odd.count(), name
        assert stage(spark, nothing.withColumns({"lang": F.lit(""), "n_chars": F.lit(0).cast("long")}), sf_dir).count() == 0, name
    texts = [r.text or "" for r in odd.collect()]
    kept = corpus_pipeline.exact(spark, wide, sf_dir).collect()
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts})
    fps = [slow_fingerprint(t) for t in texts]
    assert corpus_pipeline.near(spark, wide, sf_dir).count() == len(set(slow_components(fps)))
