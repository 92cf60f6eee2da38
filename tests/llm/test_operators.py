"""Each operator against a plain version of it, and on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import bpe, chat, exact_dedup, extract_html, near_dedup, packing, quality, queries, shingles, substring_dedup, topk, toxicity

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(80)
BASE = prose(120).split()


def variant(k):
    words = list(BASE)
    for i in range(k):
        words[5 + 11 * i] = f"changed{R.randint(0, 10**9)}"
    return " ".join(words)


def corpus():
    """Ids and texts: copies, near copies, shared passages, odd texts, repeated rows."""
    texts = [prose(R.randint(1, 200)) for _ in range(40)]
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\n")]
    texts += [variant(k) for k in (0, 1, 1, 2, 2, 3, 5, 8)]
    texts += [prose(30) + " " + PASSAGE + " " + prose(20) for _ in range(4)]
    texts += [None, "", "", " \n\t ", "one", "One", "a b c", "ÄÖ ß naïve 日本語 テキスト 😀", "x" * 5000, prose(3000), "\x1c a  b\r\n c "]
    rows = list(enumerate(texts))
    return [*rows, rows[3], rows[3], rows[45], (None, prose(50)), (None, None), (None, texts[0])]


SCHEMA = "doc_id long, text string, _id int, uid string, score double, removed string, places int, key binary"
ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "u", 0.5, "r", 2, b"k") for i, t in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# exact dedup


def plain_digest(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return hashlib.sha256((text or "").translate(fold).encode()).hexdigest()


@pytest.mark.parametrize("counters", [4, 1024])
def test_find_copies(docs, counters):
    by = {}
    for i, t in ROWS:
        by.setdefault(plain_digest(t), []).append(i)
    keep = {h: max((i for i in ids if i is not None), default=None) for h, ids in by.items()}
    got = exact_dedup.find_copies(docs, counters=counters).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order((i, keep[h], len(by[h]), h) for i, t in ROWS for h in [plain_digest(t)])
    kept = [r for r in got if r.kept]
    assert len(kept) == len(by) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("counters", [4, 1024])
def test_drop_copies(docs, nothing, counters):
    got = exact_dedup.drop_copies(docs, counters=counters)
    assert got.columns == docs.columns
    assert sorted(plain_digest(r.text) for r in got.collect()) == sorted({plain_digest(t) for _, t in ROWS})
    assert exact_dedup.drop_copies(nothing).count() == 0 == exact_dedup.find_copies(nothing).count()


def test_misra_gries_bound():
    stream, k = [R.choice([1, 1, 1, 2, 2, *range(3, 60)]) for _ in range(5000)], 9
    counters = {}
    for a in range(0, 5000, 70):
        more = {}
        for x in stream[a : a + 70]:
            more[x] = more.get(x, 0) + 1
        counters = exact_dedup.misra_gries(counters, more, k)
        assert len(counters) <= k
    for x in set(stream):
        assert stream.count(x) - 5000 / (k + 1) <= counters.get(x, 0) <= stream.count(x)


# top-k


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in r.normal(0, 0.3, (300, 8))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300 + i, vectors[50]) for i in range(80)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, []), (1250, [0.5, 0.5]), (None, vectors[0]), (50, vectors[7]), (100, [3e15] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, range string").repartition(3)
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), c) for c, b in usable if c != q)[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    got = topk.top_k(df, F.pmod("vec_id", F.lit(50)) == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.pmod("vec_id", F.lit(50)) == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 50"), F.lit(True)).count() == 0


# quality and toxicity


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        junk, bad = i % 4 == 0, i % 5 == 0
        words = prose(60).split()
        if junk:
            words = [w + "***" for w in words]
        if bad:
            words[20:23] = ["vileword", "hatefulword", "vileword"]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, int(bad)))
    rows += [(None, "text"), (900, None), (901, ""), (902, prose(30_000)), (0, rows[0][1])]
    labels += [(900, None, None), (None, 1, 1), (3, 1, 0), (5000, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def test_quality(spark):
    docs, labels, n = labelled(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    alone = quality.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_scores_whole_texts_in_any_slices():
    net = quality.Network()
    text = prose(200_000).encode()
    whole = net.scores([text])[0]
    quality_slice, quality.SLICE = quality.SLICE, 4096
    try:
        assert net.scores([b"", text, b"x"])[1] == pytest.approx(whole, abs=1e-6)
    finally:
        quality.SLICE = quality_slice


def plain_score(net, text):
    """The network written out: filters at every place, maxima over overlapping chunks of two segments, maxima over chunks."""
    size = -(-(len(text) + quality.WIDTH - 1) // quality.SEGMENT) * quality.SEGMENT
    data = text.ljust(size, b"\0")
    filters = [[sum(float(net.table[j][data[i + j]][f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for i in range(size - quality.WIDTH + 1)]
    best = [-np.inf] * quality.HIDDEN
    for a in range(0, size, quality.SEGMENT):
        chunk = [max(r[f] for r in filters[a : a + 2 * quality.SEGMENT]) for f in range(quality.FILTERS)]
        for k in range(quality.HIDDEN):
            z = sum(np.tanh(x) * float(net.hidden[f][k]) for f, x in enumerate(chunk)) + float(net.hidden_bias[k])
            best[k] = max(best[k], z, 0)
    return 1 / (1 + np.exp(-(sum(b * float(w) for b, w in zip(best, net.out)) + float(net.shift[0]))))


def test_quality_network_against_plain_loops():
    net = quality.Network(3)
    texts = [b"", b"x", prose(60).encode(), bytes(range(256)) * 2, b"ab" * 64, b"y" * 123]
    assert net.scores(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def test_quality_gradients(monkeypatch):
    """Against differences, with texts in one part and in many."""
    texts, labels = [prose(200).encode(), b"short", prose(90).encode()], np.array([1, 0, 1], np.float32)

    def loss(net):
        p = net.scores(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for size in (quality.SLICE, 512):
        monkeypatch.setattr(quality, "SLICE", size)
        net = quality.Network(4)
        found = quality._gradients(net, texts, labels)
        for w, g in zip(net.weights()[1:], found[1:]):
            for at in [np.unravel_index(k, w.shape) for k in range(0, w.size, max(1, w.size // 5))]:
                old = w[at]
                w[at] = old + 1e-2
                up = loss(net)
                w[at] = old - 1e-2
                down = loss(net)
                w[at] = old
                assert (up - down) / 2e-2 == pytest.approx(g[at], abs=2e-3)


def test_samples_are_bounded(spark):
    """An id repeated many times, labels of ids that are not there, and a bound on bytes."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "x" * 100) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 400)], "doc_id long, quality int, toxic int")
    found = quality.sample(docs, labels, F.lit(True), "quality", "doc_id", "text", 30).collect()
    assert len(found) == len({r["_id"] for r in found}) == 30 and all(r["_id"] < 60 for r in found)
    few = quality.sample(docs, labels, F.lit(True), "quality", "doc_id", "text", 30, 1000).collect()
    assert 0 < len(few) <= 12 and all(len(r["_text"]) == 100 or r["_id"] == 1 for r in few)
    assert quality.sample(docs, labels, F.lit(True), "quality", "doc_id", "text", 30, 0).count() == 0
    assert quality.classify(docs, labels).count() == 558 == toxicity.classify(docs, labels).count()


def test_toxicity(spark):
    docs, labels, n = labelled(spark)
    got = toxicity.classify(docs.withColumn("passages", F.lit(1)), labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    seen = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in seen)
    assert all(r.passages and r.passages[0].start <= 20 <= r.passages[0].end for r in seen if r.doc_id % 5 == 0)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_segments_are_the_maximal_ones():
    def plain(scores, offset=0):
        """By definition: the best segment (shortest, leftmost), then the same on both sides of it."""
        best = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return [*plain(scores[:a], offset), (offset + a, offset + b), *plain(scores[b:], offset + b)]

    for _ in range(300):
        scores = [R.choice([-7, -5, -3, -2, -1, 1, 2, 4, 6]) + R.random() / 100 for _ in range(R.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == plain(scores)


# near copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("block", [400_000, 300])
def test_find_near_copies(docs, nothing, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets = [plain_set(t) for _, t in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(ROWS)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(ROWS):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    want = order((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(ROWS))
    assert order(map(tuple, near_dedup.find_near_copies(docs).collect())) == want
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    empty = [k for k in range(len(ROWS)) if not sets[k]]
    got = left.collect()
    assert len([r for r in got if plain_set(r.text)]) == len({find(k) for k in range(len(ROWS)) if sets[k]})
    assert {r.doc_id for r in got if not plain_set(r.text)} == {ROWS[k][0] for k in empty}
    assert near_dedup.find_near_copies(nothing).count() == 0 == near_dedup.drop_near_copies(nothing).count()


def test_near_copies_through_members_that_are_not_the_leader(spark):
    """A chain in which most pairs are not similar, in one bucket or several."""
    words = prose(100).split()
    rows = []
    for i in range(40):
        words[(7 * i) % 100] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.find_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [plain_set(t) for _, t in rows]
    linked = all(len(a & b) * 100 >= 75 * len(a | b) for a, b in zip(sets, sets[1:]))
    assert linked and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("nodes", [1024, 100])
def test_blocks_of_a_large_bucket(spark, monkeypatch, nodes):
    """Many short nodes in one bucket, dealt in blocks: all links between components, and none inside one."""
    monkeypatch.setattr(near_dedup, "NODES", nodes)
    monkeypatch.setattr(near_dedup, "MAIN", nodes // 2)
    r = np.random.default_rng(3)
    found = [np.unique(r.integers(0, 1 << 62, 20, dtype=np.uint64)) for _ in range(2500)]
    linked = {(k, k + 1) for k in range(100, 2400, 7)}
    for a, b in linked:
        found[b] = np.unique(np.append(found[a][:-2], np.uint64(b)))
    members = spark.createDataFrame([(1, k, 0, len(s)) for k, s in enumerate(found)], "band long, uid long, leader long, n long")
    labels = spark.createDataFrame([(k, 0) for k in range(0, 2500, 2)], "uid long, label long")  # the leader's component
    sets = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(found)], "uid long, set binary")
    got = {tuple(sorted(e)) for e in near_dedup._blocks(members, labels, sets, 75).collect()}
    assert got == linked


def test_even_join(spark):
    rows = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(5000)] + [(None, -k) for k in range(900)], "key long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 5000, 2)], "key long, w string")
    for how in ("inner", "left"):
        got = near_dedup.even_join(rows, table, "key", how)
        assert got.columns == ["key", "v", "w"]
        assert order(map(tuple, got.collect())) == order(map(tuple, rows.join(table, "key", how).collect()))


def test_shingle_sets_and_sketches():
    texts = [(t or "").encode() for _, t in ROWS] + [b"a " * 700_000 + b"end of it all here now"]
    for text, found in zip(texts, shingles.sets(texts)):
        assert len(found) == len(plain_set(text.decode()))
    a = np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        n = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], np.arange(10_000, 10_400 - n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
        x, y = shingles.sketches([a, b], 128)
        errors.append(abs((x == y).mean() - n / (800 - n)))
    assert max(errors) < 0.15
    small = shingles.sketches([np.array([7], np.uint64), np.zeros(0, np.uint64)], 128)
    assert (small[0] != np.uint64(2**64 - 1)).all() and (small[1] == np.uint64(2**64 - 1)).all()


# HTML

PAGES = [
    (1, "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><header>Top</header><article><h1>Head &amp; more</h1><p>First\n  para<br>graph.</p>"
        "<div class='ad-box'>Buy</div><p>Second <b>one</b>.</p><aside>Side</aside></article><section id=comments><p>Nice!</p></section><footer>Foot</footer></body></html>",
     "Head & more\nFirst para graph.\nSecond one."),
    (2, "<body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div class=cookie-notice>We use cookies</div><p>Only text here, and a lot of it.</p><form>Mail <input></form></body>", "Only text here, and a lot of it."),
    (3, None, ""), (4, "", ""), (5, "<script>var a='<p>no</p>'</script>", ""), (6, "<article><p>un<!-- c -->closed <i>text", "unclosed text"),
    (7, "<main><p>A &lt;tag&gt; &copy; 5 &#233;&nbsp;x</p><p>  </p><ul><li>One</li><li>Two</li></ul></main>", "A <tag> © 5 é x\nOne\nTwo"),
    (8, "<article>" + "<p>word word</p>" * 3000 + "</article>", "\n".join(["word word"] * 3000)),
]


def test_extract_html(spark):
    df = spark.createDataFrame([(i, "u", h, 1) for i, h, _ in [*PAGES, *PAGES]], "page_id long, url string, html string, text int")
    got = extract_html.extract(df).collect()
    assert len(got) == 2 * len(PAGES) and {(r.page_id, r.text) for r in got} == {(i, t) for i, _, t in PAGES}
    assert extract_html.extract(df.limit(0)).count() == 0


BODY = "<p>" + "alpha beta gamma delta. " * 8 + "</p><p>Second one, short.</p>"
BODY_TEXT = ("alpha beta gamma delta. " * 8).strip() + "\nSecond one, short."
LINKS = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        # names that hold words of furniture
        (f'<div class="content-sidebar-wrap"><article>{BODY}</article></div>', BODY_TEXT),
        (f'<article class="post category-ads hentry comments-open">{BODY}</article>', BODY_TEXT),
        (f'<div class="site has-cookie-banner"><main>{BODY}</main></div>', BODY_TEXT),
        (f'<article>{BODY}<p class="social-policy">Policy.</p><h2 id="related-work">Related work</h2><p id="search">Searching.</p></article>', BODY_TEXT + "\nPolicy.\nRelated work\nSearching."),
        # furniture around the only article, and articles in furniture beside another
        (f'<div class="sidebar"><article>{BODY}</article></div>', BODY_TEXT),
        (f"<form>{BODY}<input></form><form>Mail <input></form>", BODY_TEXT),
        (f'<article>{BODY}<div class="comment-list"><article><p>Nice post!</p></article></div></article>', BODY_TEXT),
        (f"<article>{BODY}<div class='related'>Read this</div><div class='notice'>{BODY}{BODY}</div></article>", f"{BODY_TEXT}\n{BODY_TEXT}\n{BODY_TEXT}"),
        # links: a run of them in an article is a dive, fewer are not
        (f"<article>{BODY}{LINKS}<p>End</p></article>", BODY_TEXT + "\nEnd"),
        (f"<article><h1><a href=x>Title</a></h1>{BODY}<p><a href=y>More</a></p></article>", f"Title\n{BODY_TEXT}\nMore"),
        # pages without an article
        (f"<body>{LINKS}<div><div><div>{BODY}</div></div></div><div><div><div><p>(c) us</p></div></div></div></body>", BODY_TEXT),
        (f"<div><p>Intro.</p><div class=ad>Buy this</div>{LINKS}{BODY}</div><div><div><div><div>tiny</div></div></div></div>", f"Intro.\n{BODY_TEXT}"),
        (f'<div id="cookieNotice">We use cookies</div>{BODY}<div class="site-footer">Us</div>', BODY_TEXT),
        # elements within a line
        ("<article><p>one <span hidden>no</span>two <button>Press</button>three</article>", "one two three"),
        ("<head><title>T</title><p>no end tag of the head", "no end tag of the head"),
    ],
)
def test_extract_html_by_names_and_windows(page, text):
    assert extract_html.main_text(page) == text


def test_windows_decide(monkeypatch):
    """Without windows (each page one stretch) links of an article and lines far from the text of a page would stay."""
    pages = [f"<article>{BODY}{LINKS}<p>End</p></article>", f"<body>{LINKS}<div><div><div>{BODY}</div></div></div><div><div><div><p>(c) us</p></div></div></div></body>"]
    right = [extract_html.main_text(p) for p in pages]
    monkeypatch.setattr(extract_html, "stretches", lambda lengths, window=3: [(0, len(lengths))])
    assert all(a != extract_html.main_text(p) for a, p in zip(right, pages))


def test_surge_and_dive():
    assert extract_html.stretches([0, 0, 0, 5, 9, 0, 3, 0, 0, 0, 0, 4]) == [(1, 7), (9, 12)]
    assert extract_html.stretches([]) == []


# substrings


def test_drop_repeats(docs, nothing):
    got = substring_dedup.drop_repeats(docs)
    assert got.columns == [c for c in docs.columns if c != "removed"] + ["removed", "n_removed"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, []).append(t)
    for r in rows:
        assert (r.text is None) == (r.n_removed == 0 and None in texts[r.doc_id]) or r.text is not None
    with_passage = [r for r in rows if r.text and " ".join(PASSAGE.split()[15:65]) in r.text]
    assert len(with_passage) == 1 and sum(r.n_removed > 200 for r in rows if 51 <= (r.doc_id or 0) <= 54) == 3
    clean = [r for r in rows if r.doc_id in (5, 6, 7, 8, 9, 10)]
    assert all(r.n_removed == 0 and [r.text] == texts[r.doc_id] for r in clean)
    for r in rows:
        if r.n_removed and len(texts[r.doc_id]) == 1:
            before, out, last = texts[r.doc_id][0], [], 0
            for s in r.removed:
                out.append(before[last : s.start])
                last = s.end
            assert "".join(out) + before[last:] == r.text
    assert substring_dedup.drop_repeats(nothing).count() == 0


def plain_chunks(data):
    """The rule written out: zero bits of the gear hash, not too near the one before; long chunks at the last least hash."""
    gear = substring_dedup._GEAR.tolist()
    hashes = [sum(gear[data[i - j] if i >= j else 0] << j for j in range(16)) & 0xFFFF for i in range(len(data))]
    raw = [i + 1 for i, h in enumerate(hashes) if h & substring_dedup.MASK == 0 and i + 1 < len(data)]
    cuts = [c for c, before in zip(raw, [0, *raw]) if c - before >= substring_dedup.SHORTEST] + [len(data)] * bool(data)
    out, at = [], 0
    for c in cuts:
        while c - at > substring_dedup.LONGEST:
            at = max(range(at + substring_dedup.SHORTEST, at + substring_dedup.LONGEST + 1), key=lambda i: (-hashes[i - 1], i))
            out.append(at)
        at = c
        out.append(at)
    return out


def plain_repeats(rows):
    """Texts by (id, text) without the stretches of runs that a document with a smaller id (or the same id and a smaller text hash) has."""
    made = {}
    for i, t, h in rows:
        data = (t or "").encode()
        ends = plain_chunks(data)
        begin = [0, *ends[:-1]]
        made[(2**63 - 1 if i is None else i, h)] = t, data, ends, [data[begin[k] : ends[k]] + b"|" + data[begin[k + 1] : ends[k + 1]] + b"|" + data[begin[k + 2] : ends[k + 2]] for k in range(len(ends) - 2)]
    first, out = {}, {}
    for key in sorted(made):
        t, data, ends, runs = made[key]
        again = [k for k, run in enumerate(runs) if first.get(run, key) != key]
        for run in runs:
            first.setdefault(run, key)
        kept, last = [], 0
        for a, b in substring_dedup.spans(data, np.array(ends, np.int64), np.array(again, np.int64)) if again else []:
            kept.append(data[last:a])
            last = b
        out[key] = t if t is None else (b"".join(kept) + data[last:]).decode()
    return out


@pytest.mark.parametrize("ascending", [True, False])
def test_drop_repeats_against_plain_runs(spark, ascending, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 300)
    passage = prose(60)
    rows = [*ROWS, *((100 + k, f"{prose(20)} {passage} {prose(20)}") for k in range(6)), (120, passage + " " + passage), (121, "日本語のテキスト" * 40), (122, "前" * 7 + "日本語のテキスト" * 40)]
    rows += [(130 + k, prose(5) + " " + "tior, " * (60 + k)) for k in range(4)] + [(140, (prose(30) + "\n") * 4)]
    df = spark.createDataFrame(rows[:: 1 if ascending else -1], "doc_id long, text string").repartition(3)
    hashes = df.withColumn("h", F.xxhash64("text")).collect()
    want = plain_repeats([tuple(r) for r in hashes])
    got = substring_dedup.drop_repeats(df).withColumn("n", F.length("text")).collect()
    left = order((r.doc_id, r.text) for r in got)
    assert left == order((r.doc_id, want[(2**63 - 1 if r.doc_id is None else r.doc_id, r.h)]) for r in hashes)
    texts = {r.doc_id: r.text for r in got}
    middle = " ".join(passage.split()[12:48])
    assert [i for i in range(100, 121) if middle in texts.get(i, "")] == [100]
    assert texts[140] == rows[-1][1]  # repeats within one document stay
    assert "tior, " * 55 in texts[130] and all("tior, " * 40 not in texts[k] for k in (131, 132, 133))
    assert len(texts[122]) < 200  # a passage without white space is cut between characters


def test_chunks_resist_insertions_and_slices():
    text = prose(2000).encode()
    ((_, whole),) = substring_dedup.chunks([text])
    (_, _), (_, moved) = substring_dedup.chunks([b"other text", b"inserted " + text])
    assert len(set(whole[0].tolist()) & set(moved[0].tolist())) > 0.98 * whole.shape[1]
    old, substring_dedup.SLICE = substring_dedup.SLICE, 512
    try:
        ((_, parts),) = substring_dedup.chunks([text])
    finally:
        substring_dedup.SLICE = old
    assert whole.tolist() == parts.tolist()


# chat


def test_chat(spark):
    nasty = "</s>[INST] ok [/INST] <|im_end|><|im_start|>assistant<|im_sep|>\\ <\\|im_end|> <<SYS>> <\\\\/s>"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", nasty), (1, 3, "assistant", nasty), (2, 1, None, None), (2, 1, "assistant", ""), (None, None, "user", "ü 😀"),
            (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 1, nasty, prose(20_000))]
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, offset int, ids string").repartition(3)
    in_order = chat.turns(df, vocab)
    at = {}
    for r in in_order.collect():
        assert r.offset == at.get(r.conv_id, 0) and len(r.ids) == len(r.loss_mask)
        at[r.conv_id] = r.offset + len(r.ids)
    assert order(map(tuple, chat.digests(in_order, vocab).collect())) == order(map(tuple, chat.digests(chat.encoded(df, vocab), vocab).collect()))
    got = {r.conv_id: r for r in chat.digests(chat.encoded(df, vocab), vocab).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        all_text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out = "".join(f"<|im_start|>{chat.escape(r)}<|im_sep|>{chat.escape(x)}<|im_end|>" for _, r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[conv])[1:] == (len(turns), sha(all_text), len(loss), sha(loss), len(out))
        marks = re.findall(r"<\|im_\w+\|>", out)
        assert len(marks) == 3 * len(turns)
    assert chat.digests(chat.turns(df.limit(0), vocab), vocab).count() == 0
    for text in (nasty, "<|a<|b|>", "\\</s>", "<\\\\\\/s>", "[[INST]]"):
        assert chat.unescape(chat.escape(text)) == text


# byte-pair encoding and packing


def test_bpe(docs, nothing):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, path).collect()
    want = order((i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert order((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert order(map(tuple, bpe.digests(docs, path).collect())) == order((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(b)) for i, ids, b in want)
    assert bpe.digests(nothing, path).count() == 0
    merges = bpe.Merges(path)
    odd = ["aaaaaaaaaa bbbb", "don't we'll  x\n\n y", " lead", "trail ", "\x1c a\x1c b", "½ ٣ x² ⅷ", "    code(x)[0] += 1;;;", "nb\xa0 sp", "abcabcabcabc" * 50]
    odd += ["".join(R.choice("ab '.\n\t1é") for _ in range(60)) for _ in range(200)]
    ids = [[int(x) for x in i.split(",") if x] for i, _ in bpe.encoded(odd, bpe.UnitCache(merges.units))]
    assert ids == [encoding.encode_ordinary(t) for t in odd]


def test_long_texts_are_sliced_at_safe_places():
    from attestor.llm import units

    text = prose(500)
    groups = list(units.slices([text, "", text], 300))
    assert "".join(p for g in groups for i, p in g if i == 0) == text and all(len(p) < 400 for g in groups for _, p in g)


def check_packing(rows, want):
    ids = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        ids.setdefault((r.doc_id, r.doc_tokens), []).append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    total = sorted(x for parts in ids.values() for p in parts for x in p)
    assert total == sorted(x for _, w in want for x in w)
    sequences = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS]
    rows = packing.pack(docs, path).collect()
    assert check_packing(rows, want) == 0
    single = {i: w for i, w in want if [x for x, _ in want].count(i) == 1}
    for i, w in single.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.doc_tokens == len(w) and np.frombuffer(bytes(p.ids), "<u4").tolist() == w[at : at + p.length]
            at += p.length
        assert at == len(w)
    assert packing.pack(nothing, path).count() == 0


def test_ids_are_those_of_the_tokenizers_library():
    """The library's own call, added tokens in texts included, for a file of plain ranks and for any other."""
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    odd = [f"{mark} a", f"a{mark}", f" {mark}{mark} x {mark}", f"x  {mark}  y\n{mark}\n", "<|endoftext|", f"<{mark}>", "", "don't  we'll \x1c a", "    code(x)[0] += 1;;;", "½ ٣ x² ⅷ\xa0 日本"]
    odd += ["".join(R.choice(["a", "b ", " ", "'s", ".", "\n", "1", "é", mark]) for _ in range(60)) for _ in range(200)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        got = [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(public_tokenizers.path(name)).encoded(odd)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_windows_are_bounded():
    windows, done = packing.Windows(16, 3), []
    for k in range(500):
        done += list(windows.add((k, 0, bytes(4 * R.randint(1, 40)), 1)))
        assert len(windows.open) <= 3
    assert all(sum(len(p[2]) for p in w) == 64 for w in done)


# queries and pipeline


def test_queries_of_all_operators():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 11) for n in queries.QUERIES if n.startswith(f"op{k}_")]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "substring dedup", "packing"]


def test_pipeline(spark, tmp_path):
    """The stages in a row against plain rules: junk and copies go, a shared passage stays once, each id is packed once."""
    good = [prose(80) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100 + i, " ".join(w + "***" for w in prose(60).split())) for i in range(40)]
    rows += [(200, good[0]), (201, good[1].upper()), (202, good[2].replace(good[2].split()[40], "other", 1))]
    rows += [(300 + i, prose(30) + " " + PASSAGE + " " + prose(30)) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 140], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(at)
        if name != "packing":
            assert at.columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert ids[0] == {i for i, _ in rows if not 100 <= i < 200}
    assert ids[1] == ids[0] - {0, 1}
    assert ids[2] == ids[1] - {202}
    texts = [r.text for r in seen[3].collect()]
    assert sum(" ".join(PASSAGE.split()[15:65]) in t for t in texts) == 1 and all(r.n_chars == len(r.text) for r in seen[3].collect())
    assert {r.doc_id for r in seen[4].collect()} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, docs, nothing, tmp_path, name):
    """Nulls, repeated rows, odd texts, columns with clashing names, and no rows, in each stage on its own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    labels = [(i, int(i % 3 > 0), 0) for i, t in ROWS if i is not None and t] + [(None, 1, 0), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_removed", F.lit("x")).withColumn("kept", F.lit(1))
    out = stage(spark, rows, str(tmp_path))
    got = out.collect()
    ids = {i for i, _ in ROWS}
    if name == "packing":
        assert {r.doc_id for r in got} == ids and sum(r.length for r in got) > len(ROWS)
    else:
        assert out.columns == rows.columns and 0 < len(got) <= len(ROWS) and {r.doc_id for r in got} <= ids
    if name == "quality classifier":
        by_text = {}
        for r in got:
            by_text.setdefault(r.text or "", []).append(r)
        assert all(len(found) == sum((t or "") == text for _, t in ROWS) for text, found in by_text.items())
    if name == "exact dedup":
        assert len(got) == len({plain_digest(t) for _, t in ROWS})
    if name == "substring dedup":
        assert all(r.text is None or r.n_chars == len(r.text) for r in got)
        assert sum(not (r.text or "").strip() for r in got) == sum(not (t or "").strip() for _, t in ROWS)  # none was wholly cut here
    assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
