"""The corpus operators against brute force, round trips and held-out rows; nulls, empty tables, ties, clashing columns."""

import base64
import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from spanloom.llm import decontam, extract, fingerprint, langid, packing, queries, sharding, simhash, tokenfiles, tokens, urltrust, warc
from spanloom.llm.shared import ship, stage, table

from ..conftest import DATA

ODD = ["", None, " a  b", "x\n\ny", "é\nè ü, ñandú! ÀB.", "中文字 字, x1y", "<|endoftext|> it's 12 3", "a\tb ", "Z" * 3000, "the the the"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return [(r[0], r[1]) for r in table(spark, DATA, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, a null id, and columns whose names the operators use themselves."""
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(ODD)] + [(1, None, "de", "s", 1), (3, "x\n\ny", None, None, None), (None, "lost", "fr", "s", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, shard string, n_words long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_encoder_equals_the_library(docs):
    e = tokens.Encoder(tokens.tokenizer_path(None), most=5000)
    texts = [t for _, t in docs] + ODD
    for got, want in zip(e.encode(pa.array(texts)), e.whole([t or "" for t in texts]), strict=True):
        assert np.array_equal(got, want)


def test_automaton_equals_windows():
    r = random.Random(3)
    word = lambda: b"abcdefg"[(k := r.randrange(7)) : k + 1]
    for _ in range(60):
        items = [(str(k), [word() for _ in range(r.randrange(1, 9))]) for k in range(5)]
        auto = decontam.Automaton(items, 4)
        doc = [word() for _ in range(60)]
        hit, names = set(), set()
        for name, seq in items:
            w = min(4, len(seq))
            for a, b in itertools.product(range(len(seq) - w + 1), range(len(doc) - w + 1)):
                if seq[a : a + w] == doc[b : b + w]:
                    hit.update(range(b, b + w))
                    names.add(name)
        spans, found = auto.scan(doc)
        assert {k for a, b in spans for k in range(a, b)} == hit and {auto.names[k] for k in found} == names


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "the the"), (2, None), (3, "!!"), (1, "the the")], "item_id long, text string")
    rows = {(r.doc_id, r.n_hit, r.n_items) for r in decontam.report(decontam.mark(odd.select("doc_id", "text"), items)).collect()}
    assert (9, 3, 1) in rows and all(n == 0 for d, n, _ in rows if d != 9)
    blocks = decontam.report(decontam.mark(odd.select("doc_id", "text"), items, block_words=1))
    assert {(r.doc_id, r.n_hit, r.n_items) for r in blocks.collect()} == rows
    assert decontam.mark(none, items).count() == 0
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and kept.filter("doc_id = 9").count() == 0 and kept.count() == odd.count() - 1
    assert decontam.cut("one two BAD bad THREE four", decontam.Automaton([("1", [b"bad", b"bad"])], 10), 0.5) == "one two\nTHREE four"


def _best(xs, c):
    """The least number of sequences, by search."""
    xs, best = sorted(xs, reverse=True), [len(xs)]

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(xs):
            best[0] = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= xs[i]}.values():
            free[k] -= xs[i]
            go(i + 1, free)
            free[k] += xs[i]
        go(i + 1, [*free, c - xs[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    r = random.Random(1)
    for _ in range(400):
        c = r.choice([10, 13, 20])
        xs = [r.randint(1, c) for _ in range(r.randint(0, 9))]
        left = packing.Lengths(collections.Counter(xs))
        fixed = packing.reduce(left, c)
        assert sum(fixed.values()) + _best(list(collections.Counter(left.count).elements()), c) == _best(xs, c)
        got = collections.Counter()
        for group, n in packing.plan(collections.Counter(xs), c).items():
            assert sum(group) <= c
            for x in group:
                got[x] += n
        assert got == collections.Counter(xs)


def test_packing_is_gapless(spark, docs, odd, none):
    lib = tokens.Encoder(tokens.tokenizer_path(None))
    for df, rows in ((table(spark, DATA, "documents"), docs), (odd, [tuple(r)[:2] for r in odd.collect()])):
        out = packing.pack_documents(df, with_ids=False).collect()
        want = collections.Counter()
        for d, ids in zip([d for d, _ in rows], lib.whole([t or "" for _, t in rows]), strict=True):
            ids = np.append(ids, 0).astype("<u4")
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
        assert collections.Counter(tuple(r)[:5] for r in out) == want
        seqs = collections.defaultdict(list)
        for r in out:
            seqs[r.sequence_id].append((r.offset, r.length))
        for s in seqs.values():
            at = 0
            for a, n in sorted(s):
                assert a == at
                at += n
            assert at <= 2048
        assert len(seqs) <= 1.02 * -(-sum(r.length for r in out) // 2048) + 1
    assert packing.pack_documents(none).count() == 0


def test_extraction(spark):
    ship(spark)
    rows = [(r.page_id, r.url, r.html) for r in table(spark, DATA, "pages").collect()]
    got = {r.page_id: r for r in queries.op3_extract(spark, DATA).collect()}
    for p, _, h in rows:
        m = re.search(r"<article>(.*?)(</article>|$)", h, re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", m[1]) if m else "")
        want = [t for x in parts if (t := " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()))]
        assert got[p].text == "\n".join(want) and got[p].n_chars == len(got[p].text)
    page = lambda k: f"<body><div class=top>Our site &amp; more</div><div id=c{k}><p>Story {k} is   long.<br>Yes.<p>End {k}.</div><div class='side-bar sidebar'>x</div><form>f</form></body>"
    made = spark.createDataFrame([(k, f"http://h.org/{k}", page(k)) for k in range(5)] + [(9, None, None), (10, "", "<p>a<!-- b --> c")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in extract.extract(made).collect()}
    assert out[3] == "Story 3 is long. Yes.\nEnd 3." and out[9] == "" and out[10] == "a c"
    assert extract.extract(made.limit(0)).count() == 0


def test_templates_decide_inside_content(spark):
    page = lambda k: f"<body><article><h1>Title {k}</h1><div>Read all our stories here</div><p>Story {k} is long enough, {k} times.</p></article></body>"
    copy = "<body><main><p>One</p><p>Two</p></main></body>"
    apart = "<body><main><nav>menu</nav></main><div>Text {}</div></body>"
    near = lambda k: f"<body><article><p>A long text that is copied</p><i>v{k}</i></article></body>"
    rows = [(k, f"http://{h}.org/{k}", h_) for h, make in (("a", page), ("b", lambda k: copy), ("c", apart.format), ("d", near)) for k, h_ in ((100 * ord(h) + k, make(k)) for k in range(5))]
    out = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert out[9700 + k] == f"Title {k}\nStory {k} is long enough, {k} times."
        assert out[9800 + k] == "One\nTwo" and out[9900 + k] == f"Text {k}" and out[10000 + k] == f"A long text that is copied\nv{k}"


def test_slots_beside_the_largest_and_two_layouts(spark):
    first = lambda k: f"<body><h1>Title {k}</h1><div class=top>All our news</div><div class=content><p>{f'Words of story {k}. ' * 20}</p><h2>Part {k}</h2><p>More of {k}.</p></div></body>"
    second = lambda k: f"<body><section><b>Old layout</b><ul class=x><li>Point {k}</ul></section><section class=legal>Rights are ours</section></body>"
    one_p = lambda k: f"<body><h1>Head {k}</h1><p>{f'Story {k}. ' * 40}</p><blockquote>Said {k}</blockquote></body>"
    rows = [(k, f"http://a.org/{k}", (first, second)[k % 2](k)) for k in range(10)] + [(k, f"http://b.org/{k}", one_p(k)) for k in range(10, 14)]
    rows += [(k, f"http://c.org/{k}", "<body><div>Copy</div><p>of one page</p></body>") for k in range(20, 24)]
    out = {r.page_id: r.text.split("\n") for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(0, 10, 2):
        assert out[k] == [f"Title {k}", (f"Words of story {k}. " * 20).strip(), f"Part {k}", f"More of {k}."]
        assert out[k + 1] == [f"Point {k + 1}"]
    for k in range(10, 14):
        assert out[k] == [f"Head {k}", (f"Story {k}. " * 40).strip(), f"Said {k}"]
    assert all(out[k] == ["Copy", "of one page"] for k in range(20, 24))


def _like(a, b):
    x, y = set(fingerprint.digests(a).tolist()), set(fingerprint.digests(b).tolist())
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def test_fingerprints(spark, docs, odd, none):
    got = {r.doc_id: r for r in queries.op4_fingerprint(spark, DATA).collect()}
    rows = docs[::-1]
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = fingerprint.edited(t, nxt)
        assert got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[d].n_chars == len(t)
        assert abs(got[d].near_edited - _like(t, new)) < 1e-9 and abs(got[d].near_next - _like(t, nxt)) < 1e-9
    assert fingerprint.with_edits(odd).count() == odd.count() and fingerprint.with_edits(none).count() == 0
    same = collections.defaultdict(set)
    for d, t in docs:
        same[t].add(got[d].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_urls(spark):
    rows = [(1, "http://A.net/x", None), (2, "https://m.example.net/en/1#x", ""), (3, "http://example.com/de/", None), (4, "http://x.org/fr/a?b", None), (5, None, None),
            (6, "x://evilnet/", None), (7, "http://b.net?q", None), (8, "http://friend.com/", "<a href='http://a.net/'>x</a>"), (9, "http://good.org/fr/", '<a href="//fine.com/">y</a>'), (10, "http://fine.com/a", None)]
    out = {r.page_id: r for r in urltrust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(out[k].rule, out[k].verdict) for k in (1, 2, 3, 4)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (out[5].host, out[5].path, out[5].verdict) == ("", "", "allow") and out[6].rule is None and (out[7].host, out[7].path, out[7].rule) == ("b.net", "", None)
    assert out[8].verdict == "block" and out[10].verdict == "allow"


def test_simhash(spark, docs, odd, none):
    def slow(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        h = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), 42).intdigest() for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    texts = [t for _, t in docs] + ODD
    fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    assert all(int(f) == slow(t) for f, t in zip(fps, texts, strict=True))
    label = np.arange(len(docs))
    for i in range(len(docs)):
        j = np.flatnonzero(np.bitwise_count(fps[: len(docs)] ^ fps[i]) <= 4)
        label = simhash.forest(len(docs), np.full(len(j), i), j, label)
    got = {r.doc_id: r.component_id for r in queries.op6_simhash(spark, DATA).collect()}
    assert got == {docs[i][0]: docs[label[i]][0] for i in range(len(docs))}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id = 1").count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_dense_balls_in_chunks(spark):
    rng = np.random.default_rng(0)
    pts = set()
    for base in rng.integers(0, 2**63, 8):
        for _ in range(40):
            pts.add(int(base) ^ sum({1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 7))}))
    fp = np.array(sorted(pts), np.int64)
    label = np.arange(len(fp))
    for i in range(len(fp)):
        j = np.flatnonzero(np.bitwise_count(fp.view(np.uint64) ^ fp[i].view(np.uint64)) <= 4)
        label = simhash.forest(len(fp), np.full(len(j), i), j, label)
    nodes = stage(spark.createDataFrame([(int(x),) for x in fp], "fp long"), "balls")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, bucket=8)).collect()}
    ours = collections.defaultdict(set)
    for x in fp.tolist():
        ours[got.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, lab in zip(fp.tolist(), label, strict=True):
        want[lab].add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_languages(spark, odd):
    lang = {r.doc_id: r.lang for r in table(spark, DATA, "documents").collect()}
    out = queries.op7_language(spark, DATA).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)
    model = langid.train(table(spark, DATA, "documents"), rows=50)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[0] == got[1] == ("und", 0.0) and got[9][0] == "en" and langid.predict(odd.limit(0), model).count() == 0
    empty = langid.train(odd.limit(0).selectExpr("doc_id", "text", "length AS lang"))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_full_cells_are_ranked_in_parts(spark):
    """A third of all rows are equal, a third share an id: all are ranked in parts of a few rows, none twice, and slots stay gapless."""
    rows = [(None, "same")] * 300 + [(7, f"text {k}") for k in range(300)] + [(k, f"own {k}") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard(df, cell_rows=16).collect()
    assert collections.Counter((r.doc_id, r.text_crc32) for r in out) == collections.Counter((d, zlib.crc32(t.encode())) for d, t in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {37, 38}
    few = sharding.shard(df.filter("doc_id is null"), cell_rows=16).collect()
    assert len(few) == 300 and len({(r.shard, r.slot) for r in few}) == 300


def test_sharding(spark, docs, odd, none):
    for df in (table(spark, DATA, "documents"), odd):
        out = sharding.shard(df).collect()
        slots = collections.defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        sizes = [len(slots.get(s, [])) for s in range(24)]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(sizes) - min(sizes) <= 1 and len(out) == df.count()
    text = dict(docs)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode())) for r in sharding.shard(table(spark, DATA, "documents")).collect())
    assert sharding.shard(none).count() == 0
    ring = sharding.points(3, 2)
    moved = sharding.flow({0: 9}, ring, 3)  # one arc holds all: it overflows clockwise
    first = list(dict.fromkeys(s for _, s in ring))
    assert [s for _, _, _, s, _ in sorted(moved)] == first and all(b - a == 3 for _, a, b, _, _ in moved)


def test_warc(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, DATA, "pages").collect()]
    rows += [(1000, None, None), (1001, "http://a b\r\n/", ""), (1002, "x", "WARC/1.1\r\n\r\n\r\n\r\nöä\n"), (1003, "y", rows[3][2])]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first: dict = {}
    for p, _, h in sorted(rows):
        first.setdefault(h or "", p)
    for p, _, h in rows:
        body, r = (h or "").encode(), out[p]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == p else ("revisit", first[h or ""]))
    assert len(out) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_counterparts(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want.select(*cols).fetchall()))


def test_token_files(spark, docs, odd, none):
    ranks = np.random.default_rng(1).integers(0, 1 << 25, 1001).astype(np.uint32) >> np.random.default_rng(2).integers(0, 25, 1001).astype(np.uint32)
    control, data = tokenfiles.pack_ranks(ranks)
    assert np.array_equal(tokenfiles.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)), ranks)
    out = {r.doc_id: r for r in queries.op10_token_files(spark, DATA).collect()}
    at = 0
    for (d, _), ids in zip(docs, tokens.Encoder(tokens.tokenizer_path(None)).whole([t or "" for _, t in docs]), strict=True):
        ids = np.append(ids, 2).astype("<u4")
        assert tuple(out[d]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = tokenfiles.round_trip(odd).orderBy("start").collect()
    assert len(got) == odd.count() and [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert [r.doc_id for r in got][0] is None and tokenfiles.round_trip(none).count() == 0


def test_pipeline_stages(spark, docs):
    corpus = pytest.importorskip("corpus_pipeline")
    df = table(spark, DATA, "documents")
    items = {tuple(w[k : k + 10]) for (t,) in table(spark, DATA, "benchmark").select("text").collect() for w in [decontam.words(t)] for k in range(max(1, len(w) - 9))}
    for name, step in corpus.STAGES[:-1]:
        before, df = df, stage(step(spark, df, DATA), name)
        assert df.columns == before.columns and df.count() <= before.count()
    for (t,) in df.select("text").collect():
        w = decontam.words(t)
        assert not any(tuple(w[k : k + 10]) in items for k in range(len(w) - 9))
    out = corpus.STAGES[-1][1](spark, df, DATA)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in df.select("doc_id").collect()}


def test_pipeline_finds_every_near_copy(spark, docs, odd, none):
    corpus = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = list(docs)
    for k in range(12):  # copies of 0.7 to 0.9, and a large group of copies of one text
        base = [word() for _ in range(100)]
        rows.append((10_000 + 10 * k, " ".join(base)))
        for n in range(1, 6):
            copy = list(base)
            for at in r.sample(range(0, 100, 5), n):
                copy[at] = word()
            rows.append((10_000 + 10 * k + n, " ".join(copy)))
    group = [word() for _ in range(200)]
    for k in range(150):
        rows.append((20_000 + k, " ".join([*group[:k], word(), *group[k + 1 :]])))

    def grams(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    label = np.arange(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x == y or min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 5 * len(x & y) >= 4 * len(x | y):
            label = simhash.forest(len(rows), np.array([i]), np.array([j]), label)
    want = {min(rows[i][0] for i in np.flatnonzero(label == x)) for x in set(label.tolist())}
    got = corpus.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(x.doc_id for x in got.collect()) == sorted(want)
    kept = corpus.near_copies(spark, odd, DATA)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id = 1").count() == 0
    assert corpus.near_copies(spark, none, DATA).count() == 0
