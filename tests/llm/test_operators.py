"""The operators on small tables: edges (nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns) and brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import decontam, html, linedup, media, mixing, neardup, quality, tokenids, urlfilter, warc
from svloom.llm.common import Workspace
from svloom.llm.graph import components

LONG = "lorem ipsum dolor " * 9000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "a", 1), (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "a", 1), (3, None, "b", 2), (4, "", None, 3),
    (5, "a", "b", 4), (6, LONG, "c", 5), (6, LONG, "c", 5), (None, "no id here but words", None, 6), (7, " \t\n ", "c", 7), (8, "line one is a fairly long line of text\nline two\n\nline one is a fairly long line of test", "c", 8),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Further columns have names that the operators use inside."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_shingles int").withColumns({"component": F.lit("x"), "place": F.lit(0), "key": F.lit(1), "__id": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by(df, key="doc_id"):
    return collections.Counter(tuple(r.asDict().items()) for r in df.collect())


# ---------------------------------------------------------------- 1 quality
def test_quality_learns_and_holds_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 1), (6, None)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(nothing, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_scores_are_gaussian_log_odds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    covs, means = [np.diag([1.0, 2.0, 3.0]), np.eye(3) + 0.3], [np.zeros(3), np.ones(3)]
    factors = [np.linalg.cholesky(c) for c in covs]
    model = quality.Discriminant(means, [np.linalg.inv(f) for f in factors], [np.log(0.5) - np.log(np.diag(f)).sum() for f in factors])
    logs = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.log(np.linalg.det(c)) for m, c in zip(means, covs)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


# ---------------------------------------------------------------- 2 html
PARAGRAPH = "This is a paragraph of the body, of some length, and it should be kept."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<script>x<b>", ""), ("<!-- a", ""),
        ("<nav><a href=x>m</a></nav><article><h1>T &amp; t</h1><p>One<br>two\n three<p>b<ul><li>x<li>y</ul></article><footer>f</footer>", "T & t\n\nOne two three\n\nb\n\nx\n\ny"),
        ("<article><header><h1>H</h1></header><p>Body text.</p><div class='comments'><p>I liked this very much, a reader says here.</p></div><aside>rel</aside><form>f</form></article>", "H\n\nBody text."),
        ("<article><p>a<!-- c -->b</p><div class=ad>Buy now</div><style>p{}</style><p>c</p><div id='cookie-notice'>We use cookies.</div></article>", "ab\n\nc"),
        # class names that tell a state or a subject
        ('<article class="post-1 post hentry category-news tag-travel"><p>Hello there.</p></article>', "Hello there."),
        ('<article class="post has-tags comment-open"><p>Hello there.</p></article>', "Hello there."),
        (f'<div class="post-content share-page"><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>', f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (f'<div class="layout-sidebar"><article><p>{PARAGRAPH}</p></article></div><div class="sidebar"><p>{PARAGRAPH}</p></div>', PARAGRAPH),
        ('<article><p>a</p><section id="comments"><article class="comment"><p>I liked this very much, says a reader.</p></article></section></article>', "a"),
        # quotes
        ("<article><p title=it's>One</p><p>Two it's</p></article>", "One\n\nTwo it's"),
        ('<article><p class="x"">One</p><p>Two</p></article>', "One\n\nTwo"),
        ('<article><p class="x>One</p><p>Two</p></article>', "One\n\nTwo"),
        ('<article><p title="a>b" lang=en>One</p></article>', "One"),
        ("<article><p><a href=/x/>link</a> and text</p></article>", "link and text"),
        # no landmark at all
        (f'<div><a href=/>Home</a></div><div><a href=/x>News</a></div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div><a href=/y>Imprint</a></div>', f"{PARAGRAPH}\n\n{PARAGRAPH}"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_main_text_of_a_very_long_page():
    rng = random.Random(7)
    lines = [f"<p>{'word ' * rng.randint(1, 12)}<a href=x>{'link ' * rng.randint(0, 8)}</a></p>" for _ in range(20000)]
    assert html.main_text(f"<nav>menu</nav><article>{''.join(lines)}</article>").count("\n\n") == len(lines) - 1
    html.main_text("".join(lines))


def _cost(own, edges, label):
    return sum(abs(o) for o, x in zip(own, label) if o and (o > 0) != x) + sum(w for a, b, w in edges if label[a] != label[b])


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        best = min(_cost(odds, edges, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(_cost(odds, edges, html.min_cut(odds, edges)) - best) < 1e-9


def test_labels_of_pages_are_the_cheapest():
    """Whole pages of random markup against all labellings of their blocks and regions."""
    rng, turned = random.Random(3), 0
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 7)):
            words = " ".join(rng.choice(["tea", "river.", "stone,", "of"]) for _ in range(rng.randint(1, 30)))
            inner = rng.choice([f"<p>{words}</p>", f"<p><a href=x>{words}</a></p>", f"<li>{words}</li>"])
            parts.append(rng.choice(["{}", "{}", "<div>{}</div>", "<div class=content>{}</div>", "<article>{}</article>", "<nav>{}</nav>", "<div class=ad>{}</div>"]).format(inner))
        found = html.blocks("".join(parts))
        own, edges = html.graph(found, html.FIXED)
        finite = [max(-1e6, min(1e6, o)) for o in own]
        label = html.min_cut(own, edges)
        best = min(_cost(finite, edges, [bool(m >> k & 1) for k in range(len(own))]) for m in range(1 << len(own)))
        assert abs(_cost(finite, edges, label) - best) < 1e-6
        turned += sum(x != (o > 0) for x, o in zip(label, own))
    assert turned > 0


def test_the_cut_decides_labels_of_pages(spark, sf):
    """Pages as they are, and with their landmarks of content taken away: labels that neither a region nor a block's own statistics give."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    learned, against_own, unmarked, kept, whole = html.fit(pages), 0, 0, 0, 0
    assert learned["links", 0] > 0 > learned["links", 4] and learned["chars", 6] > learned["chars", 0]
    for r in pages.collect():
        found = html.blocks(r.html)
        text = {b[0] for b, x in zip(found, html.label_blocks(found, learned)) if x}
        bare = html.blocks(re.sub(r"<(/?)(?:article|main)(?=[\s>])", r"<\1div", re.sub(r'(class|id|role)="[^"]*"', "", r.html)))
        label = html.label_blocks(bare, learned)
        against_own += sum(x != (html.log_odds(b, learned) > 0) for x, b in zip(label, bare))
        unmarked += sum(html.region(b[3]) == 0 for b in bare)
        whole += sum(len(t) for t in text)
        kept += sum(b[1] for b, x in zip(bare, label) if x and b[0] in text)
    assert against_own > 20 and unmarked > 100 and kept >= 0.85 * whole


@pytest.mark.parametrize("page", ['<form id="aspnetForm"><div id="content">{}</div></form>', '<div class="related-work">{}</div>', '<div class="article-social-science">{}</div>', '<div class="feedback-essay">{}</div>', '<section class="storm-alerts">{}</section>', "<form><div class=related>{}</div></form>"])
def test_what_is_around_the_page_is_no_boilerplate(page):
    text = f"{PARAGRAPH}\n\n{PARAGRAPH}"
    assert html.main_text(page.format(f"<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>")) == text
    assert html.main_text(f"<nav><a href=x>Home</a></nav>{page.format(f'<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>')}<footer><p>Imprint and more</p></footer>") == text


def test_the_cut_turns_doubtful_elements():
    """A doubtful element with many blocks that read like text turns as a whole, one with few does not; certain ones never do."""
    rest = f"<article>{f'<p>{PARAGRAPH}</p>' * 9}</article>"
    short = "<p>Tea</p>"
    for name, n, stays in (("related", 6, True), ("related", 1, False), ("sidebar", 6, False), ("comments", 6, False)):
        found = html.blocks(f"{rest}<div class={name}>{f'<p>{PARAGRAPH}</p>' * n}{short}</div>")
        label = html.label_blocks(found, html.FIXED)
        assert all(label[:9]) and label[9:] == [stays] * (n + 1)
        assert {html.region(b[3]) for b in found[9:]} == {-1} and html.log_odds(found[-1], html.FIXED) < 0
    assert html.main_text(f"<article>{PARAGRAPH}</article><div class=comments>{f'<p>{PARAGRAPH}</p>' * 50}</div>") == PARAGRAPH


def test_many_open_tags_take_no_square():
    began = time.time()
    html.main_text("<b>" * 20000 + "<p>x</p>" * 20000)
    html.main_text("<i>" * 20000 + "<li>x" * 20000 + "</ul>" * 20000 + "<td>y</td>" * 20000)
    assert time.time() - began < 10


def test_fit_on_a_part_of_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    some = html.fit(pages, 20)
    assert some != html.fit(pages) and set(some) == set(html.FIXED) and some == html.fit(pages.repartition(3), 20)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html.extract_pages(pages).collect()), key=str) == [(1, "x", 1), (1, "x", 1), (None, "", 0)]
    assert html.extract_pages(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 3 media
@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 100])
def test_media_round_trip(payload):
    padded = media.pad(payload)
    assert len(padded) % 64 == 0 and padded.startswith(payload) and len(padded) >= 64
    data = media.write_media(padded)
    (track,) = media.read_media(data)
    assert media.payload_of(data, track) == padded and track["codec"] == "raw" and track["ticks"] == track["duration"] == len(padded)
    first, end = track["key_ranges"][0]
    assert data[first:end] == padded[: end - first]


def test_media_bears_broken_boxes():
    good = media.write_media(media.pad(b"abc" * 3000))
    for k in range(0, len(good), 97):
        media.read_media(good[:k])
        media.read_media(good[:k] + b"\x00\x00\x00\x00moov" + good[k:])


def test_media_tracks_at_any_depth():
    data = media.write_media(media.pad(b"abc" * 300))
    inside = data[data.index(b"moov") - 4 :]
    size = int.from_bytes(inside[:4], "big")
    box = inside[:size]
    for _ in range(3000):
        box = (len(box) + 8).to_bytes(4, "big") + b"moov" + box
    assert len(media.read_media(data.replace(inside[:size], box))) == 1


def test_media_rows(spark, docs, nothing):
    rows = media.documents_as_media(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(t for d, t, *_ in ROWS if d == r.doc_id) or ""
        padded = media.pad(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.documents_as_media(nothing).count() == 0


# ---------------------------------------------------------------- 4 mixing
def test_mix(spark, docs, nothing):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    source = {k: s for k, _, s in rows}
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in out:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size and r.taken % r.size == 0
    assert all(abs(taken[s] - target[s]) <= 20 for s in size) and abs(sum(target.values()) - sum(size.values())) < 1e-6
    # shares by weight, capped at three times a source
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    open_, want, rest = set(order), {}, float(sum(size.values()))
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            rest -= want[s]
            open_.remove(s)
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in order)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (3, 4, 7)} == {0}
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_mix_documents_takes_each_row_as_mix_says(spark):
    """doc_ids in several sources and with several texts, nulls, and equal rows."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), "w " * rng.randint(0, 30), rng.choice(["a", "a", "b", "c", None])) for _ in range(300)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = collections.Counter()
    for r in mixing.mix_rows(df).collect():
        said[r.doc_id, r.source, r.size] += r.copies
    taken = collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mix_documents(df).collect())
    assert taken == +said and len({c for c in said.values()}) > 2


# ---------------------------------------------------------------- 5 decontamination
ITEM = "A train leaves Boston at 60 mph and Anna waits 3 hours for the train at Boston station with her 3 bags"


def test_decontamination(spark, nothing):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (None, "the null item is a long enough sentence of plain words")], "item_id int, text string")
    texts = [
        "Bla. A train leaves Denver at 75 km and Peter waits 4 hours for the train at Denver station with her 4 bags", "A train leaves Denver at 75 km and Peter waits 4 hours for the train at Miami station with her 9 bags",
        "x y z " + ITEM.upper().lower() + " and more", "clean text with nothing to see", None, "", "the null item is a long enough sentence of plain words", "too short",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("hash", F.lit(1))
    found = sorted((r.doc_id, r.item_id or 0) for r in decontam.find_contamination(docs, items).collect())
    assert found == [(0, 1), (2, 1), (6, 0)]
    assert {r.doc_id for r in decontam.drop_contaminated(docs, items).collect()} >= {1, 3, 4, 5, 7}
    assert decontam.find_contamination(nothing, items).count() == 0 and decontam.find_contamination(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("run", ["Anna Boston ", "twenty three ", "1,234.5,"])
def test_decontamination_takes_runs_of_any_length(spark, run):
    """Names, number words and figures on end, more of them than a matcher that recurses has stack for."""
    docs = spark.createDataFrame([(0, run * 100_000 + ". " + ITEM), (1, run * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id int, text string")
    assert [r.doc_id for r in decontam.find_contamination(docs, items).collect()] == [0]


def test_decontamination_equals_containment(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()} == want


def test_decontamination_finds_passages_and_short_items(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ta") for b in ("ba", "de", "fi", "go", "hu", "ja", "ke", "li")][:59]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "three plain words"), (3, "too short")], "item_id int, text string")
    texts = [" ".join(["before", *words[20:50], "after"]), " ".join(["x", *words[5:18], "y"]), " ".join(["x", *words[5:17], "y"]), " ".join([*words[5:15], "x", *words[16:26]]), "Here are three plain words on end.", "Three plain words", "three words plain", "too short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): r.n_windows for r in decontam.find_contamination(docs, items).collect()}
    assert rows == {(0, 1): 26, (1, 1): 9, (4, 2): 1, (5, 2): 1}


def test_decontamination_runs_keep_values_consistent(spark):
    item = "we count 3 birds on every roof and note 3 cats under every car before the long rain begins again over quiet hills and empty fields where nobody walks at night anymore since winter came early"
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    part = "we count {} birds on every roof and note {} cats under every"
    docs = spark.createDataFrame([(0, part.format(5, 5)), (1, part.format(5, 6))], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find_contamination(docs, items).collect()] == [0]


def test_decontamination_finds_copies_in_other_case(spark):
    german = "Der alte Lehrer gab jedem Schüler Papier, Tinte, Feder und ein Buch mit Bildern von Schiffen, Bergen und Tieren"
    items = spark.createDataFrame([(1, ITEM), (2, german)], "item_id int, text string")
    texts = [f"x y z {ITEM.lower()} and more", ITEM.upper(), german.lower(), german.upper(), german, ITEM]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): r.coverage for r in decontam.find_contamination(docs, items).collect()}
    assert rows == {(d, i): 1.0 for d, i in ((0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 1))}


def test_decontamination_names_at_sentence_starts_and_both_ways(spark):
    items = spark.createDataFrame([(1, "Tom has 3 apples. Ann has 5 pears. Tom gives 2 to Ann."), (2, "What is 2 + 2?"), (3, "17 + 25 = 42"), (4, ITEM)], "item_id int, text string")
    texts = [
        "Bob has 7 apples. Eve has 9 pears. Bob gives 4 to Eve.", "So: what is 2 + 2?", "What is 2 + 3?", "We know that 17 + 25 = 42 holds", "We know that 17 + 24 = 41 holds",
        "A train leaves Paris at 60 mph and Paris waits 3 hours for the train at Paris station with her 3 bags", "A train leaves Paris at 60 mph and Rosa waits 3 hours for the train at Paris station with her 3 bags",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (9, "filler words of a very long text " * 20000 + texts[0])], "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect())
    assert found == [(0, 1), (1, 2), (3, 3), (6, 4), (9, 1)]


def _template(text):
    """Two lists of (token, value, kind of placeholder), of the template and of the plain tokens."""
    import regex

    d = decontam
    units, name, number = set(d.UNITS.split()), regex.compile(d.NAME), regex.compile(rf"(?i:{d.NUMBER})")

    def read(pattern, kind_of):
        out, end = [], None
        for m in regex.finditer(pattern, text):
            word, kind = m.group().lower(), kind_of(m)
            if end is not None and word in units and text[end : m.start()] in ("", " ", "-"):
                kind = d.UNI
            out.append((word, kind))
            end = m.end() if kind == d.NUM else None
        return out

    template = read(rf"{d.NAME}|(?i:{d.NUMBER})|[\p{{L}}\p{{M}}]+", lambda m: d.NAM if name.fullmatch(text, m.start(), m.end()) else d.NUM if number.fullmatch(m.group()) else None)
    plain = read(d.TOKEN, lambda m: d.NUM if m.group()[0].isnumeric() else None)
    return [(k or w, d.VALUES.get(w, w) if k == d.NUM else w, k) for w, k in template], [(w, w, k) for w, k in plain]


def _brute_found(doc, item):
    """The definition, by one alignment after the other over all pairs of places."""
    w = decontam.WINDOW
    for plain, d, t in zip((False, True), _template(doc), _template(item)):
        size = min(w, len(t))
        specific = {p for p in range(len(t) - size + 1) if sum(k is None for _, _, k in t[p : p + size]) >= decontam.MIN_WORDS}
        hits = {(q - p, p) for p in specific for q in range(len(d) - size + 1) if all(a[0] == b[0] for a, b in zip(t[p : p + size], d[q : q + size]))}
        windows = {p: tuple(x[0] for x in t[p : p + size]) for p in specific}

        def passes(hits):
            if len({windows[p] for _, p in hits}) >= decontam.COVERAGE * len(set(windows.values())):
                return True
            for line in {x for x, _ in hits}:
                first = last = None
                for p in sorted(p for x, p in hits if x == line):
                    first = p if first is None or p - last > w else first
                    last = p
                    if last + size - first >= decontam.RUN:
                        return True
            return False

        if not specific or not passes(hits):
            continue
        if not plain:
            bad = set()
            for line in {x for x, _ in hits}:
                there, back = collections.defaultdict(set), collections.defaultdict(set)
                places = [p for x, p in hits if x == line]
                slots = [(k, t[k][2], t[k][1], d[k + line][1]) for k in range(min(places), max(places) + size) if t[k][2] and t[k][2] == d[k + line][2]]
                for _, kind, was, now in slots:
                    there[kind, was].add(now)
                    back[kind, now].add(was)
                wrong = {k for k, kind, was, now in slots if len(there[kind, was]) > 1 or kind != decontam.NUM and len(back[kind, now]) > 1}
                bad |= {(line, p) for p in places if not wrong.isdisjoint(range(p, p + size))}
            hits -= bad
        if passes(hits):
            return True
    return False


def test_decontamination_equals_brute_force_and_finds_other_parameters(spark):
    rng = random.Random(12)
    names, places = ["Tom", "Ann", "Rosa", "Ivan", "Mei", "Omar", "Lena", "Kofi"], ["Boston", "Lagos", "Oslo", "Lima", "Perth", "Quito"]
    frames = [
        "{a} has {n} apples and gives {m} of them to {b}. How many apples does {a} keep for the trip to {p}?", "A train leaves {p} at {n} km and reaches {q} after {m} hours. How fast does the train to {q} go on average?",
        "{a} and {b} paint a fence that is {n} m long. {a} paints {m} m on the first day, how much is left for {b}?", "In {p} it rains on {n} days of a month, in {q} on {m} days. Where does it rain more often, asks {a}?",
    ]

    def filled(frame):
        (a, b), (p, q) = rng.sample(names, 2), rng.sample(places, 2)
        return frame.format(a=a, b=b, p=p, q=q, n=rng.randint(2, 90), m=rng.randint(2, 90))

    items = [filled(f) for f in frames]
    docs = [(k, k % 4, f"Some words of another kind stand here. {filled(frames[k % 4])} And more of them follow.") for k in range(40)]
    mixed = []
    for k in range(40, 80):
        words = filled(frames[k % 4]).split()
        cut = rng.randint(0, len(words))
        mixed.append((k, " ".join(words[:cut] + rng.sample(names, 2) + filled(rng.choice(frames)).split()[cut:])))
    texts = [(k, t) for k, _, t in docs] + mixed
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()}
    assert got == {(k, i) for k, t in texts for i, item in enumerate(items) if _brute_found(t, item)}
    assert len(got & {(k, i) for k, i, _ in docs}) >= 0.9 * len(docs)


def test_decontamination_tokens_of_names_and_numbers(spark):
    text = "Mary Jane Watson paid twenty-five dollars, One Hundred and six km; two one-way trips for 3 kg of \ue002 Tea. Two and three make no one 5. SEVEN"
    tokens = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    rows = tokens.select(decontam.template_tokens(F.col("text")).alias("t"), decontam.raw_tokens(F.col("text")).alias("r"), decontam.plain_tokens(F.col("text")).alias("p"), decontam.plain_kinds(F.col("text")).alias("k")).collect()
    n, u, a = decontam.NUM, decontam.UNI, decontam.NAM
    assert rows[0].t == [a, "paid", n, u, n, u, n, "way", "trips", "for", n, u, "of", a, n, "and", n, "make", "no", "one", n, n]
    assert rows[0].r[:4] == ["Mary Jane Watson", "paid", "twenty-five", "dollars"] and len(rows[0].r) == len(rows[0].t) and len(rows[0].p) == len(rows[0].k)
    assert [(r.t, r.r) for r in rows[1:]] == [([], []), (None, None)]


def test_decontamination_recall_of_two_word_names_and_number_words(spark):
    rng = random.Random(29)
    short, long = ["Tom", "Ann", "Ivan", "Mei", "Omar", "Kofi"], ["Mary Jane", "Sue Ellen", "Juan Carlos", "Anna Maria", "Jean Luc", "Li Wei"]
    words = [None, None, *decontam.SMALL, *decontam.TENS]
    frames = [
        "{a} has {n} apples. {b} has {m} pears. {a} gives {k} to {b}.", "{a} reads {n} pages of a book on the first day and {m} pages on the second day. How many pages has {b} read if {b} is {k} pages ahead?",
        "A bus leaves at noon with {a} and {n} other people on board. At the next stop {m} get off and {b} gets on with {k} friends. How many ride on?", "{a} walks {n} miles to the house of {b} and {m} miles back home by another road. How far did {a} walk in {k} weeks?",
    ]

    def filled(frame, names, spelled):
        (a, b), numbers = rng.sample(names, 2), rng.sample(range(2, 20), 3)
        return frame.format(a=a, b=b, **{s: words[x] if spelled else x for s, x in zip("nmk", numbers)})

    items = [filled(f, short, False) for f in frames]
    docs = [(k, f"Some other words stand in front here. {filled(frames[k % 4], long if k % 3 else short, k % 2 == 0)} More of them follow after it.") for k in range(48)]
    swapped = [(48 + k, filled(frames[k % 4], long, True).replace(frames[k % 4].split("{n}")[1].split()[0], "something else again"[: 9 + k % 2])) for k in range(8)]
    texts = [*docs, *swapped, (90, "nothing of the kind is told in here by Mary Jane and twenty friends")]
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()}
    assert got == {(k, i) for k, t in texts for i, item in enumerate(items) if _brute_found(t, item)}
    assert len(got & {(k, k % 4) for k, _ in docs}) >= 0.9 * len(docs) and 90 not in {d for d, _ in got}


def test_decontamination_of_a_very_long_text_and_repeated_rows(spark):
    item = "Tom has 3 apples and gives 2 of them to Ann before they both go home to rest."
    other = "Mary Jane has nine apples and gives four of them to Sue Ellen before they both go home to rest."
    long = "plain filler words without any meaning at all " * 60000
    docs = spark.createDataFrame([(1, long + other), (1, long + other), (2, long), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (1, item)], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()] == [(1, 1)]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [2, 3, 4]


# ---------------------------------------------------------------- 6 near-duplicates
def _sets(texts, k):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _components(texts, k, hundredths):
    sets, root = _sets(texts, k), {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(sets[d]), top(d)) for d in texts}


def _family(rng, n, size, edits):
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=size)
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = rng.choice(words)
        yield " ".join(own)


@pytest.mark.parametrize("block", [8, 2048])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(6)
    texts = [t for n, size, edits in ((60, 150, 9), (25, 90, 4), (8, 300, 12), (3, 40, 1)) for t in _family(rng, n, size, edits)] + ["a", "A", "", "b c", None]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 0.85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _components(texts, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_edges(spark, docs, nothing):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert {(1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 3, 6, True), (None, 1, None, True)} <= rows
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert neardup.near_duplicates(nothing).count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    """Each text of a doc_id is a document of its own; nothing is lost and reruns agree."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "a"), (5, "quite another text with nothing in common at all", "b"), (5, base, "c"), (5, base, "d"), (7, "Quite another text with nothing in common at all", "e"), (8, "a third text that stands alone here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = collections.Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got in (collections.Counter({(1, 1): 1, (5, 5): 1, (5, 1): 2, (7, 5): 1, (8, 8): 1}), collections.Counter({(1, 1): 1, (5, 7): 1, (5, 1): 2, (7, 7): 1, (8, 8): 1}))
    kept = [sorted((r.doc_id, r.tag) for r in neardup.deduplicate(docs).collect()) for _ in range(2)]
    assert kept[0] == kept[1] and {t for _, t in kept[0]} in ({"a", "b", "f"}, {"a", "e", "f"})


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (5, 5)]
    space = Workspace(spark, "test")
    got = {r.node: r.component for r in components(space, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == got[102] == 100
    assert components(space, spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 7 URL filter
def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1", "https://x.example.org/en/12", "http://example.com/fr/a", "http://example.com/de/a", "http://other.net/x", "no scheme", None, "http://org", "ftp://myorg/x", "http://example.org/en/2?x=http://y.com/de/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages).collect()}
    assert rows[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and rows[1][2:] == ("example.org/en/1", "block")
    assert rows[2][2:] == ("com/fr/", "allow") and rows[3][2:] == ("com/de/", "block") and rows[4][2] is None
    assert rows[5][:3] == ("", "", None) and rows[6][:3] == ("", "", None) and rows[7][:3] == ("org", "", None) and rows[8][2] is None and rows[9][2:] == ("org/", "allow")
    assert urlfilter.filter_urls(pages).count() == len(urls) + 1 and urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_url_rules_are_mined(spark):
    rows = [(f"http://s{k}.bad-casino.net/x/{k}", "block") for k in range(60)] + [(f"http://s{k}.news.net/x/{k}", "allow") for k in range(60)]
    labels = spark.createDataFrame(rows, "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://q.bad-casino.net/zz"), (2, "http://q.news.net/zz"), (3, "http://unknown.info/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, labels=labels).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def _brute_rules(rows, min_support, min_confidence, most):
    """All combinations of up to `most` tokens with a label, pruned as the operator says."""
    least, total = math.ceil(min_support * len(rows)), len(rows)
    seen, freq = collections.Counter(), collections.Counter()
    for tokens, verdict in rows:
        for n in range(1, most + 1):
            for c in itertools.combinations(sorted(set(tokens)), n):
                seen[c] += 1
                freq[c, verdict] += 1
    rules = {(c, v): (f / seen[c], f / total) for (c, v), f in freq.items() if f >= least and f / seen[c] >= min_confidence}
    return {(c, v): x for (c, v), x in rules.items() if not any(((p, v) in rules and rules[p, v][0] >= x[0]) for p in itertools.combinations(c, len(c) - 1) if p)}


@pytest.mark.parametrize("max_items", [12, 2])
def test_url_rules_equal_brute_force(spark, monkeypatch, max_items):
    monkeypatch.setattr(urlfilter, "MAX_ITEMS", max_items)
    monkeypatch.setattr(urlfilter, "BLOCK_ITEMS", 2)
    rng, rows, asked = random.Random(13), [], []
    for k in range(260):
        tokens = [t for t in "abcdefg" if rng.random() < 0.45]
        tokens += ["h", "i"] if "a" in tokens else []
        tokens += ["z"] if "b" in tokens and "c" in tokens and k % 2 else []
        verdict = "block" if {"a", "d"} <= set(tokens) or {"b", "e", "g"} <= set(tokens) or "z" in tokens or rng.random() < 0.1 else "allow"
        (rows if k < 200 else asked).append((tokens or ["q"], verdict))
    asked += [(["i", "d"], "x"), (["h"], "x"), (["none"], "x")]
    space = Workspace(spark, "rules")
    mined = urlfilter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), space, 0.02, 0.8, 3)
    urls = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(asked)], "row string, tokens array<string>")
    got = {r.row: (r.mined, round(r.confidence, 9)) for r in urlfilter.match_rules(urls, mined).collect()}
    rules, want = _brute_rules(rows, 0.02, 0.8, 3), {}
    for k, (tokens, _) in enumerate(asked):
        fits = [(c, s, len(t), v) for (t, v), (c, s) in rules.items() if set(t) <= set(tokens)]
        if fits:
            want[str(k)] = (max(fits)[3], round(max(fits)[0], 9))
    assert got == want and len(want) > 20
    expanded = {(tuple(sorted(t)), r.verdict) for r in mined.collect() for t in itertools.product(*r.tokens)}
    assert expanded == set(rules)


def test_url_with_many_keys_that_come_together(spark):
    keys = "&".join(f"k{k:02d}=1" for k in range(25))
    rows = [(k, f"http://www.example.com/{'fr' if k % 2 else 'de'}/{k}?{keys}") for k in range(200)] + [(200, f"http://other.net/?{keys}"), (201, "http://other.net/" + "x" * 100_000)]
    rng = random.Random(14)
    rows += [(300 + k, f"http://www.example.com/{'fr' if k % 2 else 'de'}/{k}?" + "&".join(f"j{j:02d}" for j in range(25) if rng.random() < 0.5)) for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert {r.verdict for r in urlfilter.filter_urls(pages).collect()} <= {"allow", "block"}


# ---------------------------------------------------------------- 8 lines
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(8)
    for _ in range(4000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        for most in range(4):
            assert linedup.within_edits(a, b, most) == (_distance(a, b) <= most)


@pytest.mark.parametrize("hot", [4096, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot):
    """Lines with characters and words replaced, put in and left out; also with keys of a few rows passed through as hot ones."""
    monkeypatch.setattr(linedup, "HOT_CHUNK", hot)
    monkeypatch.setattr(linedup, "HOT_BUCKET", hot)
    monkeypatch.setattr(linedup, "BUCKET_KEYS", 1 << 19 if hot > 3 else 50)
    monkeypatch.setattr(linedup, "BLOCK", 2048 if hot > 3 else 4)
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "." for n in (15, 19, 25, 39, 41, 60, 60, 120)]
    bases += [" ".join(f"w{rng.randint(0, 60)}" for _ in range(n)) for n in (8, 10, 11, 19, 21, 30, 41, 90)]
    texts = []
    for _ in range(50):
        lines = []
        for _ in range(rng.randint(0, 5)):
            own = rng.choice(bases)
            if rng.random() < 0.5 and own[0] == "w":
                own = own.split()
                for _ in range(rng.randint(0, 4)):
                    k = rng.randrange(len(own))
                    own[k : k + rng.randint(0, 1)] = rng.choice([[], ["another"], ["word"]])
                own = " ".join(own)
            else:
                own = list(own)
                for _ in range(rng.randint(0, 3)):
                    k = rng.randrange(len(own))
                    own[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
                own = "".join(own)
            lines.append(own)
        texts.append("\n".join(lines))
    docs = list(enumerate(texts))
    lines = [(d, n, x.strip(" \t\r\x0b\x0c")) for d, t in docs for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    distinct = sorted({x for _, _, x in lines})
    root = {x: x for x in distinct}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def near(a, b):
        for x, y, bounds in ((a, b, (20, 40)), (a.split(), b.split(), (10, 20, 40))):
            most = sum(min(len(x), len(y)) >= n for n in bounds)
            if abs(len(x) - len(y)) <= most and _distance(x, y) <= most:
                return True
        return False

    for a, b in itertools.combinations(distinct, 2):
        if near(a, b):
            root[top(b)] = top(a)
    first = {}
    for d, n, x in lines:
        first.setdefault(top(x), (d, n))
    want = {d: (sum(1 for e, _, _ in lines if e == d), sum(1 for e, n, x in lines if e == d and first[top(x)] != (d, n))) for d, _ in docs}
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_a_long_line_with_a_replaced_word_is_near(spark):
    words = [f"word{k}" for k in range(30)]
    other = [words[:7] + ["replacement"] + words[8:], words[:20] + ["insertion"] + words[20:], words[:3] + words[4:], [f"other{k}" for k in range(30)]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([words, *other])], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in linedup.line_report(docs).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_line_dedup_edges(spark, docs, nothing):
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.n_near) for r in linedup.line_report(docs).collect()}
    assert rows[2] == (1, 1, 0) and rows[1] == (1, 0, 0) and rows[8] == (3, 1, 1) and rows[3] == (0, 0, 0)
    out = linedup.dedup_lines(docs)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and texts[8] == "line one is a fairly long line of text\nline two\n" and texts[2] == "" and texts[3] is None
    assert linedup.line_report(nothing).count() == 0


# ---------------------------------------------------------------- 9 WARC
def test_warc(spark):
    rows = [(1, "http://www.a.org/x", "<p>same</p>"), (2, "http://a.org/é", "<p>same</p>"), (3, None, None), (4, "u", ""), (4, "u", ""), (None, "http://b.org", "<i>one</i>"), (9, "http://a.org/é", "x" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    catalogue, records = warc.archive_pages(pages)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == collections.Counter([
        (1, 11, digest("<p>same</p>"), "revisit", 2), (2, 11, digest("<p>same</p>"), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None), (4, 0, digest(""), "response", None),
        (None, 10, digest("<i>one</i>"), "response", None), (9, 70000, digest("x" * 70000), "response", None),
    ])
    asked = spark.createDataFrame([("http://a.org/é",), ("http://none.org/",), (None,)], "url string")
    hits = warc.lookup(asked, catalogue).collect()
    assert sorted(h.key for h in hits) == ["", "org,a)/é", "org,a)/é"]
    assert {warc.read_record(h.file, h.offset, h.length)[0]["WARC-Record-ID"] for h in hits if h.key} == {"<urn:page:2>", "<urn:page:9>"}
    # the look-up of all pages meets every capture of the full listing once
    place = lambda df: collections.Counter((h.key, h.file, h.offset, h.length) for h in df.collect())
    assert place(warc.lookup(pages, catalogue)) == place(warc.index_entries(catalogue)) and len(place(warc.index_entries(catalogue))) == len(rows)
    _, large = warc.archive_pages(pages, min_bytes=11)
    assert {r.page_id for r in large.collect() if r.record_type == "revisit"} == {1}
    assert warc.archive_pages(pages.limit(0))[1].count() == 0


def test_capture_keys_and_blocks(tmp_path):
    assert warc.capture_key("http://www.A.org/x?y") == "org,a,www)/x?y" and warc.capture_key(None) == "" and warc.capture_key("x") == "x"
    lines = sorted((f"k{k // 7:05d}", "f", k, 1) for k in range(500)) + [("k99999\t%\n", "f", 1, 2)]
    data, n = warc.pack_index(lines, 16)
    (tmp_path / "i").write_bytes(data)
    index = warc.IndexFile(f"file://{tmp_path}/i")
    assert n == len(index.blocks) == 32
    for key in ("k00000", "k00035", "k00071", "k99999\t%\n", "zz", ""):
        assert index.find(key) == [x for x in lines if x[0] == key]


# ---------------------------------------------------------------- 10 token ids
def _plain():
    """The library's tokenizer, as it is."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokenids.DEFAULT_TOKENIZER))


def test_pieces_equal_whole_texts():
    plain, ours, rng = _plain(), tokenids.text_encoder(), random.Random(10)
    parts = ["the", "Ünder", " ", "  ", "\n", "\n\n", "\t", "don't", "'s", "1,234.5", "...", "!!", "%%%", "naïve", "日本語", "\xa0", "\u2003", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "é", "\r\n", "\x1c", "😀", "A.", "|"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_codes_give_random_access():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 1 << 32, 500)]).astype(np.uint32)
    rng.shuffle(ids)
    shard = tokenids.Shard(tokenids.pack_shard([5, None], np.array([1000, 2500]), ids))
    assert shard.offsets.tolist() == [0, 1000, 3500] and shard.doc_null.tolist() == [0, 1]
    assert all(shard.token(k) == ids[k] for k in [0, 1, 511, 512, 513, 1023, 3499, *rng.integers(0, 3500, 300).tolist()])
    for a, b in ((0, 3500), (0, 0), (7, 9), (511, 1025), (3499, 3500)):
        assert (shard.tokens(a, b) == ids[a:b]).all()
    empty = tokenids.Shard(tokenids.pack_shard([], np.zeros(0, np.int64), np.zeros(0, np.uint32)))
    assert len(empty.tokens(0, 0)) == 0


def test_token_files(spark, docs, nothing):
    plain, at = _plain(), 0
    rows = sorted(tokenids.token_ids(docs, shard_tokens=20).collect(), key=lambda r: r.start)
    for (doc_id, text, *_), r in zip(sorted(ROWS, key=lambda x: (-1 if x[0] is None else x[0], x[1] or "")), rows, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenids.token_ids(nothing).count() == 0


def test_special_tokens_are_one_id(spark):
    plain, at = _plain(), 0
    rows = [(1, "one<|endoftext|>two <|endoftext|>\n<|endoftext|> three"), (2, "<|endoftext|>"), (3, "after")]
    for (_, text), r in zip(rows, sorted(tokenids.token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start), strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())) and ids.tolist().count(50256) == text.count("<|endoftext|>")
        at += len(ids)


def test_token_ids_keep_common_pieces_in_few_generations(monkeypatch):
    import public_tokenizers

    plain, ours, rng = _plain(), tokenids.TextEncoder(public_tokenizers.path(tokenids.DEFAULT_TOKENIZER)), random.Random(11)
    monkeypatch.setattr(tokenids, "CACHE_PIECES", 50)
    made = []
    monkeypatch.setattr(tokenids.Pieces, "_made", lambda self, piece, of=tokenids.Pieces._made: made.append(piece) or of(self, piece))
    for k in range(200):
        text = " ".join(x for n in range(20) for x in ("common", f"rare{k}x{n}{rng.choice('abc')}"))
        assert ours.encode(text) == tokenids.packed(plain.encode(text, add_special_tokens=False).ids)
        assert all(len(p) <= 50 and len(p.older) <= 50 for p in (ours.first, ours.later))
    assert made.count("common") <= 2  # once at a text's start, once elsewhere
