"""Tokens, packing, media, HTML and sharding: exact round trips and brute force, with every odd case."""

import hashlib
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexweave.llm import html_extract, media, packing, sharding
from lexweave.llm.bpe import Vocabulary, digest_columns, encode_column
from lexweave.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library(docs, wide, nothing, rows, library):
    got = sorted(tuple(r) for r in digest_columns(encode_column(wide, word_vocabulary())).collect() if r.doc_id)
    expected = []
    for i, t, *_ in rows:
        if i:
            ids = ids_of(library, t)
            text = library.decode(ids, skip_special_tokens=False)
            expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected)
    assert encode_column(nothing, word_vocabulary()).count() == 0


def test_bpe_on_random_texts(library, monkeypatch):
    from lexweave.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 50)  # the cache is emptied again and again
    rng, v = random.Random(1), Vocabulary(word_vocabulary())
    signs = "aaabcdeéàÅßñÜΣ ,.'!?1 2\n\t-<|>%\x1c\x85漢"
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(800)] + ["a" * 3000, "'s'll'VE I'm", "<|startoftext|>a<|endoftext|>"]
    for k in range(0, len(texts), 97):
        same_ids(v, library, texts[k : k + 97])


def same_ids(vocab, library, texts):
    ids, at = vocab.encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    wrong = [ascii(t) for t, x, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True) if x != e.ids]
    assert not wrong, wrong[:20]


def test_bpe_on_every_code_point(library):
    v, points = Vocabulary(word_vocabulary()), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 100_000):
        same_ids(v, library, [f"a{c}b {c}{c} {c}7" for c in points[k : k + 100_000]])


def test_differencing():
    home, loads = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(loads.tolist()) == [14, 16] and Counter(home.tolist()).total() == 5  # differencing misses the even split by one
    rng = random.Random(2)
    sizes = [rng.randrange(1, 400) for _ in range(300)]
    _, loads = packing.differencing(sizes, 20)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 30
    home = packing.balanced([60, 60, 60], 100)
    assert len(set(home.tolist())) == 3  # the count rises, as two windows can't hold three


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(docs, wide, nothing, rows, library, window):
    got = packing.pack_documents(wide, word_vocabulary(), window=window, ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, n in Counter(r[0] for r in rows).items():
        text = next(t for j, t, *_ in rows if j == i)
        whole = np.array([*ids_of(library, text), 2], "<u4").tobytes()
        own = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == n * len(whole) // 4
        for r in own:
            part = whole[r.start * 4 : (r.start + r.length) * 4]
            assert (r.ids, r.ids_crc32, r.doc_tokens) == (part, zlib.crc32(part), len(whole) // 4)
        if n == 1:
            at = 0
            for r in own:
                assert r.start == at
                at += r.length
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= 0.05 * sum(r.length for r in got)
    assert packing.pack_documents(nothing, word_vocabulary()).count() == 0


def test_media_round_trip(wide, nothing, rows, spark):
    got = media.media_columns(wide).collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload)) and len(payload) % 576 == 0 and payload
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.feature == media.feature(payload)
        assert (r.width, r.width * r.height) == (576, len(payload))
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            stored = tar.extractfile(f"{r.digest}.png").read()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.from_png(stored) == payload
    assert len({r.digest for r in got}) == len({media.padded(t) for t in texts.values()})
    assert media.media_columns(nothing).count() == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("a &lt; b &amp;\n c", "a < b & c"),
    ("<html><body><nav><a href='/'>Home page of it</a></nav><article><h1>T  x</h1><p>One&nbsp;two<br>three <b>fo</b>ur.</p><div class='ad-box'>Buy now and more and more</div><p>End.</p><form>Your name <input></form><p>7</p></article><section class='comments'><p>Great article, thanks a lot, very good</p></section><footer>Imprint and words</footer>", "T x\nOne two\nthree four.\nEnd.\n7"),
    ("<body><div id='cookieNotice'>We use cookies, accept all of them now</div><div class=sidebar><p>Some long list of other things to read here</p></div><div id='content'><div><p>First part of it is here.</p></div><div><p>Second part, not long.</p></div></div><script>if (a<b) { document.write('<p>no no no no</p>') }</script></body>", "First part of it is here.\nSecond part, not long."),
    ("<style>p{}</style><p>Unclosed <b>bold<p>Next &copy; text<!-- hidden words here --> goes on", "Unclosed bold\nNext © text goes on"),
    ("<article><div class='entry-header'><h1 class='page-header'>Real title of it</h1></div><div class='share-price-table'><p>Price is 3 and rises</p></div><div class='alert-box'>Mind the step here</div><div class='post-share-buttons'>Share it</div><p>End of it.</p></article>", "Real title of it\nPrice is 3 and rises\nMind the step here\nEnd of it."),
    ("<article><p>One<div/><p>two <a href=/x/>three</a> four<div class='related-posts'><p>Other things to read</p></div></article>", "One\ntwo three four"),
    ("<body class='has-sidebar'><div class='with-sidebar'><div class='site-sidebar'>Lists of other things<article><p>The text itself is here and long.</p></article>and tags</div></div><div id='comments'><article class='comment-body'><p>I liked it very much, thanks for all of this, dear</p></article></div>", "The text itself is here and long."),
    ("<article><p>" + "long word " * 50_000 + "</p></article>", ("long word " * 50_000).strip()),
]


def test_html(spark):
    rows = [(k, f"http://x/{k}", h, "extra") for k, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(df).orderBy("page_id").collect()
    for r, (_, expected) in zip(got, PAGES, strict=True):
        assert (r.text, r.n_chars) == (expected, len(expected)), r.page_id
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    twice = html_extract.extract_pages(df.union(df)).collect()
    assert len(twice) == 2 * len(PAGES) and len({tuple(r) for r in twice}) == len(PAGES)


def slow_text(tree):
    """Main text of a tree of (tag, left out, children) and texts: every region is tried."""
    items, articles = [], []

    def walk(node, out, link):
        if isinstance(node, str):
            items.append((0.0 if out else len(node.split()) * (html_extract.LINK_WORD if link else 1.0), "" if out else node, False))
            return
        tag, hidden, children = node
        out, link = out or hidden, link or tag == "a"
        edge = 0.0 if out else html_extract.fit_weights().get(tag, html_extract.UNKNOWN)
        first = len(items)
        items.append((edge, "", tag not in ("a", "b", "i")))
        for child in children:
            walk(child, out, link)
        if tag == "article" and not out:
            articles.append((first, len(items)))
        items.append((edge, "", tag not in ("a", "b", "i")))

    walk(tree, False, False)
    best, region = 0.0, (0, 0)
    for i in range(len(items)):
        for j in range(i + 1, len(items) + 1):
            total = sum(x[0] for x in items[i:j])
            if total > best + 1e-9:
                best, region = total, (i, j)
    i, j = region
    held = [a for a in articles if a[0] <= i < j <= a[1]]
    if held:
        i, j = min(held, key=lambda a: a[1] - a[0])
    elif i < j:
        while i and not items[i][2] and not items[i - 1][2]:
            i -= 1
        while j < len(items) and not items[j - 1][2] and not items[j][2]:
            j += 1
    blocks = [""]
    for _, text, cut in items[i:j]:
        blocks = [*blocks, ""] if cut else [*blocks[:-1], blocks[-1] + text]
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def test_html_equals_a_slow_version():
    """Random pages, as trees whose left out elements are known, against trying every region."""
    rng = random.Random(12)
    kinds = [("p", "", False), ("div", "", False), ("section", "", False), ("ul", "", False), ("b", "", False), ("a", " href='x'", False), ("nav", "", True), ("aside", "", True), ("div", " class='ad-slot'", True), ("div", " id=comments", True), ("footer", "", True), ("article", "", False), ("h2", " class='menu'", False)]

    def made(depth):
        tag, attributes, hidden = rng.choice(kinds if depth else kinds[:3])
        children, html = [], ""
        for _ in range(rng.randrange(1, 4)):
            if depth > 2 or rng.random() < 0.5:
                text = " ".join(rng.choice(["word", "other", "long one", "x  y\n"]) for _ in range(rng.randrange(1, 9)))
                children.append(text)
                html += text
            else:
                child, inner = made(depth + 1)
                if tag == "p" and child[0] not in ("a", "b"):  # what isn't part of a line ends a paragraph
                    continue
                children.append(child)
                html += inner
        return (tag, hidden, children), f"<{tag}{attributes}>{html}</{tag}>"

    def lines(node, inside=False):
        """Whether elements of a line hold elements of their own kind only."""
        return isinstance(node, str) or (not inside or node[0] in ("a", "b")) and all(lines(c, inside or node[0] in ("a", "b", "p")) for c in node[2])

    tried = 0
    while tried < 150:
        tree, html = made(0)
        if lines(tree):
            tried += 1
            got, slow = html_extract.main_text(html), slow_text(tree)
            assert got == slow, html


def test_best_region_is_the_maximum():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(12))]
        i, j = html_extract.best_region(x)
        assert sum(x[i:j]) == pytest.approx(max([0.0, *(sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1))]))


def test_weights_are_learned_and_negative():
    w = html_extract.fit_weights()
    assert all(x < 0 for x in w.values()) and w["a"] < w["p"]


@pytest.mark.parametrize("slice_rows", [3, 20_000])
def test_sharding(wide, nothing, rows, monkeypatch, slice_rows):
    monkeypatch.setattr(sharding, "SLICE_ROWS", slice_rows)
    got = sharding.interleaved_shards(wide, shards=4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert set(shards) == {0, 1, 2, 3} and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    again = sharding.interleaved_shards(wide.repartition(5), shards=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sharding.interleaved_shards(nothing).count() == 0


def test_sharding_keeps_the_mixture(spark):
    df = spark.createDataFrame([(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)], "doc_id long, text string, source string")
    counts = Counter((r.shard, r.source) for r in sharding.interleaved_shards(df, shards=8).collect())
    for source in {s for _, s in counts}:
        own = [counts[k, source] for k in range(8)]
        assert max(own) - min(own) <= 2
