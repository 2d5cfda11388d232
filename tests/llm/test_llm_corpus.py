"""Joins, dedup, language model, classifier, rules and the pipeline against brute force."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import WORD, words
from tokenizers import Tokenizer

import corpus_pipeline
from lexweave.llm import ngram_join, ngram_lm, quality_classifier, quality_rules, shared, substring_dedup
from lexweave.llm.queries import word_vocabulary
from lexweave.llm.shared import components


def brute_components(table, n, percent):
    sets = {}
    for i, t in table.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_scratch_folder_forms(spark, tmp_path, monkeypatch):
    """The shared folder may be given as a path, with one slash or with three."""
    for form in (f"file:{tmp_path}/a", f"file://{tmp_path}/b", f"{tmp_path}/c/"):
        monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda _, form=form: {"spark.checkpoint.dir": form})
        name = form.rstrip("/")[-1]
        assert shared.scratch_path(spark, "x").startswith(f"file://{tmp_path}/{name}/lexweave-")
        written = shared.materialize(spark.range(5), "five", 5)
        assert written.count() == 5 and len(list((tmp_path / name).rglob("*.parquet"))) == 1
        shared.discard(written)
        assert not [x for x in tmp_path.rglob("*.parquet") if x.exists()]
    shared.release_heap(spark)


def test_words_of_long_texts_are_hashed_alike(monkeypatch):
    rng = random.Random(17)
    texts = ["".join(rng.choices("ab \n", k=rng.randrange(0, 3000))) for _ in range(60)] + ["x" * 70_000, " " * 9000, "", "a b"]
    raw, offsets = shared.utf8_parts(pa.array(texts))
    words, at = shared.hash_words(raw, offsets)
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(shared, "CHUNK_BYTES", 512)
    again, places = shared.hash_words(raw, offsets)
    assert again.tolist() == words.tolist() and places.tolist() == at.tolist()
    known = {}
    for w, h in zip([w for t in texts for w in t.split()], words.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(300, 360)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_odd_rows(wide, nothing, rows, n, percent):
    expected = brute_components({i: t for i, t, *_ in rows if i}, n, percent)
    setting = wide.sparkSession.conf.get(shared._BATCH)
    got = ngram_join.ngram_components(wide, n=n, percent=percent).collect()
    assert wide.sparkSession.conf.get(shared._BATCH) == setting
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id is None) if r.doc_id is None else ((r.n_shingles, r.component_id) == expected[r.doc_id])
    assert ngram_join.ngram_components(nothing, n=n, percent=percent).count() == 0


@pytest.mark.parametrize("tile", [4, 2048])
def test_ngram_join_chains_of_copies(spark, monkeypatch, tile):
    """Copies of copies: many pairs lie on both sides of the threshold, in one tile or dealt to many."""
    monkeypatch.setattr(ngram_join, "TILE_DOCS", tile)
    rng, table = random.Random(7), {}
    for family in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        for k in range(40):
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = f"n{rng.randrange(9999)}"
            table[family * 100 + (k * 37) % 40] = " ".join(base)
    df = spark.createDataFrame([(i, t) for i, t in table.items()], "doc_id long, text string").repartition(4)
    for n, percent in ((3, 90), (5, 80), (1, 70)):
        expected = brute_components(table, n, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, n=n, percent=percent).collect()} == expected


def test_digests_lose_no_link():
    """Sets at the very threshold share a digest, small and large, with and without empty slices."""
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        bands = ngram_join.Bands(percent)
        for size in [*range(1, 60), 100, 333, 2000]:
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for extra in {0, ngram_join.most_differences(2 * size, percent) // 2, ngram_join.most_differences(2 * size, percent)}:
                drop = min(extra // 2, size - 1)
                b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, extra - drop, dtype=np.uint64))))
                if ngram_join.meets(len(np.intersect1d(a, b)), len(a), len(b), percent):
                    assert set(ngram_join.digests(a, bands).tolist()) & set(ngram_join.digests(b, bands).tolist())
                shared = len(np.intersect1d(a, b))
                assert ngram_join.shared_counts(a, [b, a]).tolist() == [shared, len(a)]
                for bits in (256, 4096):
                    assert ngram_join.overlap_bound(len(a), len(b), *ngram_join.bitmaps([a, b], bits)) >= shared


def test_ngram_join_ids_with_several_texts(spark):
    """An id with several texts is one document that links with what any of them links with; copies stand for each other."""
    w = [f"w{k}" for k in range(200)]
    a, b, c = (" ".join(w[k : k + 60]) for k in (0, 70, 140))
    near = lambda t: " ".join(t.split()[:-3])
    rows = [(9, a), (9, b), (7, a), (5, near(b)), (8, ""), (8, c), (3, near(c)), (4, near(c)), (2, "alone"), (None, a), (6, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=5, percent=80).collect()}
    assert got == {(9, 56): 5, (7, 56): 5, (5, 53): 5, (8, 0): 3, (8, 56): 3, (3, 53): 3, (4, 53): 3, (2, 1): 2, (None, 56): None, (6, 0): 6}


def test_tile_links():
    """Links of a tile join what links, are fewer than its members, and two tiles give links across only."""
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 2**64, 300, dtype=np.uint64), []
    for k in range(120):
        kept = rng.permutation(base[(k % 3) * 60 :])[: 170 - k % 20]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 2**64, 5, dtype=np.uint64)))))
    ids, second = rng.permutation(1000)[:120], np.arange(120) % 2 == 1
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))

    def roots(pairs):
        root = {int(i): int(i) for i in ids}
        for a, b in pairs:
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        out = {}
        for i in root:
            x = i
            while root[x] != x:
                x = root[x]
            out[i] = x
        return out

    for side in (None, second):
        every = [(int(ids[i]), int(ids[j])) for i in range(120) for j in range(i) if (side is None or side[i] != side[j]) and linked(i, j)]
        found = ngram_join.tile_links(ids, sets, side, 70)
        assert every and len(found) < 120 and {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in every}
        assert roots(found) == roots(every)


def test_substring_dedup(wide, nothing, rows):
    got = {r.doc_id: r for r in substring_dedup.dedup_report(wide).collect()}
    texts = {i: t for i, t, *_ in rows}
    seen = set()
    for i in sorted(x for x in texts if x is not None):
        found = substring_dedup.units(texts[i] or "")
        marked = {k for k, (_, _, u) in enumerate(found) if u in seen or u in {v for _, _, v in found[:k]}}
        seen |= {u for _, _, u in found}
        spans = substring_dedup.removed_spans(found, marked, substring_dedup.MIN_WORDS)
        text = texts[i]
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        assert (got[i].text, [(s.start, s.end) for s in got[i].spans], got[i].n_units) == (text, spans, len(found))
    assert "passage30" in got[10].text and "passage30" not in got[11].text and got[11].text.endswith("then more")
    assert got[None].text == "a row without an id" and len(got[8].text) < 100
    out = substring_dedup.without_repeats(wide)
    assert out.columns == wide.columns
    assert substring_dedup.dedup_report(nothing).count() == 0


def plain_dedup(texts, size=25, line_size=5):
    """Words that are left of each text: repeated passages and lines go, the first occurrence by id and place stays."""
    passages, lines = {}, {}
    cut = {i: [x.lower().split() for x in t.split("\n")] for i, t in texts.items()}
    for i in sorted(cut):
        w, at = sum(cut[i], []), 0
        for k in range(len(w) - size + 1):
            passages.setdefault(tuple(w[k : k + size]), (i, k))
        for x in cut[i]:
            lines.setdefault(tuple(x), (i, at))
            at += len(x)
    out = {}
    for i, t in texts.items():
        w, gone, at = sum(cut[i], []), set(), 0
        for k in range(len(w) - size + 1):
            j, first = passages[tuple(w[k : k + size])]
            if (j, first) != (i, k):
                gone.update(range(max(k, first + size) if j == i else k, k + size))
        for x in cut[i]:
            if len(x) >= line_size and lines[tuple(x)] != (i, at):
                gone.update(range(at, at + len(x)))
            at += len(x)
        out[i] = [x for k, x in enumerate(t.split()) if k not in gone]
    return out


def test_substring_dedup_equals_a_plain_version(spark):
    """Random texts of few words with shared passages, lines and repeats inside."""
    rng = random.Random(21)
    made = lambda n: " ".join(rng.choices(["Ab", "ab", "c", "dd", "E."], k=n))
    passages, lines = [made(rng.randrange(20, 60)) for _ in range(6)], [made(rng.randrange(1, 9)) for _ in range(8)]
    texts = {}
    for i in range(120):
        parts = [rng.choice([rng.choice(passages), rng.choice(lines), made(rng.randrange(1, 30))]) for _ in range(rng.randrange(0, 7))]
        texts[i * 3] = "".join(p + rng.choice([" ", "\n", "\n\n", "  "]) for p in parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text.split() for r in substring_dedup.dedup_report(df).collect()}
    expected = plain_dedup(texts)
    assert got == expected and sum(map(len, expected.values())) < 0.8 * sum(len(t.split()) for t in texts.values())


def test_substring_dedup_short_lines(spark):
    """A short line that repeats goes wherever it stands alone; a trivially short one stays."""
    texts = {1: "own words of one\nRead more on our other pages\nends here", 2: "quite different\nread  more on our other pages\nand its end\nends here"}
    got = {r.doc_id: r for r in substring_dedup.dedup_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].text == texts[1] and got[1].n_removed == 0
    assert got[2].text == "quite different\nand its end\nends here" and got[2].n_removed == 1


@pytest.mark.parametrize("kind", ["latin", "greek", "han"])
def test_substring_dedup_mid_line(spark, kind):
    """Passages of 51 words without capitals and punctuation go whole from the middle of lines, whatever their letters."""
    rng = random.Random(4)
    letters = {"latin": "acdeghijlmnoqrstuvy", "greek": "αβγδεζηθικλμνξοπρτ", "han": "".join(chr(0x4E00 + k) for k in range(900))}[kind]
    join = "" if kind == "han" else " "

    def made(n):
        return join.join("".join(rng.choices(letters, k=1 if kind == "han" else rng.randrange(4, 9))) for _ in range(n))

    texts, expected = {}, {}
    for i in range(0, 40, 2):
        passage = made(51)
        a, b, c, d = (made(10 + k) for k in range(4))
        texts[i], texts[i + 1] = join.join((a, passage, b)), join.join((c, passage, d))
        expected |= {i: texts[i], i + 1: join.join((c, d))}
    got = substring_dedup.dedup_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == expected


def test_substring_units_agree():
    """Strings and arrays cut the same words around any character."""
    texts = [f"x{chr(c)}Y{chr(c)}\nz" for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    for _, _, u in substring_dedup._runs(pa.array(texts), 2):
        own, texts = texts[: len(u.lines)], texts[len(u.lines) :]
        for t, n_words, n_passages, n_lines in zip(own, np.diff(u.begins).tolist(), u.passages.tolist(), u.lines.tolist(), strict=True):
            found = substring_dedup.units(t, 2)
            lines = sum(x.endswith("\n") for _, _, x in found)
            assert (len(substring_dedup.WORD.findall(t)), len(found) - lines, lines) == (n_words, n_passages, n_lines), ascii(t)
    assert not texts


def test_substring_dedup_overlap(spark):
    """A repeat that overlaps the kept occurrence leaves that whole."""
    got = {r.doc_id: r.text.split() for r in substring_dedup.dedup_report(spark.createDataFrame([(1, "a b " * 50), (2, "x " + "a b " * 20 + "y")], "doc_id long, text string")).collect()}
    assert got == {1: ["a", "b"] * 12 + ["a"], 2: ["x", "y"]}
    found = substring_dedup.units("a b " * 50)
    assert substring_dedup.removed_spans(found, set(range(2, 76)), 25) == [(50, 200)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(wide, nothing, rows, order):
    import zlib

    got = ngram_lm.train_and_score(wide, order=order).collect()
    assert len(got) == len(rows)
    docs = {i: [*words(t), None] for i, t, *_ in rows}
    train = [docs[i] for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {order: Counter()}
    for d in train:
        p = ["<s>"] * (order - 1) + d
        counts[order].update(tuple(p[k : k + order]) for k in range(len(d)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    plain = Counter(w for d in train for w in d)
    total, v = sum(plain.values()), len(plain)

    def p(context, w):
        value = 1 / (v + 1)
        for k in range(1, order + 1):
            d = ngram_lm.discounts([sum(c == t for c in counts[k].values()) for t in (1, 2, 3, 4)])
            own = {g[-1]: c for g, c in counts[k].items() if g[:-1] == (tuple(context[-(k - 1) :]) if k > 1 else ())}
            if own:
                c = own.get(w, 0)
                value = (max(c - d[min(c, 3) - 1], 0) if c else 0) / sum(own.values()) + sum(d[min(x, 3) - 1] for x in own.values()) / sum(own.values()) * value
        return value

    for r in got:
        d = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(d), sum(plain[w] > 0 for w in d), total)
        assert r.base_score == pytest.approx(sum(math.log10((plain[w] + 1) / (total + v + 1)) for w in d))
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if len(d) < 200:
            h = ["<s>"] * (order - 1) + d
            assert r.score == pytest.approx(sum(math.log10(p(h[k : k + order - 1], d[k])) for k in range(len(d))))
    assert ngram_lm.train_and_score(nothing, order=order).count() == 0


def test_registered_model_sees_two_words_of_context(spark, tmp_path):
    from lexweave.llm.queries import op7_lm

    rows = [(i, "a x b" if i % 2 else "c x d") for i in range(40)] + [(100, "a x d"), (101, "a x b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in op7_lm(spark, str(tmp_path)).collect()}
    assert score[101] > score[100] + 0.5


def test_language_model_without_training_rows(docs):
    rows = ngram_lm.train_and_score(docs.where("doc_id IS NULL"), order=2).collect()
    assert [(r.train_tokens, r.score) for r in rows] == [(0, 0.0)]


LABELS = "doc_id long, quality int, toxic int"


def test_classifier(spark, wide, nothing):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        good = i % 4 != 0
        w = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, LABELS)
    model = quality_classifier.fit_classifier(docs, marks)
    assert 0 < len(model.rules) < 60
    got = {r.doc_id: r for r in quality_classifier.score_documents(docs, model).collect()}
    assert all(got[i].predicted == y for i, y, _ in labels) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.held_out for r in got.values()) == sum(__import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in got)
    assert quality_classifier.keep_quality(docs, model).count() == sum(y for _, y, _ in labels)
    odd = quality_classifier.score_documents(wide, model)
    assert odd.count() == wide.count() and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality_classifier.keep_quality(wide, model).columns == wide.columns
    assert quality_classifier.score_documents(nothing, model).count() == 0
    for some in (marks.limit(0), marks.where("quality = 1")):
        flat = quality_classifier.score_documents(docs, quality_classifier.fit_classifier(docs, some))
        assert flat.select("score").distinct().count() == 1
    x = np.array([[float(k)] for k in range(100)])
    fitted = quality_classifier.fit_rules(np.hstack([x] * 11), (x[:, 0] > 40).astype(float), quality_classifier.SHAPE)
    assert ((fitted.score(np.hstack([x] * 11), quality_classifier.SHAPE) > 0.5) == (x[:, 0] > 40)).mean() >= 0.97  # cuts are quantiles


def plain_features(text):
    """The classifier's statistics, one text at a time."""
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars = len(w), sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    values = {
        "size_log": math.log(n + 1), "symbol_ratio": share(sum(c in "#*$%&|<>" for c in text), n), "bang_ratio": share(text.count("!"), n), "bar_ratio": share(text.count("|"), n),
        "upper_ratio": share(sum(unicodedata.category(c) == "Lu" for c in text), chars), "digit_ratio": share(sum(c in "0123456789" for c in text), chars), "mean_word": share(chars, n),
        "distinct_ratio": share(len(set(w)), n), "same_ratio": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n), "dup_line_ratio": share(len(lines) - len(set(lines)), len(lines)), "line_words": share(n, len(lines)),
    }
    return [values[x] for x in quality_classifier.SHAPE]


def test_classifier_equals_a_plain_version(spark, wide, rows):
    """Statistics and compiled rules of odd and random texts against Python."""
    rng = random.Random(31)
    texts = {i: t for i, t, *_ in rows if i is not None}
    for k in range(300):
        texts[1000 + k] = "".join(rng.choices(["a", "B", "é", "É", "word", "word ", " ", "\n", "\t", "#", "!", "|", "7", "漢", "same same "], k=rng.randrange(0, 60)))
    names = quality_classifier.SHAPE
    x = np.array([plain_features(t) for t in texts.values()])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r[0]: list(r[1:]) for r in quality_classifier.with_features(df, "text").select("doc_id", *names).collect()}
    for i, row in zip(texts, x, strict=True):
        assert got[i] == pytest.approx(row), (i, texts[i])
    y = (x[:, names.index("symbol_ratio")] + 0.3 * x[:, names.index("upper_ratio")] > 0.2).astype(float)
    model = quality_classifier.fit_rules(x, y, names)
    assert len(model.rules) > 1
    scored = {r.doc_id: r.score for r in quality_classifier.score_documents(df, model).collect()}
    exact = np.array([got[i] for i in texts])  # cuts lie between values that occur
    assert [scored[i] for i in texts] == pytest.approx(model.score(exact, names).tolist())


def binomial_cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_bound():
    for k, n, level in ((0, 50, 0.05), (3, 50, 0.01), (50, 50, 0.05), (10, 400, 0.001)):
        u = quality_rules.binomial_upper(k, n, level)
        assert u == 1 if k == n else binomial_cdf(k, n, u) == pytest.approx(level, rel=1e-6)


def brute_base(text):
    text = text or ""
    w, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rules(spark, wide, nothing, rows):
    none = spark.createDataFrame([], LABELS)
    got = quality_rules.rule_report(wide, none).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = brute_base(next(t for i, t, *_ in rows if i == r.doc_id))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert (r.base_failed, r.kept) == (failed, not failed)  # no labels, no cutoffs
    assert quality_rules.rule_report(nothing, none).count() == 0
    assert quality_rules.keep_good(wide, none).columns == wide.columns
    assert "Python" not in quality_rules.with_statistics(wide.select("doc_id", "text"), "text")._jdf.queryExecution().toString()


def test_quality_rules_limit_false_rejection(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(5000):
        lang = "en" if i % 10 else "xx"  # a stratum with too few labels certifies nothing
        bad = i % 5 == 0
        w = ["".join(rng.choices("abcdefgh", k=5)) + ("#*" if bad and rng.random() < 0.9 else "") for _ in range(30)]
        rows.append((i, " ".join(w), lang))
        labels += [(i, int(not bad), 0)] * (1 + i % 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.rule_report(docs, spark.createDataFrame(labels, LABELS)).collect()}
    en = [i for i, _, lang in rows if lang == "en"]
    good, bad = [i for i in en if i % 5], [i for i in en if i % 5 == 0]
    assert sum(not got[i].kept for i in good) <= quality_rules.RISK * len(good)
    assert all(not got[i].kept for i in bad)
    assert all(got[i].kept for i, _, lang in rows if lang == "xx")


def test_quality_rules_small_strata(spark):
    """About 300 good labels are enough for rules that reject none of them; fewer than 217 of four strata aren't."""
    rng, rows, labels = random.Random(6), [], []
    for lang, n in (("a", 300), ("b", 300), ("c", 300), ("d", 150)):
        for k in range(n + 20):
            mark = "##" if k >= n else ""
            rows.append((len(rows), " ".join("".join(rng.choices("abcdefgh", k=6)) + mark for _ in range(30)), lang))
            labels.append((rows[-1][0], int(k < n), 0))
    got = quality_rules.rule_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).collect()
    good = {i: q for i, q, _ in labels}
    lang = {i: x for i, _, x in rows}
    assert all(r.kept == (good[r.doc_id] == 1 or lang[r.doc_id] == "d") for r in got)


def test_quality_rules_sequence():
    """The sequence starts with the steps that catch bad documents, and takes every step once."""
    full = [len(c) for c in quality_rules.RULES.values()]
    order = quality_rules.steps({(full[0], 1, *full[2:]): 30, (2, *full[1:]): 6, tuple(full): 5})
    assert order[:5] == ["bang_ratio"] * 2 + ["symbol_ratio"] * 3
    assert Counter(order) == dict(zip(quality_rules.RULES, full, strict=True))
    assert quality_rules.useful(order, {(full[0], 1, *full[2:]): 30, (2, *full[1:]): 6, tuple(full): 5}) == order[:5]
    assert quality_rules.useful(order, {}) == quality_rules.useful(order, {tuple(full): 1}) == []


def test_quality_rules_pool_small_strata():
    assert quality_rules.pooled({"a": 900, "b": 100, "c": 30, None: 5}, 0.02, 0.05) == [["a"], [None, "b", "c"]]
    assert quality_rules.pooled({"a": 900}, 0.02, 0.05) == [["a"]] and quality_rules.pooled({}, 0.02, 0.05) == []
    assert quality_rules.binomial_upper(300, 1000, 0.05, 0.02) == 0.3


def test_pipeline_stages(spark, docs, tmp_path):
    rng = random.Random(8)
    folder = str(tmp_path)
    texts = {}
    for i in range(300):
        texts[i] = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(80)) + "."
    texts[300] = texts[7].replace(" ", "  ")  # a copy
    texts[301] = " ".join(texts[8].split()[:-2])  # a near copy
    passage = "Passage " + " ".join(f"p{k}" for k in range(60)) + "."
    texts[302], texts[303] = texts[9] + "\n" + passage, "Own words first. " + " ".join(f"q{k}" for k in range(90)) + ".\n" + passage
    texts[304] = " ".join(x + "###" for x in texts[10].split())
    bad = {304, *range(400, 480)}
    for i in range(400, 480):
        texts[i] = " ".join("".join(rng.choices("abcdefgh", k=5)) + "###" for _ in range(60))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in texts], LABELS).write.parquet(f"{folder}/labels.parquet")
    current, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = corpus_pipeline.materialize(stage(spark, current, folder), f"test-{name}")
        assert current.columns == columns
        kept[name] = {r.doc_id: r.text for r in current.collect()}
    assert not bad & set(kept["quality_classifier"])
    assert set(kept["quality_classifier"]) - set(kept["near_duplicates"]) >= {300, 301} and 9 in kept["near_duplicates"]
    # each stage against a plain version of it
    model = quality_classifier.fit_classifier(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(np.array([plain_features(t) for t in texts.values()]), quality_classifier.SHAPE)
    assert set(kept["quality_classifier"]) == {i for i, x in zip(texts, scores, strict=True) if x >= 0.3}
    base = {i: brute_base(t) for i, t in kept["quality_classifier"].items()}
    assert set(kept["quality_rules"]) <= {i for i, b in base.items() if b[0] >= 20 and 100 * b[4] <= 30 * b[0]}
    assert set(kept["quality_rules"]) >= {i for i, b in base.items() if b[0] >= 20 and b[2] == b[4] == 0}
    groups = brute_components(kept["quality_rules"], 5, 80)
    assert kept["near_duplicates"] == {i: kept["quality_rules"][i] for i, (_, root) in groups.items() if i == root}
    left = plain_dedup(kept["near_duplicates"])
    assert {i: t.split() for i, t in kept["substring_dedup"].items()} == {i: w for i, w in left.items() if w}
    assert "p30" in kept["substring_dedup"][302] and "p30" not in kept["substring_dedup"][303] and "q30" in kept["substring_dedup"][303]
    pieces = corpus_pipeline.STAGES[-1][1](spark, current, folder)
    library = Tokenizer.from_file(word_vocabulary())
    found = defaultdict(list)
    for r in pieces.collect():
        found[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(found) == set(kept["substring_dedup"])
    for i, t in kept["substring_dedup"].items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, length, crc, total in sorted(found[i]):
            assert (start, crc, total) == (at, zlib.crc32(ids[at : at + length].tobytes()), len(ids))
            at += length
        assert at == len(ids)
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length").collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_stages_on_odd_rows(spark, wide, rows, tmp_path):
    """Null ids, texts and keys, repeats and columns with clashing names go through every stage; columns stay."""
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = {name: stages[name](spark, wide, str(tmp_path)) for name in stages}
    for name, df in got.items():
        assert name == "packing" or df.columns == wide.columns
    ids = lambda name: Counter(r.doc_id for r in got[name].select("doc_id").collect())
    every = Counter(i for i, *_ in rows)
    assert ids("quality_classifier") == every
    texts = {i: t for i, t, *_ in rows}
    passed = {i for i, t in texts.items() if (b := brute_base(t))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
    assert ids("quality_rules") == Counter({i: n for i, n in every.items() if i in passed})
    roots = brute_components({i: t for i, t in texts.items() if i}, 5, 80)
    assert ids("near_duplicates") == Counter({None: every[None]} | {i: 1 for i, (_, root) in roots.items() if i == root})
    assert set(ids("substring_dedup")) == set(texts) - {6}  # 6 is 1 in other cases, so nothing is left of it
    assert set(r.doc_id for r in got["packing"].collect()) == set(texts)


def test_near_duplicates_keep_one_row_of_an_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "b", 3), (1, text, "en", "a", 9), (1, text + " z", "de", "a", 1), (2, text, "fr", "c", 2), (3, None, "en", "x", 0), (3, "", "en", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [rows[1], rows[4]]
