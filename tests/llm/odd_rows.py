"""Rows with nulls, empty, blank and very long texts, ties and repeats, and words as the operators see them."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest of old trees by night"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one"),
    (6, "The QUICK brown fox jumps over the lazy dog and runs far away into the deep green forest of old trees by night"),
    (7, LONG),
    (8, LONG + " more"),
    (9, "Über straße ΣΑΣ naïve 漢字 ١٢ don't <|endoftext|> x"),
    (10, "Some start of a text. " + PASSAGE + " And an end."),
    (11, "Other words here and " + PASSAGE + "\nthen more"),
    (12, "same same same same same same same same same same same same same same same same same same same same same"),
    (13, "<b>a & b | c % d # e * f > g $ h</b>\n\nline\nline\nother"),
    (None, "a row without an id"),
]
EXTRA = "id long, _row string, score double, n_words long, digest string, bucket int, root long, place int, kept boolean, _words string, stratum string, size long, slot int, url string, value double"


def words(text):
    return WORD.findall((text or "").translate(LOWER))
