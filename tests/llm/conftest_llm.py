"""Fixture rows that all operators must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def make_docs():
    """Nulls, empty and blank texts, ties, repeated texts, near copies, shared passages, one very long text."""
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "naïve", "x" * 300, "東京", "a b"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = text(120), text(70)
    near = base.split()
    near[5] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "one two three"), (7, base), (8, base), (9, " ".join(near)), (10, base.upper()), (11, text(30) + "\n" + passage + " " + text(20)), (12, text(10) + "\x0b" + passage), (13, passage + "\r\n" + text(5)), (14, text(5000)), (15, "same same same same same " * 30), (16, "same same same same same " * 30), (17, "line a b c\n" * 60), (18, text(49)), (19, text(50)), (-3, base), (2**60, passage)]
    return [(i, t, "en", "src", None, "clash", 1, "x") for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, n int, key string"


