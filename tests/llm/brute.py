"""Plain Python versions and small tables for the tests."""

from __future__ import annotations

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAME_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str | None, width: int, word: re.Pattern = SPACE_WORD) -> set[tuple[str, ...]]:
    w = word.findall((text or "").translate(LOWER))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def groups(texts: dict[int, str | None], width: int) -> dict[int, int]:
    """Smallest id reachable by links of similarity 0.8 and more."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    label = {k: k for k in texts}

    def find(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {k: find(k) for k in ids}


def prose(rng: random.Random, n: int) -> list[str]:
    parts = ["ba", "Ko", "ri", "tu", "né", "ß", "lo", "mi", "da", "xe"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edited(rng: random.Random, words: list[str], rate: float) -> list[str]:
    return [rng.choice(prose(rng, 1)) if rng.random() < rate else w for w in words]


EDGES: list[str | None] = [
    None, "", " ", "\n", "\n\n \t\n", "a", "Ab cd", "one two three four five", "ü" * 50, "x" * 200_000, "é b c", "A\x00B c",
    "same line here\nsame line here\nSAME LINE HERE  ", "😀 😀 smile\r\nnext",
]


def edge_documents() -> list[tuple]:
    """Nulls in all columns, empty, long and repeated texts, repeated rows and ids."""
    rows = [(i, t, "en", "src%d" % (i % 3), len(t or "")) for i, t in enumerate(EDGES)]
    rows += [(None, "no id here at all today", None, None, None), (None, None, None, None, None), (100, "very long " * 30_000, "en", None, 1)]
    rows += [rows[6], rows[7], (6, "another text of the same id", "de", "src0", 5)]
    return rows
