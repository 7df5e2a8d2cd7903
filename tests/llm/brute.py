"""Plain versions of the operators, and the rows of small fixtures."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t", "one", "é ü 漢字 😀", "x " * 5, "\n\nalone on a line of six words\n"]


def words(text, lower=False):
    text = text or ""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if lower else text)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared lines and passages, and odd rows."""
    rng = random.Random(seed)
    shared = [sentence(rng, 9) for _ in range(5)]
    passage = sentence(rng, 30)
    out = list(ODD)
    for i in range(n):
        lines = [sentence(rng, rng.randint(5, 14)) for _ in range(rng.randint(1, 7))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if i % 7 == 0:
            lines.append(passage)
        out.append("\n".join(lines))
    for i in range(0, n, 5):
        copy = out[len(ODD) + i].split(" ")
        if i % 2 and len(copy) > 3:
            copy[len(copy) // 2] = "changed"
        out.append(" ".join(copy))
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]


def shingles(text, k, lower=True):
    w = words(text, lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, per_cent):
    sets = {i: shingles(t, k) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}
