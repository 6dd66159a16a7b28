"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int, vocabulary: int = 12, longest: int = 120) -> list[tuple]:
    """(doc_id, text) rows with shared passages, copies, odd spaces, empty and null texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["é", "日本", "x-y"]
    passages = [[r.choice(vocab) for _ in range(r.randrange(15, 60))] for _ in range(5)]
    rows: list[tuple] = []
    for i in range(n):
        words: list[str] = []
        while len(words) < r.randrange(0, longest):
            words += r.choice(passages) if r.random() < 0.4 else [f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 25))]
        text = "".join(w + r.choice([" ", "  ", "\n", "\t ", "\x0b"]) for w in words)
        if rows and r.random() < 0.15:
            text = r.choice(rows)[1]
        rows.append((i * 3 + r.randrange(3), text))
    return [*rows, (10**9, None), (10**9 + 1, ""), (10**9 + 2, "  \n ")]


def substring(rows: list[tuple], size: int) -> dict:
    """doc_id: (words, removed words, kept text)."""
    seen: set[tuple] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out[doc] = len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)
    return out


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_duplicates(rows: list[tuple], size: int, percent: int = 80) -> dict:
    """doc_id: (set size, smallest linked id)."""
    sets = {d: shingles(t, size) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = components(list(sets), links)
    return {d: (len(s), roots[d]) for d, s in sets.items()}


def components(nodes: list, links: list[tuple]) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality_counts(text: str | None) -> tuple:
    """Words, their characters, symbols, repeated lines, words in repeated 3-word windows."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)
