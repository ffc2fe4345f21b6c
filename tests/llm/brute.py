"""Plain Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations, pairwise

import xxhash


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def fingerprint(text, size=3):
    words = spaced_words(ascii_lower(text))
    grams = [words[i : i + size] for i in range(len(words) - size + 1)] or [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(" ".join(gram).encode(), 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(grams))


def components(prints: list[int], bits=3) -> list[int]:
    """For each place the first place of its component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


ASSIGN = re.compile(
    r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def base_spans(text):
    """`(start, rank, end, kind)`, sorted."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [
        (m.start(), 1, m.end(), "access")
        for m in re.finditer(r"AKIA[A-Z0-9]+", text)
        if len(m[0]) >= 16
    ]
    found += [
        (m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32
    ]
    return sorted(found)


def piece_score(piece, ratios, alphabet):
    codes = [alphabet.index(c) for c in piece]
    return sum(round(ratios[a * len(alphabet) + b], 5) for a, b in pairwise(codes))


def learned_spans(text, base, ratios, alphabet, threshold, least=10, marks="/_.=-"):
    """Of each run that base spans leave over, the stretches of whole pieces that pass."""
    rest = list(text or "")
    for start, _, end, _ in base:
        rest[start:end] = " " * (end - start)
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", "".join(rest)):
        if len(m[0]) < least:
            continue
        pieces, at = [], m.start()
        for piece in re.split(f"[{marks}]", m[0]):
            pieces.append((at, at + len(piece), piece_score(piece, ratios, alphabet)))
            at += len(piece) + 1
        i = 0
        while i < len(pieces):
            total, best, end, j = 0.0, 0.0, i, i
            while j < len(pieces):
                total += pieces[j][2]
                if total > best:
                    best, end = total, j + 1
                j += 1
                if total <= 0 or total <= best - threshold:
                    break
            if best >= threshold and pieces[end - 1][1] - pieces[i][0] >= least:
                found.append((pieces[i][0], 3, pieces[end - 1][1], "markov"))
            i = j
    return found


def written(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contained(text, item, size=5, share=0.8):
    """`(shared, shingles)` if the item is in the text, else None."""
    words, own = plain_words(text), plain_words(item)
    if not own:
        return None
    size = min(size, len(own))
    grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
    there = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    shared = len(grams & there)
    return (shared, len(grams)) if shared >= share * len(grams) - 1e-9 else None


def majority(values):
    return Counter(values).most_common(1)[0][0]
