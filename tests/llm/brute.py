"""Plain Python versions of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log10

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard(rows):
    """rows: (doc_id, text).  Returns (doc_id, n_shingles, component_id) by row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text, ALNUM)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = words(text, ALNUM)
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                names = windows.get(tuple(w[k:k + m]))
                if names:
                    hit.update(range(k, k + m))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def line_dedup(docs, least=50):
    """docs in order, one per (doc_id, text).  Texts without the words of runs that occurred before."""
    words_of = [SPACED.findall(t or "") for _, t in docs]
    seen, gone = {}, [set() for _ in docs]
    for d, w in enumerate(words_of):
        for i in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[i:i + least]), (d, i)) != (d, i):
                gone[d].update(range(i, i + least))
    out = []
    for (_, t), lost in zip(docs, gone):
        if not lost:
            out.append(t)
            continue
        kept, k = [], 0
        for line in t.split("\n"):
            tokens = re.split(r"([\x20\x09-\x0D]+)", line)          # words and the white space between them, in turn
            n, rest = 0, ""
            for i, x in enumerate(tokens):
                if i % 2 == 0 and x:
                    n += 1
                    if k + n - 1 in lost:
                        tokens[i] = None
                elif i % 2 and i and tokens[i - 1] is None:
                    tokens[i] = None
            if n and all(x is None for x in tokens[::2] if x != ""):
                k += n
                continue
            if tokens[0] == "" and len(tokens) > 2 and tokens[2] is None:
                tokens[1] = None
            last = next((x for x in reversed(range(0, len(tokens), 2)) if tokens[x] != ""), None)
            rest = "".join(x for x in tokens if x)
            if last is not None and tokens[last] is None:
                rest = rest.rstrip(" \t\n\x0b\x0c\r")
            kept.append(rest)
            k += n
        out.append("\n".join(kept))
    return out


def base_scores(docs, held):
    """(n_tokens, n_known, train_tokens, base_score) of each text."""
    count = Counter()
    for (doc_id, text), h in zip(docs, held):
        if not h:
            count.update(words(text) + [0])
    total, kinds = sum(count.values()), len(count)
    out = []
    for _, text in docs:
        t = words(text) + [0]
        out.append((len(t), sum(count[x] > 0 for x in t), total,
                    sum(log10((count[x] + 1) / (total + kinds + 1)) for x in t)))
    return out


def base_secrets(text):
    text = text or ""
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
                        r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(k for _, k, _ in spans)
    listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return n[0], n[1], n[2], listed
