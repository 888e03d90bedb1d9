"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    """rows of (doc_id, text) with unique ids: {doc_id: component_id}."""
    sets = {i: shingles(t) for i, t in rows}
    ids, of = sorted(sets), {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def line_dedup(rows, least=50):
    """rows of (doc_id, text) with unique ids: {doc_id: text} without later runs of `least` words or more, of lines and then of words."""
    return passages(whole_lines(rows, least), least)


def passages(texts, least=50, pieces=8):
    """{doc_id: text} without later windows of `least` words, if these hold `pieces` whole pieces: words up to one that ends a piece."""
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        w, gone = words(t), set()
        ends = [x[-1] in ".,;:!?e" or ord(x[-1]) >= 0x250 or k == len(w) - 1 for k, x in enumerate(w)]
        for a in range(len(w) - least + 1):
            if sum(ends[a : a + least]) - (a > 0 and not ends[a - 1]) >= pieces and first.setdefault(tuple(w[a : a + least]), (i, a)) != (i, a):
                gone |= set(range(a, a + least))
        tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", t)
        out[i] = "".join(x for k, x in enumerate(tokens) if k not in gone) if gone else t
    return out


def whole_lines(rows, least=50):
    """{doc_id: text} without later runs of whole lines of `least` words or more."""
    docs = {i: (t or "").split("\n") for i, t in sorted(rows)}
    full = {i: [(k, x.strip(" \t\n\x0b\f\r"), len(words(x))) for k, x in enumerate(ls) if words(x)] for i, ls in docs.items()}
    first, gone = {}, {i: set() for i in docs}
    for i, ls in full.items():
        for a in range(len(ls)):
            n = 0
            for b in range(a, len(ls)):
                n += ls[b][2]
                if n >= least:
                    key = tuple(x[1] for x in ls[a : b + 1])
                    if first.setdefault(key, (i, a)) != (i, a):
                        gone[i] |= set(range(ls[a][0], ls[b][0] + 1))
                    if n - ls[a][2] >= least:
                        break
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in gone[i]) if gone[i] else "\n".join(ls) for i, ls in docs.items()}


SECRETS = (
    ("assign", re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def secrets(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate(SECRETS):
        out += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def first_fit(lengths, capacity):
    bins, places = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, n in enumerate(bins) if n + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        places.append((i, b, bins[b]))
        bins[b] += lengths[i]
    return [(b, o) for _, b, o in sorted(places)]
