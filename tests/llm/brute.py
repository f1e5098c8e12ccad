"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def token_ids(path, text, end):
    tok = Tokenizer.from_file(path)
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def targets(sizes, weights=(1, 2, 3), stop=3):
    """sizes: source -> words; the excess above stop times a source goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = float(sum(sizes.values())), {}, set(order)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > stop * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(stop * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def components(texts):
    """doc_id -> smallest doc_id reachable by links of Jaccard similarity >= 0.75."""
    sets = {d: shingles(t) for d, t in texts.items()}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in sets:
        near = set().union(*(by[x] for x in sets[a])) if sets[a] else set()
        for b in near:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}
