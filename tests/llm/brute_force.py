"""Plain versions of what the operators compute, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text)
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_classes(texts):
    """{key: (class, links)} of distinct keys, by comparing all that share a shingle."""
    sets = {k: shingles(t or "") for k, t in texts.items()}
    having = {}
    for k, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(k)
    links = {}
    for k, s in sets.items():
        common = Counter(o for x in s for o in having[x] if o != k)
        links[k] = [o for o, n in common.items() if 5 * n >= 4 * (len(s) + len(sets[o]) - n)]
    label = {}
    for k in sorted(sets):
        queue = [] if k in label else [k]
        label.setdefault(k, k)
        while queue:
            for o in links[queue.pop()]:
                if o not in label:
                    label[o] = k
                    queue.append(o)
    return {k: (label[k], len(links[k])) for k in sets}
