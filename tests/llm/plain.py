"""Brute-force versions, in plain Python, of what the operators compute."""

import collections
import hashlib
import itertools
import re

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m.group())) <= 15),
}
SECRETS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def spans(text, kinds):
    found = []
    for rank, (kind, (pattern, ok)) in enumerate(kinds.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m)]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()


def quality(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    at, covered = {}, set()
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contamination(text, items, window=13):
    words = bench_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        iw = bench_words(item)
        n = min(window, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def maximal_matches(text, items, window=13):
    """(item, start in it, start in the text, words) of matches of a window or more that can't be extended."""
    words, out = bench_words(text or ""), []
    for item_id, item in items:
        iw = bench_words(item or "")
        n = min(window, len(iw))
        for a in range(len(iw)):
            for b in range(len(words)):
                if iw[a] == words[b] and not (a and b and iw[a - 1] == words[b - 1]):
                    k = 0
                    while a + k < len(iw) and b + k < len(words) and iw[a + k] == words[b + k]:
                        k += 1
                    if k >= n:
                        out.append((item_id, a, b, k))
    return out


def longest_match(text, items, window=13):
    """(words, start in the text, item): of equally long ones the first, then of the least id."""
    best = min(((-n, b, str(k)) for k, _, b, n in maximal_matches(text, items, window)), default=(0, None, None))
    return -best[0], best[1], best[2]


def shingle_counts(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    out = {}
    for i in range(len(words) - n + 1 if n else 0):
        g = tuple(words[i : i + n])
        out[g] = out.get(g, 0) + 1
    return out


def probability_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b))


def near_links(docs, threshold=0.8):
    """Pairs of ids whose plain or probability Jaccard reaches the threshold, of all pairs that share a shingle."""
    sets = {i: shingle_counts(t) for i, t in docs.items()}
    holders = {}
    for i in sorted(docs):
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    common = collections.Counter()
    for ids in holders.values():
        common.update(itertools.combinations(ids, 2))
    out = []
    for (a, b), n in common.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        even = max(sets[a].values()) == 1 == max(sets[b].values())
        if j >= threshold or (not even and j > 0.3 and probability_jaccard(sets[a], sets[b]) >= threshold):
            out.append((a, b))
    return out


def near_groups(docs, threshold=0.8):
    """{doc_id: least doc_id of its group}."""
    up = {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near_links(docs, threshold):
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}
