"""Plain single-machine versions of the operators, for comparison on small inputs."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def base_spans(text):
    t = text or ""
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 6 and m[1].isascii():
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]], x[2]))


def base_sha(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


def fingerprint(text):
    w = WORD.findall(low(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(points):
    """points: list of (id, fingerprint); the smallest id that each reaches over links of 3 bits at most."""
    n = len(points)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (points[i][1] ^ points[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(points):
        r = find(i)
        if k is not None:
            best[r] = min(best.get(r, k), k)
    return [best.get(find(i)) for i in range(n)]


def phrase_places(text, phrases):
    w = ALNUM.findall(low(text))
    out = []
    for label, phrase in phrases:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def sentences(text):
    """(words) of each sentence, as lists of lower-cased words."""
    out = []
    for part in re.split("[.!?\n。！？｡।॥؟۔…։።။។]", text or ""):
        w = ALNUM.findall(low(part))
        if w:
            out.append(w)
    return out


def later_runs(docs, run):
    """{doc_id: starts of runs that are not the first}; docs in doc_id order."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        s = sentences(text)
        for i in range(len(s) - run + 1):
            key = tuple(tuple(x) for x in s[i : i + run])
            if key in seen:
                out.setdefault(doc_id, set()).add(i)
            else:
                seen.add(key)
    return out


def tiling(doc, item, k):
    """Words of the item covered by greedy string tiling, word by word."""
    d, t = ALNUM.findall(low(doc)), ALNUM.findall(low(item))
    k = min(k, len(t))
    md, mt = [False] * len(d), [False] * len(t)
    covered = 0
    while True:
        best = None
        for i in range(len(t)):
            for j in range(len(d)):
                n = 0
                while i + n < len(t) and j + n < len(d) and t[i + n] == d[j + n] and not mt[i + n] and not md[j + n]:
                    n += 1
                if n >= k and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return covered / len(t) if t else 0.0
        n, i, j = -best[0], best[1], best[2]
        covered += n
        for x in range(n):
            mt[i + x] = md[j + x] = True


def alergia(strings, alpha):
    """State merging said plainly: a state is a set of prefixes of the sample. Returns a function: symbols -> log-likelihood."""
    reach = Counter(tuple(s[:n]) for s in strings for n in range(len(s) + 1))
    end = Counter(map(tuple, strings))
    block = {p: {p} for p in reach}  # prefix -> the state it belongs to

    def count(q, c=None):
        return sum(end[p] for p in q) if c is None else sum(reach[(*p, c)] for p in q)

    def following(q):
        return sorted({p[-1] for p in reach if p and p[:-1] in q})

    def after(q, c):
        return next(block[(*p, c)] for p in q if (*p, c) in reach)

    def close(a, b):
        n, m = (sum(reach[p] for p in q) for q in (a, b))
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (n**-0.5 + m**-0.5)
        if any(abs(count(a, c) / n - count(b, c) / m) > bound for c in [None, *following(a), *following(b)]):
            return False
        return all(close(after(a, c), after(b, c)) for c in set(following(a)) & set(following(b)) if after(a, c) is not after(b, c))

    def merge(a, b):
        shared = set(following(a)) & set(following(b))
        below = [tuple(next((*p, c) for p in q if (*p, c) in reach) for q in (a, b)) for c in shared]
        a |= b
        for p in b:
            block[p] = a
        for x, y in below:
            if block[x] is not block[y]:
                merge(block[x], block[y])

    red = [(block[()], ())]
    while True:
        kept = [id(q) for q, _ in red]
        blue = [(len(path) + 1, (*path, c), after(q, c)) for q, path in red for c in following(q) if id(after(q, c)) not in kept]
        if not blue:
            break
        _, path, b = min(blue, key=lambda x: x[:2])
        for q, _ in red:
            if close(q, b):
                merge(q, b)
                break
        else:
            red.append((b, path))

    def score(word, text, sizes, alphabet):
        q, total = block[()], 0.0
        for c, char in zip([*word, None], [*text, None]):
            seen = following(q)
            if c and c not in seen:
                c = "=" + char
            n = sum(reach[p] for p in q) + len(seen) + 2
            if c is None:
                return total + math.log((count(q) + 1) / n)
            if c in seen:
                total += math.log((count(q, c) + 1) / n / sizes.get(c, 1))
            else:
                total += math.log(1 / n / alphabet)
                c = min(seen, key=lambda s: (-count(q, s), s)) if seen else None
            q = after(q, c) if c else q

    return len(red), score


TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def importance(docs, good, bucket, size):
    """{doc_id: log-importance} of docs (doc_id, text): one count per n-gram, model by model. bucket: n-gram (tuple) -> number."""

    def features(text):
        t = TOKENS.findall(text or "")
        return [bucket((x,)) for x in t] + [bucket(x) for x in zip(t, t[1:])]

    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(features(text))
        if i in good:
            target.update(features(text))
    n, m = sum(raw.values()), sum(target.values())

    def ratio(b):
        p = (raw[b] + 1) / (n + size)
        return math.log((target[b] / m + p) / 2 / p) if m else 0.0

    return {i: sum(map(ratio, features(text))) for i, text in docs}


def notice_share(text, notice, k, gap):
    """The best share of a notice's words on neighbouring diagonals of equal word k-grams, and the bands that reach any share."""
    w, t = ALNUM.findall(low(text)), ALNUM.findall(low(notice))
    on = {}
    for i in range(len(t) - k + 1):
        for j in range(len(w) - k + 1):
            if w[j : j + k] == t[i : i + k]:
                on.setdefault(j - i, set()).update(range(i, i + k))
    best, band, last = 0.0, set(), None
    for d in sorted(on):
        band = band | on[d] if last is not None and d - last <= gap else set(on[d])
        last = d
        best = max(best, len(band) / len(t))
    return best


def removed_words(docs, run, passage, slack):
    """{doc_id: word places that must go, word places that may go}: from repeated runs of sentences, and from repeated passages."""
    seen, must = set(), {}
    words = {i: [w for s in sentences(t) for w in s] for i, t in docs}
    for i, text in sorted(docs):
        s = sentences(text)
        first = [0]
        for x in s:
            first.append(first[-1] + len(x))
        for n in range(len(s) - run + 1):
            key = tuple(tuple(x) for x in s[n : n + run])
            if key in seen:
                must.setdefault(i, set()).update(range(first[n], first[n + run]))
            else:
                seen.add(key)
    seen, inner, may = set(), {}, {}
    for i in sorted(words):
        for n in range(len(words[i]) - passage + 1):
            key = tuple(words[i][n : n + passage])
            if key in seen:  # all but the ends of such a passage go
                inner.setdefault(i, set()).update(range(n + slack - 1, n + passage - slack + 1))
            seen.add(key)
    seen = set()
    for i in sorted(words):
        k = passage - slack + 1
        for n in range(len(words[i]) - k + 1):
            key = tuple(words[i][n : n + k])
            if key in seen:
                may.setdefault(i, set()).update(range(n, n + k))
            seen.add(key)
    return must, inner, may
