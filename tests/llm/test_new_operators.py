"""Filter audit, n-gram join and source divergence: brute force, awkward rows, hot groups, packing and ranks."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cratemill.llm import divergence, filteraudit, graph, ngramjoin, queries

from . import brute

DOCS = "doc_id long, text string, lang string, source string"
AWKWARD = [
    (1, None, None, None), (2, "", "en", ""), (None, "alpha beta gamma delta", "en", "a"), (3, "x", None, "a"), (3, "x", "", "a"), (4, "x", "en", None), (5, "é" * 40 + " ünder", "de", "b"),
    (6, "Word & " * 30000, "en", "a"), (7, "\x0b\x0c \t\r\n", "en", "a"), (8, "a.b,c;d!e?f:g\nh", "xx", "solo"), (None, None, None, None), (None, "alpha beta gamma delta", "en", "a"), (9, "ABCDEFGH ABCDEFGHI ABCDEFGHIJKLMNOP ABCDEFGHIJKLMNOPQ", "en", "b"),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """Further columns with names that the operators use inside."""
    names = ("part", "digest", "bits", "good", "n", "docs", "term", "key", "k", "sig", "comp", "total")
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"{DOCS}, " + ", ".join(f"{n} int" for n in names))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# --- 11: filter audit


def plain_audit(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], int(q == 1)), max(marks[i][1], int(t == 1))]
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = brute.WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[lang or ""].append(({x for x in fails if fails[x]}, marks[i] if i is not None else [0, 0]))
    out = []
    for part, rows in parts.items():
        total = Counter()
        lines = []
        for order in permutations("ABCDE"):
            gone = [False] * len(rows)
            for step, x in enumerate(order, 1):
                here = [n for n, (f, _) in enumerate(rows) if x in f and not gone[n]]
                redundant = sum(x in f and gone[n] for n, (f, _) in enumerate(rows))
                for n in here:
                    gone[n] = True
                total[x] += len(here)
                lines.append((part, "".join(order), step, len(rows) - sum(gone), len(here), redundant, sum(f == {x} for f, _ in rows), sum(rows[n][1][0] for n in here), sum(rows[n][1][1] for n in here), x))
        out += [(*line[:-1], total[line[-1]]) for line in lines]
    return sorted(map(str, out))


def test_filter_audit_matches_plain(spark):
    rng = random.Random(3)
    texts = ["short one", "Many Capitals HERE", " ".join(f"w{i}" for i in range(250)), "same " * 300, "50% off & more", "same " * 300 + "# X"]
    docs = [(i, rng.choice(texts) + rng.choice(["", "", " tail", " $"]), rng.choice(["en", "de", None, ""]), "s") for i in range(150)] + AWKWARD
    labels = [(rng.choice([*range(160), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    got = filteraudit.audit(clashing(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert rows_of(got) == plain_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    labels = frame(spark, [], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(frame(spark, []), labels).count() == 0
    one = filteraudit.audit(frame(spark, [(1, None, None, None)]), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["unique_fails"] for r in one} == {0, 1}


def test_intervals_cover_every_order_once():
    for k in (1, 2, 3, 4, 5):
        orders = list(permutations(range(k)))
        assert [filteraudit.lehmer_rank(p, k) for p in orders] == list(range(len(orders)))
        falls = defaultdict(list)
        for mask, step, a, b in filteraudit.intervals(k):
            assert a < b
            for rank in range(a, b):
                falls[mask, rank].append(step)
        for mask in range(1, 1 << k):
            for rank, order in enumerate(orders):
                assert falls[mask, rank] == [next(s for s, x in enumerate(order, 1) if mask >> x & 1)]


def test_filter_audit_with_other_filters(spark):
    """Filters are a parameter; the last letter always stands for repeated texts."""
    docs = [(1, "a", "en", "s"), (2, "a", "en", "s"), (3, "bb", "en", "s")]
    got = filteraudit.audit(frame(spark, docs), frame(spark, [(2, 1, 0)], "doc_id long, quality int, toxic int"), lambda t: {"A": F.length(t) < 2}).collect()
    assert {(r["filter_order"], r["step"]): (r["removed"], r["redundant"], r["good_lost"]) for r in got} == {("AB", 1): (2, 0, 1), ("AB", 2): (0, 1, 0), ("BA", 1): (1, 0, 1), ("BA", 2): (1, 1, 0)}
    with pytest.raises(ValueError):
        filteraudit.audit(frame(spark, docs), frame(spark, [], "doc_id long, quality int, toxic int"), lambda t: {x: F.length(t) < 2 for x in "ABCDEFGH"})


# --- 12: n-gram join


def plain_join(docs, size, percent):
    def tokens(t):
        w = brute.WORD.findall(brute.low(t))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    found = [tokens(t) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        a, b = found[i], found[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for n, (i, *_) in enumerate(docs):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(str((docs[n][0], len(s), least.get(find(n)) if s else docs[n][0])) for n, s in enumerate(found))


@pytest.fixture(scope="module")
def similar():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 2, 5, 11, 30, 60, 200]))] for _ in range(30)]
    docs = []
    for i in range(260):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, "  \t".join(t) if i % 3 else "\x0b" + " ".join(t).upper() + "\n", "en", "s"))
    return docs + AWKWARD


@pytest.mark.parametrize(("percent", "classes"), [(90, (1, 4)), (70, (0, 1)), (50, ()), (100, (1,))])
def test_ngram_join_matches_plain(spark, similar, percent, classes):
    got = ngramjoin.near_duplicates(clashing(spark, similar), percent=percent, classes=classes)
    assert rows_of(got) == plain_join(similar, 3, percent)


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.near_duplicates(frame(spark, [])).count() == 0
    assert rows_of(ngramjoin.near_duplicates(frame(spark, [(1, None, "", ""), (2, "", "", "")]))) == ["(1, 0, 1)", "(2, 0, 2)"]


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """Near copies that are all different: they are joined without all their pairs, and chains are followed to their ends."""
    rng = random.Random(4)
    text = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(300):
        t = list(text)
        t[rng.randrange(120)] = f"own{i}"
        docs.append((i, " ".join(t)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):  # each is near the one before only
        chain = chain[2:] + [f"c{100 + 2 * i}", f"c{101 + 2 * i}"]
        docs.append((1000 + i, " ".join(chain)))
    compared = []
    real = ngramjoin.verify
    monkeypatch.setattr(ngramjoin, "verify", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_duplicates(frame(spark, docs, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[1000 + i] for i in range(40)} == {1000}
    assert sum(compared) < 300 * 299 / 2 / 4


def test_ngram_join_makes_an_open_pair_once(spark):
    """Members that share many signatures are a pair under one of them; members that share any are no less a pair."""
    rng = random.Random(6)
    of = {k: set(range(40)) for k in range(3)} | {k: set(rng.sample(range(100, 160), 20)) for k in range(10, 20)}
    left = spark.createDataFrame([(s, k, 100, str(k)) for k, sigs in of.items() for s in sigs], "sig long, k long, n int, comp string")
    keys = spark.createDataFrame([(k, [0] * 16) for k in of], "k long, bits array<long>")
    got = [(r["ka"], r["kb"]) for r in ngramjoin.open_pairs(left, keys, 90).collect()]
    assert set(got) == {(a, b) for a in of for b in of if a < b and of[a] & of[b]}
    assert sum(b < 3 for _, b in got) == 3


def test_signatures_are_shared_by_similar_sets():
    """Whatever the classes of tokens are, two similar sets that differ have a signature in common."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        percent = int(rng.choice([50, 80, 90, 95]))
        n_classes = ngramjoin.most_classes(percent, 3)
        order = ngramjoin.Order((rng.integers(0, 5, 1 << 8) | (rng.integers(0, n_classes, 1 << 8) << 6)).astype(np.uint8))
        n = int(rng.choice([9, 10, 11, 20, 40, 95, 400, 1500]))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        lack = int(n * (100 - percent) / percent)
        extra = rng.integers(0, 1 << 63, lack, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cut = int(rng.integers(0, lack + 1))
        a, b = np.unique(np.concatenate([both, extra[:cut]])), np.unique(np.concatenate([both, extra[cut:]]))
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and len(np.union1d(a, b)) > len(np.intersect1d(a, b)):
            assert len(np.intersect1d(order.signatures(a, percent), order.signatures(b, percent)))


def test_counters_come_back_as_sent():
    """Few and many counters of a chunk, small and large counts; classes and levels ascend with counts."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 8191, 8192, 30000, 65536):
        counts = np.zeros(1 << 16, dtype=np.uint16)
        counts[rng.choice(1 << 16, n, replace=False)] = rng.choice([1, 2, 300, 65535, 122], n)
        sums = np.ones(1 << 16, dtype=np.int64)
        ngramjoin._add(sums, ngramjoin._pack(counts))
        assert (sums == counts.astype(np.int64) + 1).all()
    codes = ngramjoin.rank(np.array([0, 1, 10, 30, 100, 5000, 10**9]), 4.0, (16, 1024))
    assert (codes >> 6).tolist() == [0, 0, 0, 1, 1, 2, 2] and sorted(codes & 63) == (codes & 63).tolist()


def test_words_as_contracted():
    texts = pa.array([" A\x0bb\x0c\x0d\nC ", None, "", "Éa Éa", " x y"])
    hashes, first = ngramjoin.word_hashes(texts)
    assert np.diff(first).tolist() == [3, 0, 0, 2, 1] and hashes[3] == hashes[4]


def test_sets_of_many_texts():
    """Texts are taken in groups of rows; each row has its own words, in whatever group it is."""
    rng = random.Random(12)
    rows = [rng.choice([None, "", " ".join(f"É{rng.randint(0, 10**6)}W" for _ in range(rng.randint(1, 9000)))]) for _ in range(500)]
    assert sum(len(t or "") for t in rows) > 1 << 22
    for kind in (pa.string(), pa.large_string()):
        together = list(ngramjoin.sets(pa.array(rows, kind), 3))
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(together, (next(ngramjoin.sets(pa.array([t], pa.string()), 3)) for t in rows), strict=True))
        assert [len(x) for x in together] == [max(0, len((t or "").split()) - 2) or min(1, len((t or "").split())) for t in rows]


def test_components_with_hot_nodes(spark):
    """A star, a chain and a ring; every node and root counts as hot."""
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2001), (2001, 2002), (2000, 2002)]
    got = {r["node"]: r["root"] for r in graph.components(frame(spark, edges, "a long, b long"), parts=50, least=2, few=0).collect()}
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(1000, 1041), 1000), **dict.fromkeys(range(2000, 2003), 2000)}


# --- 13: source divergence


def plain_divergence(docs, least_docs, top):
    count, occurs, groups = defaultdict(Counter), defaultdict(set), set()
    for n, (_, t, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", brute.low(t)):
            count[lang, source][w] += 1
            occurs[lang, w].add(n)
    out = []
    for lang in {x for x, _ in groups}:
        own = [s for x, s in groups if x == lang]
        kept = [w for (x, w), at in occurs.items() if x == lang and len(at) >= least_docs]
        whole = Counter()
        for s in own:
            whole.update({w: count[lang, s][w] for w in kept})

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = {s: shares(count[lang, s]) for s in own}, shares(whole)
        for s in own:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in own if o != s]
            terms = [(q[w] - p[s][w], w.encode()) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block_terms", [128, 3])
def test_divergence_matches_plain(spark, block_terms):
    rng = random.Random(6)
    words = ["a", "bb", "éé", "éa", "Straße", "ABCDEFGH", "abcdefghi", "x" * 16, "x" * 17, "y" * 17, "ñ" * 40, "tionhawhing", "日本語", "日本語日本語日本語"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = []
    for i in range(200):
        source = rng.choice(["s1", "s2", "s3", "é", None, ""])
        own = words[: rng.randint(3, len(words))]
        docs.append((i, rng.choice([" ", "-", "1"]).join(rng.choice(own) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), source))
    docs += AWKWARD
    got = divergence.audit(clashing(spark, docs), least_docs=6, top=4, block_terms=block_terms)
    assert rows_of(got.select("lang", "source", "part", "item", "value", "rank")) == plain_divergence(docs, 6, 4)


def test_divergence_without_terms(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    got = divergence.audit(frame(spark, [(1, None, "en", "a"), (2, "", "en", "b"), (3, "one two", "de", "a")]))
    assert rows_of(got) == ["('en', 'a', 'pair', 'b', 0, 1)", "('en', 'b', 'pair', 'a', 0, 1)"]


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 3000, dtype=np.uint64) << np.uint64(40), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b[::3] = b[0]
    assert divergence.radix_order([a, b]).tolist() == sorted(range(3000), key=lambda i: (a[i], b[i], i))
    assert divergence.radix_order([a[:0]]).tolist() == []


def test_counts_by_length_of_term():
    """Terms of 1 to 40 bytes, at the edges of one word, two words and the byte buckets; rows in order inside a term."""
    rng = random.Random(9)
    rows = [" ".join("é" * (n // 2) + "a" * (n % 2) for n in (rng.randint(1, 40) for _ in range(rng.randint(0, 50)))) for _ in range(60)]
    group = np.sort(np.array([rng.randint(0, 3) for _ in rows]))
    want, docs = Counter(), defaultdict(set)
    for n, t in enumerate(rows):
        for w in t.split():
            want[w, group[n]] += 1
            docs[w, group[n]].add(n)
    got = {}
    for terms, g, n, d in divergence.count_terms(pa.array(rows), group):
        for key in zip(terms.to_pylist(), g, n, d):
            assert (key[0], key[1]) not in got
            got[key[0], key[1]] = (key[2], key[3])
    assert got == {k: (n, len(docs[k])) for k, n in want.items()}


def test_registered_join_matches_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.queries()["op12_ngram_join"](spark, sf)) == plain_join(docs, 3, 90)
