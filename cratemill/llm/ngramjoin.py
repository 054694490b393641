"""Similarity join of documents by the Jaccard index of their word n-grams, with token-combination prefixes.

The tokens of a document are its distinct n-grams, in one order for all documents: the rarest first. Two documents that are similar enough
share most tokens, so they share some among the first of each. Rare tokens are indexed one by one. Frequent tokens are told into classes: of
class k, combinations of k tokens are indexed, which fewer documents share. Who shares no combination of class k shares k - 1 of its
tokens at most, so the prefix is extended by k - 1 tokens for each class; then no similar pair is missed. Candidates are
compared by their whole sets.

What is wanted is which documents are connected, so a group of thousands of near copies is not expanded into all its pairs: candidates are
first compared with one member of each index entry, and only members of entries that are still in several parts with all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, textscan
from .common import KeyFilter
from .textscan import mix

#: The frequency table has 2**LOG2_COUNTERS counters whatever the number of tokens (32 MB for a task, 16 MB for the driver and each worker).
LOG2_COUNTERS = 24
_CHUNK = 1 << 16
#: Tokens of more documents than the first number are indexed in pairs, of more than a second (if given) in threes.
CLASSES = (16,)
#: Frequent tokens of a class are dealt to groups of about so many in a prefix; combinations are made inside groups.
_GROUP = 8
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every word, first word of each row with a closing entry); A-Z lower-cased, words between ASCII white space, null is empty."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))  # no cast here: a cast slice loses its place in ascii_lower
    ends = pieces.offsets.to_numpy()
    words = pieces.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]]
    coded = words.filter(pa.array(full)).dictionary_encode()
    data, ends = textscan.buffers(coded.dictionary)
    raw, ends = data.tobytes(), ends.tolist()
    table = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(ends, ends[1:])), dtype=np.uint64, count=len(ends) - 1)
    return table[coded.indices.to_numpy()], first


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of each row as sorted 64-bit hashes of its runs of `size` words (fewer words: of all of them; none: empty)."""
    texts = texts.cast(pa.string())
    for lo, hi in textscan.row_groups(texts, 1 << 22):
        words, first = word_hashes(texts.slice(lo, hi - lo))
        runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for j in range(size):
            runs *= _MULT[0]
            runs += words[j : len(runs) + j]
        runs = mix(runs)
        for a, b in zip(first, first[1:]):
            if b - a >= size:
                found = np.sort(runs[a : b - size + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            elif b > a:  # a short text's run has a mark of its length
                powers = np.cumprod(np.full(b - a, _MULT[1])) + np.uint64(b - a)
                yield mix((words[a:b] * powers).sum(dtype=np.uint64, keepdims=True))
            else:
                yield words[:0]


def need(n: int, percent: int) -> int:
    """How many tokens a set of n can lack in common with a similar one, plus one: the length of its prefix if all are rare."""
    return n + (-percent * n) // 100 + 1


def least_size(percent: int) -> int:
    """Sets of fewer tokens are similar to equal sets only."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def scheme(n: int, percent: int) -> int:
    """log2 of the number of groups that each class of frequent tokens is dealt to, by the size of the set."""
    return (need(n, percent) // _GROUP).bit_length()


def most_classes(percent: int, wanted: int) -> int:
    """The number of classes at which every set has tokens enough for its prefix: class k costs k - 1 of them for each group."""
    for m in range(wanted, 1, -1):
        cost = m * (m - 1) // 2
        if all(n - min(n, cost << scheme(100 * n // percent, percent)) >= need(n, percent) for n in range(least_size(percent), 4096)) and (100 - percent) * (1 + 2 * cost / _GROUP) < 90:
            return m
    return 1


def rank(counts: np.ndarray, usual: float, classes: tuple[int, ...]) -> np.ndarray:
    """What the table says of tokens by their counters: class (2 bits) and level of frequency (6 bits). usual: what other tokens add to a counter."""
    level = np.minimum(63, np.floor(3 * np.log2(counts + 1.0))).astype(np.uint8)
    kind = np.zeros(len(counts), dtype=np.uint8)
    for limit in classes:
        kind += counts > usual + 4 * usual**0.5 + limit
    return level | (kind << 6)


class Order:
    """Levels and classes of tokens, looked up by the first bits of their hashes."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - (len(table).bit_length() - 1))

    def signatures(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """What the set is indexed under. Sets that are similar and not equal have a signature in common."""
        n = len(tokens)
        if n < least_size(percent):
            return tokens[:0]
        code = self.table[(tokens >> self.shift).astype(np.int64)]
        order = np.argsort(code & 63, kind="stable")  # tokens are sorted, so ties go by hash
        kind, wanted = code[order] >> 6, need(n, percent)
        ordered = tokens[order]
        if not kind[:wanted].any():
            return mix(ordered[:wanted])
        out = []
        # a partner of another size can use another number of groups: index under those of all sizes it can have
        for log2 in range(scheme(-(-percent * n // 100), percent), scheme(100 * n // percent, percent) + 1):
            groups: dict[tuple[int, int], list[int]] = {}
            gained = 0
            for token, k in zip(ordered.tolist(), kind.tolist()):
                group = groups.setdefault((k, (token & ((1 << log2) - 1)) if k else 0), [])
                group.append(token)
                gained += len(group) > k
                if gained == wanted:
                    break
            for (k, _), group in groups.items():
                if k == 0:
                    out.append(mix(np.array(group, dtype=np.uint64)))
                elif len(group) > k:
                    rows = np.array(list(combinations(sorted(group), k + 1)), dtype=np.uint64)
                    out.append(mix((rows * _MULT[: k + 1]).sum(axis=1, dtype=np.uint64) + np.uint64(64 * log2 + k)))
        return np.unique(np.concatenate(out)) if out else tokens[:0]


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


#: Of the signatures of a set that are still open so many of the smallest are looked at, so that a pair is not made again for each one shared.
_FIRST = 8
#: A set's tokens flip bits of a bitmap of so many bits, by their hashes.
_BITS = 1024


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Which bits an odd number of tokens falls on, as longs. Two bitmaps differ in no more bits than their sets differ in tokens."""
    return np.packbits(np.bincount((tokens & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1).view(np.int64)


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and bitmaps of two sides allow that the sets are similar. Sides: prefixes of the columns n and b0, b1, ...

    Similar sets differ in (100 - percent) / (100 + percent) of the sum of their sizes at most.
    """
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}"))) for i in range(_BITS // 64)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def _with_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = pa.array([_short(x) for x in batch.column("key").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([short, *batch.columns], ["k", *batch.schema.names])


def _pack(counts: np.ndarray) -> bytes:
    """A chunk of counters: places and counts of those that are not zero if they are few, else all, compressed."""
    at = np.flatnonzero(counts)
    if len(at) < _CHUNK >> 3:
        return b"s" + at.astype(np.uint16).tobytes() + counts[at].tobytes()
    return b"z" + zlib.compress(counts.tobytes(), 1)


def _add(sums: np.ndarray, packed: bytes) -> None:
    if packed[:1] == b"z":
        sums += np.frombuffer(zlib.decompress(packed[1:]), dtype=np.uint16)
    else:
        at, counts = np.frombuffer(packed[1:], dtype=np.uint16).reshape(2, -1)
        sums[at] += counts


def survey(docs: DataFrame, size: int, classes: tuple[int, ...]) -> tuple[DataFrame, Order]:
    """((doc_id, tag, n, key, bits), order): the size, identity and bitmap of every row's set, and how frequent tokens are, by the first bits of their hashes.

    One pass over the texts. A task sends its counters in chunks of fixed size, once for 65,535 rows; chunks are added up as they come.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counters, chunk, longs = 1 << LOG2_COUNTERS, _CHUNK, pa.list_(pa.int64())
    names = ["doc_id", "tag", "n", "key", "bits", "chunk", "counts"]

    def send(counts: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for i in range(counters // chunk):
            part = counts[i * chunk : (i + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, longs), pa.array([i], pa.int32()), pa.array([_pack(part)], pa.binary())], names)
        counts[:] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, id_type = np.zeros(counters, dtype=np.uint16), 0, None
        for batch in batches:
            sizes, keys, maps, id_type = [], [], [], batch.column(0).type
            for tokens in sets(batch.column(2), size):
                if seen == 65535:
                    yield from send(counts, id_type)
                    seen = 0
                sizes.append(len(tokens))
                keys.append(_key(tokens))
                maps.append(bitmap(tokens))
                counts[(tokens >> np.uint64(64 - LOG2_COUNTERS)).astype(np.int64)] += 1  # one at most for a text, so no counter overflows
                seen += 1
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(maps, longs), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if seen:
            yield from send(counts, id_type)

    rows = common.pick(docs, "doc_id", "text").select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    rows = rows.mapInArrow(run, f"doc_id {kind}, tag long, n int, key binary, bits array<long>, chunk int, counts binary")
    rows = common.materialize(rows, "sets")
    usual = (rows.agg(F.sum("n").cast("double").alias("n")).first()["n"] or 0.0) / counters

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _add(sums.setdefault(i, np.zeros(chunk, dtype=np.int64)), packed)
        for i, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rank(counts, usual, classes).tobytes()], pa.binary())], ["chunk", "codes"])

    table = np.zeros(counters, dtype=np.uint8)
    for r in rows.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, codes binary").toLocalIterator():
        table[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["codes"], dtype=np.uint8)
    return rows.where("chunk is null").select("doc_id", "tag", "n", "key", "bits"), Order(table)


def postings(docs: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """(sig, k, n): signatures of all sets with the first 64 bits of their identity, for signatures that several sets have."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ks, ns, seen = [], [], [], set()
            for tokens in sets(batch.column(0), size):
                found = held.value.signatures(tokens, percent)
                if len(found) and (k := _short(_key(tokens))) not in seen:  # copies are indexed once
                    seen.add(k)
                    sigs.append(found)
                    ks.append(k)
                    ns.append(len(tokens))
            if sigs:
                times = [len(x) for x in sigs]
                yield pa.RecordBatch.from_arrays([textscan.signed(np.concatenate(sigs)), pa.array(np.repeat(np.array(ks, dtype=np.int64), times)), pa.array(np.repeat(np.array(ns, dtype=np.int32), times))], ["sig", "k", "n"])

    rows = common.materialize(common.pick(docs, "text").mapInArrow(run, "sig long, k long, n int"), "signatures")
    held.destroy()  # what it was used for lies in files
    several = rows.groupBy("sig").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select(F.col("sig").alias("shared"))
    several = common.materialize(several, "shared-signatures")
    maybe = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(several, "shared"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe.value.maybe(batch.column(0).to_numpy().view(np.uint64))))

    few = rows.mapInArrow(narrow, rows.schema)
    out = common.materialize(few.join(several, few["sig"] == several["shared"]).select("sig", "k", "n").distinct(), "postings")
    maybe.destroy()
    return out


def members(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, tokens) of the sets in wanted (key, tag): each from a text with that tag, once."""
    maybe = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted, "tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe.value.maybe(batch.column(0).to_numpy().view(np.uint64))))
            found = list(sets(batch.column(1), size))
            if found:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), textscan.signed(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key(x) for x in found], pa.binary()), lists], ["t", "key", "tokens"])

    rows = common.pick(docs, "text").select(common.text_tag(F.col("text")).alias("t"), "text").mapInArrow(run, "t long, key binary, tokens array<long>")
    # copies have one tag; of each task's copies the first moves on
    once = rows.groupBy("key", "t").agg(F.first("tokens").alias("tokens"))
    mine = wanted.select(F.col("key").alias("wk"), "tag")
    out = common.materialize(once.join(mine, (once["key"] == mine["wk"]) & (once["t"] == mine["tag"]), "left_semi").select("key", "tokens"), "members")
    maybe.destroy()
    return out


def verify(pairs: DataFrame, docs: DataFrame, keys: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the identities of the pairs (ka, kb) of sets that are similar; keys: k, key, tag, n, bits of all sets.

    Bitmaps rule out nearly all that are not; the sets of the others are made from their texts and compared. A set with many
    partners is dealt to several tasks.
    """
    pairs = common.materialize(pairs, "pairs")
    side = lambda x: keys.select(F.col("k").alias(f"k{x}_"), F.col("key").alias(x), F.col("n").alias(f"{x}_n"), *(F.get("bits", F.lit(i)).alias(f"{x}_b{i}") for i in range(_BITS // 64)))
    half = graph.split_join(pairs, side("b"), "kb", "kb_", graph.hot_or_none(pairs, "kb"), [F.col("ka")]).drop("kb_")
    both = graph.split_join(half, side("a"), "ka", "ka_", graph.hot_or_none(pairs, "ka"), [F.col("kb")])
    close = common.materialize(both.where(may_be_similar("a_", "b_", percent)).select("a", "b", F.col("a_n").alias("na"), F.col("b_n").alias("nb")), "close-pairs")
    ends = close.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    found = members(docs, common.materialize(keys.join(ends, keys["key"] == ends["end"], "left_semi").select("key", "tag"), "wanted"), size)
    set_of = lambda x: found.select(F.col("key").alias(f"key_{x}"), F.col("tokens").alias(f"t{x}"))
    half = graph.split_join(close, set_of("b"), "b", "key_b", graph.hot_or_none(close, "b", least=200), [F.col("a")])
    both = graph.split_join(half, set_of("a"), "a", "key_a", graph.hot_or_none(close, "a", least=200), [F.col("b")])
    inter = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "na", "nb", inter.alias("i")).where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def open_pairs(left: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """(ka, kb) of all members of one entry of left (sig, k, n, comp) that are in different components and may be similar by size and bitmap.

    A pair that shares one of its first signatures is made under the smallest of those only; few others come more than once.
    """
    bits = keys.select(F.col("k").alias("bk"), *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(_BITS // 64)))
    firsts = left.groupBy(F.col("k").alias("fk")).agg(F.slice(F.array_sort(F.collect_set("sig")), 1, _FIRST).alias("first"))
    left = common.materialize(left.join(bits, left["k"] == bits["bk"]).join(firsts, left["k"] == firsts["fk"]).drop("bk", "fk"), "rest")
    mine, other = left.select(*(F.col(c).alias(f"x_{c}") for c in left.columns)), left.select(*(F.col(c).alias(f"y_{c}") for c in left.columns))
    close = (F.col("x_sig") == F.col("y_sig")) & (F.col("x_k") < F.col("y_k")) & may_be_similar("x_", "y_", percent) & (F.col("x_comp") != F.col("y_comp"))
    close = close & F.coalesce(F.array_min(F.array_intersect("x_first", "y_first")) == F.col("x_sig"), F.lit(True))
    return mine.join(other, close).select(F.col("x_k").alias("ka"), F.col("y_k").alias("kb"))


def link_components(posts: DataFrame, docs: DataFrame, keys: DataFrame, size: int, percent: int, rounds: int = 2) -> DataFrame | None:
    """(node, root) over the identities of all sets that are similar to another.

    A round compares the members of every index entry with one of them, the first by a hash that changes with the round, and joins
    what is similar. Then members of one entry that are still in different components are compared with each other, all of them, by
    their bitmaps first, inside the join. Pairs inside a component could add nothing. None if no two sets share an entry.
    """
    if posts.isEmpty():
        return None
    short, entries = keys.select("key", F.col("k").alias("short")), posts.count()
    links, left = None, posts.withColumn("comp", F.col("k").cast("string"))
    for turn in range(rounds):
        first = F.xxhash64("k", F.lit(turn))
        lead = left.groupBy(F.col("sig").alias("of")).agg(F.min_by("k", first).alias("ka"), F.min_by("comp", first).alias("lead_comp"))
        lead = common.materialize(lead, "leads")
        hot = graph.hot_or_none(left, "sig")
        star = graph.split_join(left, lead, "sig", "of", hot, [F.col("k")]).where("comp <> lead_comp").select("ka", F.col("k").alias("kb")).distinct()
        new = common.materialize(verify(star, docs, keys, size, percent), "links")
        links = new if links is None else links.unionByName(new)
        roots = graph.components(links)
        of_k = roots.join(short, roots["node"] == short["key"]).select(F.col("short").alias("ck"), F.hex("root").alias("root"))
        # an entry that is not open stays so: the next round starts from the open ones. Of two members the round has compared one with the other
        joined = left.drop("comp").join(of_k, left["k"] == of_k["ck"], "left").select("sig", "k", "n", F.coalesce("root", F.col("k").cast("string")).alias("comp"))
        entry = Window.partitionBy("sig")
        open_ = joined.withColumns({"least": F.min("comp").over(entry), "most": F.max("comp").over(entry), "docs": F.count(F.lit(1)).over(entry)}).where("least <> most and docs > 2")
        left = common.materialize(open_.select("sig", "k", "n", "comp"), "open-entries")
        sizes = left.groupBy("sig", "comp").agg(F.count(F.lit(1)).cast("double").alias("s"))
        pairs = sizes.groupBy("sig").agg((F.pow(F.sum("s"), F.lit(2)) - F.sum(F.col("s") * F.col("s"))).alias("twice"))
        pending = (pairs.agg(F.sum("twice").alias("p")).first()["p"] or 0.0) / 2
        if not pending:
            return roots
        if pending <= 100 * entries:
            break
    rest = open_pairs(left, keys, percent).distinct()
    new = common.materialize(verify(rest, docs, keys, size, percent), "links")
    return graph.components(links.unionByName(new))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_shingles (size of its set), component_id (smallest doc_id it can reach).

    Sets are linked if 100 * intersection >= percent * union. Null and empty texts, and texts without words, have an empty set and are linked
    with nothing, not even each other: their component is their own doc_id. Texts of fewer than `size` words are one token. Repeated rows
    give repeated results. A null doc_id is the smallest of a component only if all are null. Other columns are ignored.

    Tokens are compared by 64-bit hashes (XXH64 of words, mixed), sets by 128-bit ones. Result and completeness do not depend on
    classes or on the size of the frequency table: those decide how many candidates are compared. At far more tokens than
    the table has counters it tells only the most frequent ones apart.
    """
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent is 1 to 100, size 1 or more")
    rows, order = survey(docs, size, classes[: most_classes(percent, len(classes) + 1) - 1])
    posts = postings(docs, order, size, percent)
    keys = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("tag").alias("tag"), F.first("bits").alias("bits"))
    keys = common.materialize(keys.mapInArrow(_with_short, f"k long, {', '.join(f'{c} {t}' for c, t in keys.dtypes)}"), "keys")
    linked = link_components(posts, docs, keys, size, percent)
    if linked is None:
        of_key = keys.select(F.col("key").alias("at"), F.col("least").alias("component_id"))
    else:
        rooted = common.materialize(keys.join(linked, keys["key"] == linked["node"], "left").select(F.col("key").alias("at"), "least", F.coalesce("root", "key").alias("root")), "rooted")
        ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
        of_key = graph.split_join(rooted, ids, "root", "r", graph.hot_or_none(rooted, "root"), [F.col("at")]).select("at", "component_id")
    full = graph.split_join(rows.where("n > 0"), of_key, "key", "at", graph.hot_or_none(rows.where("n > 0"), "key"), [F.col("doc_id")])
    own = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(own)
