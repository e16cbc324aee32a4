"""SimHash near-duplicates with a generalised pigeonhole search.

A fingerprint has a bit for each of the 64 bits of the shingles' hashes, 1 where over
half of the hashes have it.  Equal fingerprints are one node.  Two fingerprints with at
most ``limit`` differing bits differ, for any split of the bits into parts and any limits
of the parts with ``sum(limit_i + 1) = limit + 1``, by at most ``limit_i`` in some part i
(a part with limit -1 is not probed).  So each fingerprint is filed under its value of
each probed part and looked up under all values within that part's limit; what is found is
verified on all 64 bits.  The search is complete for every split; the split only
decides its cost:

* bits whose values go together are put into one part, from the correlations of all
  fingerprints, so that the parts differ from each other;
* the limits come from a dynamic programme over the parts that minimises lookups plus
  estimated candidates, from the number of fingerprints and their bits' frequencies.

Defined results: a null text counts as empty; texts without a word have fingerprint 0;
a null doc_id takes no part in the choice of a component's smallest id, so a component
of null ids has id null; repeated rows stay; texts of any length are read whole; columns of other
names are ignored; an empty table gives an empty result.  ``similar_documents`` states its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, cut, fresh, map_arrow, spread_join
from .components import connected_components

BITS = 64
SHINGLE = 3
LIMIT = 3
SEED = 42
#: A lookup is a row to shuffle and sort; a candidate is a comparison in passing.
LOOKUP_COST = 8.0


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the lower-cased text, as a signed 64-bit number."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes
    if not words:
        return 0
    runs = [b" ".join(w) for w in zip(*(words[i:] for i in range(shingle)), strict=False)] if len(words) > shingle else [b" ".join(words)]
    votes, step = np.zeros(BITS, np.int64), 1 << 16
    for k in range(0, len(runs), step):  # in pieces: a text may be very long
        part = runs[k : k + step]
        hashes = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in part), np.uint64, len(part))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(runs), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (long)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "fingerprint")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            out = [fingerprint((x.as_py() or "").encode(), shingle) for x in values]
            rest = batch.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.int64())], names=[*rest.schema.names, "fingerprint"])

    return map_arrow(docs, work, T.StructType([*kept, T.StructField("fingerprint", T.LongType())]))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many of them have both bits, for each two bits.

    Each task sends 64 rows of 64 counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(values), 1 << 16):
                bits = np.unpackbits(values[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BITS), BITS), pa.int64()), pa.array(np.tile(np.arange(BITS), BITS), pa.int64()), pa.array(both.ravel().astype(np.int64), pa.int64()), pa.array(np.full(BITS * BITS, n), pa.int64())], names=["i", "j", "both", "n"])

    rows = map_arrow(prints.select("fingerprint"), work, "i long, j long, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    counts = np.zeros((BITS, BITS))
    for r in rows:
        counts[r["i"], r["j"]] = r["both"]
    return (rows[0]["n"] if rows else 0), counts


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of equal size; each part starts with a free bit and takes in turn the
    free bit with the largest sum of correlations to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [min(free, key=lambda b: (-max(related[b][c] for c in free if c != b) if len(free) > 1 else 0, b))]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (related[b][group].sum(), -b)))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """The cheapest split found: parts of bits with their limits, those with limit -1 left out."""
    ones = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for parts in range(1, limit + 2):
        groups = group_bits(n, both, parts)
        costs = [_part_costs(n, ones[g], limit) for g in groups]
        # spent -> cheapest, over the parts so far; a limit of t spends t + 1
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (so_far, limits) in states.items():
                for t in range(-1, limit - spent + 1):
                    total = so_far + (cost[t] if t >= 0 else 0.0)
                    if total < after.get(spent + t + 1, (math.inf,))[0]:
                        after[spent + t + 1] = (total, (*limits, t))
            states = after
        total, limits = states[limit + 1]
        if total < best[0]:
            best = total, [(g, t) for g, t in zip(groups, limits, strict=True) if t >= 0]
    return best[1]


def _part_costs(n: int, ones: np.ndarray, limit: int) -> list[float]:
    """By the limit: lookups of all fingerprints, and pairs expected within it if bits were independent."""
    differ = np.zeros(limit + 1)
    differ[0] = 1.0
    for p in 2 * ones * (1 - ones):
        differ = differ * (1 - p) + np.concatenate(([0.0], differ[:-1])) * p
    near = np.cumsum(differ)
    n = max(n, 1)
    return [LOOKUP_COST * n * (1 + sum(math.comb(len(ones), k) for k in range(t + 1))) + n * (n - 1) / 2 * near[t] for t in range(limit + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _at(part: int, key: Column) -> Callable[[Column], Column]:
    return lambda flip: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(flip).alias("key"))


def near_links(prints: DataFrame, limit: int = LIMIT, node: str = "fingerprint", carried: tuple[str, ...] = (), also: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Links (a, b), a < b, of all pairs of nodes whose fingerprints have at most ``limit`` differing bits.

    ``node`` names the column of the nodes' ids, one row each.  ``also`` is a further condition on the
    ``carried`` columns of both ends, as structs.  A pair is found in the first part that is near enough,
    and so once."""
    rows = prints.select("fingerprint", F.col(node).alias("_node"), F.struct(*carried, F.lit(0).alias("_none")).alias("_with"))
    n, both = bit_statistics(rows)
    filed, looked_up, first = [], [], F.lit(True)
    differing = F.col("_fa").bitwiseXOR(F.col("_fb"))
    for k, (bits, t) in enumerate(allocate(n, both, limit)):
        mask = _signed(sum(1 << b for b in bits))
        flips = [_signed(sum(1 << b for b in c)) for size in range(t + 1) for c in itertools.combinations(bits, size)]
        key = F.col("fingerprint").bitwiseAND(F.lit(mask))
        filed.append(F.struct(F.lit(k).alias("part"), key.alias("key")))
        looked_up.append(F.transform(F.array(*map(F.lit, flips)).cast("array<long>"), _at(k, key)))
        first = first & ((F.col("part") <= k) | (F.bit_count(differing.bitwiseAND(F.lit(mask))) > t))
    files = rows.select(F.col("_node").alias("b"), F.col("fingerprint").alias("_fb"), F.col("_with").alias("_wb"), F.explode(F.array(*filed)).alias("x")).select("b", "_fb", "_wb", "x.part", "x.key")
    lookups = rows.select(F.col("_node").alias("a"), F.col("fingerprint").alias("_fa"), F.col("_with").alias("_wa"), F.explode(F.concat(*looked_up)).alias("x")).select("a", "_fa", "_wa", F.col("x.part").alias("_part"), F.col("x.key").alias("_key"))
    near = (F.bit_count(differing) <= limit) & first
    if also is not None:
        near = near & also(F.col("_wa"), F.col("_wb"))
    found = lookups.join(files, (F.col("part") == F.col("_part")) & (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint as long, component_id) of every row; component_id is the smallest
    doc_id that can be reached over links."""
    prints = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("_rows")))
    roots = cut(connected_components(near_links(nodes.select("fingerprint"), limit)))
    linked = nodes.join(roots, nodes["fingerprint"] == roots["node"]).select("root", "least")
    least = linked.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("_least"))
    of_root = roots.join(least, roots["root"] == least["_root"]).select("node", "_least")
    named = nodes.join(of_root, nodes["fingerprint"] == of_root["node"], "left").select(F.col("fingerprint").alias("_print"), F.coalesce("_least", "least").alias("component_id"), "_rows")
    return spread_join(prints, named, "fingerprint", "_print", "_rows").select("doc_id", "fingerprint", "component_id")


# -- near copies by the similarity of their texts

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: The order of shingles in ``prefix_rows`` comes from about so many texts; at most so many shingles that
#: are in three of them or more count as common.  Both decide the cost only: every order finds all pairs.
ORDER_SAMPLE = 10_000
COMMON = 100_000
#: Sequences a task remembers to pass on equal texts once.
SEEN = 100_000
MAP = 8  # longs of a bitmap
MAPS = tuple(f"map{i}" for i in range(MAP))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _sequence(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def shingle_set(known: np.ndarray, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, in order, from the hashes of the words."""
    size = min(shingle, len(known))
    found = np.full(max(1, len(known) - shingle + 1), size, np.uint64)
    for i in range(size):
        found = found * _ODD + known[i : i + len(found)]
    found ^= found >> np.uint64(32)
    found *= _ODD
    return np.unique((found ^ found >> np.uint64(29)).view(np.int64))


def word_print(known: np.ndarray) -> int:
    """The fingerprint of the set of words, which changes less with a few edits than that of shingles."""
    if not len(known):
        return 0
    found = np.unique(known)
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(found), bitorder="little").view(np.int64)[0])


def bitmap(found: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes, whether a set has an odd number of them: two sets differ in at
    least as many members as their bitmaps in bits."""
    return np.packbits(np.bincount(found & (64 * MAP - 1), minlength=64 * MAP).astype(np.uint8) & 1).view(np.int64)


def wide_bitmap(found: np.ndarray) -> np.ndarray | None:
    """The same with at least two classes for each member, of sets too large for ``bitmap`` to tell apart."""
    if len(found) <= 64 * MAP:
        return None
    bits = 1 << (2 * len(found) - 1).bit_length()
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def bits_apart(x: Column, y: Column) -> Column:
    """Differing bits of two wide bitmaps, the wider one (twice as wide at most) folded to the classes of the other."""

    def folded(a: Column, b: Column) -> Column:
        half = (F.size(a) / 2).cast("int")
        both = F.zip_with(F.slice(a, F.lit(1), F.greatest(half, F.lit(1))), F.slice(a, half + 1, F.greatest(half, F.lit(1))), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > F.size(b), both).otherwise(a)

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)


def may_be_similar(least: float) -> Callable[[Column, Column], Column]:
    """Whether two nodes' sizes and bitmaps leave room for a similarity of ``least``; true for all that have it.

    Sets of m and n members with that similarity differ in at most ``(1 - least) / (1 + least) * (m + n)``."""

    def also(a: Column, b: Column) -> Column:
        differ = sum((F.bit_count(a[c].bitwiseXOR(b[c])) for c in MAPS), F.lit(0))
        longest, shortest = F.greatest(a["n"], b["n"]), F.least(a["n"], b["n"])
        return (shortest >= longest * F.lit(least) - 1e-6) & (differ * F.lit(1 + least) <= (a["n"] + b["n"]) * F.lit(1 - least) + 1e-6)

    return also


def with_word_prints(docs: DataFrame, text: str = "text", shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """``docs`` without the text, with ``sequence`` (the hash of its words in order), ``fingerprint`` (of the
    set of words), ``n`` (different shingles), the bitmap of the shingles and, of large sets, the wide one."""
    made = ("sequence", "fingerprint", "n", *MAPS)
    kept = [f for f in docs.schema.fields if f.name not in (text, *made, "wide")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wides = np.zeros((batch.num_rows, len(made)), np.int64), []
            for i, x in enumerate(batch.column(batch.schema.get_field_index(text))):
                words = _words(x.as_py())
                known = _hashes(words)
                found = shingle_set(known, shingle)
                rows[i, :3] = _sequence(words), word_print(known), len(found)
                rows[i, 3:] = bitmap(found)
                wides.append(wide_bitmap(found))
            rest = batch.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(rows[:, i]) for i in range(len(made))), pa.array(wides, pa.list_(pa.int64()))], names=[*rest.schema.names, *made, "wide"])

    return map_arrow(docs, work, T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in made), T.StructField("wide", T.ArrayType(T.LongType()))]))


def with_sequence(docs: DataFrame, text: str = "text", name: str = "_sequence") -> DataFrame:
    """``docs`` with the hash of the text's words in order, as ``with_word_prints`` makes it."""
    words = F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")
    return docs.withColumn(name, F.xxhash64(F.regexp_replace(words, "^ | $", "")))


def within_bounds(pairs: DataFrame, nodes: DataFrame, wides: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave room for a similarity of ``least``.

    ``nodes``: sequence and about (n and the bitmap); ``wides``: sequence, n and wide of large sets."""
    x, y = (nodes.select(F.col("sequence").alias(f"_s{e}"), F.col("about").alias(f"_m{e}")) for e in "ab")
    pairs = pairs.join(x, F.col("a") == F.col("_sa")).join(y, F.col("b") == F.col("_sb")).where(may_be_similar(least)(F.col("_ma"), F.col("_mb"))).select("a", "b")
    x, y = (wides.select(F.col("sequence").alias(f"_s{e}"), F.col("n").alias(f"n{e}"), F.col("wide").alias(f"w{e}")) for e in "ab")
    both = pairs.join(x, F.col("a") == F.col("_sa"), "left").join(y, F.col("b") == F.col("_sb"), "left")
    room = bits_apart(F.col("wa"), F.col("wb")) * F.lit(1 + least) <= (F.col("na") + F.col("nb")) * F.lit(1 - least) + 1e-6
    return both.where(F.col("wa").isNull() | F.col("wb").isNull() | room).select("a", "b")


def similar_enough(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """The pairs (a, b) of sequences whose texts have a Jaccard similarity of ``least`` or more.

    ``texts``: text, of which only those of the pairs are shuffled; each is hashed once and meets its pairs
    as its set of shingles."""
    needed = cut(pairs.select(F.col("a").alias("_needed")).unionByName(pairs.select(F.col("b").alias("_needed"))).distinct())
    known = attach(with_sequence(texts.select("text")), needed, F.col("_sequence") == F.col("_needed"), "inner").select("_sequence", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sets, size = [], [], 0
            for s, x in zip(batch.column(0), batch.column(1), strict=True):
                if (sequence := s.as_py()) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sequence)
                    ids.append(sequence)
                    sets.append(shingle_set(_hashes(_words(x.as_py())), shingle))
                    size += len(sets[-1])
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sequence", "members"])
                    ids, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sequence", "members"])

    sets = map_arrow(known, hashed, "sequence long, members array<long>").groupBy("sequence").agg(F.first("members").alias("members"))
    left = sets.select(F.col("sequence").alias("_sa"), F.col("members").alias("ma"))
    right = sets.select(F.col("sequence").alias("_sb"), F.col("members").alias("mb"))
    both = pairs.join(left, F.col("a") == F.col("_sa")).join(right, F.col("b") == F.col("_sb"))
    common = F.size(F.array_intersect("ma", "mb"))
    return both.where(common * F.lit(1 + least) >= (F.size("ma") + F.size("mb")) * F.lit(least) - 1e-9).select("a", "b")


def common_shingles(texts: DataFrame, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of the texts, in order, and the place of each by its frequency."""
    every = max(1, texts.count() // ORDER_SAMPLE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(_hashes(_words(x.as_py())), shingle) for x in batch.column(0)]
            found, n = np.unique(np.concatenate(sets or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["shingle", "n"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")
    rows = map_arrow(sample, work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    found = rows.column("shingle").to_numpy()
    order = np.argsort(found)
    return found[order], len(found) - order  # the most frequent one comes last


def prefix_rows(texts: DataFrame, least: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(shingle, sequence, n, place): the first ``n - least * n + 1`` shingles of every text's set of n.

    Sets of m and n shingles with a similarity of ``least`` share ``least * max(m, n)``, so whatever the
    order of the shingles, they share one of these; rare ones are put first.  A task gives out equal texts once."""
    common, places = common_shingles(texts, shingle)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for x in batch.column(0):
                words = _words(x.as_py())
                sequence = _sequence(words)
                if sequence in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sequence)
                found = shingle_set(_hashes(words), shingle)
                place = np.zeros(len(found), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    place = np.where(common[at] == found, places[at], 0)
                n = len(found)
                first = found[np.lexsort((found, place))][: n - math.ceil(least * n - 1e-6) + 1]
                columns = [pa.array(first), pa.array(np.full(len(first), sequence)), pa.array(np.full(len(first), n, np.int32)), pa.array(np.arange(len(first), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "sequence", "n", "place"])

    return map_arrow(texts.select("text"), work, "shingle long, sequence long, n int, place int")


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, least: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, sequence, component_id, component_sequence) of every row: the groups of all texts with a
    similarity of ``least`` or more on their sets of word shingles; component_id and component_sequence
    are those of the group's row with the smallest id, null ids last.

    Texts with equal words are one node.  No pair is lost, and no group is spelled out as pairs:

    1. The pigeonhole search finds the word fingerprints within ``limit`` bits of each other; texts of one
       fingerprint, in the order of their sizes, are compared each with the next.
    2. Texts that share a shingle of their prefixes (``prefix_rows``), once in the order of their sizes and once
       in that of a hash, are compared each with the next.  What is similar so far makes groups.
    3. What similar texts are not in one group by then share a shingle of their prefixes with a third: all
       pairs of different groups that do are candidates.  Of the largest group at a shingle only pairs with
       others are made.

    Candidates whose sizes or bitmaps rule the similarity out go, all others are compared exactly.

    Null texts count as empty; empty texts are one node; very long texts are read whole; repeated rows
    stay; null ids take no part in the choice of the smallest id; columns of other names are ignored; an
    empty table gives an empty result."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    similar = may_be_similar(least)
    rows = cut(with_word_prints(texts, "text", shingle))
    made = ["fingerprint", "n", *MAPS]  # equal for equal sequences
    nodes = cut(rows.groupBy("sequence").agg(F.min("doc_id").alias("least"), F.count("*").alias("_rows"), *[F.min(c).alias(c) for c in made]))
    wides = cut(rows.where("wide is not null").groupBy("sequence").agg(F.min("n").alias("n"), F.first("wide").alias("wide")))
    ends = nodes.select("sequence", "fingerprint", F.struct("n", *MAPS).alias("about"))

    def verified(pairs: DataFrame) -> DataFrame:
        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        return similar_enough(cut(within_bounds(once, ends, wides, least)), texts, least, shingle)

    # 1. by fingerprint
    by_print = Window.partitionBy("fingerprint").orderBy("about.n", "sequence")
    chained = ends.withColumns({"_b": F.lag("sequence").over(by_print), "_about": F.lag("about").over(by_print)}).where("_b is not null")
    equal = chained.where(similar(F.col("about"), F.col("_about"))).select(F.col("sequence").alias("a"), F.col("_b").alias("b"))
    heads = cut(nodes.groupBy("fingerprint").agg(F.min(F.struct("sequence", "n", *MAPS)).alias("h")).select("fingerprint", "h.*"))
    pairs = equal.unionByName(near_links(heads, limit, "sequence", ("n", *MAPS), similar))

    # 2. along shared shingles
    same = Window.partitionBy("shingle")
    several = prefix_rows(texts, least, shingle).withColumn("_least", F.min("sequence").over(same)).withColumn("_most", F.max("sequence").over(same)).where("_least <> _most")
    several = cut(several.select("shingle", "sequence", "n", "place").distinct())

    def room(na: str, pa_: str, nb: str, pb: str) -> Column:
        """Sizes are near, and from the first shared shingle on enough is left of both sets."""
        near = F.least(na, nb) >= F.greatest(na, nb) * F.lit(least) - 1e-6
        return near & (F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) >= (F.col(na) + F.col(nb)) * F.lit(least / (1 + least)) - 1e-6)

    for order in ("n", F.xxhash64("sequence")):
        by_order = Window.partitionBy("shingle").orderBy(order, "sequence")
        before = {f"_{c}": F.lag(c).over(by_order) for c in ("sequence", "n", "place")}
        next_to = several.withColumns(before).where(room("n", "place", "_n", "_place"))
        pairs = pairs.unionByName(next_to.select(F.col("sequence").alias("a"), F.col("_sequence").alias("b")))
    links = cut(verified(pairs))
    roots = cut(connected_components(links))

    # 3. the rest
    of = roots.where("node <> root")
    members = cut(attach(several, of, several["sequence"] == of["node"]).select(*several.columns, F.coalesce("root", "sequence").alias("group")))
    mixed = members.groupBy("shingle", "group").agg(F.count("*").alias("size")).groupBy(F.col("shingle").alias("_shingle")).agg(F.max(F.struct("size", "group")).alias("_largest"), F.count("*").alias("_groups"), F.sum("size").alias("_total")).where("_groups > 1 and _total > 2")
    maps = ends.select(F.col("sequence").alias("_of"), "about")
    rest = members.join(mixed, F.col("shingle") == F.col("_shingle")).join(maps, F.col("sequence") == F.col("_of"))
    rest = cut(rest.select("shingle", "sequence", "n", "place", "group", "about", (F.col("group") == F.col("_largest.group")).alias("large")))
    left = rest.where("not large").select(F.col("shingle").alias("_xa"), F.col("sequence").alias("a"), F.col("n").alias("_na"), F.col("place").alias("_pa"), F.col("group").alias("_ga"), F.col("about").alias("_ma"))
    right = rest.select(F.col("shingle").alias("_xb"), F.col("sequence").alias("b"), F.col("n").alias("_nb"), F.col("place").alias("_pb"), F.col("group").alias("_gb"), F.col("about").alias("_mb"), "large")
    once = F.col("large") | (F.col("a") < F.col("b"))
    pairs = left.join(right, (F.col("_xa") == F.col("_xb")) & (F.col("_ga") != F.col("_gb")) & once & room("_na", "_pa", "_nb", "_pb") & similar(F.col("_ma"), F.col("_mb")))
    found = cut(verified(pairs.select("a", "b")))
    if not found.isEmpty():
        roots = cut(connected_components(cut(links.unionByName(found))))

    grouped = nodes.join(roots, nodes["sequence"] == roots["node"], "left").select("sequence", "least", "_rows", F.coalesce("root", "sequence").alias("group"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sequence")).alias("_first")
    of_group = grouped.groupBy(F.col("group").alias("_group")).agg(first)
    named = grouped.join(of_group, F.col("group") == F.col("_group")).select(F.col("sequence").alias("_sequence"), F.col("_first.least").alias("component_id"), F.col("_first.sequence").alias("component_sequence"), "_rows")
    return spread_join(rows.select("doc_id", "sequence"), named, "sequence", "_sequence", "_rows").select("doc_id", "sequence", "component_id", "component_sequence")


def keep_one(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id, null ids last, and of equal ids one text.

    ``groups``: the rows of ``similar_documents``.  A row is known by its id and the words of its text, so
    rows without an id and different texts of one id go only with their own group; of rows with equal
    ids and words the one that comes first as JSON stays.  Only those of rows to go or to be thinned
    meet the texts in a join.  Columns of any name may be there."""
    name, of, of_id, rows_of, kept = fresh(docs.columns, "_sequence", "_of", "_id", "_rows", "_kept")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sequence") == F.col("component_sequence"))
    ids = groups.groupBy(F.col("doc_id").alias(of_id), F.col("sequence").alias(of)).agg(F.count("*").alias(rows_of), F.max(first).alias(kept))
    changes = cut(ids.where(~F.col(kept) | (F.col(rows_of) > 1)))
    rows = with_sequence(docs, text, name)
    known = attach(rows, changes, (rows[name] == changes[of]) & rows[doc_id].eqNullSafe(changes[of_id])).where(F.col(kept).isNull() | F.col(kept))
    once = known.where(F.col(rows_of).isNull()).select(docs.columns)
    if changes.where(F.col(kept)).isEmpty():
        return once
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    thinned = known.where(F.col(rows_of) > 1).groupBy(F.col(f"`{doc_id}`").alias(of_id), F.col(name).alias(of)).agg(F.min_by(whole, F.to_json(whole)).alias(kept))
    return once.unionByName(thinned.select(f"{kept}.*"))
