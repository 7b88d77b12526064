"""SimHash fingerprints and their components, by an inverted index on byte positions.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight
positional bytes. A list under one positional byte would hold a 256th of the corpus, so the
index lists fingerprints under every five of the eight positions and their bytes: a pair
that shares six positional bytes meets in six of the 56 lists, one that shares five in a
single one. The hits of a pair are tallied as the union of the positions they prove shared;
pairs whose tally reaches six are retained and verified by their differing bits.

A list with more than longest members is split by further positional bytes, at any size of
the corpus in the same way: under six positions, then seven. A pair that shares six or more
still meets, and one list under seven positions holds at most 256 fingerprints. What shares
just six differs by one bit in each of the other two bytes, so a list under six positions
is split as well by those two bytes with a bit of each left out, into lists of at most four.
No list forms more than a bounded number of pairs for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, shuffled, spread_join
from .storage import materialize
from .textbuf import release, slices

MAX_BITS = 2
LEAST_BYTES = 8 - MAX_BITS


def fingerprint_all(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of each text as uint64: majority of the XXH64 (seed 42) of its word shingles."""
    import xxhash

    one, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: lowers A-Z alone, splits at the six ASCII spaces
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= shingle:
            hashes.append(np.array([one(line, 42)], np.uint64))
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            pairs = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            hashes.append(np.fromiter((one(line[a:b], 42) for a, b in pairs), np.uint64, n - shingle + 1))
        counts[i] = len(hashes[-1])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = counts[full]
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint long, then the columns of carry) of every row; null and word-less texts have fingerprint zero."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    names = ["doc_id", "fingerprint", *carry]
    kinds = ["long", "long", *(own.schema[c].dataType.simpleString() for c in carry)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, at in slices(batch.column(1)):
                raw = data.tobytes()
                prints = fingerprint_all([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], shingle)
                rest = [batch.column(k).slice(lo, hi - lo) for k in range(2, 2 + len(carry))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(prints.view(np.int64)), *rest], names)
        release()

    return own.mapInArrow(batches, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds, strict=True)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bits_of(places: int) -> int:
    """The 64-bit mask of a set of byte positions, given as eight bits."""
    return sum(0xFF << 8 * k for k in range(8) if places >> k & 1)


#: Sets of five, six and seven byte positions, as eight bits each.
PLACES = {n: [sum(1 << k for k in c) for c in combinations(range(8), n)] for n in (5, 6, 7)}


def _under(places: list[int]) -> Column:
    """(places, mask) of each set, as an array of structs."""
    return F.array(*[F.struct(F.lit(p).alias("places"), F.lit(_signed(_bits_of(p))).alias("mask")) for p in places])


def _listed(rows: DataFrame, sets: Column) -> DataFrame:
    """Index entries: fingerprint under each set of positions (places) and the bytes there (list)."""
    out = rows.select("fingerprint", F.explode(sets).alias("x")).select("fingerprint", "x.places", "x.mask")
    return out.select("fingerprint", "places", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("list"))


def _counted(entries: DataFrame) -> DataFrame:
    """Entries of lists with two members or more, with the length of their list."""
    many = entries.groupBy("places", "list").agg(F.count("*").alias("n")).filter("n > 1")
    return shuffled(entries).join(many, ["places", "list"])


def _hits(entries: DataFrame, key: list[str]) -> DataFrame:
    """(u, v, places) of every two members of a list; lists are short."""
    members = F.col("members")
    lists = entries.groupBy(*key, "places").agg(F.collect_set("fingerprint").alias("members")).filter(F.size(members) > 1)
    lists = lists.select("places", F.array_sort(members).alias("members"))
    pairs = F.flatten(F.transform(members, lambda u, i: F.transform(F.slice(members, i + 2, F.greatest(F.size(members) - i - 1, F.lit(0))), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    return lists.select("places", F.explode(pairs).alias("e")).select("e.u", "e.v", "places")


def _longer(places: list[int], wanted: list[int]) -> Column:
    """For each set of positions, the sets of one more, as _under() has them."""
    out = _under(wanted).getItem(0)
    out = F.array(out)
    for p in places:
        out = F.when(F.col("places") == p, _under([w for w in wanted if w & p == p])).otherwise(out)
    return out


def _without_bits() -> Column:
    """For each set of six positions, the 64 masks that leave out a bit of both other bytes."""
    out = F.array(F.lit(0).cast("long"))
    for p in PLACES[6]:
        a, b = (k for k in range(8) if not p >> k & 1)
        masks = [_signed(((1 << 64) - 1) ^ (1 << 8 * a + i) ^ (1 << 8 * b + j)) for i in range(8) for j in range(8)]
        out = F.when(F.col("places") == p, F.array(*[F.lit(m).cast("long") for m in masks])).otherwise(out)
    return out


def links(prints: DataFrame, longest: int = 32) -> DataFrame:
    """(u, v), u < v: every two distinct fingerprints that differ in MAX_BITS bits or fewer."""
    five = _counted(_listed(prints, _under(PLACES[5])))
    hits = _hits(five.filter(F.col("n") <= longest), ["list"])
    hot = materialize(five.filter(F.col("n") > longest).select("fingerprint", "places"), "hot")
    if not hot.isEmpty():
        six = materialize(_counted(_listed_from(hot, _longer(PLACES[5], PLACES[6]))), "split")
        hits = hits.unionByName(_hits(six.filter(F.col("n") <= longest), ["list"]))
        hot = six.filter(F.col("n") > longest)
        hits = hits.unionByName(_hits(_listed_from(hot, _longer(PLACES[6], PLACES[7])), ["list"]))
        parted = hot.select("fingerprint", "places", F.explode(_without_bits()).alias("mask"))
        hits = hits.unionByName(_hits(parted.withColumn("list", F.col("fingerprint").bitwiseAND(F.col("mask"))), ["mask", "list"]))
    tally = hits.groupBy("u", "v").agg(F.bit_or("places").alias("places"))
    return tally.filter((F.bit_count("places") >= LEAST_BYTES) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v")


def _listed_from(rows: DataFrame, sets: Column) -> DataFrame:
    """_listed() for entries of shorter lists; a fingerprint that several of them lead to a list stands there once."""
    out = rows.select("fingerprint", F.explode(sets).alias("x")).select("fingerprint", "x.places", "x.mask").distinct()
    return out.select("fingerprint", "places", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("list"))


def near_duplicates(docs: DataFrame, shingle: int = 3, longest: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (long) and component_id.

    component_id is the smallest doc_id reachable over links of MAX_BITS bits or fewer,
    itself included. Equal fingerprints are one node, so a group of copies of any size costs
    one entry in the index. Null and word-less texts share fingerprint zero and are linked
    like any other. Rows with one id each get a row; an id is its row's own least value;
    null ids never become a component id unless a component has no other. Other columns are
    left out; an empty table gives an empty result.
    """
    return clusters(docs, shingle, longest, id_col, text_col).select("doc_id", "fingerprint", "component_id")


def clusters(docs: DataFrame, shingle: int = 3, longest: int = 32, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """near_duplicates() with root, which names the component, and the columns of carry.

    component_id doesn't name it where ids repeat: rows of one id can be the least of several components.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col, carry), "fingerprints")
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(links(classes, longest))
    rooted = shuffled(classes).join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = shuffled(rooted).join(least, "root").select("fingerprint", "root", "component_id")
    return spread_join(prints, of, "fingerprint", F.xxhash64("doc_id", "fingerprint")).select("doc_id", "fingerprint", "component_id", "root", *[F.col(f"`{c}`") for c in carry])
