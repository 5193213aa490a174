"""SimHash near-duplicates by covering locality-sensitive hashing.

near_duplicates links fingerprints within a radius. The pipeline's near-dedup (near_texts) takes the same masks to let texts
meet, and compares their sets of shingles.

Edge cases: null, empty and blank texts have no words and the fingerprint zero, which links like any other. A text of fewer
words than a shingle is one shingle; repeated rows share a fingerprint and so a component; a null id is never the least of a
component that has others; texts of any length are hashed whole, in blocks; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes, materialise
from mnemos.llm.components import connected_components

BITS, SEED, WORDS, RADIUS = 64, 42, 3, 2
#: A primitive polynomial over GF(2) of each degree, without its leading term.
PRIMITIVE = {1: 0b1, 2: 0b11, 3: 0b011, 4: 0b0011, 5: 0b00101, 6: 0b000011, 7: 0b0000011, 8: 0b00011101, 9: 0b000010001}
#: Hashes whose bits are unpacked at a time: 64 bytes each.
BLOCK = 1 << 16
#: In a bucket of more fingerprints, links come from flipped bits instead of comparisons.
SMALL_BUCKET = 24


def shingle_hashes(text: str | None, n: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only the six separators split
    k = len(w) - n + 1
    h = xxhash.xxh64_intdigest
    if not w or k < 1:
        return np.array([h(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    return np.fromiter((h(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(n)))), dtype=np.uint64, count=k)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = WORDS) -> int:
    return majority(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, n: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 1):
                fp = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words of `bits` bits within the radius agree under at least one.

    Bit i has a nonzero vector m(i) of radius + 1 bits and is in mask v iff <m(i), v> is odd. The vectors of at most
    `radius` differing bits don't span the space, so some v is orthogonal to all of them: its mask leaves all those bits
    out. The vectors are the states of a shift register of full period, so each mask keeps about half of the bits.
    """
    n = 1 << (radius + 1)
    vector = [1]
    while len(vector) < bits:
        x = vector[-1] << 1
        vector.append(x ^ n ^ PRIMITIVE[radius + 1] if x & n else x)
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(src, dst) over distinct fingerprints `fp`, whose components are those of all pairs within the radius, which is 2.

    Each fingerprint goes to one bucket of each table; a pair within the radius meets in one at least. Buckets are first
    counted (a combined count, no rows gathered); those of one are dropped. In small ones every fingerprint is compared
    to each in memory and only true links leave. In larger ones, of whatever size, nothing is compared: see _flipped.
    """
    if radius != 2:
        raise ValueError("links without comparisons are exact for a radius of 2")
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")) for m in masks))).alias("t", "key"))
    # a bucket of up to small_bucket travels as one array; collect_list's partial state is cut by the count beforehand
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    sizes = materialise(sizes, "simhash-buckets")
    pairs = sizes.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    crowded = sizes.where("n > 2").select("t", "key", "n")
    members = keyed.join(crowded, ["t", "key"])
    small = members.where(F.col("n") <= small_bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    near = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= radius)), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    links = pairs.union(small.select(F.inline(near)))
    if crowded.where(F.col("n") > small_bucket).isEmpty():
        return links
    return links.union(_flipped(members.where(F.col("n") > small_bucket), masks, radius))


def _flipped(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links inside large buckets, by meeting points instead of comparisons.

    Two fingerprints of a bucket agree under its mask, so they differ in free bits alone. Within distance 2 they meet in
    a word that is one flip of a free bit from either or none, so each emits those words: 1 + f of them, however large
    the bucket. All that meet in a word are within 2 of each other, so they link to the least.
    """
    free = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.array(*(F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)).cast("bigint") for i in f)) for f in free))
    met = members.select("t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = F.min("fp").over(_by("t", "at"))
    return met.withColumn("least", least).where("fp != least").select(F.col("least").alias("src"), F.col("fp").alias("dst")).distinct()


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def near_duplicates(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of each row.

    Copies share a fingerprint, so a group of any size is one node from here on.
    """
    fps = materialise(fingerprints(docs, n, doc_id, text), "simhash-fp")
    return label_components(fps, radius)


def label_components(fps: DataFrame, radius: int = RADIUS, links: DataFrame | None = None) -> DataFrame:
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    components = connected_components(near_links(nodes.select("fp"), radius) if links is None else links)
    member = nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialise(member.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-known")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes(text, n))
