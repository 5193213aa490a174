"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows, one scan of each text.

Edge cases: null and blank texts have no words and no hits; an item without words has no window; items with equal
windows are all reported; repeated documents keep their rows; repeated items count once; extra columns are ignored; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes

WINDOW = 10
#: Bytes of item text in one automaton. A larger benchmark takes more scans, each with an automaton of its own.
MAX_AUTOMATON_BYTES = 64 << 20
#: Lower-cases A-Z and turns every ASCII byte that isn't 0-9 or a-z into a space; other bytes stay.
NORMAL = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


class Automaton:
    """Finds windows of item words in a text's words, in one pass over the words.

    Words are numbered; one that no item has is 0, which leads back to the root. Built from (item_id, text) rows.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.items: list[object] = []
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in normalised(text)]
            if not w:
                continue
            self.items.append(item)
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                owners.setdefault(tuple(w[i : i + size]), set()).add(len(self.items) - 1)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.machine.add_word(key, (len(key), tuple(who)))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint, ascending ranges [first, last) of hit words, and the indexes of items found."""
        if self.empty or not words:
            return [], set()
        get = self.number.get
        ranges: list[tuple[int, int]] = []
        found: set[int] = set()
        for end, (size, who) in self.machine.iter(tuple([get(w, 0) for w in words])):
            found.update(who)
            ranges.append((end + 1 - size, end + 1))
        return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The character ranges [from, to) of the text that the word ranges came from."""
    raw = text.encode("utf-8", "replace").translate(NORMAL)
    at = [m.span() for m in WORD.finditer(raw)]
    place, last, chars = {}, 0, 0
    for b in sorted({x for a, z in ranges for x in (at[a][0], at[z - 1][1])}):
        chars += sum(1 for c in raw[last:b] if c & 0xC0 != 0x80)
        place[b], last = chars, b
    return [(place[at[a][0]], place[at[z - 1][1]]) for a, z in ranges]


def item_shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = MAX_AUTOMATON_BYTES) -> list[list[tuple[object, str | None]]]:
    """The benchmark's items, in lists whose text is bounded by `most` bytes each, read one list at a time by id's hash."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // most
    return [[tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)).orderBy(F.col("item_id").cast("string")).collect()] for k in range(n)]


SPANS = "array<struct<first:int,last:int,char_first:int,char_last:int>>"


def scan_documents(docs: DataFrame, items: list[tuple[object, str | None]], window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (doc_id, unless given) with n_words, spans (word and character ranges hit) and item_ids."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    keep = [doc_id] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(shared.value, window)
        for whole in batches:
            for b in by_bytes(whole, 0):
                counts, spans, ids = [], [], []
                for t in b.column(0).to_pylist():
                    w = normalised(t)
                    ranges, found = machine.scan(w)
                    counts.append(len(w))
                    chars = original_offsets(t, ranges) if ranges else []
                    spans.append([{"first": a, "last": z, "char_first": x, "char_last": y} for (a, z), (x, y) in zip(ranges, chars)])
                    ids.append(sorted({str(machine.items[i]) for i in found}))
                span = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "char_first", "char_last")]))
                more = [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], names=[*(f"c{i}" for i in range(len(keep))), "n_words", "spans", "item_ids"])

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    out = out.mapInArrow(run, f"{kinds}, n_words bigint, spans {SPANS}, item_ids array<string>")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans, item_ids (sorted as strings) for each document.

    One automaton scans all texts in a narrow stage. Only a benchmark beyond MAX_AUTOMATON_BYTES takes several scans,
    whose hits are put together per row.
    """
    shards = item_shards(benchmark)
    if len(shards) == 1:
        out = scan_documents(docs, shards[0], window, doc_id, text)
    else:
        rows = docs.select(F.col(doc_id), F.col(text), F.xxhash64(text).alias("_row"))
        out = None
        for items in shards:
            hits = scan_documents(rows, items, window, doc_id, text, keep=[doc_id, "_row"]).dropDuplicates([doc_id, "_row"])
            out = hits if out is None else out.union(hits)
        parts = out.groupBy(doc_id, "_row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        # null ids are ids like any other, as in one scan
        parts = parts.withColumnsRenamed({doc_id: "_id", "_row": "_of"})
        out = rows.select(doc_id, "_row").join(parts, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of"))).drop("_id", "_row", "_of").withColumn("spans", _merge("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["last"] - s["first"]))
    return out.withColumnRenamed(doc_id, "doc_id").select("doc_id", "n_words", hit.alias("n_hit"), "spans", "item_ids")


def _merge(spans: str):
    """Sorted spans with those that overlap or touch made one."""
    none = F.array().cast(SPANS)
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], s["last"]).alias("last"), last(acc)["char_first"].alias("char_first"), F.greatest(last(acc)["char_last"], s["char_last"]).alias("char_last"))),
    )
    return F.aggregate(spans, none, lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= s["first"]), grown(acc, s)).otherwise(F.concat(acc, F.array(s))))


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
