"""SimHash near-duplicate groups: fingerprints, pigeonring candidate chains, exact Hamming links, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components
from panelwright.llm.runtime import checkpoint, map_arrow, slices, texts

SEED, WORDS = 42, 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: The ring: 16 segments of 4 bits. Two fingerprints within 2 bits have a chain of 16 segments,
#: from some start on, whose cumulative differences keep to 2/16 a segment: none in the first 7,
#: one at most in the first 15, two in all.
SEGMENTS, BITS, MOST = 16, 4, 2
CLEAN = (SEGMENTS - 1) // MOST  # segments that the proportional budget allows no difference
KEY_BITS = CLEAN * BITS
#: Buckets above this many fingerprints are linked through masked values, whose number is the same for each row.
PAIRED = 128


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's 3-word shingles, repeats included; 0 for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    count = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_intdigest
    if count == 1:
        return digest(b" ".join(words), SEED)
    hashes = np.fromiter((digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(count)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, 4096):  # bounded, however long the text
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        prints = np.fromiter(map(fingerprint, texts(part.column("text"))), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, print)``: each row's fingerprint as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _fingerprints, f"doc_id {dict(rows.dtypes)['doc_id']}, print long")


def _turned(start: int) -> Column:
    """The fingerprint rotated so that segment ``start`` stands first."""
    return F.col("print") if not start else F.shiftleft("print", BITS * start).bitwiseOR(F.shiftrightunsigned("print", 64 - BITS * start))


def _masks() -> list[int]:
    """Pairs of bits behind the clean segments that may differ within the budgets, as masks to clear.

    One of the 8 segments that follow and one of the last, or two of the last: every pair of
    fingerprints that keeps the chain from this start agrees outside one of these masks.
    """
    last = range(BITS)
    between = range(BITS, 64 - KEY_BITS)
    return [(1 << i) | (1 << j) for i in between for j in last] + [(1 << i) | (1 << j) for i in last for j in last if i < j]


def hamming_links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints within 2 bits: all their components, no false link.

    ``prints`` has distinct longs ``print``. Each fingerprint goes to 16 buckets, one for each
    start of a chain, keyed by the 7 segments that must be equal (28 bits). In a bucket of up to
    ``PAIRED`` members, pairs are pruned by the chain's further budgets and then checked in full.
    A larger bucket isn't paired: each member is filed under its value with each mask cleared
    (134 values), and all members of such a file are within 2 bits of each other, so linking
    them to the smallest loses no component. Work stays linear in a bucket's size.
    """
    chains = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("start"), _turned(i).alias("ring")) for i in range(SEGMENTS)]))
    filed = prints.select("print", chains.alias("c")).select("print", "c.start", F.shiftrightunsigned("c.ring", 64 - KEY_BITS).alias("key"), F.col("c.ring").bitwiseAND(F.lit((1 << (64 - KEY_BITS)) - 1)).alias("rest"))
    held = filed.groupBy("start", "key").agg(F.count("*").alias("held")).where("held > 1")
    filed = checkpoint(filed.join(held, ["start", "key"]))

    a = filed.where(F.col("held") <= PAIRED).select("start", "key", F.col("print").alias("u"), F.col("rest").alias("ru"))
    b = filed.where(F.col("held") <= PAIRED).select("start", "key", F.col("print").alias("v"), F.col("rest").alias("rv"))
    differing = F.col("ru").bitwiseXOR(F.col("rv"))
    chain_kept = (F.bit_count(F.shiftrightunsigned(differing, BITS)) <= 1) & (F.bit_count(differing) <= MOST)
    pairs = a.join(b, ["start", "key"]).where((F.col("u") < F.col("v")) & chain_kept).select("u", "v")

    masks = F.posexplode(F.array(*[F.lit(~m).cast("long") for m in _masks()])).alias("mask", "keep")
    masked = filed.where(F.col("held") > PAIRED).select("print", "start", "key", "rest", masks).select("print", "start", "key", "mask", F.col("rest").bitwiseAND(F.col("keep")).alias("value"))
    files = ["start", "key", "mask", "value"]
    least = masked.groupBy(*files).agg(F.min("print").alias("u"), F.max("print").alias("most")).where("u < most").drop("most")
    starred = masked.join(least, files).where("u < print").select("u", F.col("print").alias("v"))
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per input row.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are 3 words (a shorter
    text is one shingle). Rows of one fingerprint are one class; classes within 2 differing bits
    link; ``component_id`` is the smallest doc_id that links reach. Only distinct fingerprints are
    compared, so exact copies cost nothing beyond their own row.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id is a row of
    its class but never names a component; a class of null ids alone has a null component. Repeated
    rows come out repeated; an empty table gives an empty one. Long texts are read whole, their
    shingles counted in bounded parts. Other columns are ignored.
    """
    rows = checkpoint(fingerprints(docs, doc_id, text))
    classes = checkpoint(rows.groupBy("print").agg(F.min("doc_id").alias("first")))
    linked = connected_components(hamming_links(classes.select("print")))
    parts = linked.select(F.col("node").alias("print"), F.col("component"))
    named = classes.join(parts, "print").groupBy("component").agg(F.min("first").alias("least"))
    named = parts.join(named, "component").select("print", "least")
    # Written, so that the join below deals plain rows and adaptive execution can split a fingerprint with very many.
    ids = checkpoint(classes.join(named, "print", "left").select("print", F.coalesce("least", "first").alias("component_id")))
    return rows.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


#: Keys up to which the rows to drop are broadcast (16 bytes each for long ids).
BROADCAST_ROWS = 1_000_000


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    A row is told by its id and its text: where an id repeats, the rows with other texts are judged
    by themselves. Among equal ids the text's hash decides; a null id comes after all others; of
    rows that repeat both id and text one stays. Null and empty texts are alike and form one group.
    Long texts are read whole. An empty table gives an empty one; other columns pass through,
    whatever their names.
    """
    hashed = F.xxhash64(F.col(text))
    keys = docs.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), hashed.alias("hash")).alias("doc_id"), F.col(text).alias("text"))
    found = checkpoint(near_duplicates(keys).select("doc_id", "component_id"))

    def matching(rows: DataFrame, keyed: DataFrame, n: int, how: str) -> DataFrame:
        side = (F.broadcast(keyed) if n <= BROADCAST_ROWS else keyed).select(F.col("doc_id.id").alias("_id"), F.col("doc_id.hash").alias("_text"))
        return rows.join(side, rows[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(rows[text]) == F.col("_text")), how)

    held = checkpoint(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("component_id").alias("first")))
    drop, again = held.where("doc_id <> first"), held.where("doc_id = first and rows > 1")
    n_drop, n_again = held.agg(F.count_if(F.expr("doc_id <> first")), F.count_if(F.expr("doc_id = first and rows > 1"))).first()
    kept = matching(docs, drop, n_drop, "left_anti")
    if not n_again:
        return kept
    once = matching(kept, again, n_again, "left_semi").dropDuplicates([doc_id, text])
    return matching(kept, again, n_again, "left_anti").unionByName(once)
