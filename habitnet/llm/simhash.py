"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits meet half way: there is a
value within one bit of one of them and within two bits of the other. Every
fingerprint therefore emits the variants around it, the variants are shuffled,
and fingerprints that meet are linked.

Which variants are needed follows from parity. Fingerprints one or three bits
apart differ in the parity of their bit counts, those two bits apart do not. So
every fingerprint emits itself and its 64 one-bit variants, and those of odd
parity also two-bit variants. Of three differing bits two lie in the same half
of the 64, so the two-bit variants with both bits in one half suffice (992 of
2,016). A value that is reached in two steps links only to one reached in at
most one, which makes every link at most three bits long; it is verified all
the same. Linking all that meet at a value to the least one of those within a
bit of it keeps every connection and needs no pairs. A value can be met by at
most 2,081 different fingerprints, so no group is unbounded, whatever the data.

Most fingerprints have no neighbour, and 560 variants each would be a large
shuffle, so a cheaper exact test goes first: the 64 bits form a ring of five
blocks, and a *view* leaves out two blocks next to each other. Three bits touch
at most three blocks, of which two are the same or neighbours, so some view
sees at most one difference. Fingerprints emit, for each view, what it keeps
and (even parity there) the one-bit variants of that; those whose values nobody
else emits have no neighbour and drop out.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; equal fingerprints are one node, so copies add no links; rows of one
doc_id are all returned; null doc_ids get a component but are never its id
(null if the component has no other); an empty table gives no rows. Texts are read
whole, however long; of ties the least doc_id names the component. Only the two named
columns are read, and ``one_of_each`` keeps the others, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitnet.llm.common import LOWER_ASCII, fresh_name, map_batches, stored, texts_of
from habitnet.operators.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Shingles hashed at a time, so that a very long text needs bounded memory.
SHINGLES_AT_ONCE = 1 << 16
RING_BLOCKS = 5


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes (0 for a text without words)."""
    tokens = text.translate(LOWER_ASCII).encode("utf-8", "surrogatepass").split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(tokens))
    begins, ends = begins[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), SHINGLES_AT_ONCE):
        span = slice(at, at + SHINGLES_AT_ONCE)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[span], ends[span])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(begins)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": values.view(np.int64)}

    return run


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, text_hash, fp)``, the 64 bits as a signed long."""
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return map_batches(own, _fingerprints(shingle), "doc_id long, text_hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[tuple[int, ...]]) -> Column:
    """The XOR masks that flip each of ``bits``, as an array literal."""
    return F.array(*[F.lit(_signed(sum(1 << b for b in some))).cast("long") for some in bits])


def views() -> list[list[int]]:
    """The bits that each view keeps: all but two neighbouring blocks of the ring."""
    block = [b * RING_BLOCKS // 64 for b in range(64)]
    return [[b for b in range(64) if block[b] not in (v, (v + 1) % RING_BLOCKS)] for v in range(RING_BLOCKS)]


def _seen(fp: Column) -> Column:
    """What a fingerprint emits in all views: an array of (view, value)."""
    out = []
    for number, bits in enumerate(views()):
        kept = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        around = F.when(F.bit_count(kept) % 2 == 0, F.concat(F.array(F.lit(0).cast("long")), _flips([(b,) for b in bits])))
        masks = F.coalesce(around, F.array(F.lit(0).cast("long")))
        out.append(_values(number, kept, masks))
    return F.concat(*out)


def _values(view: int, kept: Column, masks: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(view).cast("byte").alias("view"), kept.bitwiseXOR(m).alias("value")))


def _spread(fps: DataFrame) -> DataFrame:
    """Few bytes that make a hundred times as many rows: as many tasks as a shuffle has, not as the bytes suggest."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def with_company(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints that meet another one in some view."""
    emitted = _spread(fps).select("fp", F.explode_outer(_seen(F.col("fp"))).alias("e")).select("fp", "e.view", "e.value")
    shared = emitted.groupBy("view", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    shared = stored(shared.select("view", "value"), "simhash-views")
    return emitted.join(shared.hint("merge"), ["view", "value"], "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """``(src, dst)``: enough links of at most ``MAX_BITS`` bits to connect all that any of them connect."""
    halves = [range(32), range(32, 64)]
    near = F.concat(F.array(F.lit(0).cast("long")), _flips([(b,) for b in range(64)]))
    far = F.when(F.bit_count("fp") % 2 == 1, _flips([(a, b) for h in halves for a in h for b in h if a < b]))
    fps = _spread(fps)
    emitted = fps.select("fp", F.explode_outer(near).alias("m"), F.lit(True).alias("near")).unionByName(
        fps.select("fp", F.explode(far).alias("m"), F.lit(False).alias("near"))
    )
    met = emitted.select("fp", "near", F.col("fp").bitwiseXOR(F.col("m")).alias("value"))
    least = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("value"))
    pairs = met.select(F.col("fp").alias("src"), least.alias("dst")).where("src != dst")
    return pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS).distinct()


def components(docs: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` of every fingerprint of ``docs``; equal roots are one component."""
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    company = stored(with_company(nodes.select("fp")), "simhash-company")
    found = connected_components(links(company)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = stored(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    return stored(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-components")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; the id is the least doc_id of the component."""
    docs = stored(fingerprints(df, doc_id, text, shingle), "simhash-docs")
    return docs.join(components(docs), "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component, that of the least doc_id (nulls last; then the least text hash); same columns."""
    docs = stored(fingerprints(df, doc_id, text, shingle), "simhash-docs")
    in_order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = docs.join(components(docs), "fp").groupBy("root").agg(F.min(in_order).alias("kept"))
    key, code = fresh_name(df, "_kept_id"), fresh_name(df, "_kept_hash")
    kept = stored(least.select(F.col("kept.doc_id").alias(key), F.col("kept.text_hash").alias(code)), "simhash-kept")
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(code))
    copies = docs.groupBy("doc_id", "text_hash").count().where("count > 1")
    copies = stored(copies.select(F.col("doc_id").alias(key), F.col("text_hash").alias(code)), "simhash-copies")
    own = df.join(kept, same, "left_semi")
    if copies.isEmpty():
        return own
    repeated = own.join(copies, same, "left_semi").dropDuplicates([doc_id, text])
    return own.join(copies, same, "left_anti").unionByName(repeated)
