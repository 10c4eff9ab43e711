"""SimHash near-duplicates by deletion variants of segments, equality joins and verification.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Fingerprints that differ in at most three
bits link. Of two halves of a fingerprint one then differs in at most one bit, so two segments do instead of four: a segment is
indexed as it is and with each of its bits left out (a wildcard). Left-out variants are made of *distinct* segments, so a
variant has at most two of them, which differ in that bit; they are found by a grouping and joined by equality with their
fingerprints. A group is thus a set of fingerprints that agree on half of their bits but for one wildcard.

Groups of at most ``GROUP`` fingerprints are compared inside a task, and only a spanning set of verified links leaves it. A
larger group is cut again by the half that is left (32 bits, then 16), which keeps every link, as again one of two halves
differs in at most one bit. With 8 bits left a group has 2^8 fingerprints times a factor of two per wildcard, 2,048 at the
most, and is compared whatever its size. So no group grows with the data, no bucket is expanded into its pairs, and no link is lost.

Equal fingerprints are one node, so copies cost nothing; component_id is the least id of the component, found by star steps.

Null and empty texts, and texts without a word, have fingerprint zero, which links like any other. Fewer words than a shingle: the whole
sequence. Rows with a null id keep it and take part; component_id is null only where no row of the component has an id. Repeated
rows have rows of their own. An empty table gives no rows; other columns are not looked at. A very long text is held whole in
the task that reads it, its hashes in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from boutlog.llm.components import components
from boutlog.llm.textkit import LOWER
from boutlog.session import discard, stored

WORDS, BITS, DISTANCE, SEED = 3, 64, 3, 42
GROUP = 256
LAST = 8  # bits left in the groups that are compared whatever their size
PART = 1 << 16  # hashes whose bits are counted at a time
_LOWER = LOWER.tobytes()


def shingle_hashes(text: bytes, k: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all k-word shingles, repeats included, in parts; of fewer words the whole sequence, of none nothing."""
    words = text.translate(_LOWER).split()  # at ASCII white space
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) < k:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    joined = b" ".join(words)
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    n = len(words) - k + 1
    for at in range(0, n, PART):
        some = slice(at, min(n, at + PART))
        a, z = begins[:n][some].tolist(), (begins[k : k + n][some] - 1).tolist()
        yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, z)), np.uint64, len(a))


def fingerprint(text: bytes, k: int = WORDS, seed: int = SEED) -> int:
    """The bits set in over half of the hashes; zero without a word."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, k, seed):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, fp (as a signed long) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py() or b"", k, seed) for x in batch.column(1).cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _halves(left: int) -> Column:
    """(side, seg, rest): each half of the ``left`` bits that rest holds, with the other half."""
    h = left // 2
    high, low = F.shiftrightunsigned("rest", h), F.col("rest").bitwiseAND(F.lit((1 << h) - 1))
    row = lambda side, seg, rest: F.struct(F.lit(side).alias("side"), seg.alias("seg"), rest.alias("rest"))
    return F.inline(F.array(row(0, high, low), row(1, low, high)))


def cut_groups(members: DataFrame, left: int) -> DataFrame:
    """grp, rest, fp: members (of groups that agree on all but ``left`` bits) in groups that agree on half of those too.

    Two members of a group that differ in at most three of the bits left share a group of the result. grp is a hash of what its
    members agree on; were two hashes equal, their groups would be compared together, to no harm.
    """
    h = left // 2
    parts = stored(members.select("grp", "fp", _halves(left)))
    same = parts.select(F.xxhash64("grp", "side", "seg").alias("grp"), "rest", "fp")
    # a row becomes as many as a segment has bits: dealt out before, as adaptive execution would put the small rows into a few tasks
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = parts.select("grp", "side", "seg").distinct().repartition(tasks)
    bits = F.array(*[F.struct(F.lit(i).alias("wild"), F.col("seg").bitwiseAND(F.lit(~(1 << i))).alias("others")) for i in range(h)])
    variants = segments.select("grp", "side", F.inline(bits)).groupBy("grp", "side", "wild", "others").agg(F.count("*").alias("n")).where("n = 2")
    two = F.array(F.col("others"), F.col("others").bitwiseOR(F.expr("shiftleft(1L, wild)")))
    met = variants.select("grp", "side", F.explode(two).alias("seg"), F.xxhash64("grp", "side", "wild", "others", F.lit("wild")).alias("to"))
    near = parts.join(met, ["grp", "side", "seg"]).select(F.col("to").alias("grp"), "rest", "fp")
    out = stored(same.union(near))
    discard(parts)
    return out


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what verified links connect among the fingerprints."""
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    parent = np.argmax(near, axis=1)  # the first fingerprint that each one links with: itself, or an earlier one
    links = [np.stack([parent, label])]
    while True:  # neighbours that the first links leave in other trees
        root = parent
        while (root[root] != root).any():
            root = root[root]
        least = np.where(near, root[None, :], len(prints)).min(axis=1)
        apart = np.flatnonzero(least < root)
        if not len(apart):
            break
        # one link for each tree that meets a lower one: from its first such member to that member's neighbour of the least root
        trees, first = np.unique(root[apart], return_index=True)
        a = apart[first]
        b = np.argmax(near[a] & (root[None, :] == least[a][:, None]), axis=1)
        links.append(np.stack([b, a]))
        parent = root.copy()
        parent[trees] = least[a]
    a, b = np.concatenate(links, axis=1)
    real = a != b
    return prints[a[real]], prints[b[real]]


def group_links(groups: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that connect each group (an array fps), verified on whole fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spanning_links(np.asarray(x.values).view(np.uint64), distance) for x in batch.column(0)]
            a, b = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    pair = groups.where("size(fps) = 2").select(F.col("fps")[0].alias("a"), F.col("fps")[1].alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pair.union(groups.where("size(fps) > 2").select("fps").mapInArrow(run, "a long, b long"))


def links(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """a, b: links that connect whatever is connected among distinct fingerprints (fp)."""
    if distance > 3:
        raise ValueError("two segments find up to three differing bits")
    members, left, found = prints.select(F.lit(0).cast("long").alias("grp"), F.col("fp").alias("rest"), "fp"), BITS, None
    while True:
        cut = cut_groups(members, left)
        left //= 2
        if left < BITS // 2:
            discard(members)
        sizes = stored(cut.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"))
        last = left <= LAST
        small = cut.join(sizes if last else sizes.where(F.col("size") <= group), "grp").groupBy("grp").agg(F.collect_list("fp").alias("fps"))
        part = stored(group_links(small, distance).distinct())
        merged = part if found is None else stored(found.union(part).distinct())
        if found is not None:
            discard(found, part)
        found = merged
        members = None if last else stored(cut.join(sizes.where(F.col("size") > group), "grp", "left_semi"))
        discard(cut, sizes)
        if last or members.isEmpty():
            if members is not None:
                discard(members)
            return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: a row per row of docs."""
    prints = stored(fingerprints(docs, key, text, k))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(classes.select("fp"), distance, group)
    label = components(found, "a", "b").select(F.col("node").alias("fp"), "component")
    named = classes.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    out = prints.join(of, "fp")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
