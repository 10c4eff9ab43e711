"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

* Documents with equal shingle sets form a class (found by a fingerprint of the set, with map-side
  minima); only one row of each class goes on, and all that follows is about classes.
* Tensoring: two collections of ``m`` short bands are made from 2 * m * r minhashes. The table keys
  are all m * m pairs of a band of the first collection with one of the second, so that m * m
  tables cost about the square root of the minhashes. A key holds a range of set sizes too (two keys
  near a range's end), so that bucket mates are of comparable size.
* Peeling: of the bucket mates, a set with more shingles that no other mate holds than a link allows
  (1 - s of its size) has no link at all and goes. A passage that many texts share, or a text copied
  with many edits, ends here; it takes one grouping of the mates' shingles.
* In each bucket the least class is the centre, and every other one is compared with it on full
  sets. The others of a bucket form a family, of which each member x keeps d(x), its difference from
  the centre: two sets differ by d(x) xor d(y), so nothing but d is needed from here on.
* A family is moved to its consensus: elements that more than half of it hold are turned over in every
  d. A pair may differ by a(x) + a(y) elements, a = (1 - s) / (1 + s) * size. Pairs with
  |d(x)| + |d(y)| <= a(x) + a(y) are linked, and are connected by a star around the member with the
  least |d| - a. Any other linked pair shares an element of d, and the first one they share, in one
  order (rare first), stands at places p(x), p(y) with p(x) + p(y) + | |d(x)| - p(x) - |d(y)| + p(y) |
  <= a(x) + a(y), as all elements before it differ. So members meet under elements, as far as that
  bound lets them have a partner there to which they are not connected yet. Groups of at most
  ``GROUP`` members are paired under the bound, and pairs verified by d; a larger one, at most half of
  its family, is a family of its own. No bucket is expanded into its pairs, and no link is lost.

Two different texts that meet the threshold are missed only if they share no table bucket: below
0.0001 at a similarity of exactly 0.85 with m = 8, r = 2, and below 0.0006 at exactly 0.80, which the pipeline asks for.

Null and empty texts, and texts without words, have an empty set and link with nothing: a component of their own
id (null, if they have none). component_id is the least id in the component whose rows have one, and null if no row has;
kept is true where the id equals it, null counting as equal to null. Repeated rows and rows that share an id are judged by
their own texts; an id with two texts of two components may have two rows. An empty table gives no rows. Other columns are
not looked at. A very long text is held whole in the task that reads it; a set travels once for each of its centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boutlog.llm.components import components
from boutlog.llm.textkit import Block, mix, shingle_sets, texts
from boutlog.session import discard, stored

M, R, K, PERCENT = 8, 2, 5, 85
FILTER_PARTS = 256
GROUP = 200  # members under one element that are paired directly; larger groups become families of their own
SIZE_STEPS = 8  # a range of sizes in a table key spans this many steps of the largest ratio of linked sizes
_SEEDS = mix(np.arange(101, 101 + 4096, dtype=np.uint64))


def half_keys(sets: list[np.ndarray], m: int = M, r: int = R) -> np.ndarray:
    """Per set (none empty) the 2 * m band values that pairs are made of: the first m, then the second m."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets).view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), 2 * m), np.uint64)
    for band in range(2 * m):
        for j in range(r):
            s = _SEEDS[2 * (band * r + j)], _SEEDS[2 * (band * r + j) + 1] | np.uint64(1)
            out[:, band] = mix(out[:, band] + np.minimum.reduceat(flat * s[1] + s[0], starts))
    return out.view(np.int64)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, text, row: rows of equal id and text have one row hash."""
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("doc", "text"))


def sketches(rows: DataFrame, m: int = M, r: int = R, k: int = K) -> DataFrame:
    """doc, row, n (size of the shingle set), cls (a fingerprint of the set), half (band values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in texts(batch.column(2)):
                sets = shingle_sets(Block(held), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                f = np.zeros((2, len(sets)), np.int64)
                half: list = [None] * len(sets)
                if full:
                    for i, h in zip(full, half_keys([sets[i] for i in full], m, r)):
                        u = sets[i].view(np.uint64)
                        f[0, i], f[1, i] = u.sum(dtype=np.uint64).view(np.int64), mix(u + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)
                        half[i] = h
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)), pa.array([len(s) for s in sets], pa.int64()), pa.array(f[0]), pa.array(f[1]), pa.array(half, pa.list_(pa.int64()))],
                    names=["doc", "row", "n", "f1", "f2", "half"],
                )

    made = rows.select("doc", "row", "text").mapInArrow(run, "doc long, row long, n long, f1 long, f2 long, half array<long>")
    return made.select("doc", "row", "n", F.xxhash64("n", "f1", "f2").alias("cls"), "half")


def full_sets(rows: DataFrame, k: int = K) -> DataFrame:
    """row, s: the sorted shingle set of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(shingle_sets(Block(held), k), pa.list_(pa.int64()))], names=["row", "s"])

    return rows.select("row", "text").mapInArrow(run, "row long, s array<long>")


def _tables(classes: DataFrame, m: int, percent: int) -> DataFrame:
    """cls, key: of each class its key in each of the m * m tables, by range of sizes; two near a range's end."""
    place = F.log(F.col("n").cast("double")) / (SIZE_STEPS * math.log(100 / percent)) if percent < 100 else F.col("n").cast("double") + 0.5
    near = 1.001 / SIZE_STEPS
    here = F.floor(place)
    ranges = F.array(2 * here, F.when(F.floor(place + near) > here, 2 * here + 1), F.when(F.floor(place - near) < here, 2 * here - 1))
    dealt = classes.select("cls", "half", F.explode(F.array_compact(ranges)).alias("range"))
    pairs = [F.xxhash64(F.col("half")[i], F.col("half")[m + j], F.lit(i * m + j), F.col("range")) for i in range(m) for j in range(m)]
    return dealt.select("cls", F.explode(F.array(*pairs)).alias("key"))


def _mates(table: DataFrame) -> DataFrame:
    """The rows of buckets that hold two classes at least, with the bucket's least class."""
    bucket = table.groupBy("key").agg(F.min("cls").alias("c"), F.max("cls").alias("z")).where("c < z").select("key", "c")
    return table.join(bucket, "key")


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose row hash may be among wanted: all that are, and few others.

    A bitmap of hashes, of FILTER_PARTS rows of 4 kB whatever their number, is broadcast; texts of other
    rows are dropped where they are read and take no part in a shuffle.
    """
    part, place = (lambda d: F.shiftright(F.pmod(F.xxhash64(d), F.lit(FILTER_PARTS << 15)), 15)), (lambda d: F.pmod(F.xxhash64(d), F.lit(1 << 15)))
    bits = wanted.groupBy(part("row").alias("_part")).agg(F.bitmap_construct_agg(place("row")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("long")
    tried = rows.withColumns({"_part": part("row"), "_place": place("row")}).join(F.broadcast(bits), "_part")
    return tried.where(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def _peeled(sets: DataFrame, percent: int) -> DataFrame:
    """cls of the sets that hold no more shingles of their own than a link allows."""
    alone = sets.select("cls", F.explode("s").alias("t")).groupBy("t").agg(F.min("cls").alias("cls"), F.max("cls").alias("z")).where("cls = z")
    own = alone.groupBy("cls").agg(F.count("*").alias("own"))
    left = sets.select("cls", "n").join(own, "cls", "left")
    return left.where(F.coalesce("own", F.lit(0)) * 100 <= F.col("n") * (100 - percent)).select("cls")


def _differ(a: str, b: str) -> Column:
    """The elements that one of two arrays of distinct elements has."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _linked(percent: int) -> Column:
    """Similarity of at least percent hundredths, from the sizes n and nc and the difference d."""
    return F.size("d") * (100 + percent) <= (F.col("n") + F.col("nc")) * (100 - percent)


def _excess(percent: int) -> Column:
    """|d| - a of a member, times 100 + percent."""
    return F.size("d") * (100 + percent) - F.col("n") * (100 - percent)


def _consensus(state: DataFrame, percent: int) -> DataFrame:
    """fam, x, n, d, over (the excess) and z, zover (the member of least excess), after the family has moved to its consensus."""
    sizes = state.groupBy("fam").agg(F.count("*").alias("members"))
    held = state.select("fam", F.explode("d").alias("t")).groupBy("fam", "t").agg(F.count("*").alias("held"))
    common = held.join(sizes, "fam").where(F.col("held") * 2 > F.col("members")).groupBy("fam").agg(F.collect_list("t").alias("common"))
    moved = state.join(common, "fam", "left").withColumn("d", F.when(F.col("common").isNull(), F.col("d")).otherwise(_differ("d", "common")))
    moved = stored(moved.select("fam", "x", "n", "d", _excess(percent).alias("over")))
    least = moved.groupBy("fam").agg(F.min(F.struct("over", "x")).alias("z")).select("fam", F.col("z.x").alias("z"), F.col("z.over").alias("zover"))
    out = stored(moved.join(least, "fam"))
    discard(moved)
    return out


def _labelled(state: DataFrame, found: DataFrame) -> DataFrame:
    """state with lab and zlab, the components of x and z among the links found, without families that are connected."""
    label = stored(components(found, "a", "b"))
    both = state.join(label.select(F.col("node").alias("x"), F.col("component").alias("lab")), "x", "left").join(label.select(F.col("node").alias("z"), F.col("component").alias("zlab")), "z", "left")
    named = stored(both.select("fam", "x", "n", "d", "over", F.coalesce("lab", "x").alias("lab"), F.coalesce("zlab", "z").alias("zlab")))
    discard(label)
    open_ = named.groupBy("fam").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo < hi").select("fam")
    out = stored(named.join(open_, "fam", "left_semi"))
    discard(named)
    return out


def _meets(state: DataFrame, percent: int) -> DataFrame:
    """fam, t, x, lab, less, more: the members that may have a partner under each element t of their d.

    With p the place of t in x's order, more is |d| - a and less is 2 * p - |d| - a, times 100 + percent: less of one and more of
    the other member of a linked pair sum up to zero at most, both ways.
    """
    flat = state.select("fam", "x", "n", "lab", "zlab", "over", F.size("d").alias("nd"), F.explode("d").alias("t"))
    shared = flat.groupBy("fam", "t").agg(F.count("*").alias("held"), F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo < hi").select("fam", "t", "held")
    ranked = flat.join(shared, ["fam", "t"]).groupBy("fam", "x", "n", "lab", "zlab", "over", "nd").agg(F.sort_array(F.collect_list(F.struct("held", "t"))).alias("ts"))
    alone = F.col("nd") - F.size("ts")
    room = F.floor(F.col("n") * (100 - percent) / percent).cast("int") + 1 - alone
    first = ranked.withColumn("alone", alone).withColumn("room", room).where("room > 0")
    rows = first.select("fam", "x", "n", "lab", "zlab", "nd", "over", "alone", F.posexplode(F.slice("ts", F.lit(1), F.col("room"))).alias("i", "e"))
    less = (2 * (F.col("alone") + F.col("i")) - F.col("nd")) * (100 + percent) - F.col("n") * (100 - percent)
    rows = rows.select("fam", "e.t", "x", "lab", (F.col("lab") == F.col("zlab")).alias("main"), less.alias("less"), F.col("over").alias("more"))
    other = lambda c: F.min(F.when(~F.col("main"), F.col(c)))  # noqa: E731  of those that a member of the main component can meet
    reach = rows.groupBy("fam", "t").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.min("less").alias("less0"), F.min("more").alias("more0"), other("less").alias("less1"), other("more").alias("more1")).where("lo < hi")
    within = lambda k: (F.col("less") + F.col(f"more{k}") <= 0) & (F.col("more") + F.col(f"less{k}") <= 0)
    return rows.join(reach, ["fam", "t"]).where(F.when(F.col("main"), within(1)).otherwise(within(0))).select("fam", "t", "x", "lab", "less", "more")


def _groups(meets: DataFrame) -> DataFrame:
    """fam, t, large, to: the groups of members that are not all connected yet; to names the set of members."""
    group = meets.groupBy("fam", "t").agg(F.count("*").alias("size"), F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.expr("bit_xor(xxhash64(x))").alias("members")).where("lo < hi")
    return group.select("fam", "t", (F.col("size") > GROUP).alias("large"), F.xxhash64("fam", "members", "size").alias("to"))


def _pairs(meets: DataFrame, small: DataFrame) -> DataFrame:
    """fam, c, x: the pairs of members of small groups that the bound leaves open, each once."""
    one = meets.join(small, ["fam", "t"], "left_semi")
    other = one.select("fam", "t", *[F.col(c).alias(f"{c}2") for c in ("x", "lab", "less", "more")])
    open_ = (F.col("x") < F.col("x2")) & (F.col("lab") != F.col("lab2")) & (F.col("less") + F.col("more2") <= 0) & (F.col("less2") + F.col("more") <= 0)
    both = one.join(other, ["fam", "t"]).where(open_)
    return both.groupBy(F.col("x").alias("c"), F.col("x2").alias("x")).agg(F.min("fam").alias("fam")).select("fam", "c", "x")


def _verified(pairs: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """a, b: the linked ones of pairs of members of a family."""
    one = state.select("fam", "x", "n", F.col("d").alias("dx"))
    other = state.select("fam", F.col("x").alias("c"), F.col("n").alias("nc"), F.col("d").alias("dc"))
    tested = pairs.join(one, ["fam", "x"]).join(other, ["fam", "c"]).select("c", "x", "n", "nc", _differ("dx", "dc").alias("d"))
    return tested.where(_linked(percent)).select(F.col("c").alias("a"), F.col("x").alias("b"))


def links(classes: DataFrame, rows: DataFrame, m: int = M, k: int = K, percent: int = PERCENT) -> DataFrame:
    """a, b: links that connect whatever is connected among the classes (cls, row, n, half) by bucket mates."""
    mates = stored(_mates(_tables(classes, m, percent)).select("cls", "key"))
    wanted = stored(classes.select("cls", "row", "n").join(mates.select("cls").distinct(), "cls", "left_semi"))
    sets = stored(full_sets(_among(rows, wanted), k).join(wanted, "row").select("cls", "n", "s").dropDuplicates(["cls"]))
    discard(wanted)
    left = stored(_peeled(sets, percent))
    pairs = stored(_mates(mates.join(left, "cls", "left_semi")).where("cls <> c").select("c", F.col("cls").alias("x")).distinct())
    discard(mates, left)
    both = pairs.join(sets.select(F.col("cls").alias("x"), "n", F.col("s").alias("xs")), "x").join(sets.select(F.col("cls").alias("c"), F.col("n").alias("nc"), F.col("s").alias("cs")), "c")
    tested = stored(both.select("c", "x", "n", "nc", _differ("xs", "cs").alias("d")).select("c", "x", "n", "d", _linked(percent).alias("linked")))
    found = stored(tested.where("linked").select(F.col("c").alias("a"), F.col("x").alias("b")))
    discard(sets, pairs)
    apart = tested.groupBy("c").agg(F.count("*").alias("size"), F.min("linked").alias("all")).where("size > 1 AND NOT all")
    state = stored(tested.join(apart.select("c"), "c", "left_semi").select(F.col("c").alias("fam"), "x", "n", "d"))
    discard(tested)
    while not state.isEmpty():
        moved = _consensus(state, percent)
        star = moved.where((F.col("over") + F.col("zover") <= 0) & (F.col("x") != F.col("z"))).select(F.col("z").alias("a"), F.col("x").alias("b"))
        linked = stored(found.union(star).distinct())
        named = _labelled(moved, linked)
        meets = stored(_meets(named, percent))
        groups = stored(_groups(meets))
        more = stored(linked.union(_verified(_pairs(meets, groups.where("NOT large")), named, percent)))
        large = meets.select("fam", "t", "x").join(groups.where("large"), ["fam", "t"]).select("fam", "x", "to").distinct()
        next_ = stored(large.join(named, ["fam", "x"]).select(F.col("to").alias("fam"), "x", "n", "d"))
        discard(state, found, moved, linked, named, meets, groups)
        state, found = next_, more
    discard(state)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", m: int = M, r: int = R, k: int = K, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, kept: a row per row of docs."""
    rows = _rows(docs, key, text)
    sketch = stored(sketches(rows, m, r, k))
    classes = sketch.where("n > 0").groupBy("cls").agg(F.min(F.struct("row", "n", "half")).alias("one"), F.min("doc").alias("doc"))
    found = links(classes.select("cls", "one.row", "one.n", "one.half"), rows, m, k, percent)
    label = components(found, "a", "b").select(F.col("node").alias("cls"), "component")
    named = classes.select("cls", "doc").join(label, "cls")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    joined = named.join(least, "component").select("cls", "least", F.lit(True).alias("in_component"))
    labelled = classes.select("cls", "doc").join(joined, "cls", "left").select("cls", F.when(F.col("in_component"), F.col("least")).otherwise(F.col("doc")).alias("component"))
    out = sketch.where("n > 0").select("doc", "n", "cls").join(labelled, "cls").select("doc", "n", "component")
    out = out.unionByName(sketch.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    kept = F.col("doc").eqNullSafe(F.col("component"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
