"""Sharding by a hierarchical weighted hash tree.

A key goes down from region to rack to shard. At each level every child draws -ln(u) / weight with u
hashed from the key and the child's own name, and the least draw wins, so a child is chosen in
proportion to its weight. Changing a weight moves keys only into or out of that child's subtree: draws of
the others stay as they are, and so do all choices below them.

One more shard: shards are dealt to racks of 4 and regions of 8 in order of number, so from a multiple of 8
(as from 24 to 25) the new shard is a subtree of its own and takes rows only into itself. From other counts it would
change the weight of a subtree that has shards already, so shard_rows takes multiples of 8 only.

All expressions are built in; texts are read but never shuffled. Slots are numbered in two steps, places
within blocks of a shard and offsets of the blocks, so that no task holds a whole shard.

Null keys share one place in the tree, null texts count as empty; rows with equal keys share a shard. Equal rows
get different slots. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RACK, REGION = 4, 2  # shards in a rack, racks in a region
BLOCK_ROWS = 20_000


def tree(shards: int) -> list[list[list[int]]]:
    """Regions of racks of shard numbers."""
    racks = [list(range(a, min(a + RACK, shards))) for a in range(0, shards, RACK)]
    return [racks[a : a + REGION] for a in range(0, len(racks), REGION)]


def _unit(key: Column, name: str) -> Column:
    """A number in (0, 1) hashed from a key and a node's name."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + name))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _choose(key: Column, names: list[str], weights: list[float], values: list[Column]) -> Column:
    """The value of the child with the least draw; the first of equals."""
    if len(values) == 1:
        return values[0]
    draws = [(-F.ln(_unit(key, n)) / float(w)) for n, w in zip(names, weights)]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(zip(draws, values))]))["v"]


def place(key: Column, shards: int, weights: dict[int, float] | None = None) -> Column:
    """The shard of a key (a string), descending region, rack and shard; a node's weight is the sum of its shards'."""
    w = lambda s: (weights or {}).get(s, 1.0)
    key = F.coalesce(key, F.lit(""))
    regions = tree(shards)
    of_regions = []
    for r, racks in enumerate(regions):
        of_racks = [_choose(key, [f"s{s}" for s in rack], [w(s) for s in rack], [F.lit(s) for s in rack]) for rack in racks]
        of_regions.append((r, [sum(map(w, rack)) for rack in racks], of_racks))
    region = _choose(key, [f"r{r}" for r in range(len(regions))], [sum(ws) for _, ws, _ in of_regions], [F.lit(r) for r in range(len(regions))])
    out = F.lit(None).cast("int")
    for r, ws, of_racks in of_regions:
        inner = _choose(key, [f"r{r}k{k}" for k in range(len(ws))], ws, [F.lit(k) for k in range(len(ws))])
        shard = of_racks[0]
        for k in range(1, len(of_racks)):
            shard = F.when(inner == k, of_racks[k]).otherwise(shard)
        out = F.when(region == r, shard).otherwise(out)
    return out


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row."""
    if shards % (RACK * REGION):
        raise ValueError(f"shards: a multiple of {RACK * REGION}")
    name = F.col(key).cast("string")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), place(name, shards).alias("shard"), place(name, shards + 1).alias("grown_shard"))
    blocks = max(1, -(-docs.count() // (BLOCK_ROWS * shards)))
    spread = F.pmod(F.conv(F.substring(F.md5(F.concat(F.coalesce(name, F.lit("")), F.lit("#"), F.col("text_crc32").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(blocks))
    rows = rows.withColumn("block", spread)
    offsets = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).select("shard", "block", "before")
    placed = rows.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "block").orderBy(F.asc_nulls_first(key), "text_crc32", "size")) - 1)
    joined = placed.join(offsets, ["shard", "block"])
    return joined.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"), "grown_shard")


def oracle_sql(shards: int = 24) -> str:
    """doc_id, size, shard and grown_shard by DuckDB, which has no crc32; compared in a test."""
    unit = lambda n: f"((('0x' || substr(md5(k || '/{n}'), 1, 12))::BIGINT + 0.5) / {float(1 << 48)!r})"
    def choose(names: list[str], weights: list[float], values: list[str]) -> str:
        if len(values) == 1:
            return values[0]
        pairs = ", ".join(f"{{'d': -ln({unit(n)}) / {float(w)!r}, 'i': {i}, 'v': {v}}}" for i, (n, w, v) in enumerate(zip(names, weights, values)))
        return f"list_min([{pairs}]).v"
    def of(n: int) -> str:
        regions, out = tree(n), "NULL"
        region = choose([f"r{r}" for r in range(len(regions))], [float(sum(map(len, x))) for x in regions], [str(r) for r in range(len(regions))])
        for r, racks in enumerate(regions):
            inner = choose([f"r{r}k{k}" for k in range(len(racks))], [float(len(x)) for x in racks], [str(k) for k in range(len(racks))])
            shard = choose([f"s{s}" for s in racks[0]], [1.0] * len(racks[0]), [str(s) for s in racks[0]])
            for k in range(1, len(racks)):
                shard = f"CASE WHEN {inner} = {k} THEN {choose([f's{s}' for s in racks[k]], [1.0] * len(racks[k]), [str(s) for s in racks[k]])} ELSE {shard} END"
            out = f"CASE WHEN {region} = {r} THEN {shard} ELSE {out} END"
        return out
    return f"SELECT doc_id, size, shard, grown_shard FROM (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, CAST({of(shards)} AS INTEGER) AS shard, CAST({of(shards + 1)} AS INTEGER) AS grown_shard FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents))"
