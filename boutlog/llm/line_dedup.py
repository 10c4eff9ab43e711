"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A text's lines (split at \\n, compared trimmed of ASCII white space and lower-cased) with a word are
numbered. A window is the shortest run of lines, from any line on or up to any line, that has ``min_words``
words; its least line hash (the last of equals) is its fingerprint. Windows whose fingerprint stands at one
place only are dropped; the others are joined, on a hash of all their line hashes, with the first position
of that hash in the corpus (by doc_id, then place), and the lines of a window that stands later are deleted.

Equal windows are a proven run, and every line of a run of ``min_words`` words is in a window that begins or
ends within the run and lies inside it: no such run is missed, whatever other texts hold its fingerprint. A
line goes only if an equal one stands earlier, so the first of equal lines always stays.

Texts are read once for hashes and once for the rewrite; what is shuffled between are hashes and counts.

Null texts stay null, empty texts empty; a text whose lines all go becomes empty. Rows equal in id and text
count once and are rewritten alike; null ids come first. Lines without a word stay.
Other columns are kept, but for the names of the three counts that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.session import cut

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc, ls: of each distinct (id, text) the lines with a word, as structs of place i, hash h, words w."""
    lined = F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.lower(F.btrim(x, F.lit(" \t\x0b\x0c\r")))).alias("h"), F.regexp_count(x, F.lit(_WORD)).alias("w")))
    parts = docs.where(F.col(text).isNotNull()).select(_rid(key, text).alias("rid"), F.col(key).alias("doc"), F.filter(lined, lambda x: x["w"] > 0).alias("ls"))
    return parts.where(F.size("ls") > 0).dropDuplicates(["rid"])


def _rid(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, doc, pos, size, h, f, at: each window of a line table once; h is the hash of all its line hashes.

    f is the window's fingerprint and at its place; pos, size and at count lines with a word.
    """
    flat = lines.select("rid", "doc", F.posexplode("ls").alias("pos", "z")).select("rid", "doc", "pos", "z.h", "z.w")
    flat = flat.withColumn("upto", F.sum("w").over(Window.partitionBy("rid").orderBy("pos"))).withColumn("cum", F.col("upto") - F.col("w"))
    flat = flat.withColumn("all", F.sum("w").over(Window.partitionBy("rid")))
    ahead = Window.partitionBy("rid").orderBy("cum").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("rid").orderBy("upto").rangeBetween(1 - min_words, 0)
    flat = flat.withColumn("ahead", F.collect_list("h").over(ahead)).withColumns({"behind": F.collect_list("h").over(behind), "before": F.min("cum").over(behind)})
    # a backward window that is too short without its last line is a forward window too
    windows = F.array(
        F.when(F.col("all") - F.col("cum") >= min_words, F.struct("pos", F.col("ahead").alias("hs"))),
        F.when(F.col("cum") - F.col("before") >= min_words, F.struct((F.col("pos") - F.size("behind") + 1).alias("pos"), F.col("behind").alias("hs"))),
    )
    each = flat.select("rid", "doc", F.explode(F.filter(windows, lambda x: x.isNotNull())).alias("z")).select("rid", "doc", "z.pos", "z.hs", F.array_min("z.hs").alias("f"))
    last = F.size("hs") - F.array_position(F.reverse("hs"), F.col("f"))
    return each.select("rid", "doc", "pos", F.size("hs").alias("size"), F.xxhash64("hs").alias("h"), "f", (F.col("pos") + last).cast("int").alias("at"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """rid, gone (places of the lines to delete), gone_words, runs (in how many texts they stand first)."""
    lines = cut(line_table(docs, key, text))
    every = cut(windows(lines, min_words))
    place = F.xxhash64("rid", "at")
    prints = every.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a < z").select("f")
    likely = cut(every.join(prints, "f", "left_semi").select("rid", "doc", "pos", "size", "h"))
    first = likely.groupBy("h").agg(F.min(F.struct("doc", "rid", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = likely.join(first, "h").where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos")))
    spans = later.groupBy("rid").agg(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("spans"), F.count_distinct("first.rid").alias("runs"))
    lost = spans.join(lines.select("rid", "ls"), "rid").select("rid", "runs", F.transform(F.array_distinct(F.flatten("spans")), lambda k: F.get("ls", k)).alias("lost"))
    return lost.select("rid", F.sort_array(F.transform("lost", lambda x: x["i"])).alias("gone"), F.aggregate("lost", F.lit(0).cast("long"), lambda n, x: n + x["w"]).alias("gone_words"), "runs")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text rewritten, and n_lines (with a word or not, before), removed_lines, removed_words."""
    gone = cut(repeated_lines(docs, key, text, min_words)).select(F.col("rid").alias("_rid"), F.col("gone").alias("_gone"), F.col("gone_words").alias("_words"))
    joined = docs.withColumn("_rid", F.when(F.col(text).isNotNull(), _rid(key, text))).join(gone, "_rid", "left").withColumn("_lines", _lines(F.col(text)))
    stay = F.array_except(F.transform("_lines", lambda x, i: i), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "removed_lines", "removed_words")]
    return joined.select(
        *[kept.alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce("_words", F.lit(0)).cast("long").alias("removed_words"),
    )
