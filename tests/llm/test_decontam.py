import random

from boutlog.llm import decontam

RND = random.Random(21)
FOLD = {i: i + 32 for i in range(65, 91)} | {i: 32 for i in (0, 9, 10, 11, 12, 13)}


def words(n):
    return " ".join("".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RND.randrange(2, 9))) for _ in range(n))


def edited(x, edits):
    x = list(x)
    for _ in range(edits):
        at, kind = RND.randrange(len(x)), RND.randrange(3)
        x[at : at + (kind != 1)] = [] if kind == 0 else [RND.choice("abcdefghij")]
    return "".join(x)


def least_edits(item, text):
    """Plain full-matrix alignment of the item to any part of the text."""
    a, b = item.translate(FOLD), text.translate(FOLD)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_equals_full_alignment(spark):
    items = [words(n) for n in (3, 4, 6, 9, 14, 20)] + ["one and on and one and on and one and on", "a" * 30, "tenletters", "twenty two letters in"]
    texts = []
    for k in range(90):
        item = items[k % len(items)]
        some = edited(item, RND.randrange(0, len(item) // 7 + 2))
        texts.append(words(RND.randrange(0, 12)) + " " + some + " " + words(RND.randrange(0, 12)) + (" " + edited(item, 2) if k % 5 == 0 else ""))
    texts += [items[4][5:], items[4][:-4], items[5] + items[5], "aaaa" * 20, "and on " * 20, "", None]
    # letters of several bytes are one edit each, in Latin, Cyrillic and beyond the first plane
    items += ["the über wälder são are good", "Съешь ещё этих мягких французских булок да выпей же чаю", "words with 𝔄 and 😀 in them, twenty and more of 😀 such", "ü" * 12]
    texts += ["so the uber walder são are good", "the über wälder sao are gut", "и съешь еще этих мягких францусских булок, да выпей же чаю!", "Съешь ещё этих мягких французских булок да выпей же чаю", "words with 𝔅 and 😁 in them, twenty or more of 😀 such", "x" + "ü" * 11 + "u", "ÿ" + "ü" * 5 + "ö" * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            e = least_edits(item, text or "")
            if text and e <= len(item) // 10:
                want[d, i] = e
    rows = decontam.contaminated(docs, bench).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert got == want and len(want) > 40 and len(rows) == len(got)
    for r in rows:
        assert least_edits(items[r.item_id], texts[r.doc_id][r.begin : r.end]) == r.edits


def test_short_items_match_as_whole_words_and_rows_repeat(spark):
    docs = spark.createDataFrame([(1, "a catalogue"), (2, "the cat sat"), (3, "Cat"), (2, "the cat sat"), (None, "my cat"), (4, None), (5, "x" * 60_000 + " cat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cat"), (2, None), (3, ""), (4, "cat")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 1), (0, 4), (2, 1), (2, 1), (2, 4), (2, 4), (3, 1), (3, 4), (5, 1), (5, 4)]
