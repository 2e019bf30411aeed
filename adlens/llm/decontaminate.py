"""Benchmark decontamination: finds word windows of benchmark items in training documents and removes them.

Method: a broadcast hash set of normalised test n-grams. Every window of every document is hashed and looked up
in the set; a hit is verified word by word against the item's window. Then the covered words are cut out, or
the documents go as a whole. DataFrame functions only: no Python runs on the executors.

The set goes to every task as part of the plan, and the windows' words as a broadcast table, only if they hold at
most ``set_windows`` windows and ``broadcast_bytes`` bytes; beyond that the hashes of both sides meet in a shuffled
join instead and hits are verified in a second one, with the same result.

Defined cases: null, empty and word-free texts have no words and no hit; a null or word-free item has no window;
items that repeat an id are one item; an item without an id hits, but isn't among a document's items; items with equal windows are all counted; a repeated document row is
counted once for itself (rows are told apart by id and text); empty tables give no hits; other columns are never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_key, materialize, text_key

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z; null: none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, len, grams): one row for each window of each item, ``grams`` its words."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    return w.select("item", n.alias("len"), F.explode_outer(F.transform(
        F.sequence(F.lit(0), F.size("w") - n), lambda i: F.transform(F.sequence(i, i + n - 1), lambda j: F.get("w", j)))).alias("grams"))


def window_key(words_at: str, size: int, first: str = "0") -> str:
    """SQL of the hash of ``size`` word hashes from a place; elements are read one by one, as slices copy the whole array."""
    return "xxhash64(" + ", ".join(f"{words_at}[{first} + {k}]" for k in range(size)) + ")"


def candidates(size: int, known: list[int], at: str) -> Column:
    """Positions (pos, len, g) of windows of ``size`` words whose hash is one of ``known``; ``at``: the word hashes."""
    key = window_key(at, size, "i")
    places = f"filter(sequence(0, size({at}) - {size}), i -> {key} in ({', '.join(map(str, known))}))"
    return F.expr(f"transform(if(size({at}) >= {size}, {places}, array()), i -> struct(int(i) as pos, {size} as len, {key} as g))")


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, set_windows: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame, bool]:
    """(found, grams, small): ``found`` has for each document a row with n_words, and a row (pos, len, g, g2) for each hit window."""
    word_hash = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    grams = materialize(
        windows(items, item_col, item_text, window).groupBy("grams", "len").agg(F.collect_set("item").alias("items"))
        .withColumn("wh", word_hash("grams"))
        .withColumn("g", F.expr("CASE len " + " ".join(f"WHEN {k} THEN {window_key('wh', k)}" for k in range(1, window + 1)) + " END")).drop("wh"), "grams")
    n, size = grams.agg(F.count(F.lit(1)), F.sum(F.length(F.array_join("grams", " ")) + 8 * F.size("grams") + F.length(F.array_join("items", " ")) + 64)).first()
    small = n <= set_windows and (size or 0) <= broadcast_bytes
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most ``window`` values
    own = docs.select(id_key(F.col(id_col), F.col(text_col)).alias("did"), text_key(F.col(text_col)).alias("h"), words(F.col(text_col)).alias("w"))
    hashed = own.select("did", "h", "w", word_hash("w").alias("wh"))
    known = grams.select(F.col("g").alias("of"), F.col("len").alias("of_len"), "grams", F.xxhash64(F.lit(7), "grams").alias("g2"))
    same_words = F.forall(F.sequence(F.lit(0), F.col("len") - 1), lambda k: F.get("w", F.col("pos") + k) == F.get("grams", k))
    nothing = F.array().cast("array<struct<pos:int,len:int,g:bigint>>")
    if small:
        by_len = {k: [r["g"] for r in grams.filter(F.col("len") == k).select("g").distinct().collect()] for k in lengths}
        at = hashed.select("did", "h", "w", F.concat(nothing, *[candidates(k, g, "wh") for k, g in by_len.items()]).alias("x"))
        one = at.select("did", "h", F.size("w").alias("n_words"), "x", F.when(F.size("x") > 0, F.col("w")).alias("w"))
        one = materialize(one, "looked_up")
        test = one.filter("size(x) > 0").select("did", "h", "w", F.inline("x"))
        sure = test.join(F.broadcast(known), (F.col("g") == F.col("of")) & (F.col("len") == F.col("of_len")) & same_words)
        counts = one.select("did", "h", "n_words")
    else:
        each = [F.expr(f"transform(if(size(wh) >= {k}, sequence(0, size(wh) - {k}), array()), i -> struct(int(i) as pos, {k} as len, {window_key('wh', k, 'i')} as g))") for k in lengths]
        every = hashed.select("did", "h", F.concat(nothing, *each).alias("x"))
        # outer: the planner would test an inner generator's input first, computing all of it once more for each element
        every = every.select("did", "h", F.inline_outer("x")).filter("pos is not null")
        maybe = materialize(every.join(known.select("of").distinct(), F.col("g") == F.col("of"), "left_semi"), "maybe")
        test = maybe.groupBy("did", "h").agg(F.collect_set(F.struct("pos", "len", "g")).alias("x"))
        test = own.join(test, ["did", "h"]).select("did", "h", "w", F.inline("x"))
        sure = test.join(known, F.col("g") == F.col("of")).filter((F.col("len") == F.col("of_len")) & same_words)
        counts = own.select("did", "h", F.size("w").alias("n_words"))
    sure = sure.select("did", "h", F.lit(None).cast("int").alias("n_words"), "pos", "len", "g", "g2")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("len", "int"), ("g", "long"), ("g2", "long"))]
    return materialize(sure.unionByName(counts.select("did", "h", "n_words", *none)), "hits"), grams, small


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, set_windows: int = 50_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit word spans."""
    found, grams, small = hits(docs, items, id_col, text_col, item_col, item_text, window, set_windows, broadcast_bytes)
    hit = found.filter("pos is not null").select("did", "h", "pos", "len", "g", "g2").distinct()
    named = grams.select("g", F.xxhash64(F.lit(7), "grams").alias("g2"), F.explode("items").alias("item"))
    named = F.broadcast(named) if small else named
    which = (hit.select("did", "h", "g", "g2").distinct().join(named, ["g", "g2"]).groupBy("did", "h")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    places = hit.groupBy("did", "h").agg(F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))).alias("p"))
    # spans in order: each adds the words past the furthest end so far
    covered = F.aggregate(
        "p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["pos"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    # windows that only items without an id hold have no name in ``which``, but are hits like any other
    marks = places.join(which, ["did", "h"], "left").select("did", "h", "items", F.col("p").alias("spans"), covered["n"].alias("n_hit"))
    sizes = found.filter("pos is null").groupBy("did", "h").agg(F.max("n_words").alias("n_words"))
    facts = materialize(sizes.join(marks, ["did", "h"], "left"), "facts")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), id_key(F.col(id_col), F.col(text_col)).alias("did"), text_key(F.col(text_col)).alias("h"))
    none = F.array().cast("array<string>")
    return own.join(facts, ["did", "h"]).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "spans", F.col("did").alias("_key"), F.col("h").alias("_text"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_documents: bool = True, **kw) -> DataFrame:
    """``docs`` without contamination, all columns as they were: whole documents go, or only the hit words.

    With ``whole_documents=False`` each hit word is cut out and what stands between words stays.
    """
    facts = materialize(contamination(docs, items, id_col, text_col, **kw), "contamination").filter("contaminated")
    if whole_documents:
        # ids can be null or repeated, so the text's hash goes with them
        own = docs.withColumn("_did", id_key(F.col(id_col), F.col(text_col))).withColumn("_h", text_key(F.col(text_col)))
        bad = facts.select(F.col("_key").alias("_did"), F.col("_text").alias("_h")).distinct()
        # contaminated documents can be any share of all, so the plan is a merge join at every size
        return own.join(bad.hint("merge"), ["_did", "_h"], "left_anti").select(*docs.columns)
    own = docs.withColumn("_did", id_key(F.col(id_col), F.col(text_col))).withColumn("_h", text_key(F.col(text_col)))
    cut = facts.select(F.col("_key").alias("_did"), F.col("_text").alias("_h"), F.col("spans").alias("_spans")).dropDuplicates(["_did", "_h"])
    any_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    w, between = F.regexp_extract_all(text_col, F.lit(any_word), F.lit(0)), F.split(text_col, any_word, -1)
    hit = F.col("_spans").isNotNull()
    joined = own.join(cut, ["_did", "_h"], "left").withColumn("_w", F.when(hit, w)).withColumn("_b", F.when(hit, between))
    gone = F.flatten(F.transform("_spans", lambda s: F.sequence(s["pos"], s["end"] - 1)))
    joined = joined.withColumn("_stay", F.array_except(F.sequence(F.lit(0), F.size("_w") - 1), gone))
    # what stands before word i goes to place 2i, the word itself, if it stays, to 2i + 1
    apart = F.transform(F.sequence(F.lit(0), F.size("_w")), lambda i: F.struct((i * 2).alias("at"), F.get("_b", i).alias("t")))
    words_left = F.transform("_stay", lambda i: F.struct((i * 2 + 1).alias("at"), F.get("_w", i).alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.concat(apart, words_left)), lambda x: x["t"]), "")
    return joined.withColumn(text_col, F.when(hit, text).otherwise(F.col(text_col))).select(*docs.columns)
