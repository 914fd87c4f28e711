"""Benchmark decontamination: n-gram windows of test items against all windows of training texts.

DataFrame functions only. Every window of the items is reached by an anchor, its longest word (long words are
rare; of equal ones the smallest). A text can hold a window only where it holds the anchor, so the scan explodes
a text's words against the hash set of anchors, and compares the full window of words at the places that match.
The explode and the look-up run in one generated loop: the words never leave it, only matches do. Long texts are
cut into stretches first, so what a match carries is bounded.

The anchors are broadcast while the items have at most ``broadcast_windows`` windows; beyond that
stretches which hold an anchor are found by a shuffled join of distinct words, and only those are joined again. A text's matches are reduced to start positions per item before they meet by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WINDOW = 13
#: Words that are scanned together; each stretch also holds the words around it that a window can reach.
STRETCH = 512
#: Item windows that may be broadcast: at some 150 bytes each, about 75 MB.
BROADCAST_WINDOWS = 500_000
# Fixed value: everything but ASCII letters, digits and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word that no text can hold; it gives every document one row.
_MARK = "\x00"


def normal_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows of the items with their anchors: ``item``, ``anchor``, ``offset``, ``size``, ``gram``."""
    words = items.select(F.col(item_col).alias("item"), normal_words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    size = F.least(F.lit(window), F.size("w"))
    grams = words.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice(F.col("w"), i, F.least(F.lit(window), F.size("w")))
            )
        ).alias("gram"),
    ).distinct()
    # The longest word, of equal ones the smallest, at its first place.
    best = F.array_min(F.transform("gram", lambda w: F.struct((-F.octet_length(w)).alias("l"), w.alias("w"))))
    return grams.select(
        "item",
        best["w"].alias("anchor"),
        (F.array_position("gram", best["w"]) - 1).cast("int").alias("offset"),
        F.size("gram").alias("size"),
        "gram",
    )


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Every place where an item's window occurs: ``id``, ``n_words``, ``item``, ``start``, ``size``; and for
    every document one row whose ``item`` and ``start`` are null (``start`` counts words from 0)."""
    grams = item_windows(items, item_col, item_text_col, window)
    few = grams.limit(broadcast_windows + 1).count() <= broadcast_windows
    words = docs.select(F.col(id_col).alias("id"), normal_words(F.col(text_col)).alias("w"))
    last = F.floor(F.greatest(F.size("w") - 1, F.lit(0)) / STRETCH).cast("int")
    cut = words.select(
        "id", F.size("w").alias("n_words"), "w", F.explode(F.sequence(F.lit(0), last)).alias("stretch")
    )
    first = F.col("stretch") * STRETCH
    before = F.greatest(first - (window - 1), F.lit(0))  # words of the context before its first one
    parts = cut.select(
        "id",
        "n_words",
        "stretch",
        first.alias("first"),
        before.alias("before"),
        F.slice("w", first + 1, F.lit(STRETCH)).alias("core"),
        F.slice("w", before + 1, first - before + STRETCH + window - 1).alias("context"),
    )
    if few:
        mark = docs.sparkSession.range(1).select(
            F.lit(None).cast(grams.schema["item"].dataType).alias("item"),
            F.lit(_MARK).alias("anchor"),
            F.lit(0).alias("offset"),
            F.lit(0).alias("size"),
            F.lit(None).cast("array<string>").alias("gram"),
        )
        marked = F.when(F.col("stretch") == 0, F.concat("core", F.array(F.lit(_MARK)))).otherwise(F.col("core"))
        placed = parts.select("*", F.posexplode(marked).alias("at", "anchor"))
        joined = placed.join(F.broadcast(grams.unionByName(mark)), "anchor")
        every = None
    else:
        # Which stretches hold an anchor, by a join of their distinct words; only those are read further.
        anchors = grams.select("anchor").distinct()
        held = parts.select("id", "stretch", F.explode(F.array_distinct("core")).alias("anchor")).join(anchors, "anchor")
        held = held.select(F.col("id").alias("h_id"), F.col("stretch").alias("h_stretch")).distinct()
        parts = parts.join(held, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("stretch") == F.col("h_stretch")), "left_semi")
        joined = parts.select("*", F.posexplode("core").alias("at", "anchor")).join(grams, "anchor")
        every = words.select("id", F.size("w").alias("n_words"), F.lit(None).cast(grams.schema["item"].dataType).alias("item"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("size"))
    start = F.col("first") + F.col("at") - F.col("offset")
    place = start - F.col("before") + 1
    same = F.col("gram").isNull() | (
        (start >= 0) & (place >= 1) & (F.slice("context", F.greatest(place, F.lit(1)), F.greatest("size", F.lit(1))) == F.col("gram"))
    )
    found = joined.filter(same).select(
        "id", "n_words", "item", F.when(F.col("gram").isNotNull(), start).alias("start"), "size"
    )
    return found if every is None else found.unionByName(every)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """How much of each document lies in windows of test items.

    Returns one row per id: ``id_col``, ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (sorted
    texts of the ids of items that occur), ``spans`` (runs of hit words: first word, words), ``contaminated``
    (some word is hit, and at least one of ``share``).

    * A window is ``window`` consecutive words of an item; an item of fewer words is one window, one of none
      has none. Null texts have no words. Null item ids count as the empty string in ``items``.
    * Repeated rows with one id must hold one text; they count as one document. A null id is an id.
    * Without items, or in an empty table, nothing is hit. Further columns are ignored.
    """
    hits = find_hits(docs, items, id_col, text_col, item_col, item_text_col, window, broadcast_windows)
    item = F.when(F.col("start").isNotNull(), F.coalesce(F.col("item").cast("string"), F.lit("")))
    per_doc = hits.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(item)).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size")))).alias("at"),
    )
    # Occurrences in order of start, joined into runs; a document has no more of them than words and sizes.
    empty = F.array().cast("array<struct<first:int,words:int>>")

    def extend(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        end = F.greatest(last["first"] + last["words"], x["start"] + x["size"])
        grown = F.struct(last["first"].alias("first"), (end - last["first"]).alias("words"))
        new = F.struct(x["start"].alias("first"), x["size"].alias("words"))
        touches = (F.size(runs) > 0) & (x["start"] <= last["first"] + last["words"])
        return F.when(touches, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(runs, F.array(new))
        )

    spans = F.aggregate("at", empty, extend)
    out = per_doc.withColumn("spans", spans).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    )
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        "items",
        "spans",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` without contaminated documents, all columns kept (stage of the pipeline)."""
    bad = decontaminate(docs, items, id_col, **more).filter("contaminated").select(F.col(id_col).alias("__id"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with the hit words taken out of the texts; texts without hits stay as they are.

    Between the cuts, words and separators keep their form: the text is split at the words, and the pieces
    that belong to hit words are dropped.
    """
    hit = (
        decontaminate(docs, items, id_col, text_col, **more)
        .filter("n_hit > 0")
        .select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    )
    joined = docs.join(hit, docs[id_col].eqNullSafe(hit["__id"]), "left")
    # Each piece is a word (of any case) with the separators after it; separators before the first word come first.
    pieces = F.regexp_extract_all(text_col, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(text_col, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(
        pieces,
        lambda _, i: ~F.exists("__spans", lambda s: (i >= s["first"]) & (i < s["first"] + s["words"])),
    )
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.withColumn(text_col, text).drop("__id", "__spans").select(*docs.columns)
