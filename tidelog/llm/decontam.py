"""Benchmark decontamination with DataFrame functions only.

Words of a text are an array. A window is ``window`` consecutive item words (all of a shorter item).
Any run of ``window`` document words holds an aligned gram: the ``g = (window + 1) // 2`` words from a
position that ``g`` divides. So only every g-th position of a document is hashed and looked up in
the set of all item grams; each find is verified word by word in the ``2 * window - g`` words around
it, which hold every window through that gram. No window is missed and hash collisions do no harm.

A gram's words around it are one context, however many items have them. Documents meet contexts; which texts a context is in,
and which items have a text, are looked up for the contexts that a document has been found to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import remove, written
from .text import ALNUM_WORD, ascii_lower

WINDOW = 13
#: A gram set of at most so many hashes goes into the scan as a hash set (8 bytes each), if its contexts are
#: at most four times as many and have no more than MAX_BROADCAST_BYTES; otherwise both are joined as Spark sees fit.
MAX_BROADCAST_GRAMS, MAX_BROADCAST_BYTES = 50_000, 32 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _texts(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, words and a digest of them."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.withColumn("text", F.md5(F.array_join("words", " ").cast("binary"))).distinct()


def _grams(texts: DataFrame, window: int) -> DataFrame:
    """One row for each gram place of distinct texts: text, context, win, g, h, and the words around it (iq: the gram's place in ictx)."""
    items = texts.select("text", "words").distinct().withColumn("win", F.least(F.lit(window), F.size("words"))).withColumn("g", F.expr("cast((win + 1) div 2 as int)"))
    items = items.withColumn("at", F.explode(F.expr("sequence(0, size(words) - g)"))).withColumn("lo", F.expr("greatest(at - (win - g), 0)"))
    places = items.selectExpr("text", "win", "g", "xxhash64(slice(words, at + 1, g)) as h", "at - lo as iq", "slice(words, lo + 1, at + win - lo) as ictx")
    return places.withColumn("context", F.md5(F.concat_ws(" ", "win", "iq", F.array_join("ictx", " ")).cast("binary"))).distinct()


#: How many words agree outward from the gram, at most win - g: ``a`` and ``b`` are the words at distance i.
_RUN = "if(win = g, 0, aggregate(sequence(1, win - g), 0, (n, i) -> if(n = i - 1 and {inside} and {a} = {b}, i, n)))"
_LEFT = _RUN.format(inside="q >= i and iq >= i", a="try_element_at(ctx, greatest(q - i + 1, 1))", b="try_element_at(ictx, greatest(iq - i + 1, 1))")
_RIGHT = _RUN.format(inside="q + g - 1 + i < size(ctx) and iq + g - 1 + i < size(ictx)", a="try_element_at(ctx, q + g + i)", b="try_element_at(ictx, iq + g + i)")


def _literal(h: int) -> str:
    return f"{h}L" if h != -(2**63) else "(-9223372036854775807L - 1L)"


def benchmark_hits(keyed: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_GRAMS) -> tuple[DataFrame, list[DataFrame]]:
    """For each row of ``keyed`` (any columns and ``text``): those columns but text, n_words, hit (positions of words inside a window), items.

    Rows keep their identity even where all columns are null or repeated. An item without words has no
    window; one with a null item_id hits without being listed. Null texts have no words. One scan,
    and shuffles of rows without text. Also the tables that the result is read with.
    """
    texts = written(_texts(benchmark), "items")
    places = written(_grams(texts, window), "places")
    grams = written(places.select("win", "g", "h", "iq", "ictx", "context").distinct(), "grams")
    shapes = sorted((r.win, r.g) for r in grams.select("win", "g").distinct().collect())  # at most ``window`` rows
    own = [c for c in keyed.columns if c != "text"]
    rows = keyed.select(*[F.col(f"`{c}`") for c in own], F.monotonically_increasing_id().alias("_row"), F.xxhash64("text").alias("_text_key"), words_of(F.col("text")).alias("_words"))
    known = written(grams.select("g", "h").distinct(), "known")
    rows_of, bytes_of = grams.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("ictx", " "))), F.lit(0))).first()
    few = rows_of <= 4 * max_broadcast and bytes_of <= MAX_BROADCAST_BYTES and known.limit(max_broadcast + 1).count() <= max_broadcast
    tables = [texts, places, grams, known]
    if not few:
        # Beyond the bound the grams of all documents meet those of the benchmark in a shuffle, all lengths at once, and their
        # places come back by text. The table ends the aggregate's partitioning, so that a large group of copies can be split.
        lengths = ", ".join(f"if(size(_words) >= {g}, transform(sequence(0, size(_words) - {g}, {g}), p -> struct({g} as g, p as p, xxhash64(slice(_words, p + 1, {g})) as h)), null)" for g in sorted({g for _, g in shapes}))
        none = "cast(array() as array<struct<g:int,p:int,h:bigint>>)"
        at = rows.select("_text_key", F.explode(F.expr(f"flatten(transform(array({lengths or none}), x -> coalesce(x, {none})))")).alias("x")).select("_text_key", "x.g", "x.p", "x.h")
        at = written(at.join(known, ["g", "h"], "left_semi").groupBy("_text_key").agg(F.collect_set(F.struct("g", "p")).alias("_at")), "found")
        tables.append(at)
        rows = rows.join(at, "_text_key", "left")
    parts = ["cast(array() as array<struct<win:int,g:int,p:int,h:bigint,q:int,ctx:array<string>>>)"]
    for win, g in shapes:
        if few:
            hashes = ",".join(_literal(r.h) for r in known.where(F.col("g") == g).select("h").collect())  # at most max_broadcast
            places_of = f"filter(if(size(_words) >= {win}, sequence(0, size(_words) - {g}, {g}), cast(array() as array<int>)), p -> xxhash64(slice(_words, p + 1, {g})) in ({hashes}))"
        else:
            places_of = f"if(size(_words) >= {win} and _at is not null, transform(filter(_at, x -> x.g = {g}), x -> x.p), cast(array() as array<int>))"
        lo = f"greatest(p - {win - g}, 0)"
        parts.append(f"transform({places_of}, p -> struct({win} as win, {g} as g, p as p, xxhash64(slice(_words, p + 1, {g})) as h, p - {lo} as q, slice(_words, {lo} + 1, p + {win} - {lo}) as ctx))")
    names = [f"`{c}`" for c in own]
    finds = rows.selectExpr(*names, "_row", "cast(size(_words) as bigint) as n_words", f"concat({', '.join(parts)}) as _finds")
    finds = finds.select(*names, "_row", "n_words", F.explode_outer("_finds").alias("f")).select(*names, "_row", "n_words", "f.*")
    met = finds.join(F.broadcast(grams) if few else grams, ["win", "g", "h"], "left")
    met = met.withColumn("_l", F.expr(f"if(slice(ctx, q + 1, g) = slice(ictx, iq + 1, g), {_LEFT}, null)")).withColumn("_r", F.when(F.col("_l").isNotNull(), F.expr(_RIGHT)))
    met = met.withColumn("_ok", F.expr("_l + g + _r >= win"))
    key = ["_row", "n_words", *names]
    met = met.select(*key, F.when(F.col("_ok"), F.expr("sequence(p - _l, p + g - 1 + _r)")).alias("_run"), F.when(F.col("_ok"), F.col("context")).alias("_context"))
    hits = met.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set("_run"))).alias("hit"), F.collect_set("_context").alias("_contexts"))
    # From contexts to texts to items; a row without any stays one row, with a key of its own that no digest equals.
    within = places.select(F.col("context").alias("_context"), F.col("text").alias("_text")).distinct()
    found = hits.select(*key, "hit", F.explode_outer("_contexts").alias("_context")).withColumn("_context", F.coalesce("_context", F.col("_row").cast("string"))).join(within, "_context", "left")
    found = found.groupBy(*key).agg(F.first("hit").alias("hit"), F.collect_set("_text").alias("_texts"))
    owners = texts.select(F.col("text").alias("_text"), F.col("item_id").alias("_item"))
    found = found.select(*key, "hit", F.explode_outer("_texts").alias("_text")).withColumn("_text", F.coalesce("_text", F.col("_row").cast("string"))).join(owners, "_text", "left")
    found = found.groupBy(*key).agg(F.first("hit").alias("hit"), F.collect_set("_item").alias("items"))
    return found.select(*names, "n_words", "hit", "items"), tables


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    items_sha256 is of the empty string where no item occurs. An empty table on either side gives
    no hits; null texts have no words; null doc_ids and repeated rows each give their own row. Texts are read whole, however
    long; other columns are ignored, whatever their names. Items of equal texts all count, and ties have no part in it.
    """
    hits, _ = benchmark_hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window, max_broadcast)
    n_hit = F.size("hit").cast("long")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit words of the others (n_chars follows the text).

    Other columns and their order stay. Rows are matched by doc_id and text, so repeated rows are
    treated alike and a null doc_id or text is kept as it is.
    """
    key = [F.col("doc_id").alias("_found_d"), F.xxhash64("text").alias("_found_t")]
    found, tables = benchmark_hits(docs.select(*key, "text"), benchmark.select("item_id", "text"), window, max_broadcast)
    found = written(found.where(F.size("hit") > 0).selectExpr("_found_d", "_found_t", "n_words as _found_words", "hit as _found_hit").dropDuplicates(["_found_d", "_found_t"]), "hits")
    for table in tables:
        remove(table)
    own = docs.columns
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_found_d"]) & (F.xxhash64(docs["text"]) == found["_found_t"]), "left")
    joined = joined.where("_found_hit is null or 20 * size(_found_hit) < _found_words")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"[^{_SEPARATORS}]+|[{_SEPARATORS}]+"), F.lit(0))
    # Word i is piece 2 * i, or 2 * i + 1 where the text begins with separators; what follows a word goes with it.
    shift = F.when(F.regexp_like(F.col("text"), F.lit(f"^[{_SEPARATORS}]")), 1).otherwise(0)
    joined = joined.withColumn("_found_pieces", F.when(F.col("_found_hit").isNotNull(), pieces)).withColumn("_found_shift", shift)
    cut = F.expr("array_join(filter(_found_pieces, (x, j) -> j < _found_shift or not array_contains(_found_hit, cast((j - _found_shift) div 2 as int))), '')")
    text = F.when(F.col("_found_hit").isNotNull(), cut).otherwise(F.col("text"))
    columns = {"text": text.alias("text")} | ({"n_chars": F.when(F.col("_found_hit").isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")} if "n_chars" in own else {})
    return joined.select(*[columns.get(c, F.col(f"`{c}`")) for c in own])
