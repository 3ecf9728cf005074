"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of ``>`` before it. Adjoining lines of one level are a passage.
Quoted passages (whole, by paragraph, line and sentence) are normalised (lower case, letters and digits)
and hashed; the same is done with what messages say themselves, whole and by line, and the first message
of a conversation that said a passage is its original. A passage that nobody said so is looked for inside
what messages say, across their line breaks: by its first words, then word by word in full. A message
replies to the original of most of what it quotes at level 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import remove, written

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_QUOTES = r"(?m)^[ \t]*>"
_SAYS = r"(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)[^:]{0,80}:[ \t]*$"
_SENTENCES = r"(?<=[.!?])\s+"
#: A line or sentence of fewer words only decides between parents that longer passages leave equal, unless it is all that is quoted.
LINE_WORDS = 3
#: A passage is looked for by the largest of these numbers of words that it has.
ANCHOR_WORDS = (8, 4, 2, 1)
#: Parts of a conversation, as one may hold a third of all rows.
PARTS = 64


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``body`` (the text without quotes and lines that introduce them) and ``runs`` (level, lines).

    A text without quotes is its own body, unchanged; a null text has a null body and no runs.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.split(F.regexp_replace(F.col("text"), "\r\n?", "\n"), "\n").alias("_lines"))
    lines = F.transform("_lines", lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("line")))
    rows = rows.withColumn("_lines", F.when(F.col("text").rlike(_QUOTES), lines).otherwise(F.transform("_lines", lambda line: F.struct(F.lit(0).alias("level"), line.alias("line")))))
    # A line that introduces a quote belongs to neither side: level -1.
    said = F.transform("_lines", lambda x, i: F.when((x.level == 0) & x.line.rlike(_SAYS) & (F.get("_lines", i + 1).level > 0), F.struct(F.lit(-1).alias("level"), x.line.alias("line"))).otherwise(x))
    rows = rows.withColumn("_lines", F.when(F.col("text").rlike(_QUOTES), said).otherwise(F.col("_lines")))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (F.get("_lines", i).level != F.get("_lines", i - 1).level))
    rows = rows.withColumn("_starts", F.when(F.size("_lines") > 0, starts))
    runs = F.transform("_starts", lambda s, k: F.struct(F.get("_lines", s).level.alias("level"), F.transform(F.slice("_lines", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - s), lambda x: x.line).alias("lines")))
    rows = rows.withColumn("runs", runs)
    body = F.array_join(F.flatten(F.transform(F.filter("runs", lambda r: r.level == 0), lambda r: r.lines)), "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"\n\s*\n\s*\n", "\n\n"), r"^\s+|\s+$", "")
    return rows.withColumn("body", F.when(F.col("text").rlike(_QUOTES), body).otherwise(F.col("text"))).select("conv_id", "turn", "role", "text", "body", "runs")


def _passages(runs: Column) -> Column:
    """Normalised passages of runs, each whole and each of its lines."""
    one = lambda text: F.struct(F.length(text).alias("size"), F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("sha"))
    whole = F.transform(runs, lambda r: one(_normal(F.array_join(r.lines, " "))))
    by_line = F.flatten(F.transform(runs, lambda r: F.transform(r.lines, lambda x: one(_normal(x)))))
    return F.filter(F.array_distinct(F.concat(whole, by_line)), lambda p: p["size"] > 0)


def _quoted(messages: DataFrame) -> DataFrame:
    """Each passage that a message quotes, once: level, first run, size in characters, words, whether it has several lines or is short, hashes and its first words' hash."""
    runs = messages.select("conv_id", "turn", F.posexplode("runs").alias("run", "r")).where("r.level > 0")
    piece = lambda text, part: F.struct(text.alias("text"), F.lit(part).alias("part"))
    text = F.array_join("r.lines", "\n")
    wide = F.concat(F.array(piece(text, False)), F.transform(F.split(text, r"\n[ \t]*\n"), lambda x: piece(x, False)))
    narrow = F.transform(F.concat(F.col("r.lines"), F.flatten(F.transform("r.lines", lambda x: F.split(x, _SENTENCES)))), lambda x: piece(x, True))
    pieces = runs.select("conv_id", "turn", "run", F.col("r.level").alias("level"), F.explode(F.concat(wide, narrow)).alias("p"))
    pieces = pieces.select("conv_id", "turn", "run", "level", (F.size(F.filter(F.split("p.text", "\n"), lambda x: F.length(F.trim(x)) > 0)) > 1).alias("lines"), "p.part", _normal(F.col("p.text")).alias("_text"))
    pieces = pieces.where("length(_text) > 0").withColumn("_words", F.split("_text", " ")).withColumn("words", F.size("_words"))
    anchor = F.coalesce(*[F.when(F.col("words") >= n, F.lit(n)) for n in ANCHOR_WORDS])
    pieces = pieces.withColumn("anchor_words", anchor).select(
        "conv_id", "turn", "run", "level", "lines", (F.col("part") & (F.col("words") < LINE_WORDS)).alias("short"), F.length("_text").alias("size"), "words",
        F.xxhash64("_text").alias("hash"), F.sha2("_text", 256).alias("sha"), "anchor_words", F.xxhash64(F.slice("_words", 1, F.col("anchor_words"))).alias("anchor"),
    )
    return pieces.groupBy("conv_id", "turn", "level", "size", "hash", "sha", "words", "anchor_words", "anchor").agg(F.min("run").alias("run"), F.min("lines").alias("lines"), F.min("short").alias("short"))


def _inside(spoken: DataFrame, missing: DataFrame) -> DataFrame:
    """``conv_id, hash, sha`` and the first turn whose own text has the passage anywhere in it, word by word."""
    sizes = missing.groupBy("conv_id").agg(F.collect_set("anchor_words").alias("_sizes")).select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    texts = spoken.select("conv_id", "turn", F.pmod(F.xxhash64("turn"), F.lit(PARTS)).cast("int").alias("_part"), F.split(_normal(F.col("body")), " ").alias("_words"))
    texts = written(texts.join(sizes, ["conv_id", "_part"]).select("conv_id", "turn", "_sizes", "_words", F.monotonically_increasing_id().alias("_id")), "texts")
    at = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.struct(i.alias("at"), n.alias("anchor_words"), F.xxhash64(F.slice("_words", i, n)).alias("anchor")))).otherwise(F.array())
    grams = texts.select("conv_id", "_id", F.explode(F.flatten(F.transform("_sizes", at))).alias("g")).select("conv_id", "_id", "g.*")
    # An anchor brings its passages' lengths, not its passages: places and passages that share it make no pairs.
    lengths = missing.groupBy("conv_id", "anchor_words", "anchor").agg(F.collect_set("words").alias("_lengths"))
    places = grams.join(lengths, ["conv_id", "anchor_words", "anchor"]).select("_id", "at", F.explode("_lengths").alias("words"))
    found = places.join(texts.select("conv_id", "turn", "_words", "_id"), "_id").where("at + words - 1 <= size(_words)")
    found = found.select("conv_id", "turn", F.array_join(F.slice("_words", F.col("at"), F.col("words")), " ").alias("_text"))
    found = found.select("conv_id", "turn", F.xxhash64("_text").alias("hash"), F.sha2("_text", 256).alias("sha"))
    found = found.join(missing.select("conv_id", "hash", "sha").distinct(), ["conv_id", "hash", "sha"], "left_semi")
    return found.groupBy("conv_id", "hash", "sha").agg(F.min("turn").alias("_within"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every row of ``messages`` (conv_id, turn, role, text; others are ignored) with its place among the replies.

    Returns conv_id, turn, role, text (without quotes), n_quotes (quoted passages), n_linked (those with
    an original; one of several lines that is only found inside a message's text counts by its lines where
    they have originals of their own), parent_turn (null where nothing quoted at level 1 has an earlier original), thread_turn
    (the turn that its chain of parents begins with) and depth (number of parents). Ordered by
    thread_turn and turn, every message stands after what it replies to and threads stay together.

    A passage repeated in a conversation has its first message as original; of parents that account for equally
    much the later one counts. A null conv_id or turn links nothing. Repeated (conv_id, turn)
    rows are each returned and share their links. Null and empty texts quote nothing; texts are read whole, however long. An
    empty table gives an empty result.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    known = messages.where("conv_id is not null and turn is not null")
    # A table of its own, as a filter on what is parsed would parse every message first.
    quoters = written(known.where(F.col("text").rlike(_QUOTES)), "quoters")
    quotes = written(_quoted(parse(quoters).where(F.exists("runs", lambda r: r.level > 0))), "quotes")
    # Only conversations in which anything is quoted are normalised and hashed.
    quoting = written(quotes.select("conv_id").distinct(), "quoting")
    spoken = parse(known.join(quoting, "conv_id", "left_semi"))
    own = spoken.select("conv_id", "turn", F.explode(_passages(F.filter("runs", lambda r: r.level == 0))).alias("p"))
    own = own.unionByName(parse(quoters).where(F.exists("runs", lambda r: r.level > 0)).select("conv_id", "turn", F.explode(_passages(F.array(F.struct(F.lit(0).alias("level"), F.split("body", "\n").alias("lines"))))).alias("p")))
    # The wanted passages are few; a first message is an aggregate, so a common passage needs no task of its own.
    wanted = quotes.select("conv_id", "hash", "sha").distinct()
    own = own.select("conv_id", "turn", "p.hash", "p.sha").join(wanted, ["conv_id", "hash", "sha"], "left_semi")
    originals = own.groupBy("conv_id", "hash", "sha").agg(F.min("turn").alias("original"))
    linked = quotes.join(originals, ["conv_id", "hash", "sha"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    linked = linked_table = written(linked.withColumn("within", F.lit(False)), "linked")
    missing = linked.where("original is null")
    if missing.limit(1).count():
        linked = linked.join(_inside(spoken, missing), ["conv_id", "hash", "sha"], "left").withColumn("within", F.expr("original is null and _within < turn"))
        linked = linked.withColumn("original", F.when(F.col("within"), F.col("_within")).otherwise(F.col("original"))).withColumn("short", F.expr(f"short or (within and words < {LINE_WORDS})"))
    by_run = linked.groupBy("conv_id", "turn", "run").agg(F.count("*").alias("all"), F.count_if(F.expr("original is not null and not within")).alias("said"), F.count_if(F.expr("within and not lines")).alias("inside"), F.count_if(F.expr("within and lines")).alias("across"))
    counts = by_run.groupBy("conv_id", "turn").agg(F.sum("all").alias("n_quotes"), F.sum(F.expr("said + inside + if(said = 0, across, 0)")).alias("n_linked"))
    weighed = linked.where("level = 1 and original is not null").groupBy("conv_id", "turn", "original").agg(F.sum(F.expr("if(short, 0, size)")).alias("size"), F.sum(F.expr("if(short, size, 0)")).alias("small"))
    parents = weighed.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct("size", "small", "original")).alias("parent_turn"))
    parents = written(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "parents")
    # Chains of parents by doubling: after k rounds a message knows 2^k of them.
    while True:
        up = parents.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_next"), F.col("depth").alias("_more"))
        joined = parents.join(up, ["conv_id", "thread_turn"], "left")
        moved = written(joined.select("conv_id", "turn", "parent_turn", F.coalesce("_next", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_next").isNotNull().alias("_moved")), "threads")
        remove(parents)
        parents = moved.drop("_moved")
        if moved.where("_moved").limit(1).count() == 0:
            break
    found = written(counts.join(parents, ["conv_id", "turn"], "left"), "replies")
    for table in (quoters, quotes, quoting, linked_table, parents):
        remove(table)
    out = parse(messages).join(found, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("body").alias("text"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
