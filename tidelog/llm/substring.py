"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a text from one of its words on. All suffixes that begin with the same words are one group, and a
group's suffix tree holds every repeat that begins so.

* Pruning. A suffix can only be in a tree's deep part if its first ``window`` words occur in several documents.
  Most don't, and would be leaves that hang above the depth that counts. They are dropped first: the ``gram``-word run
  with the smallest hash in a window (its minimiser) is the same in equal windows, so a window whose minimiser
  one document alone has is not repeated. What stays of a text is a few passages: runs of windows that may be.
* Partitioning. The passages' suffixes are counted by their first three words. Only prefixes with more than
  ``group_suffixes`` suffixes are extended, to the whole window, so a prefix is as long as its group needs to fit in memory.
* Trees. A task takes some groups at a time, sorts their suffixes word by word, takes the lengths
  of common prefixes and walks the internal nodes. A node at ``window`` words or deeper with leaves of several
  documents is a repeat; leaves whose document is not the first one below the node are marked. Words themselves are
  compared; hashes only choose groups. (A word of over LONG bytes stands in passages as its 256-bit digest.)
* A whole window that is still too frequent is a very common passage: one deep node. Its leaves are cut into parts of
  bounded size, and the first document below the node is the smallest of the parts' first ones.

Texts that equal a whole text with a smaller doc_id (128-bit digest of all words) are marked at once and left out.
Each step ends in a table of the shared folder, which bounds both lineage and shuffle files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, written
from .text import SLICE_BYTES, frugal, slices

WINDOW, GRAM = 13, 8
#: Suffixes of a group at most: about 12 MB of words, 40 MB in a task.
GROUP_SUFFIXES = 131_072
#: Groups are taken in so many rounds, as the suffixes of all at once would be the largest shuffle of the job.
ROUNDS = 2
#: Lengths of prefixes in words, before the whole window.
PREFIXES = (3,)
#: Longer words stand in passages as a digest.
LONG = 64
#: Words of a suffix that ``maximal_repeats`` sees.
DEPTH = 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of a passage are separated by a byte that is smaller than all of theirs; a zero byte inside a word becomes the space that words don't have.
_SEPARATOR, _SEPARATED = b"\x00", np.arange(256) == 0
_SWAP = bytes([32, *range(1, 32), 0, *range(33, 256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


class Words:
    """Words of several texts at once: hash, text number and byte range of each, all as arrays."""

    _up = _down = np.ones(1, dtype=np.uint64)

    def __init__(self, texts: list[bytes | None], space: np.ndarray = _SPACE, glue: bytes = b"\n") -> None:
        self.raw = glue.join([t or b"" for t in texts] + [b""])
        buffer = np.frombuffer(self.raw, dtype=np.uint8)
        between = np.r_[True, space[buffer]]
        edge = np.flatnonzero(between[1:] != between[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, np.r_[0, np.cumsum(lengths)])
        up, down = self._powers(len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum((buffer.astype(np.uint64) + _U(1)) * up[: len(buffer)], out=sums[1:])
        self.hash = _mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            n = max(n, 2 * SLICE_BYTES)
            cls._up, cls._down = (np.cumprod(np.r_[_U(1), np.full(n - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
        return cls._up, cls._down

    def starts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of each window inside one text."""
        n = len(self.hash) - window + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[:n]
        at = np.flatnonzero(np.arange(n) + window <= self.first[text + 1])
        return at, text[at]

    def runs_of(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on that has as many after it."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out = out * _U(0xD6E8FEB86659FD93) + self.hash[i : n + i]
        return _mixed(out)

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window inside one text: its first word, its text and the smallest hash of ``gram`` words in it."""
        at, text = self.starts(window)
        least, span, want = self.runs_of(gram), 1, window - gram + 1
        while span < want and len(at):  # by doubling
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        return at, text, least[at]


def _runs(text: np.ndarray, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of runs of windows that follow each other in one text and share an anchor; one more at the end."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    return np.r_[np.flatnonzero(new), len(at)]


_ANCHORS = "doc_id long, text_key int, sequence binary, anchors array<long>"
_PASSAGES = "doc_id long, text_key int, first int, words binary"
_SUFFIXES = "doc_id long, text_key int, pos int, before binary, words binary"
_MARKS = "doc_id long, text_key int, pos int"
_REPEATS = "words binary, n_words int, n_places long, first_doc long, open boolean"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(column)):
            yield batch.slice(lo, hi - lo)


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    schema = _arrow(_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, "text"):
            texts = _raw(part)
            words = Words(texts)
            at, text, anchor = words.anchors(window, gram)
            starts = _runs(text, anchor, at)[:-1]
            offsets = np.searchsorted(text[starts], np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchor[starts].view(np.int64)), type=schema.field("anchors").type)
            sequence = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() if n >= window else None for t, n in zip(texts, np.diff(words.first).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(sequence, pa.binary()), lists], schema=schema)

    return docs.mapInArrow(frugal(run), _ANCHORS)


def passage(words: list[bytes]) -> bytes:
    """Words as suffixes have them: in the order of their bytes, words by word, a shorter suffix before a longer one."""
    return b" ".join([w if len(w) <= LONG else hashlib.blake2b(w, digest_size=32).hexdigest().encode() + b"##" for w in words]).translate(_SWAP)


def _passages(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of windows that have one of their text's ``shared`` anchors, as words."""
    schema = _arrow(_PASSAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, "text"):
            words = Words(_raw(part))
            at, text, anchor = words.anchors(window, gram)
            shared = part.column("shared")
            owner = np.repeat(np.arange(len(shared)), np.diff(shared.offsets.to_numpy()))
            salt = _mixed(np.arange(1, len(shared) + 1, dtype=np.uint64))
            known = shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ salt[owner]
            wanted = np.flatnonzero(np.isin(anchor ^ salt[text], known))
            runs = _runs(text[wanted], np.zeros(len(wanted)), at[wanted])
            begin, last = at[wanted][runs[:-1]], at[wanted][runs[1:] - 1]
            of = text[wanted][runs[:-1]]
            found = [passage(words.raw[a:b].split()) for a, b in zip(words.start[begin].tolist(), words.end[last + window - 1].tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(of)), part.column("text_key").take(pa.array(of)), pa.array((begin - words.first[of]).astype(np.int32)), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(frugal(run), _PASSAGES)


def _suffixes(passages: DataFrame, window: int, depth: int, prefixes: list[int], texts: bool = False) -> DataFrame:
    """Suffixes of at least ``window`` words, cut after ``depth``, with hashes of their prefixes; without ``texts`` the hashes alone."""
    ddl = ", ".join([f"h{k} long" for k in prefixes] + [_SUFFIXES] * texts)
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, "words"):
            words = Words(_raw(part, "words"), _SEPARATED, _SEPARATOR)
            at, of = words.starts(window)
            columns = [pa.array(words.runs_of(k)[at].view(np.int64)) for k in prefixes]
            if texts:
                start, end, raw = words.start.tolist(), words.end.tolist(), words.raw
                last = np.minimum(at + depth, words.first[of + 1]) - 1
                found = [raw[start[a] : end[b]] for a, b in zip(at.tolist(), last.tolist(), strict=True)]
                before = [raw[start[a - 1] : end[a - 1]] if a > f else None for a, f in zip(at.tolist(), words.first[of].tolist(), strict=True)] if depth > window else pa.nulls(len(at), pa.binary())
                pos = part.column("first").to_numpy()[of] + (at - words.first[of])
                columns += [part.column("doc_id").take(pa.array(of)), part.column("text_key").take(pa.array(of)), pa.array(pos.astype(np.int32)), pa.array(before, pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return passages.mapInArrow(frugal(run), ddl)


def _grouped(passages: DataFrame, window: int, depth: int, group_suffixes: int) -> tuple[DataFrame, bool, list[DataFrame]]:
    """Suffixes with ``_group``, null where whole windows are too many; whether there are such; and the tables it reads."""
    lengths, tables = [k for k in PREFIXES if k < window] + [window], []
    for i, k in enumerate(lengths):
        hashes, key = _suffixes(passages, window, depth, lengths[: i + 1]), F.col(f"h{k}")
        if i:
            # Suffixes with shorter prefixes that are not too frequent are counted together, under null.
            longer = tables[-1].select(F.col(f"h{lengths[i - 1]}").alias("_many"))
            hashes = hashes.join(longer, F.col(f"h{lengths[i - 1]}") == F.col("_many"), "left")
            key = F.when(F.col("_many").isNotNull(), key)
        # A prefix in this table has so many suffixes that the table is at most their number over group_suffixes long.
        counts = hashes.groupBy(key.alias(f"h{k}")).agg(F.count("*").alias("n"))
        tables.append(written(counts.where(F.col("n") > group_suffixes).select(f"h{k}"), f"prefixes-{k}").where(f"h{k} is not null"))
        hot = tables[-1].limit(1).count() > 0
        if not hot:
            break
    known = [*zip(lengths, tables, strict=False)]
    rows, group = _suffixes(passages, window, depth, [k for k, _ in known], True), F.lit(None).cast("long")
    for k, table in reversed(known):
        rows = rows.join(table.withColumnRenamed(f"h{k}", "_many").withColumn(f"_many_{k}", F.lit(True)), F.col(f"h{k}") == F.col("_many"), "left").drop("_many")
        group = F.when(F.col(f"_many_{k}").isNull(), F.xxhash64(F.lit(k), f"h{k}")).otherwise(group)
    return rows.select(group.alias("_group"), "doc_id", "text_key", "pos", "before", "words"), hot, tables


def common_words(suffixes: list[bytes]) -> Iterator[int]:
    """How many words each of the sorted suffixes but the first shares with the one before, from the start on."""
    last = suffixes[0]
    words = last.split(_SEPARATOR)
    for suffix in suffixes[1:]:
        if suffix == last:
            yield len(words)
            continue
        here, n = suffix.split(_SEPARATOR), 0
        for x, y in zip(words, here, strict=False):
            if x != y:
                break
            n += 1
        yield n
        last, words = suffix, here


def internal_nodes(suffixes: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(depth in words, depth of the parent, first leaf, end leaf) of each internal node below the root of the tree of sorted suffixes; children first."""
    above: list[tuple[int, int]] = [(0, 0)]
    for i, depth in enumerate(chain(common_words(suffixes), (0,)), 1):
        begin = i - 1
        while above[-1][0] > depth:
            d, begin = above.pop()
            yield d, max(depth, above[-1][0]), begin, i
        if above[-1][0] < depth:
            above.append((depth, begin))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of whole groups; no group is in two of them."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        groups = rows.column("_group").to_numpy()
        other = np.flatnonzero(groups != groups[-1]) if len(groups) else groups
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield rows.slice(0, whole)
        kept = rows.slice(whole)
    if kept is not None and kept.num_rows:
        yield kept


def _sorted(rows: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Suffixes in order, and their rows. Suffixes of different groups share fewer words than any deep node has."""
    words = rows.column("words").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    return [words[i] for i in order], np.array(order, dtype=np.int64)


def _marks(grouped: DataFrame, window: int) -> DataFrame:
    """Leaves below a node of at least ``window`` words that has a leaf of a smaller doc_id."""
    schema = _arrow(_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            suffixes, order = _sorted(rows)
            # All deeper nodes lie below such a one, and these don't overlap.
            deep = np.array([(lo, hi) for depth, parent, lo, hi in internal_nodes(suffixes) if depth >= window > parent], dtype=np.int64).reshape(-1, 2)
            if len(deep):
                docs = rows.column("doc_id").to_numpy()[order]
                first = np.minimum.reduceat(np.append(docs, docs[-1]), deep.ravel())[::2]
                leaves = np.concatenate([np.arange(lo, hi) for lo, hi in deep.tolist()])
                leaves = leaves[docs[leaves] > np.repeat(first, deep[:, 1] - deep[:, 0])]
                yield rows.select(schema.names).take(pa.array(order[leaves])).combine_chunks().cast(schema).to_batches()[0] if len(leaves) else pa.RecordBatch.from_pylist([], schema)

    return grouped.select("_group", "doc_id", "text_key", "pos", "words").repartition("_group").sortWithinPartitions("_group").mapInArrow(frugal(run), _MARKS)


def _pruned(docs: DataFrame, window: int, gram: int, whole: bool) -> tuple[DataFrame, DataFrame | None]:
    """Passages of ``docs`` (doc_id, text) that may be repeated; if ``whole``, of texts that no smaller doc_id has, with a table of the others."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.hash("text").alias("text_key"), "text")
    # Anchors of all windows, one for each run of windows.
    anchors = written(_anchors(keyed, window, gram), "anchors")
    copies, single = None, anchors
    if whole:
        firsts = written(anchors.where("sequence is not null").groupBy("sequence").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
        copies = written(anchors.where("sequence is not null").select("doc_id", "text_key", "sequence").join(firsts, "sequence").where("doc_id > first").select("doc_id", "text_key").distinct(), "copies")
        remove(firsts)
        single = anchors.join(copies, ["doc_id", "text_key"], "left_anti")
    single = single.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    # A table ends the aggregate's partitioning, so that the join has two plain shuffles and a hot anchor's rows can be split.
    groups = written(single.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor"), "groups")
    shared = written(single.join(groups, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("shared")), "shared")
    for table in (anchors, groups):
        remove(table)
    passages = written(_passages(keyed.join(shared, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "shared"), window, gram), "passages")
    remove(shared)
    return passages, copies


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``doc_id, text_key, whole, starts``: texts with windows that a smaller doc_id has too.

    starts are the first words of those windows, sorted; whole is true where all of the text's windows
    are such, and starts is then null. text_key is the ``hash`` of the text, for rows with one doc_id.
    """
    passages, copies = _pruned(docs, window, gram, True)
    suffixes, hot, tables = _grouped(passages, window, window, group_suffixes)
    rounds = [written(_marks(suffixes.where(f"pmod(_group, {ROUNDS}) = {i}"), window), f"marks-{i}") for i in range(ROUNDS)]
    marked = reduce(DataFrame.unionByName, rounds)
    tables += rounds
    if hot:
        common = written(suffixes.where("_group is null").drop("_group", "before"), "common")
        # No window has more leaves than there are here, so no part has many more than group_suffixes.
        parts = -(-common.count() // group_suffixes)
        leaves = F.collect_list(F.struct("doc_id", "text_key", "pos")).alias("leaves")
        parts = written(common.groupBy("words", F.expr(f"pmod(xxhash64(doc_id, text_key, pos), {parts})").alias("part")).agg(F.min("doc_id").alias("least"), leaves), "parts")
        nodes = written(parts.groupBy("words").agg(F.min("least").alias("first")), "nodes")
        later = parts.join(nodes, "words").select(F.explode(F.expr("filter(leaves, x -> x.doc_id > first)")).alias("x"))
        marked = marked.unionByName(later.select("x.doc_id", "x.text_key", "x.pos"))
        tables += [common, parts, nodes]
    starts = marked.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    found = written(starts.select("doc_id", "text_key", F.lit(False).alias("whole"), "starts").unionByName(copies.select("doc_id", "text_key", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))), "repeats")
    for table in (passages, copies, *tables):
        remove(table)
    return found


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``words, n_words, n_places, first_doc, open``: word sequences of at least ``window`` words in several documents that no word before or after extends everywhere.

    They are the deep internal nodes whose leaves have different words before them. words is a string joined by spaces
    (words of over LONG bytes as digests), n_places counts all places, first_doc is the smallest doc_id. Trees are cut at ``depth`` words: a
    longer repeat is there by its first ``depth`` words, with open true. Null doc_ids and texts have no part; rows of equal doc_id are one document.
    """
    schema = _arrow(_REPEATS)
    passages, _ = _pruned(docs, window, gram, False)
    suffixes, hot, tables = _grouped(passages, window, depth, group_suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            (suffixes, order), out = _sorted(rows), []
            docs, before = rows.column("doc_id").to_numpy()[order], rows.column("before").take(pa.array(order)).to_pylist()
            for n, _, lo, hi in internal_nodes(suffixes):
                if n >= window and docs[lo:hi].min() < docs[lo:hi].max() and (len(kinds := set(before[lo:hi])) > 1 or None in kinds):
                    out.append((_SEPARATOR.join(suffixes[lo].split(_SEPARATOR)[:n]), n, hi - lo, int(docs[lo:hi].min()), n == depth))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found = suffixes.where("_group is not null").repartition("_group").sortWithinPartitions("_group").mapInArrow(frugal(run), _REPEATS)
    if hot:
        # The nodes of a common passage by an aggregate for each depth: a node is where the next words differ, or the cut.
        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _sliced(batches, "words"):
                out = []
                for doc_id, before, raw in zip(*(part.column(c).to_pylist() for c in ("doc_id", "before", "words")), strict=True):
                    words = raw.split(_SEPARATOR)
                    out += [(doc_id, before, _SEPARATOR.join(words[:n]), n, words[n] if n < len(words) else None) for n in range(window, len(words) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        ddl = "doc_id long, before binary, words binary, n_words int, after binary"
        kinds = _arrow(ddl)
        nodes = suffixes.where("_group is null").select("doc_id", "before", "words").mapInArrow(frugal(prefixes), ddl).groupBy("words", "n_words").agg(
            F.count("*").alias("n_places"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"), F.min("before").alias("_b1"), F.max("before").alias("_b2"), F.count("before").alias("_b"),
            F.min("after").alias("_a1"), F.max("after").alias("_a2"), F.count("after").alias("_a"),
        )
        nodes = nodes.where("first_doc < _last and (_b < n_places or _b1 < _b2) and (_a < n_places or _a1 < _a2)")
        found = found.unionByName(nodes.select("words", "n_words", "n_places", "first_doc", (F.col("n_words") == depth).alias("open")))
    found = written(found.withColumn("words", F.translate(F.decode("words", "UTF-8"), "\x00 ", " \x00")), "maximal")
    for table in (passages, *tables):
        remove(table)
    return found


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window that begins at one of ``starts``."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change)[:n] > 0


def _with_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("doc_id").alias("_rep_id"), F.col("text_key").alias("_rep_key"), F.col("whole").alias("_rep_whole"), F.col("starts").alias("_rep_starts"))
    return docs.join(found, (docs["doc_id"] == found["_rep_id"]) & (F.hash(docs["text"]) == found["_rep_key"]), "left").drop("_rep_id", "_rep_key")


def _gone(n: int, whole: bool | None, starts, window: int) -> np.ndarray | None:
    """Which words go; None where all stay."""
    if whole:
        return np.ones(n, dtype=bool)
    return None if starts is None else covered(n, starts, window)


def dedup_counts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have no words. Rows with a null doc_id are neither earlier nor later than
    others and keep all words; rows with equal doc_id don't count as earlier for each other.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "text"):
            sizes, removed, digests = [], [], []
            for raw, whole, starts in zip(_raw(batch), batch.column("_rep_whole").to_pylist(), batch.column("_rep_starts"), strict=True):
                words = raw.split() if raw else []
                gone = _gone(len(words), whole, starts.values.to_numpy() if starts.is_valid else None, window)
                if gone is not None:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                sizes.append(len(words) + (0 if gone is None else int(gone.sum())))
                removed.append(0 if gone is None else int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(digests)], schema=kinds)

    base = docs.select("doc_id", "text")
    return _with_repeats(base, repeats(base, window, gram)).select("doc_id", "text", "_rep_whole", "_rep_starts").mapInArrow(frugal(run), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without repeated words: spans are cut out of the texts and n_chars follows; emptied documents go.

    Words that stay keep the white space after them. A text without repeats, and one that is null
    or empty from the start, stays as it is. Other columns and their order stay.
    """
    taken = docs.columns
    kinds = _arrow(docs.schema.toDDL())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "text"):
            keep, texts = [], []
            for i, (raw, whole, starts) in enumerate(zip(_raw(batch), batch.column("_rep_whole").to_pylist(), batch.column("_rep_starts"), strict=True)):
                if not raw or not (whole or starts.is_valid):
                    keep.append(i)
                    texts.append(raw)
                    continue
                words = Words([raw])
                gone = _gone(len(words.start), whole, starts.values.to_numpy() if starts.is_valid else None, window)
                # Each run of kept words with the white space up to the next word.
                edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
                following = np.r_[words.start, len(raw)]
                text = b"".join(raw[words.start[a] : following[b]] for a, b in zip(edge[::2], edge[1::2], strict=True))
                if text:
                    keep.append(i)
                    texts.append(text)
            rows = batch.take(pa.array(keep, pa.int64()))
            columns = {c: rows.column(c) for c in taken} | {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            if "n_chars" in taken:
                changed = [bool(w) or s.is_valid for w, s in zip(rows.column("_rep_whole").to_pylist(), rows.column("_rep_starts"), strict=True)]
                columns["n_chars"] = pa.array([len(t.decode()) if c and t is not None else n for c, t, n in zip(changed, texts, rows.column("n_chars").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in kinds], schema=kinds)

    return _with_repeats(docs, repeats(docs.select("doc_id", "text"), window, gram)).select(*[f"`{c}`" for c in taken], "_rep_whole", "_rep_starts").mapInArrow(frugal(run), docs.schema)
