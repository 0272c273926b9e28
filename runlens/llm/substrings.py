"""Substring deduplication: passages of SPAN words that occur anywhere else go, told by FM-indexes of shards.

Words are runs without white space, unchanged. A window is SPAN consecutive words of a document; it
is repeated if its words also start at another place of the corpus, same document included.

Where equal windows meet. Every window has an anchor: of its runs of GRAM words the one of least
hash, the first of equals. Neighbouring windows mostly share theirs, so a document is a row of
stretches, the windows of one anchor each; equal windows have equal anchors at the same place of
theirs. A stretch whose anchor occurs once in the corpus holds no repeated window. The others,
distinct ones once with the number of their occurrences, are dealt to shards by anchor.

In a shard the words of its stretches are put into a compressed FM-index (wavelet matrix of their
BWT), twice what occurs more than once. The stretches then stream through backward search, which
gives their matching statistics: how far the words from each place on match in two places at
least. Stretches of one document overlap by less than SPAN words, so no window meets itself. The
places of SPAN and more are reported and go back to the documents.

Hot anchors. Where more than HOT distinct stretches share one (a common line in many contexts),
these are cut into single windows, counted by their own hash first, and dealt to shards by it.

Defined cases: null texts and texts without words have no words, and kept_sha256 of the empty text;
documents of fewer than SPAN words keep all; repeated rows repeat each other, whatever their ids;
null and repeated ids are kept, one row a row; other columns are ignored. Words, anchors and
stretches are told by 64-bit hashes, stretches by two of them (anchor and words).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import Rolling, chunks, durable, in_arrow, scratch, text_bytes, text_of
from runlens.llm.fm_index import FMIndex
from runlens.storage import freed_shuffles

SPAN, GRAM = 35, 12
CHUNK = 1 << 21
#: Distinct stretches of one anchor beyond which they are cut into windows.
HOT = 10_000
#: Words in a shard's index, about.
SHARD = 1 << 20
_RUNS = "array<struct<s: int, e: int>>"
_blank = np.zeros(256, dtype=bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_bytes, _words = Rolling(), Rolling()


class Words:
    """The words of several texts: starts and ends in the bytes, owners, 64-bit codes and the number before each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        word = ~_blank[raw]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] |= word[inner]  # a word ends with its text
        ends[inner - 1] |= word[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.owner = np.searchsorted(offsets, self.start, side="right") - 1
        self.before = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.codes = _bytes.spans(raw, self.start, self.end)
        self.sums = _words.prefix(self.codes)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words a to b - 1, as int64."""
        return _words.between(self.sums, a, b).view(np.int64)

    def stretches(self, span: int, gram: int) -> tuple[np.ndarray, ...]:
        """(first window, last window, anchor's word) of each stretch, ascending; windows are told by their first word."""
        n = len(self.codes)
        none = (np.zeros(0, dtype=np.int64),) * 3
        if n < span:
            return none
        at = np.arange(n - gram + 1)
        value, where = _words.between(self.sums, at, at + gram), at
        left, have = span - gram + 1, 1
        while have < left:  # the least of `have` neighbours, the first of equals
            step = min(have, left - have)
            less = value[step:] < value[:-step]
            value, where = np.where(less, value[step:], value[:-step]), np.where(less, where[step:], where[:-step])
            have += step
        whole = np.flatnonzero(self.owner[: n - span + 1] == self.owner[span - 1 :])
        if not len(whole):
            return none
        anchor = where[whole]
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)
        first = np.flatnonzero(new)
        return whole[first], whole[np.concatenate([first[1:], [len(whole)]]) - 1], anchor[first]

    def joined(self, keep: np.ndarray | None = None) -> list[bytes]:
        """Of each text the words (that keep names) joined by one space."""
        start, end, owner = (self.start, self.end, self.owner) if keep is None else (self.start[keep], self.end[keep], self.owner[keep])
        marks = np.zeros(len(self.raw) + 1, dtype=np.int8)
        marks[start] += 1
        marks[end] -= 1
        inside = np.cumsum(marks[:-1]).astype(bool)
        gaps = end[:-1][owner[:-1] == owner[1:]]  # the white space after a word that another of its text follows
        inside[gaps] = True
        out = self.raw.copy()
        out[gaps] = 32
        sums = np.concatenate([[0], np.cumsum(inside)])[self.offsets].tolist()
        whole = out[inside].tobytes()
        return [whole[a:b] for a, b in zip(sums, sums[1:], strict=False)]


def _listed(pa, values: np.ndarray, sizes: np.ndarray, kind):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(docs[id_col].alias("_id"), text.alias("_text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("key"))


def outlines(keyed: DataFrame, span: int, gram: int) -> DataFrame:
    """Per document: row, _id, key, n_words, whole (digest of all its words), and its stretches: anchors m, hashes d, first and last windows s, e."""
    kind = keyed.schema["_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s, e, p = words.stretches(span, gram)
                own = words.owner[s]
                sizes, back = np.bincount(own, minlength=j - i), words.before[own]
                lists = [
                    _listed(pa, v, sizes, k)
                    for v, k in ((words.hashes(p, p + gram), pa.int64()), (words.hashes(s, e + span), pa.int64()), (s - back, pa.int32()), (e - back, pa.int32()))
                ]
                told = [hashlib.sha256(t).hexdigest() for t in words.joined()]
                counts = np.bincount(words.owner, minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(counts), pa.array(told, pa.string()), *lists],
                    ["row", "_id", "key", "n_words", "whole", "m", "d", "s", "e"],
                )
                row += j - i

    return in_arrow(keyed.select("_id", "_text", "key"), run, f"row bigint, _id {kind}, key string, n_words bigint, whole string, m array<bigint>, d array<bigint>, s array<int>, e array<int>")


_CUT = "array<struct<m: bigint, d: bigint, s: int, e: int, c: bigint>>"


def _cut(keyed: DataFrame, outline: DataFrame, stretches: DataFrame, run, schema: str) -> DataFrame:
    """run over (text, key, its list of stretches) of one row at least for each text that stretches (row, m, d, s, e, c) name."""
    each = stretches.groupBy("row").agg(F.collect_list(F.struct("m", "d", "s", "e", "c")).alias("cut"))  # a document's own
    named = durable(each.join(outline.select("row", "key"), "row").select("key", "cut"), "substring-cut")
    return in_arrow(keyed.select("_text", "key").join(named.hint("merge"), "key").select("_text", "key", "cut"), run, schema)


def _once(batches):
    """(words, first windows, last windows, m, d, c, first words of their texts) of the stretches of several texts; of equal rows in a task the first counts."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        fresh = []
        for i, name in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).value_lengths().to_pylist(), strict=True)):
            if name not in seen:
                seen.add(name)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        raw, offsets = text_bytes(batch.column(0))
        for i, j in chunks(offsets, CHUNK):
            words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cut = batch.column(2).slice(i, j - i)
            m, d, s, e, c = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in cut.flatten().flatten())
            base = np.repeat(words.before[:-1], cut.value_lengths().to_numpy())
            yield words, s + base, e + base, m, d, c, base


def _windows(keyed: DataFrame, outline: DataFrame, hot: DataFrame, span: int) -> DataFrame:
    """(row, m, d, w, at, s, e, c): the windows of hot stretches, with their own hash w and place `at` in the stretch."""

    def run(batches):
        import pyarrow as pa

        for words, a, b, m, d, c, base in _once(batches):
            size = b - a + 1
            at = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            first = np.repeat(a, size) + at
            columns = (np.repeat(m, size), np.repeat(d, size), words.hashes(first, first + span), at, first - np.repeat(base, size), np.repeat(c, size))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["m", "d", "w", "at", "s", "c"])

    found = _cut(keyed, outline, hot, run, "m bigint, d bigint, w bigint, at bigint, s bigint, c bigint")
    return found.dropDuplicates(["m", "d", "at"]).join(hot.select("row", "m", "d"), ["m", "d"])


def _shard(span: int):
    """(m, d, at): the repeated windows of a shard's stretches by its FM-index, as runs (first, last) of windows."""

    def run(table):
        import pyarrow as pa

        m, d, c = (table.column(x).to_numpy() for x in ("m", "d", "c"))
        order = np.lexsort((d, m))
        order = order[np.concatenate([[True], (np.diff(m[order]) != 0) | (np.diff(d[order]) != 0)])]  # rows of texts that repeat
        lists = table.column("codes").combine_chunks().take(pa.array(order))
        m, d, c = m[order], d[order], c[order]
        sizes, flat = np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().to_numpy()
        twice = np.flatnonzero(c > 1)
        again = lists.take(pa.array(twice))
        index = FMIndex(np.concatenate([flat, again.flatten().to_numpy()]), np.concatenate([[0], np.cumsum(np.concatenate([sizes, sizes[twice]]))]))
        starts = index.starts[: len(sizes)]
        far = index.statistics(starts, sizes) >= span
        edge = np.diff(far.astype(np.int8), prepend=0, append=0)  # the mark after each stretch is never far
        first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
        own = np.searchsorted(starts, first, side="right") - 1
        some, counts = np.unique(own, return_counts=True)
        runs = pa.StructArray.from_arrays([pa.array((x - starts[own]).astype(np.int32)) for x in (first, last)], ["s", "e"])
        at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), runs)
        return pa.table([pa.array(m[some]), pa.array(d[some]), at], names=["m", "d", "at"])

    return run


def repeated(keyed: DataFrame, outline: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(key, at): per distinct text with repeated windows the runs (first, last) of their first words."""
    own = outline.select("row", F.explode(F.arrays_zip("m", "d", "s", "e")).alias("x")).select("row", "x.*")
    twice = durable(own.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m"), "substring-anchors")
    met = durable(own.join(twice, "m"), "substring-met")
    distinct = durable(met.groupBy("m", "d").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "s", "e")).alias("x")).select("m", "d", "c", "x.*"), "substring-distinct")
    many = durable(distinct.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("m"), "substring-hot")
    tamed, cut_up = distinct.withColumn("by", F.col("m")), None
    if many.limit(1).count():
        cut_up = durable(_windows(keyed, outline, distinct.join(many, "m"), span), "substring-windows")
        ones = cut_up.groupBy("m", "w").agg(F.sum("c").alias("c"), F.min(F.struct("row", F.col("s").cast("int").alias("s"))).alias("x"))
        ones = ones.select("m", F.col("w").alias("d"), "c", "x.row", "x.s", F.col("x.s").alias("e"), F.col("w").alias("by"))
        tamed = durable(tamed.join(many, "m", "left_anti").unionByName(ones), "substring-tamed")
    words = tamed.agg(F.sum(F.col("e") - F.col("s") + span)).first()[0] or 0
    shards = -(-words // shard) or 1

    def run(batches):
        import pyarrow as pa

        for text, a, b, m, d, c, _ in _once(batches):
            size = b - a + span
            at = np.arange(size.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(d), pa.array(c), _listed(pa, text.codes[at].view(np.int64), size, pa.int64())], ["m", "d", "c", "codes"])

    coded = _cut(keyed, outline, tamed, run, "m bigint, d bigint, c bigint, codes array<bigint>")
    by = coded.withColumn("by", F.col("m"))
    if cut_up is not None:  # windows go by their own hash
        by = coded.join(many.withColumn("hot", F.lit(True)), "m", "left").withColumn("by", F.when(F.col("hot"), F.col("d")).otherwise(F.col("m"))).drop("hot")
    found = durable(by.groupBy(F.pmod(F.xxhash64("by"), F.lit(shards)).alias("shard")).applyInArrow(_shard(span), f"m bigint, d bigint, at {_RUNS}"), "substring-found")
    if cut_up is not None:
        single = cut_up.select("m", "d", "w", "at").join(found.select("m", F.col("d").alias("w")), ["m", "w"])
        found = found.join(many, "m", "left_anti").unionByName(single.select("m", "d", F.array(F.struct(F.col("at").cast("int").alias("s"), F.col("at").cast("int").alias("e"))).alias("at")))
    places = met.select("row", "m", "d", "s").join(found, ["m", "d"]).select("row", F.transform("at", lambda x: F.struct((x["s"] + F.col("s")).alias("s"), (x["e"] + F.col("s")).alias("e"))).alias("at"))
    per_row = places.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"))  # a document's own
    return per_row.join(outline.select("row", "key"), "row").groupBy("key").agg(F.min("at").alias("at"))


def _trimmed(keyed: DataFrame, flagged: DataFrame, span: int, how: str) -> DataFrame:
    """(_id, n_words, n_removed, kept): texts without the words of their repeated windows; how: join with flagged."""
    kind = keyed.schema["_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = batch.column(2).slice(i, j - i)
                base, n = np.repeat(words.before[:-1], cut.value_lengths().to_numpy()), len(words.codes) + 1
                first, last = (x.to_numpy(zero_copy_only=False) + base for x in cut.flatten().flatten())
                marks = np.bincount(first, minlength=n) - np.bincount(last + span, minlength=n)
                gone = np.cumsum(marks[:-1]) > 0
                counts = [np.bincount(o, minlength=j - i) for o in (words.owner, words.owner[gone])]
                kept = pa.array([t.decode() for t in words.joined(~gone)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, counts), kept], ["_id", "n_words", "n_removed", "kept"])

    joined = keyed.join(flagged.hint("merge"), "key", how).select("_id", "_text", F.coalesce("at", F.array().cast(_RUNS)).alias("at"))
    return in_arrow(joined, run, f"_id {kind}, n_words bigint, n_removed bigint, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, **options) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    keyed, spark = _keyed(docs, id_col, text_col), docs.sparkSession
    with freed_shuffles(spark), scratch(spark) as keep:
        outline = durable(outlines(keyed, span, gram), "substring-outline")
        flagged = keep(repeated(keyed, outline, span, gram, **options), "substring-flagged")
    return _trimmed(keyed, flagged, span, "left").withColumnRenamed("_id", id_col)


def substring_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, **options) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256."""
    keyed, spark = _keyed(docs, id_col, text_col), docs.sparkSession
    with freed_shuffles(spark), scratch(spark) as keep:
        outline = durable(outlines(keyed, span, gram), "substring-outline")
        flagged = keep(repeated(keyed, outline, span, gram, **options), "substring-flagged")
        whole = outline.join(flagged.select("key"), "key", "left_anti").select("_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("whole").alias("kept_sha256"))
        whole = keep(whole, "substring-whole")
    changed = _trimmed(keyed, flagged, span, "inner").select("_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
    return whole.unionByName(changed).withColumnRenamed("_id", id_col)


ORACLE = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS MATERIALIZED (SELECT r, i, array_to_string(ws[i : i + {SPAN - 1}], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM w WHERE len(ws) >= {SPAN})),
g AS (SELECT DISTINCT r, i + k AS p FROM x, (SELECT unnest(range({SPAN})) AS k) WHERE win IN (SELECT win FROM x GROUP BY win HAVING count(*) > 1)),
o AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM o ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""
