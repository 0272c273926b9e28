"""Word counts of large text tables: counted next to the texts, so that terms, not occurrences, are exchanged.

Texts go in blocks of about BLOCK bytes, and terms in slots by their hash. A block sends each slot its terms
there as one text, in an order that the block's texts alone fix; a slot adds up what the blocks
sent. For weights the slots send the counts of documents back in that same order, without the terms,
and the block, put together again from the same texts, forms its documents' weights and lengths. No
exchange moves the single entries of documents, and a term that every text has is one entry a block.

For searches (Postings.best) a block keeps its documents as lists of its own numbers of terms, written once.

Rows of one id are one text, whose word pairs do not reach from row to row; null is an id.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import tokens
from runlens.storage import durable

#: Bytes of words that are counted at once.
BLOCK = 1 << 23
#: Entries of documents that meet queries at once.
MEETING = 1 << 22
#: Columns of what a block sends a slot: its terms as lines of one packed text of so many bytes. Their counts follow.
SENT = "slot int, size int, terms binary"
#: Between the words of rows with one id.
BREAK = "\n"


def repeated(rows: DataFrame, id_col: str) -> bool:
    """Whether an id has more than one row."""
    return bool(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())


def measured(rows: DataFrame, id_col: str, text_col: str) -> tuple[int, int, bool]:
    """(rows, blocks that their texts fill, whether an id has more than one row)."""
    ids = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes"))
    n, size, most = ids.agg(F.sum("n"), F.sum("bytes"), F.max("n")).first()
    return n or 0, max(1, -(-(size or 0) // BLOCK)), (most or 0) > 1


def merged(rows: DataFrame, id_col: str, text_col: str, again: bool | None = None) -> DataFrame:
    """(id, words): the words of each id, joined by spaces; rows are put together only where an id has more than one (again, if known)."""
    words = rows.select(id_col, F.array_join(tokens(F.col(text_col)), " ").alias("words"))
    if repeated(rows, id_col) if again is None else again:
        return words.groupBy(id_col).agg(F.array_join(F.collect_list("words"), f" {BREAK} ").alias("words"))
    return words


def pieces(batches):
    """(ids, words) of about BLOCK bytes, or one text that is longer."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        ids, words = batch.column(0), batch.column(1).cast(pa.large_string())
        at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK - size, side="right")) - 1)
            held.append((ids.slice(i, j - i), words.slice(i, j - i)))
            size += int(at[j] - at[i])
            i = j
            if size >= BLOCK or i < len(words):
                yield pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
                held, size = [], 0
    if held:
        yield pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])


def _counted(words, single: bool, pairs: bool, slots: int = 1):
    """(terms, where each slot's terms begin, code of each occurrence, row of each occurrence) of texts of joined words.

    The terms are in order of their slots, and of their words in a slot, whatever the order of the texts.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(words, " ")
    row = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    own, rank = coded.dictionary.take(order), np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    w = rank[coded.indices.to_numpy(zero_copy_only=False)]
    del lists, coded
    real = ~pc.is_in(own, pa.array(["", BREAK], own.type)).to_numpy(zero_copy_only=False)[w]
    keys, rows, base = [], [], len(own) + 1
    if single:
        keys.append(w[real] * np.int64(base))
        rows.append(row[real])
    if pairs:
        near = real[:-1] & real[1:] & (row[:-1] == row[1:])
        keys.append(w[:-1][near] * np.int64(base) + w[1:][near] + 1)
        rows.append(row[:-1][near])
    del w, row, real
    if pairs:
        del near
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    key, inverse = np.unique(keys, return_inverse=True)  # sorted: a hash table of them would take several times the memory
    del keys
    first, second = np.divmod(key, base)
    hashes = np.fromiter(map(zlib.crc32, own.cast(pa.large_binary()).to_pylist()), np.uint64, len(own))
    mixed = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + np.append(np.uint64(0), hashes)[second] * np.uint64(0xC2B2AE3D27D4EB4F)
    slot = ((mixed >> np.uint64(32)) % np.uint64(slots)).astype(np.int32)
    order = np.argsort(slot, kind="stable")
    place = np.empty(len(key), dtype=np.int32)
    place[order] = np.arange(len(key), dtype=np.int32)
    code, at = place[inverse], np.searchsorted(slot[order], np.arange(slots + 1))
    first, second = first[order], second[order]
    del inverse, key, mixed, slot, order, place
    terms = pc.binary_join_element_wise(own.take(pa.array(first)), own.take(pa.array(np.maximum(second - 1, 0), mask=second == 0)), pa.scalar(" ", own.type), null_handling="skip")
    del own, first, second
    pa.default_memory_pool().release_unused()
    return terms, at, code, rows


def _entries(row, code, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf) of occurrences, by row and code."""
    entry, tf = np.unique(row * np.int64(max(terms, 1)) + code, return_counts=True)
    return *np.divmod(entry, max(terms, 1)), tf


def _sent(terms, at, counts: dict, **more: int):
    """A row a slot that has terms (SENT): its terms as lines of one text, packed, and their counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    has = np.flatnonzero(np.diff(at))
    ends = np.append(at[has], len(terms)).astype(np.int32)
    for i in range(0, len(has), 64):
        some, inner = ends[i : i + 65], slice(ends[i], ends[min(i + 64, len(has))])
        offsets = pa.array(some - some[0])
        lines = pc.binary_join(pa.ListArray.from_arrays(offsets, terms[inner]), pa.scalar(BREAK, terms.type)).cast(pa.large_binary())
        size, packed = pa.array([len(x.as_buffer()) for x in lines], pa.int32()), pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) for x in lines], pa.binary())
        same = {k: pa.array(np.full(len(lines), v, dtype=np.int32)) for k, v in more.items()}
        lists = {k: pa.ListArray.from_arrays(offsets, pa.array(v[inner].astype(np.int32))) for k, v in counts.items()}
        yield pa.RecordBatch.from_pydict({"slot": pa.array(has[i : i + 64].astype(np.int32)), "size": size, "terms": packed, **same, **lists})


def _received(table):
    """(distinct terms, code of each term sent, terms of each row) of the rows of one slot."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lines = [pa.decompress(x.as_buffer(), n.as_py(), "zstd", asbytes=True) for x, n in zip(table["terms"], table["size"])]
    lists = pc.split_pattern(pa.array(lines, pa.large_string()), BREAK)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _numbers(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _table(columns: dict):
    """columns as a table of batches of 65,536 rows."""
    import pyarrow as pa

    whole = pa.table(columns)
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(whole.to_batches(max_chunksize=1 << 16), whole.schema)


def totals(rows: DataFrame, id_col: str, text_col: str, single: bool = True, pairs: bool = True) -> DataFrame:
    """(term, n, df) of words, word pairs or both: occurrences, and ids that have the term."""
    _, slots, again = measured(rows, id_col, text_col)

    def run(batches):
        for _, words in pieces(batches):
            terms, at, code, row = _counted(words, single, pairs, slots)
            n = np.bincount(code, minlength=len(terms))
            df = np.bincount(_entries(row, code, len(terms))[1], minlength=len(terms))
            yield from _sent(terms, at, {"n": n, "df": df})

    def add(table):
        import pyarrow as pa

        terms, code, _ = _received(table)
        n, df = (pa.array(np.bincount(code, _numbers(table[c]), len(terms)).astype(np.int64)) for c in ("n", "df"))
        return _table({"term": terms.cast(pa.string()), "n": n, "df": df})

    sent = merged(rows, id_col, text_col, again).mapInArrow(run, f"{SENT}, n array<int>, df array<int>")
    return sent.groupBy("slot").applyInArrow(add, "term string, n bigint, df bigint")


class Postings:
    """Words and word pairs of a table (id, text) in blocks; for searches they are written once."""

    def __init__(self, rows: DataFrame, id_col: str, text_col: str):
        self.id = rows.schema[id_col].dataType.simpleString()
        self.documents, self.blocks, again = measured(rows, id_col, text_col)
        self.words = merged(rows, id_col, text_col, again).withColumnRenamed(id_col, "id")

    @cached_property
    def _written(self) -> tuple[DataFrame, DataFrame]:
        """Per id its codes and tf; and per term of a block its code, the term and the ids that have it. No two blocks share an id."""

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 32
            names = ["block", "id", "codes", "tfs", "code", "term", "n"]
            for ids, words in pieces(batches):
                terms, _, code, row = _counted(words, True, True)
                row, code, tf = _entries(row, code, len(terms))
                at = np.searchsorted(row, np.arange(len(ids) + 1))
                n = np.bincount(code, minlength=len(terms))
                for i in range(0, len(ids), 1000):
                    part = at[i : i + 1001]
                    offsets, inner = pa.array((part - part[0]).astype(np.int32)), slice(part[0], part[-1])
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[inner].astype(np.int32))) for x in (code, tf)]
                    m = len(part) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), ids.slice(i, m), *lists, pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names)
                for i in range(0, len(terms), 1 << 16):
                    some = terms.slice(i, 1 << 16).cast(pa.string())
                    m = len(some)
                    nulls = [pa.nulls(m, ids.type), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), *nulls, pa.array(np.arange(i, i + m, dtype=np.int32)), some, pa.array(n[i : i + m])], names)
                block += 1

        schema = f"block bigint, id {self.id}, codes array<int>, tfs array<int>, code int, term string, n bigint"
        written = durable(self.words.mapInArrow(run, schema), "postings")
        again = self.words.sparkSession.read.schema(written.schema).parquet(written._runlens_path)  # columns of its own, for the cogroup
        return written.filter("code IS NULL").select("block", "id", "codes", "tfs"), again.filter("code IS NOT NULL").select("block", "code", "term", "n")

    @property
    def entries(self) -> DataFrame:
        return self._written[0]

    @property
    def terms(self) -> DataFrame:
        return self._written[1]

    def _idf(self, df):
        return F.log((F.lit(1.0) + self.documents) / (F.lit(1.0) + df)) + 1

    def _idfs(self) -> DataFrame:
        """(block, code, term, idf): a term has a row a block, whatever the number of documents that have it."""
        df = F.sum("n").over(Window.partitionBy("term"))
        return self.terms.select("block", "code", "term", self._idf(df).alias("idf"))

    def weighed(self, rows: DataFrame) -> DataFrame:
        """(id, term, w) of other counts (id, term, tf): tf * idf at length 1 per id; terms that no document has go."""
        wanted = rows.select("term").distinct()
        df = self.terms.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        raw = rows.join(df, "term").select("id", "term", (F.col("tf") * self._idf(F.col("df"))).alias("r"))
        return raw.select("id", "term", (F.col("r") / F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("id")))).alias("w"))

    def weights(self) -> DataFrame:
        """(id, term, w): tf * idf at length 1 per id. Nothing is written; ids are dealt to blocks by their hash."""
        documents, slots = self.documents, self.blocks

        def send(table):
            import pyarrow as pa

            terms, at, code, row = _counted(table["words"].cast(pa.large_string()).combine_chunks(), True, True, slots)
            n = np.bincount(_entries(row, code, len(terms))[1], minlength=len(terms))
            schema = pa.schema({"slot": pa.int32(), "size": pa.int32(), "terms": pa.binary(), "block": pa.int32(), "n": pa.list_(pa.int32())})
            return pa.Table.from_batches(_sent(terms, at, {"n": n}, block=table["block"][0].as_py()), schema)

        def answer(table):
            import pyarrow as pa

            terms, code, lengths = _received(table)
            df = np.bincount(code, _numbers(table["n"]), len(terms)).astype(np.int64)[code]
            return _table({"block": table["block"], "slot": table["slot"], "df": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(df))})

        def run(key, docs, dfs):
            import pyarrow as pa

            terms, _, code, row = _counted(docs["words"].cast(pa.large_string()).combine_chunks(), True, True, slots)
            df = _numbers(dfs.sort_by("slot")["df"]) if len(dfs) else np.zeros(0)
            assert len(df) == len(terms), "a block's terms have changed on the way"
            row, code, tf = _entries(row, code, len(terms))
            raw = tf * (np.log((1.0 + documents) / (1.0 + df)) + 1)[code]
            w = raw / np.sqrt(np.bincount(row, raw * raw, len(docs)))[row]
            return _table({"id": docs["id"].combine_chunks().take(pa.array(row)), "term": terms.take(pa.array(code)).cast(pa.string()), "w": pa.array(w)})

        words = self.words.select(F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int").alias("block"), "id", "words")
        sent = words.groupBy("block").applyInArrow(send, f"{SENT}, block int, n array<int>")
        dfs = sent.groupBy("slot").applyInArrow(answer, "block int, slot int, df array<bigint>")
        return words.groupBy("block").cogroup(dfs.groupBy("block")).applyInArrow(run, f"id {self.id}, term string, w double")

    def best(self, queries: DataFrame, k: int = 1, digits: int = 6) -> DataFrame:
        """(query, id, score, rank): the k ids of the largest cosine per query (id, term, w), ties to the least id.

        The queries' terms go to all tasks; a block sends its k best per query and no more.
        """
        rows = queries.toArrow()
        names, query = np.unique(rows["id"].to_numpy(), return_inverse=True)
        numbers = rows["term"].unique()
        term = {t: i for i, t in enumerate(numbers.to_pylist())}
        spark = queries.sparkSession
        number = np.array([term[t] for t in rows["term"].to_pylist()], dtype=np.int64)
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(term) + 1))
        held = spark.sparkContext.broadcast((names, query[order], rows["w"].to_numpy()[order], starts))
        known = spark.createDataFrame(list(term.items()), "term string, number int")

        def run(key, entries, terms):
            import pyarrow as pa

            names, query, q, starts = held.value
            at, code, w = _weights(entries, terms)
            number = np.full(len(terms), -1, dtype=np.int64)
            number[terms["code"].to_numpy()] = terms["number"].fill_null(-1).to_numpy()
            ids = entries["id"].to_numpy()
            row = np.repeat(np.arange(len(entries)), np.diff(at))
            asked = number[code] >= 0
            row, number, w = row[asked], number[code][asked], w[asked]
            many = np.diff(starts)[number]
            so_far = np.concatenate([[0], np.cumsum(many)])
            value, who = np.full((len(names), k), -np.inf), np.zeros((len(names), k), dtype=np.int64)
            i = 0
            while i < len(row):
                # whole documents, as many as meet about MEETING entries of queries
                j = max(i + 1, int(np.searchsorted(so_far, so_far[i] + MEETING, side="right")) - 1)
                j = int(np.searchsorted(row, row[j - 1], side="right")) if j >= len(row) or row[j] != row[j - 1] else max(int(np.searchsorted(row, row[j], side="left")), int(np.searchsorted(row, row[i], side="right")))
                base, docs = row[i], row[j - 1] - row[i] + 1
                n = many[i:j]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[number[i:j]], n)
                score = np.bincount(query[place] * docs + np.repeat(row[i:j] - base, n), q[place] * np.repeat(w[i:j], n), len(names) * docs).reshape(len(names), docs)
                score = np.where(score > 0, np.round(score, digits), -np.inf)
                score = np.concatenate([value, score], axis=1)
                near = np.concatenate([who, np.broadcast_to(ids[base : base + docs], (len(names), docs))], axis=1)
                best = np.lexsort((near, -score), axis=1)[:, :k]
                value, who = np.take_along_axis(score, best, axis=1), np.take_along_axis(near, best, axis=1)
                i = j
            ok = np.isfinite(value)
            return pa.table({"query": pa.array(np.broadcast_to(names[:, None], ok.shape)[ok]), "id": pa.array(who[ok]), "score": pa.array(value[ok])})

        idfs = self._idfs().join(known, "term", "left").select("block", "code", "idf", "number")
        schema = f"query {queries.schema['id'].dataType.simpleString()}, id {self.id}, score double"
        found = self.entries.groupBy("block").cogroup(idfs.groupBy("block")).applyInArrow(run, schema)
        first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(first).cast("bigint")).filter(F.col("rank") <= k)


def _weights(entries, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each id's entries begin, codes, weights at length 1 per id) of a block."""
    idf = np.empty(len(terms))
    idf[terms["code"].to_numpy()] = terms["idf"].to_numpy()
    codes, tfs = (entries[c].combine_chunks() for c in ("codes", "tfs"))
    at = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    code = codes.flatten().to_numpy().astype(np.int64)
    raw = tfs.flatten().to_numpy() * idf[code]
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(entries)), np.diff(at)), raw * raw, len(entries)))
    return at, code, raw / np.repeat(length, np.diff(at))
