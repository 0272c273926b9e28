"""Cross-tokenizer alignment: where tokens of a byte-level BPE (A) and of a sentence-piece model (B) end together.

align() is relational: tokens are exploded with their positions, a window adds up their byte
lengths to ends, A and B meet by text and end, a running count of the ends they share (the cuts)
numbers the groups, and links are the pairs that end together. Links counted over
the whole corpus give each pair its weight.

aligned_documents() puts documents through it without a row for every token of the corpus. Both
tokenizers always end a token before a space that follows a character which is no white space:
no match of A's pattern and no piece of B's vocabulary crosses that place (B's is looked through;
of another model whole texts are taken). So the text between such places is aligned once for the
corpus, however often it occurs, and counts with its occurrences:
1. A task splits the texts of a block of documents and writes their distinct parts, numbered, with
   their counts, and every document as the numbers of its parts.
2. Equal parts of all blocks meet in an aggregation, one row a block, and are aligned.
3. The parts' results go back to their blocks, and each document adds up and joins its parts'.
A part that fills half of the corpus is one row a block, so no key is hot by its occurrences.

Defined cases: A text that is null, empty, or whose tokens don't spell it (one with a U+2581, which
B takes as a space) has zeros, '' and no part in the counts; so has a table without rows no rows.
Repeated rows and ids count as often as they come, null ids too; other columns are ignored. Parts
and blocks are as long as their text: one text longer than BLOCK is a block of its own.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import chunks, durable, give_back, in_arrow, scratch, text_bytes, text_of
from runlens.storage import freed_shuffles

#: Bytes of text in a block of documents.
BLOCK = 1 << 25
#: Texts that go to the tokenizers at once.
AT_ONCE = 4096
_SPLIT = re.compile(r"(?<=\S)(?= )")
#: What a text must not have to be cut at every space.
_ROUGH = tuple(c + " " for c in map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _unicode_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 characters as themselves, other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """Token bytes by id: encode() gives (ids, offsets of texts), spelt() the bytes of ids."""

    def _table(self, entries: list[bytes]) -> None:
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(entries), dtype=np.uint8)

    @staticmethod
    def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.concatenate([np.asarray(x, dtype=np.int32) for x in lists] or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(sizes)])

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        size = self.lengths[ids]
        sums = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.at[ids] - sums[:-1], size) + np.arange(sums[-1])]


class ByteLevel(Side):
    """A: tokenizers file; encodes a space and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        byte = _unicode_bytes()
        vocab = self.model.get_vocab(with_added_tokens=False)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(byte[c] for c in token)
        self._table(entries)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)])


class Pieces(Side):
    """B: sentence-piece model, which puts the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self._table([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat(self.model.encode(texts, num_threads=1))


@functools.cache
def _sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def separable(path_a: str, path_b: str) -> bool:
    """Whether no token crosses the places that parts() splits at; looked up in the two files."""
    from sentencepiece import sentencepiece_model_pb2

    a = json.load(open(path_a, encoding="utf-8"))
    b = sentencepiece_model_pb2.ModelProto()
    b.ParseFromString(open(path_b, "rb").read())
    before = a.get("pre_tokenizer") or {}
    own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not a.get("normalizer")
    spec = b.normalizer_spec
    whole = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not b.trainer_spec.treat_whitespace_as_suffix
    return bool(own and whole and not any(re.search("[^▁]▁", p.piece) for p in b.pieces))


def parts(text: str) -> list[str]:
    """text cut before spaces that follow no white space; each part without that space, so " ".join(parts) is text."""
    if not (text.startswith(" ") or text.endswith(" ") or any(x in text for x in _ROUGH)):
        return text.split(" ")
    cut = _SPLIT.split(" " + text)
    if len(cut) > 1 and cut[-1] == " ":  # B puts no space before an empty text
        cut[-2:] = [cut[-2] + " "]
    return [c[1:] for c in cut]


def _spells(side: Side, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> np.ndarray:
    """Whether the tokens of each text spell a space and the text."""
    want = [b" " + t.encode() for t in texts]
    sizes = np.fromiter(map(len, want), np.int64, len(want))
    got, size = side.spelt(ids), side.lengths[ids]
    have = np.concatenate([[0], np.cumsum(size)])[at]
    if np.array_equal(np.diff(have), sizes) and np.array_equal(got, np.frombuffer(b"".join(want), dtype=np.uint8)):
        return np.ones(len(texts), dtype=bool)
    got = got.tobytes()
    return np.fromiter((got[have[i] : have[i + 1]] == w for i, w in enumerate(want)), bool, len(want))


def _encoded(side: Side, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of texts). joined: texts that end in no white space are encoded as one, cut where no token crosses."""
    one = np.fromiter((joined and t != "" and not t[-1].isspace() for t in texts), bool, len(texts))
    together = [t for t, o in zip(texts, one.tolist(), strict=True) if o]
    ids, _ = side.encode([" ".join(together)] if together else [])
    ends = np.cumsum(np.fromiter((len(t.encode()) + 1 for t in together), np.int64, len(together)))
    sums = np.cumsum(side.lengths[ids])
    at = np.searchsorted(sums, ends)
    if len(ends) and (len(sums) == 0 or sums[-1] != ends[-1] or not np.array_equal(sums[at], ends)):
        return side.encode(texts)
    rest, rest_at = side.encode([t for t, o in zip(texts, one.tolist(), strict=True) if not o])
    sizes = np.zeros(len(texts), dtype=np.int64)
    sizes[one], sizes[~one] = np.diff(at + 1, prepend=0), np.diff(rest_at)
    out = np.zeros(int(sizes.sum()), dtype=np.int32)
    own = np.repeat(one, sizes)
    out[own], out[~own] = ids, rest
    return out, np.concatenate([[0], np.cumsum(sizes)])


def tokenised(texts: DataFrame, paths: tuple[str, str] | None = None, joined: bool = False) -> DataFrame:
    """(key, n, tokens array<struct<b: boolean, id: int, size: int>>) of texts (key bigint, text string, n bigint).

    The tokens of A, then those of B, with their bytes; none where they don't spell the text.
    """
    path_a, path_b = paths or default_paths()

    def encoded(batches):
        import pyarrow as pa

        sides = _sides(path_a, path_b)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(i, AT_ONCE)
                words = [w or "" for w in rows.column(1).to_pylist()]
                found = [_encoded(side, words, joined) for side in sides]
                ok = np.fromiter((w != "" for w in words), bool, len(words))
                for side, (ids, at) in zip(sides, found, strict=True):
                    ok &= _spells(side, ids, at, words)
                sizes = [np.where(ok, np.diff(at), 0) for _, at in found]
                total = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
                second, ids, lengths = np.zeros(total[-1], dtype=bool), np.zeros(total[-1], dtype=np.int32), np.zeros(total[-1], dtype=np.int32)
                for b, (side, (own, at)) in enumerate(zip(sides, found, strict=True)):
                    own = own[np.repeat(ok, np.diff(at))]
                    first = total[:-1] + b * sizes[0]
                    place = np.arange(len(own)) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes[b])[:-1]]), sizes[b])
                    second[place], ids[place], lengths[place] = bool(b), own, side.lengths[own]
                tokens = pa.StructArray.from_arrays([pa.array(second), pa.array(ids), pa.array(lengths)], ["b", "id", "size"])
                lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), tokens)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), lists], ["key", "n", "tokens"])

    def run(batches):
        try:
            yield from encoded(batches)
        finally:  # later stages work in the same processes, without the models
            _sides.cache_clear()

    return in_arrow(texts.select("key", "text", "n"), run, "key bigint, n bigint, tokens array<struct<b: boolean, id: int, size: int>>")


def _ids(column: str):
    """The ids of a group in the order of their ends, joined by commas."""
    got = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("end", column))))
    return F.concat_ws(",", F.transform(got, lambda t: t[column].cast("string")))


def grouped(tokens: DataFrame) -> DataFrame:
    """(key, n, n_a, n_b, groups, links array<struct<a, b>>) of tokenised texts.

    Texts are dealt out once, as arrays; explode, both windows, the join by text and end and the
    groups all keep to that. The join is an aggregation, as an end has one token a side: it needs
    no second shuffle.
    """
    rows = tokens.repartition("key").select("key", "n", F.posexplode("tokens").alias("pos", "t")).select("key", "n", "pos", "t.*")
    so_far = Window.partitionBy("key", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum("size").over(so_far))
    met = ends.groupBy("key", "n", "end").agg(F.max(F.when(~F.col("b"), F.col("id"))).alias("a_id"), F.max(F.when(F.col("b"), F.col("id"))).alias("b_id"))
    link = F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    before = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    numbered = met.withColumn("link", link).withColumn("group", F.coalesce(F.count("link").over(before), F.lit(0)))
    groups = numbered.groupBy("key", "n", "group").agg(
        F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"), F.concat(_ids("a_id"), F.lit("|"), _ids("b_id")).alias("ids"), F.max("link").alias("link"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("group", "ids", "link")))
    told = groups.groupBy("key", "n").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), ordered.alias("g"))
    return told.select("key", "n", "n_a", "n_b", F.array_join("g.ids", ";").alias("groups"), F.col("g.link").alias("links"))


def align(texts: DataFrame, paths: tuple[str, str] | None = None, joined: bool = False) -> DataFrame:
    """(text, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of distinct texts (key, text, n occurrences); those without tokens are left out.

    Tokens have at least one byte, so an end has one token a side and a group has one link, at its end.
    """
    with scratch(texts.sparkSession) as keep:
        told = durable(grouped(tokenised(texts, paths, joined)), "align-told")
        links = told.select("key", "n", F.explode("links").alias("l")).select("key", "n", "l.*")
        pairs = durable(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "align-pairs")
        highest = pairs.groupBy("b").agg(F.max("count").alias("most"))
        ranked = pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))
        sums = links.drop("n").join(ranked, ["a", "b"]).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        every = told.join(sums, "key").withColumn("n_groups", F.size("links").cast("bigint")).select("key", *COUNTS, "groups")
        return keep(every.join(texts.select("key", "text"), "key").drop("key"), "aligned")  # rows of tokens don't carry their text


def factored(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], separate: bool, block: int = BLOCK) -> DataFrame:
    """Rows (block, id, parts) of documents and (block, slot, part, n) of the distinct parts of their block's spelt texts."""
    path_a, path_b = paths
    source = docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def split(text: str) -> list[str]:
        if separate:  # such a model spells what it is given, but for its own sign of a space
            return parts(text) if text and "▁" not in text else []
        side = _sides(path_a, path_b)[1]
        return [text] if text and _spells(side, *side.encode([text]), [text])[0] else []

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"block": pa.int64(), "_id": None, "parts": pa.list_(pa.int32()), "slot": pa.int32(), "part": pa.string(), "n": pa.int64()}

        def tagged(number: int, size: int, **columns):
            columns["block"] = pa.array(np.full(size, number))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in kinds.items()], list(kinds))

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            kinds["_id"] = batch.column(0).type
            _, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, block):
                numbers = defaultdict(itertools.count().__next__)  # numbers for parts, in order of first sight
                rows = [np.fromiter(map(numbers.__getitem__, split(t.as_py())), np.int32) for t in batch.column(1).slice(i, j - i)]
                found, flat = list(numbers), np.concatenate(rows)
                del numbers
                n = np.bincount(flat, minlength=len(found))
                at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
                yield tagged(made, j - i, _id=batch.column(0).slice(i, j - i), parts=pa.ListArray.from_arrays(at, pa.array(flat)))
                for a in range(0, len(found), 1 << 16):
                    some = found[a : a + (1 << 16)]
                    yield tagged(made, len(some), slot=pa.array(np.arange(a, a + len(some), dtype=np.int32)), part=pa.array(some, pa.string()), n=pa.array(n[a : a + (1 << 16)]))
                made += 1

    return in_arrow(source, run, f"block bigint, _id {kind}, parts array<int>, slot int, part string, n bigint")


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths, spark = paths or default_paths(), docs.sparkSession
    with freed_shuffles(spark), scratch(spark) as keep:
        rows = keep(factored(docs, id_col, text_col, paths, separate := separable(*paths), block), "align-factored")
        slots = rows.filter("part IS NOT NULL").select("block", "slot", "part", "n")
        distinct = slots.groupBy("part").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("key"), F.col("part").alias("text"), "n")
        distinct = durable(distinct, "align-parts")
        told = align(distinct, paths, joined=separate)
        back = keep(slots.select("block", "slot", F.col("part").alias("text")).join(told, "text").drop("text"), "align-back")
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", *COUNTS, "groups_sha256"]

    def joined(left, right):
        import pyarrow as pa

        slot = right.column("slot").to_numpy().astype(np.int64)
        lists = left.column("parts").combine_chunks()
        flat, counts = lists.flatten().to_numpy(), np.asarray(lists.value_lengths())
        size = int(max(slot.max(initial=-1), flat.max(initial=-1))) + 1
        groups = np.full(size, "", dtype=object)
        groups[slot] = right.column("groups").to_pylist()
        at = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for c in COUNTS:
            values = np.zeros(size, dtype=np.int64)
            values[slot] = right.column(c).to_numpy()
            sums = np.concatenate([[0], np.cumsum(values[flat])])
            out.append(pa.array(sums[at[1:]] - sums[at[:-1]]))
            del values, sums
        ends = at.tolist()
        sha = [hashlib.sha256(";".join(groups[flat[a:b]]).encode()).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:], strict=False)]
        told = pa.table([left.column("_id").combine_chunks(), *out, pa.array(sha, pa.string())], names=names)
        del groups, flat, lists
        give_back()
        return told

    documents = rows.filter("parts IS NOT NULL").select("block", "_id", "parts")
    schema = f"_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, groups_sha256 string"
    out = documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(joined, schema)
    return out.withColumnRenamed("_id", id_col)
