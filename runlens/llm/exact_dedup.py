"""Exact deduplication by deterministic block naming (native DataFrame operations only).

Texts are cut into fixed-size byte blocks. Distinct blocks are sorted and named by integers;
then neighbouring names are paired and the distinct pairs named again, until each document
has one name. Two texts have the same (level, name) exactly if they are the same bytes: a
name stands for one byte string only, at its level.

What moves: every distinct block once (equal blocks meet in a map-side aggregation first),
afterwards only integers. Names are joined back by a 64-bit block hash; blocks whose hash
is shared with a different block get their names from a join on the bytes themselves.

Defined results: a null text is the empty text (one empty block). Of equal texts the row
with the largest doc_id stays (a null doc_id is the smallest); of rows that repeat both
doc_id and text one stays. Extra columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, scratch, text_of

BLOCK_BYTES = 8192


def _blocks(docs: DataFrame, block_bytes: int) -> Column:
    data = F.col("_bytes")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(block_bytes))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: data.substr(i * block_bytes + 1, F.lit(block_bytes)))


def _named(pairs: DataFrame, *keys: str) -> DataFrame:
    """One integer per distinct key, by the sorted order within each hash partition."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).sortWithinPartitions(*keys).withColumn("_name", F.monotonically_increasing_id())


def text_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(_row, id, text_sha256, _level, _name) per row of docs; hash_bits under 64 is for tests of hash collisions."""
    source = docs.select(F.col(id_col).alias("_id"), F.encode(text_of(text_col), "UTF-8").alias("_bytes"))
    block_hash = lambda b: F.xxhash64(b) if hash_bits >= 64 else F.pmod(F.xxhash64(b), F.lit(1 << hash_bits))
    rows = durable(
        source.select(
            F.monotonically_increasing_id().alias("_row"),
            "_id",
            F.sha2("_bytes", 256).alias("text_sha256"),
            F.transform(_blocks(source, block_bytes), block_hash).alias("_hashes"),
        ),
        "dedup-rows",
    )
    cut = source.select(F.explode(_blocks(source, block_bytes)).alias("_block")).withColumn("_hash", block_hash(F.col("_block")))
    names = durable(_named(cut, "_hash", "_block").select("_hash", "_name"), "dedup-blocks")
    shared = durable(names.groupBy("_hash").agg(F.count(F.lit(1)).alias("_blocks"), F.min("_name").alias("_name")), "dedup-shared")

    flat = rows.select("_row", F.size("_hashes").alias("_size"), F.posexplode("_hashes").alias("_at", "_hash"))
    level = flat.join(shared, "_hash")
    if shared.filter("_blocks > 1").limit(1).count():
        level = _with_collisions(source, rows, level, shared, block_bytes, block_hash)
    level = level.select("_row", "_size", "_at", "_name")

    done, depth = [], 0
    longest = rows.agg(F.max(F.size("_hashes"))).first()[0] or 1
    while True:
        done.append(level.filter("_size = 1").select("_row", F.lit(depth).alias("_level"), "_name"))
        if longest <= 1:
            break
        pairs = durable(
            level.filter("_size > 1")
            .groupBy("_row", "_size", F.expr("_at div 2").alias("_at"))
            .agg(F.max(F.expr("if(_at % 2 = 0, _name, null)")).alias("_left"), F.max(F.expr("if(_at % 2 = 1, _name, null)")).alias("_right"))
            .select("_row", F.expr("cast((_size + 1) div 2 as int)").alias("_size"), "_at", "_left", F.coalesce("_right", F.lit(-1)).alias("_right")),
            f"dedup-pairs-{depth}",
        )
        named = durable(_named(pairs, "_left", "_right").select("_left", "_right", "_name"), f"dedup-names-{depth}")
        level = pairs.join(named, ["_left", "_right"]).select("_row", "_size", "_at", "_name")
        longest, depth = (longest + 1) // 2, depth + 1
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return rows.select("_row", "_id", "text_sha256").join(identity, "_row")


def _with_collisions(source: DataFrame, rows: DataFrame, level: DataFrame, shared: DataFrame, block_bytes: int, block_hash) -> DataFrame:
    """Names by the bytes for blocks whose hash is not theirs alone; negative, so they meet no other name.

    Rows have their numbers from one pass that was written; a second pass could number them
    otherwise. So these blocks find their rows by the text's digest and the block's position.
    """
    twice = shared.filter("_blocks > 1").select("_hash")
    cut = source.select(F.sha2("_bytes", 256).alias("text_sha256"), F.posexplode(_blocks(source, block_bytes)).alias("_at", "_block")).withColumn("_hash", block_hash(F.col("_block")))
    bytes_of = durable(cut.join(twice, "_hash", "left_semi").distinct(), "dedup-collisions")
    own = durable(_named(bytes_of, "_hash", "_block").select("_hash", "_block", (-F.col("_name") - 2).alias("_exact")), "dedup-exact")
    exact = durable(bytes_of.join(own, ["_hash", "_block"]).select("text_sha256", "_at", "_exact"), "dedup-exact-names")
    told = level.join(twice, "_hash", "left_semi").join(rows.select("_row", "text_sha256"), "_row").join(exact, ["text_sha256", "_at"]).select("_row", "_size", "_at", F.col("_exact").alias("_name"))
    return level.join(twice, "_hash", "left_anti").select("_row", "_size", "_at", "_name").union(told)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    with scratch(docs.sparkSession) as keep:
        identity = keep(text_identity(docs, id_col, text_col, block_bytes, hash_bits), "dedup-identity")
    # written first: the join then has exchanges of its own, whose large partitions can be split
    groups = durable(
        identity.groupBy("_level", "_name").agg(
            F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.coalesce(F.max_by("_row", "_id"), F.min("_row")).alias("_keep_row")
        ),
        "dedup-groups",
    )
    return identity.join(groups, ["_level", "_name"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    table = durable(exact_dedup(docs, id_col, text_col, **options).select(F.col(id_col).alias("__runlens_id"), F.col("text_sha256").alias("__runlens_sha"), "kept"), "dedup-table")
    kept = table.filter("kept").select("__runlens_id", "__runlens_sha")
    sha = F.sha2(F.encode(text_of(text_col), "UTF-8"), 256)
    left = docs.join(kept.hint("merge"), docs[id_col].eqNullSafe(F.col("__runlens_id")) & (sha == F.col("__runlens_sha")), "left_semi")
    if not table.groupBy("__runlens_id", "__runlens_sha").count().filter("count > 1").limit(1).count():
        return left
    # some rows repeat both id and text: one of each stays
    return left.withColumn("__runlens_sha", sha).dropDuplicates([id_col, "__runlens_sha"]).drop("__runlens_sha")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
