"""MinHash near-deduplication: SuperMinHash, banding, verification, union-find grouping.

Signatures. Every distinct shingle of a document draws, per rank j = 0, 1, ..., a value
j + u and the place where it goes, the places of one shingle being a random permutation
(Ertl 2017). A place keeps its least value. The correlated ranks give signatures of lower
variance than independent hashes, and a document is done as soon as all of its places hold
values below the next rank. All documents of a chunk advance one rank at a time.

Candidates. ROWS consecutive places make one of BANDS bands; documents that agree in a band
are candidates. At similarity 0.85 a pair is missed with probability (1 - 0.85**5)**25 = 4e-7,
at 0.8 with 5e-5.

Links, without all pairs of a group:
1. Documents with the same shingle set are one class, whatever the number of their rows; from
   here on everything has one row a class.
2. In every bucket the least class is the pivot; only (pivot, member) pairs are confirmed on
   the full sets of both texts, and the confirmed ones joined to components.
3. Classes of buckets whose other members then lie in more than one component are joined by
   prefix filtering, which is exact (Chaudhuri et al. 2006; Xiao et al. 2008): the shingles of
   each are put in one order, rarest first, and of two linked sets the first few of the smaller
   one and the first few of the larger one must meet. A set sends 1 - t of its shingles, and
   what many unlinked texts share stands last in that order and isn't sent. Pairs that meet,
   lie in different components and can still reach the threshold by their sizes, positions and
   256-bit parity maps (no two sets differ less than their maps) are confirmed on the full sets. Near copies that step 2 has joined cost nothing here.
   Before these pairs are formed, sets that share a shingle are tried with the NEXT sets that follow them in
   the order of a quarter of the map: near copies stand together there, and a large group of them, of
   which every second pair may be linked, is joined by a few links a set instead of all. The order
   comes from counts in a table of COUNTERS slots; it decides only how few pairs meet, never
   which are found. No cap, no drop.

What moves: per class BANDS integers; texts only of classes in a candidate pair; the first
shingles of classes in step 3.

Defined results: null, empty and blank texts have no shingles and stand alone; a text with
fewer words than a shingle is one shingle of all its words; repeated rows are linked by
their equal sets; rows that repeat a doc_id with other texts are documents of their own; a
row without doc_id has no component and stays. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import Rolling, chunks, durable, in_arrow, mix64, scratch, text_bytes, text_of
from runlens.llm.components import components

ROWS, BANDS = 5, 25
PLACES = ROWS * BANDS
CHUNK = 1 << 19
#: Pairs of one pivot that a task confirms, about.
SPLIT = 1000
#: Slots of the counts that order shingles, the rarest first.
COUNTERS = 1 << 16
#: Sets that follow a set in the order of a map and are tried with it before all pairs are formed.
NEXT = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, PLACES + 1, dtype=np.uint64) * _GOLD

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, dtype=bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_rolling = Rolling()


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets of each text's hashes): the distinct shingles of each text, ascending."""
    n = len(offsets) - 1
    raw = _lower[raw]
    word = ~_blank[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= word[inner]  # a word ends with its text
    ends[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = _rolling.spans(raw, start, end)
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(text, minlength=n)
    if len(hashes) >= words:
        whole = text[: len(text) - words + 1] == text[words - 1 :]
        grams = np.zeros(len(whole), dtype=np.uint64)
        for k in range(words):
            grams = mix64(grams * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : len(hashes) - words + 1 + k])
        grams, owner = grams[whole], text[: len(whole)][whole]
    else:
        grams, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        at = np.concatenate([[0], np.cumsum(count)])
        short = []
        for d in few:
            h = np.full(1, 0x1234567 + int(count[d]), dtype=np.uint64)
            for x in hashes[at[d] : at[d + 1]]:
                h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + x)
            short.append(h[0])
        grams, owner = np.concatenate([grams, np.array(short, dtype=np.uint64)]), np.concatenate([owner, few])
    order = np.argsort(grams)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[keep], owner[keep]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def super_minhash(grams: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures (documents x places) of uint64: rank in the high 32 bits, fraction in the low ones."""
    n = len(offsets) - 1
    out = np.full(n * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not n or not len(grams):
        return out.reshape(n, places)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    active, seeds, order = owner, grams, None
    for j in range(places):
        draw = mix64(seeds + _STEPS[j])
        pick = j + (((draw >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        if order is None:
            place = pick
        else:
            rows = np.arange(len(active))
            place = order[rows, pick].astype(np.int64)
        np.minimum.at(out, active * places + place, value)
        if j + 1 == places:
            break
        # a place that holds a value below the next rank can't be bettered any more
        going = out.reshape(n, places).max(axis=1) >= np.uint64((j + 1) << 32)
        stay = going[active]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8), (int(stay.sum()), 1))
            rows = np.arange(len(order))
            order[rows, pick[stay]] = order[rows, 0]
        else:
            rows = np.arange(len(order))
            order[rows, pick] = order[rows, j]
            if not stay.all():
                order = order[stay]
        active, seeds = active[stay], seeds[stay]
    return out.reshape(n, places)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents x BANDS) int64 keys of the bands."""
    n = len(signatures)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0xC2B2AE3D27D4EB4F) + signatures.reshape(n, BANDS, ROWS)[:, :, r])
    return keys.view(np.int64)


_SIGNED = "_id bigint, _hash bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def signed(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, a hash of the text, n_shingles, a 128-bit key of the shingle set, band keys."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in chunks(offsets, CHUNK):
                grams, limits = shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                signatures = super_minhash(grams, limits)
                n = j - i
                sums = np.zeros((2, len(grams) + 1), dtype=np.uint64)
                np.cumsum(mix64(grams + _GOLD), out=sums[0, 1:])
                np.cumsum(mix64(grams ^ _GOLD), out=sums[1, 1:])
                sets = (sums[:, limits[1:]] - sums[:, limits[:-1]]).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_keys(signatures).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.diff(limits)), pa.array(sets[0]), pa.array(sets[1]), bands],
                    ["_id", "_hash", "n_shingles", "set_a", "set_b", "bands"],
                )

    return in_arrow(_source(docs, id_col, text_col), run, _SIGNED)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("bigint").alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash"), text_of(text_col).alias("_text"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs, by the full shingle sets of both texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, left_at = text_bytes(batch.column(2))
            right, right_at = text_bytes(batch.column(3))
            linked = np.zeros(batch.num_rows, dtype=bool)
            # texts come often more than once: sets of the last few are kept
            sets: dict = {}
            for i in range(batch.num_rows):
                both = []
                for key, raw, at in ((batch.column(0)[i].as_py(), left, left_at), (batch.column(1)[i].as_py(), right, right_at)):
                    if key not in sets:
                        if len(sets) >= 64:
                            sets.pop(next(iter(sets)))
                        part = raw[at[i] : at[i + 1]]
                        sets[key] = shingle_hashes(part, np.array([0, len(part)]), words)[0]
                    both.append(sets[key])
                shared = len(np.intersect1d(*both, assume_unique=True))
                either = len(both[0]) + len(both[1]) - shared
                linked[i] = shared > 0 and 100 * shared >= percent * either
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    # joins by merging at every size: the plan, and what it moves, grows in proportion to the input
    # the text of a hot pivot is dealt out once for every SPLIT of its pairs, to as many tasks
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    left = texts.join(parts.hint("merge"), F.col("_class") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("_text").alias("_left"))
    right = texts.select(F.col("_class").alias("b"), F.col("_text").alias("_right"))
    dealt = pairs.select("a", "b").join(parts.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    both = dealt.join(right.hint("merge"), "b").join(left.hint("merge"), ["a", "part"])
    return in_arrow(both.select("a", "b", "_left", "_right"), run, "a bigint, b bigint, linked boolean")


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the texts fall in each of COUNTERS slots."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for i, j in chunks(offsets, CHUNK):
                grams = shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)[0]
                counts += np.bincount((grams % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])

    found = in_arrow(texts.select("_text"), run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix_lengths(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that a set sends, those of them that are met as the smaller of two sets)."""
    probe = sizes - -(-percent * sizes // 100) + 1
    return probe, np.minimum(probe, sizes - -(-2 * percent * sizes // (100 + percent)) + 1)


_MAPS = ("m0", "m1", "m2", "m3")


def _prefixes(texts: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(gram, _class, component, n, at, small, maps): the first shingles of each text in the order of counts.

    The row of the first one has the map of the whole set: bit k is the parity of the shingles whose top byte is k.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import pyarrow as pa

        counts = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in chunks(offsets, CHUNK):
                grams, limits = shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                sizes = np.diff(limits)
                owner = np.repeat(np.arange(j - i), sizes)
                tops = (mix64(grams) >> np.uint64(56)).astype(np.int64)
                order = np.lexsort((grams, counts[(grams % np.uint64(COUNTERS)).astype(np.int64)], owner))
                at = np.arange(len(grams)) - limits[:-1][owner]
                probe, small = prefix_lengths(sizes, percent)
                sent = at < probe[owner]
                grams, owner, at = grams[order][sent], owner[sent], at[sent]
                flips = np.bincount(np.repeat(np.arange(j - i), sizes) * 256 + tops, minlength=(j - i) * 256) & 1
                maps = np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(j - i, 4)[owner]
                who, parts = (batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False)[owner] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(who), pa.array(parts), pa.array(sizes[owner]), pa.array(at), pa.array(at < small[owner]), *[pa.array(maps[:, k], mask=at > 0) for k in range(4)]],
                    ["gram", "_class", "component", "n", "at", "small", *_MAPS],
                )

    return in_arrow(texts.select("_class", "component", "_text"), run, "gram bigint, _class bigint, component bigint, n bigint, at bigint, small boolean, " + ", ".join(f"{m} bigint" for m in _MAPS))


def _spanning(sent: DataFrame) -> DataFrame:
    """(gram): shingles that more than one component sent, one of its sets as the smaller of two."""
    return durable(sent.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("small").alias("any")).filter("lo < hi AND any").select("gram"), "near-shared", light=True)


def _met(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The first shingles of texts (_class, component, _text) that may meet those of another component, all with the maps."""
    sent = durable(_prefixes(texts, _counts(texts, words), words, percent), "near-prefixes")
    met = durable(sent.drop(*_MAPS).join(_spanning(sent).hint("merge"), "gram"), "near-met")
    return durable(met.join(sent.filter("at = 0").select("_class", *_MAPS).hint("merge"), "_class"), "near-mapped")


def _neighbours(met: DataFrame, by: str, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, of sets that follow each other among those with a shingle in the order of a map.

    At most NEXT a row, whatever the size of a group. Ranges cut a frequent shingle too; what is parted so isn't tried here.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
            maps = np.stack([c[m] for m in _MAPS])
            for d in range(1, NEXT + 1):
                i = np.flatnonzero((c["gram"][:-d] == c["gram"][d:]) & (c["component"][:-d] != c["component"][d:]))
                j = i + d
                later = (c["n"][j] > c["n"][i]) | ((c["n"][j] == c["n"][i]) & (c["_class"][j] > c["_class"][i]))
                x, y = np.where(later, j, i), np.where(later, i, j)
                n, m = c["n"][x], c["n"][y]
                differ = np.bitwise_count(maps[:, x] ^ maps[:, y]).sum(axis=0, dtype=np.int64)
                fits = (100 * m >= percent * n) & ((100 + percent) * differ <= (100 - percent) * (n + m))
                x, y = c["_class"][x[fits]], c["_class"][y[fits]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    order = ["gram", by, "_class"]
    dealt = met.repartitionByRange(*order).sortWithinPartitions(*order)
    return in_arrow(dealt.select("gram", "_class", "component", "n", *_MAPS), run, "a bigint, b bigint").distinct()


def _all_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked: all whose first shingles meet."""
    sides = ("_class", "component", "n", "at", *_MAPS)
    x = met.select("gram", *[F.col(c).alias("x_" + c) for c in sides])
    y = met.filter("small").select("gram", *[F.col(c).alias("y_" + c) for c in sides])
    larger = "(x_n > y_n OR (x_n = y_n AND x__class > y__class))"
    # from this shingle on at most so many can be common
    enough = f"{100 + percent} * least(x_n - x_at, y_n - y_at) >= {percent} * (x_n + y_n)"
    # so many at least are not common
    differ = " + ".join(f"bit_count(x_{m} ^ y_{m})" for m in _MAPS)
    close = f"{100 + percent} * ({differ}) <= {100 - percent} * (x_n + y_n)"
    fits = f"x_component <> y_component AND {larger} AND 100 * y_n >= {percent} * x_n AND {enough} AND {close}"
    both = x.join(y.hint("merge"), (x["gram"] == y["gram"]) & F.expr(fits))
    return both.select(F.least("x__class", "y__class").alias("a"), F.greatest("x__class", "y__class").alias("b")).distinct()


def _across(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, by the first shingles of texts (_class, component, _text)."""
    return _all_pairs(_met(texts, words, percent), percent)


def _more_links(open_texts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of open_texts (_class, component, _text), with those that are left out lying within one component.

    Neighbours go first, by one map after the other, as long as they join anything: a large group of near
    copies becomes one component by a few links a text. All pairs are formed only of what then still differs.
    """
    met, found = _met(open_texts, words, percent), None
    for by in _MAPS:
        tried = durable(_neighbours(met, by, percent), "near-neighbours", light=True)
        links = durable(confirmed(tried, texts, words, percent).filter("linked").select("a", "b"), "near-joining", light=True)
        if not links.limit(1).count():
            break
        found = links if found is None else found.union(links)
        stars = open_texts.filter("_class <> component").select(F.col("component").alias("a"), F.col("_class").alias("b"))
        now = components(stars.union(found)).select(F.col("node").alias("_class"), F.col("component").alias("now"))
        met = durable(met.join(now.hint("merge"), "_class", "left").withColumn("component", F.coalesce("now", "component")).drop("now"), "near-mapped")
    if found is not None:
        met = durable(met.join(_spanning(met).hint("merge"), "gram"), "near-mapped")
    across = durable(_all_pairs(met, percent), "near-across", light=True)
    more = confirmed(across, texts, words, percent).filter("linked").select("a", "b")
    return more if found is None else more.union(found)


def _one_text_a_class(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_class, _text) of the classes in wanted (_class, rep, rep_hash)."""
    found = _source(docs, id_col, text_col).join(wanted.hint("merge"), (F.col("_id") == F.col("rep")) & (F.col("_hash") == F.col("rep_hash")))
    texts = durable(found.select("_class", "_text"), "near-texts")
    if texts.count() > wanted.count():  # rows that repeat doc_id and text: one of them, the others going before the exchange
        texts = durable(texts.groupBy("_class").agg(F.first("_text").alias("_text")), "near-text")
    return texts


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union of the shingle sets."""
    with scratch(docs.sparkSession) as keep:
        return _near_dedup(docs, words, percent, id_col, text_col, keep).drop("_hash", "_group")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component that with the least id, and of its texts the one of least hash.

    Rows are told by id and text, as ids may repeat; rows without an id or a word stay.
    """
    with scratch(docs.sparkSession) as keep:
        rows = _near_dedup(docs, words, percent, id_col, text_col, keep).select(F.col(id_col).alias("_id"), "_hash", "_group")
        alone = [F.when(F.col("_group").isNull(), F.col(c)) for c in ("_id", "_hash")]  # a row without a group is one of its own
        best = rows.groupBy("_group", *alone).agg(F.min(F.struct("_id", "_hash")).alias("b"))
        kept = keep(best.select(F.col("b._id").alias("__runlens_id"), F.col("b._hash").alias("__runlens_hash")), "near-kept")
    own = docs[id_col].cast("bigint").eqNullSafe(F.col("__runlens_id")) & (F.xxhash64(text_of(text_col)) == F.col("__runlens_hash"))
    return docs.join(kept.hint("merge"), own, "left_semi")


def _near_dedup(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, keep) -> DataFrame:
    rows = keep(signed(docs, words, id_col, text_col), "near-signed")
    key = ["set_a", "set_b", "n_shingles"]
    classes = rows.filter("n_shingles > 0 AND _id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("_id", "_hash")).alias("_least"), F.first("bands").alias("bands"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("_class"), *key, F.col("_least._id").alias("rep"), F.col("_least._hash").alias("rep_hash"), "bands"), "near-classes")
    flat = classes.select("_class", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = durable(
        flat.groupBy("band", "key").agg(F.min(F.struct("_class", "n_shingles")).alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("band", "key", F.col("pivot._class").alias("pivot"), F.col("pivot.n_shingles").alias("size")), "near-buckets", light=True
    )
    members = durable(flat.join(buckets.hint("merge"), ["band", "key"]), "near-members")
    # the texts of all that has a candidate, taken once; everything after this works on them alone
    wanted = durable(classes.join(members.select("_class").distinct().hint("merge"), "_class", "left_semi").select("_class", "rep", "rep_hash"), "near-wanted", light=True)
    texts = _one_text_a_class(docs, wanted, id_col, text_col)
    fits = f"_class <> pivot AND 100 * least(n_shingles, size) >= {percent} * greatest(n_shingles, size)"
    pairs = durable(members.filter(fits).select(F.col("pivot").alias("a"), F.col("_class").alias("b")).distinct(), "near-stars", light=True)
    linked = durable(confirmed(pairs, texts, words, percent).filter("linked").select("a", "b"), "near-confirmed")
    labels = durable(components(linked), "near-labels")
    # what a pivot could not join: buckets whose other members lie in several components
    placed = members.filter("_class <> pivot").select("_class", "band", "key").join(labels.hint("merge"), F.col("_class") == F.col("node"), "left")
    placed = durable(placed.select("_class", "band", "key", F.coalesce("component", "_class").alias("component")), "near-placed")
    mixed = durable(placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "key"), "near-mixed", light=True)
    open_ = durable(placed.join(mixed.hint("merge"), ["band", "key"], "left_semi").select("_class", "component").distinct(), "near-open", light=True)
    open_texts = durable(texts.join(open_.hint("merge"), "_class"), "near-open-texts")
    more = durable(_more_links(open_texts, texts, words, percent), "near-more", light=True)
    if more.limit(1).count():
        labels = durable(components(linked.union(more)), "near-labels")
    # the least doc_id of each component
    named = durable(labels.join(classes.select("_class", "rep").hint("merge"), F.col("node") == F.col("_class")).select("component", "node", "rep"), "near-named", light=True)
    least = durable(named.groupBy("component").agg(F.min("rep").alias("component_id")), "near-least", light=True)
    of_class = durable(named.select("component", "node").join(least.hint("merge"), "component").select(F.col("node").alias("_class"), "component", "component_id"), "near-of-class", light=True)
    final = classes.select("_class", "rep", *key).join(of_class.hint("merge"), "_class", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "_class").alias("_group"))
    out = rows.drop("bands").join(keep(final, "near-final").hint("merge"), key, "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    group = F.when(F.col("_id").isNotNull(), F.col("_group")).alias("_group")
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), "_hash", group).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


#: For three words and 85 per cent, all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r != b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(o.doc_id)) AS component_id, w.doc_id = least(w.doc_id, min(o.doc_id)) AS kept
FROM w LEFT JOIN n USING (r) LEFT JOIN c ON c.a = w.r LEFT JOIN w o ON o.r = c.b GROUP BY w.r, w.doc_id
"""
