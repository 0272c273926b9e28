"""Alignment of two tokenizers, substring dedup and centroid clustering against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import alignment, centroids, substrings
from runlens.llm.fm_index import FMIndex

ODD = ["a \n \tb", " lead", "trail ", "trail  ", "  ", " ", "a  b", "x▁y", "▁", "it's we've<|endoftext|> <s>", "a\0b c", "　 x   y", "é́ ̈", "😀 漢字 漢字", "\x1c \x1d a", "line\n\nnext  \n x", "1 234 5,6 %"]


def pairs(spark):
    """(doc_id, text) rows, awkward ones and odd ones, and the table that holds them."""
    table = awkward(spark)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    table = table.unionByName(more, allowMissingColumns=True)
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], table


# --- cross-tokenizer alignment


def aligned(rows):
    """op11's rows by one loop over whole documents, with the two libraries as they are."""
    path_a, path_b = alignment.default_paths()
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    table = alignment._unicode_bytes()

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        spelt = [[bytes(table[c] for c in a_model.id_to_token(x)) for x in a], [b_bytes(x) for x in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelt):
            docs.append((i, None))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in s]).tolist(), ids, strict=True)) for s, ids in zip(spelt, (a, b), strict=True)]
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0]) if e in ends[1]]
        groups, own = [], ([], [])
        for e in sorted({*ends[0], *ends[1]}):
            for side in (0, 1):
                if e in ends[side]:
                    own[side].append(str(ends[side][e]))
            if e in ends[0] and e in ends[1]:
                groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
                own = ([], [])
        count.update(links)
        docs.append((i, (len(a), len(b), links, ";".join(groups))))
    most = defaultdict(int)
    for (_, b), c in count.items():
        most[b] = max(most[b], c)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = d
            out.append((i, n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", *alignment.COUNTS, "groups_sha256").collect()), key=str)


def test_alignment_equals_whole_texts(spark):
    rows, table = pairs(spark)
    want = aligned(rows)
    assert told(alignment.aligned_documents(table)) == want
    assert told(alignment.aligned_documents(table, block=500)) == want  # parts meet again from many blocks


def test_alignment_without_separation(spark, monkeypatch):
    rows, table = pairs(spark)
    monkeypatch.setattr(alignment, "separable", lambda *_: False)
    assert told(alignment.aligned_documents(table)) == aligned(rows)


def test_alignment_of_nothing(spark):
    assert alignment.aligned_documents(empty(spark)).count() == 0


def test_the_models_are_separable():
    assert alignment.separable(*alignment.default_paths())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \t\n  \x1cab'1.é漢", min_size=1, max_size=30))
def test_parts_are_the_text(text):
    cut = alignment.parts(text)
    assert " ".join(cut) == text
    for side in alignment._sides(*alignment.default_paths()):
        whole = side.encode([text])[0].tolist()
        for joined in (False, True):
            assert alignment._encoded(side, cut, joined)[0].tolist() == whole


# --- substring dedup


def trimmed(rows, span=35):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + span]) for _, w in words for k in range(len(w) - span + 1))
    out = []
    for i, w in words:
        gone = {k + x for k in range(len(w) - span + 1) if count[tuple(w[k : k + span])] > 1 for x in range(span)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(spark):
    rng = random.Random(5)
    every = [f"w{i}" for i in range(300)]
    line, common = ([rng.choice(every) for _ in range(n)] for n in (40, 20))
    rows = []
    for i in range(300):
        w = [rng.choice(every) for _ in range(rng.randint(0, 120))]
        for what in (line, common, line[3:38]):
            if rng.random() < 0.3:
                k = rng.randint(0, len(w))
                w[k:k] = what
        if rng.random() < 0.05:
            w = ["a"] * rng.randint(30, 90)
        if rng.random() < 0.1 and rows:
            w = rng.choice(rows)[1].split()
        rows.append((i if rng.random() < 0.9 else 7, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(r.doc_id, r.text) for r in awkward(spark).collect()]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"hot": 0, "shard": 3000}, {"shard": 500}])
def test_substrings_equal_all_windows(spark, options):
    rows, table = passages(spark)
    got = substrings.substring_table(table, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == trimmed(rows)


def test_substring_texts_and_shorter_windows(spark):
    rows, table = passages(spark)
    got = substrings.without_repeats(table, span=9, gram=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=str) == trimmed(rows, 9)


def test_substrings_of_clashing_and_no_columns(spark):
    assert substrings.substring_table(empty(spark)).count() == 0
    table = awkward(spark).withColumnRenamed("size", "key").withColumnRenamed("score", "_text")
    assert substrings.substring_table(table).count() == table.count()


def test_index_statistics():
    rng = random.Random(1)
    for _ in range(30):
        kinds = rng.choice([1, 2, 3, 50])
        rows = [[rng.randrange(kinds) * 1000003 for _ in range(rng.randint(1, rng.choice([3, 20, 63])))] for _ in range(rng.randint(1, 20))]
        rows += [list(r) for r in rows[: rng.randint(0, 4)]]
        sizes = [len(r) for r in rows]
        index = FMIndex(np.array(sum(rows, []), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)]))
        got = index.statistics(index.starts, np.array(sizes))
        count = Counter(tuple(r[i:j]) for r in rows for i in range(len(r)) for j in range(i + 1, len(r) + 1))
        for r, start in zip(rows, index.starts, strict=True):
            for i in range(len(r)):
                far = max((j - i for j in range(i + 1, len(r) + 1) if count[tuple(r[i:j])] > 1), default=0)
                assert got[start + i] == far


# --- centroid clustering


def lloyd(rows, k, rounds, size, scale=256, seed=2):
    """(rows of id, cluster, distance; centroids) in Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.LIMIT, min(centroids.LIMIT, int(np.floor(x * scale)))) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else old for n, old in enumerate(c)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], c


def test_clusters_equal_lloyd(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.25, -0.25, 1.0, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, [0.5] * 4), (900, [1e30, -1e30, 0.0, 1.0]), (901, [1.0, 2.0]), (902, None), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, _v int")
    for k in (1, 7, 500):
        want, c = lloyd(rows, k, 3, 4)
        got = centroids.cluster_table(table, k=k, rounds=3, size=4).collect()
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
        inertia = Counter()
        for _, n, d in want:
            inertia[n] += d
        for r in got:
            assert (r.cluster_inertia, r.inertia) == tuple(min(x, 2**63 - 1) for x in (inertia[r.cluster], sum(inertia.values())))
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert centroids.cluster_table(none).count() == 0


def test_annulus_leaves_centroids_out():
    rng = np.random.default_rng(1)
    c = rng.integers(-50, 50, (40, 8)) + np.arange(40)[:, None] * 400
    x = np.repeat(c, 50, axis=0) + rng.integers(-20, 20, (2000, 8))
    annuli = centroids.Annuli(c)
    who, d = annuli.nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert annuli.compared < every.size / 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_clusters_equal_sql(spark):
    from runlens.llm import queries

    got = queries.queries()["op13_centroid_clustering"](spark, "/root/testdata/sf0.001").toPandas()
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_centroid_clustering"]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert (got[names].sort_values(names, ignore_index=True) == want[names].sort_values(names, ignore_index=True)).all().all()
