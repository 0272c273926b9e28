"""Exact dedup, mixing and fingerprints, against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from helpers import SCHEMA, awkward, empty
from pyspark.sql import functions as F

from runlens.llm import exact_dedup, fingerprint, mixing


@pytest.mark.parametrize("options", [{}, {"block_bytes": 16}, {"block_bytes": 7, "hash_bits": 3}])
def test_exact_dedup(spark, options):
    docs = awkward(spark).cache()
    got = exact_dedup.exact_dedup(docs, **options).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), str(top[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_of_unsteady_row_order(spark):
    """Blocks that share a hash are told apart also where a second pass would number the rows otherwise."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 24))) for _ in range(300)]
    docs = awkward(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for shuffled in (docs.repartition(4), docs.union(docs.filter("false")).repartition(3, "n_chars"), docs.groupBy("doc_id").agg(F.first("text").alias("text"))):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(shuffled, block_bytes=7, hash_bits=3).collect()}
        assert got == {i: (max(k for k, x in enumerate(texts) if x == t), texts.count(t)) for i, t in enumerate(texts)}


def test_without_copies_keeps_rows_whole(spark):
    docs = awkward(spark)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in docs.collect()})


def test_empty_tables(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.without_copies(empty(spark)).count() == 0
    assert mixing.mix_table(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert fingerprint.fingerprint_table(empty(spark)).count() == 0


def _water_filling(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice([None, "é", "b", "z", "Z", "aa"] if seed else ["only"])) for i in range(300)]
    got = mixing.mix_table(awkward(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = _water_filling(dict(sizes))
    taken, variance = defaultdict(int), defaultdict(float)
    for r in got:
        rate = want[r["source"]] / sizes[r["source"]]
        assert r["copies"] in (int(rate), int(rate) + 1)
        variance[r["source"]] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)  # of a fair draw with the fraction as its chance
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 4 * variance[s] ** 0.5 + 1e-6 for s in sizes)


def test_mixed_rows(spark):
    docs = awkward(spark)
    plan = {}
    for r in mixing.mix_table(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = defaultdict(int)
    for r in out.collect():
        found[r["doc_id"]] += 1
        assert r["size"] == "y"
    assert found == {k: v for k, v in plan.items() if v}


def _winnow(tokens, k=4, w=4):
    """Chosen positions by the definition, over any token hash; ties to the right."""
    grams = [tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)] or ([tuple(tokens)] if tokens else [])
    return grams, w


def test_fingerprints_against_definition(spark):
    """The chosen hashes are those that the definition picks from the operator's own gram hashes."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "cc"]) for _ in range(n)) for n in (0, 1, 3, 4, 6, 7, 8, 30, 200)]
    docs = awkward(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    by_gram = {}
    for i, t in enumerate(texts):
        grams, w = _winnow(t.split())
        for h, p in zip(got[i]["hashes"], got[i]["positions"], strict=True):
            assert by_gram.setdefault(grams[p], h) == h  # equal grams, equal hashes
        places = got[i]["positions"]
        assert places == sorted(places)
        for start in range(max(1, len(grams) - w + 1) if grams else 0):  # every window has a chosen position
            assert any(start <= p < start + w for p in places)
        known = [by_gram.get(g) for g in grams]
        for start in range(len(grams) - w + 1):
            window = known[start : start + w]
            if None not in window:
                least = min(window)
                assert start + max(j for j, h in enumerate(window) if h == least) in places


def test_fingerprints_of_texts_without_spaces(spark):
    """A passage without spaces is found at every offset, and tokens are taken at whole code points."""
    rng = random.Random(5)
    for signs in ("0123456789abcdef", "的一是不了人我在有他这中大来上个国", "😀😁😂🤣😃😄😅😆a"):
        passage = "".join(rng.choices(signs, k=400))
        docs = awkward(spark, [(i, '"' * i + passage, "en", "s") for i in range(9)])
        got = {r["doc_id"]: (set(r["hashes"]), r["positions"]) for r in fingerprint.fingerprints(docs).collect()}
        for i in range(9):
            assert len(got[0][0] & got[i][0]) >= 0.9 * len(got[0][0])
            assert got[i][1][-1] < 400 + i - 7 - 3  # 8 code points a token, 4 tokens a gram
        table = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprint_table(docs).collect()}
        assert all(table[i] > 0.8 for i in range(8))


def test_edited_texts_and_next_documents(spark):
    docs = awkward(spark).filter("doc_id <> 2")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    for ranges in (2, 9):
        got = {r["doc_id"]: r for r in fingerprint.fingerprint_table(docs, ranges).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            following, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
            edited = t[: len(t) - cut] + following[:cut]
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
            if edited == t:
                assert got[i]["near_edited"] == 1 and got[i]["fingerprint"] == got[i]["edited_fingerprint"]
            elif len(t.split()) > 60 and len(set(t.split())) > 30:
                assert got[i]["near_edited"] > 0.3


def _hash(parts, seed=42):
    """The 64-bit hash of several values, each seeding the next, as a signed number."""
    for x in parts:
        raw = x.encode() if isinstance(x, str) else x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed & ((1 << 64) - 1))
    return seed - (1 << 64) if seed >> 63 else seed


def _plain_fingerprint(text):
    """(hash of the chosen hashes and positions, set of the chosen hashes) by the definition."""
    tokens = []
    for run in re.finditer(r"[^\x20\x09-\x0d]+", text):
        whole = run[0]
        tokens += [whole] if len(whole) < 8 else [whole[i : i + 8] for i in range(len(whole) - 7)]
    tops, rolled, base, prime = [], 0, fingerprint.BASE, fingerprint.P
    leaves = [_hash([t]) % prime for t in tokens]
    for i, leaf in enumerate(leaves):  # rolled on from place to place
        gone = leaves[i - 4] * base**3 if i >= 4 else 0
        rolled = ((rolled - gone) * base + leaf) % prime
        if i >= 3 or i == len(leaves) - 1:
            tops.append(rolled)
    chosen = []
    for i in range(max(len(tops) - 3, min(len(tops), 1))):
        window = tops[i : i + 4]
        best = (min(window), max(i + j for j, h in enumerate(window) if h == min(window)))
        if best not in chosen:
            chosen.append(best)
    packed = [(h << 31) + (1 << 31) - 1 - at for h, at in chosen]
    four = lambda n: n.to_bytes(4, "little")
    word = lambda n: f"{n & ((1 << 64) - 1):016x}"
    return word(_hash(packed)) + word(_hash([four(4), *packed, four(4)])), {h for h, _ in chosen}


def test_fingerprint_table_by_hand(spark):
    """Every column against winnowing by its definition, with repeated rows, null ids and texts without spaces."""
    rng = random.Random(8)
    docs = awkward(spark).filter("doc_id IS NULL OR doc_id <> 11")
    more = [(200 + i // 2, "".join(rng.choice("ab 漢字😀c") for _ in range(rng.randint(0, 90))), "en", "s") for i in range(40)]
    docs = docs.union(awkward(spark, [*more, more[3], (None, "another one without an id", "en", "s")]))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, _hash([r[1]])))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        (own, a), (new, b), (_, c) = map(_plain_fingerprint, (t, edited, following))
        alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new, round(alike(a, b), 9), round(alike(a, c), 9)))
    for ranges in (1, 7):
        got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprint.fingerprint_table(docs, ranges).collect()]
        assert sorted(got) == sorted(want)


def test_no_python_in_the_plans(spark):
    for df in (fingerprint.fingerprint_table(awkward(spark)), mixing.mix_table(awkward(spark)), exact_dedup.exact_dedup(awkward(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "MapInArrow" not in plan
    assert "doc_id" in SCHEMA
