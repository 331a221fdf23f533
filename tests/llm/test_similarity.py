"""Near-duplicates by exact similarity, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import similarity, simhash
from tests.llm import cases


def brute_sets(texts, size=5):
    split = [t.encode().lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in split]


def brute_components(sets):
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def edited(r, words, n):
    """n words at places that are far enough apart replaced, so that each costs five shingles."""
    out = list(words)
    for k in r.sample(range(0, len(words) - 6, 6), n):
        out[k] = f"new{r.randrange(10**9)}"
    return out


def near_the_border(seed=5, n=150):
    """Pairs of similarity 0.7 to 0.9, a large group of copies of one text, one line that many texts share, and short texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioustrnl") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    line, base = r.choices(words, k=30), r.choices(words, k=200)
    texts = []
    for _ in range(n):
        one = r.choices(words, k=r.randrange(150, 400))
        texts += [one, edited(r, one, round(len(one) * r.uniform(0.008, 0.036)))]
    texts += [edited(r, base, r.randrange(1, 10)) for _ in range(120)]
    texts += [line + r.choices(words, k=r.randrange(20, 60)) for _ in range(100)]
    texts += [words[:n] for n in range(12)] + [words[:200], [w.upper() for w in words[:200]], words[:163], words[:164], words[:165], words[:166]]
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("parts", "limit"), [(1, similarity.LIMIT), (5, 20)])
def test_components_are_those_of_all_pairs(spark, tmp_path, parts, limit):
    texts = near_the_border()
    label = brute_components(brute_sets(texts))
    least = {g: min(i for i, x in enumerate(label) if x == g) for g in set(label)}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts).write.parquet(str(tmp_path / "d"))
    found = similarity.near_groups(spark.read.parquet(str(tmp_path / "d")), 5, limit=limit).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: least[x] for i, x in enumerate(label)}
    assert Counter(r.doc_id for r in found if r.kept) == Counter(least.values())
    assert len(found) == len(texts)


def test_stage_decides_by_similarity(spark, tmp_path):
    texts = near_the_border(6, 30)
    label = brute_components(brute_sets(texts))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    left = corpus_pipeline.near_copies(spark, spark.read.parquet(str(tmp_path / "d")), None)
    assert {r.doc_id for r in left.collect()} == {min(i for i, x in enumerate(label) if x == g) for g in set(label)}


def test_every_pair_of_a_crowded_key_meets_in_one_group(spark):
    """First rows meet each other and all others once, whatever the number of rows and chunks."""
    for n, r, limit in ((40, 15, 64), (300, 120, 16), (300, 3, 20), (50, 50, 10)):
        rows = spark.range(n).selectExpr("7L AS key", "id AS node", f"{n}L AS n", f"id < {r} AS first", f"{r}L AS r")
        groups = {}
        for x in simhash.dealt(rows, limit).collect():
            groups.setdefault((x.c1, x.c2), ([], []))[x.side].append(x.node)
        met = [frozenset((a, b)) for (i, j), (own, others) in groups.items() for a in own for b in ([y for y in own if y < a] if i == j else []) + others]
        assert len(met) == len(set(met)) == r * (r - 1) // 2 + r * (n - r)


def test_pairs_at_the_border_share_a_key_and_differ_in_few_bits():
    """What the trie join's budget and the keys lose of pairs of similarity 0.8."""
    r = np.random.default_rng(2)
    lost = 0
    for _ in range(2000):
        n = int(r.integers(9, 300))
        both = r.integers(-(2**63), 2**63 - 1, 8 * n // 9)
        a, b = (np.unique(np.append(both, r.integers(-(2**63), 2**63 - 1, n // 9))) for _ in range(2))
        prints = [[simhash.majority(x.view(np.uint64)), simhash.majority(simhash.remixed(x.view(np.uint64)))] for x in (a, b)]
        apart = sum((x ^ y).bit_count() for x, y in zip(*prints, strict=True))
        lost += apart > similarity.BUDGET or not set(similarity.keys_of(a).tolist()) & set(similarity.keys_of(b).tolist())
    assert lost <= 2


def test_recall_and_precision_on_the_test_table(spark):
    """Links of documents whose id is divisible by 20 against all pairs by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    sets = {i: {hash(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))} for i, w in rows.items()}
    asked = set().union(*(s for i, s in sets.items() if i % 20 == 0))
    holders = {}
    for i, s in sets.items():
        for x in s & asked:
            holders.setdefault(x, []).append(i)
    component = {r.doc_id: r.component_id for r in similarity.near_groups(docs, 5).collect()}
    wanted = found = 0
    for i in (i for i in sets if i % 20 == 0):
        for j in {j for x in sets[i] for j in holders[x]} - {i}:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                wanted += 1
                found += component[i] == component[j]
    print("recall", found, "of", wanted)
    assert wanted > 20 and found >= 0.99 * wanted


def test_hard_rows(spark):
    df = cases.documents(spark)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    label = brute_components(brute_sets([t for _, t in rows]))
    least = {g: min((i for (i, _), x in zip(rows, label, strict=True) if x == g and i is not None), default=None) for g in set(label)}
    found = similarity.near_groups(df, 5).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((i, least[g]) for (i, _), g in zip(rows, label, strict=True))
    assert sum(r.kept for r in found) == len(set(label))
    assert similarity.near_groups(cases.empty(spark), 5).collect() == []


def test_bitmaps_differ_in_no_more_bits_than_their_sets(spark):
    r = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 128, 140, 600):
        found = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        other = np.append(found[n // 9 :], r.integers(-(2**63), 2**63 - 1, n // 5))
        rows = spark.createDataFrame([(similarity.bitmap(found).tolist(), similarity.bitmap(other).tolist())], "x array<long>, y array<long>")
        longs = F.least(F.size("x"), F.size("y"))
        x, y = rows.select(similarity.folded(F.col("x"), longs), similarity.folded(F.col("y"), longs)).first()
        apart = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
        assert apart <= n // 9 + n // 5 and (apart - n // 9 - n // 5) % 2 == 0
