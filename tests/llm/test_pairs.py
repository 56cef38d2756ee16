"""Overlap across splits, leakage and repetition against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from parlance.llm import leakage, overlap, repetition
from parlance.llm.plain import plain_words
from parlance.runtime import shared_folder

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ana", "ilo", "ure", "este", "ock")]
SCHEMA = "example_id string, split string, text string, corpus string, words string, n int, cls string"


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        i = r.randrange(len(w))
        k = r.randrange(3)
        if k == 0:
            w[i] = r.choice(WORDS)
        elif k == 1:
            del w[i]
        else:
            w.insert(i, r.choice(WORDS))
    return w


def test_within():
    r = random.Random(1)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randrange(12))]
        b = edited(r, a, r.randrange(4)) if len(a) > 4 else [r.choice("abcd") for _ in range(r.randrange(5))]
        for most in (0, 1, 3, 20):
            d = levenshtein(a, b)
            assert overlap.within(a, b, most) == (d if d <= most else None)


def test_pairs_and_classes(spark):
    r = random.Random(2)
    rows = []
    texts = []
    for i in range(40):
        w = [r.choice(WORDS) for _ in range(r.randrange(20, 60))]
        texts.append(w)
        rows.append((f"t{i}", r.choice(["train", " Train"]), " ".join(w)))
    for i in range(40):
        w = texts[r.randrange(40)]
        rows.append((f"h{i}", r.choice(["dev", "TEST "]), " ".join(edited(r, w, r.randrange(0, max(1, len(w) // 8))))))
    # exact copies of one text hold a third of all rows; their looks differ
    for i in range(30):
        rows.append((f"c{i}", "train" if i % 3 else "test", "Um, " + " ".join(texts[0]).upper() + "!"))
    rows += [("n1", None, " ".join(texts[0])), ("n2", "test", None), ("n3", "test", ""), (None, "train", " ".join(texts[0])), ("n4", "test", " ".join(texts[0][:19]))] + rows[:10]
    # near misses
    rows += [("m1", "test", " ".join(texts[1][: len(texts[1]) // 2] + [r.choice(WORDS) for _ in range(len(texts[1]) // 2)]))]
    df = spark.createDataFrame([(a, b, c, "x", "y", 1, "z") for a, b, c in rows], SCHEMA)
    got = {(x["id_a"], x["id_b"]) for x in overlap.cross_split_pairs(df).collect()}
    own = {(i, "train" if s.strip().lower() == "train" else "held"): plain_words(t) for i, s, t in rows if i and s and t and len(plain_words(t)) >= 20}
    want = set()
    for (a, s), x in own.items():
        for (b, t), y in own.items():
            if s == "train" and t == "held" and 4 * levenshtein(x, y) <= max(len(x), len(y)):
                want.add((min(a, b), max(a, b)))
    assert got == want
    classes = {x["example_id"]: x for x in overlap.document_classes(df).collect()}
    assert classes["c0"]["class_id"] == classes["c3"]["class_id"] == classes["c1"]["class_id"] and classes["c0"]["links"] >= 1
    # one row per record that takes part, of either side
    assert {(k, "train" if x["split"] == "train" else "held") for k, x in classes.items()} <= {*own} and {*classes} == {i for i, _ in own}
    fractions = {x["example_id"]: x["overlap"] for x in overlap.overlap_fractions(df).collect()}
    assert {*fractions} == {i for i, s in own if s == "held"} and fractions["c0"] > 0.4 and fractions["m1"] < fractions["c0"]
    assert all(0 <= f <= 1 for f in fractions.values())
    report = overlap.overlap_report(df).collect()
    assert sum(x["pairs"] for x in report) == len(want)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_recall_of_chunks():
    """Share of pairs that have a chunk in common, by share of edited words."""
    r = random.Random(3)
    for share, least in ((0.06, 0.99), (0.15, 0.99), (0.25, 0.96)):
        hit = 0
        for _ in range(300):
            w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randrange(20, 60))]
            e = edited(r, w, int(share * len(w)))
            owner, digest, _, _ = overlap.chunk_digests([w, e])
            hit += bool({*digest[owner == 0]} & {*digest[owner == 1]})
        assert hit / 300 >= least


def test_chunks_of_odd_records():
    owner, digest, place, length = overlap.chunk_digests([[], ["a"] * 50, ["b", "c"]])
    assert set(owner) <= {1, 2} and (length >= overlap.MIN_WORDS).all() and (length <= overlap.MAX_WORDS).all()
    assert all(len(x) == 0 for x in overlap.chunk_digests([]))


def leaks(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = plain_words(t)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, x in items:
            v = plain_words(x)
            if any(tuple(v[i : i + n]) in have for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("pass_chars", [4_000_000, 900])
def test_leaks(spark, pass_chars):
    r = random.Random(4)
    items = [(f"b{i}", " ".join(r.choice(WORDS) for _ in range(r.choice([5, 12, 30])))) for i in range(25)]
    docs = []
    for d in range(80):
        w = [r.choice(WORDS) for _ in range(r.randrange(0, 90))]
        if r.random() < 0.6:
            v = r.choice(items)[1].split()
            n = r.choice([11, 12, 20])
            i = r.randrange(max(1, len(v) - n + 1))
            w[len(w) // 2 : len(w) // 2] = [x.upper() if r.random() < 0.3 else f"um, {x}" for x in v[i : i + n]]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " "), (903, " ".join(r.choice(WORDS) for _ in range(50_000)) + " " + items[2][1])]
    D = spark.createDataFrame([(a, b, "x") for a, b in docs] + [(*docs[0], "x")], "doc_id long, text string, item string")
    I = spark.createDataFrame([(a, b, "x") for a, b in [*items, ("b98", None), ("b99", ""), items[0]]], "blind_id string, reference string, doc_id string")  # noqa: E741
    rows = leakage.leaked(D, I, pass_chars=pass_chars).collect()
    assert {(x["doc_id"], x["blind_id"]) for x in rows if x["passage"]} == leaks(docs[:80] + docs[-1:], items)
    assert next(x for x in rows if (x["doc_id"], x["blind_id"]) == (903, items[2][0]))["whole"] == (1.0 if len(items[2][1].split()) > 20 else 0.0)
    assert leakage.leaked(D.limit(0), I).count() == 0 and leakage.leaked(D, I.limit(0)).count() == 0


def test_simhash_radius():
    r = np.random.default_rng(5)
    w = r.integers(0, 2**63, size=500, dtype=np.uint64)
    for size in (1, 2, 12, 20, 31, 48):
        bits = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1)
        want = [np.packbits(2 * bits[i : i + size].sum(axis=0) > size).view(np.uint64)[0] for i in range(500 - size + 1)]
        assert leakage.simhashes(w, size).tolist() == want
    assert len(leakage.simhashes(w[:11], 12)) == 0
    for radius in (0, 2, 5, 7):
        prints = r.integers(0, 2**63, size=300, dtype=np.uint64)
        blocks = leakage.Blocks(prints, radius)
        asked = prints.copy()
        for i in range(300):
            for bit in r.choice(64, i % (radius + 2), replace=False):
                asked[i] ^= np.uint64(1) << np.uint64(bit)
        q, own = blocks.near(asked)
        want = {(i, j) for i in range(300) for j in np.flatnonzero(np.bitwise_count(prints ^ asked[i]) <= radius)}
        assert {*zip(q.tolist(), own.tolist(), strict=True)} == want


def test_edited_items():
    """Copies of whole items with few words changed: found at the item's scale, though no window is the same at radius 0."""
    r = random.Random(11)
    vocabulary = [f"w{i}x" for i in range(5_000)]
    items = [(f"b{i}", " ".join(r.choices(vocabulary, k=r.randrange(90, 300)))) for i in range(120)]
    docs = []
    for _, t in items:
        w = t.split()
        for i in range(0, len(w), 60):
            w[min(len(w) - 1, i + r.randrange(60))] = r.choice(vocabulary)
        docs.append(r.choices(vocabulary, k=40) + w + r.choices(vocabulary, k=40))
    index = leakage.Index(items)
    found = {(d, k): whole for d, k, _, whole in index.leaks(docs)}
    recall = sum(found.get((d, k), 0) >= leakage.LEAST for d, (k, _) in enumerate(items)) / len(items)
    narrow = {(d, k): whole for d, k, _, whole in leakage.Index(items, radius=0, item_radius=0).leaks(docs)}
    assert {*found} == {(d, k) for d, (k, _) in enumerate(items)}
    assert recall >= 0.75 > 0.7 > sum(narrow.get((d, k), 0) > 0 for d, (k, _) in enumerate(items)) / len(items), recall


def share(w):
    if len(w) < 8:
        return 0.0
    seen, hit = set(), set()
    for i in range(len(w) - 3):
        k = tuple(w[i : i + 4])
        if k in seen:
            hit |= set(range(i, i + 4))
        seen.add(k)
    return len(hit) / len(w)


def test_repetition(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(r.randrange(0, 40))]
        if i % 9 == 0:
            w += [r.choice(WORDS) for _ in range(r.randrange(1, 7))] * r.randrange(6, 15)
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "谢谢大家观看。" * 6), (503, "no " * 7), (504, "no, No. " * 5), rows[0]]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "pred_id long, hypothesis string, share double")
    got = {x["pred_id"]: x for x in repetition.repetition(df).collect()}
    assert len(got) == 405
    for i, t in rows[:400]:
        assert got[i]["share"] == pytest.approx(share((t or "").split()))
        assert got[i]["repetitive"] == (got[i]["share"] >= 0.4) or 0.3 < got[i]["share"] < 0.5
    assert sum(x["told"] for x in got.values()) > 0.95 * len(got)
    assert got[502]["repetitive"] and got[504]["repetitive"] and not got[503]["repetitive"] and got[500]["share"] == 0.0
    assert repetition.repetition(df.limit(0)).count() == 0
    assert repetition.repetition(df.where("pred_id = 502")).first()["repetitive"]
    assert repetition.repetition(df, shares=False).where("share IS NOT NULL").count() == 0


def test_forest_decides():
    """Held-out texts: the forest tells nearly all, and what it tells comes from its paths, not from the exact share."""
    r = random.Random(12)
    some = [" ".join(r.choices(WORDS, k=r.randrange(8, 80))) for _ in range(1_500)]
    detector = repetition.Detector(some[:1_000])
    held = [t.split() for t in some[1_000:]]
    held += [x for w in held[:200] for x in repetition.spoilt(w)]
    _, told, yes = detector.decide(held)
    exact = np.array([repetition.repeated_share(w) >= 0.4 for w in held])
    assert told.mean() > 0.9 and (yes == exact)[told].mean() > 0.995
    detector.forest = repetition.Forest(np.random.default_rng(0).random((256, 4)))
    assert (detector.decide(held)[2] != exact).sum() > 100


def test_evenly_spread_edits(spark):
    r = random.Random(7)
    rows, want = [], set()
    for step in (4, 5):
        for n in (24, 40, 60, 80, 120, 200):
            for k in range(4):
                w = [f"w{r.getrandbits(40)}x" for _ in range(n)]
                e = [f"e{r.getrandbits(40)}x" if i % step == step - 1 else x for i, x in enumerate(w)]
                a, b = f"{step}-{n}-{k}-a", f"{step}-{n}-{k}-b"
                rows += [(a, "train", "x", " ".join(w)), (b, "test", "x", " ".join(e))]
                want.add((a, b))
    df = spark.createDataFrame(rows, "example_id string, split string, corpus string, text string")
    assert {(x["id_a"], x["id_b"]) for x in overlap.cross_split_pairs(df).collect()} == want


def test_runs_of_all_pairs():
    r = random.Random(8)
    hot = count = None
    for t in range(3_000):
        a = r.choices(["ha", "ja", "no", *[f"w{i}" for i in range(r.choice([2, 30, 500]))]], k=r.randint(20, 90))
        b, most = list(a), len(a) // 4
        for _ in range(most):
            i = r.randrange(len(b))
            b[i : i + 1] = r.choice([[], ["new"], [r.choice(a)], [b[i], "more"]])
        if len(b) < overlap.LEAST_WORDS or overlap.within(a, b, max(len(a), len(b)) // 4) is None:
            continue
        if t % 2:
            # any order of rarity is right
            digest = np.unique(overlap.run_digests([a])[1].view(np.uint64))
            hot, count = digest, np.array([r.randint(1, 9) for _ in digest])
        owner, digest = overlap.run_digests([a, b], hot, count)
        assert len(set(digest[owner == 0]) & set(digest[owner == 1])) >= overlap.COMMON


def test_doubled_records(spark):
    """Records that hold their words twice, edited in one half: their chunks have two places each, and no link is lost."""
    r = random.Random(13)
    rows, want = [], set()
    for k in range(60):
        w = [f"w{r.getrandbits(40)}x" for _ in range(r.randrange(20, 50))]
        e = [f"e{r.getrandbits(40)}x" if i % 4 == 3 else x for i, x in enumerate(w)]
        rows += [(f"{k}-a", "train", "x", " ".join(w + w)), (f"{k}-b", "test", "x", " ".join(e + w))]
        want.add((f"{k}-a", f"{k}-b"))
    df = spark.createDataFrame(rows, "example_id string, split string, corpus string, text string")
    assert {(x["id_a"], x["id_b"]) for x in overlap.cross_split_pairs(df).collect()} == want


def sneaky(r, x, k):
    """Edits that spoil as many parts as they can: insertions within parts of six and five words, and a few others."""
    y = list(x)
    step = r.choice([2, 3, 3, 4])
    places = [*range(r.randrange(1, step + 1), len(x), step)]
    for i in sorted(r.sample(places, min(k, len(places))) if r.random() < 0.5 else places[:k], reverse=True):
        y[i:i] = [f"n{r.getrandbits(30)}"]
    while len(y) - len(x) < k and r.random() < 0.7:
        i = r.randrange(len(y) + 1)
        y[i:i] = [f"n{r.getrandbits(30)}"]
    return y


def test_keys_of_all_pairs():
    r = random.Random(21)
    seen = hard = 0
    for t in range(2_500):
        n = r.randint(20, 80) if t % 4 else 24
        x = [f"w{r.getrandbits(30)}" for _ in range(n)] if t % 3 else r.choices(["ha", "ja", *[f"w{i}" for i in range(40)]], k=n)
        if t % 2:
            y = sneaky(r, x, n // 3)
        else:
            y, most = list(x), r.choice([n // 4, n // 3])
            for i in sorted(r.sample(range(n), most), reverse=True):
                y[i : i + 1] = r.choice([[], ["new"], [x[i], f"m{i}"], [f"e{i}"]])
        x, y = r.choice([(x, y), (y, x)])
        if min(len(x), len(y)) < overlap.LEAST_WORDS or overlap.within(x, y, max(len(x), len(y)) // 4) is None:
            continue
        seen += 1
        hard += 2 * (len(x) // overlap.PART) <= max(len(x), len(y)) // 4
        assert set(overlap.candidate_keys(*overlap.word_codes([" ".join(x)]), True)[1]) & set(overlap.candidate_keys(*overlap.word_codes([" ".join(y)]), False)[1]), (x, y)
    assert seen > 800 and hard > 40


def test_disk_of_pairs(spark, tmp_path):
    """Sentences of few patterns share runs by chance: neither their keys nor chance pairs take more than four times the input."""
    r = random.Random(22)
    nouns, verbs = [f"noun{i}" for i in range(150)], [f"verb{i}" for i in range(80)]
    names = ["".join(r.choices("abdegiklmnorstu", k=9)) for _ in range(4_000)]
    say = lambda: [r.choice(["the", "that", "our"]), r.choice(nouns), r.choice(verbs), r.choice(["the", "this"]), r.choice(nouns), "near", r.choice(names)]
    rows = [(str(i), "train" if i % 3 else "test", "x", " ".join(w for _ in range(r.randrange(6, 14)) for w in say())) for i in range(12_000)]
    copies = [(f"c{i}", "test" if s == "train" else "train", "x", t.replace("noun1 ", "noun2 ")) for i, s, _, t in rows[:50]]
    path = str(tmp_path / "records")
    spark.createDataFrame(rows + copies, "example_id string, split string, corpus string, text string").write.option("compression", "zstd").parquet(path)
    size = lambda folder: sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    used = lambda: sum(size(d) for d in [shared_folder(spark).removeprefix("file:"), *local])
    before = used()
    got = overlap.cross_split_pairs(spark.read.parquet(path)).collect()
    assert len(got) == 50 and used() - before < 4 * size(path)


def test_spoilt_parts(spark):
    """Pairs at the bound of edits, either record the longer one, some of few words and some of many."""
    r = random.Random(23)
    rows, want = [], set()
    for k in range(400):
        n = r.choice([20, 24, 27, 35, 47, 53, 64, r.randint(20, 90), r.randint(200, 400)])
        x = [f"w{r.getrandbits(30)}x" for _ in range(n)] if k % 4 else [f"{k}v", *r.choices([f"{k}a", f"{k}b", f"{k}c"], k=n - 1)]
        y = sneaky(r, x, n // 3) if k % 3 else edited(r, x, n // 4)
        if min(len(x), len(y)) < overlap.LEAST_WORDS or overlap.within(x, y, max(len(x), len(y)) // 4) is None:
            continue
        x, y = r.choice([(x, y), (y, x)])
        rows += [(f"{k}-a", "train", "x", " ".join(x)), (f"{k}-b", "test", "x", " ".join(y))]
        want.add((f"{k}-a", f"{k}-b"))
    df = spark.createDataFrame(rows, "example_id string, split string, corpus string, text string")
    assert {(x["id_a"], x["id_b"]) for x in overlap.cross_split_pairs(df).collect()} >= want and len(want) > 200
