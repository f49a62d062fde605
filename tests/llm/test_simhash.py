import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import simhash
from packetloom.llm.components import components


def plain(text, k=4):
    words = [w for w in (text or "").encode().lower().replace(b"\x1c", b"\x1c").split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(pairs, tau=4):
    """pairs: (doc_id, fingerprint); the least doc_id reachable per fingerprint."""
    fps = sorted({f for _, f in pairs})
    of = {f: f for f in fps}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= tau:
                of[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for d, f in pairs:
        if d is not None:
            r = root(f)
            least[r] = d if least[r] is None else min(least[r], d)
    return {f: least[root(f)] for f in fps}


def brute(rows):
    pairs = [(r.doc_id, plain(r.text)) for r in rows]
    named = reach(pairs)
    return sorted(((d, f"{f:016x}", named[f]) for d, f in pairs), key=str)


def test_documents_and_odd_rows(docs, rows, odd, none):
    for df in (docs, odd):
        assert sorted((tuple(r) for r in simhash.near_dedup(df).collect()), key=str) == brute(df.collect())
    assert simhash.near_dedup(none).count() == 0


def clouds(seed, n=300):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        f = draw.choice(centres)
        for _ in range(draw.randint(0, 6)):
            f ^= 1 << draw.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_connect_what_all_pairs_connect(spark, hot):
    """hot = 3: nearly every key takes the path without pairs."""
    fps = clouds(1)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "fp long, doc_id long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.group(df, hot=hot).collect()}
    assert got == reach([(i, f) for i, f in enumerate(fps)])


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 5])
def test_any_allocation_finds_all(spark, parts, monkeypatch):
    fps = clouds(parts, 200)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "fp long, doc_id long")
    cut = [list(range(64))[i::parts] for i in range(parts)]
    spread = [[4], [2, 1], [1, 1, 0], [1, 0, 0, 0], [0] * 5][parts - 1]
    monkeypatch.setattr(simhash, "allocate", lambda *a: (cut, spread))
    assert {r.fp % (1 << 64): r.component_id for r in simhash.group(df).collect()} == reach([(i, f) for i, f in enumerate(fps)])


def test_allocation_spends_the_threshold(spark):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in clouds(9)], "fp long")
    n, both = simhash.bit_statistics(df)
    assert n == df.count()
    for size in (n, 10**7, 10**9):
        parts, t = simhash.allocate(size, both * (size / n), 4)
        assert sorted(b for p in parts for b in p) == list(range(64)) and sum(x + 1 for x in t) == 5


def test_crowded_runs_keep_a_forest():
    draw = np.random.default_rng(5)
    fp = np.unique(np.uint64(77) ^ (np.uint64(1) << draw.integers(0, 64, 500).astype(np.uint64)))
    u, v = simhash.forest(fp, 4)
    assert len(u) == len(fp) - 1


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def grams(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def wide_reach(rows):
    """Groups of rows whose sets of five-word shingles a Jaccard similarity of 0.8 links, by all pairs."""
    sets, label = [grams(r.text) for r in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def test_one_of_each_group_stays(docs, rows, odd, none):
    for df in (docs, odd):
        own = df.collect()
        least = {}
        for r, k in zip(own, wide_reach(own)):
            key = (r.doc_id is None, r.doc_id)
            least[k] = min(least.get(k, key), key)
        kept = simhash.keep_one(df)
        assert kept.schema.names == df.schema.names
        assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted((d for _, d in least.values()), key=str)
    assert simhash.keep_one(none).select(F.count("*")).first()[0] == 0


def test_clashing_columns_are_kept(spark):
    names = ["_rid", "rid", "row", "node", "key", "first"]
    df = spark.createDataFrame([(i, f"text number {i % 2}", *(f"{c}{i}" for c in names)) for i in range(4)], ["doc_id", "text", *names])
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.filter("doc_id < 2").collect()))


def test_near_copies_go_and_others_stay(spark):
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    rows = [(i, draw.choices(vocabulary, k=300)) for i in range(120)]
    for i in range(0, 60):
        copy = list(rows[i][1])
        copy[draw.randrange(300)] = "changed"
        copy[draw.randrange(300)] = "again"
        rows.append((1000 + i, copy))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert set(range(120)) <= kept and len([i for i in kept if i >= 1000]) <= 2


def test_borderline_pairs_are_found_and_pairs_below_are_not(spark):
    draw = random.Random(23)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    rows, above, below = [], set(), set()
    for i in range(200):
        words = draw.choices(vocabulary, k=400)
        copy = list(words)
        for at in draw.sample(range(400), 7 if i % 2 else 14):  # about 0.84 and 0.7
            copy[at] = "changed"
        near = jaccard(grams(" ".join(words)), grams(" ".join(copy)))
        (above if near >= 0.8 else below).add(1000 + i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert below | set(range(200)) <= kept and len(above) > 50 and len(above & kept) <= len(above) * 0.1


@pytest.mark.parametrize("tau", [2, 3, 4, 5])
def test_crowded_keys_for_even_and_odd_thresholds(spark, tau):
    draw = random.Random(tau)
    base = [draw.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, doc_id long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.group(df, tau, hot=5).collect()}
    assert got == reach([(i, f) for i, f in enumerate(fps)], tau)


def kept_ids(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one(df, **more).collect()}


def plain_ids(texts):
    """The least of each group that a Jaccard similarity of 0.8 links, by all pairs."""
    sets, label = [grams(t) for t in texts], list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(texts))}


def test_texts_that_share_only_a_repeated_shingle_stay(spark):
    draw = random.Random(7)
    own = lambda k: [f"w{draw.getrandbits(60):x}" for _ in range(k)]
    rule = ["-----"] * 34
    texts = [" ".join([*own(60), *rule]) for _ in range(20)]
    assert kept_ids(spark, texts) == set(range(20))


def test_pairs_of_one_template_are_found_in_dense_keys(spark):
    """40 pairs at 0.85 of one template; 0.69 across pairs."""
    draw = random.Random(29)
    word = lambda: f"w{draw.getrandbits(60):x}"
    frame, texts = [word() for _ in range(400)], []
    for _ in range(40):
        page = list(frame)
        for at in range(5, 400, 28):
            page[at] = word()
        copy = list(page)
        for at in draw.sample(range(19, 380, 28), 6):
            copy[at] = word()
        texts += [" ".join(page), " ".join(copy)]
    want = plain_ids(texts)
    assert want == set(range(0, 80, 2))
    assert kept_ids(spark, texts) == kept_ids(spark, texts, hot=20) == want


def test_groups_are_those_of_plain_jaccard(spark, rows):
    draw = random.Random(31)
    vocabulary = [f"w{draw.getrandbits(60):x}" for _ in range(5000)]
    texts = [r.text or "" for r in rows]
    for size in (8, 9, 12, 16, 19, 24, 29, 45, 54, 104, 254):
        for _ in range(25):
            text = draw.choices(vocabulary, k=size)
            copy = text[: max(5, round(size * draw.uniform(0.75, 0.95)))]
            texts += [" ".join(text), " ".join(copy)]
    common = draw.choices(vocabulary, k=104)
    texts += [" ".join(common), " ".join(common) + (" " + " ".join(draw.choices(vocabulary, k=5))) * 10]
    assert kept_ids(spark, texts) == plain_ids(texts)


def test_similar_sets_share_a_key():
    draw = np.random.default_rng(2)
    for n in [*range(1, 40), 100, 999]:
        for _ in range(30):
            a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
            gone = draw.integers(0, n // 5 + 1)
            more = draw.integers(0, int((n - gone) / 0.8 - n + 1e-9) + 1) if (n - gone) / 0.8 >= n else 0
            b = np.unique(np.concatenate([a[draw.permutation(n)[gone:]], draw.integers(0, 1 << 63, more).astype(np.uint64)]))
            assert (n - gone) / (n + more) >= 0.8
            own, every = ([set(np.concatenate([k for o, k in simhash.set_keys(x, 0.8) if o or most]).tolist()) for x in (a, b)] for most in (0, 1))
            assert own[0] & every[1] or own[1] & every[0]


def template_pages(draw, n, size, own):
    """Pages of one template of ``size`` words, in each of which a block of its own takes the place of ``own`` of them."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(size)]
    return [" ".join([*base[:at], *(word() for _ in range(own)), *base[at + own :]]) for at in (draw.randrange(size - own) for _ in range(n))]


def put_out(spark, sets, similarity=0.8):
    """The pairs that ``unjoined`` puts out for sets that are all under their keys and joined with none."""
    rows, held = [], []
    for node, g in enumerate(sets):
        for own, keys in simhash.set_keys(g, similarity):
            rows += [(int(k), node, own, node) for k in keys]
        held.append((node, len(g), [int(x) for x in simhash.wide_parities(g)]))
    members = spark.createDataFrame(rows, "key long, node long, own boolean, label long")
    return {(r.u, r.v) for r in simhash.unjoined(members, spark.createDataFrame(held, "node long, size long, wide array<long>"), similarity).collect()}


@pytest.mark.parametrize("size", [500, 1000, 2000, 4000, 8000])
def test_pages_of_a_template_that_are_not_similar_put_out_no_pairs(spark, size):
    pages = [grams_of(p) for p in template_pages(random.Random(size), 20, size, size * 18 // 100)]
    alike = [jaccard(set(a.tolist()), set(b.tolist())) for a, b in zip(pages, pages[1:])]
    assert max(alike) < 0.72 and put_out(spark, pages) == set()


def grams_of(text):
    return simhash.shingles(text, 5)


def test_output_grows_with_the_members_of_a_template_of_long_pages(spark):
    pages = template_pages(random.Random(5), 200, 8000, 1400)
    assert len(put_out(spark, [grams_of(p) for p in pages])) <= 200


def test_wide_sketches_fold_and_bound_the_difference():
    draw = np.random.default_rng(2)
    for n in (10, 700, 3000, 20_000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], draw.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        x, y = (simhash.wide_parities(g).view(np.uint64) for g in (a, b))
        assert 64 * len(x) >= 2 * n
        sizes = np.array([len(x), len(y)])
        rows = simhash.folded(np.concatenate([x, y]), np.array([0, len(x)]), sizes)
        assert rows.shape == (2, sizes.min()) and np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
        assert (rows[0].view(np.int64) == simhash.parities(a, rows.shape[1])).all()


@pytest.mark.parametrize("size,n", [(400, 120), (3000, 60)])
def test_borderline_pages_of_a_template_are_found_as_by_all_pairs(spark, size, n):
    draw = random.Random(size)
    pages = [p for own in (7, 9, 10, 11, 14) for p in template_pages(random.Random(1), n // 5, size, size * own // 100)]
    pages += draw.sample(pages, 5)
    assert kept_ids(spark, pages) == plain_ids(pages)


def test_names_that_share_a_node_are_told_apart(spark):
    texts = [f"text number {i // 2} of a set with a few more words {i // 2}" for i in range(60)]
    assert kept_ids(spark, texts, bits=3) == plain_ids(texts) and len(plain_ids(texts)) == 30
