import random

import numpy as np

from chunkweave.llm.near_duplicates import corrected_similarity, exact_jaccard, near_duplicate_groups, pack, signatures


def norm(t):
    return t.lower().translate({ord(c): None for c in " \t\r\n"})


def brute(rows, threshold=0.6):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None and len(norm(t)) >= 100:
            texts[i] = norm(t)
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if exact_jaccard(texts[a], texts[b], 5) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((find(i), i) for i in ids if find(i) != i)


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij检阀") for _ in range(rng.randint(3, 9)))
    rows = []
    for g in range(25):
        base = [word() for _ in range(40)]
        for v in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(40)] = word()
            rows.append((f"{g:03d}-{v}", " ".join(own)))
    boiler = [word() for _ in range(36)]
    rows += [(f"h{k:03d}", " ".join([*boiler, word(), word(), word()])) for k in range(120)]  # a hot bucket
    rows += [("n1", None), ("n2", ""), (None, "x" * 300), ("s", "short"), rows[0], ("big", "lorem ipsum " * 90000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id string, content string, rid string")
    got = sorted((r.first_id, r.id) for r in near_duplicate_groups(df, "id", "content").collect() if r.id != r.first_id)
    assert got == brute([r for r in rows if r[0] != "big"])
    assert near_duplicate_groups(df.limit(0), "id", "content").count() == 0


def test_estimate_is_corrected():
    a = "".join(random.Random(1).choice("abcdefgh") for _ in range(4000))
    b = a[:2400] + "".join(random.Random(2).choice("stuvwxyz") for _ in range(1600))
    s = pack(signatures([a, b], 5))
    assert abs(corrected_similarity(s[0], s[1]) - exact_jaccard(a, b, 5)) < 0.2
    assert np.all(corrected_similarity(s[0], s[0]) == 1)



def test_blocks_meet_every_pair_of_components_once(spark, monkeypatch):
    """A large component, strays and middling ones in one bucket: all pairs of different components, and no others."""
    from chunkweave.llm import near_duplicates as nd

    monkeypatch.setattr(nd, "BLOCK", 4)
    sig = bytes(nd.HASHES // 2)
    comps = [1] * 40 + [50, 51, 52] + [60] * 5 + [70] * 3 + [80, 81]
    rows = [("k", n, c, sig) for n, c in enumerate(comps)] + [("m", 100 + n, n % 2, sig) for n in range(3)] + [("e", 200 + n, 7, sig) for n in range(6)]
    df = spark.createDataFrame(rows, "key string, rid bigint, comp bigint, sig binary").selectExpr("xxhash64(key) AS key", "rid", "comp", "sig")
    df, sigs = df.drop("sig"), df.select("rid", "sig")
    got = sorted((r.u, r.v) for r in nd._block_pairs(df, sigs, 0.6).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and a[1] < b[1])
    assert got == want
    most = nd._cells(df, sigs).groupBy("key", "i", "j").count().agg({"count": "max"}).first()[0]
    assert most <= 24  # two blocks, uneven by their hash
    assert nd._cells(df, sigs).filter("comp = 1").count() < 40 * 12


def test_a_component_beside_one_stray(spark):
    """A bucket filled by one component but for one text still gives that text's links."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = [(f"a{k:03d}", " ".join([*base[:55], *[word() for _ in range(5)]])) for k in range(80)]
    other = [*base[:40], *[word() for _ in range(20)]]
    rows += [("z1", " ".join(other)), ("z2", " ".join([*base[:47], *other[40:53]]))]
    df = spark.createDataFrame(rows, "id string, content string")
    got = sorted((r.first_id, r.id) for r in near_duplicate_groups(df, "id", "content").collect() if r.id != r.first_id)
    assert got == brute(rows)
