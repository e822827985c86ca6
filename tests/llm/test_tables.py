import itertools
import random

import pytest
from pyspark.sql import functions as F

from sitewise.llm import components, mixing, packing, quality, splits, textcopies, tokens, topn


def test_top_n(spark):
    rows = [("a", 1.0, "x"), ("a", 1.0, "w"), ("a", 3.0, "z"), ("a", None, "q"), ("a", float("nan"), "r"), ("b", -1.0, "y"), (None, 5.0, "u"), (None, 4.0, "v"), ("a", 1.0, "w")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "g string, s double, i string, salt int, Salt_ int")
    got = sorted((r.g or "-", r.s, r.i) for r in topn.top_n(df, ["g"], "s", "i", 3).collect())
    assert got == [("-", 4.0, "v"), ("-", 5.0, "u"), ("a", 1.0, "w"), ("a", 1.0, "w"), ("a", 3.0, "z"), ("b", -1.0, "y")]
    assert topn.top_n(df.limit(0), ["g"], "s", "i", 3).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        topn.top_n(df, ["g"], "s", "i", 0)


def test_top_n_of_a_hot_group_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(1)
        rows = [("hot" if r.random() < 0.7 else str(r.randrange(20)), float(r.randrange(30)), i) for i in range(3000)]
        got = {tuple(x) for x in topn.top_n(spark.createDataFrame(rows, "g string, s double, i long"), ["g"], "s", "i", 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {x for _, g in itertools.groupby(sorted(rows), key=lambda x: x[0]) for x in sorted(g, key=lambda x: (-x[1], x[2]))[:5]}
    assert got == want


def test_components(spark):
    r = random.Random(2)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [(f"m{r.randrange(80):02d}", f"m{r.randrange(80):02d}") for _ in range(50)] + [("z", "z"), (None, "z"), ("y", None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert got == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_running_total(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("w")).union(spark.createDataFrame([(None, 5, 2), (None, -5, 1)], "g long, k long, w long"))
    rows = df.collect()
    got = {(r.g, r.k): r.t for r in components.running_total(df, ["g"], "k", "w", "t", 16).collect()}
    assert got == {(r.g, r.k): sum(x.w for x in rows if x.g == r.g and x.k <= r.k) for r in rows}


@pytest.mark.parametrize("seed", range(30))
def test_closest_subset(seed):
    r = random.Random(seed)
    sizes = {r.randrange(1, 30): r.randrange(1, 5) for _ in range(r.randrange(1, 5))}
    total = sum(s * m for s, m in sizes.items())
    target = r.randrange(0, total + 1)
    sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*(range(m + 1) for m in sizes.values()))}
    got = splits.closest_subset(sizes, target)
    assert all(0 < n <= sizes[s] for s, n in got.items())
    assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in sums)


def test_closest_subset_beyond_the_bits():
    got = splits.closest_subset({1: 500, 7: 1000, 50: 100}, 6001, max_bits=300)
    assert sum(s * n for s, n in got.items()) == 6001


def test_closest_subset_keeps_one_step_for_each_total():
    import tracemalloc

    r = random.Random(5)
    sizes = {s: r.randrange(1, 9) for s in r.sample(range(50, 9000), 399)}
    tracemalloc.start()
    got = splits.closest_subset(sizes, 1_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * n for s, n in got.items()) == 1_000_000 and all(n <= sizes[s] for s, n in got.items())
    assert peak < 50_000_000


def test_closest_subset_of_a_billion():
    """Beyond the bitset the largest groups go first; small ones still settle the total exactly."""
    sizes = {10_000_000: 40, 1_000_000: 300, 7919: 60_000, 613: 100_000, 5: 1_000_000}
    got = splits.closest_subset(sizes, 512_345_678)
    assert abs(sum(s * n for s, n in got.items()) - 512_345_678) <= 1 and all(n <= sizes[s] for s, n in got.items())


def test_many_sides(spark):
    """Every side of the targets counts, however many there are."""
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("mp-"), F.col("id").cast("string")).alias("material_id"), F.lit(None).cast("string").alias("chemsys"), F.lit(None).cast("string").alias("_split"))
    t = spark.createDataFrame([(f"side{i}", 1.0) for i in range(150)], "split_name string, target_share double")
    n = {r.side: r["count"] for r in splits.assign(rows, t).groupBy("side").count().collect()}
    assert len(n) == 150 and set(n.values()) == {20}


SPLIT = "row_id long, material_id string, chemsys string, _split string, group_id string, component long"


def test_splits(spark):
    rows = [(1, "mp-1", "Li-O", "train", "", 0), (2, "MP-1 ", "O Fe Li", "val", "", 0), (3, "mp-2", "FeLiO", None, "", 0), (4, "mp-3", None, "test", "", 0), (5, "mp-3", None, "valid", "", 0), (6, None, None, "train", "", 0), (7, None, None, "val", "", 0), (8, "mp-4", "Li-S", "Train", "", 0), (9, "mp-5", "Li-S", " train", "", 0)]
    df = spark.createDataFrame(rows, SPLIT)
    assert {tuple(r) for r in splits.broken(df).collect()} == {("Fe-Li-O", 1), ("Fe-Li-O", 2), ("Fe-Li-O", 3), ("mp-3", 4), ("mp-3", 5)}
    t = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, target_share double")
    many = df.union(spark.range(100, 400).select("id", F.concat(F.lit("mp-"), (F.col("id") % 90 + 10).cast("string")), F.lit(None), F.lit("train"), F.lit(""), F.lit(0).cast("long")))
    a = splits.assign(many, t).collect()
    side = {r.row_id: r.side for r in a}
    assert len(a) == many.count() == len(side) and side[1] == side[2] == side[3] and side[4] == side[5] and side[8] == side[9]
    n = {s: sum(v == s for v in side.values()) / len(side) for s in ("train", "val", "test")}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["val"] - 0.1) < 0.01 and abs(n["test"] - 0.1) < 0.01
    per = {}
    for r in splits.groups(many).collect():
        per.setdefault(r.group_id, set()).add(side[r.row_id])
    assert all(len(s) == 1 for s in per.values())
    assert splits.broken(df.limit(0)).count() == 0 and splits.assign(df.limit(0), t).count() == 0


def test_tokens_round_trip():
    e = tokens.encoder(tokens.VOCABULARY)
    for text in ("", "Plain words.", " " * 60_000 + "x" + "\n" * 9000, "a" * 100_000, "<|endoftext|> é 😀", "x" + " " * 5000 + "y  z"):
        assert e.decode(tokens.encode(text)) == text


@pytest.mark.parametrize("seed", range(8))
def test_pack(seed):
    r = random.Random(seed)
    sizes = [r.randrange(0, 100) for _ in range(300)]
    clusters = [r.choice([-1, 0, 1, 2]) for _ in sizes]
    sources = [r.randrange(4) for _ in sizes]
    place, relaxed = packing.pack(sizes, clusters, sources, 128, {0: 0b10, 1: 0b01})
    fill, seen, held = {}, {}, {}
    for i, p in enumerate(place):
        fill[p] = fill.get(p, 0) + sizes[i]
        held.setdefault(p, set()).add(sources[i])
        if not relaxed[i] and clusters[i] >= 0:
            seen.setdefault((p, clusters[i]), []).append(i)
    assert max(fill.values()) <= 128 and not any({0, 1} <= s for s in held.values())
    alone = packing.pack(sizes, [-1] * 300, [0] * 300, 128)[0]
    assert len(set(alone)) <= -(-sum(sizes) // 128) + 2


def test_fill(spark):
    docs = [(i, "word " * (i % 50), "en", ["s1", "s2", None][i % 3], "x", 0) for i in range(200)] + [(900, "word " * 3000, "en", "s1", "x", 0), (901, None, "en", "s1", "x", 0), (902, "", "en", "s2", "x", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, size string, shard int")
    specs = spark.createDataFrame([(1, 64), (2, 512)], "spec_id int, capacity_tokens int")
    c = tokens.counted(df)
    rows = packing.fill(c, specs).collect()
    n = {r.doc_id: r.n_tokens for r in c.collect()}
    for spec, cap in ((1, 64), (2, 512)):
        pieces, used = {}, {}
        for r in rows:
            if r.spec_id == spec:
                pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
                used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert set(pieces) == set(n) and max(used.values()) <= cap
        for d, ps in pieces.items():
            at = 0
            for first, k in sorted(ps):
                assert first == at
                at += k
            assert at == n[d] and (len(ps) == 1 or n[d] > cap)
        assert sum(used.values()) / (len(used) * cap) > 0.95
    assert {r.spec_id: r.n_documents for r in packing.fill_report(packing.fill(c, specs), specs).collect()} == {1: 202, 2: 202}
    assert packing.fill(c.limit(0), specs).count() == 0
    with pytest.raises(ValueError, match="capacities"):
        packing.fill(c, spark.createDataFrame([(1, 0)], "spec_id int, capacity_tokens int"))


def test_fill_of_repeated_documents_and_large_capacities(spark):
    """Rows of one document are told apart, and shards are large enough for the capacity."""
    twice = spark.createDataFrame([(1, "s", 7, 600, 10), (1, "s", 7, 600, 11), (1, "s", 7, 512, 12)], "doc_id long, source string, same long, n_tokens long, row long")
    spec = lambda *c: spark.createDataFrame(list(enumerate(c)), "spec_id int, capacity_tokens int")
    used = {}
    for r in packing.fill(twice, spec(512)).collect():
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 512 and sum(used.values()) == 1712
    many = spark.createDataFrame([(i, "s", i, 1000, i) for i in range(3000)], "doc_id long, source string, same long, n_tokens long, row long")
    for r in packing.fill_report(packing.fill(many, spec(4096, 131_072, 600_000, 1_500_000)), spec(4096, 131_072, 600_000, 1_500_000)).collect():
        shards = packing.shards_of(3_000_000, 3000, r.capacity)
        assert r.n_containers < -(-3000 // (r.capacity // 1000)) + shards
    assert packing.shards_of(10**12, 10**9, 4096) == 10**6 and packing.shards_of(10**12, 10**9, 10**8) == 156
    found = packing.invariants(packing.fill(twice, spec(512)), twice, spec(512)).collect()
    assert [tuple(r) for r in found] == [(0, 3, 0, 0, 0)]
    lost = packing.invariants(packing.fill(twice, spec(512)).where("row <> 11 or piece = 1"), twice, spec(512)).collect()
    assert lost[0].n_broken == 1


def test_tokens_of_long_runs_of_blanks(spark):
    """Counts are those of the tokenizer itself, which takes runs of this length whole."""
    e = tokens.encoder(tokens.VOCABULARY)
    for text in ("ab" + " " * 9000 + "cd", "x" + "\n" * 5000, " " * 5000 + "\tz", "a" + "\u00a0 " * 4000 + "b" + " " * 6000 + ". c", "q" + "\x1c" * 5000 + "r"):
        assert tokens.encode(text) == e.encode_ordinary(text)


def test_mixing(spark):
    rows = [(i, ["a", "b", "c", None][0 if i < 700 else 1 if i < 950 else 2 if i < 990 else 3], i, (i * 37) % 200 + 1) for i in range(1000)]
    c = spark.createDataFrame(rows, "doc_id long, source string, same long, n_tokens long")
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mixing.report(c, t).collect()}
    for s, share, cap in (("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 3)):
        assert abs(rep[s].reached_share - share) < 0.005 and rep[s].most_uses <= cap
    assert rep["absent"].drawn_tokens == 0
    drawn = mixing.draw(c, t, total=10_000_000).collect()
    assert {r.doc_id: r.uses for r in drawn} == {i: {"a": 1, "b": 2, "c": 3}[s] for i, s, _, _ in rows if s}
    assert mixing.draw(c.limit(0), t).count() == 0
    assert mixing.draw(c, t).collect() == mixing.draw(c.repartition(7), t).collect() or {tuple(r) for r in mixing.draw(c, t).collect()} == {tuple(r) for r in mixing.draw(c.repartition(7), t).collect()}


def test_quality(spark):
    prose = "The old map was kept because nobody had asked for it, and we looked at it again. It is not clear to us if this will help."
    texts = {1: prose, 2: "a-1\nb-2\nc-3\nd-4", 3: "1.0 2.0 3.0\n4.0 5.0 6.0", 4: "", 5: None, 6: "  \n ", 7: prose + "\n" + "x9/+Qz" * 400, 8: (prose + " ") * 3000, 9: "gap trend cell gap force trend cell", 10: "Es ist nicht klar, ob die Karte noch mit der alten Rechnung zu tun hat, aber wir haben sie auch nicht mehr.", 11: prose}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, t int")
    none = spark.createDataFrame([], "doc_id long, text_kind string")
    assert {r.doc_id for r in quality.judged(df, none).where("not natural_prose").collect()} == {2, 3, 4, 5, 6, 7, 9}
    s = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert s[4].n_words == s[5].n_words == s[6].n_words == 0 and s[2].n_lines == 4 and s[3].digit_ratio > 0.4
    assert quality.judged(df.limit(0), none).count() == 0


def test_rules_are_learned_and_exported(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.random((600, len(quality.FEATURES)))
    y = (x[:, 0] < 0.4) | (x[:, 3] > 0.8)
    rules = quality.induce(x[:400], y[:400])
    got = np.zeros(200, bool)
    for rule in rules:
        got |= quality._covers(rule, x[400:])
    assert (got == y[400:]).mean() > 0.95
    df = spark.createDataFrame([(i, 1, *map(float, v)) for i, v in enumerate(x[400:])], ", ".join(["i int", "n_words int", *(f"{f} double" for f in quality.FEATURES)]))
    assert [r.hit for r in df.orderBy("i").select((F.expr(quality.case_sql(rules)) > 0).alias("hit")).collect()] == got.tolist()


def jaccard(x, y):
    def of(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = of(x), of(y)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_near_texts_against_brute_force(spark):
    """Texts of 1 to 300 words edited a little or more: every pair at 0.8 or above is found, and no other."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = ["", "one", "One", "one two three", "one two three"]
    for n in [5, 6, 8, 12, 20, 45, 80, 150, 300] * 4:
        base = [r.choice(vocabulary) for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, 1, max(1, n // 60), max(1, n // 45), n // 20):
            w = list(base)
            for _ in range(edits):
                i = r.randrange(len(w))
                w[i : i + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    name = {row.h: row.text for row in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    got = {frozenset((name[x.a], name[x.b])) for x in textcopies.near_texts(df).collect()}
    distinct = sorted(set(texts))
    want = {frozenset((x, y)) for x, y in itertools.combinations(distinct, 2) if jaccard(x, y) >= 0.8}
    assert got == want and len(want) > 100
    assert textcopies.near_texts(df.limit(0)).count() == 0


def test_clusters_of_texts_are_kept_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text + " more"), (3, text), (4, "something else here"), (5, None)]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in docs], "doc_id long, text string, source string, same int")
    c = {x.doc_id: x.same for x in textcopies.clustered(tokens.counted(df), df).collect()}
    assert c[1] == c[2] == c[3] != c[4] and 5 not in c
    spec = spark.createDataFrame([(1, 4096)], "spec_id int, capacity_tokens int")
    few = packing.fill(textcopies.clustered(tokens.counted(df), df), spec).collect()
    assert sum(x.relaxed for x in few) == 2  # all fit into one container, so no second one is opened for a conflict


def test_held_out_accuracy(spark):
    """Documents of four kinds, a quarter of them mixed: judged by rules that were fitted without them."""
    r = random.Random(8)
    nouns = "lattice barrier frame cell force model anion split path image gap trend".split()

    def sentence():
        return f"The {r.choice(nouns)} of the {r.choice(nouns)} was not as large as we had thought, and it is still in the {r.choice(nouns)}."

    make = {
        "prose": lambda: " ".join(sentence() for _ in range(r.randint(2, 9))),
        "list": lambda: "\n".join(f"- {r.choice(nouns)} {r.choice(nouns)}" for _ in range(r.randint(4, 20))),
        "table": lambda: "\n".join(" ".join(f"{r.uniform(-9, 9):.3f}" for _ in range(5)) for _ in range(r.randint(3, 12))),
        "junk": lambda: " ".join("".join(r.choice("qwzkjfgh") for _ in range(r.randint(3, 12))) for _ in range(r.randint(10, 60))),
    }
    rows = []
    for i in range(400):
        kind = r.choice(list(make))
        text = make[kind]()
        if i % 4 == 0:  # a smaller piece of another kind
            other = make["prose" if kind != "prose" else "table"]()
            text = text + "\n" + other[: len(text) // 3]
        rows.append((i, text, kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, text_kind string")
    got = quality.held_out(df.drop("text_kind"), df.drop("text")).set_index("text_kind")
    assert got["n_documents"].sum() == 400 and (got["n_right"] / got["n_documents"]).min() > 0.93
    model = quality.fit(df.drop("text_kind"), df.drop("text"))
    assert len({c.feature for rule in model.sentences for c in rule}) > 1
    judged = quality.judged(df.drop("text_kind"), df.drop("text")).select("doc_id", "natural_prose").toPandas().set_index("doc_id")["natural_prose"]
    assert sum(judged[i] == (k == "prose") for i, _, k in rows) > 380


def test_every_query_has_a_name_of_a_problem():
    from sitewise.llm import queries

    assert set(queries.SQL) <= set(queries.QUERIES) and {n.split("_")[0] for n in queries.QUERIES} == {"p1", "p3", "p5", "p6", "p8", "p9", "p10"}
