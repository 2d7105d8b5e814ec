"""Each operator on small awkward tables, against brute force."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _common, bpe, embeddings, exact_dedup, mixing, quality, queries, secrets, sharding, simhash, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size int, digest string, judged0 int, _bin int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def rows():
    r = random.Random(0)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(4, 120))) for _ in range(60)]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(base)]
    out += [(100 + i, base[0], None, "s0") for i in range(40)]  # copies: a third
    out += [(200 + i, base[1] + f" tail{i}", "en", "s1") for i in range(5)]  # near copies
    out += [(300, None, None, None), (301, "", "en", "s9"), (302, " \n\t ", "en", "s9"), (303, "Ünï cödé 👍 x", "de", "s2"), (304, LONG, "en", "s2")]
    out += [(305, base[5], "en", "s1")] * 3 + [(None, base[6], "en", None), (None, None, None, None)]  # repeated rows, null ids
    return out


@pytest.fixture(scope="module")
def docs(spark):
    full = [(i, t, lang, s, None if t is None else len(t), "r", "k", 1, "d", 2, 3) for i, t, lang, s in rows()]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs):
    got = exact_dedup.mark_copies(docs).toPandas()
    d = pd.DataFrame(rows(), columns=["doc_id", "text", "lang", "source"])
    d["text"] = d["text"].fillna("")
    want = d.groupby("text")["doc_id"].agg(["max", "size"])
    assert len(got) == len(d)
    by = {hashlib.sha256(t.encode()).hexdigest(): (x["max"], x["size"]) for t, x in want.iterrows()}
    for x in got.itertuples():
        keep, size = by[x.text_sha256]
        assert x.group_size == size and (x.keep_id == keep or (pd.isna(x.keep_id) and pd.isna(keep)))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(want)
    assert left.where("doc_id = 305").count() == 1 and left.where("text IS NULL").count() + left.where("text = ''").count() == 1


def test_exact_dedup_with_colliding_digests(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    got = exact_dedup.mark_copies(docs).toPandas()
    d = pd.Series([t or "" for _, t, *_ in rows()])
    assert sorted(got.group_size) == sorted(d.map(d.value_counts()))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        s, t = find(a), find(b)
        root[max(s, t)] = min(s, t)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("longest", [128, 2])
def test_simhash_links(spark, longest):
    r = random.Random(longest)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(60)} | {centre ^ i for i in range(40)} | {r.getrandbits(64) for _ in range(50)} | {0}
    fps = sorted(simhash._signed(x) for x in fps)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), longest=longest).collect()
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want)


def test_simhash_groups(docs):
    got = simhash.group(docs).toPandas()
    data = rows()
    fp = [simhash.fingerprint(t) for _, t, *_ in data]
    comp = brute_components(range(len(data)), [(i, j) for i in range(len(data)) for j in range(i) if ((fp[i] ^ fp[j]) % 2**64).bit_count() <= 3])
    least = {}
    for i, c in comp.items():
        if data[i][0] is not None:
            least[c] = min(least.get(c, 1 << 60), data[i][0])
    want = sorted((f"{fp[i] % 2**64:016x}", str(data[i][0]), str(least.get(comp[i]))) for i in range(len(data)))
    text = lambda v: "None" if pd.isna(v) else str(int(v))
    assert sorted((x.fingerprint, text(x.doc_id), text(x.component_id)) for x in got.itertuples()) == want
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns and left.where("doc_id = 100").isEmpty()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(500, 500 + i) for i in range(1, 60)] + [(600 + i, 601 + i) for i in range(40)]
    want = brute_components({x for e in edges for x in e}, edges)
    for few in (0, 10_000):
        got = {x.node: x.root for x in _common.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert all(got.get(i, i) == c for i, c in want.items())
    assert _common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounded_rank(spark):
    data = [(i % 3, i, i % 5) for i in range(200)]
    got = _common.bounded_rank(spark.createDataFrame(data, "a int, b int, v int"), ["a", "b"], sums={"before": "v"}, rank="n").collect()
    run = 0
    for n, (a, b, v) in enumerate(sorted(data)):
        x = next(g for g in got if (g.a, g.b) == (a, b))
        assert (x.n, x.before) == (n, run)
        run += v


def test_embeddings(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(25, 12))
    vecs = [[float(x) for x in np.float32(base[i % 25] + s * r.normal(size=12))] for i in range(300) for s in (0.05 + 0.4 * (i % 3),)]
    vecs += [vecs[0]] * 30 + [None, [], [0.0] * 12, [float("nan")] * 12, [None] * 12, [float("inf")] * 12, [1.0] * 5, [2.0] * 5]
    data = [(i, v, 1 if i % 4 else (2 if i % 8 else None)) for i, v in enumerate(vecs)] + [(None, vecs[1], 1), (7, vecs[7], 1)]
    df = spark.createDataFrame([(*x, "extra") for x in data], "vec_id long, embedding array<float>, label int, rep string")
    got = embeddings.group(df, block=16, fan=3).toPandas()
    usable = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    x = [None if not usable(v) or lab is None else np.array(v) / np.linalg.norm(v) for _, v, lab in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if x[i] is not None and x[j] is not None and data[i][2] == data[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.93]
    comp = brute_components(range(len(data)), links)
    least, n = {}, np.zeros(len(data), int)
    for i, c in comp.items():
        if data[i][0] is not None:
            least[c] = min(least.get(c, 1 << 60), data[i][0])
    for i, j in links:
        n[i] += 1
        n[j] += 1
    text = lambda v: "None" if v is None or pd.isna(v) else str(int(v))
    want = sorted((text(data[i][0]), int(n[i]), text(least.get(comp[i]))) for i in range(len(data)))
    assert n.max() > 20
    assert sorted((text(v.vec_id), v.n_links, text(v.component_id)) for v in got.itertuples()) == want
    assert embeddings.group(df.limit(0)).count() == 0


def test_shards(docs, spark):
    for shards in (8, 3):
        got = sharding.shard(docs, shards).toPandas()
        data = rows()
        assert len(got) == len(data) and set(got.law) == {"bytes"}
        sizes = sorted(len((t or "").encode()) + 1 for _, t, *_ in data)
        assert sorted(got["size"]) == sizes
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    # Equal rows without a giant among them: sizes are near equal, and copies share a shard.
    even = spark.createDataFrame([(i, f"text {i // 3:05d} " + "x" * 50) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(even, 8).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 0.03 * total.mean()
    assert (got.merge(even.toPandas(), on="doc_id").groupby("text").shard.nunique() == 1).all()
    # One text with most of the bytes is cut by id.
    hot = spark.createDataFrame([(i, "same text of some length" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    total = sharding.shard(hot, 8).toPandas().groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 0.03 * total.mean()


def test_splitters_equal_brute_force(docs):
    """Boundaries against all rows in order: as near to the goal as the nearest one, or within the tolerance."""
    rows_ = docs.where("doc_id != 304").select(sharding.size_bytes(F.col("text")).alias("size"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("key"),
                                               F.shiftrightunsigned(F.col("doc_id").bitwiseXOR(F.lit(-(2**63))), 1).alias("key2")).cache()
    data = sorted((r.key, r.key2, r["size"]) for r in rows_.collect())
    total, most = sum(x[2] for x in data), max(x[2] for x in data)
    for shards in (2, 3, 8):
        allowed = int(sharding.TOLERANCE * total / shards)
        for n, (a, b) in enumerate(sharding.splitters(rows_, shards)):
            goal = total * (n + 1) // shards
            below = sum(s for k, k2, s in data if (k, k2) < (a, b))
            run, edges = 0, [0]
            for i, (k, _, s) in enumerate(data):
                run += s
                if i + 1 == len(data) or data[i + 1][0] != k:
                    edges.append(run)
            nearest = min(abs(e - goal) for e in edges)
            if b == 0:  # between two texts
                assert abs(below - goal) <= max(allowed, nearest)
            else:  # inside a group of copies, which alone misses the tolerance
                assert nearest > max(allowed, most // 2) and abs(below - goal) <= most


def test_awkward_types(spark):
    maps = spark.createDataFrame([(1, "a", {"x": 1}), (2, "a", {"x": 2}), (2, "a", {"x": 3}), (None, "a", None), (None, None, {"y": 1})], "doc_id long, text string, m map<string,int>")
    left = exact_dedup.drop_copies(maps).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, None), (2, "a")]
    assert sorted(map(str, exact_dedup.drop_copies(maps.repartition(5)).collect())) == sorted(map(str, left))  # ties do not go by the partitioning
    names = spark.createDataFrame([(x, "text " * n) for n, x in enumerate(["a", "None", None, "a>b", "é", "7"])], "doc_id string, text string")
    out = sharding.shard(names, 2).toPandas()
    assert len(out) == 6 and set(out.shard) <= {0, 1} and sorted(out.groupby("shard").slot.apply(list).map(sorted).explode()) == sorted(i for n in out.shard.value_counts() for i in range(n))
    pages = names.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("same").alias("html"))
    got = warc.archive_and_read(pages).collect()
    assert sorted((str(r.page_id), r.page_id is None, r.record_type, r.refers_to) for r in got) == sorted((str(x), x is None, "response" if x == "7" else "revisit", None if x == "7" else "7") for x in ["a", "None", None, "a>b", "é", "7"])
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [1e-300, 0.0], [5e-324, 5e-325]]
    for kind, a, b in (("double", 0.5, 1.5), ("boolean", True, False), ("date", datetime.date(2020, 1, 1), datetime.date(2021, 1, 1))):
        data = [(i, v, a) for i, v in enumerate(vectors)] + [(9, [1.0, 0.0], b), (10, [1.0, 0.0], None)]
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.group(spark.createDataFrame(data, f"vec_id long, embedding array<double>, label {kind}")).collect()}
        assert got == {0: (3, 0), 1: (3, 0), 3: (3, 0), 4: (3, 0), 2: (0, 2), 9: (0, 9), 10: (0, 10)}, kind


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= each * w[s]}
        if not full:
            target |= {s: each * w[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(docs):
    got = mixing.taken(docs).toPandas()
    data = pd.DataFrame([(i, len((t or "").encode().split()), s) for i, t, _, s in rows()], columns=["doc_id", "words", "source"])
    assert sorted(got["size"]) == sorted(data.words)
    sizes = {s: int(data.words[data.source.eq(s) if s is not None else data.source.isna()].sum()) for s in set(data.source.where(data.source.notna(), None))}
    want = brute_targets(sizes)
    one = got.drop_duplicates(["source_size", "target"])
    assert sorted(zip(one.source_size, one.target.round(6))) == sorted((sizes[s], round(want[s], 6)) for s in sizes)
    assert (got.taken <= 2 * got["size"]).all()
    for (size, target), g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= max(40, 0.01 * target), (size, target, g.taken.sum())
    again = mixing.taken(docs.repartition(2)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))
    left = mixing.repeat_documents(docs.where("doc_id < 60"))
    assert left.columns == docs.columns and left.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_mix_equals_brute_force(docs, spark):
    """Slots, blocks and taken words from the definition: points one by one, documents end to end in hash order."""
    frame = docs.where("doc_id IS NULL OR doc_id != 304").dropDuplicates(["doc_id", "text"])
    block = 64
    d, pieces = mixing.mix(frame, block=block)
    keyed = d.withColumn("h", F.xxhash64("doc_id", "source", "size")).toPandas()
    keyed["source"] = keyed.source.where(keyed.source.notna(), None)
    keyed["id"] = [-1 if pd.isna(x) else int(x) for x in keyed.doc_id]
    sizes = {x: int(keyed["size"][[y == x for y in keyed.source]].sum()) for x in set(keyed.source)}
    goal = brute_targets(sizes)
    order = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    total = sum(goal.values())
    ends = np.cumsum([goal[x] for x in order]) / total
    slots, given = {}, dict.fromkeys(order, 0)
    for k in range(int(total // block)):
        of = order[int(np.searchsorted(ends, (k * mixing.PHI) % 1, side="right"))]
        slots[k] = (of, given[of])
        given[of] += 1
    want_taken, want_blocks = {}, {}
    for of in order:
        at, t, n = 0, round(goal[of]), sizes[of]
        mine = keyed[[y == of for y in keyed.source]].sort_values(["h", "id"])
        for row, size in zip(mine.row, mine["size"]):
            want_taken[row] = sum(max(0, min(at + lap * n + size, t) - min(at + lap * n, t)) for lap in range(2))
            at += size
        for b in range(-(-t // block)):
            want_blocks[of, b] = min(t, (b + 1) * block) - b * block
    got = pieces.toPandas()
    got["source"] = got.source.where(got.source.notna(), None)
    taken = got.groupby("row").words.sum().to_dict()
    assert {r: taken.get(r, 0) for r in want_taken} == want_taken
    per = {}
    for x in got.itertuples():
        per[x.source, x.block] = per.get((x.source, x.block), 0) + x.words
        if x.block < given[x.source]:  # the points gave this block its slot; blocks left over go by hash
            assert slots[x.slot] == (x.source, x.block)
    assert per == {k: v for k, v in want_blocks.items() if v}


def test_mix_repeats_rows_with_null_and_repeated_ids(docs, spark):
    left = mixing.repeat_documents(docs).toPandas()
    data = [r for r in rows() if (r[1] or "").split()]
    known = {(str(i), t) for i, t, *_ in data}
    got = [("None" if pd.isna(i) else str(int(i)), t) for i, t in zip(left.doc_id, left.text)]
    assert set(got) <= known and ("None", rows()[6][1]) in got
    most = {k: 2 * sum((str(i), t) == k for i, t, *_ in data) for k in known}
    assert all(got.count(k) <= most[k] for k in known)
    twins = [(7, "a b c d", "s"), (7, "e f g h", "s"), (None, "i j k l", "s"), (None, "m n o p", "s"), (8, "q " * 400, "t")]
    left = mixing.repeat_documents(spark.createDataFrame(twins, "doc_id long, text string, source string")).toPandas()
    assert sorted(left.text[left.source == "s"]) == sorted(2 * [t for _, t, s in twins if s == "s"])


def test_mix_meets_small_targets(spark):
    data = [(100 * s + i, "w " * n, f"s{s}") for s in range(30) for i, n in enumerate([3000, 5000] if s < 3 else [s, 7, 40])]
    got = mixing.taken(spark.createDataFrame(data, "doc_id long, text string, source string"), block=256).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for s, g in got.groupby(got.doc_id // 100):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5, (s, g.taken.sum(), g.target.iloc[0])
    left = mixing.repeat_documents(spark.createDataFrame(data, "doc_id long, text string, source string"), block=256)
    assert left.select("source").distinct().count() == 30


def test_points_are_spread():
    k = np.arange(1 << 12)
    assert np.abs(np.histogram((k * mixing.PHI) % 1, 16, (0, 1))[0] - 256).max() <= 4


def test_secrets(docs, spark):
    got = secrets.find_secrets(docs).toPandas()
    assert len(got) == len(rows()) and got[["n_assign", "n_access", "n_hex", "n_markov"]].to_numpy().sum() == 0
    r = random.Random(5)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    free = ["".join(r.choice(secrets.ALPHABET[:62]) for _ in range(40)) for _ in range(20)]
    prose = [t for _, t, *_ in rows() if t] * 3
    data = [(i, f"{prose[i]} token = '{h}' end") for i, h in enumerate(hexes)] + [(100 + i, f"é {prose[i]} {s} end") for i, s in enumerate(free)] + [(200, None)]
    out = secrets.find_secrets(spark.createDataFrame(data, "doc_id long, text string")).toPandas().set_index("doc_id")
    text = dict(data)
    for i in range(30):
        x = out.loc[i]
        parts = [p.split(":") for p in x.spans.split(",")]
        assert (x.n_assign, x.n_hex) == (1, 1) and [k for k, *_ in parts] == ["assign", "hex"]
        assert text[i][int(parts[1][1]) : int(parts[1][2])] == hexes[i] and x.base_sha256 == hashlib.sha256(x.spans.encode()).hexdigest()
    found = [i for i in range(20) if out.loc[100 + i].n_markov == 1]
    assert len(found) >= 18
    for i in found:
        _, a, b = out.loc[100 + i].spans.split(":")
        assert text[100 + i][int(a) : int(b)] == free[i]
    assert out.loc[200].base_sha256 == hashlib.sha256(b"").hexdigest()


def brute_secrets(data):
    """The contract's row and the models from scratch: characters labelled one by one."""
    patterns = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("AKIA[A-Z0-9]+", 0, 0, 16), ("[0-9a-f]+", 0, 0, 32)]
    n, per = secrets.K, {}
    counts = np.zeros((2, n, n))
    code = lambda c: secrets.ALPHABET.find(c) if c in secrets.ALPHABET else n - 1
    for i, text in data:
        text = text or ""
        spans = [(m.start(), k, m.end(), *m.span(g)) for k, (p, flag, g, least) in enumerate(patterns) for m in re.finditer(p, text, flag) if m.end(g) - m.start(g) >= least]
        label = [1] * len(text)
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if not any(s < m.end() and m.start() < e for s, _, e, *_ in spans)]
        for a, b in runs:
            label[a:b] = [None] * (b - a)
        for *_, a, b in spans:
            label[a:b] = [0] * (b - a)
        for j in range(len(text) - 1):
            if label[j] == label[j + 1] is not None:
                counts[label[j], code(text[j]), code(text[j + 1])] += 1
        per[i] = sorted(s[:3] for s in spans), runs, text
    ratio = secrets.ratios(counts.ravel())
    out = {}
    for i, (base, runs, text) in per.items():
        more = [(a, 3, b) for a, b in runs if (s := sum(ratio[code(x), code(y)] for x, y in zip(text[a:b], text[a + 1 : b]))) >= 20 and s >= 0.8 * (b - a)]
        line = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, k, b in spans)
        kinds = [k for _, k, _ in base]
        out[i] = (*map(kinds.count, range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + more)), len(more))
    return out


def test_secrets_equal_brute_force(spark):
    r = random.Random(11)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    text = secrets.ALPHABET[:62]
    kinds = [lambda: f"token={some('0123456789abcdef', 40)}", lambda: f"API_KEY: 'AKIA{some('ABCDEFGHIJ0123', 16)}'", lambda: some("0123456789abcdef", r.randrange(28, 40)), lambda: some(text, 32),
             lambda: f"secret := {some(text, 12)}", lambda: "antidisestablishmentarianism_interoperability", lambda: "é" * r.randrange(4), lambda: "passwd=" + some(text, 7), lambda: f"{some('abc', 5)}token=deadbeef"]
    prose = [t for _, t, *_ in rows() if t and len(t) < 5000]
    data = [(i, " ".join([r.choice(prose)[:400], *(r.choice(kinds)() for _ in range(r.randrange(5)))])) for i in range(150)] + [(900, None), (901, ""), (902, "x")]
    want = brute_secrets(data)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    for parts in (1, 7):  # the models don't depend on the partitioning
        got = secrets.find_secrets(frame.repartition(parts)).toPandas()
        assert {x.doc_id: (x.n_assign, x.n_access, x.n_hex, x.base_sha256, x.spans, x.n_markov) for x in got.itertuples()} == want
    assert sum(x[-1] for x in want.values()) > 20


def test_quality(docs, spark):
    got = quality.decisions(docs).toPandas()
    assert len(got) == len(rows())
    assert not got[got.doc_id.isin([300, 301, 302])].kept.any()
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_against_labels(spark):
    """On the half of the labels that nothing was chosen by."""
    d = "/root/testdata/sf0.1"
    got = queries.op4_quality_weak_labels(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = got.quality == 1
    assert (got.kept == good).mean() > 0.99 and got.kept[good].mean() > 0.995 and not got.kept[~good].mean() > 0.04


def brute_posterior(patterns, counts):
    """Expectation-maximisation vote by vote."""
    n = sum(counts)
    bad = [0.9 if "0" in p else 0.05 for p in patterns]
    for _ in range(200):
        before, tables = bad, []
        share = (sum(b * c for b, c in zip(bad, counts)) + 1) / (n + 4)
        for k, mean in ((0, quality.ON_GOOD), (1, quality.ON_BAD)):
            weight = [(b if k else 1 - b) * c for b, c in zip(bad, counts)]
            tables.append([])
            for i in range(len(patterns[0])):
                votes = [sum(w for w, p in zip(weight, patterns) if int(p[i]) == v) + mean[v] * max(3.0, quality.PRIOR * n) for v in range(3)]
                tables[k].append([v / sum(votes) for v in votes])
        bad = []
        for p in patterns:
            odds = share / (1 - share)
            for i, v in enumerate(p):
                odds *= tables[1][i][int(v)] / tables[0][i][int(v)]
            bad.append(odds / (1 + odds))
        if max(abs(a - b) for a, b in zip(bad, before)) < 1e-9:
            break
    return bad


def test_quality_equals_brute_force(docs):
    """Votes, posterior and score of every row from the model's own weights, feature by feature."""
    voted, posterior, scorer = quality.train(docs, "doc_id", "text")
    counts = voted.groupBy("votes").count().toPandas()
    assert dict(zip(counts.votes, counts["count"])) == dict(pd.Series([quality.votes(t) for _, t, *_ in rows()]).value_counts())
    counts = counts.sort_values("votes")
    want = brute_posterior(list(counts.votes), list(counts["count"]))
    assert all(abs(posterior[p] - w) < 1e-6 for p, w in zip(counts.votes, want))
    got = quality.decisions(docs).toPandas()
    by_text = {t: (round(posterior[quality.votes(t)], 6), t) for _, t, *_ in rows()}
    texts = {(-1 if i is None else i): t for i, t, *_ in rows()}
    for x in got[got.doc_id.notna()].itertuples():
        t = texts[int(x.doc_id)]
        assert abs(x.weak_bad - by_text[t][0]) < 1e-6
        if t and t.strip() and len(t) < 5000:
            raw, n = t.encode(), np.zeros(quality.FEATURES)
            for i in range(len(raw) - 2):
                n[(int.from_bytes(raw[i : i + 3], "little") * 2654435761 % 2**32) >> 20] += 1
            n /= max(1, len(raw) - 2)
            w = raw.split()
            n[zlib.crc32(b"<same word>") % quality.FEATURES] += sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w))
            p = posterior[quality.votes(t)] if scorer is None else 1 / (1 + np.exp(-(np.sqrt(n) @ scorer.weight + scorer.bias)))
            assert abs(p - x.bad) < 1e-5 and x.kept == (p < quality.THRESHOLD)


def test_token_operators(docs):
    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(P.path(bpe.VOCABULARY), P.PATTERN).ranks, special_tokens={})
    data = [(i, t or "") for i, t, *_ in rows()]
    text = lambda v: "None" if v is None or pd.isna(v) else str(int(v))
    got = token_counts.count_tokens(docs).toPandas()
    assert sorted((text(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in got.itertuples()) == sorted((text(i), len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in data)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((text(i), len(e := lib.encode_ordinary(t)), sha(" ".join(map(str, e)).encode()), sha(t.encode())) for i, t in data)
    out = bpe.encode_documents(docs).toPandas()
    assert sorted((text(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out.itertuples()) == want
    assert (out.ids.map(len) == out.n_tokens).all()


def test_archives(spark):
    data = [(5, "http://a", "same"), (3, None, "same"), (9, "http://b", "same"), (1, "x", None), (2, "y", ""), (4, "z", "Ü" * 300_000), (None, "n", "same"), (6, "only", "only"), (6, "only", "only")]
    got = warc.archive_and_read(spark.createDataFrame([(*x, "e") for x in data], "page_id long, url string, html string, digest string").repartition(3)).toPandas()
    text = lambda v: None if v is None or pd.isna(v) else int(v)
    out = sorted(((text(x.page_id) or 0), x.payload_bytes, x.record_type, text(x.refers_to)) for x in got.itertuples())
    assert out == [(0, 4, "revisit", 3), (1, 0, "response", None), (2, 0, "revisit", 1), (3, 4, "response", None), (4, 600_000, "response", None), (5, 4, "revisit", 3), (6, 4, "response", None), (6, 4, "response", None), (9, 4, "revisit", 3)]
    assert set(got.payload_digest[got.payload_bytes == 0]) == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_empty_tables(empty):
    for f in (exact_dedup.mark_copies, exact_dedup.drop_copies, simhash.group, simhash.keep_one, sharding.shard, mixing.taken, mixing.repeat_documents, secrets.find_secrets, quality.decisions,
              quality.keep_good, token_counts.count_tokens, bpe.encode_documents):
        assert f(empty).count() == 0, f


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, "/root/testdata/sf0.001").toPandas()
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id")
    assert len(out) and set(out.doc_id) <= set(d.index) and p.ORACLE_SQL is None
    assert all(x.decoded_sha256 == hashlib.sha256(d.text[x.doc_id].encode()).hexdigest() for x in out.itertuples())
