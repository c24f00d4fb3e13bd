"""Odd rows, clashing columns, and brute-force versions of whole operators and of the pipeline."""

import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, decontamination, embeddings, jaccard, language, mixing, quality, sharding, substrings
from strandloom.llm.common import WORD, Scratch, fresh

CLASHES = ["score", "predicted", "_id", "_tie", "_s", "_score", "_copy", "_own", "_one", "_text", "_digest", "size", "target", "copies", "node", "n", "key", "Batch"]
WIDE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def wide(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", 1, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(zip(ids, texts))], WIDE)


def words(t):
    return re.findall(WORD, t or "")


def test_fresh_names():
    assert fresh(["a", "B", "c_"], "a", "b", "c", "c") == ["a_", "b_", "c", "c__"]


LONG = " ".join(f"v{k % 997}x{k % 31}" for k in range(120_000))


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    """Null ids and texts, empty, repeated and very long texts, and columns named as anything inside."""
    texts = ["one two three four five six seven", None, "", "one two three four five six seven", "x " * 3000, LONG, "other words stand here today", "same", "same", "of null id"]
    df = wide(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, None])
    bench = spark.createDataFrame([(1, "other words stand here today"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    stages = {
        "quality": lambda d: quality.accepted(d, labels, 0.0),
        "near": lambda d: jaccard.deduplicated(d),
        "leaks": lambda d: decontamination.decontaminated(d, bench),
        "mix": lambda d: mixing.mixed(d),
    }
    left = {}
    for name, stage in stages.items():
        out = stage(df)
        assert out.columns == df.columns
        got = out.collect()
        left[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
        assert {tuple(r) for r in got} <= {tuple(r) for r in df.collect()}
        assert stage(df.limit(0)).collect() == []
    ids = {k: [i for none, i in v if not none] for k, v in left.items()}
    assert ids["quality"] == [0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert ids["near"] == [0, 1, 2, 4, 5, 6, 7] and (True, 0) in left["near"]
    assert ids["leaks"] == [0, 1, 2, 3, 4, 5, 7, 7]
    size = [len(words(t)) for t in texts]
    mix = mixing.systematic_mix(df)
    assert [c for c in mix.columns if c not in df.columns] == ["source_size"] and mix.count() == len(texts)
    assert sum(r.size for r in mix.collect()) == sum(size)


def test_operators_take_empty_tables_and_odd_rows(spark):
    df = wide(spark, [None, "", " \t\n", "a", "a", LONG, LONG, "a b c"], [0, 1, 2, 3, 3, 5, 6, None])
    bench = df.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 0")
    for made in (substrings.remove_repeats, jaccard.join, sharding.shard, lambda d: decontamination.overlaps(d, bench)):
        assert made(df.limit(0)).collect() == []
    got = substrings.remove_repeats(df).collect()
    assert len(got) == 8 and sorted(r.n_removed for r in got) == [0] * 7 + [120_000]
    got = jaccard.join(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got if r.doc_id is not None) == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 3), (5, 5), (6, 5)]
    rows = sharding.shard(df, n=4).collect()
    assert len(rows) == 8 and sum(r.size for r in rows) == sum(len((t or "").encode()) + 1 for t in df.toPandas().text)
    crc = {r.doc_id: r.text_crc32 for r in rows}
    assert crc[5] == zlib.crc32(LONG.encode()) and crc[0] == 0


def overlaps(text, item):
    """Most equal words of any stretch of any diagonal of which 80% are equal, by trying all."""
    a, b = [w.lower() for w in words(text)], [w.lower() for w in words(item)]
    best = 0
    for d in range(-len(b) + 1, len(a)):
        same = [0 <= d + k < len(a) and a[d + k] == b[k] for k in range(len(b))]
        for i, j in itertools.combinations(range(len(b) + 1), 2):
            if 0 <= d + i and d + j <= len(a) and 5 * sum(same[i:j]) >= 4 * (j - i):
                best = max(best, sum(same[i:j]))
    return best


def leaky(text, items):
    return any(n and overlaps(text, i) >= min(12, math.ceil(0.8 * n)) for i in items for n in [len(words(i))])


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 25, n)]
    items = [" ".join(say(n)) for n in (3, 5, 9, 14, 18, 22)]
    texts = []
    for k in range(50):
        item = items[k % 6].split()
        for j in rng.integers(0, len(item), k % 5):
            item[j] = "z"
        cut = int(rng.integers(0, 4))
        texts.append(" ".join(say(6) + item[cut:] + say(5)))
    texts += ["x " * 40, None, "W1 w2"]
    items += ["x " * 30, None, ""]
    docs = wide(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.equal_words for r in decontamination.overlaps(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            n = len(words(x))
            if n and t and (e := overlaps(t, x)) >= min(12, math.ceil(0.8 * n)):
                want[d, i] = e
    assert got == want and len(want) > 15


def test_repetitive_texts_take_little_room():
    seeds = decontamination.Seeds([0], ["x " * 2000])
    assert seeds.overlaps(pa.array(["x " * 10_000])) == [(0, 0, 2000, 2000, 0)]


def test_benchmarks_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    items = [" ".join(f"b{k}_{j}" for j in range(15)) for k in range(20)]
    docs = wide(spark, ["clean text", *items[:10], None, "", "clean text"])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench).collect()} == {(k + 1, k) for k in range(10)}
    out = decontamination.decontaminated(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 11, 12, 13]


def least_cost(roles):
    """Least cost of any repair, by trying every role, merge and insertion at each turn."""
    known = [chat.SYNONYMS.get((r or "").strip().lower()) for r in roles]
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    best = math.inf

    def go(k, last, cost):
        nonlocal best
        if k == len(known):
            best = min(best, cost)
            return
        for role in chat.ROLES:
            price = cost + (chat.NAME_UNKNOWN if known[k] is None else 0 if known[k] == role else chat.RELABEL)
            if role == last:
                go(k + 1, role, price + chat.MERGE)
            if role in legal[last]:
                go(k + 1, role, price)
            for between in legal[last]:
                if role in legal[between]:
                    go(k + 1, role, price + chat.INSERT)

    go(0, None, 0.0)
    return best


def test_repairs_cost_least(spark):
    kinds = ["user", "assistant", "system", "tool"]
    cases = [list(c) for n in range(1, 5) for c in itertools.product(kinds, repeat=n)]
    rows = [(c, t, r, f"{t}") for c, roles in enumerate(cases) for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost, each = {}, defaultdict(float)
    for r in chat.repair(df, 2).collect():
        cost[r.conv_id] = r.conv_cost
        each[r.conv_id] += r.cost
    for c, roles in enumerate(cases):
        assert cost[c] == pytest.approx(least_cost(roles)) and each[c] == pytest.approx(cost[c])


def test_repair_of_odd_and_long_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "bot", "b"), (1, None, "user", "late"), (1, 0, "system", "s"), (2, 0, "user", "twice"), (2, 0, "user", "twice"), (2, None, None, None)]
    rows += [(3, k, ("user", "assistant")[k % 2], "t") for k in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit("clash")).withColumn("part", F.lit(1))
    got = chat.repair(df).collect()
    assert Counter(r.conv_id for r in got) == {None: 2, 1: 2, 2: 3, 3: 5000}
    assert all(r.action == "keep" for r in got if r.conv_id in (None, 1, 3))
    assert sorted(r.action for r in got if r.conv_id == 2)[-1].startswith("relabel") and sum(r.action == "merge" for r in got) == 1


def test_languages_equal_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    pages, docs = spark.read.parquet(f"{d}/pages.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    odd = [(-1, "http://a.example.org/x", "<html lang='fr'><p>le la les et une</p>"), (-2, None, None), (-3, "http://B.example.org", "")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("s0", F.lit("clash"))
    langs, logs = language.fit(docs)
    rows = []
    for r in pages.collect():
        html, url = r.html or "", r.url or ""
        plain = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]{1,10};", " ", html).lower().encode()
        runs = [((plain[k] | plain[k + 1] << 8 | plain[k + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> (32 - language.BITS) for k in range(len(plain) - 2)]
        v = np.array([sum(float(logs[i][x]) for x in runs) for i in range(len(langs))]) * min(1.0, language.EFFECTIVE / max(len(runs), 1))
        v -= v.max()
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", url) or [None, ""])[1].lower()
        said = (re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html) or [None, ""])[1].lower()
        parts = host.split(".")
        rows.append((r.page_id, v, np.exp(v) / np.exp(v).sum(), said, parts[-1], ".".join(parts[-2:]), host))
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    for me in rows:
        _, v, p, said, suffix, domain, host = me
        out = lambda of, k: np.maximum(sum(r[2] for r in rows if k is None or r[k] == of) - p, 0)
        whole = out(None, None)
        mean = lambda s, prior, n: (s + n * prior) / (s.sum() + n)
        prior = mean(whole, np.full(len(langs), 1 / len(langs)), language.WHOLE_PRIOR)
        prior = mean(out(host, 6), mean(out(domain, 5), prior, language.DOMAIN_PRIOR), language.HOST_PRIOR)
        odds = lambda s: np.log((s + language.TABLE_PRIOR / len(langs)) / (whole + language.TABLE_PRIOR))
        total = v + np.log(prior) + (odds(out(said, 3)) + np.array([x == said for x in langs]) if said else 0) + (odds(out(suffix, 4)) if suffix else 0)
        share = np.exp(total - total.max())
        assert got[me[0]].lang == langs[int(total.argmax())]
        assert got[me[0]].confidence == pytest.approx(share.max() / share.sum(), rel=1e-3)


def test_dual_solution_is_optimal():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    good = np.array([(r < 25).sum() > 4 for r in rows])
    ratio = quality.log_count_ratio(rows, good)
    count = lambda x, c: 1 + sum(x in r for r, g in zip(rows, good) if g == c)
    size = [sum(len(r) for r, g in zip(rows, good) if g == c) + (1 << quality.BITS) for c in (False, True)]
    for x in range(60):
        assert ratio[x] == pytest.approx(math.log(count(x, True) / size[1]) - math.log(count(x, False) / size[0]))
    values = [ratio[r] / np.linalg.norm(ratio[r]) for r in rows]
    y, cost = np.where(good, 1.0, -1.0), np.full(80, 2.0)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost, epochs=400)
    margin = np.array([w[r] @ v + b for r, v in zip(rows, values)]) * y
    primal = (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - margin)).sum()
    # at the optimum the primal and the dual value are equal; the dual value is sum(alpha) - |w|^2 / 2, and w is made of alpha
    spot = lambda u, c: (u @ u + c * c) / 2 + sum(2.0 * max(0, 1 - s * (u[r] @ v + c)) for r, v, s in zip(rows, values, y))
    for _ in range(300):
        step, change = np.zeros_like(w), rng.normal() * 0.05
        step[:60] = rng.normal(size=60) * 0.05
        assert spot(w + step, b + change) >= primal - 1e-6


def plain_features(text):
    """Hashed words and runs of three bytes, one by one."""
    mask, base = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def spread(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    data = (text or "").encode()
    word = lambda w: spread((sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(w)) + len(w)) & mask) >> (64 - quality.BITS)
    three = lambda k: ((data[k] | data[k + 1] << 8 | data[k + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> (32 - quality.BITS)
    return sorted({word(w.encode()) for w in words(text)} | {three(k) for k in range(len(data) - 2)})


def test_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", "  ", "a", "one two  one", "é漢字 ### $$$", *(" ".join(f"w{x}" for x in rng.integers(0, 90, n)) for n in (3, 40, 400))]
    model = quality.Model(rng.normal(size=1 << quality.BITS), rng.normal(size=1 << quality.BITS), 0.3, 1.7, -0.4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    for k, text in enumerate(texts):
        at = plain_features(text)
        norm = math.sqrt(sum(float(model.ratio[f]) ** 2 for f in at)) or 1.0
        margin = sum(float(model.product[f]) for f in at) / norm + model.offset
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))))


def test_shards_cut_few_links_of_all_pairs(spark):
    """Links counted pair by pair: of groups of two to nine copies, and one that no shard can hold, hardly any is cut that need not be."""
    rng = np.random.default_rng(4)
    texts = [f"group {g} " * int(rng.integers(1, 20)) for g in range(150) for _ in range(int(rng.integers(2, 10)))]
    texts = [t if k % 3 else f"alone {k} " * 9 for k, t in enumerate(texts)]
    whole = sum(len(t) + 1 for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    home = {r.doc_id: r.shard for r in sharding.shard(docs, n=4).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] == texts[b]]
    load = [sum(len(t) + 1 for k, t in enumerate(texts) if home[k] == j) for j in range(4)]
    assert max(load) < 1.1 * whole / 4 and min(load) > 0.9 * whole / 4
    by_hash = np.mean([rng.integers(0, 4) != rng.integers(0, 4) for _ in pairs])
    cut = np.mean([home[a] != home[b] for a, b in pairs])
    assert cut < 0.1 < 0.6 < by_hash


def test_quality_rejects_bad_rows(spark):
    d = "/root/testdata/sf0.1"
    out = quality.op9_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == 1 for r in out if r.quality == 1]) > 0.97
    assert np.mean([r.predicted == 0 for r in out if r.quality == 0]) > 0.8


def test_labels_that_disagree_and_repeat(spark):
    docs = wide(spark, ["good words here"] * 30 + ["bad junk zzz"] * 30)
    labels = spark.createDataFrame([(k, int(k < 30), 0) for k in range(60)] * 2 + [(0, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert min(r.score for r in got[:30]) > max(r.score for r in got[30:]) and got[0].predicted == "predicted0"


def test_shards_of_odd_rows(spark):
    df = wide(spark, ["a"] * 5 + [None, None, ""] + [f"t{k}" for k in range(40)], [None, None, 1, 1, 1, 2, 2, 3, *range(40)])
    rows = sharding.shard(df, n=4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 48 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_mix_comes_near_its_targets(spark):
    d = "/root/testdata/sf0.01"
    largest, total, goal = Counter(), Counter(), {}
    for r in mixing.op10_source_mixing(spark, d).collect():
        largest[r.source] = max(largest[r.source], r.size)
        total[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size
    for s, t in goal.items():
        assert abs(total[s] - t) <= largest[s]


def test_vectors_with_one_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, a), (5, b), (1, [0.0, 1.0, 0.01, 0.0]), (9, [1.0, 0.01, 0.0, 0.0]), (7, b)]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (5, 1, 5), (5, 2, 1), (7, 2, 1), (9, 1, 5)]


def test_recall_on_fifty_thousand_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(42_000, 64)).astype(np.float32)
    pick = rng.integers(0, len(base), 8_000)
    angle = rng.uniform(0.05, 0.45, len(pick))[:, None]  # cosine 0.9 is 0.451
    unit = base[pick] / np.linalg.norm(base[pick], axis=1, keepdims=True)
    aside = rng.normal(size=unit.shape)
    aside -= (aside * unit).sum(1, keepdims=True) * unit
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x = np.concatenate([base, np.cos(angle) * unit + np.sin(angle) * aside]).astype(np.float64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 64), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": lists}), f"{tmp_path}/v.parquet")
    got = embeddings.link(spark.read.parquet(f"{tmp_path}/v.parquet").repartition(8)).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [np.nonzero(unit[k : k + 2000] @ unit.T >= 0.9) for k in range(0, len(x), 2000)]
    ends = np.concatenate([np.stack([a + 2000 * k, b]) for k, (a, b) in enumerate(near)], 1)
    links = np.bincount(ends[0], minlength=len(x)) - 1
    least = np.arange(len(x))
    while True:  # the smallest id reachable, by all links
        then = least.copy()
        np.minimum.at(then, ends[0], least[ends[1]])
        if (then == least).all():
            break
        least = then
    assert (got.component_id.to_numpy() >= least).all()  # nothing is joined that isn't reachable
    assert (got.component_id.to_numpy() == least).mean() > 0.98
    found = got.n_links.to_numpy()
    assert (found <= links).all()
    recall = found.sum() / links.sum()
    print("recall", recall)
    assert recall >= 0.9


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    d = f"{tmp_path}/data"
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(70).collect()
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(6).collect()]
    texts = [" ".join(words(r.text)[:90]) for r in real]
    for k in range(0, 30, 3):  # near copies
        w = texts[k].split()
        for j in rng.integers(0, len(w), 1 + k % 4) if w else ():
            w[j] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [texts[2], None, "", "a b", "lead " + bench[0] + " tail", bench[1].upper()]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(70)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    # quality: the fitted model on each text by itself
    model = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), labels)
    now = [r for r in rows if model.score(pa.array([r[1]], pa.string()))[0] >= quality.THRESHOLD]
    assert 0 < len(now) < len(rows)

    def grams(t):
        w = [x.lower() for x in words(t)]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = [grams(r[1]) for r in now], list(range(len(now)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(now)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    now = [r for k, r in enumerate(now) if root[k] == k]
    now = [r for r in now if not leaky(r[1], bench)]
    con = duckdb.connect()
    frame = pd.DataFrame(now, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con.register("documents", frame)
    taken = con.execute(mixing.OP10_SQL).df()
    want = Counter({int(r.doc_id): int(r.copies) for r in taken.itertuples() if r.copies > 0})
    got = corpus_pipeline.run(spark, d).collect()
    assert Counter(r.doc_id for r in got) == want
    by = defaultdict(list)
    for r in got:
        t = rows[r.doc_id][1] or ""
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes")
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_scratch_needs_a_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        Scratch(Session())


def test_deduplicated_with_repeated_ids(spark):
    """A near copy goes whatever else has its doc_id; another text of that doc_id stays."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (5, base + " more"), (5, "another text that has nothing in common with it"), (5, None), (5, ""), (5, ""), (7, "solo words here now again"), (7, "solo words here now again")]
    rows += [(9, "x1 x2 x3 x4 x5 x6 x7"), (9, "y1 y2 y3 y4 y5 y6 y7"), (10, "y1 y2 y3 y4 y5 y6 y7"), (3, "one two three four five six"), (3, "one two three four five six ")]
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, _node string, Own string")
    got = sorted((r.doc_id, r.text or repr(r.text)) for r in jaccard.deduplicated(docs).collect())
    texts = {(i, (t or "").strip()) for i, t in got}
    assert len(got) == 8 and (5, "None") in got and (5, "''") in got
    assert {(1, base), (5, rows[2][1]), (7, rows[6][1]), (9, rows[8][1]), (9, rows[9][1]), (3, "one two three four five six")} <= texts
    assert not any(t.endswith("more") for _, t in got) and all(i != 10 for i, _ in got)


@pytest.mark.parametrize("unit", ["<", "<a ", "<a b='", "<script>", "<style ", "<html ", "<html lang ", "</", "&", "<!--", "</script ", "lang="])
def test_language_of_hostile_pages_takes_time_in_proportion(spark, unit):
    docs = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 4)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.de/x", unit * ((1 << 20) // len(unit)))], "page_id long, url string, html string")
    began = time.time()
    assert language.identify(pages, docs).count() == 1
    assert time.time() - began < 25
