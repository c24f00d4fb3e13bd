import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, decontamination, embeddings, jaccard, language, mixing, quality, sharding, substrings
from strandloom.llm.components import components
from strandloom.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long"
WORD = r"[^\x20\x09-\x0D]+"


def docs_of(spark, texts, extra=()):
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), 99) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOC)


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    say = lambda k: [f"w{x}" for x in rng.integers(0, 400, k)]
    base, passage = say(200), say(40)
    texts = [None, "", "  \t", "one", "one two", "one two", "x " * 5000]
    for k in range(n):
        words = say(int(rng.integers(3, 200)))
        if k % 4 == 0:
            words = list(base)
            for j in rng.integers(0, len(words), int(rng.integers(0, 14))):
                words[j] = f"edit{k}_{j}"
        if k % 5 == 0:
            words[10:10] = passage
        texts.append(" ".join(words) if k % 3 else "\n".join(words))
    return [*texts, texts[8], texts[9], texts[9]]


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize(("gram", "percent", "leaf"), [(4, 85, 512), (5, 80, 2), (2, 50, 2)])
def test_jaccard_equals_brute_force(spark, gram, percent, leaf):
    rng = np.random.default_rng(17)
    families = [[f"f{f}_{x}" for x in range(40)] + [f"c{x}" for x in range(30)] for f in range(4)]  # near each other, and farther
    texts = corpus(n=80)
    for k in range(40):
        w = list(families[k % 4])
        for j in rng.integers(0, 70, k // 4):
            w[j] = f"e{k}_{j}"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in jaccard.join(docs_of(spark, texts, [(None, "one two", None, None, None, None)]), gram, percent, leaf).collect()}

    def shingles(t):
        w = [x.lower() for x in re.findall(WORD, t or "")]
        return {tuple(w[k : k + gram]) for k in range(len(w) - gram + 1)} if len(w) >= gram else ({tuple(w)} if w else set())

    sets, groups = [shingles(t) for t in texts], Groups()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    for k, s in enumerate(sets):
        assert (got[k].n_shingles, got[k].component_id) == (len(s), groups.find(k))
    assert got[None].component_id is None


def test_substrings_equal_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(spark, texts)).collect()}
    first = {}
    for k, t in enumerate(texts):
        w = re.findall(WORD, t or "")
        gone = set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), k) < k:
                gone |= set(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substrings_of_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 5)
    rng = np.random.default_rng(6)
    say = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 4000, k))
    line, shared = say(8), [say(9) for _ in range(4)]
    texts = [" ".join([say(5), shared[k % 4] if k % 3 else say(9), line, shared[(k + 1) % 4] if k % 2 else say(9)]) for k in range(40)] + ["x " * 500, "x " * 300 + line]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(spark, texts)).collect()}
    first, lost = {}, 0
    for k, t in enumerate(texts):
        w = t.split()
        gone = set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), k) < k:
                gone |= set(range(j, j + 13))
        lost += len(gone)
        assert got[k].kept_text == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert lost > 300


def test_substrings_of_texts_with_one_id(spark):
    shared = " ".join(f"s{k}" for k in range(15))
    rows = [(0, shared), (5, "a b c " + shared + " d"), (5, " ".join(f"t{k}" for k in range(14)))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(0, 15, 0), (5, 14, 0), (5, 19, 15)]


def test_automaton_of_more_words_than_characters(monkeypatch):
    rng = np.random.default_rng(8)
    phrases = [" ".join(f"w{x}" for x in rng.integers(0, 12, 30)) for _ in range(40)]
    group = pa.table({"anchor": [0] * 40, "print": list(range(40)), "phrase": phrases, "least": list(range(40)), "most": list(range(40))})
    one = substrings._automaton(3)(group).to_pylist()
    monkeypatch.setattr(substrings, "SYMBOLS", 5)
    assert one and substrings._automaton(3)(group).to_pylist() == one
    monkeypatch.undo()
    many = " ".join(f"w{x}" for x in range(1_112_070))
    group = pa.table({"anchor": [0] * 2, "print": [0, 1], "phrase": [many, "a b " + many[-40:]], "least": [0, 1], "most": [0, 1]})
    assert [r["print"] for r in substrings._automaton(3)(group).to_pylist()] == [0, 1]


def test_occurrences_are_located_by_the_machine_alone(monkeypatch):
    """Windows are confirmed from two passages only; the others' occurrences can come from nothing but the automaton."""
    inner = substrings._confirmed

    def of_two(ids, passage, window, low, high):
        some = passage < 2
        return inner(ids[some], passage[some], window, low, high)

    monkeypatch.setattr(substrings, "_confirmed", of_two)
    phrases = ["x a b c y", "z z a b c", "a b c", "q a b c a b c", "a b q c a b", "b c a", "aa bb cc a b cc a b c"]
    n = len(phrases)
    group = pa.table({"anchor": [7] * n, "print": list(range(n)), "phrase": phrases, "least": list(range(3, n + 3)), "most": list(range(3, n + 3))})
    found = {r["print"]: [k for k, o in enumerate(r["owners"]) if o == 3] for r in substrings._automaton(3)(group).to_pylist()}
    assert found == {0: [1], 1: [2], 2: [0], 3: [1, 4], 6: [6]}


def test_leaks(spark):
    rng = np.random.default_rng(1)
    items = [" ".join(f"b{x}" for x in rng.integers(0, 900, n)) for n in (14, 30, 60)]
    swapped = items[2].split()
    for k in range(5, 60, 9):
        swapped[k] = "other"
    texts = ["clean words " * 30, "lead " + items[0] + " tail", "a b " + " ".join(swapped), items[1].upper(), None, "", " ".join(items[1].split()[:6])]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    docs = docs_of(spark, texts)
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench).collect()} == {(1, 0), (2, 2), (3, 1)}
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 4, 5, 6}
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


def most_equal(same):
    """The most equal words of any stretch of which 80% are equal."""
    return max([sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)], default=0)


def test_leaks_take_any_stretch_of_a_diagonal():
    rng = np.random.default_rng(11)
    patterns = [[1] * 12 + [0, 1, 1, 1] * 20, [1, 0] + [1] * 11 + [0] * 17, [1] * 11 + [0, 1] + [0] * 17]
    patterns += [(rng.random(int(n)) >= share).astype(int).tolist() for share in (0.1, 0.15, 0.2, 0.25) for n in rng.integers(15, 60, 60)]
    for same in patterns:
        item = [f"b{k}" for k in range(len(same))]
        doc = " ".join(["lead"] + [w if s else f"other{k}" for k, (w, s) in enumerate(zip(item, same))])
        begin, end, equal = decontamination._stretch(np.array(same, bool))
        assert equal == most_equal(same) == sum(same[begin:end]) and 5 * equal >= 4 * (end - begin) and same[begin] and same[end - 1]
        got = decontamination.Seeds([0], [" ".join(item)]).overlaps(pa.array([doc]))
        seeded = any(all(s or x == "0" for s, x in zip(same[k:], m)) for m in decontamination.MASKS for k in range(len(same) - len(m) + 1))
        assert got == ([(0, 0, equal, end - begin, begin + 1)] if seeded and equal >= 12 else [])


@pytest.mark.parametrize("n", [*range(1, 13), 15, 16, 20])
def test_leaks_of_short_items(n):
    item = [f"b{k}" for k in range(n)]
    wrong = 4 if n > 12 else n
    patterns = [[k not in off for k in range(n)] for m in range(wrong + 1) for off in itertools.combinations(range(n), m)]
    docs = [" ".join(["lead"] + [w if s else f"other{k}" for k, (w, s) in enumerate(zip(item, same))] + ["tail"]) for same in patterns]
    got = {r: e for r, _, e, _, _ in decontamination.Seeds([0], [" ".join(item)]).overlaps(pa.array(docs))}
    need = min(12, -(-4 * n // 5))
    most = {k: most_equal(same) for k, same in enumerate(patterns)}
    assert got == {k: e for k, e in most.items() if e >= need} and 0 in got


def test_leaks_of_several_short_items():
    items = ["the", "of the", "The", "one two three four", "", None]
    got = decontamination.Seeds(list(range(6)), items).overlaps(pa.array(["of the end of THE", "two three four", None, "one two three four five"]))
    assert got == [(0, 0, 1, 1, 1), (0, 1, 2, 2, 0), (0, 2, 1, 1, 1), (3, 3, 4, 4, 0)]


def test_mix(spark):
    texts = ["w " * (k % 50) for k in range(600)] + [None, ""]
    docs = docs_of(spark, texts).withColumn("target", F.lit("clash"))
    rows = mixing.systematic_mix(docs.drop("target")).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.copies <= 3
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert abs(sum(r.size * r.copies for r in v) - v[0].target) <= 60
    assert mixing.mixed(docs).count() > 0 and mixing.systematic_mix(docs.limit(0)).count() == 0


def test_shards(spark):
    texts = [f"t{k} " * (k % 40 + 1) for k in range(900)] + ["copy " * 8] * 30 + ["pair"] * 2 + [None, ""]
    rows = sharding.shard(docs_of(spark, texts), n=8).collect()
    assert len(rows) == len(texts)
    load, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.1 * sum(load.values()) / 8 and min(load.values()) > 0.9 * sum(load.values()) / 8
    assert len(homes["pair"]) == 1 and len(homes["copy " * 8]) == 1
    assert sharding.shard(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op9_quality_classifier(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = out.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([g >= 0.3 for g in good]) > 0.95
    odd = docs_of(spark, [None, "", "a"])
    assert [r.score for r in quality.score(odd, None).collect()] == [0.5] * 3
    assert quality.accepted(odd, labels.limit(0)).columns == odd.columns


def test_language(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "not a url", ""), (-2, "not a url", "")], "page_id long, url string, html string")
    got = language.identify(pages.unionByName(odd), spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert len(got) == pages.count() + 3 and all(0 <= r.confidence <= 1.000001 for r in got)
    truth = [r for r in got if r.page_id >= 0]
    assert np.mean([r.lang == re.search(r"/(en|de|fr|es)/", r.url)[1] for r in truth]) > 0.95
    assert language.identify(pages, spark.createDataFrame([], DOC)).where("lang is not null").count() == 0


def test_chat_is_least_cost_and_independent_of_spans(spark):
    rng = np.random.default_rng(2)
    roles = ["user", "assistant", "system", "human", None, "tool"]
    rows = [(c, t, roles[rng.integers(6)], f"m{c}.{t}") for c in range(30) for t in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame([*rows, (99, 0, "user", None), (99, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    whole, cut = ({(r.conv_id, r.turn): r for r in chat.repair(df, span).collect()} for span in (512, 2))
    text = defaultdict(str)
    for key in sorted(whole):
        assert whole[key].conv_cost == pytest.approx(cut[key].conv_cost)
        text[key[0]] += cut[key].rendered
    for c, t in text.items():
        names = re.findall(r"<\|im_start\|>(\w+)\n", t)
        assert re.fullmatch("s?(ua)*u?", "".join(n[0] for n in names)) and t.count("<|im_end|>") == len(names)
    assert text[99] == "<|im_start|>user\n\nb<|im_end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 24))
    near = base[:80] + rng.normal(size=(80, 24)) * 0.25
    x = np.concatenate([base, near, base[:5], base[:1]])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, [], 1), (905, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.link(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert got[0].component_id == got[385].component_id == 0 and got[0].kept and not got[385].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(900, 906)) and got[None].component_id is None
    assert embeddings.link(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 400), (400, 450), (7, 7), (900, 900)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert all(got[k] == 0 for k in range(101)) and got[500] == got[450] == 400 and got[900] == 900


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, d)
    assert kept.columns == docs.columns
    comps = jaccard.join(docs, 5, 80).select("component_id").distinct().count()
    assert kept.count() == comps
    rows = corpus_pipeline.run(spark, d).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
