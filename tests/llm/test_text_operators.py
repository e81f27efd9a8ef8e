"""Language ID, quality rules, SimHash, decontamination and scoring against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from bizlens.llm import bytetext as bt
from bizlens.llm import decontam, langid, ppm, quality, simhash

SF = "/root/testdata/sf0.001"
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- language ID

def test_language_id(spark, odd, none):
    model = langid.fit(odd.where("doc_id is not null").where(~langid.held_out(odd["doc_id"])))
    got = langid.identify(odd, model, name="lang_id_").select("doc_id", "text", "lang", "lang_id_.*").collect()
    assert len(got) == odd.count()
    known = [r for r in got if r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.97
    for r in got:
        assert 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model["langs"]
    assert langid.identify(none, langid.fit(none), name="y").count() == 0
    unlearned = langid.identify(odd, langid.fit(none), name="y").select("y.lang_pred").distinct().collect()
    assert [r.lang_pred for r in unlearned] == ["und"]


def test_language_stage_keeps_columns_and_rejects(spark, odd, none):
    kept = langid.stage(spark, odd, SF)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {9001, 9002, 9003, 9004}
    assert langid.stage(spark, none, SF).count() == 0


# --- quality rules

def plain_quality(text):
    text = text or ""
    w = BLANK_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK_WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for k, x in enumerate(zip(w, w[1:], w[2:])):
        if windows[x] > 1:
            hit |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_quality_figures_and_verdicts(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge(odd, labels, name="q").select("doc_id", "text", "q.*").collect()
    want = {(r.doc_id, r.text): plain_quality(r.text) for r in odd.select("doc_id", "text").collect()}
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) \
            == want[r.doc_id, r.text]
        assert not (r.base_failed and r.kept)
    mark = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    good = [r for r in got if mark.get(r.doc_id) == (1, 0) and not r.base_failed]
    bad = [r for r in got if mark.get(r.doc_id, (1, 0))[0] == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert quality.judge(none, labels, name="q").count() == 0
    alone = quality.judge(odd, labels.limit(0), name="q").where("q.kept = q.base_failed")
    assert alone.count() == 0  # without trusted documents the base rule decides


def test_toxic_documents_are_rejected_and_clean_ones_kept(spark):
    """Labels of half of the documents; the verdicts on the others count."""
    rng = np.random.default_rng(5)
    common = [f"{a}{b}" for a in "bdfgk" for b in ("a", "ei", "ust")]
    rows, marks = [], []
    for k in range(600):
        words = list(rng.choice(common, 120))
        if k % 5 == 0:
            for j in rng.choice(120, 3, replace=False):
                words[j] = ("zotz", "quark", "vrill", "wumpf")[rng.integers(4)]
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(k % 5 == 0)))
    for k in range(600, 640):
        rows.append((k, " ".join(f"#{x}" for x in rng.integers(0, 15, 120))))
        marks.append((k, 0, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels, name="q").select("doc_id", "q.kept").collect()}
    for half in (0, 1):
        toxic = [got[k] for k, good, x in marks if good and x and k % 2 == half]
        clean = [got[k] for k, good, x in marks if good and not x and k % 2 == half]
        assert sum(toxic) <= 0.05 * len(toxic) and sum(clean) >= 0.95 * len(clean)


# --- SimHash

def plain_print(text):
    w = BLANK_WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, distance):
    up = list(range(len(prints)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    values = np.array([p for _, p in prints], np.uint64)
    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= distance):
            up[root(k + 1 + int(j))] = root(k)
    groups = {}
    for k, (i, _) in enumerate(prints):
        groups.setdefault(root(k), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [low[root(k)] for k in range(len(prints))]


def test_simhash_equals_brute_force(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    want = by_row((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints, 2)))
    assert by_row(simhash.near_duplicates(odd).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.stage(spark, odd, SF)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    groups = {c for *_, c in want}
    assert len(ids) == len(groups) and set(ids) == groups


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_small_trees_find_the_same_components(spark, distance):
    """Shards larger than a tree are split; no link may be lost."""
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**62, 12, dtype=np.uint64)
    values = {int(base[k % 12]) ^ sum(1 << int(b) for b in rng.choice(64, k % 5, replace=False)) for k in range(300)}
    prints = [(k, v) for k, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in prints], "id long, fp long")
    got = simhash.component_ids(df, distance=distance, tree_nodes=8).join(df, "fp")
    assert {r.id: r.component_id for r in got.collect()} == dict(enumerate(plain_components(prints, distance)))


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**16, 400, dtype=np.uint64)
    probe, node = simhash.BKTree(values).within(values[:40], 3)
    want = [(p, k) for p in range(40) for k in range(400) if (int(values[p]) ^ int(values[k])).bit_count() <= 3]
    assert sorted(zip(probe.tolist(), node.tolist())) == want
    none, _ = simhash.BKTree(values[:0]).within(values[:40], 3)
    assert not len(none)


def test_bk_tree_of_thousands_of_nodes_follows_few_edges():
    values = np.random.default_rng(4).integers(0, 2**63, simhash.TREE_NODES, dtype=np.uint64)
    tree = simhash.BKTree(values)
    probe, node = tree.within(values ^ np.uint64(5), 2)
    assert set(zip(probe.tolist(), node.tolist())) >= {(k, k) for k in range(len(values))}
    assert tree.visited < 0.05 * len(values) ** 2


def test_shards_hold_trees_of_real_size_and_hot_parts_are_cut_further(spark):
    """20,000 far prints make shards of thousands; 20,000 with 44 equal bits, which share
    a part, are cut by their other bits; each near pair meets in a shard."""
    rng = np.random.default_rng(5)
    far = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    hot = np.unique(rng.integers(0, 2**20, 30_000, dtype=np.uint64)) << np.uint64(30)
    values = np.unique(np.concatenate([far, far[:500] ^ np.uint64(3 << 40), hot]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    rows = simhash.shards(df, distance=2)[0].toPandas()
    size = rows.groupby(["mask", "shard"]).size()
    assert size.median() > 1000 and size.max() < 4 * simhash.TREE_NODES
    where = {}
    for m, s, f in rows.itertuples(index=False):
        where.setdefault(f, set()).add((m, s))
    tree = simhash.BKTree(values)
    probe, node = tree.within(values[::20], 2)
    signed = values.view(np.int64).tolist()
    assert len(probe) > len(values[::20])
    assert all(where[signed[20 * p]] & where[signed[k]] for p, k in zip(probe.tolist(), node.tolist()))


# --- decontamination

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(docs, items, size=10):
    cut = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[x]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(ids), ",".join(ids), bool(hit)))
    return by_row(out)


def test_contamination_equals_brute_force(spark, odd, none):
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    items = [tuple(r) for r in rows] + [(501, "One"), (501, "One"), (502, "tie TIE!"), (503, None), (504, "..."),
                                        (None, "one two"), (505, rows[0].text)]
    items = [(*x, 1, "x") for x in items]
    bench = spark.createDataFrame(items, "item_id long, text string, win int, words string")
    got = decontam.contamination(odd, bench).collect()
    got = by_row((r[0], r[1], r[2], r[3], ",".join(r[4]), r[5]) for r in got)
    assert got == plain_contamination([(r.doc_id, r.text) for r in odd.collect()], [x[:2] for x in items])
    assert any(r[-1] for r in got)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("contaminated or n_items > 0").count() == 0
    kept = decontam.stage(spark, odd, SF)
    clean = plain_contamination([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in rows])
    assert kept.columns == odd.columns and kept.count() == sum(not r[-1] for r in clean)


def test_a_passage_of_every_item_in_many_documents(spark):
    """Documents that share their windows share the list of items, which is worked out once."""
    common = "terms of use apply to all of this text here"
    items = [(k, f"{common} item{k} with its own end") for k in range(300)]
    docs = [(k, f"x{k} {common} y{k}" if k % 3 else f"{common} item{k} with its own end") for k in range(200)]
    docs += [(900, None), (901, "nothing shared")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = by_row((r[0], r[1], r[2], r[3], ",".join(r[4]), r[5]) for r in got)
    assert got == plain_contamination(docs, items)
    assert max(r[3] for r in got) == 300


# --- scoring

def test_scores_equal_a_plain_model(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = by_row(ppm.score(odd).collect())
    split = by_row(ppm.score(odd, max_entries=2000, n_frequent=50).collect())
    count, n_train = Counter(), 0
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: BLANK_WORD.findall((t or "").translate(LOWER))
    for i, t in rows:
        if i is not None and not held(i):
            count.update(words(t))
            n_train += 1
    total, v = sum(count.values()) + n_train, len(count) + 1
    for a, b, (i, t) in zip(got, split, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in (r[0],)))):
        w = words(t) if [x[0] for x in rows].count(i) == 1 else None
        assert a[:2] == b[:2] and a[2:5] == b[2:5]
        assert math.isclose(a[5], b[5], abs_tol=1e-6) and math.isclose(a[6], b[6], abs_tol=1e-6) and a[6] <= 0
        if w is not None:
            base = sum(math.log10(count[x] + 0.5) for x in w) + math.log10(n_train + 0.5) \
                - (len(w) + 1) * math.log10(total + 0.5 * (v + 1))
            assert (a[0], a[1], a[2], a[3], a[4]) == (i, held(i), len(w) + 1, sum(x in count for x in w) + 1, total)
            assert math.isclose(a[5], base, rel_tol=1e-9, abs_tol=1e-6)
    assert ppm.score(none).count() == 0


def test_the_trie_is_a_probability_model():
    """For any context the next-symbol probabilities sum to one."""
    texts = [t.split() for t in (b"the cat sat on the mat", b"the bat sat", b"", b"a cat")]
    runs, counts = np.unique(ppm._symbols(texts)[0], return_counts=True)
    pair = np.zeros(1 << 16, np.int64)
    np.add.at(pair, (runs & np.uint64(0xFFFF)).astype(int), counts)
    trie = ppm.Trie(runs, counts, pair)
    for ctx in (b"\n\n\n\n\n", b"\n\nthe", b"e cat", b"zzzzz", b"qq sa"):
        key = int.from_bytes(ctx, "big") << 8
        p = trie.score(np.array([key + s for s in range(256)], np.uint64))
        assert math.isclose((10 ** p).sum(), 1.0, rel_tol=1e-9)


# --- the byte primitives

def test_words_and_sums_do_not_depend_on_neighbours():
    import pyarrow as pa
    texts = ["Ab c", None, "", "x-y 9é", " ", "long " * 50]
    data, offsets = bt.text_bytes(pa.array(texts))
    starts, ends, cut = bt.words(bt.LOWER[data], offsets, bt.ALNUM)
    got = [[bt.LOWER[data][s:e].tobytes().decode() for s, e in zip(starts[cut[k]:cut[k + 1]], ends[cut[k]:cut[k + 1]])]
           for k in range(len(texts))]
    assert got == [ITEM_WORD.findall((t or "").translate(LOWER)) for t in texts]
    h = bt.word_hashes(bt.LOWER[data], starts, ends)
    for k, t in enumerate(texts):
        d, o = bt.text_bytes(pa.array([t]))
        s, e, _ = bt.words(bt.LOWER[d], o, bt.ALNUM)
        assert bt.word_hashes(bt.LOWER[d], s, e).tolist() == h[cut[k]:cut[k + 1]].tolist()
    assert [b[:2] for b in bt.blocks(data, offsets, 10)][-1][1] == len(texts)


def test_hash_of_items():
    assert hashlib.sha256(b"").hexdigest() == \
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# --- packing: the words of the tokenizer

def test_frequent_words_stay_known_when_the_cache_is_full(monkeypatch):
    from bizlens.llm import packing
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    words = packing.WordIds(packing.default_tokenizer())

    class Counting:
        def __init__(self, model):
            self.model, self.asked = model, Counter()

        def tokenize(self, text):
            self.asked[text] += 1
            return self.model.tokenize(text)
    words.model = Counting(words.model)
    texts = [f"often Été, don't " + " ".join("x" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10 % 10] + "uvwxyz"[j % 6] * (1 + j // 6)
                                             for j in range(20)) for k in range(60)]
    for t in texts:
        plain = words.tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(t.encode()), "<u4").tolist() == plain
    assert words.model.asked["often"] == 1
