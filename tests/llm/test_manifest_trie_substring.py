"""Merkle manifest, conversation prefix trie and substring deduplication against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bizlens.llm import merkle, prefixtrie, substring

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def bag(rows):
    return Counter(tuple(r) for r in rows)


# --- Merkle manifest

def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    def leaf(r, text):
        return H(*[_enc(v) for v in r[:4]], _enc(text))

    def grow(nodes):
        """levels from the given nodes to the last one"""
        levels = [nodes]
        while len(levels[-1]) > 1:
            cur = levels[-1]
            levels.append([H(*cur[i:i + 8]) for i in range(0, len(cur), 8)])
        return levels

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(r, r[4])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = grow([h for _, h in groups[g]])
    top = grow([trees[g][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for i, (r, h) in enumerate(groups[g]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            fold, sibs = leaf(r, text), []
            for levels, at in ((trees[g], i), (top, t)):
                for level in levels[:-1]:
                    lo = at // 8 * 8
                    left, right = level[lo:at], level[at + 1:lo + 8]
                    sibs += left + right
                    fold = H(*left, fold, *right)
                    at //= 8
            out.append((r[0], h, trees[g][-1][0], top[-1][0], H(*sibs), fold, fold == top[-1][0]))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(docs):
    return merkle.manifest(docs, merkle.tampered(F.col("doc_id"), F.col("text"))).select(*NAMES)


@pytest.mark.parametrize("share", [1000, 3])
def test_manifest_equals_plain_version(spark, odd, monkeypatch, share):
    monkeypatch.setattr(merkle, "SHARE", share)  # 3: most of the climb is in shuffled joins
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    got, want = bag(manifest_of(odd).collect()), bag(plain_manifest(rows))
    assert got == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_with_many_groups_and_one(spark, none):
    kinds = "doc_id long, source string, lang string, n_chars long, text string, node string, hash string"
    many = [(i, "s", f"l{i % 70}" if i % 70 else None, 1, f"Text {i}", "x", "y") for i in range(150)]
    for rows in (many, [r[:2] + ("en",) + r[3:] for r in many], many[:1], many[:2]):
        got = bag(manifest_of(spark.createDataFrame(rows, kinds)).collect())
        assert got == bag(plain_manifest([r[:5] for r in rows]))
    assert manifest_of(none).count() == 0


def test_climb_is_a_recursive_query_without_a_row_limit(spark, odd):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    manifest_of(odd).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before


# --- prefix trie

def plain_trie(rows):
    """rows: (conv_id, turn, role, text)"""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(built.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
             H(",".join(str(c) for c in m if len(built[c]) == len(p)))) for p, m in members.items()]


CONV = "conv_id long, turn long, role string, text string, key string, c long, pos string, parent int"


def conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    same = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of all") for c in range(2000, 2130) for t in range(1, 4)]
    long = [(3000, t, "user", "go on") for t in range(400)] + [(3001, t, "user", "go on") for t in range(399)]
    odd = [(4001, None, None, None), (4001, None, "a", ""), (4001, 1, "a", "tie"), (4001, 1, "a", "tie"), (4001, 1, "b", "tie"),
           (4002, 1, "", ""), (4003, 1, "user", "x " * 20_000), (None, 1, "user", "no conversation"),
           (4019, 1, "user", "alone"), (4021, 5, "u", " \t\n"), (4022, 5, "u", "Ünï cödé"), (4023, 1, "u", "a")]
    return rows + same + long + odd


@pytest.mark.parametrize("bits", [24, 7])
def test_trie_equals_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(prefixtrie, "BITS", bits)  # 7: a nearly full sketch lets all prefixes through
    monkeypatch.setattr(prefixtrie, "PIECE", 40)
    rows = conversations(spark)
    table = spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], CONV).repartition(5)
    got = [tuple(r) for r in prefixtrie.trie(table).collect()]
    assert bag(got) == bag(plain_trie(rows))


def test_trie_of_no_and_of_turnless_conversations(spark):
    assert prefixtrie.trie(spark.createDataFrame([], CONV)).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)  # its base is absent
    rows = [(c, 1, "user", "dropped")]
    got = prefixtrie.trie(spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], CONV))
    assert bag(got.collect()) == bag(plain_trie(rows)) == bag([(c, 0, None, 1, 0, 1, 0, H(str(c)))])


def test_screening_keeps_tails_from_the_exact_grouping(spark):
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    _, turns = prefixtrie.rebuilt(prefixtrie.turns_of(convs))
    rows = prefixtrie.prefixes(turns).persist()
    seen = spark.sparkContext.broadcast(prefixtrie.sketch(rows))
    passed = rows.where(prefixtrie.possibly_shared(spark, F.col("key"), seen))
    shared = rows.groupBy("key").count().where("count > 1")
    assert passed.join(shared, "key", "left_semi").count() == rows.join(shared, "key", "left_semi").count()
    assert passed.join(shared, "key", "left_anti").count() <= 0.01 * rows.count()


# --- substring deduplication

def plain_substrings(rows, window=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    places = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if places[tuple(w[s:s + window])] > 1:
                keep[s:s + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    def make(seed, n):
        return [f"w{(seed * 7919 + k * k * 31 + k * 17) % 997}x{seed}" for k in range(n)]

    shared = make(1, 60)
    rows = [(1, " ".join(make(2, 40) + shared + make(3, 40))), (2, "\n".join(make(4, 47) + shared + make(5, 11))),
            (3, " ".join(make(6, 30) + shared[:34] + make(7, 30))),  # one word short of a window
            (4, " ".join(make(8, 30) + shared[10:45] + make(9, 30))),  # exactly a window
            (5, " ".join(make(10, 50) * 3)),  # repeats itself
            (6, " ".join(["a"] * 200)), (7, " ".join(["a"] * 34)), (8, " ".join(["a"] * 35)),
            (9, " ".join(make(11, 3000))), (10, " ".join(make(11, 1500) + ["changed"] + make(11, 3000)[1500:])),
            (11, " ".join(make(12, 36))), (11, " ".join(make(12, 36))), (12, "\t".join(make(12, 36))),
            (13, None), (14, ""), (15, " \t\n "), (16, "Tie tie"), (None, "é " * 80)]
    return spark.createDataFrame([(*r, 1, "x", 2, "k") for r in rows], "doc_id long, text string, r1 long, k string, at int, id string"), rows


@pytest.mark.parametrize("bits", [27, 8])
def test_substrings_equal_plain_version(spark, texts, monkeypatch, bits):
    monkeypatch.setattr(substring, "BITS", bits)  # 8: full bitmaps leave the work to the joins
    table, rows = texts
    got = substring.deduplicate(table.repartition(4))
    assert bag(got.collect()) == bag(plain_substrings(rows))


def test_substrings_of_small_documents_and_none(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = bag(r[:4] for r in substring.deduplicate(odd).collect())
    assert got == bag(r[:4] for r in plain_substrings(rows))
    assert substring.deduplicate(none).count() == 0
    assert [r.n_removed for r in substring.deduplicate(odd, window=200, keep_text=False).collect()]
