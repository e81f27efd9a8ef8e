"""Licence scan, WARC, packing, quotation linking, sharding and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from bizlens.llm import chat, license, packing, sharding, warc
from bizlens.llm.queries import QUERIES, SQL
from helpers import assert_same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def llm_duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, llm_duck, name):
    assert_same(QUERIES[name](spark, SF), llm_duck, SQL[name])


# --- licences

def test_licences_and_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE.txt", "All rights reserved."),
            (4, "a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (5, "z.py", "code"),
            (6, None, mit), (7, "a/b/c/d/e.py", None), (8, "ab/x", ""), (9, "a/b/c/x.py", "code"),
            (10, "q/late.py", "line\n" * 400 + mit)]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, path string, text string, uid int, dir string")
    got = {r.id: (r.own_license, r.license, r.license_from) for r in license.scan(files, key="id", path=files["path"]).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "Proprietary", "a/b"), 3: ("Proprietary", "Proprietary", None),
                   4: ("Apache-2.0", "Apache-2.0", None), 5: (None, None, None), 6: ("MIT", "MIT", None),
                   7: (None, "Proprietary", "a/b"), 8: (None, None, None), 9: (None, "Proprietary", "a/b"),
                   10: ("MIT", "MIT", None)}
    assert license.scan(files.limit(0), key="id", path=files["path"]).count() == 0


def test_licence_headers_tags_and_files(spark):
    spdx = {n: f"// SPDX-License-Identifier: {n}\nint x;" for n in ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0")}
    cases = [(n, f"s/{k}.c", t) for k, (n, t) in enumerate(spdx.items())]
    cases += [("GPL-2.0", "s/g.c", "// SPDX-License-Identifier: GPL-2.0-only"), (None, "s/z.c", "// SPDX-License-Identifier: Zlib"),
              (None, "s/a.c", "# Licensed under the Apache License, Version 1.1.")]
    for k, (name, text, _) in enumerate(license.PASSAGES):
        if len(text) > 150 and "verbatim" not in text:
            words = text.split()
            wrapped = "\n".join(" * " + " ".join(words[j:j + 9]) for j in range(0, len(words), 9))
            cases += [(name, f"h/{k}.c", f"/* Copyright 2020 A. Author\n{wrapped}\n */\nint main() {{}}\n"),
                      (name, f"u/{k}.c", f"# {text}\ncode\n" + "more code\n" * 30)]
    texts = Path("/usr/share/common-licenses")
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"),
                       ("BSD-3-Clause", "BSD"), ("MPL-2.0", "MPL-2.0")):
        if (texts / file).exists():
            cases.append((name, f"{file}/LICENSE", (texts / file).read_text()))
    cases += [(None, f"c/{k}.c", "plain code line\n" * 20) for k in range(30)]
    files = spark.createDataFrame([(k, p, t) for k, (_, p, t) in enumerate(cases)], "id long, path string, text string")
    got = {r.id: (r.own_license, r.path) for r in license.scan(files, key="id", path=files["path"]).collect()}
    assert got == {k: (name, p) for k, (name, p, _) in enumerate(cases)}


def test_a_long_licence_file_full_of_key_terms(spark):
    words = " ".join(k.split()[0] for _, _, k in license.PASSAGES)
    name, passage, _ = max((p for p in license.PASSAGES if "verbatim" not in p[1]), key=lambda p: len(p[1]))
    noise = "\n".join([words] * 400)  # tens of thousands of hits in one unit
    rows = [(1, "a/LICENSE", f"{noise}\n{passage}\n{noise}"), (2, "a/x.c", "int x;"), (3, "b/LICENSE", ""), (4, "b/y.c", None)]
    files = spark.createDataFrame([(*r, 1, "x", "x") for r in rows],
                                  "id long, path string, text string, key int, units string, own string")
    got = {r.id: (r.own_license, r.license) for r in license.scan(files, key="id", path=files["path"]).collect()}
    assert got[2][0] is None and got[1][1] == got[2][1] and got[1][0] == name
    assert got[3] == got[4] == (None, None)


# --- WARC

def test_warc_round_trip(spark):
    big = "é" * 60
    rows = [(5, "http://Www.Example.com/a?b=1#f", big), (3, "https://example.com:443/x", big), (9, None, big),
            (7, "http://u@h.org:8080", "small"), (8, "http://u@h.org:8080", "small"), (2, "odd url\n here", None),
            (3, "https://example.com:443/x", big), (None, "http://n.org/", big), (None, "http://n.org/", "y" * 200),
            (11, "http://long.org/" + "p" * 3000, "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key int, file string") \
        .repartition(2)
    archive = warc.write_warc(pages, min_dedup=100)
    keys = pages.select(warc.key_of(pages["url"]).alias("key"))
    got = warc.resolve(warc.fetch(archive, warc.lookup(archive, keys))).collect()
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        raw, low = (h or "").encode(), first.get(h)
        again = low is not None and i != low
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low if again else None))
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    one = spark.createDataFrame([("com,example,www)/a?b=1",), ("none)/",)], "key string")
    found = warc.fetch(archive, warc.lookup(archive, one), with_payload=True).collect()
    assert [(r.page_id, bytes(r.payload).decode()) for r in found] == [(5, "")]  # 3 is the response
    assert warc.write_warc(pages.limit(0)).top.count() == 0


def test_surt_keys():
    assert warc.surt_key("https://User@www.Example.org:8080/A?b#c") == "org,example,www:8080)/a?b"
    assert warc.surt_key("HTTP://example.org:80") == "org,example)/"
    assert warc.surt_key(None) == "-"


def test_blocks_are_searched_over_their_edges(spark):
    rows = [(k, f"http://h{k % 3}.org/{k % 7}", "t") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.shared_path(spark, "warc"), warc.shared_path(spark, "cdx")
    top = warc.write_index(warc.write_archives(pages, folder), index, block_lines=4)
    found = warc.lookup(warc.Archive(folder, index, top), pages.select(warc.key_of(pages["url"]).alias("key")))
    assert sorted(r.page_id for r in found.collect()) == list(range(200))


# --- packing

def check_packing(rows, capacity):
    place = defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(place)


def test_packing_is_exact_and_dense(spark, odd, none):
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    rows = packing.pack(odd, path, with_ids=True).collect()
    want = Counter()
    for d in odd.select("doc_id", "text").collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want[d.doc_id, p, at, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    small = sum(r.length for r in rows if r.length < 4096)
    bound = sum(r.length == 4096 for r in rows) + math.ceil(small / 4096)
    assert bound <= check_packing(rows, 4096) <= bound + 1
    assert packing.pack(none, path).count() == 0


def test_islands_improve_hard_packings(spark):
    rng = np.random.default_rng(5)
    size = rng.integers(20, 70, 120).astype(np.int64)
    first = packing.best_fit(size, np.argsort(-size, kind="stable"), 100).value()
    pop, n, value, _ = packing.evolve(size, [], capacity=100, seed=1, generations=200, members=8)
    assert (n, value) <= first
    for of in pop:  # every item is packed once and no sequence overflows
        assert len(of) == 120 and max(np.bincount(of, weights=size)) <= 100
    items = spark.createDataFrame([(k, int(s)) for k, s in enumerate(size.tolist() * 10)], "uid long, length long")
    got = packing.assign(items, capacity=100, shard_items=100).collect()
    lengths = {k: int(s) for k, s in enumerate(size.tolist() * 10)}
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += lengths[r.uid]
    assert len(got) == 1200 and max(fill.values()) <= 100
    assert len(fill) <= math.ceil(sum(lengths.values()) / 100) * 1.1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 60, 80).astype(np.int64)
    a = packing.best_fit(size, np.argsort(-size, kind="stable"), 100)
    b = packing.best_fit(size, rng.permutation(80), 100)
    for child in (packing.crossover(a, b, size, rng), packing.mutate(a, size, rng)):
        assert sorted(k for s in child.items for k in s) == list(range(80))
        assert all(sum(size[s]) == 100 - f for s, f in zip(child.items, child.free))


# --- sharding

def test_shards_are_balanced_and_keep_groups(spark, odd, none):
    rows = sharding.shard_by_bytes(odd, 8).collect()
    text = Counter()
    for d in odd.select("doc_id", "text").collect():
        raw = (d.text or "").encode()
        text[d.doc_id, len(raw) + 1, zlib.crc32(raw)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == text
    slots, of, load = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.size, r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert all(len(s) == 1 for s in of.values())
    assert sharding.shard_by_bytes(none, 8).count() == 0


def test_differencing_beats_the_largest_group():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10**6, 2000).tolist()
    load = Counter()
    for s, k in zip(sizes, sharding.differencing(sizes, 8)):
        load[k] += s
    assert max(load.values()) - min(load.values()) <= 8
    load = Counter()
    big = [10**8, *sizes]
    for s, k in zip(big, sharding.differencing(big, 8)):
        load[k] += s
    assert sorted(load.values())[-1] <= max(10**8 + 1, sum(big) // 8 + 10**6)
    assert sharding.differencing([], 3) == [] and sharding.differencing([4], 3) == [0]


# --- quotation linking

def test_quotes_are_linked_and_removed(spark):
    rows = [(1, 0, "user", "Hello there.\n\nHow are you today?"), (1, 1, "assistant", "> How are you today?\nI am fine.\nReally."),
            (1, 2, "user", "unrelated"), (1, 3, "user", "Bob wrote:\n> I am fine.\n>> How are you  TODAY\nGood to hear"),
            (1, 4, "user", "> unrelated\nyes\n> > nothing known"), (2, 0, "user", None), (None, 0, "user", "x"),
            (None, 1, None, "> x\ny"), (2, None, "user", "> q"), (1, 3, "user", "> I am fine. Really.\nsame"),
            (3, 0, "user", "w " * 50_000), (3, 1, "user", "> " + "w " * 50_000)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows],
                              "conv_id long, turn long, role string, text string, uid int, conv string").coalesce(1)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = chat.threads(d)
    assert_same(got, con, chat.ORACLE)
    by = {(r.conv_id, r.text): r for r in got.collect()}
    assert (by[1, "Good to hear"].reply_to, by[1, "Good to hear"].thread_turn, by[1, "Good to hear"].n_linked) == (1, 0, 2)
    assert (by[1, "yes"].reply_to, by[1, "yes"].n_quotes, by[1, "yes"].n_linked) == (2, 2, 1)
    assert chat.threads(d.limit(0)).count() == 0


# --- the pipeline

def test_pipeline_equals_its_stages_done_plainly(spark):
    import corpus_pipeline
    from test_text_operators import plain_components, plain_contamination, plain_print

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        before = kept.count()
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    rows = sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    groups = plain_components([(i, plain_print(t)) for i, t in rows], 2)
    rows = [r for r, g in zip(rows, groups) if r[0] == g]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = sorted(r[0] for r in plain_contamination(rows, items) if not r[-1])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.doc_id for r in got}) == clean
    check_packing(got, 4096)
    one = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        one = stage(spark, one, SF)
        assert one.count() == 0
