"""Sharding, WARC and near-duplicates against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest_llm import TEXTS, tuples
from pyspark.sql import functions as F

from plurigrade.llm import common, sharding, simhash, warc


def test_shards_are_even_and_slots_gapless(spark, docs, empty):
    wide = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 500).cast("int")).alias("text"), F.lit(1).alias("shard"), F.lit("k").alias("slot"))
    rows = sharding.shard(wide).collect()
    load = np.bincount([r.shard for r in rows], [r.size for r in rows], 8)
    assert load.max() - load.min() <= 0.01 * load.mean()
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    got = tuples(sharding.shard(docs), "doc_id", "size", "text_crc32", "law", "grown_shard")
    assert got == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t in TEXTS), key=repr)
    assert sharding.shard(empty).collect() == []


def test_copies_share_a_shard_and_hot_groups_are_spread(spark):
    rows = [(i, f"text {i % 700} " * 20) for i in range(1400)] + [(7, "one hot row of one id") for _ in range(9000)] + [(10_000 + i, "hot text of many ids") for i in range(9000)] + [(9, f"t{i}") for i in range(5000)] + [(None, None)] * 40
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in out) == sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    load = np.bincount([r.shard for r in out], [r.size for r in out], 8)
    assert load.max() - load.min() <= 0.01 * load.mean()
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    held = {}
    for r in out:
        held.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    whole = [s for (_, c), s in held.items() if c not in (zlib.crc32(b"one hot row of one id"), zlib.crc32(b"hot text of many ids"))]
    assert all(len(s) == 1 for s in whole) and len(whole) == 5701


def test_an_edit_moves_little_and_new_shards_fill(spark, tmp_path):
    rows = sharding.pieces(sharding.units(spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 97).cast("int")).alias("text"))))
    sizes = sharding.slot_sizes(rows)
    path = f"file://{tmp_path}/map"
    sharding.store_map(sharding.first_map(spark, 8), path)
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path, 0), sizes, 8), path)
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path, 1), sizes, 9), path)
    old, new = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    assert len(old) == len(new) == sharding.SLOTS and set(new.values()) == set(range(9))
    assert sum(old[s] != new[s] for s in old) < 0.3 * sharding.SLOTS
    again = {r.virtual_slot: r.shard for r in sharding.rebalanced(sharding.load_map(spark, path, 2), sizes, 9).collect()}
    assert sum(again[s] != new[s] for s in new) <= 0.05 * sharding.SLOTS


def test_sharding_runs_no_python(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [(1000, "u", "x" * 150), (1001, "u2", "x" * 150), (1001, "u2", "x" * 150), (1000, "u", "x" * 150), (None, None, "x" * 150), (1003, "a", None), (1004, "é\nb", "é" * 60), (1005, "z", "\r\n\r\nWARC/1.1\r\n"), (1006, "z", "short"), (1007, "z", "short"), (1008, "q", "<p>" * 60_000), (None, "only", "y" * 200)]


def test_captures_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "t") for p in PAGES], "page_id long, url string, html string, type string")
    path = f"file://{tmp_path}/warc"
    got = tuples(warc.captures(pages, path=path), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = h in first and i != first[h]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=repr)
    records = warc.read_warc(spark, path)
    assert records.count() == 3 * len(PAGES) and records.select("id").distinct().count() == 3 * len(PAGES)
    whole = warc.assembled(records)
    assert whole.where("request is null or metadata is null").count() == 0 and warc.orphans(records).count() == 0
    ids = {r.id for r in records.where("type = 'response'").collect()}
    assert all(r.refers_to in ids for r in records.where("type = 'revisit'").collect())


def test_records_without_partner(spark):
    rows = [("response", "a", None), ("request", "b", "a"), ("request", "c", "a"), ("metadata", "d", "zz"), ("response", "e", None), ("request", "f", None)]
    full = spark.createDataFrame([(t, i, c, None, "u", "d", "x", "y", "z", 1, "q", "f", 0, 1) for t, i, c in rows], warc.RECORD)
    got = {r.id: (r.request and r.request.id, r.metadata) for r in warc.assembled(full).collect()}
    assert got == {"a": ("b", None), "e": (None, None)}
    assert sorted(r.id for r in warc.orphans(full).collect()) == ["d", "f"]


def test_damaged_archives_fail():
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"])))
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"no record"])))
    import gzip

    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(b"x" * 5000)[:-20]))
    assert b"".join(warc.inflated(gzip.compress(b"one") + gzip.compress(b"two"))) == b"onetwo"


def test_records_come_whole_from_small_pieces():
    data = b"".join(f"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: {n}\r\n\r\n{'y' * n}\r\n\r\n".encode() for n in (0, 5, 700))
    for size in (1, 3, 50, 10_000):
        got = list(warc.parse(data[i : i + size] for i in range(0, len(data), size)))
        assert [len(r["content"]) for r in got] == [0, 5, 700] and all(data[r["offset"] : r["offset"] + r["length"]] == r["content"] for r in got)


def test_ids_of_any_characters_and_bodies_by_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([("a\nb", "u", "é" * 80), ("c: d%20", "u", "é" * 80), ("", "u", "é"), (None, "u", "z" * 300)], "page_id string, url string, html string")
    path = f"file://{tmp_path}/warc"
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.captures(pages, path=path).collect()}
    assert got[("a\nb", 160)] == ("response", None) and got[("c: d%20", 160)] == ("revisit", "a\nb") and (None, 300) in got and ("", 2) in got
    for r in warc.assembled(warc.read_warc(spark, path)).collect():
        assert warc.record_at(spark, r.capture.file, r.capture.offset, r.capture.length).decode() == r.capture.content
    assert warc.assembled(warc.read_warc(spark, path, bodies=False)).where("capture.content is not null").count() == 0


def test_no_pages(spark):
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def plain_print(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    """Root of every index by pairwise comparison."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_pool(n, seed):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            out.append(x)
    return out


@pytest.mark.parametrize("plan", simhash.PLANS)
@pytest.mark.parametrize("hot", [simhash.HOT_HOMES, 2])
def test_links_lose_no_component(spark, hot, plan):
    pool = sorted(set(near_pool(700, 3)))
    signed = np.array(pool, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    root = {r.node: r.root for r in simhash.components(simhash.star_links(rows, 4, hot, plan)).collect()}
    own, want = {}, {}
    for i, (x, k) in enumerate(zip(signed, plain_components(pool), strict=True)):
        own.setdefault(root.get(x, x), set()).add(i)
        want.setdefault(k, set()).add(i)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, want.values()))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    root = {r.node: r.root for r in simhash.components(links).collect()}
    assert root == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_every_value_visits_its_neighbours_homes():
    code = simhash.Anchors(21, 2)
    r = np.random.RandomState(1)
    x = r.randint(0, 1 << 21, 400)
    home = code.home(x)
    assert all(bin(a ^ b).count("1") <= 1 for a, b in zip(x.tolist(), home.tolist(), strict=True))
    for b in range(-1, 21):
        y = x ^ (1 << b if b >= 0 else 0)
        at, anchor = code.near(y)
        assert {(i, h) for i, h in enumerate(home.tolist())} <= set(zip(at.tolist(), anchor.tolist(), strict=True))


def test_the_code_follows_the_number_of_fingerprints():
    few, many = simhash.PLANS
    assert simhash.plan_for(1_000_000, 4) == few and simhash.plan_for(1_000_000_000, 4) == many
    assert few.rows(4) <= 60 and many.rows(4) <= 350 and many.pairs(4) < few.pairs(4) / 90


def test_every_value_visits_its_neighbours_homes_in_wide_blocks():
    code = simhash.Anchors(32, 3, 31)
    r = np.random.RandomState(2)
    x = r.randint(0, 1 << 32, 40)
    home = code.home(x)
    assert all(bin(a ^ b).count("1") <= 1 for a, b in zip(x.tolist(), home.tolist(), strict=True))
    for _ in range(60):
        a, b = r.randint(0, 32, 2).tolist()
        at, anchor = code.near(x ^ (1 << a) ^ (1 << b))
        assert {(i, h) for i, h in enumerate(home.tolist())} <= set(zip(at.tolist(), anchor.tolist(), strict=True))


def test_near_duplicates_of_documents(spark, docs, empty):
    got = tuples(simhash.near_duplicates(docs))
    prints = [plain_print(t) for _, t in TEXTS]
    roots = plain_components(prints)
    low = {}
    for (i, _), k in zip(TEXTS, roots, strict=True):
        low[k] = min((x for x in (low.get(k), i) if x is not None), default=None)
    assert got == sorted(((i, f"{p:016x}", low[k]) for (i, _), p, k in zip(TEXTS, prints, roots, strict=True)), key=repr)
    assert simhash.near_duplicates(empty).collect() == []


def test_one_document_of_each_group_stays(docs, empty):
    out = simhash.one_of_each(docs)
    assert out.schema == docs.schema
    prints = [plain_print(t) for _, t in TEXTS]
    assert out.count() == len(set(plain_components(prints)))
    kept = [r.doc_id for r in out.collect()]
    assert 1 in kept and 7 not in kept and kept.count(6) == 1 and 2 in kept and 3 not in kept
    assert simhash.one_of_each(empty).collect() == []


def test_the_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
