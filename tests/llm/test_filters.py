"""Personal data, decontamination, quality rules and the classifier against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import TEXTS, tuples

from plurigrade.llm import additive_model, decontamination, pii, quality_rules

# The contract's patterns, as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    bits = [*"@@...+-- ()0123456789ab", "4041894974608795", "4041-8949-7460-8795", "255.1", "000255.", "a@b.c", "+1 (988) 555-2485", "é", "٣"]
    for _ in range(30_000):
        t = "".join(r.choices(bits, k=r.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_long_digit_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + "+(" * 20_000) == []


def further_f1(model, texts, wanted):
    """F1 of the further spans, by kind and place."""
    got = [{s for s in more} for _, more in pii.spans_of(texts, model)]
    want = [{(kind, a, b) for (a, b), kind in places.items()} for places in wanted]
    hits = sum(len(g & w) for g, w in zip(got, want, strict=True))
    return 2 * hits / max(1, sum(map(len, got)) + sum(map(len, want)))


def test_every_potential_carries_weight():
    held_out = pii.practice(300, 99)
    full = pii.trained()
    best = further_f1(full, *held_out)
    assert best >= 0.95
    for name, least in (("node", 0.1), ("chain", 0.01), ("skip", 0.1)):
        weights = {k: getattr(full, k) for k in ("node", "chain", "skip")}
        weights[name] = np.zeros_like(weights[name])
        assert further_f1(pii.Field(**weights), *held_out) <= best - least, name
    for sort in range(pii.SORTS):
        skip = full.skip.copy()
        skip[sort] = 0
        assert further_f1(pii.Field(full.node, full.chain, skip), *held_out) < best - 0.01, sort


def exact_beliefs(model, g):
    """Marginals by enumeration of all labellings."""
    from itertools import product

    n = len(g.spans)
    unary = g.x @ model.node
    total = np.zeros((n, pii.LABELS))
    for labels in product(range(pii.LABELS), repeat=n):
        if any(k and labels[i] != k for i, k in enumerate(g.given.tolist())):
            continue
        e = sum(unary[i, k] for i, k in enumerate(labels) if not g.given[i])
        e += sum(model.chain[labels[a], labels[b]] for a, b in g.chain.tolist())
        e += sum(model.skip[s, labels[a]] for (a, b), s in zip(g.skip.tolist(), g.sort.tolist(), strict=True) if labels[a] == labels[b])
        total[np.arange(n), labels] += np.exp(e)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text", ["pay 4041894974608795 now 4041.8949.7460.8795", "a +1 (988) 555-2485 so 988 555 and 12-ab", "x bo.b7@firm.org or bo.b7 3.1", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 7.1'])
def test_beliefs_are_exact_without_loops(text):
    g = pii.graph([text], [pii.base_spans(text)])
    got = pii.trained().beliefs(g)
    free = g.given == 0
    # The messages of a graph without loops give the exact marginals; held nodes cut loops.
    assert 0 < len(g.spans) <= 6 and np.allclose(got[free], exact_beliefs(pii.trained(), g)[free], atol=2e-3)


def test_beliefs_are_near_exact_with_loops():
    r = np.random.RandomState(3)
    for _ in range(20):
        n = 5
        pairs = lambda k: np.array([sorted(r.choice(n, 2, replace=False)) for _ in range(k)])  # noqa: E731, B023
        g = pii.Graph([(0, i, i + 1) for i in range(n)], r.randn(n, pii.FEATURES) * 0.3, np.array([2, 0, 0, 0, 0]), np.array([[i, i + 1] for i in range(n - 1)]), pairs(3), r.randint(0, pii.SORTS, 3))
        f = pii.Field(r.randn(pii.FEATURES, pii.LABELS) * 0.5, r.randn(pii.LABELS, pii.LABELS) * 0.3, np.abs(r.randn(pii.SORTS, pii.LABELS)) * 0.5)
        assert np.abs(f.beliefs(g)[1:] - exact_beliefs(f, g)[1:]).max() < 0.08


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to bosbt.42@mail8.example.com, then BOSBT.42 again", [("email", "BOSBT.42")]),
        ("from 10.0.0.1 and 10-0-0-1 too", [("ip", "10-0-0-1")]),
        ("call +1-988-555-2485 or 555-2485.", [("phone", "555-2485")]),
        ("ask info@firm.org for info about a thing", []),
        ("card 4041 8949 7460 8795 with 4041.8949 7460 of it, and 7460 more", [("card", "4041.8949"), ("card", "7460")]),
        ("card 4041 8949 7460 8795 and 7460 more", []),
        ("card 4041894974608795 typed 4041894974608796", [("card", "4041894974608796")]),
        ('so token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 04dbebab91ab85687d33eeaaf9ac699e1188f962', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")] * 2),
        ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 is a sum", []),
        ("password is required and token of trust 2024", []),
        ("api_key=Zx81kPq04LmN77tRw2Yv done", [("secret", "Zx81kPq04LmN77tRw2Yv")]),
    ],
)
def test_further_spans(text, want):
    ((_, more),) = pii.spans_of([text], pii.trained())
    assert [(k, text[a:b]) for k, a, b in more] == want


def test_decoys_stay_clean():
    texts = ["version 2.0.1 of 2024-01-02 and 300.1.2.3 or 4041894974608796 twice 4041894974608796", "call 12345 or 12345, key=ab12cd34 key=ab12cd34"]
    assert pii.spans_of(texts, pii.trained()) == [([], []), ([], [])]


@pytest.mark.parametrize("base, like", [("4041894974608795", "4041.8949.7460.8795"), ("bosbt.42@mail8.example.com", "bosbt.42"), ("+1 (988) 555-2485", "555-2485"), ("42.144.35.254", "42-144-35-254")])
def test_one_base_span_reaches_all_its_likes(base, like):
    many = " and more of ".join([like] * 150)
    for text in (f"first {base} then {many} end", f"first {many} then {base} end"):
        ((held, more),) = pii.spans_of([text], pii.trained())
        assert len(held) == 1 and {text[a:b] for _, a, b in more} == {like} and len(more) == 150


@pytest.mark.parametrize(
    "kind, base, like",
    [
        ("email", "jane.miller@firm.org", "jane.miller"), ("email", "to:janemiller@firm.org,", "Jane-Miller"), ("email", "o7@firm.org", "o7"), ("email", "jane.miller@1.2.3.4", "jane.miller"),
        ("card", "4041 8949 7460 8795", "4041.8949.7460.8795"), ("card", "4041894974608795", "4041.8949 7460.8795"), ("phone", "+1-988-555-2485", "(988) 555-2485"), ("phone", "+1 988 555 2485", "(988) 555-2485"),
    ],
)
def test_likes_of_whole_base_spans(kind, base, like):
    for text in (f"first {base} and then {like} again", f"{like} before {base}"):
        ((_, more),) = pii.spans_of([text], pii.trained())
        assert [k for k, _, _ in more] == [kind] and like.strip("(") == text[more[0][1] : more[0][2]]


def test_words_are_no_likes_without_their_address():
    text = "jane.miller met jane.miller at noon, mail bo@firm.org"
    assert pii.spans_of([text], pii.trained()) == [([("email", text.index("bo@"), len(text))], [])]


def test_labels_do_not_depend_on_the_batch():
    texts = pii.practice(40, 5)[0] + ["4041894974608795 " + "4041.8949.7460.8795 12345 a1b2c3 " * 3000]
    assert pii.spans_of(texts, pii.trained()) == [pii.spans_of([t], pii.trained())[0] for t in texts]


def test_pii_query(docs, empty):
    rows = tuples(pii.digest(pii.find(docs)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for i, t in TEXTS:
        s = plain_spans(t or "")
        n = Counter(k for k, _, _ in s)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert rows == sorted(want, key=repr)
    assert pii.digest(pii.find(empty)).collect() == []


def test_masking_keeps_columns_and_clean_texts(docs, empty):
    out = pii.masked(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[6] == "Mail [EMAIL] or [PHONE], from [IP] with [CARD]." and got[1] == TEXTS[0][1] and got[2] is None
    assert pii.masked(empty).collect() == []


def test_masking_takes_further_spans_alone(spark):
    text = "paid by 4041.8949.7460.8795 and again 4041.8949.7460.8795."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [r.n_further for r in pii.digest(pii.find(docs.where("doc_id = 1"))).collect()] == [2] and pii.base_spans(text) == []
    assert {r.doc_id: r.text for r in pii.masked(docs).collect()} == {1: "paid by [CARD] and again [CARD].", 2: None}
    mixed = spark.createDataFrame([(1, text), (2, "mail a.b1@firm.org")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.text for r in pii.masked(mixed).collect()} == {1: "paid by [CARD] and again [CARD].", 2: "mail [EMAIL]"}


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "one two three four five six seven eight nine"), (2, "Short item"), (3, None), (4, ""), (5, "été 9 LIVES of cats and dogs here now"), (1, "one two three four five six seven eight nine"), (None, "no id at all")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def leaky(spark):
    texts = ["x ONE two, three four five six seven eight nine y", "one two three four five six seven", "a short item and one-two.three four five six seven eight", None, "", "Été 9 lives of cats and dogs here", "été 9 lives of cats and dogs here", "w " * 5000 + "short item", "no id at all"]
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "short item", 0), (0, texts[0], 0)], "doc_id long, text string, n_words int")


def plain_hits(docs, items, n=8):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for x, ids in windows.items():
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontamination.BLOCK, 2])
def test_hits_in_one_block_or_more(leaky, benchmark, block):
    got = tuples(decontamination.digest(decontamination.find(leaky, benchmark, block_windows=block)))
    want = plain_hits([(r.doc_id, r.text) for r in leaky.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert got == want


@pytest.mark.parametrize("block", [decontamination.BLOCK, 2])
def test_items_without_id_hit_but_do_not_count(spark, block):
    words = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(None, words), (None, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {words} end"), (2, "other words"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.digest(decontamination.find(docs, items, block_windows=block)).collect()}
    assert got == {1: (8, 0, False), 2: (2, 0, False), 3: (0, 0, False)}
    assert {r.doc_id: r.text for r in decontamination.clean(docs, items, block_windows=block).collect()} == {1: "so  end", 2: "", 3: "clean"}


@pytest.mark.parametrize("block", [decontamination.BLOCK, 2])
def test_cleaning_drops_documents_or_spans(leaky, benchmark, block):
    out = decontamination.clean(leaky, benchmark, block_windows=block)
    assert out.schema == leaky.schema
    got = {(r.doc_id, r.n_words): r.text for r in out.collect()}
    assert (2, 2) not in got and got[0, 0] == "x  y" and got[1, 1] == "one two three four five six seven" and got[3, 3] is None
    assert got[6, 6] == "" and got[5, 5] == "Été 9 lives of cats and dogs here" and len(got[7, 7]) == 10_000


def test_decontamination_of_nothing(leaky, benchmark):
    assert decontamination.find(leaky.limit(0), benchmark).collect() == []
    assert all(not r.items for r in decontamination.find(leaky, benchmark.limit(0)).collect())
    assert decontamination.clean(leaky, benchmark.limit(0)).count() == leaky.count()


def plain_measures(t):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t or "")
    lines = [x for x in (t or "").split("\n") if word.search(x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, empty):
    r = random.Random(6)
    bits = ["a", "b", "c", "the", " ", " ", "\n", "\t", "\r\n", "\x0b", "#", "é", "\x85", " ", "x!"]
    made = [(i, "".join(r.choices(bits, k=r.randint(0, 60)))) for i in range(400)]
    made += [(1000, "a b c"), (1001, "a b c a b c"), (1002, "a a a a"), (1003, "\n\n x \n x \n")]
    rows = spark.createDataFrame(made, "doc_id long, text string")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {x.doc_id: tuple(x[c] for c in columns) for x in quality_rules.measures(rows).collect()}
    assert {i: (got[i], plain_measures(t)) for i, t in made if got[i] != plain_measures(t)} == {}
    assert tuples(quality_rules.measures(docs), "doc_id", *columns) == sorted(((i, *plain_measures(t)) for i, t in TEXTS), key=repr)
    assert quality_rules.judged(empty).collect() == []


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "The old man went down to the sea and looked for the boat that his son had left on the sand by the rocks that morning. " + " ".join(f"The word{i} of item{i} is" for i in range(20))
    junk = ["%%% *** ### " * 40, "WORDS!! " * 80, "a " * 200, "short text", None, "", "| cell | cell2 " * 60]
    rows = spark.createDataFrame([(0, prose, "x")] + [(i + 1, t, "x") for i, t in enumerate(junk)], "doc_id long, text string, n_words string")
    assert [r.doc_id for r in quality_rules.judged(rows).collect() if r.kept] == [0]
    kept = quality_rules.kept(rows)
    assert kept.schema == rows.schema and [tuple(r) for r in kept.collect()] == [(0, prose, "x")]


def test_no_user_function_in_the_rules(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier_learns_from_the_train_part_only(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = y.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    a, b = (additive_model.scored(d, additive_model.train(d, labels)) for labels in (y, flipped))
    got = {r.doc_id: r for r in a.collect()}
    assert got == {r.doc_id: r for r in b.collect()}  # held-out labels have no say
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    rows = [(got[r.doc_id], r.quality) for r in y.collect() if r.doc_id in got]
    out = [(g.predicted == q) for g, q in rows if g.held_out]
    assert len(out) > 50 and np.mean(out) >= 0.95
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g, _ in rows)


def plain_tree(g, h, leaves):
    """Greedy splits of ordered bins by the second-order gain, gone through one by one."""
    value = lambda a, b: sum(g[a:b]) / (sum(h[a:b]) + additive_model.RIDGE)
    gain = lambda a, b: sum(g[a:b]) * value(a, b)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(gain(a, c) + gain(c, b) - gain(a, b), (a, b), c) for a, b in parts for c in range(a + 1, b)]
        best = max(cuts, key=lambda x: x[0], default=None)
        if best is None or best[0] <= 1e-9:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    return [next(value(a, b) for a, b in parts if a <= i < b) for i in range(len(g))]


def test_trees_against_brute_force():
    r = np.random.RandomState(4)
    for n in (1, 2, 3, 8, 20):
        for leaves in (1, 2, 4):
            g, h = r.randn(n), r.rand(n)
            assert np.allclose(additive_model._tree(g, h, leaves), plain_tree(g.tolist(), h.tolist(), leaves))


def test_odds_are_sums_of_table_entries():
    r = np.random.RandomState(5)
    x = np.round(r.rand(600, 5), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive_model.fit(x, y)
    assert (0, 1) in [p[:2] for p in model.pairs]
    want = []
    for row in x:
        total = model.prior
        b = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total += sum(t[k] for t, k in zip(model.tables, b, strict=True))
        total += sum(t[b[j] * additive_model.PAIR_BINS // (len(model.edges[j]) + 1), b[k] * additive_model.PAIR_BINS // (len(model.edges[k]) + 1)] for j, k, t in model.pairs)
        want.append(total)
    assert np.allclose(model.odds(x), want)
    # The pairs make the model see what no feature alone tells.
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_training_does_not_depend_on_the_order_of_rows(spark):
    sf = "/root/testdata/sf0.001"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    many = d.unionByName(d).unionByName(d.limit(50))
    a, b = additive_model.train(many.repartition(1), y, sample=40), additive_model.train(many.repartition(7, "text"), y, sample=40)
    assert a.prior == b.prior and all(np.array_equal(u, v) for u, v in zip(a.tables, b.tables, strict=True))


def test_classifier_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = additive_model.train(docs, labels)
    assert additive_model.scored(docs, model).count() == len(TEXTS)
    none = additive_model.train(empty, labels.limit(0))
    assert additive_model.scored(empty, none).collect() == []
    assert {r.score for r in additive_model.scored(docs, none).collect()} == {0.5}
