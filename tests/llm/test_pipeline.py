"""The five stages on a small corpus, and the registered queries."""

import hashlib
import re

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from plurigrade.llm import pii, queries
from test_tables import plain_components, plain_print

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, at = docs.count(), docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, SF)
        path = f"{tmp_path}/{i}"
        out.write.parquet(path)
        at = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns, name
            m = at.count()
            assert 0 < m <= n, name
            n = m
            assert at.where("n_chars <> length(text)").count() == 0
        if name == "PII":
            assert all(not pii.base_spans(r.text) for r in at.collect())
            texts = {r.doc_id: r.text for r in at.collect()}
    rows = at.collect()
    assert len(rows) == n and all(len(r.ids) == r.n_tokens for r in rows)
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def plain_pipeline(con):
    """The rows of ``run``, by the rules' SQL, pairwise comparison, window by window, and the library."""
    from tokenizers import Tokenizer

    kept = con.sql(f"select doc_id, text from documents join ({queries.oracle_sql()['op10_quality_rules']}) using (doc_id) where kept order by doc_id").fetchall()
    roots = plain_components([plain_print(t) for _, t in kept])
    first = [kept[i] for i in sorted(set(roots))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in con.sql("select item_id, text from benchmark").fetchall():
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(i)
    sizes = {len(w) for w in windows}
    library, out = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), {}
    for i, t in first:
        at = [m.span() for m in word.finditer(low(t))]
        w = [low(t)[a:b] for a, b in at]
        found, hit = set(), set()
        for k in range(len(w)):
            for n in sizes:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        if len(found) >= 2:
            continue
        starts = [k for k in sorted(hit) if k - 1 not in hit]
        for a in reversed(starts):
            b = next(k for k in range(a, len(w) + 1) if k not in hit)
            t = t[: at[a][0]] + t[at[b - 1][1] :]
        ((base, more),) = pii.spans_of([t], pii.trained())
        t = pii.masked_text(t, base + more)
        ids = library.encode(t, add_special_tokens=False).ids
        out[i] = (ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_run_equals_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = {r.doc_id: (list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == plain_pipeline(con) and len(got) > 50


PROSE = "The old man went down to the sea and looked for the boat that his son had left on the sand by the rocks that morning, and he was glad of it. "


def test_run_on_odd_tables(spark, tmp_path):
    texts = [(1, PROSE + PROSE.title()), (1, PROSE + PROSE.title()), (2, None), (3, ""), (4, " ".join(f"The word{i} of item{i} is" for i in range(9000))), (None, "We were " + " ".join(f"at number{i} in the street{i}" for i in range(30))), (5, PROSE.upper() + PROSE), (None, None)]
    columns = ["key", "row", "doc", "fp", "h", "__text", "__row", "__kept", "hit", "value", "a b", "x.y"]
    rows = [(i, t, *([7] * len(columns))) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in columns))
    items = spark.createDataFrame([(None, "down to the sea and looked for the boat"), ("q", None)], "item_id string, text string")
    for name, d, b in (("full", docs, items), ("none", docs.limit(0), items.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        b.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()}
    assert {1, 4, None} <= set(got) and not {2, 3} & set(got) and got[4].n_tokens > 30_000
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    at = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, f"{tmp_path}/full")
        assert at.columns == docs.columns
    assert all(tuple(r)[2:] == (7,) * len(columns) for r in at.collect())


def test_names():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
