"""Url filter, mixing, exact search, components, and the pipeline."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest

from evalframe.llm import components as CC
from evalframe.llm import knn, mixing, queries, url_filter
from tests.oracle import assert_same, connection

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal_to_sql(spark, name):
    assert_same(spark, connection(), queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for n, m in ((300, 180), (40, 60), (200, 199)):
        edges = [(i, i + 1) for i in range(m)] if m == 199 else [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)]
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        got = CC.components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")).collect()
        assert {r.node: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "http://a.net/x", '<link href="http://b.example.org/es/1" rel=canonical>', "block"),
    (2, "http://B.example.org/es/1", "", "block"),
    (3, "https://c.net/q?x=1#f", "<META http-equiv='refresh' content='0; url=/r'>", "block"),
    (4, "https://c.net/r", "<link rel='canonical' href='http://a.net/x'>", "block"),
    (5, None, None, "allow"),
    (6, "nohost", None, "allow"),
    (7, "http://z.net/", "<link rel=canonical href=http://foo.org/en/a>", "allow"),
    (8, "http://y.net/d/e?a", "<link rel=canonical href=f>", "block"),
    (9, "http://y.net/d/f", "<link rel=canonical href=//x.com/de/1>", "block"),
    (9, "http://y.net/d/f", "<link rel=canonical href=//x.com/de/1>", "block"),
    (10, "http://w.net", "<link rel=canonical href='http://z.net/'><meta http-equiv=refresh content='1;url=http://v.com/de/1'>", "allow"),
    (11, "ftp://x.example.org/en/12?u", "", "block"),
    (12, "http://x.com/fr/?q", "", "allow"),
]


def test_redirect_equivalence(spark):
    rows = spark.createDataFrame([(*p[:3], "r", "h") for p in PAGES], "page_id long, url string, html string, rule string, host string")
    out = url_filter.judge_urls(rows)
    assert sorted((r.page_id, r.verdict) for r in out.collect()) == sorted((p[0], p[3]) for p in PAGES)
    extra = spark.createDataFrame([("http://q.net/", "http://example.org/es/9"), (None, "http://a.net/")], "from_url string, to_url string")
    one = spark.createDataFrame([(1, "http://q.net/", "")], "page_id long, url string, html string")
    assert url_filter.judge_urls(one, extra).first().verdict == "block"
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


MIRRORED = [
    (1, "http://www.a.net:80/x/index.html?utm_source=feed#top", "<article>one</article>", "block"),
    (2, "https://a.net/x/", "", "block"),
    (3, "https://m.a.net/x?ref=q", None, "block"),
    (4, "https://a.net/x?page=2", "", "allow"),  # another page
    (5, "https://b.com/de/7", "<p><ARTICLE class=x>one</ARTICLE>", "block"),
    (6, "https://c.net/y", "<article>two</article>", "allow"),
    (7, "https://d.com/de/7", "<article>two</article>", "block"),  # its own rule
    (8, "https://d.com/fr/7", "<article>two</article>", "allow"),  # takes precedence for 6
    (9, "https://e.net/z", "<article> </article>", "allow"),
    (10, "https://f.com/de/8", "<article> </article>", "block"),
    (11, "https://example.org:443/es/1", "", "block"),  # no host of a rule, but an address of one
    (12, "https://www.example.org/es/1", "", "block"),
    (13, "ftp://a.net/x", "", "allow"),
]


def test_aliases_decide(spark, monkeypatch):
    rows = spark.createDataFrame([p[:3] for p in MIRRORED], "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge_urls(rows).collect()) == [(p[0], p[3]) for p in MIRRORED]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    with_graph = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    nothing = spark.createDataFrame([], "a string, b string")
    monkeypatch.setattr(url_filter, "alias_edges", lambda pages: nothing)
    without = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    changed = [k for k in with_graph if with_graph[k] != without[k]]
    assert changed and all(with_graph[k] == (None, "block") for k in changed)


def brute_mix(docs, epochs=3):
    """Capacities and budgets by repeated water-filling over a dict tree."""
    leaves = {}
    for lang, source, n in docs:
        leaves[lang, source] = leaves.get((lang, source), 0) + n

    def fill(given, children):
        left, open_, got = given, dict(children), {}
        while open_:
            w = sum(x[1] for x in open_.values())
            full = {k: c for k, (c, x) in open_.items() if x and c * w <= left * x}
            if not full:
                got |= {k: min(c, math.floor(left * x / w)) for k, (c, x) in open_.items()} if w else {k: 0 for k in open_}
                break
            for k, c in full.items():
                got[k] = c
                left -= c
                del open_[k]
        return got

    langs = {}
    for (lang, _), n in leaves.items():
        langs[lang] = langs.get(lang, 0) + n
    top = fill(sum(leaves.values()), {k: (n * epochs, math.isqrt(n)) for k, n in langs.items()})
    return {k: v for lang in langs for k, v in fill(top[lang], {x: (n * epochs, math.isqrt(n)) for x, n in leaves.items() if x[0] == lang}).items()}, leaves


def test_budgets_and_prefixes(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en"] * 6 + ["de", None]), rng.choice(["a"] * 5 + ["b", "c", None]), 0) for i in range(400)]
    rows += [rows[0], (None, "x y", "en", "a", 0), (None, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")
    out = mixing.mix(docs).collect()
    want, leaves = brute_mix([(r[2] or "", r[3] or "", len((r[1] or "").split())) for r in rows])
    for leaf, budget in want.items():
        own = [r for r in out if (r.lang, r.source) == leaf]
        taken, longest = sum(r.n_tokens for r in own), max([r.n_tokens for r in own], default=0)
        assert all(r.budget == budget for r in own)
        assert budget <= taken < budget + max(1, 2 * longest) or not leaves[leaf]
        for e in range(budget // leaves[leaf] if leaves[leaf] else 1):  # whole epochs hold every document
            assert sum(r.epoch == e for r in own) == sum((r[2] or "", r[3] or "") == leaf for r in rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mixed_documents(docs).count() == len(out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_weights_go_down_the_tree(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 2 else "de", "s", 0) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([("web", "en", None, 3), ("web", "de", None, 1)], "domain string, lang string, source string, weight long")
    out = mixing.mix(docs, total=1000, weights=weights).groupBy("lang").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in out} == {"en": 750, "de": 250}


def test_rows_of_two_leaves_with_equal_id_and_text_stay(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "t"), (1, "a b", "en", "t"), (2, "c d", "en", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("web", "en", "s", 0), ("web", "en", "t", 1), ("web", "en", "u", 0)], "domain string, lang string, source string, weight long")
    domains = spark.createDataFrame([("t", "web"), ("s", "web"), ("u", "web")], "source string, domain string")
    for extra in ({}, {"domains": domains}):
        out = mixing.mixed_documents(docs, total=4, epochs=1, weights=weights, **extra)
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == [(1, "a b", "en", "t")] * 2


def test_shortages_go_to_siblings_before_ancestors(spark):
    """Three domains: one cannot take its share, and in another a language cannot; each shortage stays as low as it can."""
    size = {("a", "en", "s1"): 100, ("b", "en", "s2"): 600, ("b", "de", "s3"): 20, ("c", "en", "s4"): 1000}
    rows = [(1000 * n + i, "w", lang, source) for n, ((_, lang, source), k) in enumerate(size.items()) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domains = spark.createDataFrame([(s, d) for d, _, s in size], "source string, domain string")
    weights = spark.createDataFrame([("a", None, None, 2), ("b", None, None, 1), ("c", None, None, 1), ("b", "de", None, 1), ("b", "en", None, 1)], "domain string, lang string, source string, weight long")
    out = {(r.domain, r.lang): r.budget for r in mixing.mix(docs, total=1000, epochs=1, weights=weights, domains=domains).groupBy("domain", "lang").agg({"budget": "max"}).withColumnRenamed("max(budget)", "budget").collect()}
    # a takes its 100 of 500; b and c share the rest, 450 each; in b, German takes its 20 of 225
    assert out == {("a", "en"): 100, ("b", "de"): 20, ("b", "en"): 430, ("c", "en"): 450}


@pytest.mark.parametrize("digits", [3, 1])
def test_prefixes_equal_a_sorted_leaf(spark, monkeypatch, digits):
    """Buckets taken whole and in part give what sorting the leaf's documents gives."""
    import hashlib

    monkeypatch.setattr(mixing, "DIGITS", digits)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), "en", "s") for i in range(700)] + [(5, "w w", "en", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for total in (0, 1, 137, 1500, 2900):
        got = sorted(r.doc_id for r in mixing.mix(docs, total=total).collect())
        keyed = sorted((hashlib.sha256(f"7|0|{i}|{hashlib.sha256(t.encode()).hexdigest()}".encode()).hexdigest(), i, len(t.split())) for i, t, *_ in rows)
        want, seen, k = [], 0, 0
        while k < len(keyed):
            same = [x for x in keyed if x[0] == keyed[k][0]]
            seen += sum(x[2] for x in same)
            want += [x[1] for x in same if seen - x[2] < total]
            k += len(same)
        assert got == sorted(want)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _d long, _n int, _k string, _key string, _md5 string, _l string, _s string, _sha string, _domain string, _copy int, __d int, rank int, label string, probe boolean, base long, rest long, gone long, h string"


def test_columns_with_names_that_operators_use(spark):
    from evalframe.llm import near_dup, outliers, packing, quality_model, secret_scan, suffix_dedup

    texts = [" ".join(f"word{(7 * i + j) % 90}" for j in range(40)) for i in range(8)] * 2 + [None, ""]
    rows = [(i % 9, t, "en", "s", 1, 1, 2, "k", "key", "m", "l", "s", "h", "d", 3, 4, 5, "x", True, 6, 7, 8, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHING)
    for out in (near_dup.deduplicated(docs), outliers.accepted(docs), mixing.mixed_documents(docs), secret_scan.redact(docs)):
        assert out.schema == docs.schema and out.count() >= 0
    for out in (near_dup.deduplicated(docs.limit(0)), outliers.accepted(docs.limit(0)), mixing.mixed_documents(docs.limit(0)), secret_scan.redact(docs.limit(0))):
        assert out.schema == docs.schema and out.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (packing.pack(docs), near_dup.classes(docs), outliers.judge(docs), secret_scan.scan(docs), suffix_dedup.remove_repeats(docs), quality_model.score(docs, labels)):
        assert out.count() == len(rows)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and extra columns pass each stage; so does a table without rows."""
    import corpus_pipeline as P

    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 99999)}" for _ in range(30_000))
    texts = [" ".join(f"v{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(20)]
    every = [None, "", " ", long, *texts, texts[0], texts[0] + " more", "password = abcdefgh12 " + texts[1]]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", len(t or ""), i) for i, t in enumerate(every)]
    for name, some in (("odd", [*rows, rows[4]]), ("none", [])):
        top = tmp_path / name
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, _d long").coalesce(2)
        docs.write.parquet(str(top / "documents.parquet"))
        out = P.run(spark, str(top))
        ids = {r.doc_id for r in out.collect()}
        if not some:
            assert not ids
            continue
        assert ids <= set(range(3, len(every))) and 3 in ids  # without words nothing stays; the long text does
        assert len({i for i, t in enumerate(every) if t == texts[0]} & ids) <= 1
        assert out.groupBy("doc_id", "piece").count().where("piece > 0").count() > 0


def test_pipeline_stages_equal_brute_force(spark):
    """What each stage keeps, by plain Python over the smallest tables, where its operator's own tests define the rest."""
    import corpus_pipeline as P
    from tests.llm.test_text_ops import base_spans, classes_of, counts_of

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    ids = {r.doc_id for r in P.quality_rules(spark, docs, DATA).select("doc_id").collect()}
    fine = set()
    for i, r in rows.items():
        n = counts_of(r.text)
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0]:
            fine.add(i)
    assert ids <= fine and len(ids) > 0.85 * len(fine)
    own = sorted(ids)
    found = classes_of([rows[i].text for i in own])
    one = P.near_duplicates(spark, docs.where(docs["doc_id"].isin(own)), DATA)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {own[k] for k in set(found.values())}
    marked = {r.doc_id: r.text for r in P.secrets(spark, docs, DATA).collect()}
    for i, r in rows.items():
        assert (marked[i] == r.text) or "<" in marked[i]
        assert not base_spans(marked[i] or "")
        assert bool(base_spans(r.text or "")) <= (marked[i] != r.text)


def test_pipeline_mixes_by_the_tokenizer(spark):
    import corpus_pipeline as P
    from evalframe.llm.tokens import token_count, tokenizer, default_path

    texts = ["x" * 4000, "one two", None, ""]
    one = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in one.select("doc_id", token_count(one["text"]).alias("n")).collect()}
    assert counts == {i: len(tokenizer(default_path()).encode([t or ""])[0]) // 4 for i, t in enumerate(texts)}
    # by words both leaves are alike, and each document comes once
    rows = [(i, "abcdefgh" * 40, "en", "unspaced", 320) for i in range(30)] + [(100 + i, "a", "en", "short", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.source_mixing(spark, docs, DATA).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in out}["short"] == 90


def test_exact_search_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.integers(-3, 3, 4) / 1000]) for i in r.integers(0, 400, 300)]
    rows += [(100, [0.1] * 4)] * 3 + [(200, None), (300, [float("nan")] * 4), (100, [None, 1.0, 1.0, 1.0]), (100, [1e5, 1e5, 3e4, 1.0]), (7, [1e5, 1e5, 3e4, -1.0]), (None, [1.0] * 4), (0, [1.0] * 3), (3, [1.0] * 3), (500, [])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, cell int, v int")
    got = sorted(tuple(x) for x in knn.top_k(table, k=5, pivots=8, block_rows=20).collect())
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(known):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(known) if b != a and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert knn.top_k(table.limit(0)).count() == 0


def test_exact_search_of_a_group_of_many_queries(spark):
    """Half of all vectors are alike, so one group has many blocks and many chunks of queries."""
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in (r.integers(-3, 3, 4) if i % 2 else [2, 2, 2, i % 3])]) for i in range(240)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in knn.top_k(table, k=4, every=2, pivots=5, block_rows=16, chunk_rows=8).collect())
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = [(i, n + 1, j, -s) for i, q in known if i % 2 == 0 for n, (s, j) in enumerate(sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in known if j != i)[:4])]
    assert got == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in P.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "secrets":
            from evalframe.llm.secret_scan import scan

            assert scan(docs).where("n_assign + n_access + n_hex > 0").count() == 0
    assert sizes[0] >= sizes[1] == sizes[2] > 0
    assert P.run(spark, DATA).count() == sizes[-1]


def test_nothing_else_imports_the_subpackage():
    top = Path(__file__).resolve().parents[2]
    for p in (top / "evalframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()


def test_vectors_are_shuffled_once_for_each_chunk_of_queries(spark):
    # 300 queries of 30 groups are all sent to the cells 0 to 29: three chunks of at most 128 for each cell
    sent = spark.range(9000).selectExpr("1L AS dim", "id % 30 AS cell", "id DIV 30 AS q")
    summary = spark.range(40).selectExpr("1L AS dim", "id AS cell", "id + 1 AS blocks", "0.5D AS radius")
    got = {r.cell: (r.blocks, r.chunks) for r in knn._sizes(sent, summary, 128).collect()}
    assert got == {c: (c + 1, 3) for c in range(30)}
