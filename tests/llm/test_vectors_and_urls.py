"""Vector searches and URL verdicts against brute force, and on odd rows; the whole pipeline."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlens.llm import covertree, topk, urls
from .conftest import ODD

VECTORS = "vec_id long, embedding array<float>, label string"
BAD = [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 0.0]), (903, [float("nan"), 1.0, 0.0]), (904, [float("inf"), 1.0, 0.0]), (905, []),
       (None, [1.0, 0.0, 0.0]), (906, [1.0, 2.0])]


def vectors(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], VECTORS)
    for name in ("data", "least", "n", "cell", "part", "score", "rank", "id", "vector"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def clusters(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(n // 8, dim))
    rows = middle[rng.integers(0, len(middle), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.2, 1.0], size=(n, 1))
    rows[: n // 3] = rows[0]  # a third are copies
    return [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [covertree.BLOCK, 60])
def test_cosine_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "CENTRES", 128 if block > 60 else 20)
    rows = clusters()
    out = covertree.near_duplicates(vectors(spark, rows + BAD)).toPandas()
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= covertree.LEAST
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    good = out[out.vec_id < 900].sort_values("vec_id")
    assert good.n_links.tolist() == near.sum(axis=1).tolist() and good.component_id.tolist() == label.tolist()
    assert good.kept.tolist() == (label == np.arange(len(x))).tolist()
    odd = out[~(out.vec_id < 900)]
    assert len(odd) == len(BAD) and (odd.n_links == 0).all()
    assert (odd[odd.vec_id.notna()].component_id == odd[odd.vec_id.notna()].vec_id).all() and not odd[odd.vec_id.isna()].kept.any()
    for nothing in ([], BAD[:2]):
        assert covertree.near_duplicates(vectors(spark, nothing)).count() == len(nothing)


def naive_top(rows, k=10, every=7):
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows}
    out = []
    for q in whole:
        if q % every == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_blocks_are_not_copied_for_every_pair(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 60)
    rows = clusters()
    expected = sorted(map(tuple, covertree.near_duplicates(vectors(spark, rows)).collect()))
    plans, staged = [], covertree.stage_parts

    def spied(parts, name):
        return staged((plans.append(df._jdf.queryExecution().executedPlan().toString()) or df for df in parts), name)

    monkeypatch.setattr(covertree, "stage_parts", spied)
    monkeypatch.setattr(covertree, "HELD", 5_000)
    before = spark.conf.get(covertree._ROWS)
    assert sorted(map(tuple, covertree.near_duplicates(vectors(spark, rows)).collect())) == expected
    assert len(plans) > 3 and not any("Exchange" in p or "Join" in p for p in plans) and spark.conf.get(covertree._ROWS) == before
    places = [(c, p) for c in range(-2, 3) for p in range(4)]
    assert all(covertree._meet(a, b) != covertree._meet(b, a) for a in places for b in places if a != b)
    doubles = spark.createDataFrame([(i, [1.0, i * 1e-12]) for i in range(5)] + [(9, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in covertree.near_duplicates(doubles).collect()) == [(i, 4, 0) for i in range(5)] + [(9, 0, 9)]


def test_query_blocks_are_not_sent_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    found = topk.search(vectors(spark, clusters(300, 24)), F.col("vec_id") % 7 == 0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    data = np.array([[1.0, -32767.0], [0.0, 32767.0]])
    assert len(topk._narrow(data)) == 8 and (topk._wide(topk._narrow(data), 2, 2) == data).all()
    assert len(topk._narrow(data * 2)) == 32 and (topk._wide(topk._narrow(data * 2), 2, 2) == data * 2).all()


@pytest.mark.parametrize("sizes", [(topk.CANDIDATES, topk.QUERIES), (50, 9)])
def test_top_k_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    rows = clusters(300, 24)
    asked = F.col("vec_id") % 7 == 0
    got = sorted(map(tuple, topk.search(vectors(spark, rows + BAD[:1] + BAD[2:5] + [BAD[6]]), asked).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == naive_top(rows)
    few = rows[:3]
    assert sorted(map(tuple, topk.search(vectors(spark, few), asked).collect())) == naive_top(few)
    assert topk.search(vectors(spark, []), asked).count() == 0 and topk.search(vectors(spark, rows), F.lit(False)).count() == 0
    repeated = topk.search(vectors(spark, rows[200:210] + rows[200:210]), F.col("vec_id") == 203)
    assert [r["rank"] for r in repeated.orderBy("rank").collect()] == list(range(1, 10))


def test_top_k_of_large_components(spark):
    rows = [(i, [3e7 * (i + 1), 1e8, -5e9 * i]) for i in range(8)]
    got = sorted(map(tuple, topk.search(vectors(spark, rows), F.col("vec_id") % 7 == 0).collect()))
    assert got == naive_top(rows)


# ---- URLs ----------------------------------------------------------------------------------------


def naive_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def naive_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def test_url_verdicts(spark, folder):
    more = ["http://WWW.Example.com/en/x", "https://a.www.example.com/en/?q", "http://example.com/en", "http://x.net/es/", "http://net/fr/a#b", "http://notnet/es/", None, "", "no scheme",
            "x://y://z.com/a", "http://com/", "http://a.com", "http://a.com?x://b.net/es/", "http://é.net/fr/\n", "http://u:p@h.com:80/"]
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").union(
        spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(more)] + [(10_000, more[0])], "page_id long, url string"))
    pages = pages.selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS rule", "'x' AS score")
    out = urls.judge(pages, urls.labelled_by_rules(pages)).join(pages.select("page_id", "url").distinct(), "page_id").collect()
    assert len(out) == pages.count()
    for row in out:
        host, path = naive_parts(row["url"])
        rule = naive_rule(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule.name if rule else None), row["url"]
        assert row["verdict"] == rule.verdict if rule else row["verdict"] in ("allow", "block")
    none = pages.limit(0)
    assert urls.judge(none, urls.labelled_by_rules(none)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, urls.labelled_by_rules(none)).where("rule IS NULL").collect()} == {"allow"}


def test_regression_learns_held_out_addresses():
    rng = np.random.default_rng(1)
    words = ["pills", "casino", "garden", "school"]
    rows = [(f"{words[k]}{rng.integers(1000)}.org", f"/{rng.integers(99)}") for k in rng.integers(0, 4, 400)]
    block = [h.startswith(("pills", "casino")) for h, _ in rows]
    model = urls.fit([h for h, _ in rows[:300]], [p for _, p in rows[:300]], block[:300])
    said = model.scores([h for h, _ in rows[300:]], [p for _, p in rows[300:]]) >= 0.5
    assert (said == np.array(block[300:])).mean() > 0.95
    assert (urls.fit([], [], []).scores(["", "a"], ["", "/"]) < 0.5).all()


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, documents, folder):
    import corpus_pipeline
    docs = documents([*ODD, (20, "mail me at a.b@c.org for the words of this text")])
    for name, step in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = step(spark, docs, folder)
        assert docs.columns == columns, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted(r.doc_id or 0 for r in pieces.where("piece = 0").collect()) == sorted(r.doc_id or 0 for r in docs.collect())
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = documents([])
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0
