"""Operators on vectors and urls, components and the pipeline, against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.odd import documents, empty
from voltloom.llm import components, knn, registry, urls, vectors
from voltloom.llm.sql import SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = registry.QUERIES[name](spark, SF)
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in mine.collect()))) == sorted(map(str, theirs))


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    low = components.forest(600, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert [find(i) for i in range(600)] == low.tolist()
    got = {r["node"]: r["root"] for r in components.connected(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(600))


# vectors --------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node long, root string"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0),
            (7, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0], 1),
            (11, [-1.0, 0.0], 0), (12, [1.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 0), (13, [-0.0, 1.0], 0), (14, [0.0, 1.0], 0)]
    centre = rng.normal(size=16)
    rows += [(100 + i, [float(x) for x in centre + rng.normal(scale=0.08, size=16)], 2) for i in range(400)]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)


def brute_links(rows):
    def able(v, label, key):
        return key is not None and label is not None and v is not None and len(v) > 0 and all(
            x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    ok = [able(r["embedding"], r["label"], r["vec_id"]) for r in rows]
    out = [[] for _ in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if ok[i] and ok[j] and a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], float), np.array(b["embedding"], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    out[i].append(j)
                    out[j].append(i)
    return out


@pytest.mark.parametrize("tile,window", [(1024, 64), (50, 16)])
def test_near_vectors_of_odd_rows(spark, tile, window):
    rows = [r.asDict() for r in odd_vectors(spark).collect()]
    links = brute_links(rows)
    low = components.forest(len(rows), np.array([i for i, x in enumerate(links) for _ in x]),
                            np.array([j for x in links for j in x]))
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j]["vec_id"] for j in range(len(rows)) if low[j] == low[i] and rows[j]["vec_id"] is not None]
        comp = min(ids) if ids and r["vec_id"] is not None else None
        want.append((r["vec_id"], len(links[i]), comp, r["vec_id"] == comp))
    got = vectors.near_duplicates(odd_vectors(spark), tile=tile, window=window)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_windows_do_not_depend_on_the_number_of_ranges(spark):
    x = np.random.default_rng(1).normal(size=(30, 8)) * 0.3 + 1
    nodes = spark.createDataFrame([("a", i, 8, v.tolist()) for i, v in enumerate(x)],
                                  "label string, node long, dim int, vector array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in (1, 40):  # 60 rows of two passes: ranges of one or two rows
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            links = vectors.window_links(nodes, 0.9, 2, 8)
            found.append({(r["node"], r["root"]) for r in components.connected(links).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]


def test_dense_clusters_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=64))
    x = unit(np.sqrt(0.9) * centre + np.sqrt(0.1) * unit(rng.normal(size=(3000, 64))))  # cosines of 0.9 to each other
    side = unit(rng.normal(size=(300, 64)))
    side = unit(side - (side * x[:300]).sum(1, keepdims=True) * x[:300])
    x = np.concatenate([x, 0.983 * x[:300] + np.sqrt(1 - 0.983 ** 2) * side])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicates(df, window=2).collect()}
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    low = components.forest(len(x), a, b)
    assert len(a) >= 300 and all(got[i] == low[i] for i in range(len(x)))


def test_near_vectors_of_nothing(spark):
    assert vectors.near_duplicates(odd_vectors(spark).where("false")).count() == 0


# top-k ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("pivots,query_tile,slice_rows", [(32, 1024, 65536), (3, 2, 40), (1, 5, 7)])
def test_top_k_of_odd_rows(spark, pivots, query_tile, slice_rows):
    df = odd_vectors(spark).where("vec_id IS NULL OR vec_id <> 8")
    rows = [(r["vec_id"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in df.collect()
            if r["vec_id"] is not None and r["embedding"] is not None
            and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    want = []
    for q, a in rows:
        if q % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    got = knn.top_k(df, F.col("id") % 10 == 0, pivots=pivots, query_tile=query_tile, slice_rows=slice_rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    pivots = rng.normal(size=(12, 4)) * np.r_[1, 50].repeat(6)[:, None]
    cells = {i: pivots[i] + rng.normal(size=(9, 4)) for i in range(12)}
    far = {i: float(np.sqrt(((c - pivots[i]) ** 2).sum(1)).max()) for i, c in cells.items()}
    kept = set(knn.needed(pivots, far, {i: (9, r) for i, r in far.items()}, 5))
    assert len(kept) < 144
    every = [(c, x) for c, xs in cells.items() for x in xs]
    for q, xs in cells.items():
        for x in xs:
            best = sorted(every, key=lambda p: -float(x @ p[1]))[:6]
            assert all((q, c) in kept for c, _ in best)


def test_bounds_leave_out_all_rows_of_the_query():
    pivots, far = np.array([[100.0, 0], [1.0, 0], [0.9, 0]]), {0: 0.0, 1: 0.0, 2: 0.0}
    data = {0: (7, 0.0), 1: (1, 0.0), 2: (9, 0.0)}  # the first cell is the query's own id, seven times
    assert (0, 2) not in knn.needed(pivots, far, data, 5)
    assert (0, 2) in knn.needed(pivots, far, data, 5, repeats=7)


def test_top_k_of_a_repeated_id(spark):
    rows = [(0, [100.0, 0.0])] * 7 + [(1, [1.0, 0.0])] + [(i, [0.9, 0.0]) for i in range(2, 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("id") == 0)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_large_components_stay_exact():
    q, d = np.array([[1 << 30, -(1 << 30)]]), np.array([[1 << 30, 1], [1, 1 << 30]])
    s, f = np.full((1, 2), knn.LOWEST), np.zeros((1, 2), np.int64)
    knn.best_of(q, np.array([9]), d, np.array([1, 2]), 2, s, f)
    assert s.tolist() == [[(1 << 60) - (1 << 30), (1 << 30) - (1 << 60)]] and f.tolist() == [[1, 2]]
    with pytest.raises(OverflowError):
        knn.best_of(q << 20, np.array([9]), d << 20, np.array([1, 2]), 2, s, f)


def test_top_k_of_nothing(spark):
    assert knn.top_k(odd_vectors(spark).where("false"), F.col("id") % 10 == 0).count() == 0


# urls -----------------------------------------------------------------------------------------------------------

def test_candidates_are_all_rules_that_fit(spark):
    rules = (*urls.SITES, *urls.PATTERNS, urls.Rule("any", "block", ".*", r"/zz"))
    hosts = ["org", "example.org", "a.b.example.org", "notexample.org", "x.com", "ads.x.com", "m.ads-track.x.net",
             "badser.com", "a.ad", "casino.org", "é.org", "EXAMPLE.ORG", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/", "/de/x", "/zz", "/a/wp-login.php", "/wp-login"]
    rows = [(i, f"http://{h}{p}?a=/fr/#x") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(900, None), (901, ""), (902, "no scheme/fr/"), (903, "a://b://com/fr/"), (904, "://org/"), (905, "x://")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, host string")
    for r in urls.judge(df, rules=rules).collect():
        host, path = urls.parts(r["url"])
        want = urls.decide([x for x in rules if x.fits(host, path)] if host or path else [])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want)
    assert urls.judge(df.where("false")).count() == 0


def test_the_rarest_token_is_the_index():
    got = urls.index(urls.SITES, {"h:example": 90, "h:org": 50, "p:es": 3, "p:en": 70, "h:com": 10, "p:fr": 20, "p:de": 10})
    assert {t: [r.name for r in rs] for t, rs in got.items()} == {
        "h:org": ["org/", "example.org/en/1"], "p:es": ["example.org/es/"], "h:com": ["com/fr/", "com/de/"]}


# pipeline -------------------------------------------------------------------------------------------------------

def test_stages_do_what_their_operators_say(spark):
    docs = corpus_pipeline.table(spark, SF, "documents").where("doc_id < 300")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    clean = corpus_pipeline.toxic_text(spark, kept, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= kept.count()
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    found = corpus_pipeline.simhash.near_duplicates(docs)
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(
        r[0] for r in found.select("component_id").distinct().collect())
    mix = corpus_pipeline.source_mix(spark, docs, SF)
    assert mix.columns == docs.columns
    assert corpus_pipeline.encoded(spark, docs, SF).count() == docs.count()


def test_stages_take_odd_rows(spark):
    df = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns
        assert stage(spark, empty(spark), SF).count() == 0
    single = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()]
    assert len(single) == len(set(single)) and None not in single
    assert corpus_pipeline.encoded(spark, df, SF).count() == df.count()


def test_short_texts_of_a_language_stay(spark):
    docs = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    short = spark.createDataFrame([(-1, "Avec.", "fr"), (-2, "A.", "en"), (-3, "Q.", "en"), (-4, "12!", "en"), (-5, "Zx.", "fr")],
                                  "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs.unionByName(short), SF)
    assert {r["doc_id"] for r in kept.where("doc_id < 0").collect()} == {-1, -2, -3, -5}


def test_repeated_and_missing_ids_keep_one_row_of_a_group(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(1, one), (1, two), (1, one), (2, one), (None, three), (None, three), (None, two), (None, "only here a text stands")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())))
    assert got == sorted(map(str, [(1, one), (1, two), (None, three), (None, "only here a text stands")]))


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_top_k_of_more_dimensions_than_pivots(spark):
    """Two to three vectors of each of 1,200 dimensions; a query meets those of its own dimension."""
    rows = spark.range(1, 2801).selectExpr("id AS vec_id", "id % 1200 + 1 AS dim", "id % 7 - 3 AS x")
    df = rows.selectExpr("vec_id", "array_repeat(CAST(x AS DOUBLE), CAST(dim AS INT)) AS embedding")
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("id") % 50 == 0).collect())
    want = []
    for q in range(50, 2801, 50):
        others = [i for i in range(1, 2801) if i != q and i % 1200 == q % 1200]
        scored = sorted((-256 * 256 * (q % 1200 + 1) * (q % 7 - 3) * (i % 7 - 3), i) for i in others)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
