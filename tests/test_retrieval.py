"""Lexical search with positions, phrases and stems; page ranks around seeds; fused lists."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.functions.stemming import porter
from corpusweave.operators import graph_rank, lexical
from corpusweave.plans import search

# Published examples of the Porter stemmer.
STEMS = (
    "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat"
    " troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky"
    " relational:relat conditional:condit rational:ration digitizer:digit radicalli:radic vietnamization:vietnam operator:oper feudalism:feudal"
    " decisiveness:decis formaliti:formal sensibiliti:sensibl triplicate:triplic formative:form electriciti:electr goodness:good revival:reviv"
    " gyroscopic:gyroscop irritant:irrit replacement:replac adoption:adopt communism:commun effective:effect probate:probat rate:rate"
    " cease:ceas controll:control roll:roll"
)


def test_stems():
    pairs = [x.split(":") for x in STEMS.split()]
    assert [porter(a) for a, _ in pairs] == [b for _, b in pairs]
    assert (porter("Café"), porter("as"), porter("r2d2s"), porter("日本"), porter("")) == ("cafe", "as", "r2d2s", "日本", "")


TEXTS = [
    (1, "online vector quantization for nearest neighbor search"), (2, "a paper about cats"), (3, "state of the art, the art of the state"),
    (4, "state-of-the-art vectors"), (5, None), (6, "..."), (7, "art art art of the of"), (8, "vectors vector " * 30), (8, "cats"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i if k < 8 else 9, t) for k, (i, t) in enumerate(TEXTS)], "vector_id long, text string").repartition(3)


def analysed(text, stem):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return [porter(w) for w in words] if stem else words


def brute(rows, queries, stem):
    docs = {i: analysed(t, stem) for i, t in rows}
    used = [d for d in docs.values() if d]
    mean, out = sum(map(len, used)) / len(used), {}
    for q, text in queries:
        for token in (text or "").split():
            want = analysed(token, stem)
            if not want:
                continue
            tf = {i: sum(d[k : k + len(want)] == want for k in range(len(d))) for i, d in docs.items()}
            tf = {i: n for i, n in tf.items() if n}
            idf = max(1e-6, math.log((len(used) - len(tf) + 0.5) / (len(tf) + 0.5)))
            for i, n in tf.items():
                out[q, i] = out.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    return out


@pytest.mark.parametrize("stemmer", [None, porter])
def test_phrases(spark, chunks, stemmer, tmp_path):
    queries = [(1, "vector quantization OR (cats)"), (2, "()"), (3, "state-of-the-art"), (4, 'say "art-of" art  art'), (5, ""), (6, None), (7, "the-state"), (8, "vectors")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    phrases = lexical.query_phrases(asked, stemmer=stemmer)
    posted = lexical.positional_postings(chunks, stemmer=stemmer)
    n, mean = lexical.sizes(chunks)
    got = {(r.query_id, r.vector_id): r.score for r in lexical.phrase_bm25(phrases, posted, n, mean).collect()}
    rows = [(i if k < 8 else 9, t) for k, (i, t) in enumerate(TEXTS)]
    want = brute(rows, queries, stemmer is not None)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    for k in (1, 2, 20):
        top = [(r.query_id, r.vector_id, r["rank"]) for r in lexical.top_matches(asked, chunks, k, stemmer).collect()]
        best = {q: sorted(((-round(s, 6), i) for (p, i), s in want.items() if p == q and round(s, 6) > 0))[:k] for q, _ in queries}
        assert sorted(top) == sorted((q, i, n + 1) for q, x in best.items() for n, (_, i) in enumerate(x))
    assert lexical.top_matches(asked.limit(0), chunks, 3).count() == 0 and lexical.top_matches(asked, chunks.limit(0), 3).count() == 0
    # A token with hyphens is found as a phrase only: text 7 has all its words, none in that order.
    assert {i for q, i in got if q == 3} == {3, 4} and not [q for q, _ in got if q in (2, 5, 6)]
    assert max((s, -i) for (q, i), s in got.items() if q == 1)[1] == -1
    # Stored postings give the same, from the folders of the asked terms alone.
    path = str(tmp_path / "postings")
    lexical.write_postings(posted, path, folders=16)
    read = lexical.read_postings(spark, path, phrases.filter("query_id = 3"), folders=16)
    assert {r.term for r in read.select("term").distinct().collect()} == set(analysed("state of the art", stemmer is not None))
    again = lexical.phrase_bm25(phrases.filter("query_id = 3"), read, n, mean).collect()
    assert {(r.query_id, r.vector_id): r.score for r in again} == {k: v for k, v in got.items() if k[0] == 3}


def test_only_asked_words_are_grouped(spark, chunks):
    terms = spark.createDataFrame([("art",), ("art",)], "term string")
    whole = {(r.vector_id, r.tf, r.dl) for r in lexical.postings(chunks).filter("term = 'art'").collect()}
    assert {(r.vector_id, r.tf, r.dl) for r in lexical.postings(chunks, terms=terms).collect()} == whole
    listed = search.lexical_list(spark.createDataFrame([(1, "art cats")], "query_id long, query string"), chunks, 2, chunks.filter("vector_id < 4"))
    assert {r.vector_id for r in listed.collect()} <= {1, 2, 3}


def shuffled_rows(plan):
    """Rows that a plan's exchanges wrote when it ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if "QueryStage" in name:
        return shuffled_rows(plan.plan())
    metric = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    return (metric.get().value() if metric.isDefined() else 0) + sum(shuffled_rows(below.apply(j)) for j in range(below.size()))


def test_words_of_queries_make_no_pairs(spark):
    """Every query asks a word that all items hold: what moves are the best items of a query and task."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["common"] + [f"w{x}" for x in rng.integers(0, 40, 6)] + ["x"] * (i % 3)) if i % 97 else None) for i in range(1200)]
    asked = [(10 * q, f"Common, w{q % 40} w{q * 7 % 40} common") for q in range(60)] + [(7, "common"), (8, "nowhere"), (9, None)]
    chunks, k = spark.createDataFrame(rows, "vector_id long, text string").repartition(6), 4
    listed = search.lexical_list(spark.createDataFrame(asked, "query_id long, query string"), chunks, k)
    got = sorted((r.query_id, r["rank"], r.vector_id, r.score) for r in listed.collect())
    assert shuffled_rows(listed._jdf.queryExecution().executedPlan()) <= len(asked) * k * 6
    scores = brute(rows, [(q, " ".join(dict.fromkeys(analysed(t, False)))) for q, t in asked], False)
    want = []
    for q, _ in asked:  # scores of 0 count, as in SQL
        best = sorted((-round(s, 6), i) for (p, i), s in scores.items() if p == q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert [x[:3] for x in got] == sorted(x[:3] for x in want) and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=1.1e-6)


def test_floors_leave_out_what_cannot_win():
    """Scores above a floor are those of brute force; where a rare word decides, the frequent ones' items aren't scored."""
    rng = np.random.default_rng(2)
    n_items, n_phrases, n_queries, k = 500, 80, 60, 5
    held = rng.random((n_items, n_phrases)) < np.where(np.arange(n_phrases) < 20, 0.7, 0.03)
    part = rng.random((n_items, n_phrases)) * np.where(np.arange(n_phrases) < 20, 0.1, 3.0) * held
    wants = rng.integers(0, 3, (n_queries, n_phrases)) * (rng.random((n_queries, n_phrases)) < 0.1)
    wants[:, 0] = 1
    asked = lexical._Asked([([f"t{p}"], [(q, int(wants[q, p])) for q in range(n_queries) if wants[q, p]]) for p in range(n_phrases)])
    item, phrase = np.nonzero(held)
    whole = np.round(wants @ part.T, 6)
    kth = np.sort(whole)[:, -k]
    for floor in (np.zeros(n_queries), kth.copy(), np.where(np.arange(n_queries) % 2, kth, 0.0)):
        before, got = floor.copy(), {}
        for q, d, s in asked.matches(item, phrase, part[item, phrase], n_items, floor, k):
            got |= {(int(a), int(b)): c for a, b, c in zip(q, d, s)}
        best = {(q, d) for q in range(n_queries) for d in range(n_items) if whole[q, d] >= kth[q] and whole[q, d] > 0}
        assert best <= got.keys() and all(abs(whole[x] - s) < 1.1e-6 for x, s in got.items())
        assert (floor >= before).all() and (floor <= kth + 1.1e-6).all()
        if before.all():
            assert len(got) < len(best) + n_queries


def read_once(spark, stemmer):
    """Rows of texts read by a search of 40 items, and what it found."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    texts = [f"running runs {'vector' if i % 3 else 'vectors'} w{i}" for i in range(40)]
    rows = [(f"c{i:02}", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "vector_id string, text string").repartition(2).mapInPandas(counted, "vector_id string, text string")
    asked = spark.createDataFrame([(1, "running-runs w7"), (2, "vector vectors")], "query_id long, query string")
    found = lexical.top_matches(asked, chunks, 3, stemmer).collect()
    return seen.value, {(r.query_id, r["rank"], r.vector_id) for r in found}


def test_phrase_search_reads_texts_once(spark):
    rows, found = read_once(spark, None)
    assert rows == 40 and found == {(1, 1, "c07"), (1, 2, "c00"), (1, 3, "c01"), (2, 1, "c00"), (2, 2, "c03"), (2, 3, "c06")}


def test_stemmed_search_reads_texts_once(spark):
    rows, found = read_once(spark, porter)
    assert rows == 40 and found == {(1, 1, "c07"), (1, 2, "c00"), (1, 3, "c01"), (2, 1, "c00"), (2, 2, "c01"), (2, 3, "c02")}


def vectors_of(rows):
    return {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows}


def brute_rank(seeds, rows, links, neighbors, damping, rounds):
    """The rounds over a plain adjacency of one query."""
    unit, doc, adj = vectors_of(rows), {i: d for i, d, _ in rows}, collections.defaultdict(lambda: collections.defaultdict(float))

    def edge(a, b, w):
        if a != b and w > 0:
            adj[a][b] += w
            adj[b][a] += w

    start = {i: max(0.0, c) for i, c in seeds}
    total = sum(start.values())
    if total <= 0:
        return []
    for s, _ in seeds:
        if s in unit:
            near = sorted(unit, key=lambda i: (-round(float(unit[s] @ unit[i]), 6), i))[: neighbors + 1]
            for i in near:
                edge(s, i, round(float(unit[s] @ unit[i]), 6))
    nodes = sorted(adj)
    for d, targets in links:
        for t in targets or []:
            for a in nodes:
                for b in nodes:
                    if doc[a] == d and doc[b] == t:
                        edge(a, b, 1.0)
    p = {n: start.get(n, 0.0) / total for n in nodes}
    r = dict(p)
    for _ in range(rounds):
        new = {n: (1 - damping) * p[n] for n in nodes}
        for j in nodes:
            for i, w in adj[j].items():
                new[i] += damping * r[j] * w / sum(adj[j].values())
        whole = sum(new.values())
        r = {n: x / whole if whole else x for n, x in new.items()}
    return sorted(((round(x, 9), n) for n, x in r.items()), key=lambda t: (-t[0], t[1]))


def test_page_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 3, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, 20, None)]
    links = [(0, [3, 3, 0]), (3, [0]), (5, [6, 99]), (7, None), (8, []), (9, [2])]
    seeds = {1: [(0, 0.9), (1, 0.5), (10, 0.4), (16, 0.2)], 2: [(60, 0.7), (27, 0.3), (7, -0.4)], 3: [(5, -0.1)], 4: [(29, 1.0)]}
    asked = spark.createDataFrame([(q, i, c) for q, x in seeds.items() for i, c in x], "query_id long, vector_id long, cos double")
    chunks = spark.createDataFrame(rows, "vector_id long, doc_id long, embedding array<double>").repartition(4)
    linked = spark.createDataFrame(links, "doc_id long, links array<long>")
    for neighbors, damping in ((4, 0.5), (1, 0.85)):
        got = collections.defaultdict(list)
        for r in graph_rank.ppr_rank(asked, chunks, linked, neighbors, damping).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.score, r.vector_id))
        have = [x for x in rows if x[2] is not None]
        for q, x in seeds.items():
            want = brute_rank(x, have, links, neighbors, damping, 15)
            assert [i for _, i in got[q]] == [i for _, i in want] or np.allclose([s for s, _ in got[q]], [s for s, _ in want], atol=2e-9)
            assert {i for _, i in got[q]} == {i for _, i in want} and np.allclose(sorted(s for s, _ in got[q]), sorted(s for s, _ in want), atol=2e-9)
    assert graph_rank.ppr_rank(asked.limit(0), chunks, linked).count() == 0


def test_multi_hop_and_links_lift(spark):
    # 1 is the seed; 2 is near it, 3 is only near 2 (a seed of less weight), 4 hangs on a link of documents; 5 and 6 are elsewhere.
    angle = lambda a: [math.cos(a), math.sin(a), 0.0]
    rows = [(1, 1, angle(0.0)), (2, 2, angle(0.5)), (3, 3, angle(1.0)), (5, 5, [0.0, 0.0, 1.0]), (6, 6, [0.0, -0.1, 1.0])]
    chunks = spark.createDataFrame(rows, "vector_id long, doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.2), (0, 5, 0.05)], "query_id long, vector_id long, cos double")
    none = spark.createDataFrame([], "doc_id long, links array<long>")
    rank = {r.vector_id: r["rank"] for r in graph_rank.ppr_rank(asked, chunks, none, 2).collect()}
    assert rank[3] < rank[6] and rank[1] == 1
    linked = spark.createDataFrame([(1, [6])], "doc_id long, links array<long>")
    assert {r.vector_id: r["rank"] for r in graph_rank.ppr_rank(asked, chunks, linked, 2).collect()}[6] < rank[6]


def test_fused_lists_lose_no_hit(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i // 2, "method", None, f"w{i % 7} w{i % 11} common" if i % 5 else None, [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    chunks = spark.createDataFrame(rows, "vector_id long, doc_id long, section_type string, embedded_at timestamp, text string, embedding array<double>")
    queries = spark.createDataFrame([(0, "w1 w3", rows[0][5]), (1, "()", rows[9][5])], "query_id long, query string, embedding array<double>")
    links = spark.createDataFrame([(0, [5])], "doc_id long, links array<long>")
    as_of = F.lit("2024-01-31").cast("timestamp")
    hits = search.fused_lists(queries, chunks, links, 5, -1.0, as_of)
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {0: 5, 1: 5}
    places = search.grouped(hits, chunks).collect()
    assert sum(len(r.chunk_ids) for r in places) == 10
    allowed = chunks.filter("vector_id < 6").select("vector_id")
    assert {r.vector_id for r in search.fused_lists(queries, chunks, links, 50, -1.0, as_of, allowed).collect()} == set(range(6))
    assert search.fused_lists(queries, chunks, None, 5, -1.0, as_of, allowed.limit(0)).count() == 0
