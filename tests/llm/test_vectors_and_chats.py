"""The operators on vectors and on conversations."""

import hashlib
import random

import numpy as np
import pytest

from geoframe.llm import chat_format, embedding_dedup, topk_search
from geoframe.operators.components import components
from tests.llm.conftest import oracle, spark_rows


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.02 * (i % 5)).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[5][1], 2) for i in range(20)] + [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [1.0, None] + [0.0] * 6, 1), (404, [float("nan")] * 8, 1), (405, rows[0][1], None), (406, [1.0, 2.0], 1)]
    rows = [(i, v, k, "clash", 1) for i, v, k in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, v int")


def test_topk_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    rows = topk_search.quantized(vectors, "vec_id", "embedding")
    got = topk_search.search(rows.where("id % 20 = 0"), rows, pivots=5, rings=3)
    v = {r.id: np.array(r.v) for r in rows.collect() if len(r.v) == 8}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    few = rows.where("id < 3")
    assert topk_search.search(few, few).count() == 6 and topk_search.search(rows.limit(0), rows.limit(0)).count() == 0
    assert topk_search.search(rows.limit(0), rows).count() == 0


def test_dedup_is_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 10)
    got = embedding_dedup.near_duplicates(vectors)
    rows = {r.vec_id: (r.embedding, r.label) for r in vectors.collect()}
    fine = [i for i, (v, k) in rows.items() if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [j for j in fine if j != i and rows[j][1] == rows[i][1] and len(rows[j][0]) == len(rows[i][0]) and np.dot(rows[i][0], rows[j][0]) / np.linalg.norm(rows[i][0]) / np.linalg.norm(rows[j][0]) >= 0.98] for i in fine}
    low = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i in fine:
            m = min([low[i], *(low[j] for j in links[i])])
            changed, low[i] = changed or m != low[i], m
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()} == {(i, len(links.get(i, [])), low[i], low[i] == i) for i in rows}
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_dedup_of_very_large_and_very_small_vectors(spark):
    """Cosines do not depend on the vectors' size, up to the ends of double precision."""
    rows = [(0, [1e200, 2e200, 1e195]), (1, [1e200, 2e200, 3e195]), (2, [1e-200, 2e-200, 0.0]), (3, [5e-324, 1e-323, 0.0]), (4, [1.7e308, 1.7e308, -1.7e308]), (5, [1.0, 1.0, -1.0]), (6, [1.0, 2.0, 0.0]), (7, [-1e300, 1e-300, 0.0]), (8, [2e-310, 4e-310, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (5, 0) for i in (0, 1, 2, 3, 6, 8)} | {4: (1, 4), 5: (1, 4), 7: (0, 7)}
    assert spark_rows(embedding_dedup.near_duplicates(df)) == oracle(embedding_dedup.oracle_sql(), embeddings=df.toPandas())
    single = spark.createDataFrame([(0, [3e30, 1.0], 1), (1, [2e30, 1.0], 1), (2, [1e-30, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {r.n_links for r in embedding_dedup.near_duplicates(single).collect()} == {2}


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_at_the_threshold(hashes):
    """Pairs at a cosine of just 0.98 in 64 dimensions meet in a bucket."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    x, y = embedding_dedup.buckets(a, hashes), embedding_dedup.buckets(b, hashes)
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.99


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    random.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9

def test_escapes_round_trip():
    random.seed(2)
    parts = ["<", "|", ">", "\\", "</s>", "[", "INST]", "/", "<<SYS>>", "s>", "\n", "a", "<|end|>\n", "turn:", "é"]
    for _ in range(5000):
        text, role = ("".join(random.choices(parts, k=random.randint(0, n))) for n in (12, 5))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text and not any(c in escaped for c in chat_format.CONTROLS)
        formatted, start, end = chat_format.render(role, text, True)
        assert list(chat_format.parse(formatted * 2)) == [(role, text, len(formatted))] * 2
        assert chat_format.unescape(formatted[start:end]) == text


def test_events_fold_into_messages(spark):
    events = [
        (1, 0, "u1", "message", "user", "hi"), (1, 1, "a1", "message", "assistant", ""), (1, 2, "a1", "delta", None, "Hel"), (1, 3, "a1", "delta", None, "lo"),
        (1, 4, "u1", "edit", None, "hi!"), (1, 5, "a1", "regenerate", None, None), (1, 6, "a1", "delta", None, "Bye"), (1, 7, "x", "message", "user", "gone"), (1, 8, "x", "delete", None, None),
        (2, 0, "z", "delta", None, "late"), (None, 0, "n", "message", None, None),
    ]
    out = chat_format.reconstruct(spark.createDataFrame(events, "conv_id long, seq long, message string, kind string, role string, text string")).collect()
    assert sorted(((r.conv_id or 0), r.seq, r.role, r.text) for r in out) == [(0, 0, "", ""), (1, 0, "user", "hi!"), (1, 1, "assistant", "Bye"), (2, 0, "", "late")]
    bad = spark.createDataFrame([(1, 0, "u", "what", "user", "x")], "conv_id long, seq long, message string, kind string, role string, text string")
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.reconstruct(bad).collect()


def test_formatting_of_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "q", "c"), (1, 1, "assistant", None, "c"), (1, 1, "assistant", "b\\</s>", "c"), (1, 1, "assistant", "b\\</s>", "c"), (2, 0, None, "x" * 50000, "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.read_back(chat_format.reconstruct(chat_format.log_of(df)))
    frame = df.toPandas()
    sql = chat_format.oracle_sql([(-7, 0, "user", "a")])
    assert [r for r in spark_rows(got)] == [r for r in oracle(sql, conversations=frame) if "-7" not in r]
    one = next(r for r in got.collect() if r.conv_id == 1)
    assert one.n_turns == 4 and one.loss_chars == 12 and one.loss_sha256 == hashlib.sha256(("b\\</s>" * 2).encode()).hexdigest()
    assert chat_format.read_back(chat_format.reconstruct(chat_format.log_of(df.limit(0)))).count() == 0


def test_messages_of_one_turn_go_by_role_and_text(spark):
    """As they are without escapes: these tell another order when they are formatted."""
    said = [("user2", "a"), ("user", "b"), ("user|>", "c"), ("user", "<|"), ("user", "<z"), ("user", "b "), ("user", "b\\"), ("assistant", "[INST]"), ("assistant", "[Z"), ("", "x")]
    rows = [(c, 1, r, t) for c in (1, 2) for r, t in (said if c == 1 else reversed(said))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.reconstruct(chat_format.log_of(df)))
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in sorted(said)).encode()).hexdigest()
    assert {r.turns_sha256 for r in got.collect()} == {want}
    assert spark_rows(got) == [r for r in oracle(chat_format.oracle_sql([(-7, 0, "user", "a")]), conversations=df.toPandas()) if "-7" not in r]


def test_logs_of_finished_turns_hold_drafts(spark):
    """Deltas, edits and regenerations lie between the table and what is read back."""
    rows = [(i % 7, i // 7, "assistant" if i % 2 else "user", "é\\U0001f600<|" * (i * 13 % 900) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.log_of(df)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["message"] == 300 and min(kinds["edit"], kinds["regenerate"]) > 50 and kinds["delta"] > 600
    assert log.where("kind = 'delta'").selectExpr("max(length(text))").first()[0] <= chat_format.DELTA + len(chat_format.DRAFT)
    out = chat_format.reconstruct(log.orderBy(chat_format.F.rand(3))).collect()
    assert sorted((r.conv_id, r.seq, r.role, r.text) for r in out) == sorted((c, t, r, x or "") for c, t, r, x in rows)


def test_topk_searches_each_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 3 else 3).tolist()) for i in range(120)] + [(500, [1.0] * 5)]
    q = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    v = {r.id: np.array(r.v) for r in q.collect()}
    want = set()
    for i in (i for i in v if i % 10 == 0):
        best = sorted((-int(v[i] @ v[j]), j) for j in v if j != i and len(v[j]) == len(v[i]))[:4]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in topk_search.search(q.where("id % 10 = 0"), q, k=4, pivots=4, rings=3).collect()} == want


def test_topk_of_large_components_ties_and_repeated_ids(spark):
    """Nothing is clamped: beyond 2^53 and 2^63 products are ranked as the integers they are."""
    rows = [(0, [4e5, 1.0]), (1, [3e5, 0.0]), (2, [5e5, 0.0]), (10, [4e5, 1.0]), (10, [4e5, 1.0]), (10, [-4e5, 2.0]), (3, [1e30, 1.0]), (4, [1e30, 2.0]), (5, [-1e30, 1.0]), (6, [1e200, 0.0]), (7, [1e308, 0.0]), (8, [2e30, -1e30])]
    q = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk_search.search(q.where("id % 10 = 0"), q, k=6).collect()
    v = {r.row: (r.id, [int(x) for x in r.v]) for r in q.collect()}
    assert len(v) == len(rows) - 1 and v[next(k for k in v if v[k][0] == 3)][1] == [int(1e30 * 1024), 1024]  # 1e308 * 1024 is not finite
    want = []
    for r, (i, x) in v.items():
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, o) for o, (j, y) in v.items() if o != r)[:6]
            want += [(i, k + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, j, _) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(w[0] == 10 for w in want) == 18


def test_topk_sends_only_what_is_asked_for(spark):
    """Rows of rings that no query asks for are not dealt out, and those of others once for each block of the queries that ask."""
    cells = spark.range(100).selectExpr("id AS row", "id", "array(cast(id AS double)) AS v", "cast(id % 4 AS int) AS ring", "0.0 AS d")
    parts = spark.createDataFrame([(r, 1) for r in range(4)], "ring int, parts int")
    queries = spark.createDataFrame([(1000 + i, i, [1.0]) for i in range(5)], "row long, id long, v array<double>")
    wanted = spark.createDataFrame([(1000 + i, 2, -(1 << 63) if i < 3 else 94) for i in range(5)], "query long, ring int, least long")
    out = topk_search._scan(cells, queries, wanted, 3, parts)
    assert {(r.query, r.id) for r in out.collect()} == {(1000 + i, j) for i in range(5) for j in (98, 94, 90) if i < 3 or j >= 94}
