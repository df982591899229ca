"""The operators on texts: edge cases, and brute force where SQL is not the test."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from geoframe.llm import byte_bpe, language_id, license_scan, ngram_join, pii, quality, queries, source_mix
from tests.llm.conftest import HARD, oracle, spark_rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    vocabulary = byte_bpe.Vocabulary(PATH)
    return vocabulary, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


# 1

def test_license_edges(spark, hard, none):
    frame = hard.select("doc_id", "text").toPandas()
    assert spark_rows(license_scan.report(license_scan.scan(hard))) == oracle(license_scan.oracle_sql(), documents=frame)
    out = {r.doc_id: r for r in license_scan.report(license_scan.scan(hard)).collect()}
    assert (out[5].n_base, out[5].first_word, out[5].last_word, out[5].base_labels) == (3, 0, 4, "apache,mit")
    assert (out[0].n_words, out[0].n_base, out[0].first_word, out[0].labels, out[0].score) == (0, 0, None, "", 0.0)
    assert license_scan.report(license_scan.scan(none)).count() == 0


# 3

def test_join_edges(spark, hard, none):
    frame = hard.select("doc_id", "text").toPandas()
    assert spark_rows(ngram_join.classes(hard)) == oracle(ngram_join.oracle_sql(), documents=frame)
    assert ngram_join.classes(none).count() == 0


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _classes(sets, near=80):
    """The smallest id in reach of each id, by comparing all pairs."""
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b]) if a < b else 0
            if k and 100 * k >= near * (len(sets[a]) + len(sets[b]) - k):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def _large_groups():
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    base, passage, rows = random.choices(words, k=70), random.choices(words, k=55), []
    for i in range(90):
        t = list(base)
        for _ in range(random.randint(0, 4)):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((1000 - i, " ".join(t)))
    rows += [(i, " ".join(random.choices(words, k=40) + passage + random.choices(words, k=40))) for i in range(60)]
    return rows + [(2000 + i, rows[i][1].upper()) for i in range(20)]


@pytest.mark.parametrize("hot, pairs", [(13, 4096), (2, 4096), (13, 1)])
def test_join_of_large_groups(spark, monkeypatch, hot, pairs):
    """Near copies and a shared passage, with limits so small that shingles overflow into blocks, are hot, or make jobs of two groups."""
    for name, v in (("SMALL", 4), ("BLOCK", 7), ("TYPICAL", 64), ("FREQUENT", 6), ("HOT", hot), ("PAIRS", pairs)):
        monkeypatch.setattr(ngram_join, name, v)
    rows = _large_groups()
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: _sets(t) for i, t in rows}
    low = _classes(sets)
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), low[i]) for i in sets}
    assert len(set(low.values())) < len(sets) - 40


def test_join_tells_sets_by_more_bits_when_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOLD_BY", (5, 64))
    rows = _large_groups() + [(3000, "x"), (3000, "y z"), (3001, "Y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: _sets(t) for i, t in rows if i < 3000}
    got = [(r.doc_id, r.component_id) for r in ngram_join.classes(df).collect()]
    assert sorted(got) == sorted([*_classes(sets).items(), (3000, 3000), (3000, 3000), (3001, 3000)])
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == sorted([*set(_classes(sets).values()), 3000, 3000])


def test_join_of_one_prefix(spark, monkeypatch):
    """50,000 different texts, most of them of one prefix and size (no shingle is told to be frequent), all near copies: one class."""
    monkeypatch.setattr(ngram_join, "frequent", lambda *_: (np.zeros(0, np.uint32), np.zeros(0, np.uint8)))
    same = " ".join(f"s{k}" for k in range(44))
    df = spark.createDataFrame([(i, f"{same} t{i}") for i in range(50_000)], "doc_id long, text string").repartition(8)
    rows = ngram_join.prepared(df, "doc_id", "text", 5, 80, np.zeros(0, np.uint32), np.zeros(0, np.uint8))
    assert rows.groupBy("grp").count().agg({"count": "max"}).first()[0] > 30_000
    out = ngram_join.classes(df).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in out] == [(0, 50_000)]


def test_keep_one(spark, hard):
    out = ngram_join.keep_one(hard).toPandas()
    assert collections.Counter(out.doc_id) == {i: 1 for i, _ in HARD if i != 7} and list(out.columns) == hard.columns
    twice = spark.createDataFrame([(1, "p q r s t u"), (1, "k l m n o"), (1, "P q r s t u"), (2, "k l m n o"), (3, "")], "doc_id long, text string")
    assert sorted(r.text for r in ngram_join.keep_one(twice).collect()) in (["", "P q r s t u", "k l m n o"], ["", "k l m n o", "p q r s t u"])


# 4

def _farthest(order, weights):
    """The largest distance, at any slot, of a source's blocks from its share."""
    got, worst, total = dict.fromkeys(weights, 0), 0.0, sum(weights.values())
    for t, s in enumerate(order, 1):
        got[s] += 1
        worst = max(worst, *(abs(got[s] - t * w / total) for s, w in weights.items()))
    return worst


@pytest.mark.parametrize("weights", [{"a": 0.617123, "b": 0.33, "c": 0.052877}, {"a": 7.0, "b": 2.000001, "c": 0.05, "d": 1.5, "e": 0.000001}])
def test_mix_follows_the_given_weights(spark, weights):
    """Less than a block off the weights as they are given, over 100,000 slots."""
    most = {s: int(100_500 * w / sum(weights.values())) + 2 for s, w in weights.items()}
    counts = spark.createDataFrame([(s, n * 16) for s, n in most.items()], "source string, n long")
    share = source_mix.shares(counts, weights)
    names = {r.i: r.source for r in share.collect()}
    order = [names[r.i] for r in source_mix.slots(share).orderBy("slot").limit(100_000).collect()]
    assert len(order) == 100_000 and _farthest(order, weights) < 1


def test_mix_deviation_and_edges(spark, sf, hard, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for weights in ({f"src{i}": 1 + i % 5 for i in range(20)}, None):
        out = source_mix.mix(docs, weights=weights, block=2).toPandas()
        sizes = docs.groupBy(source_mix.F.coalesce("source", source_mix.F.lit("")).alias("s")).count().collect()
        target = {r.s: weights.get(r.s) if weights else math.floor(math.sqrt(r["count"]) * 1000) for r in sizes}
        target = {s: w or sum(weights.values()) / 1000 for s, w in target.items()}
        assert len(out) == docs.count() and out.mix_position.is_unique
        by = {s: set(g) for s, g in out.assign(source=out.source.fillna("")).groupby("source")["mix_slot"]}
        owners = [[s for s in by if t in by[s]] for t in range(min(max(x) for x in by.values()) + 1)]
        assert all(len(o) == 1 for o in owners) and _farthest([o[0] for o in owners], target) < 1
    mixed = source_mix.mix(hard)
    assert mixed.count() == hard.count() and set(mixed.columns) == {*hard.columns, *source_mix.NEW}
    assert source_mix.mix(none).count() == 0
    assert source_mix.mix(hard, weights={}).count() == hard.count()


def test_mix_of_weights_beyond_the_slots(spark):
    """Where neither the stream nor what repeats fits, whole slots repeat, and no block is lost."""
    counts = spark.createDataFrame([("a", 6000), ("b", 3001), ("c", 7)], "source string, n long")
    share = source_mix.shares(counts, {"a": 0.617123, "b": 0.33, "c": 0.052877}, block=1, most=100)
    rows = {r.source: (r.w, r.total, r.slots) for r in share.collect()}
    assert rows == {"a": (61, 100, 100), "b": (33, 100, 100), "c": (6, 100, 100)}
    assert source_mix.slots(share).count() == 100


def test_mixed_files_are_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    at = [r.mix_position for r in source_mix.mix(docs, files=5).collect()]
    assert at == sorted(at) and len(at) == docs.count()


# 5

def test_language(spark, hard, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    told = language_id.predict(docs, model).join(docs.select("doc_id", "lang", language_id.held_out().alias("h")), "doc_id").toPandas()
    held = told[told.h]
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.rejected.mean() < 0.01 and held.score.between(0, 1).all()
    out = {r.doc_id: r for r in language_id.predict(hard, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (0, 1, 2, 12))
    assert out[9].lang_pred in model.languages and language_id.predict(none, model).count() == 0
    assert language_id.kept(hard, model).columns == hard.columns
    nothing = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(hard, nothing).collect()} == {"und"} and language_id.kept(hard, nothing).count() == 0


def test_language_scores_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.HASHES, 2)).astype(np.float32), np.zeros(2), 1.0, 0.5)
    model.rows[0] = 0
    texts = ["Alpha beta, gamma. " * 30, "é", "x y z " * 100]
    whole = language_id.scores(texts, model)
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert np.allclose(whole, language_id.scores(texts, model), atol=1e-4)
    monkeypatch.undo()
    assert np.allclose(whole, np.concatenate([language_id.scores([t], model) for t in texts]), atol=1e-4)


# 7

def test_bpe_is_tiktokens(spark, hard, none, library):
    vocabulary, other = library
    out = collections.defaultdict(list)
    for r in byte_bpe.round_trip(hard, PATH, PATTERN).collect():
        out[r.doc_id].append(r)
    for i, t in HARD:
        ids = other.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (out[i][0].n_tokens, out[i][0].ids_sha256, out[i][0].decoded_sha256) == want
    assert len(out[7]) == 2 and byte_bpe.round_trip(none, PATH, PATTERN).count() == 0


def test_bpe_appends_and_edits(library):
    vocabulary, other = library
    random.seed(5)
    pieces = ["a", " the", "ing", "é", "0", "  ", "\n", "\U0001f600", "不", "'s", "----", "\t", "Zebra "]
    for _ in range(60):
        e = byte_bpe.Encoding(vocabulary, PATTERN, "".join(random.choices(pieces, k=40)))
        for _ in range(8):
            a = random.randint(0, len(e.text))
            e.edit(a, min(len(e.text), a + random.randint(0, 4)), "".join(random.choices(pieces, k=random.randint(0, 2))))
            assert e.ids == other.encode_ordinary(e.text)
        e.append("".join(random.choices(pieces, k=3)))
        assert e.ids == other.encode_ordinary(e.text)
    long = byte_bpe.Encoding(vocabulary, PATTERN, "some words " * 500)
    before = long.encoded
    long.edit(3000, 3001, "x")
    assert long.encoded - before < 12 and long.ids == other.encode_ordinary(long.text)
    piece = b"abcabc" * 9
    assert vocabulary.extend(piece, vocabulary.extend(piece[:20], [])) == vocabulary.extend(piece, [])


# 8

def test_quality(spark, hard, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    vectors, net = quality.fit(docs, labels)
    some = docs.join(labels, "doc_id").where(language_id.held_out())
    told = quality.predict(some, vectors, net).join(labels, "doc_id").toPandas()
    said = told.score >= 0.3
    assert told.score.between(0, 1).all() and (said == (told.quality == 1)).mean() > 0.97 and said[told.quality == 1].mean() > 0.98
    assert quality.predict(hard, vectors, net).count() == hard.count() and quality.predict(none, vectors, net).count() == 0
    only = labels.where("quality = 1").limit(50)
    assert quality.fit(hard, only)[1] == 1.0 and quality.fit(none, labels.limit(0))[1] == 0.5


# 10

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _base(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base_by_brute_force(spark, hard, none):
    random.seed(4)
    parts = ["a", "b.c", "@", "x@y.z", "1", "23", "4539 1488 0343 6467", "4539148803436467", "+1 (415) 555-1234", "1.2.3.4", "256.1.1.1", "0001.02.3.255", ".", " ", "-", "+", "é", "\U0001f600", "%", "\n", "99999999999", "_", "(", ")"]
    rows = [(100 + i, "".join(random.choices(parts, k=random.randint(0, 25)))) for i in range(1500)] + [(i, t) for i, t in HARD if i != 7] + [(50, "1.2.3.4 " * 700), (51, "+1" + " " * 30000)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(s.start, s.rank, s.stop, s.kind) for s in out[i].base] == _base(t or ""), t
    assert pii.report(pii.find(none)).count() == 0 and pii.mask(none).count() == 0
    assert pii.find(hard).count() == hard.count()


def test_pii_discovers_by_context_and_masks(spark):
    rows = [(i, f"contact mail user{i}@mail.example.com today") for i in range(30)]
    rows += [(100, "contact mail AB12-99887 today"), (101, "the part AB12-99887 is here"), (102, "a version 1234567 elsewhere"), (103, None), (100, "contact mail AB12-99887 today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(df)).collect()}
    assert spans[100] == "id:13:23" and spans[102] == "" and spans[0] == "email:13:35"
    masked = collections.Counter(r.text for r in pii.mask(df).collect())
    assert masked["contact mail <ID> today"] == 2 and masked["contact mail <EMAIL> today"] == 30 and masked[None] == 1
    assert "@" not in "".join(t or "" for t in masked)


def test_pii_discovers_from_what_it_discovered(spark):
    """Identifiers found beside seeds vouch for a pattern that no seed ever stands in, which finds one more in the round after."""
    rows = [(1000 + i, f"contact mail user{i}@mail.example.com today") for i in range(300)]
    rows += [(100 + i, f"contact mail AB12-998{i:02} today") for i in range(40)] + [(200 + i, f"holder AB12-998{i:02} agreed") for i in range(40)]
    rows += [(300, "holder ZZ99-00001 agreed"), (301, "version 1234567 elsewhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(df)).collect()}
    assert spans[200] == "id:7:17" and spans[300] == "id:7:17" and spans[301] == ""
    found = pii.occurrences(df, "doc_id", "text")
    assert 300 not in {r.id for r in pii.discovered(found, rounds=1).collect()} and 300 in {r.id for r in pii.discovered(found, rounds=2).collect()}
    assert spark_rows(pii.report(pii.find(df))) == oracle(pii.oracle_sql(), documents=df.toPandas())


# The pipeline

def test_pipeline_by_brute_force(spark, tmp_path, library):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    kept = {i: _sets(r.text) for i, r in texts.items() if language_id.has_letter(r.text)}
    gone = set()
    for a in sorted(kept):
        for b in sorted(kept):
            k = len(kept[a] & kept[b])
            if a < b and k and 100 * k >= 80 * (len(kept[a]) + len(kept[b]) - k):
                gone.add(b)
    assert set(got) == set(kept) - gone
    assert len(corpus_pipeline.STAGES) == 5 and docs.count() == len(texts)
    vocabulary, other = library
    plain = 0
    for i, r in got.items():
        decoded = vocabulary.decode(r.ids)
        assert other.encode_ordinary(decoded.decode()) == list(r.ids) and hashlib.sha256(decoded).hexdigest() == r.decoded_sha256
        assert not _base(decoded.decode())
        if not re.search("[0-9]", texts[i].text):
            plain += decoded.decode() == texts[i].text
    assert plain > 100
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where(F.col("doc_id") < 40), "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert "op1_license_scan" in queries.QUERIES


def test_language_sample_has_800_rows_of_each(spark):
    texts = [(i, f"wort {i} satz" if i % 2 else f"word {i} phrase", "de" if i % 2 else "en") for i in range(6000)]
    sample = language_id._sample(spark.createDataFrame(texts, "doc_id long, text string, lang string"), "doc_id", "text", "lang").toPandas()
    rows = sample[sample.place % 4 == 0].groupby("lang").size()
    assert ((rows > 700) & (rows < 900)).all()
    assert sample.which.map(len).mul(2).eq(sample.share.map(len)).all()


def test_rare_languages_are_learnt(spark):
    """300 languages, each of words of its own and of very unequal frequency."""
    rows, rng = [], np.random.default_rng(3)
    for k in range(300):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(4)]
        for i in range(60 if k < 250 else 15):
            rows.append((len(rows), " ".join(rng.choice(words, 12)), f"l{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 300
    told = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    rare = told[told.lang >= "l250"]
    assert len(set(rare.lang_pred) & set(rare.lang)) > 40


def test_every_language_has_a_row_in_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 30)
    rows = [(i, f"word{i % 60} and more", f"l{i % 60}") for i in range(3000)]
    sample = language_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").toPandas()
    assert sample.lang.nunique() == 60 and sample.place.floordiv(4).nunique() < 200


def test_sample_of_languages_is_bounded_whatever_the_lengths(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_VALUES", 3000)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)), f"l{i % 2}") for i in range(30)] + [(99, "x" * 5000, "l0")]
    sample = language_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").toPandas()
    assert sample.which.map(len).max() <= 2 * 200 and sample.place.floordiv(4).nunique() > 20 and (sample.place % 4 == 0).sum() > 20


def test_language_scores_by_a_plain_loop(spark, sf):
    """Scores and predictions against sums over each subword, one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    told = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.limit(60).collect():
        data = b" " + (r.text or "").lower().encode().translate(language_id._WORD) + b" "
        total, n = np.zeros(len(model.languages)), 0
        for width in (2, 3, 4):
            for at in range(len(data) - width + 1):
                run = data[at : at + width]
                if run == b"  " if width == 2 else 32 in run[1:-1]:
                    continue
                h = run[0]
                for c in run[1:]:
                    h = (h * 16777619 + c) % (1 << 32)
                h = (h * 2654435761) % (1 << 32) >> 17
                total, n = total + model.rows[h or 1], n + 1
        z = (total / max(n, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if any(map(str.isalpha, r.text or "")):
            assert told[r.doc_id].lang_pred == model.languages[int(p.argmax())] and abs(told[r.doc_id].score - p.max()) < 1e-5
        else:
            assert told[r.doc_id].lang_pred == "und"


def test_quality_by_plain_loops(spark, hard):
    """Word vectors, pooling and the network's probabilities, one word after another."""
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id not in (9, 10, 12)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    places, signs = quality.index_vectors()
    token, w = quality._Tokens(), quality.WIDTH
    rows = {i: [divmod(token[t], quality.SHAPES) for t in (x or "").split()] for i, x in texts.items()}
    sums = np.zeros((quality._ALL, w + 1))
    index = np.zeros((quality._ALL, w))
    for r in range(quality._ALL):
        for k in (0, 1):
            index[r, places[r, k]] += signs[r, k]
    for ids in rows.values():
        for stream in ([a for a, _ in ids], [b + quality.WORDS for _, b in ids]):
            for i, a in enumerate(stream):
                sums[a, w] += 1
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(stream):
                        sums[a, :w] += index[stream[j]]
    assert np.array_equal(quality.contexts(docs), sums)
    vectors = quality.word_vectors(sums)
    rng = np.random.default_rng(1)
    net = quality.Network(np.zeros(6 * w + 3), np.ones(6 * w + 3), rng.normal(size=(6 * w + 3, 4)), rng.normal(size=4), rng.normal(size=4), 0.1, 1.7)
    told = {r.doc_id: r.score for r in quality.predict(docs, vectors, net).collect()}
    for i, ids in rows.items():
        n = max(1, len(ids))
        same = [sum(ids[k][part] == ids[k + 1][part] for k in range(len(ids) - 1)) / n for part in (0, 1)]
        x = [*same, np.log1p(len(ids))]
        for each in ([vectors[a] for a, _ in ids], [np.concatenate((vectors[b + quality.WORDS], index[b + quality.WORDS])) for _, b in ids]):
            m = np.array(each, float).reshape(len(ids), -1) if ids else np.zeros((1, w if len(x) == 3 else 2 * w))
            x += [*m.mean(0), *m.std(0)]
        h = np.tanh(np.array(x) @ net.w1 + net.b1) @ net.w2 + net.b2
        assert abs(told[i] - 1 / (1 + np.exp(-h / net.temperature))) < 1e-4, texts[i]


HARD_ROWS = [(i, t, "en" if i % 2 else None, None if i % 4 == 0 else f"s{i % 3}", None if i % 5 == 0 else len(t or "")) for i, t in HARD]


@pytest.mark.parametrize("number", range(5))
def test_stages_over_hard_rows(spark, number):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns, and no rows at all."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    rows = [*HARD_ROWS, HARD_ROWS[3], (None, None, None, None, None), (None, "some words of no document", "en", "s1", 4), (5, "another text under this id", "en", "s1", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain.selectExpr("*", "'x' AS id", "1.5 AS score", "array(1) AS ids", "'y' AS mix_slot", "'z' AS node", "0 AS place")
    out = stage(spark, more, "")
    got = out.collect()
    if number < 4:
        assert out.columns == plain.columns
    if name == "language":
        assert {r.doc_id for r in got} <= {r[0] for r in rows if language_id.has_letter(r[1])}
    if name == "near_copies":
        kept = collections.Counter(r.doc_id for r in got)
        assert kept[7] == 0 and kept[6] == 1 and kept[3] == 1 and kept[5] == 2 and kept[None] == 2
    if name in ("private", "mixture", "tokens"):
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    if name == "private":
        assert all("@" not in (r.text or "") for r in got) and all((r.text is None) == (r.n_chars is None) for r in got)
    if name == "mixture":
        assert collections.Counter(r.text for r in got) == collections.Counter(r[1] for r in rows)
    assert stage(spark, plain.limit(0), "").count() == 0


def test_samples_are_bounded_by_rows(spark):
    """An id that is repeated very often is one row of what is learnt from."""
    rows = [(7, f"alpha beta gamma {i % 50}", "en") for i in range(3000)] + [(i, f"eins zwei drei {i}", "de") for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", language_id.held_out())
    free = docs.where("NOT held").select("doc_id").distinct().count()
    sample = language_id._sample(docs, "doc_id", "text", "lang").toPandas()
    assert len(sample) <= 4 * free
    labels = spark.createDataFrame([(i, i % 2) for i in (7, *range(100, 130))] * 2, "doc_id long, quality int")
    vectors, net = quality.fit(docs, labels)
    assert quality.predict(docs, vectors, net).count() == len(rows)
