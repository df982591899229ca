"""The operators on urls, on the structure of conversations, and on how filters interact."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoframe.llm import filter_audit, queries, turn_repair, url_filter
from tests.llm.conftest import oracle, spark_rows

# 11

URLS = [
    "https://WWW.Example.COM/en/a?x=1#y", "http://a.example.com/en/", "http://example.com/en", "http://www.example.com", "http://xexample.com/en/", "http://net/es/1", "ftp://deep.a.net/fr/?q", "http://a.net/ES/",
    "no scheme", "", None, "://", "http://", "a://b://c/d", "http://h.org?x/y", "http://h.org#/en/", "http://É.com/\nfr/", "http://1.2.3.4/", "http://h.co.uk/x", "http://com/", "http://.com/", "http://u@h.com:80/",
    "http://" + "x" * 50_000 + ".net/fr/" + "y" * 50_000,
]


def _plain_parts(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", ""
    end = min([rest[1].index(c) for c in "/?#" if c in rest[1]], default=len(rest[1]))
    path = rest[1][end:]
    return "".join(c.lower() if c.isascii() else c for c in rest[1][:end]), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def test_urls_by_rule(spark, sf):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "clash", "x"), (None, URLS[0], "clash", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.judge(pages, queries.URL_RULES, labels).collect()
    want = []
    for page, url, *_ in rows:
        host, path = _plain_parts(url)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        want.append((page, host, path, best and best.host + best.path, best.verdict if best else "allow"))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(w[4] == "block" for w in want) >= 4 and sum(w[3] is None for w in want) > 5
    sql = url_filter.oracle_sql(queries.URL_RULES)
    frames = {"pages": pages.select("page_id", "url").toPandas().astype({"page_id": "Int64"}), "labels": labels.selectExpr("page_id AS doc_id", "bad AS quality").toPandas().astype("int64")}
    assert spark_rows(url_filter.judge(pages, queries.URL_RULES, labels)) == oracle(sql, **frames)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, labels).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, [], labels).collect()} == {"allow"}


def _plain_reputation(counts, z):
    """host -> lower bound, by nested dictionaries and plain loops."""

    def split(host):
        labels = host.split(".")
        if re.fullmatch(r"[0-9.]+", host):
            return "", host
        wide = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in url_filter.SECOND_LEVELS else 1
        return ".".join(labels[-wide:]), ".".join(labels[-wide - 1 :])

    keys = {h: ("", (split(h)[0],), split(h), (*split(h), h)) for h in counts}
    sums = defaultdict(lambda: [0, 0])
    for h, (n, k) in counts.items():
        for key in keys[h]:
            sums[key][0] += n
            sums[key][1] += k
    mean = {"": (sums[""][1] + 1) / (sums[""][0] + 2)}
    lower = {}
    for depth in (1, 2, 3):
        pairs = {(keys[h][depth], keys[h][depth - 1]) for h in counts}
        parents = {p for _, p in pairs}
        n = lambda x: sums[x][0]
        k = lambda x: sums[x][1]
        spread = sum(k(c) ** 2 / n(c) for c, _ in pairs) - sum(k(p) ** 2 / n(p) for p in parents)
        free = len(pairs) - len(parents)
        total = sum(n(p) for p in parents)
        pq = sum(n(p) * (k(p) / n(p)) * (1 - k(p) / n(p)) for p in parents) / total
        room = total - sum(n(c) ** 2 / n(p) for c, p in pairs) - free
        worth = url_filter.WORTH
        if pq > 0 and room > 1e-9:
            worth = min(1000.0, max(1.0, 1 / max((spread / pq - free) / room, 1 / 1001) - 1))
        for c, p in pairs:
            a, b = worth * mean[p] + k(c), worth * (1 - mean[p]) + n(c) - k(c)
            mean[c] = a / (a + b)
            if depth == 3:
                lower[c[2]] = mean[c] - z * math.sqrt(a * b / (a + b + 1)) / (a + b)
    return lower


def test_reputation_is_shrunk_from_host_to_suffix(spark):
    random.seed(5)
    rates = {"good.com": 0.02, "bad.net": 0.9, "mixed.org": 0.4, "shop.co.uk": 0.1}
    counts = {}
    for domain, rate in rates.items():
        for i in range(12):
            n = random.choice([1, 2, 8, 40, 200])
            counts[f"h{i}.{domain}"] = (n, sum(random.random() < rate for _ in range(n)))
    counts |= {"lone.bad.net": (1, 1), "10.0.0.1": (5, 5), "": (3, 1), "lone.good.com": (1, 1)}
    df = spark.createDataFrame([(h, n, k) for h, (n, k) in counts.items()], "host string, n long, bad long")
    got = {r.host: r for r in url_filter.reputation(df).collect()}
    want = _plain_reputation(counts, url_filter.Z)
    assert got.keys() == want.keys() and all(math.isclose(got[h].lower, want[h], rel_tol=1e-9, abs_tol=1e-12) for h in want)
    assert got["h1.shop.co.uk"].suffix == "co.uk" and got["h1.shop.co.uk"].domain == "shop.co.uk" and got["10.0.0.1"].domain == "10.0.0.1"
    # One bad page says much more where the neighbours are bad.
    assert got["lone.bad.net"].lower > url_filter.LIMIT > got["lone.good.com"].mean
    none = url_filter.reputation(df.limit(0))
    assert none.count() == 0


def test_pages_of_bad_hosts_are_blocked(spark):
    hosts = ["a.bad.net"] * 300 + ["b.good.com"] * 600 + ["c.bad.net"] * 60
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    labels = [(i, int("bad" in h)) for i, h in enumerate(hosts) if i % 3 == 0] + [(0, 0), (None, 1), (5, None)]
    got = url_filter.judge(pages, [url_filter.Rule("allow", "c.bad.net", "/901")], spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {(r.host, r.verdict) for r in got if r.page_id != 901} == {("a.bad.net", "block"), ("b.good.com", "allow"), ("c.bad.net", "block")} and len(got) == 960
    assert next(r.verdict for r in got if r.page_id == 901) == "allow"


# 12


def _search(said):
    """Least (cost, audit) and roles by trying all edits: a plain shortest path over (row, roles so far fit the grammar)."""
    best = {}
    legal = re.compile(r"(s?(ua)*u?)?\Z")
    todo = [(0, "", 0, "")]
    out = None
    while todo:
        cost, audit, i, roles = todo.pop()
        if not legal.match(roles) or cost > 4 * len(said) + 6 or (out and cost > out[0]) or audit.endswith("III"):
            continue
        # What roles end with and whether there is any is all that matters for the rest.
        at = (i, roles[-1:], audit)
        if at in best:
            continue
        best[at] = cost
        if i == len(said) and re.fullmatch(r"(s?(ua)+)?", roles):
            out = min(out or (cost, audit), (cost, audit))
        for r in "ua":
            todo.append((cost + 3, audit + "I", i, roles + r))
        if i < len(said):
            initial, fault = said[i]
            more = 3 * (fault == "truncated")
            todo.append((cost + 4, audit + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                todo.append((cost + more, audit + "K", i + 1, roles + (initial or "?")))
                todo += [(cost + more + 3, audit + "R", i + 1, roles + r) for r in "ua"]
    return out


def test_repairs_are_the_cheapest():
    random.seed(1)
    cases = [[]] + [[(r, "")] for r in ("s", "u", "a", "t", "")] + [[(random.choice("suaux"), random.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(random.randint(1, 5))] for _ in range(250)]
    for said in cases:
        assert turn_repair.finish(turn_repair.parsed(turn_repair.opened(), said)) == _search(said), said


def test_blocks_join_to_the_same_parse():
    random.seed(3)
    for _ in range(60):
        said = [(random.choice("suuaax"), random.choice(["", "", "truncated", "duplicate"])) for _ in range(40)]
        whole = turn_repair.parsed(turn_repair.opened(), said)
        kernel, at = turn_repair.opened(), 0
        while at < len(said):
            to = at + random.randint(1, 9)
            new = {}
            for e, x, cost, audit in turn_repair.transfer(said[at:to]):
                if (item := turn_repair.ITEMS[e]) in kernel:
                    reached = (kernel[item][0] + cost, kernel[item][1] + audit)
                    new[turn_repair.ITEMS[x]] = min(reached, new.get(turn_repair.ITEMS[x], reached))
            kernel, at = new, to
        assert kernel == whole


def _plain_repair(rows):
    """The contract by plain loops over one conversation's rows (turn, role, text) in order."""
    said, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        said.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    faults = Counter(f for _, f in said)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    # Dynamic programming over the four last roles, with whole strings.
    state = {"": (0, "")}
    inserted = lambda s: {**s, **{r: min(x for x in (s.get(r), *((s[q][0] + 3, s[q][1] + "I") for q in before if q in s)) if x) for r, before in (("u", ("", "s", "a")),) if any(q in s for q in (r, *before))}}
    after = lambda s: {**s, **({"a": min(x for x in (s.get("a"), (s["u"][0] + 3, s["u"][1] + "I")) if x)} if "u" in s else {})}
    for initial, fault in said:
        state = after(inserted(state))
        new = {}
        for q, (c, e) in state.items():
            moves = [(q, c + 4, e + "D")]
            more = 3 * (fault == "truncated")
            for r in ("s",) * (q == "") + ("u",) * (q != "u") + ("a",) * (q == "u"):
                if fault not in ("blank", "duplicate"):
                    moves += [(r, c + more, e + "K")] * (initial == r) + [(r, c + more + 3, e + "R")] * (r != "s")
            for r, cost, edits in moves:
                new[r] = min(new.get(r, (cost, edits)), (cost, edits))
        state = new
    state = after(inserted(state))
    cost, audit = min(state[q] for q in ("", "a") if q in state)
    out, last, i = [], "", 0
    for e in audit:
        if e in "DKR":
            _, role, text = rows[i]
            i += 1
        if e == "D":
            continue
        wanted = "assistant" if last == "u" else "user"
        out.append(f"{role}:{text}" if e == "K" else f"{wanted}:{text if e == 'R' else ''}")
        last = role[:1] if e == "K" else wanted[0]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.fixture(scope="module")
def chats(spark):
    random.seed(8)
    texts = ["Hi.", "What?", "no end", "", " \t", "Yes! ", "é\u2028", "ok.\n", "Same.", "Same."]
    rows = [(c, t if random.random() < 0.9 else None, random.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]), random.choice([*texts, None])) for c in range(60) for t in range(random.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"Text {t}." if t % 7 else "Again.") for t in range(700)]  # longer than the blocks of the test
    rows += [(501, 3, random.choice(["user", "assistant"]), f"{i % 5}!") for i in range(200)] + [(None, 1, "user", "x" * 100_000), (None, None, None, None)]
    rows += [(c, 0, "user", "Gone.") for c in range(600, 700) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, audit string, left boolean")


@pytest.mark.parametrize("most", [turn_repair.BLOCK, 16])
def test_turn_repair_is_brute_force(spark, chats, most):
    damaged = turn_repair.damaged(chats)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repaired(damaged, most).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    by = defaultdict(list)
    for r in damaged.collect():
        by[r.conv_id] += [(r.turn, r.role, r.text)] * r.left
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    want = {c: _plain_repair(sorted(rows, key=order)) for c, rows in by.items()}
    assert got == want and any(not rows for rows in by.values()) and len(got[500][6]) >= 600
    if most == 16:
        assert sorted(map(repr, oracle(turn_repair.oracle_sql(), conversations=chats.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})))) == sorted(map(repr, spark_rows(turn_repair.repaired(damaged, most))))
        assert turn_repair.repaired(turn_repair.damaged(chats.limit(0))).count() == 0


# 13


def _plain_counts(text):
    words = text.encode().split()
    return (len(text), len(words), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)), len(set(words))


def test_scans_of_buffers_are_plain_counts(monkeypatch):
    random.seed(4)
    parts = ["a", "B", " ", "\n", "é", "\u2028", "\U0001f600", "#", "|", "word", "Word", "longerword", "x" * 70, "x" * 71, "\x00", "\x1f", "\v"]
    texts = ["", " ", "a", "\n\na", "A" * 300, "ab " * 500] + ["".join(random.choices(parts, k=random.randint(0, 400))) for _ in range(300)]
    want = [_plain_counts(t) for t in texts]
    for piece in (filter_audit.PIECE, 64, 7):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        totals, distinct = filter_audit.counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert [(tuple(t), d) for t, d in zip(totals.tolist(), distinct.tolist(), strict=True)] == want


def test_words_whose_hashes_agree_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "_hashed", lambda padded, starts, ends: np.zeros(len(starts), np.uint64))
    raw = b"one two one three" + b"one two three four" + b"same same"
    _, distinct = filter_audit.counts(np.frombuffer(raw, np.uint8), np.array([0, 17, 35, 44]))
    assert distinct.tolist() == [3, 4, 1]


def test_filter_audit_is_brute_force(spark, hard, none):
    more = [(100 + i, t, p) for i, (t, p) in enumerate([("Same text", "en"), ("Same text", "de"), ("Same text", None), (None, "en"), ("", "en"), ("w" + " w" * 300, "en"), (" ".join(map(str, range(250))), "de")])] + [(None, "Same text", "en"), (100, "Same text", "en")]
    docs = hard.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string")).selectExpr("*", "1 AS good", "'x' AS part", "2 AS failed")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), 1) for i in (*range(0, 110), 7, 7)] + [(100, 1, None, 1), (None, 1, 1, 1)], "doc_id long, quality int, toxic int, n int")
    rows = [(r.doc_id, r.lang or "", r.text or "") for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = []
    for i, part, t in rows:
        (n, words, capitals, symbols), distinct = _plain_counts(t)
        own = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 3 * n, "D": symbols > 0, "E": i is not None and i > least[t]}
        fails.append((i, part, {f for f, x in own.items() if x}))
    want, removed_by = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        gone = set()
        for step, f in enumerate(order, 1):
            for part in {p for _, p, _ in fails}:
                mine = [k for k, (_, p, _) in enumerate(fails) if p == part]
                here = [k for k in mine if f in fails[k][2] and k not in gone]
                redundant = sum(f in fails[k][2] and k in gone for k in mine)
                gone |= set(here)
                want[part, order, step] = [sum(k not in gone for k in mine), len(here), redundant, sum(fails[k][2] == {f} for k in mine), sum(fails[k][0] in good for k in here), sum(fails[k][0] in toxic for k in here)]
                removed_by[part, f] += len(here)
    out = filter_audit.audit(docs, labels)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out.collect()}
    assert got == {k: [*v, removed_by[k[0], k[1][k[2] - 1]]] for k, v in want.items()} and len(got) == 600 * 3
    frames = {"documents": docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}), "labels": labels.toPandas().astype({"doc_id": "Int64", "toxic": "Int64"})}
    assert spark_rows(out) == oracle(filter_audit.oracle_sql(), **frames)
    assert filter_audit.audit(none, labels).count() == 0 and filter_audit.audit(docs, labels.limit(0)).count() == 1800
