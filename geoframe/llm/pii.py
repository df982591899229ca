r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four kinds of entities with a form of their own (email, ip, card, phone) are found by pattern and check; they are the seeds.
The word before and the word after an entity are its lexical patterns.  Strings that look like identifiers (CANDIDATE) and overlap no entity
stand in such contexts too.  Patterns and instances (the strings) make a bipartite graph that Spark scores in ROUNDS rounds: a
pattern's confidence is the summed score of its instances over their number plus 1, where seeds score 1; a pattern counts if at least
SUPPORT different accepted instances vouch for it, that is seeds and those that reached CONFIDENCE in the round before; an instance that is no
seed gets the mean confidence of its patterns that count.  So an identifier found in one round can vouch for a new pattern in the
next, which finds others that no seed ever stood beside.  Instances that reach CONFIDENCE at the end are identifiers, wherever they
stand.

Positions come from cutting a text at its matches: a match starts after all earlier gaps and matches, in code points.
All patterns start at the border of a run, or where the last match ended, and never backtrack into it, so a run of any length costs one pass.

Defined results: a null or empty text has no spans; overlapping spans of different kinds all count; repeated rows give
repeated rows; the context is what the 64 code points before and after hold; an empty table gives an empty table;
columns other than the two named ones are ignored by find() and kept by mask().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import ascii_lower, delete_written, written
from geoframe.llm.license_scan import BREAKS

KINDS = ("email", "ip", "card", "phone")
#: The same languages as the plain patterns [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on, but possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all; the last one is cheap where digits are rare.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
CONTEXT, ROUNDS, SUPPORT, CONFIDENCE = 64, 3, 5, 0.8
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _let(value: Column, body) -> Column:
    """body of value, evaluated once; an expression inside a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All leftmost non-overlapping matches with their places. Gaps and matches are added up inside blocks of 256 and then over the
    blocks, so that no long array is copied for each element."""
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    cut = F.transform(F.filter(cut, lambda z: z["m"].isNotNull()), lambda z: F.struct(F.length(z["g"]).alias("g"), F.length(z["m"]).alias("n"), z["m"].alias("m")))
    zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<start:int,n:int,m:string>>").alias("a"))

    def add(t: Column, x: Column) -> Column:
        at = F.struct((t["s"] + x["g"]).alias("start"), x["n"].alias("n"), x["m"].alias("m"))
        return F.struct((t["s"] + x["g"] + x["n"]).alias("s"), F.concat(t["a"], F.array(at)).alias("a"))

    def blocks(pairs: Column) -> Column:
        numbers = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / 256).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: F.aggregate(F.slice(pairs, b * 256 + 1, F.lit(256)), zero, add))

    def whole(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        starts = F.aggregate(parts, first, lambda t, b: F.struct((t["s"] + b["s"]).alias("s"), F.concat(t["a"], F.array(t["s"])).alias("a")), lambda t: t["a"])
        return F.flatten(F.transform(F.arrays_zip(parts.alias("b"), starts.alias("o")), lambda z: F.transform(z["b"]["a"], lambda x: span(x, z["o"]))))

    def span(x: Column, offset: Column) -> Column:
        start = x["start"] + offset
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("value"))

    return _let(_let(cut, blocks), whole).cast(_SPANS)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        def digit(i: Column) -> Column:
            d = F.substring(digits, n - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + digit(i))
        return F.when(n.between(14, 19), luhn % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind."""
    none = F.array().cast(_SPANS)

    def of(kind: str, rank: int) -> Column:
        return F.when(text.rlike(NEEDED[kind]), F.filter(_matches(text, PATTERNS[kind], kind, rank), lambda s: _valid(kind, s["value"]))).otherwise(none)

    return F.array_sort(F.concat(*(of(k, i) for i, k in enumerate(KINDS))))


def _word(text: Column, start: Column, stop: Column, at: int) -> Column:
    words = F.filter(F.split(ascii_lower(F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))), BREAKS, -1), lambda w: w != "")
    return F.try_element_at(words, F.lit(at))


def occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, same (a hash of the text, so that id and same name a text), base spans, and candidates with contexts: array of
    (start, stop, value, seed, before, after), where the base spans are there as seeds."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", "t", F.xxhash64("t").alias("same"), F.when(F.col("t").rlike("[0-9@]"), base_spans(F.col("t"))).otherwise(F.array().cast(_SPANS)).alias("base"))
    t = F.col("t")

    def free(base: Column) -> Column:
        return F.filter(_matches(t, CANDIDATE, "id", len(KINDS)), lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))

    def seen(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), (s["rank"] < len(KINDS)).alias("seed"), _word(t, low, s["start"], -1).alias("before"), _word(t, s["stop"], s["stop"] + CONTEXT, 1).alias("after"))

    kind = "array<struct<start:int,stop:int,value:string,seed:boolean,before:string,after:string>>"
    both = F.when((F.size("base") > 0) | t.rlike("[0-9]"), _let(F.col("base"), lambda base: F.transform(F.concat(base, free(base)), seen))).otherwise(F.array().cast(kind))
    return rows.select("id", "same", "base", both.alias("seen"))


def discovered(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """id, same, ids: the spans of identifiers that the scored graph of patterns and instances tells, for texts that have any."""
    each = found.select("id", "same", F.explode("seen").alias("o")).select("id", "same", "o.*")
    contexts = F.filter(F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after")), lambda p: p.isNotNull())
    edges = written(each.select("value", "seed", F.explode(contexts).alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-sizes")
    score = written(edges.where("seed").select("value").distinct().select("value", F.lit(True).alias("seed"), F.lit(1.0).alias("score")), "pii-score")
    for _ in range(rounds):
        # Instances that score nothing add nothing: a pattern's size is known, so only the others are joined.
        met = edges.select("pattern", "value").join(score, "value").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count(F.when(F.col("score") >= confidence, 1)).alias("sure"))
        sure = met.where(F.col("sure") >= support).join(sizes, "pattern").select("pattern", (F.round("sum", 9) / (F.col("n") + 1)).alias("confidence"))
        found_now = edges.where("NOT seed").join(sure, "pattern").groupBy("value").agg(F.round(F.avg("confidence"), 9).alias("mean"))
        seeds = score.where("seed")
        new = found_now.join(seeds.select("value"), "value", "left_anti").select("value", F.lit(False).alias("seed"), F.col("mean").alias("score"))
        last, score = score, written(seeds.unionByName(new), "pii-score")
        delete_written(last)
    delete_written(sizes)
    good = score.where((F.col("score") >= confidence) & ~F.col("seed")).select("value")
    spans = each.where("NOT seed").join(good, "value", "left_semi").select("id", "same", F.struct("start", F.lit(len(KINDS)).alias("rank"), "stop", F.lit("id").alias("kind"), "value").alias("s")).distinct()
    return spans.groupBy("id", "same").agg(F.array_sort(F.collect_list("s")).cast(_SPANS).alias("ids"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (spans of the four kinds) and spans (those and the discovered identifiers), a row for each row of df."""
    found = written(occurrences(df, id_col, text_col), "pii-found")
    ids = discovered(found).select(F.col("id").alias("__id"), F.col("same").alias("__same"), "ids")
    out = found.join(ids, F.col("id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same")), "left")
    return out.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("ids", F.array().cast(_SPANS)))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of find(): how many of each kind, a digest of the base spans and the list of all."""

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select(id_col, *map(count, range(len(KINDS))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind (the first one's) in angle brackets."""
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        now = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))
        return F.when(F.size(done) == 0, F.array(now)).when(s["start"] < last["stop"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(now)))

    def cut(runs: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
        pieces = F.transform(F.arrays_zip(runs.alias("r"), F.slice(ends, F.lit(1), F.size(runs)).alias("e")), lambda z: F.concat(F.substring(text, z["e"] + 1, z["r"]["start"] - z["e"]), F.lit("<"), F.upper(z["r"]["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return _let(F.aggregate(spans, none, add), cut)


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every span that find() tells masked in text_col; rows without digits or @ go past all joins."""
    rows = df.withColumn("__may", F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False)))
    plain, some = rows.where("NOT __may").drop("__may"), rows.where("__may").drop("__may")
    ids = written(discovered(written(occurrences(some, id_col, text_col), "pii-found")), "pii-ids").select(F.col("id").alias("__id"), F.col("same").alias("__same"), F.col("ids").alias("__ids"))
    told = some.join(ids, some[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__same")), "left")
    spans = F.array_sort(F.concat(base_spans(F.col(text_col)), F.coalesce("__ids", F.array().cast(_SPANS))))
    told = told.withColumn("__spans", spans)
    text = F.when(F.size("__spans") > 0, masked(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return told.withColumn(text_col, text).select(*df.columns).unionByName(plain)


#: The patterns as written for an engine that never backtracks; candidates are runs of six or more that hold a digit.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"[A-Za-z0-9_-]{6,}",
}


def oracle_sql(rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> str:
    """DuckDB SQL for report(find(documents))."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all(" + lower + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    cut = " UNION ALL ".join(
        f"SELECT r, t, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS g FROM docs WHERE regexp_matches(t, '{p}')" for i, (k, p) in enumerate(PLAIN.items())
    )
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({digits}[length({digits}) - i] AS INTEGER) WHEN CAST({digits}[length({digits}) - i] AS INTEGER) > 4 THEN 2 * CAST({digits}[length({digits}) - i] AS INTEGER) - 9 ELSE 2 * CAST({digits}[length({digits}) - i] AS INTEGER) END)) % 10 = 0"
    octets = "len(list_filter(string_split(value, '.'), lambda p: NOT regexp_matches(regexp_replace(p, '^0+', ''), '^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0"
    steps, score = [], "score0"
    for k in range(1, rounds + 1):
        steps.append(f"sure{k} AS (SELECT pattern, round(sum(score), 9) / (count(*) + 1) AS sure FROM edges JOIN {score} USING (value) GROUP BY pattern HAVING count(*) FILTER (score >= {confidence}) >= {support})")
        steps.append(f"score{k} AS (SELECT value, CASE WHEN bool_or(seed) THEN 1.0 ELSE coalesce(round(avg(sure), 9), 0.0) END AS score FROM edges LEFT JOIN sure{k} USING (pattern) GROUP BY value)")
        score = f"score{k}"
    listed = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(KINDS))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({cut}),
places AS (SELECT r, t, rank, kind, unnest(m) AS value, unnest(range(len(m))) AS i, g, list_transform(m, lambda x: length(x)) AS l FROM cut),
found AS (SELECT r, t, rank, kind, value, CAST(list_sum(g[1:i + 1]) + coalesce(list_sum(l[1:i]), 0) AS BIGINT) AS start FROM places),
spans AS (SELECT r, t, rank, kind, value, start, start + length(value) AS stop FROM found),
base AS (SELECT * FROM spans WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN {octets}
  WHEN 'card' THEN length({digits}) BETWEEN 14 AND 19 AND {luhn} WHEN 'phone' THEN length({digits}) BETWEEN 10 AND 15 ELSE false END),
free AS (SELECT * FROM spans s WHERE kind = 'id' AND regexp_matches(value, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s.stop AND s.start < b.stop)),
seen AS (SELECT r, start, stop, value, rank < {len(KINDS)} AS seed, substring(t, greatest(start - {CONTEXT}, 0) + 1, start - greatest(start - {CONTEXT}, 0)) AS b, substring(t, stop + 1, {CONTEXT}) AS a
  FROM (SELECT * FROM base UNION ALL SELECT * FROM free)),
contexts AS (SELECT value, seed, unnest([CASE WHEN len({words.format("b")}) > 0 THEN '<' || {words.format("b")}[-1] END, CASE WHEN len({words.format("a")}) > 0 THEN '>' || {words.format("a")}[1] END]) AS pattern FROM seen),
edges AS (SELECT pattern, value, bool_or(seed) AS seed FROM contexts WHERE pattern IS NOT NULL GROUP BY ALL),
score0 AS (SELECT value, CASE WHEN bool_or(seed) THEN 1.0 ELSE 0.0 END AS score FROM edges GROUP BY value),
{", ".join(steps)},
ids AS (SELECT DISTINCT r, {len(KINDS)} AS rank, 'id' AS kind, start, stop FROM seen WHERE NOT seed AND value IN (SELECT value FROM {score} WHERE score >= {confidence})),
per AS (SELECT r, {counts}, string_agg({listed}, ',' ORDER BY start, rank) AS l FROM base GROUP BY r),
whole AS (SELECT r, string_agg({listed}, ',' ORDER BY start, rank) AS l FROM (SELECT r, rank, kind, start, stop FROM base UNION ALL SELECT * FROM ids) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(per.l, '')) AS base_sha256, coalesce(whole.l, '') AS spans
FROM docs LEFT JOIN per USING (r) LEFT JOIN whole USING (r)"""
