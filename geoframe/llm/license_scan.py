"""Licence scans with a positional index of rare licence words, in DataFrame functions only.

A template is a run of words with a label and one mandatory key phrase inside it.  The index maps each licence word to its
postings, the templates and places it stands at, and to its inverse document frequency, for which a first pass counts in how many documents each licence
word occurs.  A second pass finds the places of a file's licence words and takes these words from the rarest on: a word looks up its postings
in those templates of which it is the rarest word of the key phrase that is left, and each of its places in the file, less its place in the
template, is where the template would start.  These starts are intersected with the postings of the phrase's other words by relative
position, the rarer ones first, and a match counts only if the whole key phrase is in place.  A file without a phrase's rarest word
cannot hold the phrase, so nothing is lost.  Index and templates are one constant, and the plan is the same for any number of templates.
Nothing is shuffled but one count for each licence word and task.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows give repeated
rows; overlapping places all count; an empty table gives an empty table; columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.common import ascii_lower

#: What separates words once A-Z are lower-case: every ASCII character but digits and a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    start: int
    stop: int
    base: bool

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.start : self.stop]


def template(label: str, text: str, phrase: str, base: bool = False) -> Template:
    words, key = tuple(text.split()), tuple(phrase.split())
    start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return Template(label, words, start, start + len(key), base)


BASE = (
    template("mit", "mit license", "mit license", True),
    template("apache", "apache license", "apache license", True),
    template("gpl", "general public license", "general public license", True),
)
#: Sentences of licences, each with the phrase that must be there word by word. Fixed values, as the licences have them.
OWN = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions"),
    template("mit-named", "released under the mit license", "the mit license"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-later", "either version 2 of the license or at your option any later version", "at your option any later version"),
    template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    template("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    template("eupl", "licensed under the european union public licence", "european union public licence"),
    template("cddl", "the terms of the common development and distribution license", "common development and distribution license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors may be used to endorse"),
    template("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising materials mentioning features or use of this software"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    template("artistic", "under the terms of the artistic license 2 0", "artistic license"),
    template("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    template("psf", "python software foundation license version 2", "python software foundation license"),
    template("postgresql", "released under the postgresql license", "postgresql license"),
    template("ms-pl", "licensed under the microsoft public license", "microsoft public license"),
    template("wtfpl", "do what the fuck you want to public license", "want to public license"),
    template("json", "the software shall be used for good not evil", "used for good not evil"),
    template("sspl", "licensed under the server side public license version 1", "server side public license"),
    template("busl", "licensed under the business source license 1 1", "business source license"),
    template("elastic", "licensed under the elastic license 2 0", "elastic license"),
    template("odbl", "made available under the open database license", "open database license"),
    template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    template("cc-by", "licensed under creative commons attribution 4 0", "creative commons attribution"),
    template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    template("reserved", "copyright all rights reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """The words of the whole text, lower-cased, in order."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, -1), lambda w: w != "")


def document_frequencies(df: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of df, and in how many each word of the (fixed) vocabulary occurs."""
    found = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))
    counts = df.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counts}
    return n.get("", 0), {w: n.get(w, 0) for w in vocabulary}


def weights(rows: int, frequencies: dict[str, int]) -> dict[str, float]:
    return {w: math.log((rows + 1) / (n + 1)) + 1 for w, n in frequencies.items()}


#: A posting names a template by its number t, with the place p of the word in it. A template: its key phrase's words and all its words, each
#: with place q and weight, the rarest first, where its key phrase starts, and the weight of all its words.
_WORDS = "array<struct<q:int,word:string,weight:double>>"
_INDEX = f"struct<words:map<string,array<struct<t:int,p:int>>>,templates:array<struct<label:string,base:boolean,start:int,total:double,key:{_WORDS},all:{_WORDS}>>>"


def index(templates: tuple[Template, ...], idf: dict[str, float]) -> tuple[list[str], Column]:
    """The words that files are looked up by, and the index as a constant. A template is posted under its key phrase's word of the
    highest weight: a file that holds the phrase holds that word, at each of the phrase's places."""
    words: dict[str, list] = {}
    listed = []
    for i, t in enumerate(templates):
        # Weights are of all files, so that of a file's licence words the rarest of a phrase is the same in every file that can hold it.
        by_weight = sorted(range(len(t.words)), key=lambda q, t=t: (-idf[t.words[q]], t.words[q], q))
        row = [{"q": q, "word": t.words[q], "weight": idf[t.words[q]]} for q in by_weight]
        key = [r for r in row if t.start <= r["q"] < t.stop]
        words.setdefault(key[0]["word"], []).append({"t": i, "p": key[0]["q"]})
        listed.append({"label": t.label, "base": t.base, "start": t.start, "total": sum(r["weight"] for r in row), "key": key, "all": row})
    return sorted(words), F.from_json(F.lit(json.dumps({"words": words, "templates": listed})), F.lit(_INDEX))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + OWN) -> DataFrame:
    """id_col, n_words, places: array of (label, base, start, score), one for each place where a template's key phrase
    stands: start is the place of its first word, score the share of the template that is there, by weight."""
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = weights(*document_frequencies(df, text_col, vocabulary))
    anchors, constant = index(templates, idf)
    w = F.col("w")

    def stands(start: Column, x: Column) -> Column:
        return F.coalesce(F.get(w, start + x["q"]) == x["word"], F.lit(False))

    def looked_up(hit: Column) -> Column:
        """(t, s) of each posting of the word at a place."""
        return F.transform(constant["words"][hit["word"]], lambda x: F.struct(x["t"].alias("t"), (hit["i"] - x["p"]).alias("s")))

    def place(c: Column) -> Column:
        t = F.get(constant["templates"], c["t"])
        held = F.aggregate(t["all"], F.lit(0.0), lambda a, x: a + F.when(stands(c["s"], x), x["weight"]).otherwise(F.lit(0.0)))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), (c["s"] + t["start"]).cast("long").alias("start"), F.round(held / t["total"], 6).alias("score"))

    rare = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), F.struct(i.alias("i"), x.alias("word")))), lambda h: h.isNotNull())
    met = F.filter(F.flatten(F.transform("hits", looked_up)), lambda c: F.forall(F.get(constant["templates"], c["t"])["key"], lambda x: stands(c["s"], x)))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    rows = df.select(F.col(id_col), words_of(F.col(text_col)).alias("w"))
    rows = rows.select(id_col, "w", rare.alias("hits"))
    return rows.select(id_col, F.size("w").cast("long").alias("n_words"), F.when(F.size("hits") > 0, F.transform(met, place)).otherwise(none).alias("places"))


def labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of scan(): counts, first and last place of the base phrases, labels and the best score."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(F.col("b"), lambda p: p["start"])
    rows = scanned.select(id_col, "n_words", "places", base.alias("b"))
    return rows.select(
        id_col, "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("b")).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("places"), lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def _text(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle_sql(templates: tuple[Template, ...] = BASE + OWN) -> str:
    """DuckDB SQL for report(scan(documents)): every posting of every word, joined and grouped by relative position."""
    rows = ",\n".join(f"({i}, '{t.label}', {_text(t.words)}, {t.start}, {t.stop}, {str(t.base).lower()})" for i, t in enumerate(templates))
    return rf"""
WITH templates(t, label, words, p0, p1, base) AS (VALUES {rows}),
postings AS (SELECT t, label, p0, p1, base, unnest(words) AS word, unnest(range(len(words))) AS p FROM templates),
docs AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
hits AS (SELECT * FROM tokens WHERE word IN (SELECT word FROM postings)),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM docs) + 1) / (count(DISTINCT h.r) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT word FROM postings) v LEFT JOIN hits h ON h.word = v.word GROUP BY v.word),
total AS (SELECT t, sum(idf) AS total FROM postings JOIN idf USING (word) GROUP BY t),
found AS (SELECT r, t, label, base, h.i - p AS s, h.i - p + p0 AS start, sum(idf.idf) AS held
  FROM hits h JOIN postings USING (word) JOIN idf USING (word) GROUP BY ALL
  HAVING count(*) FILTER (p >= p0 AND p < p1) = max(p1 - p0)),
places AS (SELECT r, label, base, start, round(held / total, 6) AS score FROM found JOIN total USING (t)),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  list(DISTINCT label) FILTER (base) AS bl, list(DISTINCT label) AS l, max(score) AS score FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(l), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN per USING (r)"""
