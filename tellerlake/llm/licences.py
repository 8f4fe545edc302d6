"""Licence scan by a positional index of rare words; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a notice that count for its score, how far apart the words of a file may stand from where the notice has them.
INDEX_WORDS, SLACK = 4, 2
#: Least share of the index words' weight that has to stand at its place.
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Notice:
    """A wording of a licence; every one of its key phrases has to stand at its place."""

    label: str
    text: str
    keys: tuple[str, ...]
    slack: int = SLACK
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    def places(self, key: str) -> tuple[int, list[str]]:
        """(place, words) of a key phrase in the notice."""
        words = key.split(" ")
        return next(i for i in range(len(self.words)) if self.words[i : i + len(words)] == words), words


def phrase(label: str, text: str, base: bool = True) -> Notice:
    return Notice(label, text, (text,), 0, base)


#: Fixed phrases of the licence query.
BASE = (phrase("gpl", "gnu general public license"), phrase("apache", "apache license"), phrase("cc-by", "cc by"), phrase("mit", "mit license"))
_FREE = ("this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published "
         "by the free software foundation either version {1} of the license or at your option any later version")
#: Usual wordings of notices; the labels are names of licences with their versions.
NOTICES = (
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Notice("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Notice("gpl-2.0-or-later", _FREE.format("", "2"), ("free software", "gnu general public license", "version 2", "any later version")),
    Notice("gpl-3.0-or-later", _FREE.format("", "3"), ("free software", "gnu general public license", "version 3", "any later version")),
    Notice("lgpl", _FREE.format("lesser ", "3"), ("free software", "gnu lesser general public license")),
    Notice("agpl", _FREE.format("affero ", "3"), ("free software", "gnu affero general public license")),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Notice("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
           ("permission is hereby granted", "free of charge")),
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
           ("redistribution and use", "source and binary forms", "conditions are met")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
           ("permission to use", "with or without fee is hereby granted")),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license")),
    Notice("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Notice("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Notice("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Notice("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Notice("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    phrase("all-rights-reserved", "all rights reserved", base=False),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case: letters, digits and everything beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, text: str, notices: Sequence[Notice]) -> dict[str, int]:
    """Inverse document frequency, floor((rows + 1) / (rows with the word + 1)), of every word of the notices; all rows count."""
    vocabulary = sorted({w for n in notices for w in n.words})
    seen = F.array_intersect(words_of(F.col(text)), F.array(*[F.lit(w) for w in vocabulary]))
    counts = docs.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}  # one row for each word of the notices
    rows = docs.count()
    return {w: (rows + 1) // (found.get(w, 0) + 1) for w in vocabulary}


def postings(notice: Notice, idf: dict[str, int]) -> tuple[tuple[int, str], list[tuple[int, str]]]:
    """((place, word) that leads to the notice, its index words): the rarest word of the key phrases, the rarest of all words."""
    def rarest(places: list[tuple[int, str]]) -> list[tuple[int, str]]:
        return sorted(places, key=lambda p: (-idf[p[1]], p[1], p[0]))

    key_words = [(q + i, w) for q, words in map(notice.places, notice.keys) for i, w in enumerate(words)]
    return rarest(key_words)[0], rarest(list(enumerate(notice.words)))[:INDEX_WORDS]


def index(notices: Sequence[Notice], idf: dict[str, int]) -> Column:
    """The notices with their postings, as one constant."""
    def entry(n: Notice) -> Column:
        (place, word), rare = postings(n, idf)
        keys = [F.struct(F.lit(q).alias("q"), F.array(*map(F.lit, words)).alias("words")) for q, words in map(n.places, n.keys)]
        rare_words = [F.struct(F.lit(q).alias("q"), F.lit(w).alias("word"), F.lit(idf[w]).cast("long").alias("weight")) for q, w in rare]
        return F.struct(F.lit(n.label).alias("label"), F.lit(n.base).alias("base"), F.lit(n.slack).alias("slack"), F.lit(word).alias("lead"), F.lit(place).alias("at"),
                        F.array(*keys).alias("keys"), F.array(*rare_words).alias("rare"), F.lit(sum(idf[w] for _, w in rare)).cast("long").alias("total"))

    return F.array(*[entry(n) for n in notices])


def alignments(words: Column, notices: Column, leads: list[str]) -> Column:
    """Places where a notice fits: array of (start, label, base, share)."""
    zero = F.lit(0)

    def key_stands(n: Column, start: Column, key: Column) -> Column:
        def at(shift: Column) -> Column:
            place = start + key["q"] + shift
            return (place >= 0) & (F.slice(words, F.greatest(place, zero) + 1, F.size(key["words"])) == key["words"])

        return F.exists(F.sequence(-n["slack"], n["slack"]), at)

    def weight(n: Column, start: Column, rare: Column) -> Column:
        place = start + rare["q"] - n["slack"]
        near = F.slice(words, F.greatest(place, zero) + 1, F.greatest(2 * n["slack"] + 1 + F.least(place, zero), zero))
        return F.when(F.array_contains(near, rare["word"]), rare["weight"]).otherwise(F.lit(0).cast("long"))

    def fit(hit: Column, n: Column) -> Column:
        start = hit - n["at"]
        stands = F.aggregate(n["rare"], F.lit(0).cast("long"), lambda sum_, r: sum_ + weight(n, start, r))
        keys = F.forall(n["keys"], lambda k: key_stands(n, start, k))
        return F.struct(start.alias("start"), n["label"].alias("label"), n["base"].alias("base"),
                        F.when(keys, stands.cast("double") / n["total"].cast("double")).alias("share"))

    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(leads), i)))
    near = F.transform(hits, lambda h: F.transform(F.filter(notices, lambda n: n["lead"] == F.get(words, h)), lambda n: fit(h, n)))
    return F.filter(F.flatten(near), lambda a: a["share"] >= LEAST_SHARE)


def scan(docs: DataFrame, keep: list[str], text: str = "text", notices: Sequence[Notice] = (*BASE, *NOTICES)) -> DataFrame:
    """The columns ``keep`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and places.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII. The index has, for
    each notice, the rarest word of its key phrases with its place, by frequency in all rows; such words of a file
    lead to the notices, and word and posting give the place where the notice would start. It fits if all its key
    phrases stand at their places, up to ``slack`` words apart, and of its rarest words those that weigh half or more;
    their share is the alignment's. Base notices have no slack and are one key phrase, so each of their places is
    found, overlapping ones too. n_base counts these places, first_word and last_word are the smallest and largest
    start (null without one); base_labels and labels are distinct, sorted and joined by commas, empty without one;
    score is the largest share, 0.0 without a fit; places lists every fit (start, label, base, share).

    A null or empty text has no words. Rows are judged one by one, so repeated rows have equal results; equal rarity
    is settled by the word, then its place. An empty table gives no rows. Clashing names in ``keep`` are replaced.
    """
    idf = rarity(docs, text, notices)
    leads = sorted({postings(n, idf)[0][1] for n in notices})
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    rows = docs.select(*[c for c in keep if c not in made], words_of(F.col(text)).alias("_li_words"))
    rows = rows.withColumn("places", alignments(F.col("_li_words"), index(notices, idf), leads))
    base = F.filter("places", lambda a: a["base"])
    starts = F.transform(base, lambda a: a["start"].cast("long"))

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda a: a["label"]))), ",")

    return rows.select(
        *[c for c in keep if c not in made], F.size("_li_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda a: a["share"])), F.lit(0.0)).alias("score"), "places")


def scan_sql(notices: Sequence[Notice] = (*BASE, *NOTICES)) -> str:
    """The same in DuckDB, for doc_id and text of ``documents``."""
    def row(*values) -> str:
        return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"

    def words(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    heads = ", ".join(row(t, n.label, str(n.base).lower() == "true", n.slack) for t, n in enumerate(notices))
    keyed = [{q + i for q, ws in map(n.places, n.keys) for i in range(len(ws))} for n in notices]
    every = ", ".join(row(t, q, w, q in keyed[t]) for t, n in enumerate(notices) for q, w in enumerate(n.words))
    keys = ", ".join(f"({t}, {k}, {q}, {words(ws)})" for t, n in enumerate(notices) for k, (q, ws) in enumerate(map(n.places, n.keys)))
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
notices(t, label, base, slack) AS (VALUES {heads}),
template(t, q, word, keyed) AS (VALUES {every}),
keys(t, k, q, ws) AS (VALUES {keys}),
spread AS MATERIALIZED (SELECT r, word, p FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) WHERE word IN (SELECT word FROM template)),
seen AS (SELECT word, count(DISTINCT r) AS n FROM spread GROUP BY word),
weighed AS (SELECT t, q, template.word, keyed, ((SELECT count(*) FROM d) + 1) // (coalesce(n, 0) + 1) AS idf FROM template LEFT JOIN seen USING (word)),
leads AS (SELECT t, q AS led, word FROM weighed WHERE keyed QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, word, q) = 1),
rare AS (SELECT t, q, word, idf FROM weighed QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, word, q) <= {INDEX_WORDS}),
totals AS (SELECT t, sum(idf) AS total FROM rare GROUP BY t),
starts AS MATERIALIZED (SELECT r, t, CAST(p - led AS BIGINT) AS origin, slack FROM spread JOIN leads USING (word) JOIN notices USING (t)),
stand AS (SELECT DISTINCT s.r, s.t, s.origin, k.k FROM starts s JOIN keys k USING (t) JOIN d USING (r), (SELECT unnest(range(-{SLACK}, {SLACK} + 1)) AS shift)
  WHERE abs(shift) <= slack AND origin + k.q + shift >= 0 AND w[origin + k.q + shift + 1:origin + k.q + shift + len(ws)] = ws),
fitting AS (SELECT r, t, origin FROM stand GROUP BY r, t, origin HAVING count(*) = (SELECT count(*) FROM keys WHERE keys.t = stand.t)),
weights AS (SELECT f.r, f.t, f.origin, sum(CASE WHEN EXISTS (SELECT 1 FROM spread x WHERE x.r = f.r AND x.word = rare.word AND abs(x.p - f.origin - rare.q) <= slack) THEN idf ELSE 0 END) AS stands
  FROM fitting f JOIN rare USING (t) JOIN notices USING (t) GROUP BY f.r, f.t, f.origin),
fits AS (SELECT r, origin, label, base, CAST(stands AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM weights JOIN totals USING (t) JOIN notices USING (t)
  WHERE CAST(stands AS DOUBLE) / CAST(total AS DOUBLE) >= {LEAST_SHARE}),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(origin) FILTER (base) AS first_word, max(origin) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM fits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN found USING (r)
"""
