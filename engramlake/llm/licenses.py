"""License scans by a positional rare-token index, in DataFrame functions only.

A template is a license label with mandatory key phrases. One pass over all documents counts in how many of them each word
of the phrases stands (as a string; a number for each of these words comes back), which gives the words' IDF. The index
posts, for each key phrase, its two words of highest IDF with their place in it. A file's words are looked up in the
index; a posting turns the word's place into the place where its phrase would begin; places that both words of a phrase
agree on are candidates; a candidate counts once the whole phrase is read there. A template's label is given when all its
phrases are found; its score is the IDF-weighted share of its phrases found.

A scan happens within a file's row: no shuffle, so no source or group of copies can make one task large.
Only files with a word that every phrase needs one of are split into places.

Null and empty texts have no words, places or labels and score 0. Rows are independent, so repeated rows and repeated
ids give repeated results. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    phrases: tuple[str, ...]
    base: bool = False


# Names of licenses and phrases that their texts hold.
TEMPLATES = (
    Template("mit", ("mit license",), True),
    Template("apache", ("apache license",), True),
    Template("gpl", ("general public license",), True),
    Template("mit-text", ("permission is hereby granted free of charge to any person", "the software is provided as is")),
    Template("apache-2.0", ("apache license version 2 0",)),
    Template("apache-text", ("licensed under the apache license", "you may not use this file except in compliance with the license", "without warranties or conditions of any kind")),
    Template("gpl-2.0", ("gnu general public license version 2",)),
    Template("gpl-3.0", ("gnu general public license version 3",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("bsd", ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    Template("bsd-name", ("bsd license",)),
    Template("mpl", ("mozilla public license",)),
    Template("epl", ("eclipse public license",)),
    Template("gpl-text", ("you can redistribute it and or modify", "under the terms of the gnu", "without any warranty")),
    Template("isc", ("permission to use copy modify and or distribute this software for any purpose", "the software is provided as is")),
    Template("unlicense", ("free and unencumbered software released into the public domain",)),
    Template("cc-by", ("licensed under cc by",)),
    Template("cc-by-nc", ("cc by nc",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("cc-by-nd", ("cc by nd",)),
    Template("cc-name", ("creative commons attribution",)),
    Template("cc0", ("cc0 1 0 universal",)),
    Template("rights-reserved", ("all rights reserved",)),
)


class PositionalIndex:
    """Postings of the two rarest words of each key phrase; counts: by word, how many of n documents have it."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, n: int = 0, counts: dict[str, int] | None = None):
        self.templates = tuple(templates)
        self.phrases = list(dict.fromkeys(p for t in self.templates for p in t.phrases))
        if any(len(p.split(" ")) < 2 for p in self.phrases):
            raise ValueError("a key phrase has two words at least")
        self.vocabulary = sorted({w for p in self.phrases for w in p.split(" ")})
        self.idf = {w: math.log(1 + (n + 1) / (1 + (counts or {}).get(w, 0))) for w in self.vocabulary}
        #: by phrase: the places of its rarest and of its second rarest word
        self.rare = [tuple(sorted(range(len(ws := p.split(" "))), key=lambda i: (-self.idf[ws[i]], i))[:2]) for p in self.phrases]
        self.words = sorted({p.split(" ")[i] for p, r in zip(self.phrases, self.rare) for i in r})

    def weight(self, phrase: str) -> float:
        return sum(self.idf[w] for w in phrase.split(" "))

    def postings(self, nth: int) -> Column:
        """By word: (phrase, place) of the phrases whose nth rarest word it is."""
        of = {w: [] for w in self.words}
        for k, (p, r) in enumerate(zip(self.phrases, self.rare)):
            of[p.split(" ")[r[nth]]].append(f"named_struct('phrase', {k}L, 'at', {r[nth]}L)")
        return F.expr("array(" + ", ".join(f"array({', '.join(x)})" if x else "cast(array() as array<struct<phrase: bigint, at: bigint>>)" for x in of.values()) + ")")

    def gate(self, low: Column) -> Column:
        """Whether a lower-cased text may hold a key phrase: the rarest word of one stands in it, and of phrases whose rarest
        word is short all words in turn."""
        may, rarest = F.lit(False), {p: p.split(" ")[r[0]] for p, r in zip(self.phrases, self.rare)}
        long = {w for w in rarest.values() if len(w) > 4}
        for word in sorted(w for w in long if not any(v != w and v in w for v in long)):
            may |= low.contains(word)
        for p, word in rarest.items():
            if len(word) <= 4:
                may |= low.contains(word) & low.rlike(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split(" ")))
        return may


BITS = 32  # of a place in a text


def counted(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> PositionalIndex:
    """The index with the words' document frequencies in all of docs."""
    words = PositionalIndex(templates).vocabulary
    low = docs.select(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    row = low.agg(F.count("*"), *(F.count_if(F.col("low").contains(w)) for w in words)).first()
    return PositionalIndex(templates, row[0], dict(zip(words, row[1:])))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (array of struct<phrase, start>: all verified key phrases), n_base, first_word, last_word,
    base_labels, labels, score."""
    index = counted(docs, templates)
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)  # only to see whether a word may be there
    number = F.create_map(*(F.lit(x) for k, w in enumerate(index.words) for x in (w, k)))

    df = docs.select("doc_id", text.alias("text"), index.gate(low).alias("gate"))
    words = F.when(F.col("gate"), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)))
    df = df.select("doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), words.alias("words"))
    # The index words of the file: number of the word and its place, in one long.
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(index.words), F.shiftleft(number[w].cast("long"), BITS) + i)))
    df = df.withColumn("hits", hits)

    def votes(nth: int) -> Column:
        """Where phrases would begin, going by their nth rarest word: number of the phrase and place, in one long."""
        lists = index.postings(nth)
        return F.flatten(
            F.transform(
                "hits",
                lambda h: F.transform(
                    F.filter(lists[F.shiftright(h, BITS).cast("int")], lambda p: p["at"] <= _place(h)),
                    lambda p: F.shiftleft(p["phrase"], BITS) + (_place(h) - p["at"]),
                ),
            )
        )

    df = df.withColumn("agreed", F.array_intersect(votes(0), votes(1)))
    texts = F.array(*(F.array(*map(F.lit, p.split(" "))) for p in index.phrases))
    phrase = lambda c: texts[F.shiftright(c, BITS).cast("int")]
    whole = F.filter("agreed", lambda c: F.slice(F.col("words"), (_place(c) + 1).cast("int"), F.size(phrase(c))) == phrase(c))
    df = df.select("doc_id", "n_words", F.coalesce(whole, F.array().cast("array<bigint>")).alias("whole"))
    df = df.withColumn("found", F.array_distinct(F.transform("whole", lambda c: F.shiftright(c, BITS).cast("int"))))

    base = [t for t in index.templates if t.base]
    base_no = [index.phrases.index(p) for t in base for p in t.phrases]
    starts = F.transform(F.filter("whole", lambda c: F.shiftright(c, BITS).cast("int").isin(base_no)), _place)
    has = lambda p: F.array_contains("found", index.phrases.index(p)) if p in index.phrases else F.lit(False)

    def complete(t: Template) -> Column:
        every = F.lit(True)
        for p in t.phrases:
            every &= has(p)
        return F.when(every, F.lit(t.label))

    def share(t: Template) -> Column:
        total = F.lit(0.0)
        for p in t.phrases:
            total = total + F.when(has(p), F.lit(index.weight(p))).otherwise(0.0)
        return total / F.lit(sum(index.weight(p) for p in t.phrases))

    def joined(some: Sequence[Template]) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*map(complete, some))))), ",")

    return df.withColumn("starts", starts).select(
        "doc_id",
        "n_words",
        F.transform("whole", lambda c: F.struct(F.element_at(F.array(*map(F.lit, index.phrases)), (F.shiftright(c, BITS) + 1).cast("int")).alias("phrase"), _place(c).alias("start"))).alias("places"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(index.templates).alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(*map(share, index.templates))), 6).alias("score"),
    )


def _place(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << BITS) - 1))


def oracle(templates: Sequence[Template] = TEMPLATES) -> str:
    """DuckDB SQL for scan() without its places: phrases are sought word by word, without an index."""
    index = PositionalIndex(templates)
    at = {p: f"list_filter(range(len(w)), lambda i: {' and '.join(f'w[i + {k + 1}] = {w!r}' for k, w in enumerate(p.split(' ')))})" for p in index.phrases}
    has = {p: f"(len(p{k}) > 0)" for k, p in enumerate(index.phrases)}
    name = lambda t: f"case when {' and '.join(has[p] for p in t.phrases)} then {t.label!r} end"
    joined = lambda ts: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(map(name, ts))}], lambda x: x is not null))), ','), '')"
    base = [t for t in index.templates if t.base]
    starts = " || ".join(f"p{index.phrases.index(p)}" for t in base for p in t.phrases)
    weigh = lambda p: "(" + " + ".join(f"i{index.vocabulary.index(w)}" for w in p.split(" ")) + ")"
    share = lambda t: "(" + " + ".join(["0.0::double", *(f"case when {has[p]} then {weigh(p)} else 0.0::double end" for p in t.phrases)]) + ") / (" + " + ".join(map(weigh, t.phrases)) + ")"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    idf = ", ".join(f"ln(1 + (count(*) + 1) / (1 + count(*) filter (contains(low, '{w}')))::double) as i{k}" for k, w in enumerate(index.vocabulary))
    return f"""
with words as (select doc_id, regexp_extract_all({low}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
idf as (select {idf} from (select {low} as low from documents)),
found as (select doc_id, w, {", ".join(f"{at[p]} as p{k}" for k, p in enumerate(index.phrases))} from words),
starts as (select *, {starts} as s from found, idf)
select doc_id, len(w)::bigint as n_words, len(s)::bigint as n_base, list_min(s)::bigint as first_word, list_max(s)::bigint as last_word,
  {joined(base)} as base_labels, {joined(index.templates)} as labels, round(least(1.0::double, greatest({", ".join(map(share, index.templates))})), 6) as score
from starts"""
