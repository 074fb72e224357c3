"""Operator 9 [native]: licence scan by a positional index of licence words.

The text is read once: of each file the index holds every place of a licence word (any word
of the templates) and how many words there are. All else comes from the index:

1. Base places are where the words of a fixed phrase stand on end.
2. A file is a candidate for a template if it holds all words of its mandatory key phrase.
3. Of a candidate's words that the template has, the ``RAREST`` with the highest inverse
   document frequency over all files are looked up in the template's postings: a word at
   place p of the file and place q of the template votes for offset p - q.
4. An offset is kept if the votes there hold half the weight (inverse document frequency)
   of the template's ``RAREST`` words, and the key phrase stands there.

Words are ranked for each template alone, so a second notice or rarer words of the prose
hide none. Everything is DataFrame functions; templates are a fixed table of a few
hundred words, so they are broadcast.

Defined cases: a null text counts as empty: no words, no labels, score 0. Repeated rows
and ids each give a row. The score is the largest share of a template's weight at a kept
offset of a file; a file with base places alone has 0.5. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracause.llm.shared import cut

#: Phrase and label of the base places.
BASE = {"apache license": "apache", "general public license": "gpl", "mit license": "mit"}
#: Label, notice text in words, mandatory key phrase in words.
TEMPLATES = [
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software for any purpose"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "to deal in the software without restriction"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable"),
]
#: Words of a template looked up in a candidate file.
RAREST = 6
#: The share of their weight that an offset needs.
SHARE = 0.5
#: What stands between words: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _tables() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(template, label), (template, word, place) and (template, word, place) of the key phrase."""
    names, postings, keys = [], [], []
    for number, (label, text, key) in enumerate(TEMPLATES):
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        names.append((number, label, len(phrase)))
        postings += [(number, w, i) for i, w in enumerate(words)]
        keys += [(number, w, at + i) for i, w in enumerate(phrase)]
    return names, postings, keys


def index(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words and ``hits``: place and word of every licence word, in order."""
    known = sorted({w for _, w, _ in _tables()[1]} | {w for p in BASE for w in p.split()})
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), BETWEEN).alias("w"))
    # what stands before the first word, and behind the last, gives an empty string
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    size = F.size("w") - lead - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    placed = F.transform("w", lambda w, i: F.struct((i - F.col("lead")).alias("at"), F.lower(w).alias("word"), F.octet_length(w).alias("n")))
    # words of ASCII keep their length, so only A-Z were lower-cased in what is left
    found = F.filter(placed, lambda h: h["word"].isin(known) & (F.octet_length(h["word"]) == h["n"]))
    rows = split.select("doc_id", "w", lead.alias("lead"), size.cast("long").alias("n_words"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.transform(found, lambda h: F.struct(h["at"].alias("at"), h["word"].alias("word"))).alias("hits"))


def _places(phrase: str) -> Column:
    """Where the words of a phrase stand on end, by the hits."""
    words = phrase.split()

    def stands(h: Column, i: Column) -> Column:
        out = h["word"] == words[0]
        for k, word in enumerate(words[1:], 1):
            later = F.get("hits", i + k)
            out = out & (later["word"] == word) & (later["at"] == h["at"] + k)
        return F.coalesce(out, F.lit(False))

    return F.transform(F.filter("hits", stands), lambda h: h["at"])


def base_places(files: DataFrame) -> DataFrame:
    """The index with ``base``: the places of each fixed phrase."""
    return files.select("*", *[_places(phrase).alias(f"base_{label}") for phrase, label in BASE.items()])


def candidates(files: DataFrame) -> DataFrame:
    """The index with ``words``, the distinct licence words, and the templates all of whose key words the file holds."""
    words = files.withColumn("words", F.array_distinct(F.transform("hits", lambda h: h["word"])))
    holds = [F.when(F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in set(key.split())]))) == len(set(key.split())), F.lit(i)) for i, (_, _, key) in enumerate(TEMPLATES)]
    return words.withColumn("templates", F.when(F.size("words") > 1, F.array_compact(F.array(*holds))).otherwise(F.array().cast("array<int>")))


def method_labels(files: DataFrame) -> DataFrame:
    """row, labels (array) and score of the files in which a template was found."""
    spark = files.sparkSession
    names, postings, keys = _tables()
    table = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    own = table(sorted({(t, w) for t, w, _ in postings}), "template int, word string")
    # one row a licence word: a number fixed by the templates; words that no file holds count as half a file
    held = files.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    words = own.select("word").distinct().join(held, "word", "left").crossJoin(F.broadcast(files.agg(F.count("*").alias("n")))).withColumn("df", F.coalesce("df", F.lit(0)))
    weights = cut(words.select("word", "df", F.log(1 + F.col("n") / F.greatest("df", F.lit(0.5))).alias("weight")), "op9-weights")
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys, "template").orderBy("df", "word"))
    whole = own.join(F.broadcast(weights), "word").withColumn("nth", nth()).where(F.col("nth") <= RAREST).groupBy("template").agg(F.sum("weight").alias("all"))
    asked = files.where(F.size("templates") > 0).select("row", "words", "hits", F.explode("templates").alias("template"))
    looked = asked.select("row", "template", F.explode("words").alias("word")).join(own, ["template", "word"]).join(F.broadcast(weights), "word").withColumn("nth", nth("row")).where(F.col("nth") <= RAREST)
    spots = cut(asked.select("row", "template", F.inline("hits")), "op9-spots")
    voted = spots.join(looked.select("row", "template", "word", "weight"), ["row", "template", "word"]).join(table(postings, "template int, word string, place int"), ["template", "word"])
    offset = (F.col("at") - F.col("place")).alias("offset")
    votes = voted.groupBy("row", "template", offset, "word").agg(F.first("weight").alias("weight")).groupBy("row", "template", "offset").agg(F.sum("weight").alias("votes"))
    phrase = spots.join(table(keys, "template int, word string, place int"), ["template", "word"]).groupBy("row", "template", offset).agg(F.count("*").alias("stand"))
    share = F.col("votes") / F.col("all")
    kept = votes.join(F.broadcast(whole), "template").where(F.round(share, 9) >= SHARE).join(phrase, ["row", "template", "offset"]).join(table(names, "template int, label string, size int"), "template").where("stand = size")
    return kept.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(share).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: words, base places, labels and score. ``docs`` needs doc_id and text; other columns are not read."""
    files = cut(candidates(base_places(index(docs.select("doc_id", "text")))), "op9")
    labels = sorted(BASE.values())
    both = files.drop("hits", "words", "templates").join(method_labels(files), "row", "left")
    places = F.concat(*[F.col(f"base_{x}") for x in labels])
    base = F.array_compact(F.array(*[F.when(F.size(f"base_{x}") > 0, F.lit(x)) for x in labels]))
    every = F.concat_ws(",", F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))))
    score = F.coalesce("share", F.when(F.size(places) > 0, 0.5), F.lit(0.0))
    return both.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.concat_ws(",", base).alias("base_labels"), every.alias("labels"), F.round(score, 6).alias("score")
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    names, postings, keys = _tables()
    bases = [(p, label, len(p.split())) for p, label in BASE.items()]
    return f"""
WITH plain AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
split AS (SELECT *, CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS w FROM plain),
names(template, label, size) AS (VALUES {values(names)}), postings(template, word, place) AS (VALUES {values(postings)}), keys(template, word, place) AS (VALUES {values(keys)}), bases(phrase, label, n) AS (VALUES {values(bases)}),
hits AS (SELECT rid, word, pos FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM split) WHERE word IN (SELECT word FROM postings)),
held AS (SELECT DISTINCT rid, word FROM hits),
weights AS (SELECT word, count(rid) AS df, ln(1 + (SELECT count(*) FROM split) / greatest(count(rid), 0.5)) AS weight FROM (SELECT DISTINCT word FROM postings) LEFT JOIN held USING (word) GROUP BY word),
needs AS (SELECT template, count(DISTINCT word) AS need FROM keys GROUP BY template),
asked AS (SELECT rid, template FROM held JOIN (SELECT DISTINCT template, word FROM keys) USING (word) JOIN needs USING (template) GROUP BY rid, template, need HAVING count(*) = need),
looked AS (
  SELECT rid, template, word, weight FROM (
    SELECT a.rid, a.template, h.word, s.weight, row_number() OVER (PARTITION BY a.rid, a.template ORDER BY s.df, h.word) AS nth
    FROM asked a JOIN held h USING (rid) JOIN (SELECT DISTINCT template, word FROM postings) p ON p.template = a.template AND p.word = h.word JOIN weights s ON s.word = h.word) WHERE nth <= {RAREST}),
whole AS (SELECT template, sum(weight) AS mass FROM (
    SELECT p.template, s.weight, row_number() OVER (PARTITION BY p.template ORDER BY s.df, p.word) AS nth FROM (SELECT DISTINCT template, word FROM postings) p JOIN weights s ON s.word = p.word) WHERE nth <= {RAREST} GROUP BY template),
votes AS (
  SELECT rid, template, o, sum(weight) AS mass FROM (
    SELECT DISTINCT l.rid, l.template, l.word, l.weight, h.pos - p.place AS o FROM looked l JOIN hits h ON h.rid = l.rid AND h.word = l.word JOIN postings p ON p.template = l.template AND p.word = l.word) GROUP BY ALL),
phrases AS (SELECT a.rid, a.template, h.pos - k.place AS o, count(*) AS stand FROM asked a JOIN hits h USING (rid) JOIN keys k ON k.template = a.template AND k.word = h.word GROUP BY ALL),
kept AS (
  SELECT v.rid, n.label, v.mass / w.mass AS share FROM votes v JOIN whole w USING (template) JOIN phrases p USING (rid, template, o) JOIN names n USING (template) WHERE round(v.mass / w.mass, 9) >= {SHARE} AND p.stand = n.size),
base AS (
  SELECT s.rid, b.label, h.pos FROM hits h JOIN split s USING (rid) JOIN bases b ON h.word = split_part(b.phrase, ' ', 1) WHERE array_to_string(s.w[h.pos + 1 : h.pos + b.n], ' ') = b.phrase),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM kept UNION ALL SELECT rid, label FROM base) GROUP BY rid),
sums AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
shares AS (SELECT rid, max(share) AS share FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END), 6) AS score
FROM split LEFT JOIN sums USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN shares USING (rid)
"""
