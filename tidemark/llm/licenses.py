"""License scans by diagonal voting, in DataFrame operations alone.

Every rolling 3-gram of a text's words is joined to the places where the templates
have it. A hit votes for the diagonal ``place in text - place in template``: the hits
of one copy fall on one diagonal, those of a copy with words put in or left out on
neighbouring ones. Diagonals at most ``SLACK`` apart are merged, and a span counts if
the template 3-grams it covers, each compared word by word in the join and counted
once, make up enough of the template.

The templates are a fixed list, so their side of the join is broadcast. All of a
text's hits come from one task, which sums its votes before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.util import ascii_lower

GRAM = 3
SLACK = 2
COVER = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Opening words of public licenses and of the usual notices, with their labels.
#: 3-grams with two words in capitals (or a number after such a word) must be there: they tell notices apart that share the rest.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 3", "gpl-3"),
    ("version 3 of the gnu general public license", "gpl-3"),
    ("terms of the GNU GENERAL public license as published by the free software foundation either VERSION 3 of the license", "gpl-3"),
    ("terms of the GNU GENERAL public license as published by the free software foundation VERSION 3 of the license", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("version 2 of the gnu general public license", "gpl-2"),
    ("terms of the GNU GENERAL public license as published by the free software foundation either VERSION 2 of the license", "gpl-2"),
    ("terms of the GNU GENERAL public license as published by the free software foundation VERSION 2 of the license", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Passages from the bodies of public licenses, which no other of them holds, with their labels.
BODIES = (
    ("each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or", "apache-2"),
    ("you must cause any modified files to carry prominent notices stating that you changed the files and c you must retain in the source form of any derivative works that", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either", "apache-2"),
    ("this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and", "apache-2"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the", "bsd"),
    ("names of its contributors may be used to endorse or promote products derived from this software without specific", "bsd"),
    ("as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose", "bsd"),
    ("this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it", "gpl-2"),
    ("for example if you distribute copies of such a program whether gratis or for a fee you must give the recipients all the rights that you have you must make", "gpl-2"),
    ("you may not copy modify sublicense or distribute the program except as expressly provided under this license any attempt otherwise to copy modify sublicense", "gpl-2"),
    ("we the free software foundation use the gnu general public license for most of our software it applies also to any other work released this way by its authors you", "gpl-3"),
    ("for example if you distribute copies of such a program whether gratis or for a fee you must pass on to the recipients the same freedoms that you received you must make sure that they too receive or can get the source code and", "gpl-3"),
    ("a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library such a work in isolation", "lgpl"),
    ("you may convey a combined work under terms of your choice that taken together effectively do not restrict modification of the portions of the library contained in the combined work and reverse engineering for debugging such", "lgpl"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("each contributor hereby grants you a world wide royalty free non exclusive license a under intellectual property rights other than patent or trademark licensable by such contributor to use reproduce", "mpl-2"),
    ("all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under the terms of this license you must inform recipients that the", "mpl-2"),
    ("covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose", "mpl-2"),
)


def _phrases() -> list[tuple[str, str, bool]]:
    return [(p, x, True) for p, x in BASE] + [(p, x, False) for p, x in NOTICES + BODIES]


def _must() -> list[str]:
    """A row of SQL values for each template: number and the bits of the 3-grams that must be there."""
    every = [[w != w.lower() or (w.isdigit() and b != b.lower()) for b, w in zip(["", *p.split()], p.split())] for p, _, _ in _phrases()]
    return [f"({n}, {sum(1 << k for k in range(len(up) - GRAM + 1) if sum(up[k : k + GRAM]) > 1)}L)" for n, up in enumerate(every)]


def _values() -> list[str]:
    """A row of SQL values for each template 3-gram: template, label, base, grams, k, a, b, c."""
    rows = []
    for number, (phrase, label, base) in enumerate(_phrases()):
        words = phrase.lower().split()
        grams = len(words) - GRAM + 1
        if not 0 < grams < 64:
            raise ValueError(f"a template needs {GRAM} to {62 + GRAM} words: {phrase}")
        for k in range(grams):
            a, b, c = words[k : k + GRAM]
            rows.append(f"({number}, '{label}', {str(base).lower()}, {grams}, {k}, '{a}', '{b}', '{c}')")
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    """The template 3-grams with their hashes; template -1 meets every text once."""
    rows = ["(-1, '', false, 0, 0, '', '', '')", *_values()]
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, base, grams, k, a, b, c)")
    must = spark.sql(f"SELECT * FROM VALUES (-1, 0L), {', '.join(_must())} AS t(template, must)")
    return table.join(must, "template").withColumn("gram", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("a", "b", "c")))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists label, first and last word and cover of what counts. Null and empty
    texts have no words and empty labels; repeated rows stay repeated; a null key stays.
    """
    spark = docs.sparkSession
    parts = docs.select(
        F.monotonically_increasing_id().alias("rid"), docs[key].alias("doc_id"),
        F.split(ascii_lower(F.coalesce(docs[text], F.lit(""))), SEPARATORS).alias("parts"),
    )
    lead = F.when(F.element_at("parts", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    worded = parts.select("rid", "doc_id", F.slice("parts", lead + 1, F.size("parts") - lead - tail).alias("words"))
    places = worded.select(
        "rid", "doc_id", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - GRAM, F.lit(-1)))).alias("at")
    )
    word = [F.get("words", F.col("at") + k) for k in range(GRAM)]
    places = places.withColumn("here", F.when(F.col("at") < 0, F.lit(0)).otherwise(F.xxhash64(*word)))
    templates = F.broadcast(_templates(spark))
    same = (F.col("here") == F.col("gram")) & (
        ((F.col("at") < 0) & (F.col("template") < 0))
        | ((word[0] == F.col("a")) & (word[1] == F.col("b")) & (word[2] == F.col("c")))
    )
    hits = places.join(templates, same).select(
        "rid", "doc_id", F.size("words").alias("n_words"), "template", "label", "base", "grams", "must",
        (F.col("at") - F.col("k")).alias("diagonal"),
        F.expr("shiftleft(1L, k)").alias("bit"), "at",
    )
    votes = hits.groupBy("rid", "doc_id", "n_words", "template", "label", "base", "grams", "must", "diagonal").agg(
        F.bit_or("bit").alias("bits"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    votes = votes.repartition("rid")  # one exchange for all that follows
    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > SLACK
    votes = votes.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0)))
    votes = votes.withColumn("span", F.sum("apart").over(line))
    whole = F.col("base") & (F.bit_count("bits") == F.col("grams"))
    spans = votes.groupBy("rid", "doc_id", "n_words", "template", "label", "base", "grams", "must", "span").agg(
        F.bit_or("bits").alias("bits"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"),
        F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("least"), F.max(F.when(whole, F.col("diagonal"))).alias("most"),
    )
    cover = F.when(F.col("template") >= 0, F.bit_count("bits") / F.col("grams")).otherwise(0.0)
    spans = spans.withColumn("cover", cover)
    counts = F.when(F.col("base"), F.col("places") > 0).otherwise(
        (F.col("template") >= 0) & (F.col("cover") >= COVER) & (F.col("bits").bitwiseAND(F.col("must")) == F.col("must"))
    )
    joined = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    return spans.groupBy("rid", "doc_id", "n_words").agg(
        F.sum("places").alias("n_base"),
        F.min("least").cast("long").alias("first_word"),
        F.max("most").cast("long").alias("last_word"),
        joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when(counts, F.col("label"))).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(
            F.collect_list(F.when(counts, F.struct("label", "first", "last", "cover")))
        ).alias("spans"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word",
        "base_labels", "labels", "score",
    )


#: The same by lists of words and plain counts of distinct 3-grams.
ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
templates AS (SELECT * FROM (VALUES TEMPLATES) AS t(template, label, base, grams, k, a, b, c)),
grams_of AS (
  SELECT rid, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS i FROM texts)),
hits AS (SELECT g.rid, g.i, t.template, t.label, t.base, t.grams, t.k FROM grams_of g JOIN templates t USING (a, b, c)),
diagonals AS (
  SELECT *, base AND len(ks) = grams AS whole FROM (
    SELECT rid, template, label, base, grams, i - k AS diagonal, list(k) AS ks FROM hits GROUP BY rid, template, label, base, grams, i - k)),
spanned AS (
  SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > 2 THEN 1 ELSE 0 END AS apart FROM diagonals)),
spans AS (
  SELECT rid, template, label, base, count(*) FILTER (whole) AS places, min(diagonal) FILTER (whole) AS least, max(diagonal) FILTER (whole) AS most,
    len(list_distinct(flatten(list(ks)))) / any_value(grams)::DOUBLE AS cover
  FROM spanned GROUP BY rid, template, label, base, span)
SELECT any_value(x.doc_id) AS doc_id, any_value(len(x.w))::BIGINT AS n_words, coalesce(sum(places), 0)::BIGINT AS n_base, min(least)::BIGINT AS first_word, max(most)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (places > 0))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (CASE WHEN base THEN places > 0 ELSE cover >= 0.8 END))), ','), '') AS labels,
  coalesce(max(cover), 0) AS score
FROM texts x LEFT JOIN spans s ON x.rid = s.rid GROUP BY x.rid""".replace("TEMPLATES", ", ".join(_values()))
