"""Licence scans: a trained paragraph classifier and a comparison with templates. DataFrame operations and Spark ML alone."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, renamed, staged, table, text_key

#: For each licence family the sentences by which texts carry or name it, from the public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "licensed under the gnu affero general public license version 3",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc 4 0",
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "licensed under cc by sa 4 0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 2 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "isc": (
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2 1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "public-domain": (
        "this is free and unencumbered software released into the public domain",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under cc0",
    ),
}

#: Class of paragraphs that are no licence text.
UNKNOWN = "unknown"
#: Plain sentences of the unknown class that speak of the same things.
PLAIN: tuple[str, ...] = (
    "the driver must renew her license before the permit office closes",
    "copyright of the photographs remains with the museum and they may not be copied",
    "the free software club meets at the public library under the bridge",
    "a general warranty of two years covers the battery of the phone",
)
#: Words and pairs of words that the classifier knows at most: those that the most training rows hold, two at least.
MOST_GRAMS = 1 << 15
#: About how many documents, drawn by the hash of their text, give the paragraphs of the unknown class; one of ASIDE
#: paragraphs and forms is kept back to calibrate.
SAMPLE_DOCS, ASIDE = 300, 4
#: Of the unknown paragraphs kept aside, how many may pass the calibrated limit.
FALSE_SHARE = 0.001
#: Of a template's word pairs, how many a paragraph must hold for a prediction to be confirmed; beyond the second it
#: may not stand for the unknown class.
CONFIRMED, RESEMBLING = 0.8, 0.5
#: Over how many times its own word pairs a statement may be spread.
SPREAD = 1.5
#: Words of so many letters are looked for in a text before it is cut into words.
LONG_WORD = 7
#: Forms of each template that are trained on.
FORMS = 24


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def neighbours(w: Column) -> Column:
    """The pairs of neighbouring words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def paragraphs(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """(kept, place, words): the paragraphs of each text, which lines end, and their words; those without words are left out."""
    lines = F.split(F.coalesce(docs[text_col].cast("string"), F.lit("")), r"\R")
    # the words come out of the generator, so that they are made once a line, however often a filter behind it names them
    return docs.select(*kept, F.posexplode(F.transform(lines, words)).alias("place", "words")).where(F.size("words") > 0)


def template_rows(spark: SparkSession) -> DataFrame:
    """(family, words): the templates; a few dozen rows of fixed values."""
    rows = ", ".join(f"('{family}', '{t}')" for family, texts in TEMPLATES.items() for t in texts)
    return spark.sql(f"SELECT family, split(t, ' ') AS words FROM VALUES {rows} AS x(family, t)")


def template_pairs() -> list[list[str]]:
    """The different word pairs of each template, in the order of template_match()."""
    ordered = [t.split() for _, texts in sorted(TEMPLATES.items()) for t in texts]
    return [sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for w in ordered]


def fixed(values: list[str]) -> Column:
    """An array of fixed values, as one short expression."""
    return F.split(F.lit("|".join(values)), r"\|")


def least_pairs(n: int) -> int:
    """Of n pairs, how many are CONFIRMED."""
    return next(k for k in range(n + 1) if k / n >= CONFIRMED)


def may_hold(text: Column) -> Column:
    """False only for texts that no template is confirmed in. Of each template one pair more is looked for than may be
    missing, by its longest word or, if that is short, as a pair."""
    long, short = set(), set()
    for own in template_pairs():
        longest = {p: max(p.split(), key=len) for p in own}
        for p in sorted(own, key=lambda p: (-len(longest[p]), p))[: len(own) - least_pairs(len(own)) + 1]:
            if len(longest[p]) >= LONG_WORD:
                long.add(longest[p])
            else:
                short.add(p.replace(" ", r"[^\p{L}\p{N}]+"))
    # a word holds what its parts hold
    long = {w for w in long if not any(v != w and v in w for v in long)}

    def held(low: Column) -> Column:
        out = F.lit(False)
        for w in sorted(long):
            out = out | low.contains(w)
        return out | low.rlike("|".join(sorted(short))) if short else out

    # the lower-case text as the variable of a lambda, so that it is made once
    return F.exists(F.array(F.lower(text)), held)


def statements(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, first, last, words): where a text's words, read on over the ends of lines, hold CONFIRMED of a template's
    pairs within SPREAD times their number; from and to which line, and the words. Of places of one template that overlap
    the best counts: with most pairs, then the shortest. Once for equal texts."""
    spark, pairs = docs.sparkSession, template_pairs()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    stream = F.flatten(F.transform(F.split(text, r"\R"), lambda line, i: F.transform(words(line), lambda w: F.struct(i.alias("place"), w.alias("word")))))
    rows = docs.where(may_hold(text)).select(text_key(docs[text_col]).alias("key"), stream.alias("stream"))
    every = fixed(sorted({p for own in pairs for p in own}))
    rows = rows.select("key", "stream", F.array_intersect(neighbours(F.col("stream.word")), every).alias("held"))
    values = ", ".join(f"({t}, {len(own)}, {least_pairs(len(own))}, split('{'|'.join(own)}', '[|]'))" for t, own in enumerate(pairs))
    known = spark.sql(f"SELECT * FROM VALUES {values} AS x(t, n, least, own)")
    rows = rows.join(F.broadcast(known), F.size(F.array_intersect("held", "own")) >= F.col("least")).select("key", "t", "n", "own", "stream")
    rows = staged(rows.dropDuplicates(["key", "t"]), "holding")
    hits = rows.select("key", "t", "n", "own", F.posexplode(neighbours(F.col("stream.word"))).alias("pos", "pair")).where(F.array_contains("own", F.col("pair"))).drop("own")
    # the place, so that 1 is what a statement reaches over
    nearby = Window.partitionBy("key", "t").orderBy(F.col("pos") / (F.floor(F.col("n") * SPREAD) + 0.5))
    hits = hits.withColumn("ahead", F.collect_list(F.struct("pair", "pos")).over(nearby.rangeBetween(0, 1)))
    different = F.array_distinct(F.col("ahead.pair"))
    end = F.array_max(F.transform(different, lambda p: F.element_at("ahead", F.array_position(F.col("ahead.pair"), p).cast("int"))["pos"]))
    starts = hits.select("key", "t", "n", "pos", F.size(different).alias("held"), end.alias("end")).where(F.col("held") / F.col("n") >= CONFIRMED)
    rank = F.struct("held", F.col("pos") - F.col("end"), -F.col("pos"))
    others = F.collect_list(F.struct("rank", "pos", "end")).over(nearby.rangeBetween(-1, 1))
    starts = starts.withColumn("rank", rank).withColumn("others", others)
    worse = F.exists("others", lambda o: (o["pos"] <= F.col("end")) & (o["end"] >= F.col("pos")) & (o["rank"] > F.col("rank")))
    starts = starts.where(~worse).select("key", "t", "pos", "end")
    part = F.slice("stream", F.col("pos") + 1, F.col("end") - F.col("pos") + 2)
    found = starts.join(rows, ["key", "t"]).select("key", part.alias("part"))
    found = found.select("key", F.element_at("part", 1)["place"].alias("first"), F.element_at("part", -1)["place"].alias("last"), F.col("part.word").alias("words"))
    return staged(found, "statements")


def template_match() -> Column:
    """(share, family) of the template whose word pairs the paragraph holds to the largest share; of equal ones the first by name."""
    found, best = F.array_distinct(neighbours(F.col("words"))), []
    for family, texts in sorted(TEMPLATES.items()):
        for t in texts:
            w = t.split()
            own = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
            share = F.size(F.array_intersect(found, fixed(own))) / F.lit(float(len(own)))
            best.append(F.struct(share.alias("share"), (-F.lit(len(best))).alias("order"), F.lit(family).alias("family")))
    return F.greatest(*best)


def training_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(label, words, aside): forms of the templates, and paragraphs of the sample and plain sentences as the unknown class; staged.

    A form is a template with about one word in twelve left out, drawn by hash, so that no wording is needed in full.
    """
    spark, families = docs.sparkSession, [*sorted(TEMPLATES), UNKNOWN]
    number = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))])
    drawn = template_rows(spark).select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(FORMS - 1))).alias("form"))
    thinned = F.filter("words", lambda w, i: (F.col("form") % ASIDE == 0) | (F.pmod(F.xxhash64("form", i, w), F.lit(12)) > 0))
    forms = drawn.select(F.element_at(number, F.col("family")).alias("label"), thinned.alias("words"), (F.col("form") % ASIDE == 1).alias("aside"))
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(17), docs[text_col].cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    plain = spark.sql("SELECT split(t, ' ') AS words FROM VALUES " + ", ".join(f"('{t}')" for t in PLAIN) + " AS x(t)")
    # a line of a wrapped licence isn't unknown either
    parts = statements(sample, text_col).select("key", F.explode(F.sequence("first", "last")).alias("place"))
    unknown = paragraphs(sample, text_col, text_key(sample[text_col]).alias("key")).join(parts, ["key", "place"], "left_anti")
    unknown = unknown.select("words").distinct().where(template_match()["share"] < RESEMBLING)
    unknown = unknown.select("words", (F.pmod(F.xxhash64(F.lit(5), "words"), F.lit(ASIDE)) == 0).alias("aside")).unionByName(plain.withColumn("aside", F.lit(False)))
    label = F.lit(float(len(families) - 1)).alias("label")
    return staged(forms.unionByName(unknown.select(label, "words", "aside")), "training")


#: The words and pairs that are known, and their weights.
Classifier = tuple[CountVectorizerModel, LogisticRegressionModel]


def with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__grams", F.concat("words", neighbours(F.col("words"))))


def scored(model: Classifier, rows: DataFrame) -> DataFrame:
    """rows with family, the likeliest class but the unknown one, and score, the share of all classes but that one."""
    known, weights = model
    out = weights.transform(known.transform(with_grams(rows)))
    names = F.array(*map(F.lit, sorted(TEMPLATES)))
    p = vector_to_array("probability")
    out = out.withColumn("__p", F.slice(p, 1, len(TEMPLATES)))
    best = F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int"))
    return out.select(*rows.columns, best.alias("family"), F.aggregate("__p", F.lit(0.0), lambda a, x: a + x).alias("score"))


def fit(docs: DataFrame, *, text_col: str = "text") -> tuple[Classifier, float]:
    """(model, limit): sparse logistic regression over words and pairs of words, trained on the templates' forms and a
    bounded sample of docs; and the score that FALSE_SHARE of the sample's paragraphs kept aside reach."""
    rows = training_rows(docs, text_col)
    train = with_grams(rows.where("not aside").coalesce(1))
    known = CountVectorizer(inputCol="__grams", outputCol="__features", vocabSize=MOST_GRAMS, minDF=2, binary=True).fit(train)
    regression = LogisticRegression(featuresCol="__features", maxIter=40, regParam=1e-3, family="multinomial", standardization=False)
    model = known, regression.fit(known.transform(train))
    aside = scored(model, rows.where(F.col("aside") & (F.col("label") == len(TEMPLATES))))
    limit = aside.agg(F.percentile("score", F.lit(1 - FALSE_SHARE))).first()[0]
    return model, max(0.5, min(limit or 0.0, 0.9))


def scan(docs: DataFrame, model: Classifier, limit: float, *, text_col: str = "text") -> DataFrame:
    """docs with n_paragraphs, n_license, n_unconfirmed, licenses and license_score behind its columns.

    A paragraph is a line that has words. n_license counts those that the classifier takes for licence text and in
    which the best template is of the predicted family and confirmed; licenses are their families, in order. So are
    statements() judged, which run over the ends of lines or are a part of a long one: lines that a confirmed statement
    joins count once. n_unconfirmed counts the other lines taken for licence text alone. license_score is the largest
    score of a confirmed line or statement, 0 without any.

    DataFrame operations and Spark ML transformers alone: one pass over the paragraphs and one over the texts, after
    which few are left to be grouped by text. A null or empty text has no paragraphs; repeated rows and ids stay; columns
    with the new names are replaced; an empty table stays empty.
    """
    new = ("n_paragraphs", "n_license", "n_unconfirmed", "licenses", "license_score")
    docs, old = numbered(docs, new)
    text_col = f"c{old.index(text_col)}"
    # the texts' own column names don't reach the transformers
    taken = scored(model, paragraphs(docs, text_col, text_key(docs[text_col]).alias("key"))).where(F.col("score") >= limit)
    confirmed = (F.col("match.share") >= CONFIRMED) & (F.col("match.family") == F.col("family"))
    taken = taken.withColumn("match", template_match()).select("key", F.col("place").alias("first"), F.col("place").alias("last"), "family", "score", confirmed.alias("confirmed")).dropDuplicates(["key", "first"])
    read_on = scored(model, statements(docs, text_col)).where(F.col("score") >= limit).withColumn("match", template_match())
    read_on = staged(read_on.select("key", "first", "last", "family", "score", confirmed.alias("confirmed")).where("confirmed"), "read-on")
    taken = taken.unionByName(read_on)
    # what shares a line counts once
    before = Window.partitionBy("key").orderBy("first", "last")
    new_one = F.coalesce(F.col("first") > F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    taken = taken.withColumn("new", new_one.cast("int")).withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    families = F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families")
    taken = taken.groupBy("key", "run").agg(F.bool_or("confirmed").alias("confirmed"), families, F.max(F.when(F.col("confirmed"), F.col("score"))).alias("score"))
    found = taken.groupBy(F.col("key").alias("__key")).agg(
        F.count_if("confirmed").alias("__n"),
        F.count_if(~F.col("confirmed")).alias("__u"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("__families"),
        F.max(F.when(F.col("confirmed"), F.col("score"))).alias("__score"),
    )
    lines = F.split(F.coalesce(docs[text_col].cast("string"), F.lit("")), r"\R")
    n = F.size(F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long")
    rows = docs.select("*", n.alias("n_paragraphs"), text_key(docs[text_col]).alias("__key"))
    out = rows.join(found, "__key", "left")
    none = F.array().cast("array<string>")
    return renamed(out, old, "n_paragraphs", F.coalesce("__n", F.lit(0)).cast("long").alias("n_license"), F.coalesce("__u", F.lit(0)).cast("long").alias("n_unconfirmed"), F.coalesce("__families", none).alias("licenses"), F.coalesce("__score", F.lit(0.0)).alias("license_score"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, *fit(docs))
    return found.select("doc_id", "n_paragraphs", "n_license", "n_unconfirmed", F.array_join("licenses", ",").alias("licenses"), F.round("license_score", 4).alias("license_score"))
