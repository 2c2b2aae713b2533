"""License scan by diagonal voting, on DataFrame functions alone.

Every two neighbouring words of every document (the rolling 2-gram) are joined to the
positions of that 2-gram in the templates.  A match is a vote for the diagonal
``document position - template position``: a copy of a template puts its votes on one
diagonal, a copy with words put in or left out on a few neighbouring ones.  Votes are
counted per diagonal, diagonals close to each other are merged, and the merged spans are
verified: of their votes the longest chain that goes forward in both document and template
must hold enough of the template, each place of it once, and not be stretched over many words more.

The templates are a parameter; up to a checked number of 2-grams they are broadcast, and
the documents are not shuffled, only votes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

# Short phrases that name a license.  Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Openings of well-known notices.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files to deal in the software without restriction",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 3
# Templates are broadcast up to this many 2-grams; more than that take an ordinary join.
BROADCAST_GRAMS = 200_000
# Common phrases ("is subject to the terms of the") make half of a short notice.
LEAST_SHARE = 0.6
# A chain may be so many times as long as its template.
MOST_STRETCH = 1.5


def words_of(text: Column) -> Column:
    """Words of lower-cased ``text``: runs of ASCII letters and digits and all other
    characters from U+0080 on.  A null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, phrase?, n_grams, t_pos, t_a, t_b, gram_hash) for every 2-gram of every template."""
    rows = []
    entries = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, t in notices.items()]
    for number, (text, label, phrase) in enumerate(entries):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words or more: {text!r}")
        rows += [
            (number, label, phrase, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)
        ]
    schema = "template int, label string, phrase boolean, n_grams int, t_pos int, t_a string, t_b string"
    grams = spark.createDataFrame(rows, schema).withColumn("gram_hash", F.xxhash64("t_a", "t_b"))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def longest_chain(votes: Column) -> Column:
    """(n, t, first, last) of the longest chain of votes (d, back) that rises in d and in t = -back.

    ``chains`` holds, for each length, the chain that ends at the least place of the template.
    Votes come in the order of the document, those of one word from the last place to the first.
    """
    none = F.array().cast("array<struct<n:int,t:int,first:int,last:int>>")

    def longer(chains: Column, vote: Column) -> Column:
        t = -vote["back"]
        n = F.size(F.filter(chains, lambda c: c["t"] < t))
        first = F.when(n > 0, F.get(chains, n - 1)["first"]).otherwise(vote["d"])
        now = F.struct((n + 1).alias("n"), t.alias("t"), first.alias("first"), vote["d"].alias("last"))
        return F.concat(F.slice(chains, F.lit(1), n), F.array(now), F.slice(chains, n + 2, F.size(chains)))

    return F.aggregate(F.array_sort(votes), none, longer, lambda chains: F.element_at(chains, -1))


def spans(
    docs: DataFrame,
    key: list[str],
    text: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    gap: int = GAP,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Verified spans: key columns, label, phrase (whether it is a phrase's place),
    first_word, last_word and share of the template found.

    A phrase is one exact diagonal with all its 2-grams.  A notice is a chain in merged
    diagonals with at least ``least_share`` of its 2-grams, in their order.  Rows with equal keys must have
    equal texts; they give their spans once.  Texts that are null, empty or of one word
    have no 2-grams and give no span.
    """
    grams = template_grams(
        docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    )
    words = docs.select(*key, words_of(F.col(text)).alias("_w"))
    # Word i beside word i + 1; the last word stands alone and matches nothing.
    beside = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("b"))
    rolling = words.select(*key, F.posexplode(beside).alias("d_pos", "_g"))
    rolling = rolling.select(*key, "d_pos", "_g.a", "_g.b", F.xxhash64("_g.a", "_g.b").alias("gram_hash"))
    # The hash finds the template position, the words themselves confirm it.  Two prefix
    # tests are an equality that stays out of the join key, which so is one number.
    same = [F.col(x).startswith(F.col(y)) for x, y in (("a", "t_a"), ("t_a", "a"), ("b", "t_b"), ("t_b", "b"))]
    votes = rolling.join(grams, "gram_hash").where(same[0] & same[1] & same[2] & same[3])
    votes = votes.select(
        *key, "template", "label", "phrase", "n_grams", "d_pos", (F.col("d_pos") - F.col("t_pos")).alias("diagonal")
    )
    group = [*key, "template", "label", "phrase", "n_grams"]
    places = F.transform(F.collect_set("d_pos"), lambda d: F.struct(d.alias("d"), (F.col("diagonal") - d).alias("back")))
    diagonals = votes.groupBy(*group, "diagonal").agg(places.alias("at"))
    beside = Window.partitionBy(*group).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(beside) > F.when(F.col("phrase"), 0).otherwise(gap)
    return (
        diagonals.withColumn("_new", apart.cast("int"))
        .withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(beside))
        .groupBy(*group, "_run")
        .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
        .withColumn("at", longest_chain(F.col("at")))
        .withColumn("share", F.col("at.n") / F.col("n_grams"))
        .where(F.col("share") >= F.when(F.col("phrase"), 1.0).otherwise(least_share))
        .where(F.col("at.last") - F.col("at.first") + 2 <= MOST_STRETCH * (F.col("n_grams") + 1))
        .select(
            *key,
            "label",
            "phrase",
            F.col("at.first").cast("bigint").alias("first_word"),
            (F.col("at.last") + 1).cast("bigint").alias("last_word"),
            "share",
        )
    )


def license_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: n_words, the places of the phrases (n_base, first_word,
    last_word, base_labels), all labels, and the best share of a template as score.

    Documents without a span have 0 places, null positions, empty labels and score 0.
    Repeated rows get a row each.  Other columns of ``docs`` are ignored.
    """
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_content"), F.col(text).alias("_text")
    )
    # A null id must still find its own spans: its group key is a text.
    keyed = keyed.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = spans(keyed, ["_key", "_content"], "_text", **options)
    base = F.col("phrase")
    per_doc = found.groupBy("_key", "_content").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    counted = keyed.select("doc_id", "_key", "_content", F.size(words_of(F.col("_text"))).cast("bigint").alias("n_words"))
    return counted.join(per_doc, ["_key", "_content"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
