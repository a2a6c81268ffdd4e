"""Life chapters of the people that timeline markers speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import similarity


def held_in(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Pairs of distinct (text, word) where the text holds the word, both in lower case: they meet by the word's first three letters (fewer, if it has
    fewer) in an inverted table of the texts' parts of one to three letters, so no word is held against all texts. Empty words are in none."""
    t = texts.select(F.lower(text).alias(text)).filter(F.col(text).isNotNull()).distinct()
    w = words.select(F.lower(word).alias(word)).filter(F.length(word) > 0).distinct()
    inverted = t.select(text, F.explode(F.concat(*(similarity.grams(F.col(text), n) for n in (1, 2, 3)))).alias("_g"))
    return w.withColumn("_g", F.left(word, F.lit(3))).join(inverted, "_g").filter(F.contains(text, word)).select(text, word)


def chapters_of(people: DataFrame, chapters: DataFrame, order: list[str | Column], k: int = 5) -> DataFrame:
    """person and the k first chapters (by order) in which they are a key person or whose title holds their first name.

    people: person, name; chapters: chapter_id, title, key_people (array of persons) and others. Membership is an equi-join on the arrays'
    elements, titles go by `held_in`; a chapter that both ways find counts once.
    """
    first = people.select("person", F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("first_name"))
    rest = chapters.drop("key_people")

    def best(df: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order, "chapter_id"))
        return df.withColumn("place", place).filter(F.col("place") <= k)

    members = chapters.select("chapter_id", F.explode(F.array_distinct("key_people")).alias("person")).join(people.select("person").distinct(), "person")
    by_member = best(members.join(rest, "chapter_id"), "person").drop("place")
    # A person's k first are among the k first of their first name, so all chapters of a name don't meet all people of it.
    titles = rest.withColumn("_title", F.lower("title"))
    held = held_in(titles, "_title", first, "first_name")
    by_name = best(titles.join(held, "_title").drop("_title"), "first_name").drop("place")
    by_title = by_name.join(first.distinct(), "first_name").drop("first_name")
    return best(by_member.unionByName(by_title).dropDuplicates(["person", "chapter_id"]), "person")
