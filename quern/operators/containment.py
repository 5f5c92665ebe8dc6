"""Which texts hold which passages: a join on a word that a passage must share with any text that holds it.

A passage inside a text may begin and end within words, but the words between its first and its last are whole words of
the text. The longest of these, the first by order among equals, is the passage's key; texts that have the word are
compared with the whole passage. Passages without such a word, of up to two words, meet every text in one pass: nothing in
them needs to be a word of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of passages up to so many (some 30 MB) are broadcast to the words of texts; beyond it the join shuffles both.
BROADCAST_KEYS = 500_000


def pieces(text: Column) -> Column:
    """What stands between blanks and line ends, however many; any fixed marks would do, as both sides are cut at them."""
    return F.split(F.translate(text, "\n\r\t", "   "), " ", -1)


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, id) for each text of docs (id, text) that has the whole passage of (query_id, text); empty passages are in
    none, repeated ids and passages count once."""
    asked = passages.where("text is not null and text != ''").select("query_id", F.col("text").alias("passage")).distinct()
    whole = asked.withColumn("ws", pieces(F.col("passage")))
    inner = F.filter(F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    keyed = whole.select("query_id", "passage", longest.alias("word"))
    long = keyed.where("word is not null")
    own = docs.where("text is not null").select("id", "text")
    near = F.broadcast if passages.count() <= BROADCAST_KEYS else lambda df: df
    had = own.select("id", F.explode(F.array_distinct(pieces(F.col("text")))).alias("word"))
    pairs = had.join(near(long.select("query_id", "word")), "word").select("query_id", "id")
    found = own.join(pairs, "id").join(near(long.select("query_id", "passage")), "query_id").where(F.contains("text", "passage"))
    # a stated set of short passages against all texts
    short = keyed.where("word is null").select("query_id", "passage")
    if short.isEmpty():
        return found.select("query_id", "id").distinct()
    again = own.join(near(short), F.contains("text", "passage"))
    return found.select("query_id", "id").unionByName(again.select("query_id", "id")).distinct()
