"""Words against a dictionary given as a table, and whether a correction holds up."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import lexicon
from variorum.runtime import cut


def fold(c: Column, form: str = "NFD") -> Column:
    """Without accents, in a normal form, by an Arrow function; ASCII text is left as it is."""

    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else "".join(ch for ch in unicodedata.normalize(form, x) if not unicodedata.combining(ch)))

    return F.when(c.rlike(r"[^\x00-\x7F]"), bare(c)).otherwise(c)


def diacritic_change(a: Column, b: Column) -> Column:
    """The same letters but for accents and ligatures."""

    def letters(c: Column) -> Column:
        c = fold(F.regexp_replace(c, r"[^\p{L}]", ""))
        for one, two in (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
            c = F.replace(c, F.lit(one), F.lit(two))
        return F.lower(c)

    return (letters(a) != "") & (letters(a) == letters(b))


def in_dictionary(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Words with in_dictionary; dictionary has entries (entry), lower case without accents.

    The forms of the distinct words, which are found once, meet the entries in one
    join. A hyphenated word needs all of its parts. Null and blank words are in no dictionary.
    """
    own = cut(words.select(word).distinct().filter(F.trim(word) != "")).withColumn("__w", fold(F.trim(F.lower(F.col(word)))))
    whole = own.select(word, F.lit(0).alias("part"), F.explode(lexicon.stems(F.col("__w"))).alias("entry"))
    parts = own.filter(F.col("__w").contains("-")).select(word, F.posexplode(F.filter(F.split("__w", "-"), lambda x: x != "")).alias("part", "entry")).withColumn("part", F.col("part") + 1)
    wanted = own.select(word, F.size(F.filter(F.split("__w", "-"), lambda x: x != "")).alias("n"))
    hits = whole.unionByName(parts).join(dictionary.select("entry").distinct(), "entry", "left_semi").groupBy(word).agg(F.max((F.col("part") == 0).cast("int")).alias("direct"), F.countDistinct(F.when(F.col("part") > 0, F.col("part"))).alias("parts"))
    known = hits.join(wanted, word).filter((F.col("direct") == 1) | ((F.col("parts") == F.col("n")) & F.col(word).contains("-"))).select(word, F.lit(True).alias("__in"))
    return words.join(known, word, "left").withColumn("in_dictionary", F.coalesce("__in", F.lit(False))).drop("__in")


def validate(cands: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates with `valid`: marked letters, numbers and capitals hold up by themselves, else the longest word must be known."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("scan_text", F.lit("")), "<[^>]+>", ""), r"_([^_]+)_", "$1"))
    bare = F.regexp_replace(F.regexp_replace(s, r"^[^\p{L}\p{N}_']+", ""), r"[^\p{L}\p{N}_']+$", "")
    longest = F.array_max(F.transform(F.filter(F.split(bare, r"\s+"), lambda x: x != ""), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("w"))))["w"]
    own = cands.withColumns({"__s": s, "__b": bare, "word": longest})
    looked = in_dictionary(own, dictionary)
    valid = F.when(lexicon.has_mark(F.col("__s")), True).when(F.col("__b") == "", False).when(F.col("__b").rlike(r"^[0-9]+([.,][0-9]+)*(-[0-9]+)*$") | F.col("__b").rlike(r"^\p{Lu}"), True).otherwise(F.col("in_dictionary"))
    return looked.withColumn("valid", valid).drop("__s", "__b", "word", "in_dictionary")


def proper_nouns(words: DataFrame, text_words: DataFrame) -> DataFrame:
    """Words with proper_noun: the book has them with a capital and never without. Both have (word)."""
    first = F.concat(F.lower(F.substring("word", 1, 1)), F.substring(F.col("word"), F.lit(2), F.length("word")))
    counts = text_words.groupBy(first.alias("key")).agg(F.count_if(F.col("word").rlike(r"^\p{Lu}")).alias("capital"), F.count_if(~F.col("word").rlike(r"^\p{Lu}")).alias("small"))
    own = words.withColumn("key", first).join(counts, "key", "left")
    return own.withColumn("proper_noun", (F.length("word") >= 2) & F.coalesce((F.col("capital") > 0) & (F.col("small") == 0), F.lit(False))).drop("key", "capital", "small")
