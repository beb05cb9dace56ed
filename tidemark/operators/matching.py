"""Record matching: substring joins, ranked first match, nearest, semi and anti, conditional overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import ngrams

#: Dictionary rows up to which a substring join goes as a map of literals; beyond that n-grams prefilter it.
SMALL_DICTIONARY = 2000


def substring_hits(texts: DataFrame, text: str, words: DataFrame, keep: list[str], gram: int = 3, small: int = SMALL_DICTIONARY) -> DataFrame:
    """Theta join on "text contains word" (words: group, word, pos): (keep..., group, word, pos).

    A dictionary of ``small`` rows at most (its size is checked) goes along as a literal list. Of a larger one, words
    of ``gram`` characters or more are looked up by their first ``gram`` characters among the text's n-grams, an
    equi-join, and verified; a shorter one is among the text's n-grams of its own length, or not in it.
    """
    listed = words.limit(small + 1).collect()
    if len(listed) <= small:
        if not listed:
            return texts.join(words, F.lit(False)).select(*keep, "group", "word", "pos")
        options = F.array(*(F.struct(F.lit(r["group"]).alias("group"), F.lit(r["word"]).alias("word"), F.lit(r["pos"]).alias("pos")) for r in listed))
        return texts.select(*keep, F.inline(F.filter(options, lambda o: F.contains(F.col(text), o["word"]))))
    out = None
    for n in range(1, gram + 1):
        own = words.filter(F.length("word") == n if n < gram else F.length("word") >= gram).withColumn("_g", F.substring("word", 1, n))
        met = texts.withColumn("_g", F.explode(F.array_distinct(ngrams(F.col(text), n)))).join(own, "_g").filter(F.contains(F.col(text), F.col("word"))).select(*keep, "group", "word", "pos")
        out = met if out is None else out.unionByName(met)
    return out


def first_hit(hits: DataFrame, by: list[str]) -> DataFrame:
    """One hit for each text and group: that of the word that comes first."""
    return hits.groupBy(*by).agg(F.min_by("word", "pos").alias("word"), F.min("pos").alias("pos"))


def first_match(left: DataFrame, key: str, ranked: list[DataFrame]) -> DataFrame:
    """Cascaded lookup: of several match tables (key, match, pos), in order of precedence, the first match.

    Within a table the dictionary's position decides, and the name on a tie.
    """
    every = None
    for rank, m in enumerate(ranked):
        part = m.select(key, "match", "pos", F.lit(rank).alias("rank"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(key).agg(F.min(F.struct("rank", "pos", "match")).alias("m"))
    return left.join(best, key, "left").withColumn("match", F.col("m.match")).withColumn("rank", F.col("m.rank")).drop("m")


def cascade(names: DataFrame, key: str, dictionary: DataFrame, aliases: DataFrame, alias_first: bool = False, prefix: int = 4) -> DataFrame:
    """Exact, alias and bidirectional prefix lookup of names in a dictionary (name, pos)."""
    exact = names.join(dictionary, names[key] == dictionary["name"]).select(key, F.col("name").alias("match"), "pos")
    by_alias = names.join(aliases, names[key] == aliases["alias"]).select(key, F.col("target").alias("name")).join(dictionary, "name").select(key, F.col("name").alias("match"), "pos")
    # of the names with one prefix the first alone can be the match, so a frequent prefix makes one row
    heads = dictionary.groupBy(F.substring("name", 1, prefix).alias("_h")).agg(F.min(F.struct("pos", "name")).alias("m"))
    close = names.withColumn("_h", F.substring(key, 1, prefix)).join(heads, "_h").select(key, F.col("m.name").alias("match"), F.col("m.pos").alias("pos"))
    return first_match(names, key, [*((by_alias, exact) if alias_first else (exact, by_alias)), close])


def normalised_match(left: Column, right: Column) -> Column:
    """Equal once spaces and slashes are dropped, or all terms of more than one character contained."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\s/_]+", "")
    terms = F.filter(F.split(F.lower(left), r"[\s/_]+"), lambda t: F.length(t) > 1)
    return (bare(left) == bare(right)) | ((F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(F.lower(right), t)))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


#: Rows of the stated side that go to all tasks at once.
MOST_AT_ONCE, BLOCK = 10_000, 256


def in_blocks(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Each row with each row of a stated set. A set whose size, checked here, allows it goes to all tasks; a larger one meets
    the rows in blocks of BLOCK, dealt by a hash of its rows, so that no task holds more of it than a block."""
    n = stated.count()
    if n <= MOST_AT_ONCE:
        return rows.join(F.broadcast(stated))
    block = F.pmod(F.xxhash64(*stated.columns), F.lit(-(-n // BLOCK)))
    packed = stated.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(*stated.columns)).alias("_set")).drop("_block")
    return rows.join(packed).select(*rows.columns, F.inline("_set"))


def nearest(points: DataFrame, centres: DataFrame, distance: Column, key: str, centre: str) -> DataFrame:
    """Each point's nearest of a set of centres (the lowest name on a tie): every point meets every centre, block by block."""
    best = F.min(F.struct(distance.alias("d"), F.col(centre).alias("c")))
    return in_blocks(points, centres).groupBy(key).agg(best.alias("m")).select(key, F.col("m.c").alias(centre), F.col("m.d").alias("d"))


def overwritten(df: DataFrame, key: str, month: str, value: str, chosen: Column, baseline_end: str, reset: str) -> DataFrame:
    """Chosen keys' values from ``reset`` on replaced by their mean up to ``baseline_end``."""
    mean = F.avg(F.when(F.col(month) <= baseline_end, F.col(value))).over(Window.partitionBy(key))
    return df.withColumn(value, F.when(chosen & (F.col(month) >= reset), mean).otherwise(F.col(value)))


def upsert_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.unionByName(new.join(table, key, "left_anti"))


def agreement(estimated: DataFrame, real: DataFrame, key: str, value: str) -> DataFrame:
    """n, Pearson r and mean absolute error of two tables joined by key; null under three pairs."""
    j = estimated.select(key, F.col(value).alias("a")).join(real.select(key, F.col(value).alias("b")), key)
    n = F.count("*")
    return j.agg(n.alias("n"), F.when(n >= 3, F.corr("a", "b")).alias("r"), F.when(n >= 3, F.avg(F.abs(F.col("a") - F.col("b")))).alias("mae"))
