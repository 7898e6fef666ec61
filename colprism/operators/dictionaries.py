"""Lookups of values in dictionaries that are tables.

Small fixed lists are literals in the predicates; these operators serve
dictionaries that come as data, of any number of terms.  Values and terms meet
by equal keys (grams, segments, letters), never all against all, and every
pair that the keys let through is confirmed by the test itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse_spaces
from ..sources.results import stored

#: Code points of the longest gram; shorter terms are a gram of their own.
GRAM = 6
#: Rows of a table of grams that is broadcast: of at most 24 bytes each, so 50 MB at most.
SMALL = 1_000_000
#: Bytes of the texts of a table that is broadcast.
LIGHT_BYTES = 32_000_000
#: A word character (of ASCII letters, digits and the underscore; beyond ASCII all but general and CJK punctuation), and any
#: other: the two kinds of runs that texts are cut into.  Ranges are read faster than Unicode's categories.
_WORDLIKE = r"a-zA-Z0-9_\x{80}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}"
_WORD, _GAP = f"[{_WORDLIKE}]", f"[^{_WORDLIKE}]"
#: Letters whose frequency orders the letters of words; the rest count as the rarest.
RANKED_LETTERS = 4096


def _sized(frame: DataFrame) -> DataFrame:
    """``frame`` marked for broadcast if it is small; a larger one is joined as Spark sees fit."""
    return F.broadcast(frame) if frame.limit(SMALL + 1).count() <= SMALL else frame


def dictionary_union(*dictionaries: DataFrame) -> DataFrame:
    """Distinct terms of several dictionaries, in lower case with single blanks."""
    terms = [d.select(F.lower(collapse_spaces(F.col("term"))).alias("term")) for d in dictionaries]
    return reduce(DataFrame.unionByName, terms).distinct()


def match_exact(values: DataFrame, dictionary: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a dictionary term (left semi join; Spark sends small dictionaries to the values)."""
    return values.join(dictionary.select(F.col("term").alias(value)).distinct(), value, "left_semi")


def _terms(dictionary: DataFrame, term: str = "term") -> DataFrame:
    return dictionary.select(F.col(term).cast("string").alias("term")).where(F.col("term").isNotNull()).distinct()


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` code points; one pass over the text, as a look-ahead takes no room."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1))


def _no_gram() -> Column:
    return F.array().cast("array<string>")


def _containing(words: DataFrame, parts: DataFrame) -> DataFrame:
    """All (word, part) of two tables of distinct texts where the word contains the part, which is not empty.

    An inverted index of grams: a part of up to ``GRAM`` code points is a gram, a longer one has one for each place. Words
    list their distinct grams that some part has.  Each part then waits under its rarest gram only, and the pairs that
    meet there are confirmed by ``contains``.  A part with a gram that no word has meets nothing.
    """
    distinct = stored(words.select(F.monotonically_increasing_id().alias("id"), "word"), "words")
    of_part = stored(parts.select("part", F.explode(F.when(F.length("part") <= GRAM, F.array("part")).otherwise(_grams(F.col("part"), GRAM))).alias("gram")), "grams")
    sizes = sorted(r[0] for r in of_part.select(F.length("gram")).distinct().collect())  # at most GRAM numbers
    every = reduce(lambda all_, n: F.concat(all_, _grams(F.col("word"), n)), sizes, _no_gram())
    known = _sized(of_part.select("gram").distinct())
    of_word = stored(distinct.select("id", F.explode(every).alias("gram")).join(known, "gram", "left_semi"), "word-grams")
    frequency = of_word.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = of_part.join(frequency, "gram", "left")
    waiting = rated.groupBy("part").agg(F.min(F.struct("n", "gram")).alias("key"), F.count_if(F.col("n").isNull()).alias("unknown"))
    waiting = waiting.where("unknown = 0").select("part", F.col("key.gram").alias("gram"))
    met = of_word.join(waiting, "gram").select("id", "part")
    return met.join(distinct, "id").where(F.contains("word", "part")).select("word", "part")


def _runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _light(frame: DataFrame) -> DataFrame:
    """A stored frame of texts marked for broadcast if it is small by rows and bytes; a larger one is joined as Spark sees fit."""
    size = frame.agg(F.count(F.lit(1)), F.sum(sum(F.octet_length(c) for c in frame.columns))).first()
    return F.broadcast(frame) if size[0] <= SMALL // 2 and (size[1] or 0) <= LIGHT_BYTES else frame


def keyword_hits(values: DataFrame, dictionary: DataFrame, value: str = "value", term: str = "term", key: str | None = None) -> DataFrame:
    """All distinct (value, term) where the value contains the term; with ``key``, (key, term) where a value of the key does.

    Words first: a value that contains a term contains the term's longest run of word characters (or of others, if those
    are longer) inside one of its own runs.  So the distinct runs of all values, which are far fewer than their places,
    meet the terms' longest runs in an index of grams (``_containing``), once however often they occur, and one read of the
    values takes from each run the terms that wait there.  Terms of more than one run are confirmed by ``contains``.

    With ``key`` no value is shuffled, unless terms of several runs meet it; the hits are dealt by their key.  Nulls
    contain nothing and are no terms; the empty term is contained in every value.  Any number of terms will do: no plan
    holds them.
    """
    terms = _terms(dictionary, term)
    rows = values.select(*([F.col(key).alias("id")] if key else []), F.col(value).cast("string").alias("value")).where(F.col("value").isNotNull())
    if not key:
        rows = stored(rows.distinct().select(F.monotonically_increasing_id().alias("id"), "value"), "values")
    longest = F.array_max(F.transform(_runs(F.col("term"), f"{_WORD}+|{_GAP}+"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    of_term = stored(terms.where("term <> ''").select("term", longest.alias("part")), "terms")
    shape = of_term.groupBy(F.col("part").rlike(_WORD).alias("word")).agg(F.min(F.length("part")).alias("least"), F.max(F.col("part") != F.col("term")).alias("more")).collect()
    pattern = "|".join("{0}{{{1}}}{0}+".format(_WORD if r["word"] else _GAP, r["least"] - 1) for r in shape) or r"\z."
    runs = rows.select("id", F.explode(F.array_distinct(_runs(F.col("value"), pattern))).alias("word"))
    met = _containing(runs.select("word").distinct(), of_term.select("part").distinct()).join(of_term, "part").select("word", "term")
    found = runs.join(_light(stored(met, "word-terms")), "word").select("id", "term")
    found = found.repartition("id").distinct()
    if any(r["more"] for r in shape):
        several = stored(found.join(_sized(of_term.where("part <> term").select("term")), "term", "left_semi"), "several")
        held = several.withColumnRenamed("id", "_id").join(rows, F.expr("_id <=> id")).where(F.contains("value", "term")).select("id", "term")
        # Spark 4.1 takes the union of frames dealt alike for one dealt alike, but merges their partitions differently: the key is an expression.
        alone = found.join(_sized(of_term.where("part = term").select("term")), "term", "left_semi")
        found = alone.unionByName(held).select("id", F.concat("term", F.lit("")).alias("term")).distinct()
    if not terms.where("term = ''").isEmpty():
        found = found.unionByName(rows.select("id", F.lit("").alias("term")).distinct())
    if key:
        return found.select(F.col("id").alias(key), F.col("term").alias(term))
    return found.join(rows, "id").select(F.col("value").alias(value), F.col("term").alias(term))


def match_keywords(values: DataFrame, dictionary: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value contains some term: the answer of ``predicates.contains_any`` for a dictionary that is a table."""
    hits = keyword_hits(values, dictionary, value)
    return values.join(hits.select(F.col(value).alias("_hit")).distinct(), values[value].cast("string") == F.col("_hit"), "left_semi")


# Fuzzy matching: two words are similar if their edit distance is at most (1 - threshold) of the longer length.

def _most(longer: str, threshold: float) -> str:
    """SQL: the largest edit distance that leaves ``threshold`` for a word of the ``longer`` length."""
    return f"CAST(floor({longer} - {longer} * {threshold!r}D + 1e-9D) AS int)"


def _in_segments(side: str) -> str:
    """SQL: whether words of lengths k (value) and l (term) go by segments, where the longer one cuts into pieces of two or more."""
    return "greatest(k, l) >= 2 * (most + 1)" if side == "segments" else "greatest(k, l) < 2 * (most + 1)"


def _with_lengths(words: DataFrame, own: str, other: str, threshold: float, side: str) -> DataFrame:
    """``words`` (word) once for each length of the other side that allows a match; ``most`` is the distance allowed."""
    far = 1.0 / threshold
    span = f"sequence(greatest(CAST(ceil({own} * {threshold!r}D - 1e-9D) AS int), 1), CAST(floor({own} * {far!r}D + 1e-9D) AS int))"
    rows = words.select("*", F.length("word").alias(own)).where(f"{own} > 0").selectExpr("*", f"explode({span}) AS {other}")
    return rows.selectExpr("*", f"{_most('greatest(k, l)', threshold)} AS most").where(f"abs(k - l) <= most AND {_in_segments(side)}")


def _segment_keys(rows: DataFrame, cut: bool) -> DataFrame:
    """(word, k, l, most, place, piece): the pieces of the longer word, or the pieces of the shorter one that may equal them.

    The longer word is cut into most + 1 pieces; each edit spoils one, so one is whole in the shorter word, moved by no
    more than the edits before it, and, counted from the end, by no more than those after it.
    """
    longer, shorter = "greatest(k, l)", "least(k, l)"
    width = f"({longer} div (most + 1))"
    # The last pieces are one longer where the length does not divide.
    small = f"(most + 1 - {longer} % (most + 1))"
    start = f"(i * {width} + greatest(i - {small}, 0))"
    size = f"CAST({width} + IF(i >= {small}, 1, 0) AS int)"
    placed = rows.selectExpr("*", "explode(sequence(0, most)) AS i")
    placed = placed.selectExpr("word", "k", "l", "most", "CAST(i AS int) AS place", f"CAST({start} AS int) AS start", f"{size} AS size", f"{shorter} AS short", f"{longer} AS long")
    if cut:
        return placed.selectExpr("word", "k", "l", "most", "place", "substring(word, start + 1, size) AS piece")
    low = "greatest(0, start - place, start + short - long - (most - place))"
    high = "least(short - size, start + place, start + short - long + (most - place))"
    moved = placed.selectExpr("*", f"{low} AS low", f"{high} AS high").where("low <= high")
    return moved.selectExpr("word", "k", "l", "most", "place", "explode(sequence(low, high)) AS at", "size").selectExpr(
        "word", "k", "l", "most", "place", "substring(word, at + 1, size) AS piece").distinct()


def _by_segments(values: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (value, term, most) that share a piece in place."""
    left, right = _with_lengths(values, "k", "l", threshold, "segments"), _with_lengths(terms, "l", "k", threshold, "segments")
    out = []
    for test, value_cuts in (("l >= k", False), ("k > l", True)):
        a = _segment_keys(left.where(test), value_cuts).withColumnRenamed("word", "value")
        b = _segment_keys(right.where(test), not value_cuts).withColumnRenamed("word", "term")
        out.append(a.join(b, ["k", "l", "most", "place", "piece"]).select("value", "term", "most"))
    return out[0].unionByName(out[1]).distinct()


def _lettered(words: DataFrame, ranks: Column) -> DataFrame:
    """``words`` with ``letters``: each letter with its frequency and its number among equal ones, the rarest first."""
    sorted_ = words.select("word", F.array_sort(F.regexp_extract_all("word", F.lit("(?s)."), 0)).alias("s"))
    token = lambda c, i: F.struct((-F.coalesce(ranks[c], F.lit(RANKED_LETTERS))).alias("r"), c.alias("c"), (i - F.array_position("s", c)).cast("int").alias("n"))
    return sorted_.select("word", F.array_sort(F.transform("s", token)).alias("letters"))


def _by_letters(values: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (value, term, most) of short words, by lengths and letter counts.

    Two words at distance d of the longer length m share at least m - d letters, counted with repeats.  Words of one bag
    of letters are one row.  Ordered by rarity, the first letters of both bags, as many as the bag may lack plus one, have a
    letter in common; only such bags meet, at their first common letter, and all their letters are then compared.
    """
    every = values.unionByName(terms).select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)."), 0))).alias("c"))
    common = every.groupBy("c").count().orderBy(F.desc("count"), "c").limit(RANKED_LETTERS).collect()
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(common) for x in (r["c"], i)]) if common else F.create_map().cast("map<string,int>")

    def keyed(words: DataFrame, own: str, other: str, name: str) -> tuple[DataFrame, DataFrame]:
        lettered = stored(_lettered(words, ranks), "letters")
        bags = _with_lengths(lettered.select("letters").distinct().select("letters", F.concat_ws("", F.transform("letters", lambda t: t["c"])).alias("word")), own, other, threshold, "letters")
        first = f"slice(letters, 1, {own} - (greatest(k, l) - most) + 1)"
        keys = bags.selectExpr("k", "l", "most", f"letters AS {name}", f"{first} AS {name}_first").selectExpr("*", f"explode({name}_first) AS letter")
        return lettered.withColumnsRenamed({"word": f"{name}_word", "letters": name}), keys

    value_words, a = keyed(values, "k", "l", "a")
    term_words, b = keyed(terms, "l", "k", "b")
    met = a.join(b, ["k", "l", "most", "letter"])
    met = met.where("letter = array_intersect(a_first, b_first)[0] AND size(array_intersect(a, b)) >= greatest(k, l) - most").select("a", "b", "most")
    named = met.join(value_words, "a").join(term_words, "b")
    return named.select(F.col("a_word").alias("value"), F.col("b_word").alias("term"), "most")


def similar_terms(values: DataFrame, dictionary: DataFrame, threshold: float = 0.5, value: str = "value", term: str = "term") -> DataFrame:
    """All distinct (value, term) whose similarity, 1 - edit distance / longer length, is at least ``threshold``.

    Lengths are known first: a pair of lengths allows so many edits.  Where the longer word cuts into that many pieces
    plus one of two code points or more, one piece must stand in the other word nearly in place (``_by_segments``);
    pairs of shorter words are found by the letters they must share (``_by_letters``).  A bounded ``levenshtein``
    confirms each pair.  No join is without equal keys, and no plan holds the terms.

    Nulls and empty words match nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    words = stored(values.select(F.col(value).cast("string").alias("word")).where("word <> ''").distinct(), "words")
    terms = stored(_terms(dictionary, term).withColumnRenamed("term", "word").where("word <> ''"), "terms")
    pairs = _by_segments(words, terms, threshold).unionByName(_by_letters(words, terms, threshold))
    close = pairs.where(F.expr("levenshtein(value, term, most) >= 0"))
    return close.select(F.col("value").alias(value), F.col("term").alias(term))


def match_similar(values: DataFrame, dictionary: DataFrame, threshold: float = 0.5, value: str = "value") -> DataFrame:
    """Rows whose value is similar to some term: the answer of ``predicates.similar_to`` for a dictionary that is a table.

    Values that are terms are settled by an equal join; only the rest is compared.
    """
    word = F.col(value).cast("string").alias("word")
    distinct = values.select(word).where("word <> ''").distinct()
    terms = _terms(dictionary)
    rest = distinct.join(terms.withColumnRenamed("term", "word"), "word", "left_anti")
    same = distinct.join(terms.withColumnRenamed("term", "word"), "word", "left_semi")
    near = similar_terms(rest, terms, threshold, "word").select("word").distinct()
    # Spark 4.1 takes the union of frames dealt alike for one dealt alike, but merges their partitions differently: the key is an expression.
    hit = F.concat("word", F.lit("")).alias("_hit")
    found = same.select(hit).unionByName(near.select(hit))
    return values.join(found, values[value].cast("string") == F.col("_hit"), "left_semi")
