"""Full-text search: stemmed, positional postings; documents ranked by BM25; phrases by the places of their words.

The index is a table (term, key, uses, places, length) with one row per term of a document. Searches take a table of
queries (query, text), so that one plan answers many; a query is joined to the postings of its terms alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import let
from ..sources.scratch import durable
from .reports import by_key, counted, dealt, of_run, runs, terms

# The suffixes of the published stemming algorithm (Porter 1980), steps 2 to 4, and what takes their place
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Scores are whole numbers of this part of one
UNITS = 1_000_000_000

#: The documents whose postings a task holds, so that its memory stays as tables grow
DOCS = 4_000

# Vowels once every y that is a consonant is written Y; a measure of m asks for m changes from vowel to consonant
_V, _C = "[aeiouy]", "[^aeiouy]"
_SOME, _TWO, _ONE = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}*$"
_DOUBLE, _CVC = f"({_C})\\1$", f"{_C}{_V}[^aeiouywxY]$"


def stem(word: Column) -> Column:
    """The stem of a lower-case English word by Porter's algorithm as published; words of up to two letters, and others than a-z, stay."""
    steps = [_plurals, _past, lambda w: F.when(F.right(w, F.lit(1)).isin("y", "Y") & w.rlike(f"{_V}.*[yY]$"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w), _mapped(STEP_2), _mapped(STEP_3), _bare, _final_e, lambda w: F.when(w.endswith("ll") & w.rlike(_TWO), _less(w, 1)).otherwise(w)]
    told = F.when(word.contains("y"), F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")).otherwise(word)
    for step in steps:
        told = let(told, step)
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(told)).otherwise(word)


def _less(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _plurals(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _less(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _less(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    """Endings of the past and the participle, and the repair of what they leave."""

    def mended(s: Column) -> Column:
        doubled = s.rlike(_DOUBLE) & ~s.rlike("[lsz]$")
        return F.when(s.rlike("(?:at|bl|iz)$") | (~doubled & s.rlike(_ONE) & s.rlike(_CVC)), F.concat(s, F.lit("e"))).when(doubled, _less(s, 1)).otherwise(s)

    eed = F.when(_less(w, 3).rlike(_SOME), _less(w, 1)).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed") & w.rlike(f"{_V}.*ed$"), let(_less(w, 2), mended)).when(w.endswith("ing") & w.rlike(f"{_V}.*ing$"), let(_less(w, 3), mended)).otherwise(w)


def _ending(w: Column, suffixes) -> Column:
    """(before, suffix) for the longest of the suffixes, if any; the first of the two is taken as short as may be."""
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    return F.struct(F.regexp_extract(w, pattern, 1).alias("before"), F.regexp_extract(w, pattern, 2).alias("suffix"))


def _may_end(w: Column, suffixes) -> Column:
    """Whether the last two letters are those of a suffix; it spares most words the patterns."""
    return F.right(w, F.lit(2)).isin(*sorted({s[-2:] for s in suffixes}))


def _mapped(table: dict[str, str]):
    instead = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    mapped = lambda w: let(_ending(w, table), lambda e: F.when((e["suffix"] != "") & e["before"].rlike(_SOME), F.concat(e["before"], instead[e["suffix"]])).otherwise(w))
    return lambda w: F.when(_may_end(w, table), mapped(w)).otherwise(w)


def _bare(w: Column) -> Column:
    goes = lambda e: (e["suffix"] != "") & e["before"].rlike(_TWO) & ((e["suffix"] != "ion") | e["before"].rlike("[st]$"))
    return F.when(_may_end(w, STEP_4), let(_ending(w, STEP_4), lambda e: F.when(goes(e), e["before"]).otherwise(w))).otherwise(w)


def _final_e(w: Column) -> Column:
    goes = lambda s: s.rlike(_TWO) | (s.rlike(_ONE) & ~s.rlike(_CVC))
    return F.when(w.endswith("e"), let(_less(w, 1), lambda s: F.when(goes(s), s).otherwise(w))).otherwise(w)


def index(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None, stemmed: bool = False, wanted: DataFrame | None = None, places: bool = True) -> DataFrame:
    """(term, key, uses, places, length): the places of a term in a document in order, and how many terms the document has.

    A place counts the terms before it, stop words excluded. Documents without terms have no row; ``key`` is taken to name one row, rows that share it
    count as one document whose places may coincide. With ``wanted`` (term, ...) other terms are left out before anything is grouped, for searches without a stored
    index; without ``places`` that column is missing. Texts are dealt by key once, and the terms of a row are counted within it; only rows of one key
    are grouped beyond that.
    """
    only = (lambda x: x) if wanted is None else lambda x: x.join(wanted.select("term").distinct(), "term", "left_semi")

    held = lambda t: _stems(counted(t, places), places) if stemmed else counted(t, places)

    def spread(rows: DataFrame) -> DataFrame:
        each = rows.select(key, let(terms(F.col("_x"), stop_words), lambda t: F.struct(F.size(t).cast("bigint").alias("length"), held(t).alias("held"))).alias("_t"))
        rows = each.select(key, F.col("_t.length").alias("length"), F.explode_outer("_t.held").alias("_e")).where("_e is not null")  # outer: the plain one would look for terms a second time
        return only(rows.select(F.col("_e.term").alias("term"), key, F.col("_e.uses").alias("uses"), *([F.col("_e.places").alias("places")] if places else []), "length"))

    alone, shared = by_key(docs.select(F.col(key), F.col(text).alias("_x")), key)
    one = spread(dealt(alone, key))
    if shared is None:
        return one
    merged = spread(shared).groupBy("term", key).agg(F.sum("uses").alias("uses"), *([F.array_sort(F.flatten(F.collect_list("places"))).alias("places")] if places else []), F.max("length").alias("length"))
    return one.unionByName(merged)


def _stems(held: Column, places: bool) -> Column:
    """``counted`` terms with stems for terms: each is taken once per row, and words that share one share its uses and places."""
    told = F.transform(held, lambda e: F.struct(stem(e["term"]).alias("term"), e["uses"].alias("uses"), *([e["places"].alias("places")] if places else [])))

    def built(x: Column):
        uses = lambda start, end: F.aggregate(of_run(x, start, end, lambda e: e["uses"]), F.lit(0).cast("bigint"), lambda n, m: n + m)
        at = lambda start, end: [F.sort_array(F.flatten(of_run(x, start, end, lambda e: e["places"]))).alias("places")] if places else []
        return lambda start, end: F.struct(F.get(x, start)["term"].alias("term"), uses(start, end).alias("uses"), *at(start, end))

    return let(F.sort_array(told), lambda x: runs(x, lambda e: e["term"], built(x)))


def sizes(docs: DataFrame, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """One row (n, mean): how many documents have a term, and how many they have on average."""
    counted = F.size(terms(F.col(text), stop_words)) if stop_words else F.regexp_count(F.lower(F.col(text)), F.lit("[a-z0-9]+"))
    n = docs.select(counted.alias("n")).where("n > 0")
    return n.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"))


def asked(queries: DataFrame, query: str, text: str, stop_words: list[str] | None = None, stemmed: bool = False) -> DataFrame:
    """(query, term, place): the terms of each query, as the index has them."""
    found = queries.select(query, F.posexplode(terms(F.col(text), stop_words)).alias("place", "term"))
    return found.withColumn("term", stem(F.col("term"))) if stemmed else found


def ranked(index_: DataFrame, key: str, wanted: DataFrame, query: str, sizes_: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank): the ``k`` best documents of each query by BM25; equal scores by the smaller key.

    ``wanted``: (query, term), as ``asked`` gives it; a repeated term counts once. ``sizes_``: as ``sizes`` gives it. What a term adds is rounded to nine decimals
    and added as an integer, so that reruns agree.
    """
    numbers = _numbered(wanted)
    held = durable(index_.select("term", key, "uses", "length").join(numbers, "term").select("_t", key, "uses", "length"))
    return _best(held, key, wanted, numbers, query, sizes_, _parts(held.select(key).distinct()), k, k1, b)


def ranked_texts(docs: DataFrame, key: str, text: str, wanted: DataFrame, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75, stop_words: list[str] | None = None) -> DataFrame:
    """``ranked`` over texts that have no stored index (without stems): they are read once, for the uses of the wanted terms and for how many terms each has.

    A term that is not wanted is dropped as it is found, before anything is sorted or grouped. The empty string ends each text that has terms and is
    held like a term (number -1): its uses are the documents, and their lengths are added there.
    """
    numbers = _numbered(wanted)
    sought = durable(numbers.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("bigint").alias("_t"))))
    ended = lambda t: F.struct(F.size(t).cast("bigint").alias("length"), F.when(F.size(t) > 0, F.concat(t, F.array(F.lit("")))).alias("terms"))
    texts = docs.select(F.col(key), F.col(text).alias("_x"))
    parts = _parts(texts)
    each = texts.repartition(parts, key).select(key, let(terms(F.col("_x"), stop_words), ended).alias("_e"))
    found = each.select(key, F.col("_e.length").alias("length"), F.explode_outer("_e.terms").alias("term"))  # outer: the plain one would look for terms a second time
    end = F.sum(F.when(F.col("_t") == -1, F.col("length")))
    held = durable(found.join(sought, "term").groupBy("_t", key).agg(F.count(F.lit(1)).alias("uses"), F.max("length").alias("length"), end.alias("_all")))
    sizes_ = held.where("_t = -1").agg(F.sum("uses").alias("n"), (F.sum("_all") / F.sum("uses")).alias("mean"))
    return _best(held.where("_t >= 0").drop("_all"), key, wanted, numbers, query, sizes_, parts, k, k1, b)


def _numbered(wanted: DataFrame) -> DataFrame:
    """(term, _t): the wanted terms with a number each, from 0."""
    return durable(wanted.select("term").distinct().where("term != ''").select("term", F.monotonically_increasing_id().alias("_t")))


def _parts(docs: DataFrame) -> int:
    """The shuffle partitions, or more where a part would have over ``DOCS`` documents."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS))


def _best(held: DataFrame, key: str, wanted: DataFrame, numbers: DataFrame, query: str, sizes_: DataFrame, parts: int, k: int, k1: float, b: float) -> DataFrame:
    """``ranked`` over the postings (_t, key, uses, length) of the wanted terms.

    What a term adds to a document is the same in every query, so it is worked out once per posting. Postings are dealt by key: a document's scores are added up,
    and the best of each part taken, where they lie, and what is shuffled after that is ``k`` rows of a query and part at most. (Leaving out documents whose terms
    are too common to reach the k-th best was tried: it needs a second pass and a shuffle of postings, and cost more.)
    """
    df = held.groupBy("_t").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = durable(df.crossJoin(F.broadcast(sizes_)).select("_t", idf.alias("idf"), "mean"))
    pairs = durable(wanted.select(query, "term").distinct().join(numbers, "term").select(query, "_t"))
    exact = F.col("idf") * F.col("uses") * (k1 + 1) / (F.col("uses") + k1 * (1 - b + b * F.col("length") / F.col("mean"))) * UNITS
    # half up, as ``round`` has it, without its decimals
    part = F.floor("_x") + (F.col("_x") - F.floor("_x") >= 0.5).cast("bigint")
    added = held.join(weights, "_t").select("_t", key, exact.alias("_x")).select("_t", key, part.alias("_p"))
    scores = added.repartition(parts, key).join(pairs, "_t").groupBy(query, key).agg(F.sum("_p").alias("_s"))
    best = Window.partitionBy(query).orderBy(F.desc("_s"), key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query, key, (F.col("_s") / UNITS).alias("score"), "rank")


def phrases(index_: DataFrame, key: str, wanted: DataFrame, query: str) -> DataFrame:
    """(query, key, uses): the documents that hold the terms of a query one after the other, and how often.

    ``wanted``: (query, term, place), as ``asked`` gives it. Every place of the rarest term (of equal ones the first) is a start that may be; the other terms are joined
    by (term, key), so a common word is looked up only in documents that have the rare one, and a start stays if all their places fit.
    """
    held = durable(index_.select("term", key, "places").join(wanted.select("term").distinct(), "term", "left_semi"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    ordered = Window.partitionBy(query).orderBy(F.coalesce("_df", F.lit(0)), "place")
    sought = durable(wanted.join(df, "term", "left").select(query, "term", "place", F.row_number().over(ordered).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(query)).alias("_m")))
    moved = lambda: F.transform("places", lambda p: p - F.col("place"))
    rare = held.join(sought.where("_r = 1"), "term").select(query, key, F.col("_m").alias("_n"), moved().alias("_starts"))
    others = sought.where("_r > 1").select(query, "term", "place")
    # (query, key) is one document and one query: a row per further term
    met = rare.join(others, query).join(held, ["term", key]).select(query, key, "_n", "_starts", moved().alias("_at"))
    rest = met.groupBy(query, key).agg(F.min("_n").alias("_n"), F.min("_starts").alias("_starts"), F.collect_list("_at").alias("_ats"))
    left = F.aggregate("_ats", F.col("_starts"), lambda kept, at: F.array_intersect(kept, at))
    several = rest.where(F.size("_ats") == F.col("_n") - 1).select(query, key, F.size(left).cast("bigint").alias("uses"))
    single = rare.where("_n = 1").select(query, key, F.size("_starts").cast("bigint").alias("uses"))
    return several.unionByName(single).where("uses > 0")
