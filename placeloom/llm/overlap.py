"""Records of evaluation splits that repeat, exactly or almost, a record of the training split about the same place.

Queries are compared folded: lower case, dotless and dotted i as one, without punctuation. Two folded queries of one
place are a case if they are equal without blanks, or at most ``slips(length)`` insertions, deletions, substitutions or
swaps of neighbours apart, or equal but for one word more, less or moved.

Slips are found by an edit-distance segment join: an evaluation string is cut into k + 1 segments with one free character
between them, so that no slip, a swap included, can touch two segments; at least one segment then occurs unchanged in the
training string, at a position that differs by no more than the slips on its left and on its right allow. Training
strings give their substrings at these positions, only for lengths that evaluation strings of the same place have. One
word more or less is found by the strings without one word, a moved word by the sorted words. All of these are keys of
8 bytes that hold the place; keys and numbers of texts alone are joined, and the texts are fetched for the candidates,
which are verified by banded dynamic programming.

Defined cases: a place is the set of geonameids, else the names between the commas of name; records with neither are
compared with each other only; null and blank queries and records without a split are no case; repeated rows count once;
equal queries are joined as classes and spread to their records at the end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.runtime import collation_free_blank, cut, once

#: Slips allowed from these lengths (code points without blanks) on: the usual values, a parameter of the functions.
SLIPS = ((4, 1), (8, 2), (12, 3))
Steps = tuple[tuple[int, int], ...]


def slips(n: int, steps: Steps = SLIPS) -> int:
    return max([k for least, k in steps if n >= least], default=0)


def _slips_sql(n: str, steps: Steps) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {least} THEN {k}" for least, k in sorted(steps, reverse=True)) + " ELSE 0 END"


def folded(c: Column) -> Column:
    """Words in lower case and without punctuation, one blank between them."""
    v = F.translate(F.lower(c), "ı̇", "i")
    v = F.regexp_replace(v, r"[^\p{L}\p{N}\p{M}\s\p{Z}]+", "")
    return collation_free_blank(v)


def place_key(ids: Column, name: Column) -> Column:
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(name, ","), lambda p: F.lower(collation_free_blank(p))), lambda p: p != "")))
    by_name = F.when(F.size(parts) > 0, F.concat(F.lit("n:"), F.array_join(parts, ",")))
    return F.coalesce(F.when(F.size(ids) > 0, F.concat(F.lit("i:"), F.array_join(F.sort_array(F.array_distinct(ids)).cast("array<string>"), ","))), by_name, F.lit(""))


def within(a: str, b: str, k: int) -> bool:
    """Whether a and b are at most k slips apart (restricted Damerau distance), in a band of width 2k + 1."""
    la, lb = len(a), len(b)
    if abs(la - lb) > k:
        return False
    far = k + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(lb, k) + 1)}
    for i in range(1, la + 1):
        lo, hi = max(0, i - k), min(lb, i + k)
        new: dict[int, int] = {}
        for j in range(lo, hi + 1):
            if j == 0:
                new[0] = i
                continue
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values()) > k:
            return False
        before, row = row, new
    return row.get(lb, far) <= k


def one_moved(a: list[str], b: list[str]) -> bool:
    """Whether b is a with one word moved."""
    if len(a) != len(b) or a == b:
        return False
    i = next(i for i in range(len(a)) if a[i] != b[i])
    j = next(j for j in range(len(a), 0, -1) if a[j - 1] != b[j - 1])
    x, y = a[i:j], b[i:j]
    return x[1:] + x[:1] == y or x[-1:] + x[:-1] == y


@F.pandas_udf(T.BooleanType())
def _slipped(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([x is not None and within(x, y, n) for x, y, n in zip(a, b, k)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _moved(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and one_moved(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)


#: The words of q joined without the i-th, as an expression in i.
_WITHOUT = "concat(array_join(slice(words, 1, i - 1), ''), array_join(slice(words, i + 1, size(words)), ''))"


def _shortened(tag: str) -> str:
    """Keys of the text without each of its words in turn, where a text of the other side has that length; one string at a time."""
    return f"""IF(size(words) > 1, transform(filter(sequence(1, size(words)), i -> array_contains(lengths, m - length(element_at(words, i)))), i -> xxhash64(place, '{tag}', {_WITHOUT})), array())"""


def _one_more(words: str, flat: str, other: str) -> str:
    """Whether a text is the other one and a word; only positions where the lengths fit are tried."""
    without = _WITHOUT.replace("words", words)
    return f"(size({words}) > 1 AND exists(sequence(1, size({words})), i -> length({flat}) - length(element_at({words}, i)) = length({other}) AND {without} = {other}))"


def _segments(steps: Steps, n: str) -> str:
    """Segments of evaluation strings of length n: k + 1 segments, one free character between neighbours."""
    k = f"({_slips_sql(n, steps)})"
    size, rest = f"(({n} - {k}) div ({k} + 1))", f"(({n} - {k}) % ({k} + 1))"
    return f"""transform(sequence(1, {k} + 1), i -> struct({n} AS n, i AS i, {k} AS k,
      CAST((i - 1) * ({size} + 1) + greatest(0, i - 1 - ({k} + 1 - {rest})) AS INT) AS p, CAST({size} + IF(i > {k} + 1 - {rest}, 1, 0) AS INT) AS l))"""


def _evaluation_keys(steps: Steps) -> str:
    own = f"transform(filter({_segments(steps, 'm')}, x -> x.k > 0), x -> xxhash64(place, x.n, x.i, substring(flat, x.p + 1, x.l)))"
    return f"array_distinct(concat({own}, array(xxhash64(place, 'full', flat), xxhash64(place, 'more', flat), xxhash64(place, 'bag', sort_array(words))), {_shortened('less')}))"


def _training_keys(steps: Steps) -> str:
    """Keys of a training string of length m at the allowed shifts s: at most i - 1 slips lie left of segment i, k + 1 - i right."""
    k = _slips_sql("n", steps)
    near = f"filter(lengths, n -> abs(m - n) <= ({k}) AND ({k}) > 0)"
    own = f"""flatten(transform(flatten(transform({near}, n -> {_segments(steps, 'n')})), x -> transform(
      filter(sequence(1 - x.i, x.i - 1), s -> s BETWEEN m - x.n - (x.k + 1 - x.i) AND m - x.n + (x.k + 1 - x.i) AND x.p + s >= 0 AND x.p + s + x.l <= m),
      s -> xxhash64(place, x.n, x.i, substring(flat, x.p + s + 1, x.l)))))"""
    return f"array_distinct(concat({own}, array(xxhash64(place, 'full', flat), xxhash64(place, 'less', flat), xxhash64(place, 'bag', sort_array(words))), {_shortened('more')}))"


def _texts(df: DataFrame, key: str, query: str, name: str, ids: str, split: str) -> DataFrame:
    side = F.lower(F.trim(F.col(split)))
    rows = df.select(F.col(key).alias("id"), F.col(query).alias("raw"), place_key(F.col(ids), F.col(name)).alias("place"), F.when(side == "train", True).when(side.isNotNull() & (side != ""), False).alias("train"))
    folds = once(rows.filter("raw is not null and train is not null and id is not null"), q=folded(F.col("raw")))
    return folds.filter("q <> ''").select("id", "q", "place", "train").distinct()


def matching_texts(texts: DataFrame, steps: Steps = SLIPS) -> DataFrame:
    """Distinct (place, eq, tq): folded queries of an evaluation and of a training record that are a case.

    ``texts`` has the columns place, q and train.
    """
    # texts are numbered and kept, as numbers hold for one run only
    own = cut(texts.select("place", "q", "train").distinct().withColumn("number", F.monotonically_increasing_id()))
    full = own.select("*", F.regexp_replace("q", " ", "").alias("flat")).withColumn("m", F.length("flat"))
    lengths = full.groupBy("place").agg(F.collect_set(F.when(~F.col("train"), F.col("m"))).alias("held"), F.collect_set(F.when(F.col("train"), F.col("m"))).alias("seen")).filter("size(held) > 0 and size(seen) > 0")
    met = full.join(lengths, "place").withColumn("words", F.split("q", " "))
    e = met.filter("not train").withColumn("lengths", F.col("seen")).select(F.col("number").alias("en"), F.explode(F.expr(_evaluation_keys(steps))).alias("key"))
    t = met.filter("train").withColumn("lengths", F.col("held")).select(F.col("number").alias("tn"), F.explode(F.expr(_training_keys(steps))).alias("key"))
    candidates = e.join(t, "key").select("en", "tn").distinct()
    et = own.filter("not train").select(F.col("number").alias("en"), F.col("place").alias("ep"), F.col("q").alias("eq"))
    tt = own.filter("train").select(F.col("number").alias("tn"), "place", F.col("q").alias("tq"))
    both = candidates.join(et, "en").join(tt, "tn").filter("ep = place").select("place", "eq", "tq", F.regexp_replace("eq", " ", "").alias("ef"), F.regexp_replace("tq", " ", "").alias("tf"), F.split("eq", " ").alias("ew"), F.split("tq", " ").alias("tw"))
    # decided in the JVM: equal without blanks, or one word more or less
    sure = F.expr(f"ef = tf OR {_one_more('tw', 'tf', 'ef')} OR {_one_more('ew', 'ef', 'tf')}")
    k = F.expr(f"CAST({_slips_sql('length(ef)', steps)} AS INT)")
    # a swap is two plain edits at most, so the JVM's bounded distance discards most others before the exact one
    judged = both.select("place", "eq", "tq", "ef", "tf", sure.alias("sure"), k.alias("k"), F.expr("size(ew) = size(tw) AND sort_array(ew) = sort_array(tw)").alias("same_words"))
    judged = judged.withColumn("close", F.expr("NOT sure AND k > 0 AND levenshtein(ef, tf, 2 * k) >= 0")).filter("sure or close or same_words")
    exact = judged.select("place", "eq", "tq", "sure", _slipped(F.when(F.col("close"), F.col("ef")), "tf", "k").alias("slipped"), _moved(F.when(F.col("same_words") & ~F.col("sure"), F.col("eq")), "tq").alias("moved"))
    return exact.filter("sure or slipped or moved").select("place", "eq", "tq")


def _cases(df: DataFrame, key: str, query: str, name: str, ids: str, split: str, steps: Steps) -> tuple[DataFrame, DataFrame]:
    texts = cut(_texts(df, key, query, name, ids, split))
    return texts, matching_texts(texts, steps)


def cross_split_pairs(df: DataFrame, key: str = "request_id", query: str = "query", name: str = "name", ids: str = "geonameid", split: str = "split", steps: Steps = SLIPS) -> DataFrame:
    """Distinct (eval_id, train_id) of records that are a case. ``cross_split_classes`` gives the same without expanding repeated texts."""
    texts, pairs = _cases(df, key, query, name, ids, split, steps)
    e = texts.filter("not train").select("place", F.col("q").alias("eq"), F.col("id").alias("eval_id"))
    t = texts.filter("train").select("place", F.col("q").alias("tq"), F.col("id").alias("train_id"))
    return pairs.join(e, ["place", "eq"]).join(t, ["place", "tq"]).select("eval_id", "train_id").distinct()


def cross_split_classes(df: DataFrame, key: str = "request_id", query: str = "query", name: str = "name", ids: str = "geonameid", split: str = "split", steps: Steps = SLIPS) -> tuple[DataFrame, DataFrame]:
    """(pairs of texts, members): place, eq, tq of texts that are a case, and id, place, q, train of every record."""
    texts, pairs = _cases(df, key, query, name, ids, split, steps)
    return pairs, texts.select("id", "place", "q", "train")


def overlap_report(df: DataFrame, source: str = "sample_source", key: str = "request_id", query: str = "query", name: str = "name", ids: str = "geonameid", split: str = "split", steps: Steps = SLIPS) -> DataFrame:
    """For each evaluation split and source: records, records with a case, and pairs.

    Pairs are counted by classes of equal texts, sizes multiplied; only records that have several texts are expanded, as
    a pair of them may be a case by more than one text and counts once.
    """
    texts, pairs = _cases(df, key, query, name, ids, split, steps)
    pairs = cut(pairs)
    several = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    one, many = texts.join(several, "id", "left_anti"), texts.join(several, "id", "left_semi")
    side = lambda x, train, q, i: x.filter(F.col("train") == train).select("place", F.col("q").alias(q), F.col("id").alias(i))
    sizes = side(one, True, "tq", "id").groupBy("place", "tq").agg(F.count(F.lit(1)).alias("n"))
    per_text = pairs.join(sizes, ["place", "tq"]).groupBy("place", "eq").agg(F.sum("n").alias("pairs"))
    counted = side(one, False, "eq", "eval_id").join(per_text, ["place", "eq"]).select("eval_id", "pairs")
    all_e, all_t = side(texts, False, "eq", "eval_id"), side(texts, True, "tq", "train_id")
    a = pairs.join(side(many, False, "eq", "eval_id"), ["place", "eq"]).join(all_t, ["place", "tq"]).select("eval_id", "train_id")
    b = pairs.join(side(many, True, "tq", "train_id"), ["place", "tq"]).join(all_e, ["place", "eq"]).select("eval_id", "train_id")
    spread = a.unionByName(b).distinct().groupBy("eval_id").agg(F.count(F.lit(1)).alias("pairs"))
    per = counted.unionByName(spread).groupBy("eval_id").agg(F.sum("pairs").alias("pairs"))
    rows = df.select(F.col(key).alias("eval_id"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source")).filter("split <> 'train'").distinct()
    return rows.join(per, "eval_id", "left").groupBy("split", "source").agg(F.countDistinct("eval_id").alias("records"), F.countDistinct(F.when(F.col("pairs") > 0, F.col("eval_id"))).alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
