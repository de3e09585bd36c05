"""Spans of entities: training examples, splits by name, a gazetteer matcher, and scores of predicted spans.

Defined cases: rows without spans, with a span that is not in its text, or off token boundaries give no example; labels
that a split lacks keep a score of zero; a text without gold and predicted spans counts nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions.text import align_span, named, spans_of, tokens, tokens_at
from placeloom.runtime import cut, once

LABELS = ["CITY", "REGION", "STATE", "COUNTRY"]


def build_examples(df: DataFrame) -> DataFrame:
    """Rows whose spans all are whole tokens, with tokenized_text and ner (first, last, label)."""
    full = df.withColumn("entities", spans_of(F.col("entities"))).filter(F.size("entities") > 0)
    # a generator between the tokens and their uses, else the optimiser would copy their expression into each use
    full = full.select("*", F.inline(F.array(F.struct(tokens_at("query").alias("__tok")))))
    verbatim = F.forall("entities", lambda e: F.substring(F.col("query"), e["start"].cast("int") + 1, (e["end"] - e["start"]).cast("int")) == e["text"])
    ner = F.transform("entities", lambda e: named(at=align_span(F.col("__tok"), e["start"], e["end"]), label=e["label"]))
    kept = full.select("*", F.inline(F.array(F.struct(ner.alias("__ner"))))).filter(F.coalesce(verbatim, F.lit(False)) & F.forall("__ner", lambda s: s["at"].isNotNull()))
    flat = F.transform("__ner", lambda s: named(first=s["at"]["first"], last=s["at"]["last"], label=s["label"]))
    return kept.select("request_id", F.col("query").alias("text"), "language", "name", "sample_source", F.transform("__tok", lambda t: t["token"]).alias("tokenized_text"), flat.alias("ner"), "entities")


def token_mismatches(examples: DataFrame) -> DataFrame:
    """Examples whose stored tokens are not those of their text; must be empty before training."""
    return examples.filter(F.transform(tokens_at("text"), lambda t: t["token"]) != F.col("tokenized_text"))


def split_by_name(examples: DataFrame, share: float = 0.1, seed: str = "42") -> DataFrame:
    """Adds split: every row of a name on one side, each language near its share.

    A name belongs to its first language. The names of a language stand in the order of a hash; each goes to validation if
    its rows still fit into the language's share, else to train, so a large name never keeps later ones out.

    The fill runs in rounds for all languages at once: names larger than the room left can't fit any more and go; of the
    others the longest beginning that fits is taken, and the next round starts behind the first that didn't. Each round
    rules out at least the largest size left, so there are at most as many rounds as different sizes, mostly three or
    four. Running sums are taken over ranges of the hash first and then inside a range, so a language's names need not
    fit one task. A round brings one row for each language to the driver.
    """
    spark = examples.sparkSession
    per = examples.groupBy("name", "language").agg(F.count(F.lit(1)).alias("n"))
    names = per.groupBy("name").agg(F.min(F.struct(F.coalesce("language", F.lit("")).alias("l"), "n")).alias("f")).select("name", F.col("f.l").alias("l"), F.col("f.n").alias("n"))
    # position in the order: the digest and, among equal digests, the name
    names = cut(names.withColumn("d", F.concat(F.md5(F.concat_ws("|", F.lit(seed), "l", "name")), F.coalesce(F.concat(F.lit("|"), "name"), F.lit("")))).withColumn("r", F.substring("d", 1, 3)))
    totals = {r["l"]: r["n"] for r in per.groupBy(F.coalesce("language", F.lit("")).alias("l")).agg(F.sum("n").alias("n")).collect()}
    state = {lang: (share * n, "") for lang, n in totals.items()}
    taken: DataFrame | None = None
    while state:
        left = spark.createDataFrame([(lang, room, after) for lang, (room, after) in state.items()], "l string, room double, after string")
        open_ = names.join(left, "l").filter("d > after and n <= room")
        ranges = open_.groupBy("l", "r").agg(F.sum("n").alias("s"))
        before = ranges.select(F.col("l").alias("__l"), F.col("r").alias("__r"), (F.sum("s").over(W.partitionBy("l").orderBy("r")) - F.col("s")).alias("before"))
        line = open_.withColumn("inside", F.sum("n").over(W.partitionBy("l", "r").orderBy("d"))).join(before, (F.col("l") == F.col("__l")) & (F.col("r") == F.col("__r"))).withColumn("upto", F.col("before") + F.col("inside"))
        line = cut(line.select("l", "name", "n", "d", "room", (F.col("upto") <= F.col("room")).alias("fits")))
        fits = line.filter("fits").select("name")
        taken = fits if taken is None else taken.unionByName(fits)
        ends = line.groupBy("l").agg(F.min(F.when(~F.col("fits"), F.col("d"))).alias("stop"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("n"))), F.lit(0)).alias("used")).collect()
        state = {r["l"]: (state[r["l"]][0] - r["used"], r["stop"]) for r in ends if r["stop"] is not None}
    validation = examples.select("name").limit(0) if taken is None else taken
    side = validation.select(F.col("name").alias("__name"), F.lit("validation").alias("__side"))
    return examples.drop("split").join(side, F.col("name").eqNullSafe(F.col("__name")), "left").withColumn("split", F.coalesce("__side", F.lit("train"))).drop("__name", "__side")


def gazetteer_spans(texts: DataFrame, names: DataFrame, key: str = "request_id", text: str = "query") -> DataFrame:
    """(key, start, end, label) of the longest known names, from left to right: a stand-in for a trained model.

    names: name (lower case), label; names of any number of tokens match, and are read once. A token is first joined to the
    names' first tokens and numbers of tokens, each with a mask of the second tokens that it goes on with; only word
    sequences that pass meet the names. Their texts are fetched by key, so no token carries more than its own text. Texts
    without a key have no spans.
    """
    fold = lambda t: F.translate(F.lower(t), "ς", "σ")  # noqa: E731  a sigma's form depends on what follows the token
    bit = lambda t: F.pmod(F.hash(fold(t)), F.lit(64))
    known = once(names.select("name", "label").distinct(), tok=tokens("name")).filter("size(tok) > 0")
    known = cut(known.select("name", "label", fold(F.get("tok", F.lit(0))).alias("head"), F.size("tok").alias("size"), bit(F.get("tok", F.lit(1))).alias("bit")))
    heads = known.groupBy("head", "size").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    asked = texts.select(key, F.col(text).alias("t")).filter(F.col(key).isNotNull())
    toks = once(asked, tok=tokens("t")).select(key, F.inline(F.transform("tok", lambda t, i: named(i=i, head=fold(t), next=F.when(i + 1 < F.size("tok"), bit(F.get("tok", i + 1)))))))
    at = toks.join(heads, "head").filter((F.col("size") == 1) | (F.getbit("mask", "next") == 1))
    begun = at.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("i", "size")).alias("begun"))
    whole = once(asked.join(begun, F.col(key) == F.col("__key")), tok=tokens_at("t"))
    inside = F.filter("begun", lambda b: b["i"] + b["size"] <= F.size("tok"))
    grams = whole.select(key, "t", F.inline(F.transform(inside, lambda b: named(start=F.get("tok", b["i"])["start"], end=F.get("tok", b["i"] + b["size"] - 1)["end"]))))
    grams = grams.select(key, "start", "end", F.lower(F.substring("t", F.col("start") + 1, F.col("end") - F.col("start"))).alias("name"))
    found = grams.join(known.select("name", "label"), "name")
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "label")))
    pick = F.aggregate(
        order, named(at=F.lit(0), out=F.array().cast("array<struct<start:int,end:int,label:string>>")),
        lambda acc, s: F.when(s["start"] >= acc["at"], named(at=-s["e"], out=F.concat(acc["out"], F.array(named(start=s["start"], end=-s["e"], label=s["label"]))))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return found.groupBy(key).agg(pick.alias("s")).select(key, F.inline("s"))


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1")]


def span_scores(gold: DataFrame, predicted: DataFrame, key: str = "request_id", labels: list[str] = LABELS) -> DataFrame:
    """bucket (overall, lang:*, label:*), tp, fp, fn, precision, recall, f1 of exact spans; both have key, language, start, end, label.

    Rows are tagged, merged per span and counted once for all buckets: one shuffle of spans, one of counts.
    """
    cols = [key, "language", "start", "end", "label"]
    both = gold.select(*cols, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*cols, F.lit(0).alias("g"), F.lit(1).alias("p")))
    span = both.groupBy(*cols).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    names = F.array(F.lit("overall"), F.concat(F.lit("lang:"), F.coalesce("language", F.lit(""))), F.when(F.col("label").isin(labels), F.concat(F.lit("label:"), "label")))
    counts = span.select(F.explode(F.array_compact(names)).alias("bucket"), "g", "p").groupBy("bucket").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    seeds = gold.sparkSession.createDataFrame([(f"label:{x}",) for x in labels], "bucket string")
    full = counts.join(seeds, "bucket", "full").na.fill(0, ["tp", "fp", "fn"])
    return full.select("bucket", "tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(gold: DataFrame, predicted: DataFrame, thresholds: list[float], key: str = "request_id") -> DataFrame:
    """Overall scores when only predictions of at least each threshold count; predicted has a column score.

    Each span's best score decides up to which threshold it counts, so spans are shuffled once for all thresholds.
    """
    cols = [key, "start", "end", "label"]
    g = gold.select(*cols).distinct().withColumn("g", F.lit(1)).withColumn("score", F.lit(None).cast("double"))
    p = predicted.select(*cols, F.lit(0).alias("g"), "score")
    span = g.unionByName(p.select(*g.columns)).groupBy(*cols).agg(F.max("g").alias("g"), F.max("score").alias("score"))
    each = span.withColumn("threshold", F.explode(F.lit(thresholds).cast("array<double>")))
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("int")
    c = each.groupBy("threshold").agg(F.sum(F.col("g") * hit).alias("tp"), F.sum((1 - F.col("g")) * hit).alias("fp"), F.sum(F.col("g") * (1 - hit)).alias("fn"))
    return c.select(F.format_string("%.2f", "threshold").alias("threshold"), "tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def span_errors(gold: DataFrame, predicted: DataFrame, key: str = "request_id") -> DataFrame:
    """Keys whose span sets differ, with the sorted spans that only one side has."""
    cols = [key, "start", "end", "label"]
    both = gold.select(*cols, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*cols, F.lit(0).alias("g"), F.lit(1).alias("p"))).groupBy(*cols).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    s = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "label")
    out = both.filter("g <> p").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("g") == 1, s))), " ").alias("missed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("p") == 1, s))), " ").alias("wrong"))
    return out
