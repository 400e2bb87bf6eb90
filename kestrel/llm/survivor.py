"""Best representative of each duplicate group (problem 7).

``fuse`` is the field-level operator: Bayesian value fusion with copy detection. ``records`` chooses the surviving
record of each content and fuses its size, extension and time from the claims of the archives that hold it.

Nothing here collects a group: groups are folded with map-side aggregation, so a content holding a third of all
rows reaches the shuffle as one partial row per partition and archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.clean import content_hash, epoch_micros, filled
from kestrel.session import cut

#: Prior accuracy of a source, number of false values a field may take, prior of dependence, rate of copying.
ACCURACY, FALSE_VALUES, DEPENDENT, COPY_RATE = 0.8, 50.0, 0.1, 0.8
#: Contents whose 8-byte keys are sent to all executors at most (16 MB); beyond it both sides are shuffled.
SENT = 2_000_000


def fuse(votes: DataFrame, rounds: int = 3) -> DataFrame:
    """Most probable value of every item from the votes of sources of unknown accuracy that may copy each other.

    ``votes(item, source, value)``: a source's claim; of several claims of one source for an item the smallest value
    counts, rows with NULL item or value are ignored, a NULL source counts as one source of its own. Returns
    ``(item, value, probability)``, one row per item; equal probabilities go to the smaller value. No votes: no rows.

    What can be inferred of an item depends on which sources agree with which, not on the values. So items are folded
    to their pattern (the sets of sources that agree) with the number of items that share it, the rounds run over the
    patterns, and items take their posteriors from their pattern. Each round

    (1) weighs a source's vote by ``ln(n A / (1 - A))``, discounted by the chance that it was copied from a source of
    the same claim that comes first (higher accuracy, then smaller name), (2) turns the weights of the values into
    posteriors, (3) re-estimates accuracies as mean posteriors, and (4) re-estimates the dependence of two sources from
    the disputed items that both speak of: differing claims speak against it, shared true ones a little for it and shared
    false ones, rare among independent sources, strongly. Before the first round all shared claims pass for true.

    Work: an item is a row per source, whatever the number of copies; pairs of sources are formed once a pattern.
    """
    v = votes.where("item IS NOT NULL AND value IS NOT NULL").select("item", F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"), "value")
    claims = v.groupBy("item", "source").agg(F.min("value").alias("value"))
    items = cut(claims.groupBy("item").agg(_by_value(F.collect_list(F.struct("value", "source"))).alias("said")))
    post = posteriors(items.select("said"), rounds)
    return items.select("item", "said", _pattern("said").alias("pattern")).join(post, "pattern").select("item", _best("said", "p").alias("b")).select("item", "b.value", "b.probability")


def _by_value(claims: Column) -> Column:
    """Claims ``(value, source)`` of an item as ``(sources, value)`` for every value, in the order of the sources."""
    per = F.transform(F.array_distinct(F.transform(claims, lambda c: c["value"])), lambda v: F.struct(F.array_sort(F.transform(F.filter(claims, lambda c: c["value"] == v), lambda c: c["source"])).alias("sources"), v.alias("value")))
    return F.array_sort(per)


def _pattern(said: str | Column) -> Column:
    return F.transform(said, lambda x: x["sources"])


def _best(said: str, p: str) -> Column:
    """The value of greatest posterior ``(probability, value)``, of equal ones the smallest."""
    ranked = F.transform(F.arrays_zip(said, p), lambda z: F.struct((-F.round(z[p], 9)).alias("n"), z[said]["value"].alias("value"), z[p].alias("probability")))
    return F.array_min(ranked)


def posteriors(said: DataFrame, rounds: int = 3) -> DataFrame:
    """``(pattern, p)``: of every pattern of ``said(said)`` the posteriors of its values, in their order (``fuse``)."""
    patterns = cut(said.select(_pattern("said").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).withColumn("item", F.xxhash64(F.col("pattern").cast("string"))))
    flat = patterns.where("size(pattern) > 1").select("item", "n", F.posexplode("pattern").alias("value", "sources")).select("item", "n", "value", F.explode("sources").alias("source"))
    agreed = patterns.where("size(pattern) = 1").select("n", F.explode(F.col("pattern")[0]).alias("source")).groupBy("source").agg(F.sum("n").alias("agreed"))
    disputed, agreed = cut(flat), cut(agreed)
    acc = disputed.select("source").distinct().withColumn("a", F.lit(ACCURACY))
    both = disputed.alias("x").join(disputed.alias("y"), F.expr("x.item = y.item AND x.source < y.source"))
    both = both.select(F.col("x.item").alias("item"), F.col("x.n").alias("n"), F.col("x.value").alias("value"), F.col("x.source").alias("s"), F.col("y.source").alias("t"), (F.col("x.value") == F.col("y.value")).alias("same"))
    same = cut(both.where("same").drop("same"))
    differ = cut(both.groupBy("s", "t").agg(F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("kd")))
    dep = cut(_dependence(same.withColumn("probability", F.lit(1.0)), differ, acc))
    post = None
    for r in range(max(1, rounds)):
        w = F.log(F.lit(FALSE_VALUES) * F.least(F.col("a"), F.lit(0.99)) / (1 - F.least(F.greatest(F.col("a"), F.lit(0.05)), F.lit(0.99))))
        first = same.join(dep, ["s", "t"]).join(acc.select(F.col("source").alias("s"), F.col("a").alias("as_")), "s").join(acc.select(F.col("source").alias("t"), F.col("a").alias("at_")), "t")
        late = first.select("item", "value", F.when(F.col("as_") >= F.col("at_"), F.col("t")).otherwise(F.col("s")).alias("source"), F.log1p(-F.lit(COPY_RATE) * F.col("d")).alias("i"))
        indep = late.groupBy("item", "value", "source").agg(F.exp(F.sum("i")).alias("i"))
        score = (
            disputed.join(acc, "source").join(indep, ["item", "value", "source"], "left")
            .groupBy("item", "value").agg(F.sum(w * F.coalesce("i", F.lit(1.0))).alias("score"))
        )
        per = Window.partitionBy("item")
        e = F.exp(F.col("score") - F.max("score").over(per))
        post = cut(score.withColumn("e", e).withColumn("probability", F.col("e") / F.sum("e").over(per)).select("item", "value", "probability"))  # read several times by the next round
        if r + 1 == max(1, rounds):
            break
        held = disputed.join(post, ["item", "value"])
        acc = (
            held.groupBy("source").agg(F.sum(F.col("probability") * F.col("n")).alias("p"), F.sum("n").alias("n"))
            .join(agreed, "source", "left").select("source", ((F.coalesce("p", F.lit(0.0)) + F.coalesce("agreed", F.lit(0)) + ACCURACY) / (F.coalesce("n", F.lit(0)) + F.coalesce("agreed", F.lit(0)) + 1)).alias("a"))
        )
        acc = cut(acc)
        dep = cut(_dependence(same.join(post, ["item", "value"]), differ, acc))
    won = post.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("value", "probability"))), lambda x: x["probability"]).alias("p"))
    return patterns.join(won, "item", "left").select("pattern", F.coalesce("p", F.array(F.lit(1.0))).alias("p"))


def _dependence(shared: DataFrame, differ: DataFrame, acc: DataFrame) -> DataFrame:
    """``(s, t, d)``: chance that two sources depend on each other, by the odds of what they share and where they differ."""
    p = F.col("probability")
    k = shared.groupBy("s", "t").agg(F.sum(p * F.col("n")).alias("kt"), F.sum((1 - p) * F.col("n")).alias("kf"))
    j = k.join(differ, ["s", "t"]).join(acc.select(F.col("source").alias("s"), F.col("a").alias("u")), "s").join(acc.select(F.col("source").alias("t"), F.col("a").alias("v")), "t")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.05)), F.lit(0.99))
    right, wrong = clip(F.col("u")) * clip(F.col("v")), 1 - clip((F.col("u") + F.col("v")) / 2)
    gain = F.col("kt") * F.log(COPY_RATE / right + (1 - COPY_RATE)) + F.col("kf") * F.log(COPY_RATE * FALSE_VALUES / wrong + (1 - COPY_RATE)) + F.col("kd") * F.log(F.lit(1 - COPY_RATE))
    odds = F.lit(DEPENDENT / (1 - DEPENDENT)) * F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), gain)))
    return j.select("s", "t", (odds / (1 + odds)).alias("d"))


#: Fields that copies may disagree about, as text that sorts by value.
FIELDS = ("size", "ext", "mtime_us")


def records(files: DataFrame, rounds: int = 3) -> DataFrame:
    """``(sha256, file_id, size, ext, mtime_us, doubt)`` for every content that two or more present records hold.

    Survivor ``file_id``: ``hidden`` 0 before anything else, then most of ``ext``, ``size``, ``fast_hash`` filled (a size
    above 0; text that is not blank), then the latest usable ``mtime``, then the smallest id. The fields are built one by
    one: each archive claims the value of its best copy that has one, and the claims about all three fields of all contents
    are fused together (``fuse``), so that what the archives' claims about one field show of their accuracy and copying
    counts for the others. ``size`` is 0, ``ext`` and ``mtime_us`` are NULL where no copy gives one. ``doubt`` is the
    greatest chance, over the fields, that the value taken is wrong. Exact repeats of a row are one record. Unreadable
    hashes, NULL ids and records not present take no part; an empty table gives no rows. Extra columns are ignored.
    """
    usable = epoch_micros("mtime")
    f = files.where("present = 1 AND id IS NOT NULL").select(
        F.unhex(content_hash("sha256")).alias("c"), F.col("root_id").alias("source"), "id",
        F.when(F.col("size") > 0, F.col("size")).alias("size"), F.when(filled("ext"), F.lower(F.trim("ext"))).alias("ext"), usable.alias("mtime_us"),
        F.struct(
            F.when(F.col("hidden") == 0, 0).otherwise(1).cast("byte").alias("h"),
            (-(filled("ext").cast("byte") + F.coalesce(F.col("size") > 0, F.lit(False)).cast("byte") + filled("fast_hash").cast("byte"))).alias("f"),
            (-F.coalesce(usable, F.lit(-1))).alias("m"), F.col("id").alias("id"),
        ).alias("rank"),
    ).where("c IS NOT NULL")
    held = f.groupBy("c").agg(F.min("rank").alias("rank"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    held = cut(held.select("c", F.col("rank.id").alias("file_id"), F.xxhash64("c").alias("k")))
    n = held.count()
    keys = held.select("k")
    of = f.withColumn("k", F.xxhash64("c")).join(F.broadcast(keys) if n <= SENT else keys, "k", "left_semi")
    # An archive's claims: one row per archive and content, by partial aggregation, however many copies it holds.
    best = [F.min(F.when(F.col(x).isNotNull(), F.struct("rank", F.col(x).cast("string").alias("v")))).alias(x) for x in FIELDS]
    claims = of.groupBy("c", "source").agg(*best).select("c", F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"), F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x)["v"].alias("value")) for x in FIELDS])).alias("x"))
    claims = claims.select("c", "x.field", "source", "x.value").where("value IS NOT NULL")
    said = cut(claims.groupBy("c", "field").agg(_by_value(F.collect_list(F.struct("value", "source"))).alias("said")))
    post = posteriors(said.select("said"), rounds)
    order = F.transform("said", lambda x: F.struct(x["sources"].alias("sources"), F.when(F.col("field") == "ext", x["value"]).otherwise(F.lpad(x["value"], 20, "0")).alias("value")))
    won = said.select("c", "field", order.alias("said"), _pattern("said").alias("pattern")).join(post, "pattern").select("c", "field", _best("said", "p").alias("b"))
    pick = lambda x: F.max(F.when(F.col("field") == x, F.col("b")["value"])).alias(x)
    fused = won.groupBy("c").agg(*[pick(x) for x in FIELDS], F.max(1 - F.col("b")["probability"]).alias("doubt"))
    out = held.join(fused, "c", "left")
    return out.select(F.lower(F.hex("c")).alias("sha256"), "file_id", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size"), "ext", F.col("mtime_us").cast("long").alias("mtime_us"), F.round(F.coalesce("doubt", F.lit(0.0)), 6).alias("doubt"))


def survivors(files: DataFrame, rounds: int = 3) -> DataFrame:
    """``(sha256, file_id, size)`` of ``records``: the survivor of each content and the fused size."""
    return records(files, rounds).select("sha256", "file_id", "size")
