"""Dataset construction: cleaning, deduplication, length-matched negative fragments, union with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import RESIDUES
from ..functions.sequence import fragment, fragment_id, normalize_sequence, once, parent_sequence, seeded_draw, sequence_sha256
from ..plans.storage import Scratch, stored
from .similarity import in_order

#: Fixed value: positives needed.
LEAST_POSITIVES = 20
#: Rounds of the permutation, slots of a size's space, steps of the walk that one row stands for.
ROUNDS, SLOTS, CHUNK = 4, 1024, 1024
#: Residues of a parent that lie in one row, so that a fragment of a long parent is not sought from its first residue on.
PIECE = 1024
#: How many more numbers of a size's space are walked than fragments are open: some are repeated or forbidden.
MARGIN = 1.1


def dedup_first(df: DataFrame, key: str = "sequence", order: str = "ordinal") -> DataFrame:
    """The first row of each key by order. One aggregation with partial maxima; no window over a hot key."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min_by(F.struct(order, *rest), order).alias("__row"))
    return first.select(key, "__row.*").select(*df.columns)


def duplicate_flags(df: DataFrame, key: str = "sequence", order: str = "ordinal") -> DataFrame:
    """df with ``is_duplicate``: not the first row of its key."""
    first = df.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("__key"))).select(*df.columns, (F.col(order) > F.col("__first")).alias("is_duplicate"))


def validated(records: DataFrame, raw: str = "sequence", min_length: int = 8, max_length: int = 80) -> DataFrame:
    """records with ``sequence``, ``error_code`` and ``error`` of the normalisation."""
    got = records.withColumn("__n", normalize_sequence(F.col(raw), min_length, max_length))
    return got.withColumns({"sequence": F.col("__n.sequence"), "error_code": F.col("__n.error_code"), "error": F.col("__n.error")}).drop("__n")


def cleaning_report(records: DataFrame, raw: str = "sequence", min_length: int = 8, max_length: int = 80) -> DataFrame:
    """One row of counts: input, invalid, outside the length range, duplicates among the valid, retained."""
    v = validated(records, raw, min_length, max_length)
    outside = F.col("error_code").isin("too_short", "too_long")
    valid = F.count(F.when(F.col("error_code").isNull(), 1))
    kept = F.count_distinct(F.when(F.col("error_code").isNull(), F.col("sequence")))
    return v.agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if(F.col("error_code").isNotNull() & ~outside).alias("invalid_or_noncanonical"),
        F.count_if(F.coalesce(outside, F.lit(False))).alias("outside_length_range"),
        (valid - kept).alias("exact_duplicates_removed"),
        kept.alias("retained_records"),
    )


def clean_positives(records: DataFrame, min_length: int = 8, max_length: int = 80, source: str = "APD") -> DataFrame:
    """(record_id, sequence, ordinal) to the positive rows of the dataset, first of each sequence."""
    kept = dedup_first(validated(records, "sequence", min_length, max_length).filter("error_code is null").select("sequence", "ordinal", "record_id"))
    # Label, class and source names.
    return kept.select("sequence", F.lit(1).alias("label"), F.lit("AMP").alias("class_name"), F.lit(source).alias("source"), F.col("record_id").cast("string").alias("source_id"), F.col("record_id").cast("string").alias("parent_id"))


def target_lengths(positives: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(fragment_index, size): n lengths drawn from the positives' lengths, by md5 of seed and index."""
    each = positives.groupBy(F.length("sequence").alias("size")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))  # one row a length
    ends = sorted((r["high"], r["size"]) for r in each.select("size", upto.alias("high")).collect())  # one row a length
    spark = positives.sparkSession
    if not ends:
        return spark.createDataFrame([], "fragment_index long, size int")
    highs, sizes = (F.array(*map(F.lit, x)) for x in zip(*ends))
    draw = F.pmod(seeded_draw(F.col("id"), f"{seed}|size"), F.lit(ends[-1][0]))
    # Looked up in the array by a draw made once; a join on a range would draw again for each length.
    return spark.range(n).select(F.col("id").alias("fragment_index"), once(draw, lambda d: F.get(sizes, F.size(F.filter(highs, lambda high: high <= d)))).alias("size"))


def shuffled_lengths(positives: DataFrame, seed: int = 42) -> DataFrame:
    """(fragment_index, size): the length of every row of positives once, in the order of a draw by seed and sequence."""
    rows = positives.select(F.length("sequence").alias("size"), seeded_draw(F.col("sequence"), f"{seed}|lengths").alias("draw"), "sequence")
    placed, _ = in_order(rows, [F.col("draw"), F.col("sequence")])
    return placed.select(F.col("place").alias("fragment_index"), "size")


def _ranked_parents(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents by falling length: (rank, id, sequence), and (size, eligible): parents at least that long."""
    cleaned = stored(parents.select(F.col("id").cast("string").alias("parent_id"), parent_sequence(F.col("sequence")).alias("parent")))
    p = cleaned.filter("parent <> ''").withColumn("n", F.length("parent"))
    sizes = p.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))  # one row a length
    sizes = stored(sizes.select("n", (upto - F.col("k")).alias("start"), upto.alias("upto")))
    placed, _ = in_order(p.select("parent_id", "parent", "n"), [F.desc("n"), F.col("parent_id"), F.col("parent")])
    Scratch(parents.sparkSession).drop(cleaned)
    return placed.select(F.col("place").alias("rank"), "parent_id", "parent", "n"), sizes


def permuted(index: Column, half: Column, key: Column, seed: int | str) -> Column:
    """A keyed permutation of [0, 4^half): a Feistel network of ROUNDS rounds, each half hashed by md5 with the key and the round's number."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), half) - 1
    start = F.struct(F.call_function("shiftright", index, half).alias("left"), index.bitwiseAND(mask).alias("right"))

    def turned(s: Column, number: Column) -> Column:
        return F.struct(s["right"].alias("left"), s["left"].bitwiseXOR(seeded_draw(F.concat_ws("|", key, number, s["right"]), seed).bitwiseAND(mask)).alias("right"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda s: F.call_function("shiftleft", s["left"], half) + s["right"])


def slot_width() -> Column:
    """How many numbers of a space of ``total`` a slot has."""
    return F.greatest(F.lit(1), F.ceil(F.col("total") / SLOTS)).cast("long")


def fragment_space(wanted: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(size, m, total, half) of wanted sizes (size, m), and (size, slot, low, high, n, first): where parents of a length lie in a size's space.

    The space of a size numbers all (parent, start) of its fragments: longest parents first, each parent's starts together. Lengths are
    found by slots, of which a size has SLOTS, so that a number meets few of them.
    """
    fit = wanted.join(sizes, sizes["n"] >= wanted["size"], "left").withColumn("starts", (F.col("upto") - F.col("start")) * (F.col("n") - F.col("size") + 1))
    upto = F.sum("starts").over(Window.partitionBy("size").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))  # one row a length
    spans = stored(fit.select("size", "m", "n", F.col("start").alias("first"), (upto - F.col("starts")).alias("low"), upto.alias("high")))
    # The least half with 4^half >= total, in whole numbers.
    half = F.size(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), 2 * k) < F.col("total")))
    space = stored(spans.groupBy("size", "m").agg(F.max("high").alias("total")).withColumn("half", half))
    met = spans.filter("n is not null").join(space.select("size", slot_width().alias("width")), "size")
    slots = met.withColumn("slot", F.explode(F.expr("sequence(low div width, (high - 1) div width)")))
    return space, stored(slots.select("size", "width", "slot", "low", "high", "n", "first"))


def negative_fragments(parents: DataFrame, targets: DataFrame, forbidden: DataFrame, seed: int = 42, source: str = "UniProt fragment") -> DataFrame:
    """Length-matched fragments of parents (id, sequence), one for each (fragment_index, size), none in forbidden and none twice.

    Each size's space of (parent, start) is walked in a keyed permutation's order, so no draw repeats. What is forbidden, or equals an
    earlier fragment of the walk, is passed over; the j-th left goes to the size's j-th index. How far a step of the walk goes changes nothing.
    Raises if there is no parent, none is long enough for a size, or a size's space has too few fragments.
    """
    scratch = Scratch(parents.sparkSession)
    ranked, sizes = _ranked_parents(parents)
    if ranked.isEmpty():
        raise ValueError("no canonical parent proteins to cut fragments from")
    targets = scratch.table(targets.select("fragment_index", "size"))
    space, slots = fragment_space(stored(targets.groupBy("size").agg(F.count(F.lit(1)).alias("m"))), sizes)
    short = space.filter("total is null").first()
    if short is not None:
        raise ValueError(f"no parent protein is long enough for a fragment of {short['size']} residues")
    banned = forbidden.select("sequence").distinct()
    longest = space.agg(F.max("size")).first()[0] or 1
    cuts = F.transform(F.expr(f"sequence(0, (n - 1) div {PIECE})"), lambda i: F.substr(F.col("parent").cast("binary"), (i * PIECE + 1).cast("int"), F.lit(PIECE + longest - 1)).cast("string"))
    pieces = scratch.table(ranked.select("rank", "parent_id", F.posexplode(cuts).alias("piece", "residues")).withColumn("piece", F.col("piece").cast("long")))
    scratch.drop(ranked)  # the parents' text is kept once, in pieces, and until the walk is over
    parts = max(int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions")), parents.sparkSession.sparkContext.defaultParallelism)
    walk, found = space.select("size", "total", "half", "m", F.lit(0).cast("long").alias("begin"), F.col("m").alias("open")), None
    size = F.col("size").cast("string")
    while True:
        # As many steps as are likely to do: of the permutation's numbers the share total / 4^half lies in the space, a quarter at least.
        end = F.least(F.expr("shiftleft(1L, 2 * half)"), F.col("begin") + F.ceil(F.col("open") * MARGIN * F.expr("shiftleft(1L, 2 * half)") / F.col("total")) + 256)
        walk = scratch.table(walk.withColumn("end", end))
        # A given number of partitions: the chunks are few bytes, which adaptive execution would bring together in one task.
        chunks = walk.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (end - 1 - begin) div {CHUNK}L)"))).repartition(parts, "size", "chunk")
        steps = F.expr(f"sequence(begin + chunk * {CHUNK}L, least(end, begin + (chunk + 1) * {CHUNK}L) - 1)")
        # Drawn within the array: a column would be drawn anew in every filter that is pushed below it.
        each = F.transform(steps, lambda step: F.struct(step.alias("step"), permuted(step, F.col("half"), size, f"{seed}|walk").alias("x")))
        drawn = chunks.select("size", "total", slot_width().alias("width"), F.inline(each)).filter("x < total").select("size", "step", "x", F.expr("x div width").alias("slot"))
        # Slots are known on both sides, so this is a join by size and slot: sought by a column of the other side, each number would meet all spans of its size.
        # By merge: the chunks' few bytes are all that Spark knows of the numbers, and it would broadcast them, however many they are.
        at = drawn.hint("merge").join(slots.select("size", "slot", "low", "high", "n", "first"), ["size", "slot"]).filter("x >= low and x < high")
        place = F.col("x") - F.col("low")
        starts = (F.col("n") - F.col("size") + 1).cast("long")
        cut = at.select("size", "step", (F.col("first") + F.floor(place / starts)).alias("rank"), F.pmod(place, starts).alias("start")).withColumn("piece", F.expr(f"start div {PIECE}L"))
        each = cut.join(pieces, ["rank", "piece"]).select("size", "step", "parent_id", "start", fragment(F.col("residues"), (F.col("start") % PIECE).cast("int"), F.col("size")).alias("sequence"))
        new = dedup_first(each, "sequence", "step").join(banned, "sequence", "left_anti")
        if found is not None:
            new = new.join(found.select("sequence"), "sequence", "left_anti")
        new = scratch.table(new)
        found = new if found is None else found.unionByName(new)
        have = found.groupBy(F.col("size").alias("of")).agg(F.count(F.lit(1)).alias("have"))
        left = scratch.table(walk.join(have, F.col("size") == F.col("of"), "left").withColumn("open", F.col("m") - F.coalesce("have", F.lit(0))).filter("open > 0").select("size", "total", "half", "m", F.col("end").alias("begin"), "open"))
        if left.isEmpty():
            break
        if not left.filter("begin >= shiftleft(1L, 2 * half)").isEmpty():
            raise RuntimeError("not enough unique negative fragments: add parents or lower the ratio")
        walk = left
    scratch.drop(pieces)
    taken = _nth(found, "step").withColumnsRenamed({"size": "of", "nth": "of_nth"})
    # By merge: numbers in order take next to nothing in a file, and by the file's size all of them would be broadcast.
    rows = _nth(targets, "fragment_index").hint("merge").join(taken, (F.col("size") == F.col("of")) & (F.col("nth") == F.col("of_nth")))
    # Label and class name.
    return rows.select("sequence", F.lit(0).alias("label"), F.lit("Putative non-AMP").alias("class_name"), F.lit(source).alias("source"), fragment_id(F.col("parent_id"), F.col("start"), F.col("size")).alias("source_id"), "parent_id", F.col("fragment_index").cast("int").alias("fragment_index"))


def _nth(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``nth``: their number within their size, from 0. One sort in ranges, so that no size passes through one task."""
    placed, _ = in_order(rows, [F.col("size"), F.col(order)])
    placed = stored(placed)
    first = stored(placed.groupBy(F.col("size").alias("__size")).agg(F.min("place").alias("__first")))
    return placed.join(first, F.col("size") == F.col("__size")).withColumn("nth", F.col("place") - F.col("__first")).drop("__size", "__first", "place")


def labelled_union(positives: DataFrame, negatives: DataFrame, seed: int = 42) -> DataFrame:
    """Both classes with sequence_sha256, length and a seeded shuffle key."""
    both = positives.unionByName(negatives, allowMissingColumns=True)
    return both.withColumns({"sequence_sha256": sequence_sha256(F.col("sequence")), "length": F.length("sequence"), "shuffle_key": seeded_draw(F.col("sequence"), f"{seed}|shuffle")})


def build_dataset(records: DataFrame, parents: DataFrame, min_length: int = 8, max_length: int = 80, negative_ratio: float = 1.0, split_mode: str = "similarity", threshold: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(dataset, cleaning report): cleaned positives, as many negatives as the ratio says, splits."""
    from .splitting import assign_splits

    if negative_ratio <= 0:
        raise ValueError("the negative ratio must be above zero")
    report = cleaning_report(records, "sequence", min_length, max_length)
    positives = stored(clean_positives(records, min_length, max_length))
    n = positives.count()
    if n < LEAST_POSITIVES:
        raise ValueError(f"fewer than {LEAST_POSITIVES} valid positives are left")
    negatives = negative_fragments(parents, target_lengths(positives, round(n * negative_ratio), seed), positives, seed)
    return assign_splits(stored(labelled_union(positives, negatives, seed)), split_mode, threshold, seed), report


#: Weights of the residues in alphabetical order, for the toy's two classes.
TOY_WEIGHTS = {
    1: (7, 1, 1, 1, 5, 2, 1, 8, 13, 8, 5, 2, 2, 3, 12, 3, 3, 7, 2, 7),
    0: (7, 2, 7, 8, 4, 7, 3, 6, 3, 7, 5, 4, 4, 6, 3, 7, 6, 5, 2, 6),
}


def toy_sequences(spark: SparkSession, per_class: int = 120, low: int = 10, high: int = 42, seed: int = 7) -> DataFrame:
    """(sequence, label): random peptides of two compositions, unique over both classes.

    A candidate's length and residues are drawn by md5 of seed, label and its number, so any engine draws the same.
    """
    out = None
    for label, weights in TOY_WEIGHTS.items():
        pool = "".join(a * w for a, w in zip(sorted(RESIDUES), weights))
        size = F.lit(low) + F.pmod(seeded_draw(F.col("id"), f"{seed}|{label}|size"), F.lit(high - low + 1)).cast("int")
        residues = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(F.lit(pool), (F.pmod(seeded_draw(F.concat_ws("|", "id", i), f"{seed}|{label}"), F.lit(len(pool))) + 1).cast("int"), F.lit(1)))
        rows = dedup_first(spark.range(2 * per_class).select("id", F.array_join(residues, "").alias("sequence")), "sequence", "id")
        if out is not None:
            rows = rows.join(out, "sequence", "left_anti")
        rows = rows.orderBy("id").limit(per_class).select("sequence", F.lit(label).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def toy_dataset(spark: SparkSession, per_class: int = 120, seed: int = 7) -> DataFrame:
    """The toy table with the columns of a dataset: ids ``toy_%04d`` by falling label and draw, a random split."""
    from .splitting import random_split

    rows = toy_sequences(spark, per_class, seed=seed)
    place = F.row_number().over(Window.orderBy(F.desc("label"), seeded_draw(F.col("sequence"), f"{seed}|id"), "sequence")) - 1  # 2 * per_class rows
    # Names of classes and source.
    named = rows.withColumns({"class_name": F.when(F.col("label") == 1, "Synthetic AMP-like").otherwise("Synthetic non-AMP-like"), "source": F.lit("Synthetic UI smoke-test data"), "source_id": F.format_string("toy_%04d", place)})
    named = named.withColumns({"parent_id": F.col("source_id"), "sequence_sha256": sequence_sha256(F.col("sequence")), "length": F.length("sequence")})
    return random_split(named, "sequence", 42)
