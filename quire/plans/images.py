"""Image placement, classification, sampling and size estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import kept

# Fixed values of the plan.
TRIGGER, PER_GROUP, ALL_SAMPLES, BUDGET_BYTES, BUDGET_ITEMS = 1.5, 3, 16, 32 << 20, 32


def dpi(pixels: Column, x: Column, y: Column, unit: Column) -> Column:
    """Pixels an inch along one axis (x, y) of a placement; null if the axis has no finite length."""
    length = F.sqrt(x * x + y * y) * unit
    return F.when((length > 0) & (length < F.lit(float("inf"))), pixels * 72.0 / length)


def placement_summary(placements: DataFrame, image: str, order: list[str], listed: DataFrame | None = None) -> DataFrame:
    """(image, dpi_x, dpi_y, page, kind) from placements (image, dx, dy, page, tiling) and what is only listed (image, page).

    kind: Unmeasured if a placement outside tiling patterns has no DPI, or tiled and measured ones mix; TilingPatternOnly if all are tiled;
    Measured otherwise; NotPlaced for a listed image that nothing draws. Only a measured image has DPIs, the least on each axis, and the
    page of the placement whose lesser DPI is least; others have their first page. First is by the columns of order. One aggregate with map-side combine.
    """
    least = F.least("dx", "dy")
    measured = ~F.col("tiling") & F.col("dx").isNotNull() & F.col("dy").isNotNull()
    met = placements.groupBy(image).agg(
        F.min(F.when(measured, F.col("dx"))).alias("_x"),
        F.min(F.when(measured, F.col("dy"))).alias("_y"),
        F.min_by("page", F.when(measured, F.struct(least.alias("_v"), *order))).alias("_low"),
        F.min_by("page", F.struct(*order)).alias("_first"),
        F.bool_or("tiling").alias("_tiled"),
        F.bool_or(measured).alias("_measured"),
        F.bool_or(~F.col("tiling") & ~measured).alias("_bad"),
    )
    kind = F.when(F.col("_bad") | (F.col("_tiled") & F.col("_measured")), "Unmeasured").when(F.col("_tiled"), "TilingPatternOnly").otherwise("Measured")
    sure = kind == "Measured"
    out = met.select(image, F.when(sure, F.col("_x")).alias("dpi_x"), F.when(sure, F.col("_y")).alias("dpi_y"), F.when(sure, F.col("_low")).otherwise(F.col("_first")).alias("page"), kind.alias("kind"))
    if listed is None:
        return out
    rest = listed.groupBy(image).agg(F.min("page").alias("page")).join(met.select(image), image, "left_anti")
    return out.unionByName(not_placed(rest, image))


def not_placed(listed: DataFrame, image: str) -> DataFrame:
    """Summaries of images (image, page) that are only listed, a row each."""
    return listed.select(image, F.lit(None).cast("double").alias("dpi_x"), F.lit(None).cast("double").alias("dpi_y"), "page", F.lit("NotPlaced").alias("kind"))


def fold(summaries: DataFrame, aliases: DataFrame, image: str) -> DataFrame:
    """summaries of images that are written once: those of an alias (image, canonical) count for its canonical.

    Drawn copies decide: all measured, the least DPI on each axis and the page of the least of both (of equals the first); all in
    tiling patterns, that; else unmeasured. Copies that are only listed count where no copy is drawn.
    """
    to = aliases.select(F.col(image).alias("_i"), "canonical")
    rows = summaries.join(to, summaries[image] == to["_i"], "left").select(F.coalesce("canonical", image).alias(image), "dpi_x", "dpi_y", "page", "kind")
    drawn = F.col("kind") != "NotPlaced"
    least = F.least("dpi_x", "dpi_y")
    every = lambda k: F.coalesce(F.bool_and(F.when(drawn, F.col("kind") == k)), F.lit(False))
    met = rows.groupBy(image).agg(
        F.min("dpi_x").alias("_x"), F.min("dpi_y").alias("_y"), F.min_by("page", F.when(least.isNotNull(), F.struct(least.alias("_v"), "page"))).alias("_low"),
        F.min(F.when(drawn, F.col("page"))).alias("_first"), F.min("page").alias("_listed"), F.bool_or(drawn).alias("_drawn"), every("Measured").alias("_m"), every("TilingPatternOnly").alias("_t"),
    )
    kind = F.when(~F.col("_drawn"), "NotPlaced").when(F.col("_m"), "Measured").when(F.col("_t"), "TilingPatternOnly").otherwise("Unmeasured")
    sure = F.col("_m")
    page = F.when(~F.col("_drawn"), F.col("_listed")).when(sure, F.col("_low")).otherwise(F.col("_first"))
    return met.select(image, F.when(sure, F.col("_x")).alias("dpi_x"), F.when(sure, F.col("_y")).alias("dpi_y"), page.alias("page"), kind.alias("kind"))


PLANNED = ["image", "page", "dpi_x", "dpi_y", "w", "h", "to_w", "to_h", "action", "skip", "mask"]


def classify(images: DataFrame, summaries: DataFrame, most: float | None, reencode: bool = False) -> DataFrame:
    """PLANNED for each image (image, w, h, skip, mask) that summaries has.

    skip is why an image can't be written anew, null if it can. An image that nothing draws stays, as do those that can't be measured.
    The others are downsampled to most DPI where both axes are well above it, and re-encoded with reencode.
    """
    rows = images.join(summaries, "image")
    kind, own = F.col("kind"), F.col("skip")
    placed, sure = kind != "NotPlaced", kind == "Measured"
    skip = F.when(~placed, "NoPlacement").when(own.isNotNull(), own).when(kind == "TilingPatternOnly", kind).when(kind == "Unmeasured", "UnmeasuredPlacement").otherwise("None")
    free = skip == "None"
    over = free & triggered(F.col("dpi_x"), F.col("dpi_y"), most) if most else F.lit(False)
    to = {n: F.when(over, target_size(F.col(n), F.col(d), most or 0.0)).otherwise(F.col(n).cast("long")) for n, d in (("w", "dpi_x"), ("h", "dpi_y"))}
    less = (to["w"] < F.col("w")) | (to["h"] < F.col("h"))
    action = F.when(free & less, "DownsampleAndReencode" if reencode else "Downsample").when(free & F.lit(reencode), "Reencode").otherwise("Keep")
    return rows.select(
        "image", F.when(placed, F.col("page")).alias("page"), F.when(sure, F.col("dpi_x")).alias("dpi_x"), F.when(sure, F.col("dpi_y")).alias("dpi_y"),
        F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), to["w"].alias("to_w"), to["h"].alias("to_h"), action.alias("action"), skip.alias("skip"), "mask",
    )


def soft_masks(masks: DataFrame, planned: DataFrame) -> DataFrame:
    """PLANNED for each soft mask (image, w, h, skip): reduced by the factor of the images that use it, as much as the one that is reduced least.

    Its DPI is the least that any image that uses it implies for it, and its page that image's. Images that nothing draws
    don't count; a mask of such images alone isn't placed.
    """
    users = planned.where("skip <> 'NoPlacement' AND mask IS NOT NULL").select(
        F.col("mask").alias("image"), F.col("image").alias("_user"), F.col("page").alias("_page"), *[F.col(c).alias(f"_{c}") for c in ("dpi_x", "dpi_y", "w", "h", "to_w", "to_h", "action")]
    )
    rows = masks.join(users, "image", "left")
    reduced = F.col("_action").startswith("Downsample") & (F.col("_w") > 0) & (F.col("_h") > 0)
    follow = lambda n: F.greatest(F.lit(1), F.least(F.col(n), F.floor(F.col(n) * F.col(f"_to_{n}") / F.col(f"_{n}") + 0.5)))
    size = {n: F.when(reduced, follow(n)).otherwise(F.col(n)).cast("long") for n in "wh"}
    implied = F.col("_dpi_x").isNotNull() & F.col("_dpi_y").isNotNull() & (F.col("_w") > 0) & (F.col("_h") > 0)
    dpi = {n: F.when(implied, F.col(f"_dpi_{d}") * F.col(n) / F.col(f"_{n}")) for n, d in (("w", "x"), ("h", "y"))}
    low = F.when(implied, F.struct(F.least(dpi["w"], dpi["h"]).alias("_v"), F.col("_user")))
    met = rows.groupBy("image", "w", "h", "skip").agg(
        F.max(size["w"]).alias("_sw"), F.max(size["h"]).alias("_sh"), F.min(dpi["w"]).alias("_x"), F.min(dpi["h"]).alias("_y"),
        F.min_by("_page", low).alias("_low"), F.min_by("_page", "_user").alias("_first"), F.count("_user").alias("_n"),
    )
    used, free = F.col("_n") > 0, (F.col("_n") > 0) & F.col("skip").isNull()
    to = {n: F.when(free, F.col(f"_s{n}")).otherwise(F.col(n).cast("long")) for n in "wh"}
    return met.select(
        "image", F.when(free, F.coalesce("_low", "_first")).when(used, F.col("_first")).alias("page"), F.when(free, F.col("_x")).alias("dpi_x"), F.when(free, F.col("_y")).alias("dpi_y"),
        F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), to["w"].alias("to_w"), to["h"].alias("to_h"),
        F.when(free & ((to["w"] < F.col("w")) | (to["h"] < F.col("h"))), "Downsample").otherwise("Keep").alias("action"),
        F.when(~used, "NoPlacement").otherwise(F.coalesce("skip", F.lit("None"))).alias("skip"), F.lit(None).cast(planned.schema["mask"].dataType).alias("mask"),
    )


def conflicts(aliases: DataFrame, planned: DataFrame, soft: DataFrame, scanned: DataFrame) -> DataFrame:
    """(image): aliases (image, canonical) that would not be written as their canonical is, by the plans of images and soft masks.

    An alias that was drawn (in scanned) and has no plan of its own was folded into its canonical. Otherwise both stay as they are, or
    both are written alike: the same action, size and kind.
    """
    plans = planned.withColumn("_soft", F.lit(False)).unionByName(soft.withColumn("_soft", F.lit(True))).select("image", F.struct("action", "to_w", "to_h", "_soft").alias("_p"))
    rows = aliases.select("image", "canonical").join(plans.withColumnRenamed("_p", "_own"), "image", "left")
    rows = rows.join(plans.select(F.col("image").alias("canonical"), F.col("_p").alias("_other")), "canonical", "left")
    rows = rows.join(scanned.select("image", F.lit(True).alias("_drawn")).distinct(), "image", "left")
    kept = lambda c: F.coalesce(F.col(f"{c}.action") == "Keep", F.lit(True))
    alike = F.when(F.col("_own").isNull() & F.col("_drawn"), True).when(kept("_own") | kept("_other"), kept("_own") & kept("_other")).otherwise(F.col("_own") == F.col("_other"))
    return rows.where(~F.coalesce(alike, F.lit(False))).select("image")


def plan(images: DataFrame, masks: DataFrame, summaries: DataFrame, aliases: DataFrame, most: float | None, reencode: bool = False, rounds: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(plans, aliases): PLANNED with soft (whether it is a soft mask) for what is written, and the aliases that hold.

    Copies are folded into their canonicals, all is classified, and aliases that would not be written alike are dropped, until none is; each
    round drops one at least. A copy that is written as its canonical has no plan, and an image whose mask is such a copy names the canonical.
    """
    held = aliases.select("image", "canonical")
    for _ in range(rounds):
        planned = classify(images, fold(summaries, held, "image"), most, reencode)
        soft = soft_masks(masks, planned)
        bad = kept(conflicts(held, planned, soft, summaries))
        if bad.isEmpty():
            break
        held = kept(held.join(bad, "image", "left_anti"))
    else:
        raise RuntimeError(f"not settled in {rounds} rounds")
    every = planned.withColumn("soft", F.lit(False)).unionByName(soft.withColumn("soft", F.lit(True))).join(held.select("image"), "image", "left_anti")
    to = held.select(F.col("image").alias("mask"), F.col("canonical").alias("_c"))
    return every.join(to, "mask", "left").withColumn("mask", F.coalesce("_c", "mask")).select(*PLANNED, "soft"), held


def skip_counts(planned: DataFrame) -> DataFrame:
    """(skip, n): how many images stay as they are for each reason."""
    return planned.where("skip <> 'None'").groupBy("skip").agg(F.count(F.lit(1)).alias("n"))


def triggered(dpi_x: Column, dpi_y: Column, most: float) -> Column:
    return F.least(dpi_x, dpi_y) > most * TRIGGER


def target_size(size: Column, own_dpi: Column, most: float) -> Column:
    """Pixels at most DPI: halves round up, at least 1, at most as now."""
    return F.greatest(F.lit(1), F.least(size, F.floor(size * most / own_dpi + 0.5))).cast("long")


def spread(n: Column, k: int) -> Column:
    """array: the places of k samples spread evenly over n, ((2i + 1) n) div (2k); all places if n <= k."""
    i = F.sequence(F.lit(0), F.least(n, F.lit(k)).cast("int") - 1)
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= k, F.transform(i, lambda x: x.cast("long"))).otherwise(
        F.transform(i, lambda x: F.floor(((2 * x + 1) * n) / (2 * k)).cast("long"))
    )


def round_robin(groups: DataFrame, order: list, size: str, each: int = PER_GROUP, most: int = ALL_SAMPLES) -> DataFrame:
    """groups with taken: samples dealt to groups in order, one a round, up to each a group and most in all.

    A row of a group and round meets only most rows at last: the top ones by (round, order).
    """
    ranked = groups.withColumn("_g", F.row_number().over(W.orderBy(*order)))
    turns = ranked.select("_g", F.explode(F.sequence(F.lit(0), F.least(F.col(size), F.lit(each)).cast("int") - 1)).alias("_r")).orderBy("_r", "_g").limit(most)
    counts = turns.groupBy("_g").agg(F.count(F.lit(1)).alias("_t"))
    return ranked.join(counts, "_g", "left").withColumn("taken", F.coalesce("_t", F.lit(0)).cast("long")).drop("_g", "_t")


def budget_pick(items: DataFrame, group: str, order: list[str], size: str, budget: int = BUDGET_BYTES, most: int = BUDGET_ITEMS) -> DataFrame:
    """(group, picked): ids taken in order while the sum of taken sizes stays within budget; one that is too large is skipped, the next are tried.

    items: (group, id, size, columns of order, which are sorted ascending). A fold over each group's sorted array.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("_size"), F.col("id").alias("_id"))))
    fold = (
        f"aggregate(rows, named_struct('sum', 0D, 'n', 0, 'ids', cast(array() as array<bigint>)), (a, x) -> if(a.n < {most} AND a.sum + x._size <= {budget}D, "
        "named_struct('sum', a.sum + x._size, 'n', a.n + 1, 'ids', concat(a.ids, array(x._id))), a), a -> a.ids)"
    )
    return items.groupBy(group).agg(rows.alias("rows")).select(group, F.expr(fold).alias("picked"))


#: What makes a group of images whose bytes a pixel are one estimate.
GROUP = ["soft", "before_encoding", "outcome"]


def ratios(items: DataFrame, bytes_: str = "bytes") -> DataFrame:
    """(GROUP, after_encoding, place, ratio): bytes a pixel of each group's samples, for groups with sampled pixels.

    items: image, GROUP, after_encoding, pixels, bytes before, and sampled (bytes of a sample's own encoding, null for what wasn't sampled). place is
    the group's, by bytes before from the most, then by its first image.
    """
    met = items.groupBy(*GROUP).agg(
        F.sum(bytes_).alias("_b"), F.min("image").alias("_i"), F.min_by("after_encoding", "image").alias("after_encoding"),
        F.sum("sampled").alias("_s"), F.sum(F.when(F.col("sampled").isNotNull(), F.col("pixels"))).alias("_p"),
    )
    placed = met.withColumn("place", F.row_number().over(W.orderBy(F.desc("_b"), "_i")))  # a row a group, of which there are some dozens
    return placed.where("_p > 0").select(*GROUP, "after_encoding", "place", (F.col("_s") / F.col("_p")).alias("ratio"))


def borrowed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (GROUP, after_encoding) with ratio: the group's own, else that of the most alike group which writes the same encoding, else null.

    Alike: 4 for the same kind (soft mask or not), 2 for the encoding read, 1 for the outcome; of equals the first place.
    """
    have = found.select(*[F.col(c).alias(f"_{c}") for c in (*GROUP, "after_encoding", "place", "ratio")])
    same = {c: F.col(c).eqNullSafe(F.col(f"_{c}")) for c in GROUP}
    exact = same["soft"] & same["before_encoding"] & same["outcome"]
    score = sum(F.when(same[c], k).otherwise(0) for c, k in zip(GROUP, (4, 2, 1)))
    score = F.when(exact, 8).otherwise(score)
    met = groups.join(F.broadcast(have), exact | (F.col("after_encoding") == F.col("_after_encoding")), "left")
    return met.groupBy(*GROUP, "after_encoding").agg(F.max_by("_ratio", F.when(F.col("_ratio").isNotNull(), F.struct(score.alias("_v"), (-F.col("_place")).alias("_q")))).alias("ratio"))


def estimate(items: DataFrame, bytes_: str = "bytes") -> DataFrame:
    """items with after: a sample's bytes, never more than before; for the others of a group that is written anew pixels times its ratio, rounded, never more than before; else bytes before.

    outcome null: the image is left as it is.
    """
    found = ratios(items.where("outcome IS NOT NULL"), bytes_)
    groups = items.where("outcome IS NOT NULL").select(*GROUP, "after_encoding").distinct()
    own = borrowed(groups, found).withColumnsRenamed({c: f"_{c}" for c in (*GROUP, "after_encoding", "ratio")})
    on = [items[c].eqNullSafe(own[f"_{c}"]) for c in (*GROUP, "after_encoding")]
    before = F.col(bytes_).cast("long")
    guess = F.least(before, F.rint(F.col("_ratio") * F.col("pixels")).cast("long"))
    rows = items.join(F.broadcast(own), on[0] & on[1] & on[2] & on[3], "left")
    return rows.select(*items.columns, F.when(F.col("sampled").isNotNull(), F.least(before, F.col("sampled").cast("long"))).otherwise(F.coalesce(guess, before)).alias("after"))
