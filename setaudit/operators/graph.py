"""Dependencies between sets: BIOS, devices and parents, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.session import cut


def edges(sets: DataFrame) -> DataFrame:
    """(src, dst, kind): bios, device (only to sets that are devices, wherever they stand in the file) and parent."""
    bios = sets.where("bios_set IS NOT NULL").select(F.col("set_name").alias("src"), F.col("bios_set").alias("dst"), F.lit("bios").alias("kind"))
    devices = sets.where("is_device").select(F.col("set_name").alias("dst"))
    device = sets.select(F.col("set_name").alias("src"), F.explode("device_refs").alias("dst")).join(devices, "dst", "left_semi").select("src", "dst", F.lit("device").alias("kind"))
    parent = sets.where("rom_of IS NOT NULL").select(F.col("set_name").alias("src"), F.col("rom_of").alias("dst"), F.lit("parent").alias("kind"))
    return bios.unionAll(device).unionAll(parent).distinct()


def _rounds(step: DataFrame, stride: int) -> DataFrame:
    """Pairs of a checkpointed graph, round by round; see `closure`."""
    seen = frontier = near = step
    at, hop = 1, 1
    while True:
        ahead = near.select(F.col("root").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        grown = frontier.join(ahead, "node").where("root <> next").groupBy("root", F.col("next").alias("node")).agg((F.min("more") + at).alias("depth"))
        new = cut(grown.join(seen, ["root", "node"], "left_anti"))
        at += hop
        frontier = new.where(F.col("depth") == at)
        if new.isEmpty():
            return seen
        seen = seen.unionAll(new)
        if at == stride:
            near, hop = seen, stride


def closure(links: DataFrame, stride: int = 4, layers: int = 2) -> DataFrame:
    """(root, node, depth): every node reachable from a root, with its least depth; the root itself is not listed.

    Most roots are what nothing depends on. They are set aside, `layers` times over, and only the rest, all cycles among it,
    is closed round by round. The first `stride` rounds go one step each; from then on a round joins the pairs of the
    outermost depth with all pairs found so near, and so goes `stride` steps, until a round brings nothing new, however long
    the chains. Each round keeps only new pairs, so cycles end and dangling ends stay listed; its pairs go to the checkpoint
    folder, so the plan does not grow and a lost executor costs no recomputation. A root set aside then reaches its own
    nodes and what these reach: one join, whose pairs are never kept. Links with a null end are none.
    """
    step = cut(links.select(F.col("src").alias("root"), F.col("dst").alias("node")).where("root <> node").distinct().withColumn("depth", F.lit(1)))
    core, aside = step, []
    for _ in range(layers):
        needed = core.select(F.col("node").alias("root")).distinct()
        aside.append(core.join(needed, "root", "left_anti"))
        core = core.join(needed, "root", "left_semi")
    reach = _rounds(cut(core), stride)
    for layer in reversed(aside):
        ahead = reach.select(F.col("root").alias("node"), F.col("node").alias("next"), (F.col("depth") + 1).alias("depth"))
        far = layer.select("root", "node").join(ahead, "node").select("root", F.col("next").alias("node"), "depth").where("root <> node")
        reach = reach.unionAll(layer.unionAll(far).groupBy("root", "node").agg(F.min("depth").alias("depth")))
    return reach


def required_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(root, source, name, category): the items a set needs, its own and those of all it depends on."""
    own = sets.select(F.col("set_name").alias("root"), F.col("set_name").alias("source"), F.lit(True).alias("own"))
    deps = closure(edges(sets)).select("root", F.col("node").alias("source"), F.lit(False).alias("own"))
    flags = sets.select(F.col("set_name").alias("source"), "is_bios", "is_device")
    category = F.when(F.col("own"), "Game").when(F.col("is_bios"), "BIOS").when(F.col("is_device"), "Device").otherwise("Parent")
    from_ = own.unionAll(deps).join(flags, "source").select("root", "source", category.alias("category"))
    return from_.join(items.select(F.col("set_name").alias("source"), "name"), "source").select("root", "source", "name", "category")
