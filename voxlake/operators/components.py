"""Connected components of a volume cut into chunks (faces connect).

Chunks are slabs of planes or bricks in all three axes, labelled here, or z-slabs of any heights
whose labels come from outside."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voxlake.functions.shared import materialise
from voxlake.functions.volume import AXES, Shape, densify, ranked
from voxlake.operators.graph import connected_components

CHUNK_LABELS = "chunk long, z long, y long, x long, label long"


def _label(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Labels of voxels given in raster order: the place of the component's first voxel."""
    n = len(z)
    sy, sx = int(y.max()) + 2, int(x.max()) + 2
    flat = (z * sy + y) * sx + x  # strictly ascending; a margin keeps rows apart
    label = np.arange(n)
    pairs = []
    for step in (1, sx, sx * sy):
        at = np.minimum(np.searchsorted(flat, flat + step), n - 1)
        hit = np.flatnonzero(flat[at] == flat + step)
        pairs.append(np.stack((hit, at[hit])))
    a, b = np.concatenate(pairs, axis=1)
    while True:  # hook the larger root on the smaller, then halve paths
        ra, rb = label[a], label[b]
        if (ra == rb).all():
            return label
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label = label[label]


def chunk_of(brick: Shape | int) -> Column:
    """The chunk of a voxel: its slab of ``brick`` planes, or its brick (up to 2**20 along y and x)."""
    if isinstance(brick, int):
        return F.floor(F.col("z") / F.lit(brick)).cast("long")
    at = [F.floor(F.col(a) / F.lit(brick.of(a))).cast("long") for a in AXES]
    return F.shiftleft(at[0], 40) + F.shiftleft(at[1], 20) + at[2]


def label_chunks(volume: DataFrame, brick: Shape | int) -> DataFrame:
    """(chunk, z, y, x, label): components within each chunk, 1, 2, ... in raster order of their
    first voxels.  Voxels with v = 0 or null are background, without a row; a voxel that is given
    twice counts once.  A chunk fits in a task: for large planes give bricks."""

    def label(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(list(AXES)).sort_values(list(AXES))
        z, y, x = (rows[a].to_numpy() for a in AXES)
        found = _label(z - z.min(), y - y.min(), x - x.min())
        return pd.DataFrame({"chunk": int(key[0]), "z": z, "y": y, "x": x, "label": np.unique(found, return_inverse=True)[1] + 1})

    placed = volume.where("v <> 0").select(*AXES).withColumn("chunk", chunk_of(brick))
    return placed.groupBy("chunk").applyInPandas(label, CHUNK_LABELS)


def seam_edges(labelled: DataFrame, planes: int | None = None) -> DataFrame:
    """(chunk, la, lb): distinct labels that touch across the seam of ``chunk`` and the next.

    Only the planes at seams are read: the last of a chunk and the first of the next.  Without
    ``planes``, chunks are z-slabs of any heights, in order; where each begins and ends is found
    first, one row for each chunk."""
    if planes is not None:
        last = labelled.where((F.col("z") % planes == planes - 1) & (F.col("label") != 0)).select("chunk", "y", "x", F.col("label").alias("la"))
        first = labelled.where((F.col("z") % planes == 0) & (F.col("label") != 0)).select((F.col("chunk") - 1).alias("chunk"), "y", "x", F.col("label").alias("lb"))
        return last.join(first, ["chunk", "y", "x"]).select("chunk", "la", "lb").distinct()
    seen = labelled.where("label <> 0")
    ends = seen.groupBy("chunk").agg(F.min("z").alias("from"), F.max("z").alias("to"))
    met = ends.select("chunk", F.col("to").alias("z")).join(ends.select((F.col("chunk") - 1).alias("chunk"), (F.col("from") - 1).alias("z")), ["chunk", "z"])
    met = F.broadcast(met)  # at most a row for each chunk
    last = seen.join(met, ["chunk", "z"]).select("chunk", "y", "x", F.col("label").alias("la"))
    first = seen.select((F.col("chunk") - 1).alias("chunk"), (F.col("z") - 1).alias("z"), "y", "x", F.col("label").alias("lb")).join(met, ["chunk", "z"])
    return last.join(first.drop("z"), ["chunk", "y", "x"]).select("chunk", "la", "lb").distinct()


def brick_edges(labelled: DataFrame, brick: Shape) -> DataFrame:
    """(chunk, la, other, lb): distinct labels that touch across the faces of bricks, on all axes.

    Only the voxels at faces take part."""
    found = []
    for axis in AXES:
        side = brick.of(axis)
        last = labelled.where((F.col(axis) % side == side - 1) & (F.col("label") != 0)).withColumn(axis, F.col(axis) + 1)
        first = labelled.where((F.col(axis) % side == 0) & (F.col("label") != 0)).select(*AXES, F.col("chunk").alias("other"), F.col("label").alias("lb"))
        found.append(last.select(*AXES, "chunk", F.col("label").alias("la")).join(first, list(AXES)).select("chunk", "la", "other", "lb"))
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def seam_mappings(edges: DataFrame) -> DataFrame:
    """(chunk, side, label, neighbours): each label's sorted neighbours, from both sides."""
    a = edges.groupBy("chunk", F.col("la").alias("label")).agg(F.sort_array(F.collect_set("lb")).alias("neighbours")).withColumn("side", F.lit("a"))
    b = edges.groupBy("chunk", F.col("lb").alias("label")).agg(F.sort_array(F.collect_set("la")).alias("neighbours")).withColumn("side", F.lit("b"))
    return a.unionByName(b).select("chunk", "side", "label", "neighbours")


def merge_tree(chunks: DataFrame) -> DataFrame:
    """(layer, l, r): pairs of neighbouring chunks by the layer of a pairwise merge.

    ``chunks`` has a column ``chunk``.  Seam j between j and j + 1 is in the layer that equals
    the number of trailing ones of j.  Components don't need it: all seams merge at once."""
    j = F.col("chunk")
    last = chunks.agg(F.max("chunk").alias("last"))
    seams = chunks.select("chunk").distinct().join(F.broadcast(last)).where("chunk < last")  # one row
    layer = F.length(F.regexp_extract(F.bin(j), "(1*)$", 1)).cast("long")
    return seams.select(layer.alias("layer"), j.alias("l"), (j + 1).alias("r"))


def rename_sets(mappings: DataFrame, lut: DataFrame) -> DataFrame:
    """``mappings`` (chunk, side, label, neighbours) with the neighbours renamed by ``lut`` (chunk,
    label, new), distinct and sorted; -1 and neighbours without an entry stay.

    Neighbours of side ``a`` are labels of the next chunk, those of side ``b`` of ``chunk`` itself."""
    one = mappings.select("chunk", "side", "label", F.explode("neighbours").alias("one"))
    one = one.withColumn("in", F.col("chunk") + F.when(F.col("side") == "a", 1).otherwise(0))
    to = lut.select(F.col("chunk").alias("in"), F.col("label").alias("one"), "new")
    new = F.when(F.col("one") == -1, F.col("one")).otherwise(F.coalesce("new", "one"))
    named = one.join(to, ["in", "one"], "left").groupBy("chunk", "side", "label").agg(F.sort_array(F.collect_set(new)).alias("neighbours"))
    return named.select("chunk", "side", "label", "neighbours")


def rename_table(labelled: DataFrame, brick: Shape | int | None = None) -> DataFrame:
    """(chunk, label, new): global labels 1, 2, ... in raster order of first voxels.

    The label graph is one row for each chunk label; it never holds voxels.  ``brick`` is how the
    chunks were cut; without it they are z-slabs of any heights."""
    firsts = labelled.where("label <> 0").groupBy("chunk", "label").agg(F.min(F.struct(*AXES)).alias("first"))
    return rename_from(firsts, brick_edges(labelled, brick) if isinstance(brick, Shape) else seam_edges(labelled, brick).withColumn("other", F.col("chunk") + 1))


def rename_from(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk, label, new) from the labels' first voxels (chunk, label, first) and the labels that
    touch (chunk, la, other, lb)."""
    firsts = materialise(firsts, "chunk-labels")
    ids = ranked(firsts.select("chunk", "label", F.col("first.z").alias("z"), F.col("first.y").alias("y"), F.col("first.x").alias("x")), list(AXES), "id")
    ids = materialise(ids.select("chunk", "label", "id"), "label-ids")
    a = ids.select("chunk", F.col("label").alias("la"), F.col("id").alias("a"))
    b = ids.select(F.col("chunk").alias("other"), F.col("label").alias("lb"), F.col("id").alias("b"))
    links = edges.join(a, ["chunk", "la"]).join(b, ["other", "lb"]).select("a", "b")
    roots = connected_components(materialise(links, "label-links"))
    # ids follow raster order, so a root is the id of the component's first voxel
    rooted = ids.join(roots, ids["id"] == roots["id"], "left").select("chunk", "label", F.coalesce("root", ids["id"]).alias("root"))
    rooted = materialise(rooted, "label-roots")
    return rooted.join(ranked(rooted.select("root").distinct(), ["root"], "new"), "root").select("chunk", "label", "new")


def pair_renaming(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, label, new): the renamings of two labelled parts, ``a`` and ``b``, into one numbering.

    ``labels`` (side, label) are all labels of both, ``edges`` (la, lb) those that touch.  Numbers
    are consecutive: first what joins both parts, by its least label of ``a``, then what lies in
    ``a`` alone, then in ``b`` alone, each by label.  The largest number is the number of components."""
    node = lambda c, side: F.col(c) * 2 + side
    roots = connected_components(edges.select(node("la", 0).alias("a"), node("lb", 1).alias("b")))
    known = labels.where("label <> 0").select("side", "label").distinct().withColumn("id", node("label", F.when(F.col("side") == "b", 1).otherwise(0)))
    rooted = materialise(known.join(roots, "id", "left").select("side", "label", F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNotNull(), 0).when(F.col("side") == "a", 1).otherwise(2).alias("kind")), "pair-roots")
    first = F.min(F.when((F.col("kind") > 0) | (F.col("side") == "a"), F.col("label")))
    groups = ranked(rooted.groupBy("kind", "root").agg(first.alias("first")), ["kind", "first"], "new")
    return rooted.join(groups, ["kind", "root"]).select("side", "label", "new")


@dataclass
class Merged:
    """The label graph of merged chunks: ``labels`` (chunk, label, new), ``edges`` (chunk, la, other, lb)."""

    labels: DataFrame
    edges: DataFrame


def merged_chunks(firsts: DataFrame, edges: DataFrame) -> Merged:
    """The graph of all chunks, from the labels' first voxels (chunk, label, first) and edges."""
    edges = materialise(edges.select("chunk", "la", "other", "lb"), "merged-edges")
    return Merged(materialise(rename_from(firsts, edges), "merged-labels"), edges)


def replace_chunk(state: Merged, chunk: int, labels: DataFrame, edges: DataFrame) -> Merged:
    """The graph after ``chunk`` was added, or put in the place of the one there was.

    ``labels`` (label) are the new chunk's, ``edges`` (chunk, la, other, lb) where they touch other
    chunks' labels; none of either take the chunk away.  Only components that the old or the new
    chunk touches are found again; all others keep their numbers.  One that is found again keeps
    the least number of its labels, unless another of them with smaller labels keeps it; the rest
    get numbers behind the largest."""
    rest = state.labels.where(F.col("chunk") != chunk)
    ends = [edges.select(F.col(c).alias("chunk"), F.col(k).alias("label")) for c, k in (("chunk", "la"), ("other", "lb"))]
    met = ends[0].unionByName(ends[1]).where(F.col("chunk") != chunk).distinct()
    touched = state.labels.where(F.col("chunk") == chunk).select("new").unionByName(rest.join(met, ["chunk", "label"]).select("new")).distinct()
    touched = materialise(touched, "touched")
    stay = rest.join(touched, "new", "left_anti")
    fresh = labels.select(F.lit(chunk).cast("long").alias("chunk"), "label").where("label <> 0").distinct().withColumn("new", F.lit(None).cast("long"))
    redo = rest.join(touched, "new", "left_semi").select("chunk", "label", "new").unionByName(fresh)
    redo = materialise(ranked(redo, ["chunk", "label"], "id"), "redo")
    every = state.edges.where((F.col("chunk") != chunk) & (F.col("other") != chunk)).unionByName(edges.select("chunk", "la", "other", "lb"))
    every = materialise(every, "merged-edges")
    a = redo.select("chunk", F.col("label").alias("la"), F.col("id").alias("a"))
    b = redo.select(F.col("chunk").alias("other"), F.col("label").alias("lb"), F.col("id").alias("b"))
    roots = connected_components(materialise(every.join(a, ["chunk", "la"]).join(b, ["other", "lb"]).select("a", "b"), "redo-links"))
    rooted = materialise(redo.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "redo-roots")
    claims = materialise(rooted.groupBy("root").agg(F.min("new").alias("claim")), "redo-claims")
    won = claims.where("claim is not null").groupBy("claim").agg(F.min("root").alias("root"))
    largest = state.labels.agg(F.coalesce(F.max("new"), F.lit(0))).first()[0]
    others = ranked(claims.join(won, "root", "left_anti").select("root"), ["root"], "n").select("root", (F.col("n") + largest).alias("number"))
    numbers = won.select("root", F.col("claim").alias("number")).unionByName(others)
    done = rooted.join(numbers, "root").select("chunk", "label", F.col("number").alias("new"))
    return Merged(materialise(stay.select("chunk", "label", "new").unionByName(done), "merged-labels"), every)


def apply_renaming(labelled: DataFrame, lut: DataFrame) -> DataFrame:
    """Replace labels by ``lut`` (chunk, label, new); labels that it lacks stay."""
    cols = labelled.columns
    renamed = labelled.join(lut.select("chunk", "label", "new"), ["chunk", "label"], "left").withColumn("label", F.coalesce("new", "label"))
    return renamed.select(*cols)


def relabel_observed(labelled: DataFrame, lut: DataFrame, most: int) -> tuple[DataFrame, dict]:
    """The labels renamed by ``lut`` and written, with what the same job saw: ``voxels``,
    ``rejects`` (null, or not from 0 to ``most``) and ``largest`` (null without voxels).

    The figures are observed where rows are written, so nothing is scanned a second time."""
    seen = Observation("relabelled")
    inside = F.coalesce(F.col("label").between(0, most), F.lit(False))
    renamed = apply_renaming(labelled, lut).observe(seen, F.count(F.lit(1)).alias("voxels"), F.count_if(~inside).alias("rejects"), F.max("label").alias("largest"))
    out = materialise(renamed, "relabelled")
    return out, {"voxels": 0, "rejects": 0, "largest": None} | dict(seen.get)


def compose_renaming(first: DataFrame, then: DataFrame) -> DataFrame:
    """(chunk, label, new) of one renaming after another."""
    step = then.select("chunk", F.col("label").alias("new"), F.col("new").alias("_then"))
    return first.join(step, ["chunk", "new"], "left").select("chunk", "label", F.coalesce("_then", "new").alias("new"))


def merge_labels(labelled: DataFrame) -> DataFrame:
    """(z, y, x, label) of chunks (chunk, z, y, x, label) that were labelled elsewhere.

    Chunks are z-slabs of any heights, numbered in order; labels are any positive numbers, their
    own in each chunk; 0 stays 0."""
    return apply_renaming(labelled, rename_table(labelled)).select(*AXES, "label")


def components(volume: DataFrame, brick: Shape | int) -> DataFrame:
    """(z, y, x, label): components of the whole volume, for any number of chunks: slabs of
    ``brick`` planes, or bricks."""
    labelled = materialise(label_chunks(volume, brick), "chunk-voxels")
    return apply_renaming(labelled, rename_table(labelled, brick)).select(*AXES, "label")


def names_and_sizes(labels: DataFrame) -> DataFrame:
    """(label, z, y, x, size): first voxel in raster order and number of voxels of each label."""
    found = labels.groupBy("label").agg(F.min(F.struct(*AXES)).alias("f"), F.count(F.lit(1)).alias("size"))
    return found.select("label", *(F.col(f"f.{a}").alias(a) for a in AXES), "size")


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def merge_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, z, y, x): the name of ``a`` where it has one, else that of ``b``."""
    left = a.select("label", F.struct(*AXES).alias("p"))
    right = b.select("label", F.struct(*AXES).alias("q"))
    both = left.join(right, "label", "full").select("label", F.coalesce("p", "q").alias("n"))
    return both.select("label", *(F.col(f"n.{k}").alias(k) for k in AXES))


def check_labels(labels: DataFrame, most: int) -> DataFrame:
    """(inside, n): how many voxels have a label from 0 to ``most``, and how many not."""
    inside = F.coalesce(F.col("label").between(0, most), F.lit(False))
    return labels.groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def with_background(labels: DataFrame, shape: Shape) -> DataFrame:
    """All voxels of ``shape``; those without a label get 0."""
    return densify(labels, shape, "label")
