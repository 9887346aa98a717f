"""Problem 5: parent links to full hierarchies, by pointer doubling.

Every node holds a pointer to an ancestor, the number of links up to it and, if wanted, the ids
in between. In each round unresolved nodes join the pointers of the nodes they point to, which
doubles all distances and concatenates the path segments; a node is resolved when its pointer is
a root. After k rounds all nodes up to depth 2^k are resolved, so a round that resolves none
leaves just the nodes whose ancestors end in a circle. Among those the doubling goes on: the
nodes still pointed to shrink to the circles themselves, the smallest id of a circle spreads
along it by doubled minima, and what hangs below is resolved again with circles as roots.

The same doubling counts: with the ancestors at distance 2^k, the descendants nearer than 2^(k+1) are
those nearer than 2^k of a node and of all whose ancestor it is. No pair is ever made for it.

Each round is cut by a table in the shared folder, replaced by the next one, so lineage doesn't
grow and no executor holds a pointer alone. The joins are equi-joins of the unresolved rows with
one row per node; a parent of a third of all nodes is a skewed key on one side only, which
adaptive skew-join splitting handles.

Defined results: a NULL id is no node; a NULL, zero or negative parent is none; of several
parents the greatest counts; repeated links are one; an id that occurs only as a parent is a
root; an empty table has no nodes; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, cut_counting, discard


def parent_links(diffs: DataFrame) -> DataFrame:
    """(id, parent): each node once, with its greatest positive parent or NULL."""
    links = diffs.where("revision_id IS NOT NULL").select("revision_id", F.expr("if(parent_id > 0, parent_id, NULL)").alias("parent"))
    both = F.array(F.struct(F.col("revision_id").alias("id"), F.col("parent").alias("parent")), F.struct(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent")))
    return links.select(F.inline(both)).where("id IS NOT NULL").groupBy("id").agg(F.max("parent").alias("parent"))


class Resolved:
    """``nodes`` (id, root, depth[, segment]) with a root; ``stuck`` (id, parent), the others, or None."""

    def __init__(self, nodes: DataFrame, stuck: DataFrame | None):
        self.nodes, self.stuck = nodes, stuck


def resolve(links: DataFrame, with_path: bool = False) -> Resolved:
    """Root and depth of each node of ``links`` (id, parent); ``segment`` are the ids below the root down to the node."""
    segment = [F.expr("if(parent IS NULL, array(), array(id))").cast("array<bigint>").alias("segment")] if with_path else []
    start = links.select("id", "parent", F.coalesce("parent", "id").alias("ptr"), F.expr("if(parent IS NULL, 0L, 1L)").alias("depth"), F.expr("parent IS NULL").alias("done"), *segment)
    (state, now), left = cut_counting(start, ~F.col("done"), "pointers"), None
    while now and now != left:
        left = now
        mine = state.where("NOT done").alias("a")
        far = state.select("id", "ptr", "depth", "done", *(["segment"] if with_path else [])).alias("b")
        jumped = mine.join(far, F.col("a.ptr") == F.col("b.id")).select(
            "a.id", "a.parent", "b.ptr", (F.col("a.depth") + F.col("b.depth")).alias("depth"), "b.done",
            *([F.concat("b.segment", "a.segment").alias("segment")] if with_path else []),
        )
        after, now = cut_counting(state.where("done").unionByName(jumped), ~F.col("done"), "pointers")
        discard(state)
        state = after
    nodes = state.where("done").select("id", F.col("ptr").alias("root"), "depth", *(["segment"] if with_path else []))
    return Resolved(nodes, state.where("NOT done").select("id", "parent") if now else None)


def circles(stuck: DataFrame) -> DataFrame:
    """(id, smallest) of the nodes on circles, among nodes whose ancestors all end in one."""
    state, size = cut(stuck.select("id", F.col("parent").alias("ptr")), "images"), None
    while True:  # the images of f^(2^k) shrink to the circles
        images = state.select("ptr").distinct().count()
        if images == size:
            break
        size = images
        after = cut(state.alias("a").join(state.alias("b"), F.col("a.ptr") == F.col("b.id")).select("a.id", "b.ptr"), "images")
        discard(state)
        state = after
    on = state.select(F.col("ptr").alias("id")).distinct()
    walk = cut(stuck.join(on, "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.col("id").alias("smallest")), "minima")
    discard(state)
    while True:  # smallest id of the window of 2^k nodes from each node on
        both = walk.alias("a").join(walk.alias("b"), F.col("a.ptr") == F.col("b.id"))
        least = both.select("a.id", "b.ptr", F.least("a.smallest", "b.smallest").alias("smallest"), (F.col("b.smallest") < F.col("a.smallest")).alias("moved"))
        after, moved = cut_counting(least, F.col("moved"), "minima")
        discard(walk)
        walk = after
        if not moved:
            return walk.select("id", "smallest")


def _hanging(stuck: DataFrame, on: DataFrame) -> DataFrame:
    """What hangs below circles, with the circles as roots: nodes without a parent."""
    return stuck.join(on.select("id"), "id", "left_anti").unionByName(on.select("id", F.lit(None).cast("long").alias("parent")))


def _places(stuck: DataFrame, on: DataFrame) -> DataFrame:
    """(id, circle, place, size) of the nodes on circles: each circle is cut above its smallest id, which makes it a chain."""
    chain = stuck.join(on, "id").select("id", F.expr("if(id = smallest, NULL, parent)").alias("parent"))
    placed = resolve(chain).nodes.select("id", F.col("root").alias("circle"), F.col("depth").alias("place"))
    sizes = placed.groupBy("circle").agg(F.count("*").alias("size"))
    return cut(placed.join(sizes, "circle").select("id", "circle", "place", "size"), "places")


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """(id, root, depth, kind[, path]) of all nodes: kind 'tree', 'cycle' or 'below_cycle'.

    ``path`` runs from the root to the node, written with '/'; on and below circles it starts
    at the circle. ``root`` is then the smallest id of the circle and ``depth`` the links up to it.
    """
    found = resolve(links, with_path)
    path = [F.array_join(F.concat(F.array("root"), "segment"), "/").alias("path")] if with_path else []
    trees = found.nodes.select("id", "root", "depth", F.lit("tree").alias("kind"), *path)
    if found.stuck is None:
        return trees
    on = circles(found.stuck)
    ring = on.select("id", F.col("smallest").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("cycle").alias("kind"), *([F.col("id").cast("string").alias("path")] if with_path else []))
    below = resolve(_hanging(found.stuck, on), with_path).nodes.where("depth > 0")
    named = below.join(on.select(F.col("id").alias("root"), "smallest"), "root")
    tails = named.select("id", F.col("smallest").alias("root"), "depth", F.lit("below_cycle").alias("kind"), *path)
    return trees.unionByName(ring).unionByName(tails)


def closure(links: DataFrame) -> DataFrame:
    """(ancestor, id, distance): each node with all its descendants in trees, itself not included."""
    return _pairs(resolve(links, with_path=True).nodes)


def _pairs(nodes: DataFrame) -> DataFrame:
    nodes = nodes.where("depth > 0")
    above = F.posexplode(F.concat(F.array("root"), "segment")).alias("place", "ancestor")
    return nodes.select("id", "depth", above).where("place < depth").select("ancestor", "id", (F.col("depth") - F.col("place")).alias("distance"))


def descendants(links: DataFrame) -> DataFrame:
    """(ancestor, id, distance): each node with all its descendants, itself not included, on and below circles too.

    Descendants of a node on a circle are the others on it and all that hangs below the circle;
    ``distance`` is the least number of links. A node that is its own parent has no pair with itself.
    """
    found = resolve(links, with_path=True)
    trees = _pairs(found.nodes)
    if found.stuck is None:
        return trees
    on = cut(circles(found.stuck), "circles")
    below = cut(resolve(_hanging(found.stuck, on), with_path=True).nodes, "below")
    placed = _places(found.stuck, on)
    a, b = placed.alias("a"), placed.alias("b")
    around = a.join(b, F.col("a.circle") == F.col("b.circle")).where("a.id <> b.id").select(F.col("a.id").alias("ancestor"), F.col("b.id").alias("id"), F.expr("pmod(b.place - a.place, a.size)").alias("distance"))
    tails = below.where("depth > 0").select("id", "root", "depth").alias("t")
    over = around.alias("r").join(tails, F.col("r.id") == F.col("t.root")).select("r.ancestor", F.col("t.id").alias("id"), (F.col("r.distance") + F.col("t.depth")).alias("distance"))
    return trees.unionByName(_pairs(below)).unionByName(around).unionByName(over)


def _counts(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((id, n, height), stuck): of each node how many are below it, itself included, and how deep; right for all but the ``stuck`` (id), whose ancestors end in circles."""
    counts = cut(links.select("id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("height")), "counts")
    jumps, left = cut_counting(links.where("parent IS NOT NULL").select("id", F.col("parent").alias("ptr")), F.lit(True), "jumps")
    step = 1
    while left:
        below = jumps.join(counts, "id").groupBy(F.col("ptr").alias("id")).agg(F.try_sum("n").alias("more"), (F.max("height") + step).alias("deeper"))
        more = cut(counts.join(below, "id", "left").select("id", F.try_add("n", F.coalesce("more", F.lit(0))).alias("n"), F.greatest("height", "deeper").alias("height")), "counts")
        a, b = jumps.alias("a"), jumps.alias("b")
        further, now = cut_counting(a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", "b.ptr"), F.lit(True), "jumps")
        discard(counts, jumps)
        counts, jumps, step = more, further, step * 2
        if now == left:
            return counts, jumps.select("id")
        left = now
    discard(jumps)
    return counts, None


def descendant_counts(links: DataFrame) -> DataFrame:
    """(id, n_descendants, height) of the nodes that have any, themselves not included; on and below circles as ``descendants`` says.

    Around a circle the height is the greatest of distance plus height there, found by running maxima
    over the places, from each node on and up to it.
    """
    counts, stuck = _counts(links)
    found = lambda df: df.select("id", (F.col("n") - 1).alias("n_descendants"), "height").where("n_descendants > 0")
    if stuck is None:
        return found(counts)
    own = links.join(stuck, "id", "left_semi")
    on = cut(circles(own), "circles")
    below, _ = _counts(_hanging(own, on))
    ring = _places(own, on).join(below, "id").withColumn("end", F.col("place") + F.col("height"))
    around = Window.partitionBy("circle").orderBy("place")
    after, before = F.max("end").over(Window.partitionBy("circle").orderBy(F.desc("place"))), F.max("end").over(around) + F.col("size")
    totals = ring.groupBy("circle").agg(F.sum("n").alias("all"))
    circle = ring.withColumn("after", after).withColumn("before", before)
    circle = circle.withColumn("height", F.greatest("after", F.lag("before").over(around)) - F.col("place"))
    on_circles = circle.join(totals, "circle").select("id", F.col("all").alias("n"), "height")
    trees = counts.join(stuck, "id", "left_anti")
    tails = below.join(on.select("id"), "id", "left_anti")
    return found(trees.unionByName(on_circles).unionByName(tails))


def contradictions(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Nodes on and below circles, and nodes whose level isn't the root's level plus their depth."""
    h = hierarchy(parent_links(diffs))
    levels = revisions.where("id IS NOT NULL AND level IS NOT NULL").groupBy("id").agg(F.max("level").alias("level"))
    deep = h.where("kind = 'tree' AND depth > 0").join(levels, "id")
    top = levels.select(F.col("id").alias("root"), F.col("level").alias("root_level"))
    wrong = deep.join(top, "root").where("level <> root_level + depth").select("id", "root", "depth", F.lit("level").alias("kind"))
    return h.where("kind <> 'tree'").select("id", "root", "depth", "kind").unionByName(wrong).select(F.col("id").alias("revision_id"), F.col("root").alias("root_id"), "depth", "kind")
