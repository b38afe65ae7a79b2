"""Parent-child links to full hierarchies: path, depth, root, descendants, loops.

A table with at most one parent a node is a weighted disjoint-set forest: a node points to the top of its tree, and
its offset, the number of links to the top, is carried along (``forest``). Partitions first combine the links that they
hold; then the partitions' tables are merged by pointing each unfinished node beyond its top, in as many joins as the
logarithm of the longest chain. A link that closes a chain shows as a node met again on its own chain.

Roots and loops over all links come from such merges too (``contraction``): nodes with one parent are merged into the
tree above them, so that only nodes with several parents, and the links between their trees, are left. That is repeated
on the remaining graph, until the rest fits one task of checked size (``REST_ROWS``) or nothing is merged any more; a link
from a tree to its own top closes a loop, whose nodes are found by climbing from the link's tail. A larger core in which
every node has several parents, if there is one, is coloured.

Paths follow one primary parent a node, and are materialised last, by doubling the piece of path above each node.
A primary link can lead into a loop although another parent leads to a root. Such nodes take over the first
alternative parent that is already under a root, until nothing changes; what is left has no root at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.session import BROADCAST_BYTES, checkpoint, counted, sized, total_cores

#: Links that one task may hold to list what is below nodes; about 200 bytes of a worker's memory each.
MERGE_ROWS = 1_000_000
#: Links of a partition that are combined first.
PART_ROWS = 500_000
#: Links between trees that the last merge takes into one task, and links so few that one task lists what is below all nodes.
REST_ROWS = 100_000
SMALL_ROWS = 1_000

TREE = "node string, top string, offset bigint, low string, looped boolean"


def title(c: Column | str) -> Column:
    """A title without outer white space and leading ``Category:``, with underscores for spaces; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    strip = lambda x: F.regexp_replace(x, r"(?U)^[\s_]+|[\s_]+$", "")
    plain = strip(F.regexp_replace(strip(c), r"^Category:", ""))
    plain = F.when(c.rlike(r"(?U)^[\s_]|[\s_]$|^Category:"), plain).otherwise(c)  # most have nothing to strip
    return F.nullif(F.translate(plain, " ", "_"), F.lit(""))


#: Bytes of a row in a broadcast besides its strings.
ROW_BYTES = 100


def near(df: DataFrame, rows: int, strings: int) -> DataFrame:
    """``df`` as a broadcast side if its counted rows and the bytes of their strings are small, else as it is (AQE splits hot keys)."""
    return F.broadcast(df) if rows * ROW_BYTES + strings <= BROADCAST_BYTES else df


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Combine the links of one partition: find with path compression, offsets added up.

    ``low`` is the lowest name on the chain, the node itself left out. Chains that close are looped.
    """
    link: dict[str, str] = {}
    for batch in batches:
        link.update(zip(batch["node"], batch["ptr"]))
    done: dict[str, tuple[str, int, str, bool]] = {}
    for start in link:
        chain, on, node = [], set(), start
        while node in link and node not in done and node not in on:
            chain.append(node)
            on.add(node)
            node = link[node]
        if node in on:  # a link closes the chain
            done.update((x, (node, 0, node, True)) for x in chain)
            continue
        top, offset, low, looped = done.get(node, (node, 0, node, False))
        for x in reversed(chain):
            offset, low = offset + 1, min(low, link[x])
            done[x] = (top, offset, low, looped)
    rows = list(done.items())
    for a in range(0, len(rows), 10_000):
        part = rows[a : a + 10_000]
        yield pd.DataFrame({"node": [k for k, _ in part], **{c: [v[i] for _, v in part] for i, c in enumerate(("top", "offset", "low", "looped"))}})


def forest(links: DataFrame, rows: int) -> DataFrame:
    """``node, top, offset, looped`` of every node of the ``rows`` ``links`` (node, ptr: at most one link a node).

    ``top`` is the end of the chain and ``offset`` the number of links to it; where the chain runs into a loop, ``looped``
    is set and top and offset mean nothing. Empty links give no row.
    """
    spark = links.sparkSession
    parts = max(total_cores(spark), -(-rows // PART_ROWS))
    state = checkpoint(links.select("node", "ptr").repartition(parts, "node").mapInPandas(_merge, TREE).withColumn("done", F.col("looped")))
    loops = state.limit(0).select(F.col("low").alias("least"))
    while True:
        above = state.select(F.col("node").alias("o_node"), F.col("top").alias("o_top"), F.col("offset").alias("o_offset"), F.col("low").alias("o_low"), F.col("looped").alias("o_looped"), F.col("done").alias("o_done"))
        met = state.where("NOT done").join(above, F.col("top") == F.col("o_node"), "left")
        low, looped = F.least("low", "o_low"), F.coalesce("o_looped", F.lit(False))
        moved = met.select(
            "node", F.coalesce("o_top", "top").alias("top"), (F.col("offset") + F.coalesce("o_offset", F.lit(0))).alias("offset"), low.alias("low"),
            (looped | (low == F.col("node"))).alias("looped"), F.coalesce("o_done", F.lit(True)).alias("done"), (low == F.col("node")).alias("closed"),
        )
        seen = Observation()
        state = checkpoint(
            state.where("done").withColumn("closed", F.lit(False)).unionByName(moved.withColumn("done", F.col("done") | F.col("looped")))
            .observe(seen, F.count_if(~F.col("done")).alias("left"), F.count_if("closed").alias("closed"))
        )
        left = seen.get["left"]
        if seen.get["closed"]:  # the lowest nodes of loops: whoever has one on its chain runs into a loop
            loops = checkpoint(loops.union(state.where("closed").select(F.col("node").alias("least"))))
            again = Observation()
            state = state.join(loops, F.col("low") == F.col("least"), "left").withColumn("looped", F.col("looped") | F.col("least").isNotNull())
            state = checkpoint(state.withColumn("done", F.col("done") | F.col("looped")).drop("least").observe(again, F.count_if(~F.col("done")).alias("left")))
            left = again.get["left"]
        state = state.drop("closed")
        if not left:
            return state.select("node", "top", "offset", "looped")


def _on_loops(links: DataFrame) -> DataFrame:
    """``node, part``: the nodes of ``links`` (node, ptr) that lie on closed chains, with the lowest name on theirs.

    Every chain of ``links`` has to run into a loop. Pointers are doubled until they reach the same nodes as before,
    which are those on loops, and until the lowest names do not change any more.
    """
    state = links.select("node", F.col("ptr").alias("top"), F.col("ptr").alias("low"))
    reached = None
    while True:
        other = state.select(F.col("node").alias("o_node"), F.col("top").alias("o_top"), F.col("low").alias("o_low"))
        seen = Observation()
        low = F.least("low", "o_low")
        state = checkpoint(
            state.join(other, F.col("top") == F.col("o_node")).select("node", F.col("o_top").alias("top"), low.alias("new"), (low < F.col("low")).alias("lower"))
            .withColumnRenamed("new", "low").observe(seen, F.count_if("lower").alias("lower"))
        )
        on, n = counted(state.select("top").distinct())
        state = state.drop("lower")
        if n == reached and not seen.get["lower"]:
            return state.join(on.select(F.col("top").alias("node")), "node", "left_semi").select("node", F.col("low").alias("part"))
        reached = n


def _climb(tails: DataFrame, links: DataFrame) -> DataFrame:
    """``tails`` (node, part) and all nodes above them by ``links`` (node, ptr), which have no loop there."""
    found, rows = counted(tails.distinct())
    jump = links
    while rows:
        step = found.join(jump, "node").select(F.col("ptr").alias("node"), "part")
        found = checkpoint(found.union(step).distinct())
        jump, rows = counted(jump.join(jump.select(F.col("node").alias("ptr"), F.col("ptr").alias("beyond")), "ptr").select("node", F.col("beyond").alias("ptr")))
    return found


def contraction(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cycle, trees)``: ``node, part`` of the nodes on closed chains of ``links`` (parent, child; other than to
    themselves), by strongly connected part; and ``node, top, looped`` of the nodes with one parent."""
    edges, rows = counted(links.where("parent <> child").select("parent", "child").distinct())
    if not rows:
        empty = edges.select(F.col("parent").alias("node"), F.col("child").alias("part"))
        return empty, empty.select("node", F.col("part").alias("top"), F.lit(False).alias("looped"))
    by_child = checkpoint(edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent")))
    single = by_child.where("n = 1").select(F.col("child").alias("node"), F.col("parent").alias("ptr"))
    several = by_child.where("n > 1").select("child")
    trees = checkpoint(forest(single, rows).select("node", "top", "looped"))
    # links into nodes with several parents, from the tops of the trees that they leave; a loop of nodes with one
    # parent each cannot be entered, and nothing leads to a root
    tails = edges.join(several, "child", "left_semi").join(trees.withColumnsRenamed({"node": "parent"}), "parent", "left")
    tails = tails.where("NOT coalesce(looped, false)").select(F.col("parent").alias("tail"), F.coalesce("top", "parent").alias("top"), "child")
    tails, n_tails = counted(tails.join(several.select(F.col("child").alias("top")), "top", "left_semi"))
    looped, n_looped = counted(single.join(trees.where("looped").select("node"), "node", "left_semi"))
    cycle = _on_loops(looped) if n_looped else edges.select(F.col("parent").alias("node"), F.col("child").alias("part")).limit(0)
    if not n_tails:
        return cycle, trees
    between, n_between = counted(tails.where("top <> child").select(F.col("top").alias("parent"), "child").distinct())
    if n_between <= REST_ROWS:  # the last merge
        inner = between.coalesce(1).mapInPandas(_tarjan, "node string, part string")
    elif n_between == rows:  # no node has one parent, none is a root: the core
        inner = _coloured(between)
    else:
        inner = contraction(between)[0]
    inner = checkpoint(inner)
    of_top, of_child = inner.select(F.col("node").alias("top"), F.col("part").alias("top_part")), inner.select(F.col("node").alias("child"), F.col("part").alias("child_part"))
    closing = tails.join(of_top, "top", "left").join(of_child, "child", "left").where("top = child OR top_part = child_part").select(F.col("tail").alias("node"), F.coalesce("top_part", "top").alias("part"))
    straight = single.join(looped.select("node"), "node", "left_anti")
    return checkpoint(cycle.union(_climb(closing, straight)).union(inner).distinct()), trees


def graph(categories: DataFrame | None, edges: DataFrame, parent: str = "parent_category", child: str = "child_category", ord: str | None = "ord", name: str = "category_title") -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)``: all titles, and distinct parent, child with the lowest ord. Links with a null end are left out."""
    at = F.min(F.coalesce(F.col(ord), F.lit((1 << 62)))) if ord else F.lit(0)
    ends = checkpoint(edges.select(title(parent).alias("parent"), title(child).alias("child"), *([ord] if ord else [])))
    links = checkpoint(ends.where("parent IS NOT NULL AND child IS NOT NULL").groupBy("parent", "child").agg(at.alias("ord")))
    nodes = ends.select(F.col("parent").alias("node")).union(ends.select("child"))
    if categories is not None:
        nodes = nodes.union(categories.select(title(name)))
    return checkpoint(nodes.where("node IS NOT NULL").distinct()), links


def _paths(links: DataFrame) -> DataFrame:
    """``node, path``: of every node of ``links`` (node, ptr; without loops) the nodes from the top of its chain to itself."""
    state = links.select("node", F.col("ptr").alias("top"), F.array("ptr").alias("above"), F.lit(True).alias("moved"))
    while True:
        other = state.select(F.col("node").alias("o_node"), F.col("top").alias("o_top"), F.col("above").alias("o_above"))
        seen = Observation()
        step = state.where("moved").join(other, F.col("top") == F.col("o_node"), "left").select(
            "node", F.coalesce("o_top", "top").alias("top"), F.when(F.col("o_node").isNull(), F.col("above")).otherwise(F.concat("o_above", "above")).alias("above"), F.col("o_node").isNotNull().alias("moved")
        )
        state = checkpoint(state.where("NOT moved").unionByName(step).observe(seen, F.count_if("moved").alias("left")))
        if not seen.get["left"]:
            return state.select("node", F.concat("above", F.array("node")).alias("path"))


def hierarchy(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root, depth, path`` of every node; null root, depth and path for nodes that no root leads to.

    The path follows primary links: the parent of lowest (ord, title), unless its chain leads into a loop; then the
    node, or the first one above it that has a parent under a root, takes the first such parent. Nodes without parents
    are their own root with depth 0; a link to itself counts as a parent. Isolated nodes, deep chains, several parents,
    repeated links and empty tables need no special care.
    """
    having = links.select(F.col("child").alias("node")).distinct()
    roots = checkpoint(nodes.join(having, "node", "left_anti"))
    proper = checkpoint(links.where("parent <> child"))
    first = lambda df: df.groupBy("child").agg(F.min(F.struct("ord", "parent")).alias("first")).select(F.col("child").alias("node"), F.col("first.parent").alias("ptr"))
    primary, n_todo = counted(first(proper))
    todo = primary
    rooted, parents = roots, primary.limit(0)
    while True:
        trees = forest(todo, n_todo).where("NOT looped")
        # a top is a true root, or was rooted in an earlier round, or (only a link to itself) leads nowhere
        fresh = checkpoint(trees.join(rooted.select(F.col("node").alias("top")), "top", "left_semi").select("node"))
        parents = parents.unionByName(todo.join(fresh, "node", "left_semi"))
        rooted = checkpoint(rooted.unionByName(fresh).distinct())
        # alternatives of what is left that are under a root now
        left, n_left = counted(nodes.join(rooted, "node", "left_anti"))
        if not n_left:
            break
        again = proper.join(left.withColumnRenamed("node", "child"), "child", "left_semi")
        anchors, n_anchors = counted(first(again.join(rooted.select(F.col("node").alias("parent")), "parent", "left_semi")))
        if not n_anchors:
            break
        n_todo = n_left
        todo = anchors.unionByName(primary.join(left, "node", "left_semi").join(anchors, "node", "left_anti"))
    path = roots.select("node", F.array("node").alias("path")).unionByName(_paths(checkpoint(parents)))
    return nodes.join(path.select("node", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path"), "node", "left")


def rootless(nodes: DataFrame, links: DataFrame, trees: DataFrame) -> DataFrame:
    """``node``: nodes that no chain of links leads to from a node without parents; ``trees`` are those of ``contraction``.

    Only the tops of trees are walked, from the roots on, along the links between trees.
    """
    top = nodes.join(trees, "node", "left").select("node", F.coalesce("top", "node").alias("top"), F.coalesce("looped", F.lit(False)).alias("looped"))
    top = checkpoint(top)
    having = links.select(F.col("child").alias("top")).distinct()
    frontier, rows = counted(top.where("NOT looped").select("top").distinct().join(having, "top", "left_anti"))
    between = checkpoint(links.join(trees.select("node").withColumnRenamed("node", "child"), "child", "left_anti").join(top.where("NOT looped").withColumnRenamed("node", "parent"), "parent").select("top", "child").where("top <> child").distinct())
    reached = frontier
    while rows:
        frontier, rows = counted(between.join(frontier, "top", "left_semi").select(F.col("child").alias("top")).distinct().join(reached, "top", "left_anti"))
        reached = checkpoint(reached.union(frontier)) if rows else reached
    return top.join(reached.withColumn("ok", F.lit(True)), "top", "left").where("looped OR ok IS NULL").select("node")


def descendants(tree: DataFrame) -> DataFrame:
    """``node, descendant, distance``: the nodes below each node on primary paths, one row each (a row a path entry); ``closure`` follows all links."""
    steps = tree.where("path IS NOT NULL").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return steps.where("at < depth").select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes below the sources of one task; rows without a child are its sources, the others all links."""
    links: set[tuple[str, str]] = set()
    sources: list[str] = []
    for batch in batches:
        for parent, child in zip(batch.column("parent").to_pylist(), batch.column("child").to_pylist()):
            if child is None:
                sources.append(parent)
            else:
                links.add((parent, child))
    code: dict[str, int] = {}
    down: list[list[int]] = []
    for a, b in links:
        for x in (a, b):
            if x not in code:
                code[x] = len(down)
                down.append([])
        down[code[a]].append(code[b])
    links.clear()
    names = pa.array(list(code), pa.string())
    seen = [-1] * len(down)
    tops, reached, far = [], [], []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(tops, pa.int64())), names.take(pa.array(reached, pa.int64())), pa.array(far, pa.int32())], names=["node", "descendant", "distance"])

    for source in sources:
        start = code[source]
        level, distance = [start], 0
        while level:
            distance += 1
            following = []
            for v in level:
                for w in down[v]:
                    if seen[w] != start:
                        seen[w] = start
                        following.append(w)
            tops += [start] * len(following)
            reached += following
            far += [distance] * len(following)
            level = following
            if len(tops) >= 50_000:
                yield rows()
                tops, reached, far = [], [], []
    if tops:
        yield rows()


def _rounds(edges: DataFrame) -> DataFrame:
    """The closure in semi-naive rounds of joins: each round follows only the pairs that the last one found."""
    ahead = edges.select(F.col("parent").alias("descendant"), F.col("child").alias("following"))
    reached = frontier = checkpoint(edges.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance")))
    done = 0
    while True:
        step = frontier.join(ahead, "descendant").select("node", F.col("following").alias("descendant"), (F.col("distance") + 1).alias("distance")).distinct()
        frontier, rows = counted(step.join(reached, ["node", "descendant"], "left_anti"))
        if not rows:
            return reached
        reached = reached.unionByName(frontier)
        done += 1
        if done % 10 == 0:  # the plan must not grow with the depth
            reached = checkpoint(reached)


def closure(links: DataFrame, merge_rows: int | None = None) -> DataFrame:
    """``node, descendant, distance``: all nodes that links lead to from each node, with the fewest links between, one row each.

    All links count, not only primary ones, so a child of several parents is below each of them. A node on a closed
    chain is below itself, at the length of its shortest one. The sources are dealt over tasks that each hold all
    links, up to ``MERGE_ROWS`` of them; beyond, rounds of joins do the same.
    """
    edges, rows = counted(links.select("parent", "child").distinct())
    if rows > (merge_rows or MERGE_ROWS):
        return _rounds(edges)
    tasks = total_cores(links.sparkSession) * 2 if rows > SMALL_ROWS else 1
    part = F.sequence(F.lit(0), F.lit(tasks - 1))
    # by hash, so that the sources with many descendants spread over the tasks
    sources = edges.select("parent").distinct().select(F.pmod(F.xxhash64("parent"), F.lit(tasks)).cast("int").alias("part"), "parent", F.lit(None).cast("string").alias("child"))
    dealt = edges.select(F.explode(part).alias("part"), "parent", "child").unionByName(sources)
    return dealt.repartitionByRange(tasks, "part").select("parent", "child").mapInArrow(_below, "node string, descendant string, distance int")


def _tarjan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, part`` of the nodes on closed chains among the edges of one task."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    edges = pd.concat(frames)
    codes, names = pd.factorize(pd.concat([edges["parent"], edges["child"]], ignore_index=True))
    n, half = len(names), len(edges)
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(codes[:half].tolist(), codes[half:].tolist()):
        out[a].append(b)
    index, low, on, stack, found, count = [-1] * n, [0] * n, bytearray(n), [], [], 0
    for first in range(n):
        if index[first] >= 0:
            continue
        work = [(first, 0)]
        index[first] = low[first] = count
        count += 1
        stack.append(first)
        on[first] = 1
        while work:
            v, i = work.pop()
            nexts = out[v]
            while i < len(nexts):
                w = nexts[i]
                i += 1
                if index[w] < 0:
                    work.append((v, i))
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = 1
                    work.append((w, 0))
                    break
                if on[w] and index[w] < low[v]:
                    low[v] = index[w]
            else:
                if work and low[v] < low[work[-1][0]]:
                    low[work[-1][0]] = low[v]
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on[w] = 0
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        found += [(names[x], names[v]) for x in part]
    yield pd.DataFrame(found, columns=["node", "part"], dtype="object")


def _coloured(edges: DataFrame) -> DataFrame:
    """``node, part`` of the nodes on closed chains by colouring, in rounds of joins."""
    found = None
    while True:
        edges = checkpoint(edges)
        if not edges.limit(1).count():
            return found if found is not None else edges.select(F.col("parent").alias("node"), F.col("child").alias("part")).limit(0)
        nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
        colour = checkpoint(nodes.withColumn("colour", F.col("node")))
        while True:  # the highest name that leads to a node
            into = edges.join(colour.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("colour").alias("c"))
            after = checkpoint(colour.join(into, "node", "left").select("node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("up")))
            colour = after.drop("up")
            if not after.where("up").limit(1).count():
                break
        inside = (
            edges.join(colour.withColumnRenamed("node", "parent").withColumnRenamed("colour", "pc"), "parent")
            .join(colour.withColumnRenamed("node", "child").withColumnRenamed("colour", "cc"), "child").where("pc = cc").select("parent", "child", F.col("pc").alias("colour"))
        )
        inside = checkpoint(inside)
        back = checkpoint(colour.where("node = colour").select("node"))
        reached = back
        while True:  # backwards from the node that gave the colour
            step = inside.join(reached.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
            new = checkpoint(step.join(reached, "node", "left_anti"))
            if not new.limit(1).count():
                break
            reached = checkpoint(reached.union(new))
        core = inside.join(reached.withColumnRenamed("node", "parent"), "parent", "left_semi").join(reached.withColumnRenamed("node", "child"), "child", "left_semi")
        loops = core.select(F.col("parent").alias("node"), F.col("colour").alias("part")).distinct()
        found = loops if found is None else found.union(loops)
        found = checkpoint(found.distinct())
        gone = reached
        edges = edges.join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("node", "child"), "child", "left_anti")


def cycle_nodes(links: DataFrame) -> DataFrame:
    """``node``: every node on a closed chain of links, a link to itself too."""
    own = links.where("parent = child").select(F.col("child").alias("node"))
    return own.union(contraction(links)[0].select("node")).distinct()


def bad_paths(categories: DataFrame, links: DataFrame, path: str = "path", name: str = "category_title") -> DataFrame:
    """``node``: titles with a stored, non-null path that is not a chain of links from a parentless node to themselves.

    An empty path and one with a null or empty entry are no chains.
    """
    stored = categories.where(F.col(path).isNotNull()).select(title(name).alias("node"), F.transform(path, title).alias("steps")).where("node IS NOT NULL")
    ends_well = (F.size("steps") > 0) & F.coalesce(F.element_at(F.when(F.size("steps") > 0, F.col("steps")), -1) == F.col("node"), F.lit(False)) & ~F.exists("steps", lambda x: x.isNull())
    stored = checkpoint(stored.withColumn("well", ends_well))
    wrong, good = stored.where("NOT well").select("node"), stored.where("well")
    starts = good.select("node", F.col("steps")[0].alias("child"))
    with_parent = links.select("child").distinct()
    wrong = wrong.union(starts.join(with_parent, "child", "left_semi").select("node"))
    pairs = good.where(F.size("steps") > 1).select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps") - 1), lambda i: F.struct(F.element_at("steps", i).alias("parent"), F.element_at("steps", i + 1).alias("child")))).alias("s")).select("node", "s.*")
    # distinct pairs first: a link near the root is on very many paths
    missing, n_missing, missing_size = sized(pairs.select("parent", "child").distinct().join(links.select("parent", "child"), ["parent", "child"], "left_anti"), ["parent", "child"])
    broken = pairs.join(near(missing, n_missing, missing_size), ["parent", "child"], "left_semi").select("node")
    return wrong.union(broken).distinct()


def found(categories: DataFrame, edges: DataFrame) -> DataFrame:
    """``category_title, kind`` with kinds cycle, rootless and path."""
    nodes, links = graph(categories, edges)
    cycle, trees = contraction(links)
    own = links.where("parent = child").select(F.col("child").alias("node"))
    parts = {"cycle": own.union(cycle.select("node")), "rootless": rootless(nodes, links, trees), "path": bad_paths(categories, links)}
    out = None
    for kind, df in parts.items():
        one = df.select(F.col("node").alias("category_title"), F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out.distinct()
