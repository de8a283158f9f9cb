"""Parent-child rows to full hierarchies.

Method: contraction.  Rows are placed so that most of a chain lies in one partition.  Each partition contracts its own
chains, piece by piece: every node learns the node at which its chain leaves the piece.  The nodes at which chains enter
another piece form a smaller quotient forest of the same shape, which is solved by the same step over larger blocks; then
the fragments are expanded with the quotient's answers.  Loops inside a piece are found there, loops across pieces in the
quotient.  Numbers of descendants go the same way upwards: a piece sums its own nodes and what enters it.

Placement: neighbouring positions of one group lie together; rows without group or position are spread.  A quotient that
doesn't halve any more has no locality left: from then on each node is placed, by a coin, either with its parent or where
its own children may come to it, so a quarter of all links falls inside a piece in every round, whatever the forest looks
like.  A task holds ``LOCAL_ROWS`` rows and a batch at most, however many rows its partition has.

Every edge table has: node, parent (null: none), own (nodes on the way that the node stands for), low (their smallest id),
last (the id at their upper end), path (their ids from the top down, or null), loop (smallest id of the loop it is known to
run into), weight (nodes below that it stands for, itself included) and the placement columns grp and pos; rows of the
first round also have their id, ordering and level.

Defined results: rows without id are left out; repeated rows of a node count once; a node that is its own parent is a
loop of one; an empty table gives empty results; a null level is a wrong level, as no number equals it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are contracted together; memory of a task is bounded by it.
LOCAL_ROWS = 200_000
#: Quotient answers up to this many bytes, by their measured lengths, are broadcast for the expansion.
BROADCAST_BYTES = 16 << 20
#: Neighbouring positions that are kept together in the first round; later rounds take up to 64 times as many.
BLOCK = 4096
#: Positions of rows that have none.
_SPREAD = 1 << 40

_OWN = "id string, parent string, grp string, pos bigint, ordering bigint, level bigint, weight bigint"
_FRAGMENT = f"node string, {_OWN}, exit string, own bigint, low string, last string, loop string, path array<string>, late string, piece bigint"


def _doubled(step: np.ndarray, own: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the last node of its chain, the summed ``own`` and the least ``rank`` on the way, ends included.

    ``step`` is the next position or -1.  Chains that never end keep a last node whose ``step`` isn't -1.
    """
    at = np.arange(len(step))
    jump = np.where(step < 0, at, step)
    moves = step >= 0
    total = np.where(moves, own, 0)
    least = rank.copy()
    for _ in range(max(1, int(len(step)).bit_length() + 1)):
        if not moves[jump].any():
            break
        total = total + total[jump]
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    return jump, total + own[jump], np.minimum(least, rank[jump])


def _loop_ranks(step: np.ndarray, endless: np.ndarray, rank: np.ndarray) -> dict[int, int]:
    """Least rank of the loop that each endless position runs into."""
    found: dict[int, int] = {}
    for start in endless:
        trail, seen, i = [], {}, int(start)
        while i not in found and i not in seen:
            seen[i] = len(trail)
            trail.append(i)
            i = int(step[i])
        least = found[i] if i in found else min(int(rank[j]) for j in trail[seen[i] :])
        for j in trail:
            found[j] = least
    return found


def contract(batch: pd.DataFrame, piece: int = 0) -> pd.DataFrame:
    """The chains of one piece's edge rows, contracted to their exits."""
    n = len(batch)
    ids = pd.Index(batch["node"])
    parent = batch["parent"].to_numpy(object)
    step = ids.get_indexer(pd.Index(parent, dtype=object)) if n else np.zeros(0, np.int64)
    step = np.where(pd.isna(parent), -1, step).astype(np.int64)
    own = batch["own"].to_numpy(np.int64)
    low = batch["low"].to_numpy(object)
    names, rank = np.unique(low.astype(str), return_inverse=True)
    end, total, least = _doubled(step, own, rank)
    endless = np.flatnonzero(step[end] >= 0) if n else np.zeros(0, np.int64)
    loops = _loop_ranks(step, endless, rank)
    loop = batch["loop"].to_numpy(object)[end] if n else np.full(n, None, object)
    for i, r in loops.items():
        loop[i] = names[r]
    paths = np.full(n, None, object)
    if n and batch["path"].notna().any():
        mine = batch["path"].to_numpy(object)
        for i in range(n):
            todo, j = [], i
            while pd.isna(loop[j]) and paths[j] is None:
                todo.append(j)
                if step[j] < 0:
                    break
                j = int(step[j])
            for j in reversed(todo):
                paths[j] = list(mine[j]) if step[j] < 0 else paths[int(step[j])] + list(mine[j])
    # Compared with a parent in the same piece: the parent's id if that stands at or behind the node, else empty.
    late = np.full(n, None, object)
    inner = np.flatnonzero(step >= 0)
    if len(inner):
        up = step[inner]
        grp, order = batch["grp"].to_numpy(object), batch["ordering"].to_numpy(float)
        behind = (grp[inner] == grp[up]) & (grp[inner] != "") & (order[up] >= order[inner])
        late[inner] = np.where(behind, batch["id"].to_numpy(object)[up], "")
    out = batch[["node", "id", "parent", "grp", "pos", "ordering", "level", "weight"]].copy()
    out["exit"] = np.where(pd.isna(loop), parent[end], None) if n else parent
    out["own"], out["low"], out["last"] = total, names[least] if n else low, batch["last"].to_numpy(object)[end] if n else low
    out["loop"], out["path"], out["late"], out["piece"] = loop, paths, late, piece
    return out


def _contracting(local_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        piece = (context.partitionId() if context else 0) << 32
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= local_rows:
                yield contract(pd.concat(held, ignore_index=True), piece)
                held, piece = [], piece + 1
        if sum(map(len, held)):
            yield contract(pd.concat(held, ignore_index=True), piece)

    return run


def _fragments(edges: DataFrame, rows: int, block: int, local_rows: int, coin: int | None) -> DataFrame:
    """``edges`` contracted piece by piece; ``coin`` numbers the round if nodes are to be mated with their parents."""
    parts = -(-rows // local_rows)
    if parts <= 1:
        placed = edges.coalesce(1)
    elif coin is None:
        placed = edges.withColumn("_b", F.floor(F.col("pos") / block)).repartition(parts, "grp", "_b").sortWithinPartitions("grp", "_b").drop("_b")
    else:
        follows = F.col("parent").isNotNull() & (F.pmod(F.xxhash64("node", F.lit(coin)), F.lit(2)) == 0)
        placed = edges.withColumn("_b", F.when(follows, F.col("parent")).otherwise(F.col("node"))).repartition(parts, "_b").sortWithinPartitions("_b").drop("_b")
    return placed.mapInPandas(_contracting(local_rows), _FRAGMENT)


_PASSED = ["node", "id", "parent", "grp", "ordering", "level", "late"]


def _small(rows: DataFrame, count: int) -> bool:
    """Whether answers of a quotient may be broadcast, by their measured lengths."""
    if count > BROADCAST_BYTES // 100:
        return False
    paths = F.coalesce(F.aggregate("path", F.lit(0), lambda s, x: s + F.octet_length(x) + 16), F.lit(0))
    return (rows.agg(F.sum(F.octet_length("node") + F.octet_length("ref") + 100 + paths)).first()[0] or 0) <= BROADCAST_BYTES


def _answers(fragments: DataFrame, solved: DataFrame | None, small: bool) -> DataFrame:
    """Fragments expanded with the answers of the quotient, if there is one: node, kind, ref, total, path and what rows brought along."""
    ended = fragments.filter(F.col("exit").isNull()).select(
        *_PASSED,
        F.when(F.col("loop").isNotNull(), "loop").otherwise("root").alias("kind"),
        F.coalesce("loop", "last").alias("ref"),
        F.col("own").alias("total"),
        "path",
    )
    left = fragments.filter(F.col("exit").isNotNull())
    if solved is None:  # every exit leads to a node that has no row
        return ended.unionByName(left.select(*_PASSED, F.lit("cut").alias("kind"), F.col("last").alias("ref"), F.col("own").alias("total"), "path"))
    right = solved.select(F.col("node").alias("exit"), "kind", "ref", F.col("total").alias("above"), F.col("path").alias("up"))
    passed = left.join(F.broadcast(right) if small else right, "exit", "left").select(
        *_PASSED,
        F.coalesce("kind", F.lit("cut")).alias("kind"),
        F.coalesce("ref", "last").alias("ref"),
        (F.col("own") + F.coalesce("above", F.lit(0))).alias("total"),
        F.when(F.col("kind").isNull(), F.col("path")).otherwise(F.concat("up", "path")).alias("path"),
    )
    return ended.unionByName(passed)


def contracted(edges: DataFrame, cut, local_rows: int = LOCAL_ROWS, block: int = BLOCK) -> list[tuple[DataFrame, int]]:
    """The fragments of every round, and how many they are.  ``cut`` writes a frame and reads it back."""
    edges = cut(edges)
    rows, before, widest = edges.count(), None, 64 * block
    levels: list[tuple[DataFrame, int]] = []
    mating = False
    while rows or not levels:
        mating = mating or (before is not None and 2 * rows > before)
        fragments = cut(_fragments(edges, rows, block, local_rows, len(levels) if mating else None))
        levels.append((fragments, rows))
        entries = fragments.filter(F.col("exit").isNotNull()).groupBy(F.col("exit").alias("node")).agg(F.sum("weight").alias("weight"))
        quotient = fragments.drop("weight", "parent").join(entries, "node")
        none = F.lit(None)
        edges = cut(
            quotient.select(
                "node", none.cast("string").alias("id"), F.col("exit").alias("parent"), "grp", "pos", none.cast("bigint").alias("ordering"), none.cast("bigint").alias("level"), "weight",
                "own", "low", "last", "path", "loop",
            )
        )
        before, rows, block = rows, edges.count(), min(widest, block * 64)
    return levels


def solve(edges: DataFrame, cut, **sizes) -> DataFrame:
    """Answers for every node: node, kind (root, cut or loop), ref, total, path, and id, parent, grp, ordering, level, late.

    total is the number of nodes on the way up, ends included; in a loop it means nothing.
    """
    return _expanded(contracted(edges, cut, **sizes), cut)


def _expanded(levels: list[tuple[DataFrame, int]], cut) -> DataFrame:
    answer, small = None, False
    for n, (fragments, size) in reversed(list(enumerate(levels))):
        answer = _answers(fragments, answer, small)
        if n:
            answer = cut(answer)
            small = _small(answer, size)
    return answer


def _summed(piece: pd.DataFrame) -> pd.DataFrame:
    """Per node of one piece the weights of all nodes of the piece below it and itself; 0 where the way never ends."""
    ids = pd.Index(piece["node"])
    parent = piece["parent"].to_numpy(object)
    step = np.where(pd.isna(parent), -1, ids.get_indexer(pd.Index(parent, dtype=object))).astype(np.int64)
    ones = np.ones(len(step), np.int64)
    end, depth, _ = _doubled(step, ones, np.zeros(len(step), np.int64))
    total = np.where(step[end] < 0, piece["weight"].to_numpy(np.int64), 0).tolist()
    ends, up = (step[end] < 0).tolist(), step.tolist()
    for i in np.argsort(-depth, kind="stable").tolist():
        if ends[i] and up[i] >= 0:
            total[up[i]] += total[i]
    return pd.DataFrame({"node": piece["node"].to_numpy(object), "below": np.array(total, np.int64)})


def _counted(levels: list[tuple[DataFrame, int]], cut) -> DataFrame:
    """Per node (node, below) the number of nodes below it and itself; of nodes that run into a loop it means nothing."""
    counts = None
    for n, (fragments, _) in reversed(list(enumerate(levels))):
        own = fragments.select("piece", "node", "parent", "weight")
        if counts is not None:
            entering = counts.select("node", F.col("below").alias("entering"))
            own = own.join(entering, "node", "left").select("piece", "node", "parent", (F.col("weight") + F.coalesce("entering", F.lit(0))).alias("weight"))
        counts = own.groupBy("piece").applyInPandas(_summed, "node string, below bigint")
        if n:
            counts = cut(counts)
    return counts


def edge_rows(nodes: DataFrame, with_path: bool, step: str = "id") -> DataFrame:
    """Edges of ``nodes`` (node, id, parent, grp, ordering, level), one per node; grp and ordering also say where to place them.

    Paths are made of the column ``step``.
    """
    spread = F.pmod(F.xxhash64("node"), F.lit(_SPREAD))
    return nodes.select(
        "node",
        "id",
        "parent",
        F.coalesce("grp", F.lit("")).alias("grp"),
        F.when(F.col("grp").isNull(), spread).otherwise(F.coalesce(F.col("ordering").cast("bigint"), spread)).alias("pos"),
        F.col("ordering").cast("bigint").alias("ordering"),
        F.col("level").cast("bigint").alias("level"),
        F.lit(1).cast("bigint").alias("weight"),
        F.lit(1).cast("bigint").alias("own"),
        F.col("id").alias("low"),
        F.col("id").alias("last"),
        (F.array(step) if with_path else F.lit(None).cast("array<string>")).alias("path"),
        F.lit(None).cast("string").alias("loop"),
    )


def nodes_of(rows: DataFrame, node, id_, parent, grp, ordering, level) -> DataFrame:
    """One row per node key: node, id, parent, grp, ordering, level.  Repeated rows agree; the least value is taken."""
    keyed = rows.select(
        node.alias("node"), id_.alias("id"), parent.alias("parent"), grp.alias("grp"), ordering.cast("bigint").alias("ordering"), level.cast("bigint").alias("level")
    ).filter(F.col("node").isNotNull())
    return keyed.groupBy("node").agg(*(F.min(c).alias(c) for c in ("id", "parent", "grp", "ordering", "level")))


def hierarchy(nodes: DataFrame, cut, **sizes) -> DataFrame:
    """Per node: id, kind, root_id, depth, path (ids from the root down) and n_descendants.

    Nodes of kind ``cut`` hang below a node whose parent is missing; their root is that node.  Nodes of kind ``loop``
    have no root, depth or path; root_id is null and loop_id the smallest id on the loop.
    """
    levels = contracted(edge_rows(nodes, True), cut, **sizes)
    sound = F.col("kind") != "loop"
    return (
        _expanded(levels, cut)
        .join(_counted(levels, cut), "node")
        .select(
            "id",
            "kind",
            F.when(sound, F.col("ref")).alias("root_id"),
            F.when(~sound, F.col("ref")).alias("loop_id"),
            F.when(sound, F.col("total")).alias("depth"),
            F.when(sound, F.col("path")).alias("path"),
            F.when(sound, F.col("below") - 1).alias("n_descendants"),
        )
    )


def descendants(nodes: DataFrame, cut, **sizes) -> DataFrame:
    """Every pair of a node and one below it: ancestor_id, descendant_id, distance.  As many rows as all depths summed."""
    answer = solve(edge_rows(nodes, True), cut, **sizes).filter("kind <> 'loop'")
    far = F.size("path") - 1
    return (
        answer.select(F.element_at("path", -1).alias("descendant_id"), far.alias("depth"), F.posexplode("path").alias("at", "ancestor_id"))
        .filter(F.col("at") < F.col("depth"))
        .select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def unsound(nodes: DataFrame, cut, **sizes) -> DataFrame:
    """Nodes without a sound place: id, kind, ref_id.

    ``loop`` and ``cut`` name where the way up goes wrong, ``depth`` a root whose distance isn't the stated level,
    ``order`` a parent of the same group that stands at or behind its child.
    """
    answer = cut(solve(edge_rows(nodes, False), cut, **sizes))
    wrong_end = answer.filter((F.col("kind") != "root") | ~F.coalesce(F.col("total") == F.col("level"), F.lit(False))).select(
        "id", F.when(F.col("kind") == "root", "depth").otherwise(F.col("kind")).alias("kind"), F.col("ref").alias("ref_id")
    )
    # Parents in the child's own piece were compared there; only the pieces' upper ends need a join.
    sound = answer.filter("kind <> 'loop'")
    inside = sound.filter("late <> ''").select("id", F.lit("order").alias("kind"), F.col("late").alias("ref_id"))
    tops = sound.filter("late is null and parent is not null and grp <> ''").select("id", "parent", "grp", "ordering")
    up = answer.select(F.col("node").alias("parent"), F.col("id").alias("ref_id"), F.col("grp").alias("p_grp"), F.col("ordering").alias("p_ordering"))
    outside = tops.join(up, "parent").filter((F.col("p_grp") == F.col("grp")) & (F.col("p_ordering") >= F.col("ordering"))).select("id", F.lit("order").alias("kind"), "ref_id")
    return wrong_end.unionByName(inside).unionByName(outside)
