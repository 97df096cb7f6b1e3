"""Near-duplicate vectors by navigable small-world graphs per shard.

Vectors of one label (and length) are dealt into shards of bounded size; each shard gets a layered
graph, built in one task and stored as rows. Every vector then queries every shard of its label: tasks
are (label, shard, block of queries), each of bounded size, so a hot label only means more tasks.

In a task a beam descends the layers and widens on the lowest one. Two things widen it further: an
audit, which compares the graph's ``NEIGHBOURS`` closest vectors of a fixed number of the block's queries
with those of an exact pass, and doubles the beam until ``RECALL`` of them are found and every true link
of these queries is; and queries with half a beam or more above the threshold, which are asked again with
twice the beam. Only a beam that would hold the whole shard gives way to an exact scan of it, so no
number of links is out of reach. Links are verified by cosine in double precision. Every task also leaves
a row with its last beam and the recall that its audit measured (``audits``).

Equal vectors are one class with a count and enter a graph once. Within a task links are joined to
components, so that a group of n near copies leaves n rows and not n squared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import shared
from tidepanel.llm.bitslice import usable
from tidepanel.llm.components import components, least_reached
from tidepanel.llm.neardup import mix

COSINE = 0.98
SHARD_ROWS = 8192
DEGREE = 12
BUILD_BEAM, FIRST_BEAM = 32, 32
AUDITS, NEIGHBOURS, RECALL = 64, 10, 0.95
BATCH = 256
EXPAND = 4


def beam_search(
    queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of each query's ``beam`` best nodes found, best first; -1 where there are fewer.

    All queries of a batch advance together, by an eighth of the beam at a time, so that the number of steps, each of which
    orders the whole beam, does not grow with it. ``entry`` holds start nodes per query.
    """
    q, width = len(queries), max(beam, entry.shape[1])
    expand = max(EXPAND, width // 8)
    seen = np.zeros((q, len(vectors)), bool)
    ids = np.full((q, width), -1, np.int64)
    near = np.full((q, width), -np.inf, np.float32)
    entry = np.sort(entry, axis=1)
    start = np.einsum("qd,qkd->qk", queries, vectors[entry])
    again = np.zeros(entry.shape, bool)
    again[:, 1:] = entry[:, 1:] == entry[:, :-1]
    start[again] = -np.inf
    entry = np.where(again, -1, entry)
    first = np.argsort(-start, axis=1)
    ids[:, : entry.shape[1]] = np.take_along_axis(entry, first, 1)
    near[:, : entry.shape[1]] = np.take_along_axis(start, first, 1)
    at, to = np.nonzero(entry >= 0)
    seen[at, entry[at, to]] = True
    done = np.zeros((q, width), bool)
    active = np.arange(q)
    while len(active):
        own_ids, own_near, own_done = ids[active], near[active], done[active]
        open_ = (own_ids >= 0) & ~own_done
        go = open_.any(axis=1)
        if not go.all():
            active = active[go]
            if not len(active):
                break
            own_ids, own_near, own_done, open_ = own_ids[go], own_near[go], own_done[go], open_[go]
        turn = np.cumsum(open_, axis=1)
        pick = open_ & (turn <= expand)
        own_done |= pick
        # Neighbours of the picked nodes that their query has not seen, each once and in order.
        at, place = np.nonzero(pick)
        reached = links[own_ids[at, place]]
        code = (at[:, None] * len(vectors) + reached)[reached >= 0]
        code = np.sort(code)
        at, to = np.divmod(code[np.append(True, code[1:] != code[:-1])[: len(code)]], len(vectors))
        new = ~seen[active[at], to]
        at, to = at[new], to[new]
        seen[active[at], to] = True
        close = np.einsum("nd,nd->n", queries[active[at]], vectors[to])
        # Only what is closer than the last of the beam can enter it.
        enters = close > own_near[at, -1]
        at, to, close = at[enters], to[enters], close[enters]
        counts = np.bincount(at, minlength=len(active))
        slot = width + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        most = width + int(counts.max(initial=0))
        every, names = np.full((len(active), most), -np.inf, np.float32), np.full((len(active), most), -1, np.int64)
        over = np.zeros((len(active), most), bool)
        every[:, :width], names[:, :width], over[:, :width] = own_near, own_ids, own_done
        every[at, slot], names[at, slot] = close, to
        best = np.argsort(-every, axis=1, kind="stable")[:, :width]
        near[active] = np.take_along_axis(every, best, 1)
        ids[active] = np.take_along_axis(names, best, 1)
        done[active] = np.take_along_axis(over, best, 1)
    return ids[:, :beam], near[:, :beam]


def diverse(vectors: np.ndarray, nodes: np.ndarray, found: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` neighbours per node: a candidate closer to the node than to any chosen before it."""
    out = np.full((len(nodes), degree), -1, np.int64)
    own = vectors[found]
    between = own @ own.transpose(0, 2, 1)
    chosen = np.zeros(found.shape, bool)
    for c in range(found.shape[1]):
        rival = np.where(chosen, between[:, c, :], -np.inf).max(axis=1)
        chosen[:, c] = (found[:, c] >= 0) & (found[:, c] != nodes) & (near[:, c] > rival) & (chosen.sum(axis=1) < degree)
    place = np.cumsum(chosen, axis=1) - 1
    at, to = np.nonzero(chosen)
    out[at, place[at, to]] = found[at, to]
    # Places left over go to the closest candidates.
    for c in range(found.shape[1]):
        free = (out < 0).any(axis=1) & ~chosen[:, c] & (found[:, c] >= 0) & (found[:, c] != nodes)
        rows = np.flatnonzero(free)
        out[rows, (out[rows] < 0).argmax(axis=1)] = found[rows, c]
    return out


def _add_back(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray, degree: int) -> None:
    """Link neighbours back to new nodes; a full list keeps a diverse choice of old and new."""
    source = np.repeat(nodes, links.shape[1])
    target = links[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads, first, counts = np.unique(target, return_index=True, return_counts=True)
    widest = int(counts.max(initial=0))
    if not widest:
        return
    incoming = np.full((len(heads), widest), -1, np.int64)
    incoming[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
    every = np.sort(np.concatenate([links[heads], incoming], axis=1), axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    # A list that holds them all needs no choice.
    fits = (every >= 0).sum(axis=1) <= links.shape[1]
    few = every[fits]
    links[heads[fits]] = np.take_along_axis(few, np.argsort(few < 0, axis=1, kind="stable")[:, : links.shape[1]], 1)
    heads, every = heads[~fits], every[~fits]
    near = np.where(every >= 0, np.einsum("nd,nkd->nk", vectors[heads], vectors[every]), -np.inf)
    keep = min(every.shape[1], 3 * degree)
    best = np.argsort(-near, axis=1, kind="stable")[:, :keep]
    links[heads] = diverse(
        vectors, heads, np.take_along_axis(every, best, 1), np.take_along_axis(near, best, 1), links.shape[1]
    )


def layer(vectors: np.ndarray, members: np.ndarray, degree: int, beam: int = BUILD_BEAM) -> np.ndarray:
    """Links of one layer over ``members`` (in order of insertion), as a row per vector of the shard."""
    links = np.full((len(vectors), 2 * degree), -1, np.int64)
    head = members[:BATCH]
    near = vectors[head] @ vectors[head].T
    best = np.argsort(-near, axis=1, kind="stable")[:, : 3 * degree + 1]
    links[head] = diverse(vectors, head, head[best], np.take_along_axis(near, best, 1), 2 * degree)
    _add_back(vectors, links, head, degree)
    done = len(head)
    while done < len(members):
        nodes = members[done : done + min(BATCH, done)]
        mine = vectors[nodes]
        entry = head[np.argsort(-(mine @ vectors[head].T), axis=1)[:, :2]]
        ids, close = beam_search(mine, vectors, links, entry, beam)
        peers = np.broadcast_to(nodes, (len(nodes), len(nodes)))
        order = np.argsort(-(mine @ mine.T), axis=1, kind="stable")[:, : degree + 1]
        ids = np.concatenate([ids, np.take_along_axis(peers, order, 1)], axis=1)
        close = np.concatenate([close, np.take_along_axis(mine @ mine.T, order, 1)], axis=1)
        best = np.argsort(-close, axis=1, kind="stable")
        links[nodes] = diverse(
            vectors, nodes, np.take_along_axis(ids, best, 1), np.take_along_axis(close, best, 1), 2 * degree
        )
        _add_back(vectors, links, nodes, degree)
        done += len(nodes)
    return _connected(vectors, members, links)


def _connected(vectors: np.ndarray, members: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Give every node that the first one does not reach a link from the closest node that it does."""
    reached = np.zeros(len(vectors), bool)

    def walk(front: np.ndarray) -> None:
        reached[front] = True
        while len(front):
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~reached[front]]
            reached[front] = True

    walk(members[:1])
    extra: dict[int, list[int]] = {}
    for node in members:
        if not reached[node]:
            known = np.flatnonzero(reached)
            extra.setdefault(int(known[np.argmax(vectors[known] @ vectors[node])]), []).append(int(node))
            walk(np.array([node]))
    if extra:
        more = np.full((len(links), max(map(len, extra.values()))), -1, np.int64)
        for node, to in extra.items():
            more[node, : len(to)] = to
        links = np.concatenate([links, more], axis=1)
    return links


def build(vectors: np.ndarray, keys: np.ndarray, degree: int = DEGREE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, links) per layer, the top one first. A node's level is drawn from its key."""
    draw = (mix(keys.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(degree)).astype(np.int64)
    order = np.lexsort((keys, -level))
    made = []
    for l in range(int(level.max(initial=0)), -1, -1):
        members = order[level[order] >= l]
        made.append((members, layer(vectors, members, degree)))
    return made


def search(
    queries: np.ndarray, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Descend the layers greedily, then search the lowest with the full beam."""
    entry = np.full((len(queries), 1), layers[0][0][0])
    for _, links in layers[:-1]:
        found = beam_search(queries, vectors, links, entry, 2)[0]
        entry = np.where(found >= 0, found, found[:, :1])
    return beam_search(queries, vectors, layers[-1][1], entry, beam)


def audit(
    queries: np.ndarray, query_keys: np.ndarray, vectors: np.ndarray, keys: np.ndarray,
    layers: list[tuple[np.ndarray, np.ndarray]], loose: np.float32, recall: float = RECALL,
) -> tuple[int, float]:
    """The beam whose audit passes, and the recall it reached; a beam of the shard's size means a scan.

    A query's own vector does not count. Neighbours as close as the last true one count as true ones.
    """
    near = queries @ vectors.T
    near[query_keys[:, None] == keys[None, :]] = -np.inf
    true = min(NEIGHBOURS, len(vectors) - 1)
    last = -np.partition(-near, true - 1, axis=1)[:, true - 1]
    linked = near >= loose
    beam = FIRST_BEAM
    while beam < len(vectors):
        found, _ = search(queries, vectors, layers, beam)
        seen = np.zeros(near.shape, bool)
        at, place = np.nonzero(found >= 0)
        seen[at, found[at, place]] = True
        reached = float(np.minimum((seen & (near >= last[:, None])).sum(axis=1), true).sum()) / (true * len(queries))
        # Queries with more links than half a beam are asked again anyway.
        few = linked.sum(axis=1) <= beam // 2
        if reached >= recall and not (linked & ~seen)[few].any():
            return beam, reached
        beam *= 2
    return len(vectors), 1.0


def shard_links(
    queries: np.ndarray, query_keys: np.ndarray, vectors: np.ndarray, keys: np.ndarray,
    layers: list[tuple[np.ndarray, np.ndarray]], cosine: float, recall: float = RECALL, audits: int = AUDITS,
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Verified links (query row, shard row) of a block of queries, the beam that passed and its recall.

    Vectors are unit length, in double.
    """
    small, own = queries.astype(np.float32), vectors.astype(np.float32)
    loose = np.float32(cosine - 1e-4)  # single precision decides nothing: the verification does

    def verified(rows: np.ndarray, found: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, to = np.nonzero((near >= loose) & (found >= 0))
        at, hit = rows[at], found[at, to]
        exact = np.einsum("nd,nd->n", queries[at], vectors[hit]) >= cosine
        exact &= query_keys[at] != keys[hit]
        return at[exact], hit[exact]

    def scan(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        everyone = np.broadcast_to(np.arange(len(own)), (len(rows), len(own)))
        return verified(rows, everyone, small[rows] @ own.T)

    beam, reached = len(own), 1.0
    if FIRST_BEAM < len(own):
        sample = np.arange(0, len(queries), max(1, -(-len(queries) // audits)))
        beam, reached = audit(small[sample], query_keys[sample], own, keys, layers, loose, recall)
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    rows, width = np.arange(len(queries)), beam
    while len(rows):
        again = [rows[:0]]
        for cut in range(0, len(rows), BATCH):
            part = rows[cut : cut + BATCH]
            if width >= len(own):
                parts.append(scan(part))
                continue
            found, near = search(small[part], own, layers, width)
            full = near[:, width // 2] >= loose
            parts.append(verified(part[~full], found[~full], near[~full]))
            again.append(part[full])
        rows, width = np.concatenate(again), 2 * width
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), beam, reached


GROUP = ["label", "width", "shard"]


def _unit(vectors: pd.Series) -> np.ndarray:
    made = np.stack(vectors.to_numpy()).astype(np.float64)
    return made / np.sqrt(np.einsum("nd,nd->n", made, made))[:, None]


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Every vector of the shard with its links per layer, the lowest first."""
    rows = rows.sort_values("class").reset_index(drop=True)
    layers = build(_unit(rows["vector"]).astype(np.float32), rows["class"].to_numpy())
    per_node: list[list[list[int]]] = [[] for _ in range(len(rows))]
    for members, links in reversed(layers):
        for node in members:
            own = links[node]
            per_node[node].append(own[own >= 0].tolist())
    return rows[[*GROUP, "class", "copies", "vector"]].assign(links=per_node)


def _layers(links: pd.Series, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of a stored shard, the top one first."""
    height = links.map(len).to_numpy()
    made = []
    for l in range(int(height.max(initial=1)) - 1, -1, -1):
        members = np.flatnonzero(height > l)
        width = max(1, max(len(links[m][l]) for m in members))
        table = np.full((len(keys), width), -1, np.int64)
        for m in members:
            own = links[m][l]
            table[m, : len(own)] = own
        # The entry is a node of the greatest height.
        made.append((members[np.argsort(-height[members], kind="stable")], table))
    return made


FOUND = {"class": "int64", "peer": "int64", "weight": "int64", "beam": "int64", "recall": "float64"}


def searched(classes: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(class, peer, weight, beam, recall): per class its links' copies, and pairs that join components.

    ``classes`` is (label, width, class, copies, vector), one row per different vector. A task adds one row
    of class -1 with its shard's size as weight, its beam and its audit's recall.
    """
    shards = classes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "width"]).withColumn(
        "shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int")
    )
    graphs = shared.stored(
        dealt.select(*GROUP, "class", "copies", "vector").groupBy(*GROUP).applyInPandas(
            _build_shard,
            "label string, width int, shard int, class bigint, copies bigint, vector array<float>, links array<array<int>>",
        ), "graphs",
    )
    every_block = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    asked = dealt.select("label", "width", "shards", F.col("shard").alias("block"), "class", "vector").withColumn(
        "shard", every_block
    ).drop("shards")
    held = graphs.join(shards, ["label", "width"]).withColumn("block", every_block).drop("shards")

    def link(stored_shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(stored_shard) or not len(block):
            return pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in FOUND.items()})
        shard = stored_shard.sort_values("class").reset_index(drop=True)
        keys, asking = shard["class"].to_numpy(), block["class"].to_numpy()
        at, to, beam, recall = shard_links(
            _unit(block["vector"]), asking, _unit(shard["vector"]), keys, _layers(shard["links"], keys), cosine
        )
        weight = np.bincount(at, shard["copies"].to_numpy()[to], len(asking)).astype(np.int64)
        nodes, place = np.unique(np.concatenate([asking, keys]), return_inverse=True)
        label = nodes[least_reached(place[at], place[len(asking) + to], len(nodes))]
        linked = np.unique(np.concatenate([place[at], place[len(asking) + to]])).astype(np.int64)
        counted = pd.DataFrame({"class": asking, "peer": asking, "weight": weight})
        joined = pd.DataFrame({"class": nodes[linked], "peer": label[linked], "weight": 0})
        links = pd.concat([counted[counted["weight"] > 0], joined]).assign(beam=0, recall=0.0)
        audited = pd.DataFrame({"class": [-1], "peer": [-1], "weight": [len(keys)], "beam": [beam], "recall": [recall]})
        return pd.concat([links, audited]).astype(FOUND)

    keys = [*GROUP, "block"]
    return shared.stored(
        held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
            link, "class bigint, peer bigint, weight bigint, beam bigint, recall double"
        ), "links",
    )


def audits(found: DataFrame) -> DataFrame:
    """(rows, beam, recall, graph) of every task of ``searched``; without ``graph`` the shard was scanned."""
    return found.filter("class < 0").select(
        F.col("weight").alias("rows"), "beam", "recall", (F.col("beam") < F.col("weight")).alias("graph")
    )


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings`` (vec_id, embedding, label).

    Vectors are compared with those of the same non-NULL label and length. Vectors that are NULL, empty,
    zero, or hold NULL or non-finite components link with nothing. Rows with equal vectors and labels are
    linked with each other. ``component_id`` is the smallest vec_id reachable; rows that repeat an id count
    as vectors of their own and share it as their name. A row with a NULL vec_id takes part under the
    name of its component; alone its component is NULL, and it is kept. Other columns are passed over.
    """
    spark = embeddings.sparkSession
    shared.prepare(spark)
    e = F.col("embedding")
    fit = F.coalesce(F.col("label").isNotNull() & usable(e) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = shared.stored(
        embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
        .withColumn("fit", fit)
        .select(
            "vec_id", "fit", "label", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("h1"),
            F.xxhash64(F.lit(1), "embedding").alias("h2"), F.when(F.col("fit"), e).alias("embedding"),
            F.monotonically_increasing_id().alias("row"),
        ), "vectors",
    )
    same = ["label", "width", "h1", "h2"]
    classes = shared.stored(
        rows.filter("fit").groupBy(*same).agg(
            F.min("row").alias("class"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
            F.first("embedding").alias("vector"),
        ), "classes",
    )
    found = searched(classes, cosine, shard_rows).filter("class >= 0")
    weights = found.groupBy("class").agg(F.sum("weight").alias("_links"))
    reached = components(found.filter("class <> peer"), "class", "peer").withColumnRenamed("node", "class")
    placed = classes.select(*same, "class", "first_id", "copies").join(weights, "class", "left").join(
        reached, "class", "left"
    ).withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = placed.join(least, "component").select(
        *same, (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    lone = rows.filter("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        rows.filter("fit").select("vec_id", *same).join(facts, same).select("vec_id", "n_links", "component_id").unionByName(lone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
