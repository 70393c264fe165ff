"""Near-duplicate vectors by robust-pruned flat graphs.

Vectors of one label (and one length) are dealt to the shard of their nearest centroid,
fitted on a bounded sample; a shard that is still too large (a dense group) is split by
hash.  Each shard builds a flat graph: every vector's nearest candidates, pruned so that a
kept neighbour is not much nearer to another kept one.  Every vector is then a query in its
shard: greedy search from the shard's medoid and, once vectors in range are found,
expansion through all neighbours near the range.  Every answer is verified by cosine in
double precision and holds for both vectors.  A share of each shard's queries is held
against brute force; a shard whose mean recall falls short is compared in whole.

Links between shards are exact: a vector can only link into a shard that begins within the
range's chord of it (its distance to the plane between both centroids), so the vectors of
two shards near their common border are compared in blocks, each pair once for both.

:func:`audit` measures recall by label against brute force, on different vectors alone (equal
ones are found without a search); :func:`near_duplicates` compares labels that fall short
in whole.

Equal vectors are one point that carries their number.  Rows link only within a label;
rows whose label is null or whose vector is null, empty, zero, or holds null, NaN or
infinite components link with nothing (0 links, kept, their own component).  A null
vec_id is answered but never a partner's component.  Repeated rows count as other
vectors.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilquery.llm._common import components, durable


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced sample rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(similar: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Neighbours out of candidates (nearest first); similar: candidates by candidates, with the point's own
    similarities in the last row.  Drops a candidate that is alpha times nearer to a kept one."""
    distance = 1 - similar
    alive = np.ones(len(candidates), dtype=bool)
    kept: list[int] = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(int(candidates[i]))
            if len(kept) == degree:
                break
            alive &= alpha * distance[i] > distance[-1]
    return kept


def _homes(centroids: dict):
    """Adds the nearest centroid."""
    def run(batches):
        for rows in batches:
            cluster = np.zeros(len(rows), dtype=np.int64)
            for key, at in rows.groupby(["label", "size"], sort=False).indices.items():
                c = centroids.get(key)
                for a in range(0, len(at) if c is not None else 0, 256):
                    some = at[a : a + 256]
                    cluster[some] = np.argmax(_unit(rows["embedding"].iloc[some]) @ c.T, axis=1)
            yield rows.assign(cluster=cluster)

    return run


def _cells(centroids: dict, splits: dict, least: float):
    """Every vector once for its own shard (u = v) and once for each other shard that may hold a partner (u < v)."""
    chord = np.sqrt(2 - 2 * least) + 1e-6

    def run(batches):
        for rows in batches:
            taken, own_unit, other_unit = [], [], []
            for (label, size), at in rows.groupby(["label", "size"], sort=False).indices.items():
                c = centroids.get((label, size))
                k = 1 if c is None else len(c)
                parts = np.array([splits.get((label, size, b), 1) for b in range(k)])
                first = np.concatenate([[0], np.cumsum(parts)])
                for a in range(0, len(at), 256):
                    some = at[a : a + 256]
                    home = rows["cluster"].to_numpy()[some]
                    unit = first[home] + rows["h1"].to_numpy()[some] % parts[home]
                    asks = np.ones((len(some), 1), dtype=bool)
                    if k > 1:
                        near = _unit(rows["embedding"].iloc[some]) @ c.T
                        between = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
                        asks = near[np.arange(len(some)), home][:, None] - near <= chord * between + 1e-9
                        asks[np.arange(len(some)), home] = True
                    r, b = np.nonzero(np.repeat(asks, parts, axis=1))
                    taken.append(some[r])
                    own_unit.append(unit[r])
                    other_unit.append(b)
            if taken:
                own, other = np.concatenate(own_unit), np.concatenate(other_unit)
                out = rows.iloc[np.concatenate(taken)].assign(u=np.minimum(own, other), v=np.maximum(own, other), unit=own)
                yield out[["rep", "label", "size", "n", "embedding", "u", "v", "unit"]]

    return run


def _graph(x: np.ndarray, degree: int, alpha: float, pool: int) -> list[np.ndarray]:
    """Neighbours of each vector, in both directions."""
    n = len(x)
    lists: list[set[int]] = [set() for _ in range(n)]
    pool_n = min(pool, n - 1)
    random = np.random.default_rng(7)
    for a in range(0, n, 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        best = np.argpartition(-near, max(pool_n - 1, 0), axis=1)[:, :pool_n] if pool_n else np.empty((len(near), 0), dtype=int)
        for r in range(len(near)):
            cand = best[r][np.argsort(-near[r, best[r]])]
            # some far points among the candidates keep distant parts of the shard connected
            cand = np.concatenate([cand, np.setdiff1d(random.integers(0, n, 6), np.append(cand, a + r))])
            if len(cand):
                kept = robust_prune(np.vstack([x[cand] @ x[cand].T, near[r, cand]]), cand, degree, alpha)
                # the nearest few stay beside the pruned list, so that dense groups are walked through
                for j in {*kept, *cand[: min(6, len(cand))].tolist()}:
                    lists[a + r].add(j)
                    lists[j].add(a + r)
    return [np.fromiter(s, dtype=np.int64, count=len(s)) for s in lists]


def _walk(x: np.ndarray, walk: list[np.ndarray], least: float, beam: int, slack: float) -> np.ndarray:
    """The links that greedy search finds, as a symmetric matrix."""
    hits = np.zeros((len(x), len(x)), dtype=bool)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    for q in range(len(x)):
        v = x[q]
        seen = {medoid}
        s = float(x[medoid] @ v)
        frontier, best, inside = [(-s, medoid)], [s], []
        while frontier:
            s, i = heapq.heappop(frontier)
            # beyond the beam only what lies near the range is expanded
            if len(best) >= beam and -s < best[0] and -s < least - slack:
                break
            if -s >= least:
                inside.append(i)
            new = [j for j in walk[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for j, t in zip(new, (x[new] @ v).tolist(), strict=True):
                    if len(best) < beam or t > best[0] or t >= least - slack:
                        heapq.heappush(frontier, (-t, j))
                        heapq.heappush(best, t)
                        if len(best) > beam:
                            heapq.heappop(best)
        hits[q, inside] = True
    hits |= hits.T
    np.fill_diagonal(hits, False)
    return hits


def _recall(x: np.ndarray, hits: np.ndarray, least: float) -> float:
    """Mean recall of the shard's audited queries that have a link; the larger the shard, the more of them."""
    asked = np.unique(np.random.default_rng(11).integers(0, len(x), max(32, len(x) // 20)))
    true = x[asked] @ x.T >= least
    true[np.arange(len(asked)), asked] = False
    n = true.sum(axis=1)
    return 1.0 if not n.any() else float(((hits[asked] & true).sum(axis=1)[n > 0] / n[n > 0]).mean())


def _links(least: float, recall: float, exact: bool, degree: int, alpha: float, pool: int, beam: int, slack: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        x, ids, weight = _unit(rows["embedding"]), rows["rep"].to_numpy(), rows["n"].to_numpy()
        left = rows["unit"].to_numpy() == rows["u"].to_numpy()
        within = bool((rows["u"] == rows["v"]).all())
        one, two = np.flatnonzero(left), np.arange(len(x)) if within else np.flatnonzero(~left)
        known = None
        if within and not exact and len(x) > 1:
            known = _walk(x, _graph(x, degree, alpha, pool), least, beam, slack)
            if _recall(x, known, least) < recall:
                known = None
        others, partners, root = (np.zeros(len(x), dtype=np.int64) for _ in range(3))
        root += np.arange(len(x))
        for a in range(0, len(one), 512):
            some = one[a : a + 512]
            hits = known[some] if known is not None else x[some] @ x[two].T >= least
            if within:
                hits[np.arange(len(some)), some] = False
            others[some] += hits @ weight[two]
            partners[some] += hits.sum(axis=1)
            if not within:
                others[two] += weight[some] @ hits
                partners[two] += hits.sum(axis=0)
            for r in np.flatnonzero(hits.any(axis=1)).tolist():
                tops = root[two[hits[r]]]
                if (tops != root[some[r]]).any():
                    tops = np.unique(np.append(tops, root[some[r]]))
                    root[np.isin(root, tops)] = tops[0]
        return pd.DataFrame({"rep": ids, "others": others, "partners": partners, "least": ids[root]})[within | (partners > 0)]

    return run


def _points(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, size, h1, h2 (of the vector); usable rows only."""
    e = F.col("embedding")
    usable = (
        F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    )
    return vectors.select("vec_id", "label", "embedding").where(F.coalesce(usable, F.lit(False))).select(
        "vec_id", "label", "embedding", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")
    )


def linked(
    vectors: DataFrame, *, least: float = 0.98, recall: float = 0.95, exact: bool = False, shard: int = 1500, sample: int = 100_000,
    degree: int = 24, alpha: float = 1.2, pool: int = 48, beam: int = 32, slack: float = 0.03,
) -> tuple[DataFrame, DataFrame]:
    """Per point (equal vectors): rep, label, size, others (vectors linked, its own copies not counted), partners (points
    linked); and the links that span the components: a, b.  ``exact`` compares shards in whole."""
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    points = _points(vectors).where("vec_id is not null")
    points = durable(
        points.groupBy("label", "size", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    )
    counts = {(r["label"], r["size"]): r["count"] for r in points.groupBy("label", "size").count().orderBy(F.desc("count")).limit(10_000).collect()}
    taken = points.select("label", "size", "embedding").orderBy("h1").limit(sample).toPandas()
    centroids = {}
    for key, part in taken.groupby(["label", "size"], sort=True):
        k = max(1, min(math.ceil(counts.get(key, 1) / shard), len(part) // 8))
        centroids[key] = _centroids(_unit(part["embedding"]), k)
    schema = f"rep {id_type}, label {label_type}, size int, n long, embedding array<double>"
    home = durable(
        points.select("rep", "label", "size", "n", F.col("embedding").cast("array<double>").alias("embedding"), "h1")
        .mapInPandas(_homes(centroids), f"{schema}, h1 long, cluster long")
    )
    large = home.groupBy("label", "size", "cluster").count().where(F.col("count") > 2 * shard).collect()
    splits = {(r["label"], r["size"], r["cluster"]): math.ceil(r["count"] / shard) for r in large}
    cells = home.mapInPandas(_cells(centroids, splits, least), f"{schema}, u long, v long, unit long")
    found = durable(
        cells.groupBy("label", "size", "u", "v").applyInPandas(
            _links(least, recall, exact, degree, alpha, pool, beam, slack), f"rep {id_type}, others long, partners long, least {id_type}"
        )
    )
    totals = found.groupBy("rep").agg(F.sum("others").alias("others"), F.sum("partners").alias("partners"))
    return (
        durable(home.select("rep", "label", "size").join(totals, "rep")),
        found.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")),
    )


def audit(vectors: DataFrame, found: DataFrame, *, least: float = 0.98, queries: int = 200) -> dict[tuple, float]:
    """Mean recall of the audited points of each label and size, against brute force over different vectors.

    found: rep, label, size, partners.  Asked are ``queries`` points with the smallest hash of rep, as many with the most partners, and
    one of each of the 1000 largest labels; points without a link say nothing."""
    largest = found.groupBy("label", "size").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep")).alias("rep")).orderBy(F.desc("n")).limit(1000)
    asked = F.broadcast(durable(
        found.orderBy(F.xxhash64("rep"), "rep").limit(queries).select("rep")
        .unionByName(found.orderBy(F.desc("partners"), F.xxhash64("rep")).limit(queries).select("rep")).unionByName(largest.select("rep")).distinct()
    ))
    rows = _points(vectors).where("vec_id is not null").groupBy("label", "size", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
    rows = durable(rows.select("rep", "label", "size", "embedding"))
    sent = rows.join(asked, "rep").toPandas()
    if not len(sent):
        return {}
    by = {k: (p["rep"].tolist(), _unit(p["embedding"])) for k, p in sent.groupby(["label", "size"])}

    def count(batches):
        for part in batches:
            for key, own in part.groupby(["label", "size"]):
                if key in by:
                    ids, x = by[key]
                    n = (_unit(own["embedding"]) @ x.T >= least).sum(axis=0)
                    yield pd.DataFrame({"rep": ids, "n": n})

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    true = rows.select("label", "size", "embedding").mapInPandas(count, f"rep {id_type}, n long").groupBy("rep").agg((F.sum("n") - 1).alias("n"))
    share = true.where("n > 0").join(found, "rep").groupBy("label", "size").agg(F.avg(F.least("n", "partners") / F.col("n")).alias("recall"))
    return {(r["label"], r["size"]): r["recall"] for r in share.collect()}


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, recall: float = 0.95, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    points, links = linked(vectors, least=least, recall=recall, **options)
    short = sorted({label for (label, _), r in audit(vectors, points, least=least).items() if r < recall})
    if short:
        again, more = linked(vectors.where(F.col("label").isin(short)), least=least, recall=recall, **{**options, "exact": True})
        points = points.where(~F.col("label").isin(short)).unionByName(again)
        links = links.unionByName(more)
    return _answer(vectors, points.select("rep", "others"), links)


def _answer(vectors: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    named = components(links)
    groups = _points(vectors).where("vec_id is not null").groupBy("label", "size", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    known = (
        groups.join(points, "rep", "left").join(named.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    own = _points(vectors).where("vec_id is not null").select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    usable = _points(vectors).where("vec_id is not null").select(F.col("vec_id").alias("_v")).distinct()
    rest = vectors.select("vec_id").join(usable, F.col("vec_id") == F.col("_v"), "left_anti").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return durable(own.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
