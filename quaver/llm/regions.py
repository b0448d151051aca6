"""Search of vectors in regions of the space: every shard of a region has a tree, and k-th scores are shared from round to round."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import materialize, small_batches

#: Centres of regions, at most, and the bytes they may take: all that goes to every task.
CENTRES, CENTRE_BYTES = 1 << 16, 32 << 20
#: Regions that a query may reach after its own one, round by round; the last round takes all that are left.
ROUNDS = (8, None)


class Centres:
    """Centres of one length; the nearest one is looked for among those around the nearest of some of them."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        heads = points[: max(1, int(len(points) ** 0.5))]
        head = _squares(points, heads).argmin(1)
        self.groups = [(heads[h], np.flatnonzero(head == h)) for h in np.unique(head)]
        self.heads = np.array([h for h, _ in self.groups])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A near centre of each row, and the distance to it."""
        group, found = _squares(x, self.heads).argmin(1), np.zeros(len(x), np.int64)
        for g in np.unique(group):
            some = np.flatnonzero(group == g)
            members = self.groups[g][1]
            found[some] = members[_squares(x[some], self.points[members]).argmin(1)]
        return found, np.sqrt(((x - self.points[found]) ** 2).sum(1))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _array(lists: list, kind: type) -> np.ndarray:
    return np.array(lists, kind).reshape(len(lists), -1)


def _placed(centres: dict[int, Centres], points: Callable, kind: type, schema: pa.Schema):
    """The region of each vector and its distance to the centre; -1: no centre has its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vs = np.array(b.column("dim").to_pylist(), int), b.column("v").to_pylist()
            region, away = np.full(len(vs), -1), np.zeros(len(vs))
            for dim in set(dims.tolist()) & set(centres):
                some = np.flatnonzero(dims == dim)
                region[some], away[some] = centres[dim].nearest(points(_array([vs[i] for i in some], kind)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int32()), pa.array(away)], schema=schema)

    return run


def _routed(centres: dict[int, Centres], shards: dict[tuple[int, int], tuple[float, int]], points: Callable, upper: Callable, kind: type, reach: tuple[int, int | None], schema: pa.Schema):
    """Blocks of queries, one row for each shard that some query of a batch can profit from.

    A query's regions are ranked by the score they can have at most; ``reach`` says which ranks this round takes. Those whose bound is
    below the query's k-th score so far are skipped, whatever their rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = {dim: sorted(r for d, r in shards if d == dim) for dim, _ in shards}
        for b in batches:
            to: dict[tuple[int, int, int], list[int]] = {}
            rows = b.to_pylist()
            for i, row in enumerate(rows):
                dim, floor, known = row["dim"], row["floor"], regions.get(row["dim"], [])
                q = points(_array([row["v"]], kind))[0]
                inner = [r for r in known if r >= 0]
                bound = upper(q, centres[dim].points[inner], np.array([shards[dim, r][0] for r in inner])) if inner else np.zeros(0)
                bound = bound + 1e-9 * np.abs(bound) + 1e-6  # rounding never hides a row
                ranked = [(inner[j], bound[j]) for j in np.argsort(-bound, kind="stable").tolist()] + [(r, np.inf) for r in known if r < 0]
                for r, most in ranked[reach[0] : reach[1]]:
                    if floor is None or most >= floor:
                        for split in range(shards[dim, r][1]):
                            if not (r == row["region"] and split == row["home"]):
                                to.setdefault((dim, r, split), []).append(i)
            if to:
                out = {"shard": [f"{d}-{r}-{s}" for d, r, s in to], "is_query": [1] * len(to)}
                for name in ("vec_id", "form", "floor"):
                    out[name + "s"] = [[rows[i][name] for i in some] for some in to.values()]
                out["vs"] = [[x for i in some for x in rows[i]["v"]] for some in to.values()]
                yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in schema}, schema=schema)

    return run


def _searched(tree: Callable, k: int, kind: type, schema: pa.Schema):
    """Whole shards, sorted so that a shard's vectors come before its blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, built = None, [], [], None
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for shard, is_query, vec_ids, forms, floors, vs in zip(*(batch.column(c).to_pylist() for c in ("shard", "is_query", "vec_ids", "forms", "floors", "vs")), strict=True):
                if shard != at:
                    at, ids, rows, built = shard, [], [], None
                if not is_query:
                    ids += vec_ids
                    rows += [vs] * len(vec_ids)
                    continue
                if not ids and built is None:
                    continue  # no vector of that length
                if built is None:
                    built, ids, rows = tree(np.array(ids, np.int64), _array(rows, kind)), [], []
                for own, form, floor, q in zip(vec_ids, forms, floors, _array(vs, kind).reshape(len(vec_ids), -1), strict=True):
                    for score, vec_id in built.search(own, q, k, floor):
                        for name, x in (("query_id", own), ("form", form), ("vec_id", vec_id), ("score", score)):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    e = F.col("embedding")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: fits(x.cast("double"))))


def nearest(clean: DataFrame, is_query: Column, k: int, shard_rows: int, tree: Callable, points: Callable, upper: Callable, kind: type, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query of ``clean`` (vec_id, v), by trees in shards of regions.

    ``tree(ids, rows)`` has ``search(own id, query, k, floor)``: best (score, id) that aren't below the floor, first the highest, then the
    smallest id. ``points(rows)`` gives the points that regions are made of, ``upper(point, centres, radii)`` a bound of any score in them.

    Rows alike in id and vector are counted; of equal vectors only the k + 1 smallest ids are kept as candidates, since no other can be
    among the k best of any query. Both are combined before the shuffle, so no vector fills a shard however often it occurs.
    A bounded sample gives the centres of regions, and every candidate goes to a near one; regions above ``shard_rows`` are split by hash.
    A query visits a shard of its own region first, then the ROUNDS; its k-th score so far excludes regions and branches. Each shard gets one row
    for a whole batch of queries.
    """
    spark = clean.sparkSession
    small_batches(spark)
    arrow, element = (pa.int64(), "long") if kind is np.int64 else (pa.float64(), "double")
    value = pa.int64() if score == "long" else pa.float64()
    form = F.concat_ws("-", F.xxhash64("v"), F.hash("v"))  # tells vectors of one id apart
    counted = materialize(clean.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).withColumns({"dim": F.size("v"), "form": form}))
    first = W.partitionBy("v").orderBy("vec_id")
    candidates = materialize(counted.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy"))
    n, widest = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, min(-(-n // shard_rows), CENTRES, CENTRE_BYTES // (8 * widest)))
    place = F.xxhash64("vec_id", "form")
    some = candidates.where(F.pmod(place, F.lit(1 << 30)) < min(1 << 30, ((4 * most + 64) << 30) // max(n, 1)))  # some four times as many, whatever the size
    by_dim: dict[int, list] = {}
    for r in some.orderBy(place, "vec_id").limit(most).select("dim", "v").collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    centres = {dim: Centres(points(_array(v, kind))) for dim, v in by_dim.items()}

    of_row = [("vec_id", pa.int64()), ("v", pa.list_(arrow)), ("times", pa.int64()), ("dim", pa.int32()), ("form", pa.string()), ("region", pa.int32()), ("away", pa.float64())]
    where = lambda df: df.select(*[c for c, _ in of_row[:-2]]).mapInArrow(_placed(centres, points, kind, pa.schema(of_row)), f"vec_id long, v array<{element}>, times long, dim int, form string, region int, away double")
    placed = materialize(where(candidates))
    # a row for each centre and for each length that has none
    sizes = placed.groupBy("dim", "region").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("splits"))
    shards = {(r["dim"], r["region"]): (r["radius"] * (1 + 1e-9) + 1e-6, r["splits"]) for r in sizes.collect()}
    splits = F.broadcast(spark.createDataFrame([(d, r, s) for (d, r), (_, s) in shards.items()], "dim int, region int, splits int"))

    key = F.concat_ws("-", "dim", "region", "home").alias("shard")
    home = lambda df: df.join(splits, ["dim", "region"], "left").withColumn("home", F.pmod(F.xxhash64("vec_id", "form"), F.coalesce("splits", F.lit(1))))
    floor = F.lit(None).cast(score)
    as_block = lambda df, is_query, ids: df.select(key, F.lit(is_query).alias("is_query"), ids.alias("vec_ids"), F.array("form").alias("forms"), F.array(floor).alias("floors"), F.col("v").alias("vs"))
    rows = as_block(home(placed), 0, F.array_repeat("vec_id", F.least(F.lit(k), "times").cast("int")))
    queries = materialize(home(where(counted.where(is_query))).drop("splits", "away"))
    count = max(1, sum(s for _, s in shards.values()))
    found_schema = pa.schema([("query_id", pa.int64()), ("form", pa.string()), ("vec_id", pa.int64()), ("score", value)])
    order = W.partitionBy("query_id", "form").orderBy(F.desc("score"), F.asc("vec_id"))

    def visit(asked: DataFrame) -> DataFrame:
        needed = rows.join(asked.select("shard").distinct(), "shard", "left_semi") if count > 1 else rows
        dealt = needed.unionByName(asked).repartition(max(count, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "is_query")
        return dealt.mapInArrow(_searched(tree, k, kind, found_schema), f"query_id long, form string, vec_id long, score {score}")

    best = materialize(visit(as_block(queries, 1, F.array("vec_id"))))
    block_schema = pa.schema([("shard", pa.string()), ("is_query", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("forms", pa.list_(pa.string())), ("floors", pa.list_(value)), ("vs", pa.list_(arrow))])
    start = 0
    for step in ROUNDS if count > 1 else ():
        reach = (start, None if step is None else start + step)
        start = reach[1]
        floors = best.groupBy("query_id", "form").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "vec_id")
        asked = queries.join(floors, ["vec_id", "form"], "left").repartition("dim", "region", F.pmod("home", F.lit(64))).sortWithinPartitions("dim", "region")
        blocks = materialize(asked.mapInArrow(_routed(centres, shards, points, upper, kind, reach, block_schema), f"shard string, is_query int, vec_ids array<long>, forms array<string>, floors array<{score}>, vs array<{element}>"))
        both = best.unionByName(visit(blocks))
        best = materialize(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
    ranked = best.withColumn("rank", F.row_number().over(order)).join(queries.select(F.col("vec_id").alias("query_id"), "form", "times"), ["query_id", "form"])
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")  # a repeated query row has its own ranks
