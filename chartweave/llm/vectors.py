"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors of cosine c or more are at most a squared distance of 2 - 2c apart. After a fixed random
rotation the dimensions are dealt into blocks; that budget is dealt to the blocks in proportion to their
dimensions, and at least one block must keep to its own. Each block is range-joined on a grid: a vector
lies in the cell of its leading coordinates and visits those later ones of the neighbouring cells that its range reaches, so that
each two vectors meet once.
The union of the candidates is verified with the cosine of the vectors as they are; a pair counts in the
first block that finds it.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spread_join
from .components import components

#: Dimensions of a block; the last block may have fewer.
BLOCK = 8
#: Vectors of a cell that one task holds against others.
PART = 2048
#: Candidates for a vector in one block that the grid aims at.
AIM = 4096
SLACK = 1e-9


@lru_cache(8)
def rotation(dims: int, seed: int = 20240229) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def budgets(dims: int, least: float) -> list[tuple[int, int, float]]:
    """(from, to, squared distance) of each block."""
    total = max(0.0, 2 - 2 * least) + SLACK
    return [(a, min(a + BLOCK, dims), total * (min(a + BLOCK, dims) - a) / dims) for a in range(0, dims, BLOCK)]


def grid_dims(rows: int) -> int:
    """Leading coordinates of a block that make the grid, more for larger groups of vectors.

    A coordinate of a random unit vector falls into one of about three equally likely cells of twice the range.
    """
    visits = [1, 2, 3.8, 6.9, 12.1, 20.8, 34.9, 57.6, 93.7]
    return next((g for g in range(2, BLOCK) if rows * 0.32**g * visits[g] <= AIM), BLOCK)


def cells(point: np.ndarray, reach2: float, g: int) -> list[tuple[tuple[int, ...], bool]]:
    """The cell of a block's coordinates (True) and the later ones (in order) within range (False); cells are twice the range wide."""
    g = min(g, len(point))
    width = 2 * reach2**0.5
    scaled = point[:g] / width
    own = np.floor(scaled).astype(np.int64)
    inside = scaled - own
    side = np.where(inside < 0.5, -1, 1)
    gap2 = (np.minimum(inside, 1 - inside) * width) ** 2
    out = [(tuple(own.tolist()), True)]
    for k in range(1, g + 1):
        for some in itertools.combinations(range(g), k):
            if gap2[list(some)].sum() <= reach2 + SLACK:
                to = own.copy()
                to[list(some)] += side[list(some)]
                if tuple(to) > tuple(own):
                    out.append((tuple(to.tolist()), False))
    return out


def cell_number(cell: tuple[int, ...]) -> int:
    """A signed 64-bit number for a cell."""
    n = 0
    for x in cell:
        n = (n * 0x9E3779B97F4A7C15 + x + 0x7FFFFFFF) % 2**64
    return n - 2**63


def dealt(classes: DataFrame, least: float, g: int) -> DataFrame:
    """A row for each block and cell in which a vector lies (``own``) or that its range reaches."""
    schema = T.StructType([
        *(classes.schema[c] for c in ("label", "dims", "id", "n", "embedding")),
        T.StructField("block", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("own", T.BooleanType()),
    ])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                of, block, cell, home = [], [], [], []
                for at, v in enumerate(batch.column("embedding")):
                    v = np.array(v.as_py(), np.float64)
                    turned = units(v[None])[0] @ rotation(len(v))
                    for k, (a, b, reach2) in enumerate(budgets(len(v), least)):
                        # cells whose numbers meet only cost time, as long as a vector is in each once
                        found = {cell_number(c): own for c, own in reversed(cells(turned[a:b], reach2, g))}
                        of += [at] * len(found)
                        block += [k] * len(found)
                        cell += found.keys()
                        home += found.values()
                kept = batch.select(schema.names[:5]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(block, pa.int32()), pa.array(cell, pa.int64()), pa.array(home)], names=schema.names)

    return classes.select(*schema.names[:5]).mapInArrow(run, schema)


def in_cell(table: pa.Table, least: float) -> pa.Table:
    """Links within one part of a cell: (``id``, ``other``, ``add``). ``add``: linked vectors; ``other``: a linked id that joins components, or null.

    Rows that are ``home`` are held against those that are ``mover``; ``own``: the vector lies in this cell.
    """
    ids = np.array(table.column("id").to_pylist())
    n = table.column("n").to_numpy()
    home, mover, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "mover", "own"))
    raw = np.array(table.column("embedding").to_pylist(), np.float64)
    block = table.column("block")[0].as_py()
    unit = units(raw)
    turned = unit @ rotation(raw.shape[1])
    blocks = budgets(raw.shape[1], least)
    a, b, reach2 = blocks[block]
    part = turned[:, a:b]
    square = (part * part).sum(axis=1)
    homes, guests = np.flatnonzero(home), np.flatnonzero(mover)
    add = np.zeros(len(ids), np.int64)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    joined = []
    for g0 in range(0, len(guests), 512):
        gs = guests[g0 : g0 + 512]
        for h0 in range(0, len(homes), 512):
            hs = homes[h0 : h0 + 512]
            near = square[gs][:, None] + square[hs][None, :] - 2 * part[gs] @ part[hs].T <= reach2 + SLACK
            # two of one cell meet as the smaller id's mover
            i, j = np.nonzero(near & (~own[gs][:, None] | (ids[gs][:, None] < ids[hs][None, :])))
            i, j = gs[i], hs[j]
            for p, q, r2 in blocks[:block]:  # found in an earlier block, so counted there
                if len(i):
                    late = ((turned[i, p:q] - turned[j, p:q]) ** 2).sum(axis=1) > r2 + SLACK
                    i, j = i[late], j[late]
            if len(i):
                sure = (unit[i] * unit[j]).sum(axis=1) >= least
                i, j = i[sure], j[sure]
            np.add.at(add, i, n[j])
            np.add.at(add, j, n[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[rx] = ry
                    joined.append((x, y))
    linked = np.flatnonzero(add)
    x, y = (np.array([p[k] for p in joined], np.int64) for k in (0, 1))
    kind = table.schema.field("id").type
    return pa.table({
        "id": pa.array(np.concatenate([ids[linked], ids[x]]) if len(linked) else [], kind),
        "other": pa.array([None] * len(linked) + (ids[y].tolist() if len(y) else []), kind),
        "add": pa.array(np.concatenate([add[linked], np.zeros(len(x), np.int64)]), pa.int64()),
    })


def linked_vectors(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row per row of ``df``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label are linked if their cosine, in double precision, is ``least`` or more. Null labels,
    null ids, and vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of
    different lengths do not link with each other. Rows with equal label and vector are compared once; each of them is linked with the others.
    An empty table gives an empty one.
    """
    spark = df.sparkSession
    e = F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), e.alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(good & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    rows = rows.withColumns({"good": good, "h": F.xxhash64("label", "embedding"), "i": F.xxhash64(F.lit(7), "embedding", "label"), "embedding": F.col("embedding").cast("array<float>") if df.schema[embedding].dataType == T.ArrayType(T.FloatType()) else F.col("embedding")})
    # a class of equal vectors is told by its hashes, as ids may stand in several labels
    own = F.concat(F.hex("h"), F.hex("i")).alias("id")
    same = rows.where("good").groupBy("label", "h", "i").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = cut(same.select("label", "h", "i", own, "first", "n", "embedding", F.size("embedding").alias("dims")))
    largest = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    out = dealt(classes, least, grid_dims(largest))

    key = ["label", "dims", "block", "cell"]
    # cells in which two vectors meet, one of them at home, and how many parts they are dealt into
    sizes = out.groupBy(*key).agg(F.count(F.lit(1)).alias("all"), F.count_if("own").alias("homes")).where((F.col("all") > 1) & (F.col("homes") > 0))
    sizes = sizes.select(*key, F.ceil(F.col("all") / PART).cast("int").alias("xs"), F.ceil(F.col("homes") / PART).cast("int").alias("ys"))
    sizes = cut(sizes)
    out = out.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, key)
    # every part x of the movers meets every part y of those at home once
    x, y = F.pmod(F.hash("id"), F.col("xs")), F.pmod(F.xxhash64("id"), F.col("ys")).cast("int")
    place = lambda a, b, home, mover: F.struct(a.alias("x"), b.alias("y"), F.lit(home).alias("home"), mover.alias("mover"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda k: place(k, y, True, k == x))
    moving = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda k: place(x, k, False, F.lit(True)))
    places = F.when(F.col("own"), F.concat(at_home, F.filter(moving, lambda p: p["y"] != y))).otherwise(moving)
    met = out.withColumn("place", F.explode(places)).select(*key, "place.*", "id", "n", "embedding", "own")

    schema = T.StructType([T.StructField("id", classes.schema["id"].dataType), T.StructField("other", classes.schema["id"].dataType), T.StructField("add", T.LongType())])
    found = cut(met.groupBy(*key, "x", "y").applyInArrow(lambda t: in_cell(t, least), schema))
    counts = found.groupBy("id").agg(F.sum("add").alias("links"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.select("label", "h", "i", "id", "first", "n").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    known = cut(known.withColumn("component", F.coalesce("component", "id")))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = spread_join(known, smallest, "component", "id").select("label", "h", "i", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # hashes of equal vectors are equal, and a common vector is dealt to several tasks
    one = F.struct("label", "h", "i").alias("same")
    done = spread_join(rows.where("good").select("id", one), known.select(one, "n_links", "component_id"), "same", "id").select("id", "n_links", "component_id")
    rest = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    done = done.unionByName(rest)
    return done.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with one label."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
