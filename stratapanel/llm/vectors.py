"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept vector a group.

Equal vectors are one row with a number of copies. Centroids are fitted on a bounded sample; every vector goes to
its nearest cell and, as a guest, to earlier cells whose boundary is so close that a linked vector may lie behind it,
so every pair at the threshold meets in the earlier cell. Cells that stay large are split again in the same way, with
centroids fitted on a bounded sample of each, so cells don't grow with the table. The number of cells is the one with
the least work on the sample: vectors that cells can't part are compared in few cells. A cell's vectors are dealt to
blocks of bounded size, and a task compares two blocks: a cell that holds a third of all rows gives more tasks, not
larger ones. A task looks at tiles of two blocks one after the other: half of the components and the length of the rest
bound a cosine from above in single precision, and only rows that the bound leaves are multiplied in double precision.
It returns link counts and a spanning forest of its links, and holds neither all pairs nor a matrix of two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from stratapanel.llm.common import collected, materialised
from stratapanel.llm.components import components

THRESHOLD = 0.95
#: Vectors that centroids are fitted on at most; vectors of a cell on average; cells of the first level at most (bounds the broadcast).
FIT_ROWS, CELL_ROWS, MOST_CELLS = 20_000, 4096, 2048
#: Levels of cells; a cell of so many times ``CELL_ROWS`` vectors is split again, into so many parts at most, fitted on so many vectors.
LEVELS, SPLIT_AT, PARTS, PART_FIT_ROWS = 4, 4, 256, 4000
#: Rows of a level's cells, guests among them, for each vector at most.
MOST_PLACED = 3
#: Vectors of a block on average, and its components where that gives fewer vectors (but 1,024 at least).
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 20
#: Blocks from which on they grow instead of their number, as every block is sent to every other: up to twice ``BLOCK_VALUES`` components.
FEW_BLOCKS = 12
#: Vectors of the sample that the work of a number of cells is estimated on; rows and columns of a product at once; links of a task that are kept before they are joined.
WORK_ROWS, PRODUCT_ROWS, PRODUCT_COLUMNS, KEPT_LINKS = 4000, 512, 4096, 1 << 20
#: Partitions of blocks' pairs at most.
MOST_TASKS = 1024


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids (k or fewer rows) of unit vectors, by cosine."""
    random = np.random.default_rng(seed)
    centres = vectors[random.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        cell = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return np.unique(centres, axis=0)


def cells_of(unit: np.ndarray, centres: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, nearest cell) of each vector's nearest cell and of the earlier ones whose boundary is close.

    A vector whose elevation over the plane between two centres is above the angle of the threshold has no linked
    vector behind that plane, and only then it stays away from the other cell.
    """
    near = unit @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0))
    margin = math.sqrt(max(1 - threshold * threshold, 0))
    close = (near[np.arange(len(unit)), home][:, None] - near) <= margin * apart + 1e-7
    close &= np.arange(len(centres))[None, :] <= home[:, None]
    row, cell = np.nonzero(close)
    return row, cell, home[row]


def fitted_cells(sample: np.ndarray, n: int, threshold: float = THRESHOLD, block: int = BLOCK_ROWS, most: int = MOST_CELLS) -> np.ndarray:
    """Centroids for ``n`` vectors; of several numbers of cells the one with the least estimated work.

    Guests are rows on the disks, at every level anew: cells that hold more than ``MOST_PLACED`` rows a vector, or save less
    than half of the work of one cell, are none.
    """
    k, best = max(1, min(most, len(sample), math.ceil(n / CELL_ROWS))), None
    alone = n + n * n / 2 / block
    while True:
        centres = spherical_kmeans(sample, k)
        homes, guests = np.zeros(len(centres)), np.zeros(len(centres))
        some = sample[:WORK_ROWS]
        for start in range(0, len(some), PRODUCT_ROWS):
            _, cell, home = cells_of(some[start : start + PRODUCT_ROWS], centres, threshold)
            homes += np.bincount(cell[cell == home], minlength=len(centres))
            guests += np.bincount(cell[cell != home], minlength=len(centres))
        homes, guests = homes * n / len(some), guests * n / len(some)
        placed = (homes + guests).sum()
        work = placed + (homes * (homes / 2 + guests)).sum() / block
        if k == 1 or (placed <= MOST_PLACED * n and work <= alone / 2):
            best = min(best or (work, centres), (work, centres), key=lambda x: x[0])
        if k == 1:
            return best[1]
        k = max(1, k // 4)


def forest(linked: np.ndarray, own: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the smallest row it is connected with, given the links of the rows ``own`` with ``other``."""
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        for start in range(0, len(own), PRODUCT_ROWS):
            some, rows = linked[start : start + PRODUCT_ROWS], own[start : start + PRODUCT_ROWS]
            new[rows] = np.minimum(new[rows], np.where(some, label[other][None, :], np.int32(n)).min(1, initial=n))
            new[other] = np.minimum(new[other], np.where(some, label[rows][:, None], np.int32(n)).min(0, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(vectors: pd.Series) -> np.ndarray:
    unit = np.array(vectors.tolist(), dtype=np.float64)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def block_size(n: int, dim: int) -> tuple[int, int]:
    """(vectors of a block by which work is estimated, vectors of a block that ``n`` vectors are dealt to)."""
    least = min(BLOCK_ROWS, max(1024, BLOCK_VALUES // dim))
    return least, max(least, min(n // FEW_BLOCKS, 2 * BLOCK_VALUES // dim))


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the smallest row it is connected with, given links ``a`` - ``b``."""
    label = np.arange(n)
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bounds(unit: np.ndarray) -> np.ndarray:
    """Rows whose products are no less than the cosines but for rounding: half of the components, and the length of the rest."""
    half = unit.shape[1] // 2
    return np.concatenate([unit[:, :half], np.linalg.norm(unit[:, half:], axis=1, keepdims=True)], axis=1).astype(np.float32)


def _compared(threshold: float):
    """Of two blocks of a cell, or one with itself: link counts and spanning links. A pair counts unless both are guests of one level."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        ids, copies, side = (group[name].to_numpy()[order] for name in ("id", "copies", "side"))
        unit = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order].astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        bounds, loose = _bounds(unit), np.float32(threshold - (unit.shape[1] + 8) * 2.0**-22)
        copies, n = copies.astype(np.float64), np.zeros(len(ids))
        own, other = (np.nonzero((side & k) > 0)[0] for k in (1, 2))
        same = len(own) == len(unit) == len(other)
        links, kept = [np.zeros((2, 0), np.int64)], 0
        for start in range(0, len(own), PRODUCT_ROWS):
            for first in range(start if same else 0, len(other), PRODUCT_COLUMNS):
                rows, columns = own[start : start + PRODUCT_ROWS], other[first : first + PRODUCT_COLUMNS]
                rows = rows[(bounds[rows] @ bounds[columns].T >= loose).any(1)]
                if not len(rows):
                    continue
                some = unit[rows] @ unit[columns].T >= threshold
                if same:
                    some &= columns[None, :] > rows[:, None]
                n[rows] += some @ copies[columns]
                n[columns] += copies[rows] @ some
                some, rows, columns = some[:, seen := some.any(0)][met := some.any(1)], rows[met], columns[seen]
                label = forest(some, np.arange(len(rows)), len(rows) + np.arange(len(columns)), len(rows) + len(columns))
                ends = np.concatenate([rows, columns])
                links.append(np.stack([ends, ends[label]]))
                kept += len(ends)
                if kept > KEPT_LINKS:
                    links, kept = [np.stack([np.arange(len(ids)), joined(*np.concatenate(links, axis=1), len(ids))])], 0
        found = n > 0
        root = joined(*np.concatenate(links, axis=1), len(ids))
        return pa.table({"id": ids[found], "n": n[found].astype(np.int64), "root": ids[root[found]]})

    return run


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Vectors are compared with those of the same length only. Equal vectors link with one another. Rows
    with one id and several vectors count as several vectors; the component is the smallest id reachable. Other
    columns are ignored; an empty table gives an empty result. ``threshold`` must be positive. A row without an id
    counts as a partner and is kept only if no row with an id is in its group.
    """
    spark = table.sparkSession
    held = table.schema[vector_col].dataType
    kind = "array<float>" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "array<double>"  # what is stored in single precision travels so
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(usable, F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(9), "vector"), F.size("vector").alias("dim"))))
    rows = rows.withColumn("key", F.when(F.col("key").isNotNull(), F.to_json("key")))
    vectors = materialised(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))
    vectors = vectors.withColumn("id", F.monotonically_increasing_id())  # of a written table: fixed
    answers = None
    for dim, n in sorted((r[0], r[1]) for r in vectors.groupBy(F.size("vector")).count().collect()):
        part = vectors.where(F.size("vector") == dim)
        sample = collected(part.select(F.xxhash64("id").alias("h"), "vector").orderBy("h").limit(FIT_ROWS))
        least, block = block_size(n, dim)
        centres = fitted_cells(_units(sample["vector"]), n, threshold, least)
        found = _links(_placed(part, centres, threshold, least), len(centres), n, threshold, block)
        answers = found if answers is None else answers.union(found)
    if answers is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    # a vector gets a row a compared block, so roots are as many at most; only what is summed up goes to few files
    answers = materialised(answers.groupBy("id").agg(F.sum("n").alias("n"), F.collect_set("root").alias("roots")), narrow=True)
    named = components(answers.select(F.col("id").alias("a"), F.explode("roots").alias("b")))
    counts = answers.select("id", "n")
    by_key = vectors.drop("vector").join(counts, "id", "left").join(named.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_key = materialised(by_key, narrow=True)
    first = by_key.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_key = by_key.join(first, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        rows.select("id", "key").join(by_key, "key", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
    )


def _schema(rows: DataFrame) -> str:
    """Of rows assigned to cells; vectors stay as they are held."""
    return f"id long, copies long, vector {rows.schema['vector'].dataType.simpleString()}, cell string, guest int, home int, cells array<int>"


def _assigned(rows: pd.DataFrame, centres: np.ndarray, threshold: float):
    """Pieces of the rows with the cell of this level they are nearest to (``home``) and all they go to (``cells``): a vector stands once, however many cells it is a guest of."""
    for start in range(0, len(rows), PRODUCT_ROWS):
        some = rows.iloc[start : start + PRODUCT_ROWS]
        row, cell, home = cells_of(_units(some["vector"]), centres, threshold)
        ends = np.searchsorted(row, np.arange(1, len(some)))
        yield some.assign(home=home[np.concatenate([[0], ends])].astype(np.int32), cells=pd.Series(np.split(cell.astype(np.int32), ends), index=some.index))


def _dealt(assigned: DataFrame, level: int) -> DataFrame:
    """A row for each cell of an assigned vector; bit ``level`` of ``guest`` is set outside the nearest one."""
    rows = assigned.select("id", "copies", "vector", "cell", "guest", "home", F.explode("cells").alias("to"))
    guest = F.col("guest").bitwiseOR(F.when(F.col("to") != F.col("home"), 1 << level).otherwise(0))
    return rows.select("id", "copies", "vector", F.concat("cell", F.lit("."), F.col("to").cast("string")).alias("cell"), guest.alias("guest"))


def _split(threshold: float, block: int):
    """The centroids of a large cell from its sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = fitted_cells(_units(rows["vector"]), int(rows["count"].iloc[0]), threshold, block, PARTS)
        return pd.DataFrame({"cell": rows["cell"].iloc[0], "centres": [cuts.tolist()]})

    return run


def _again(threshold: float, schema: list[str]):
    """A chunk of a large cell by its parts."""

    def run(rows: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        pieces = list(_assigned(rows, np.array([list(x) for x in cuts["centres"].iloc[0]]), threshold)) if len(rows) else []
        return pd.concat(pieces)[schema] if pieces else pd.DataFrame(columns=schema)

    return run


def _placed(part: DataFrame, centres: np.ndarray, threshold: float, block: int) -> DataFrame:
    """(id, copies, vector, cell, guest): every vector in each cell it belongs to, large cells split level by level."""
    if len(centres) == 1:
        return part.select("id", "copies", "vector", F.lit("").alias("cell"), F.lit(0).alias("guest"))
    shared, schema = part.sparkSession.sparkContext.broadcast(centres), _schema(part)

    def first(batches):
        for batch in batches:
            yield from _assigned(batch.assign(cell="", guest=np.int32(0)), shared.value, threshold)

    placed = materialised(_dealt(part.select("id", "copies", "vector").mapInPandas(first, schema), 0))
    for level in range(1, LEVELS):
        large = placed.groupBy("cell").count().where(F.col("count") >= SPLIT_AT * CELL_ROWS)
        if not large.limit(1).count():
            break
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
        some = placed.join(large, "cell").where(F.pmod(F.xxhash64(F.lit(3), "id"), F.floor(F.col("count") / (2 * PART_FIT_ROWS)) + 1) == 0)  # so no task sorts a whole cell
        sample = some.select("cell", "count", "vector", place.alias("place")).where(F.col("place") <= PART_FIT_ROWS)
        cuts = materialised(sample.drop("place").groupBy("cell").applyInPandas(_split(threshold, block), "cell string, centres array<array<double>>").where(F.size("centres") > 1))
        if not cuts.limit(1).count():
            break
        chunks = cuts.join(large, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("count") / CELL_ROWS))).alias("chunk"))
        dealt = placed.join(large, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.floor(F.col("count") / CELL_ROWS) + 1)).drop("count").join(cuts.select("cell"), "cell", "left_semi")
        finer = dealt.groupBy("cell", "chunk").cogroup(chunks.groupBy("cell", "chunk")).applyInPandas(_again(threshold, [x.split()[0] for x in schema.split(", ")]), schema)
        placed = materialised(placed.join(cuts.select("cell"), "cell", "left_anti").select("id", "copies", "vector", "cell", "guest").union(_dealt(finer, level)))
    return placed


def _links(placed: DataFrame, cells: int, n: int, threshold: float, block_rows: int) -> DataFrame:
    """(id, n, root): link counts and spanning links of each compared pair of blocks, of ``n`` vectors in cells.

    A block holds rows of a cell that are guests of the same levels. Two blocks meet unless their rows are guests of
    one level together: such pairs meet in the cell where one of them is at home.
    """
    sizes = placed.groupBy("cell", "guest").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    layout = sizes.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("guest", "blocks"))).alias("layout"))
    layout = layout.withColumn("masks", F.flatten(F.transform("layout", lambda x: F.array_repeat(x["guest"], x["blocks"].cast("int")))))
    rows = placed.join(layout, "cell")
    mine = F.filter("layout", lambda x: x["guest"] == F.col("guest"))[0]["blocks"]
    start = F.array_position("masks", F.col("guest")) - 1
    rows = rows.withColumn("block", start + F.pmod(F.xxhash64("id"), mine))
    partners = F.filter(F.transform("masks", lambda m, j: F.struct(m.alias("m"), j.cast("long").alias("j"))), lambda x: x["m"].bitwiseAND(F.col("guest")) == 0)
    tasks = rows.select("id", "copies", "vector", "cell", "block", F.explode(partners).alias("p")).withColumn("i", F.least("block", "p.j")).withColumn("j", F.greatest("block", "p.j"))
    side = (F.col("block") == F.col("i")).cast("int") + 2 * (F.col("block") == F.col("j")).cast("int")
    blocks = math.ceil(n / block_rows)
    pairs = min(MOST_TASKS, max(1 if cells == 1 else int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2))
    return tasks.select("id", "copies", "vector", "cell", "i", "j", side.alias("side")).repartition(pairs, "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(_compared(threshold), "id long, n long, root long")
