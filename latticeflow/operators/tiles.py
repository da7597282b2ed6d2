"""Lattice operators on tiles: blocks of voxels as arrays, of which only the rims meet other tiles.

A tile holds SIZE voxels along slice, row and col; places without a voxel are known as such.  Filters of one
pass send a voxel to its own tile, and to those whose halo it lies in, so only rims are repeated.  Filters of
many rounds keep tiles in buckets by their key: between two exchanges every tile goes through as many rounds
as its halo is wide, and then only rims are shuffled, the tiles' insides stay where they are.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import denoise, graph

KEY = ["slice", "row", "col"]
TILE = ["ts", "tr", "tc"]
SIZE = (32, 32, 32)
HALO = 8
SIDES = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]
CUBE = list(itertools.product((-1, 0, 1), repeat=3))


def with_halo(voxels: DataFrame, values: list[str], halo: int, size: tuple[int, int, int] = SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ts, tr, tc, slice, row, col and values: each voxel with its own tile, and with every tile whose halo it lies in."""
    if halo > min(size):
        raise ValueError("a halo may not be wider than a tile")
    rows = voxels.select(*by, *KEY, *values)
    for name, axis, n in zip(TILE, KEY, size, strict=True):
        own = F.floor(F.col(axis) / n).cast("int")
        inside = F.pmod(F.col(axis), F.lit(n))
        near = F.array_compact(F.array(own, F.when(inside < halo, own - 1), F.when(inside >= n - halo, own + 1)))
        rows = rows.withColumn(name, F.explode(near))
    return rows.select(*by, *TILE, *KEY, *values)


def dense(pdf: pd.DataFrame, tile: tuple[int, int, int], columns: list[str], halo: int, size: tuple[int, int, int]) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """(there, arrays of the columns, place of each row) of a tile with its halo."""
    shape = tuple(n + 2 * halo for n in size)
    place = tuple(pdf[a].to_numpy() - t * n + halo for a, t, n in zip(KEY, tile, size, strict=True))
    there = np.zeros(shape, dtype=bool)
    there[place] = True
    arrays = []
    for c in columns:
        own = np.stack(pdf[c].to_numpy()) if pdf[c].dtype == object else pdf[c].to_numpy()
        a = np.zeros(shape + own.shape[1:], dtype=own.dtype)
        a[place] = own
        arrays.append(a)
    return there, arrays, place


def stencil(voxels: DataFrame, values: list[str], run: Callable[[np.ndarray, list[np.ndarray]], dict[str, np.ndarray]], spec: str, halo: int = 1, size: tuple[int, int, int] = SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """by, slice, row, col and what run(there, arrays) gives for each voxel of a tile, from the tile and its halo; a volume for each value of `by`."""
    names = [*by, *KEY]

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        there, arrays, place = dense(pdf, key[len(by) :], values, halo, size)
        own = np.logical_and.reduce([(p >= halo) & (p < halo + n) for p, n in zip(place, size, strict=True)])
        at = tuple(p[own] for p in place)
        return pdf.loc[own, names].assign(**{k: a[at] for k, a in run(there, arrays).items()})

    keys = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in names)
    return with_halo(voxels, values, halo, size, by).groupBy(*by, *TILE).applyInPandas(each, f"{keys}, {spec}")


def moved(a: np.ndarray, by: tuple[int, int, int], fill) -> np.ndarray:
    """The value that lies `by` further at every place; fill where nothing does."""
    out = np.full_like(a, fill)
    to = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(by, a.shape, strict=False))
    of = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(by, a.shape, strict=False))
    out[to] = a[of]
    return out


def mean(voxels: DataFrame, value: str, size: tuple[int, int, int] = SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """mean of a voxel and its neighbours among 26 that are there and not null; null where all of them are."""

    def run(there: np.ndarray, arrays: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, known = arrays[0], there & arrays[1]
        x = np.where(known, x, 0.0)
        total = sum(moved(x, d, 0.0) for d in CUBE)
        n = sum(moved(known.astype(np.int64), d, 0) for d in CUBE)
        return {"mean": np.where(n > 0, total / np.maximum(n, 1), np.nan), "known": n > 0}

    rows = voxels.select(*by, *KEY, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"), F.col(value).isNotNull().alias("known"))
    return stencil(rows, ["x", "known"], run, "mean double, known boolean", size=size, by=by).select(*by, *KEY, F.when(F.col("known"), F.col("mean")).alias("mean"))


def selective_mean(voxels: DataFrame, value: str, feature: str, within: float, size: tuple[int, int, int] = SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """mean over the voxel and those of 26 neighbours whose feature differs by at most `within`, and how many were left out."""

    def run(there: np.ndarray, arrays: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, f = arrays
        total, n, dropped = np.zeros(x.shape), np.zeros(x.shape, dtype=np.int64), np.zeros(x.shape, dtype=np.int64)
        for d in CUBE:
            here = moved(there, d, False)
            close = here & (np.abs(moved(f, d, 0.0) - f) <= within)
            total += np.where(close, moved(x, d, 0.0), 0.0)
            n += close
            dropped += here & ~close
        return {"mean": total / np.maximum(n, 1), "dropped": dropped}

    rows = voxels.select(*by, *KEY, F.col(value).cast("double").alias("x"), F.col(feature).cast("double").alias("f")).where("x is not null and f is not null")
    return stencil(rows, ["x", "f"], run, "mean double, dropped bigint", size=size, by=by)


def median(voxels: DataFrame, value: str, size: tuple[int, int, int] = SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """median of a voxel and its neighbours among 26 that are there and not null; an even number averages the middle two."""

    def run(there: np.ndarray, arrays: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, known = arrays[0], there & arrays[1]
        out = np.full(x.shape, np.nan)
        some = np.full(x.shape, False)
        for s in range(x.shape[0]):  # slice by slice, so that 27 copies of a slice are all that stands in memory
            near = slice(max(0, s - 1), s + 2)
            stack = np.stack([moved(np.where(known[near], x[near], np.nan), d, np.nan)[min(s, 1)] for d in CUBE])
            stack.sort(axis=0)  # what is not there comes last
            n = sum(moved(known[near].astype(np.int64), d, 0)[min(s, 1)] for d in CUBE)
            take = lambda k: np.take_along_axis(stack, k[None].clip(0, 26), 0)[0]  # noqa: B023, E731
            out[s], some[s] = np.where(n > 0, (take((n - 1) // 2) + take(n // 2)) / 2, 0.0), n > 0
        return {"median": out, "known": some}

    rows = voxels.select(*by, *KEY, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"), F.col(value).isNotNull().alias("known"))
    return stencil(rows, ["x", "known"], run, "median double, known boolean", size=size, by=by).select(*by, *KEY, F.when(F.col("known"), F.col("median")).alias("median"))


def erode(voxels: DataFrame, flag: str, rounds: int = 1, size: tuple[int, int, int] = SIZE) -> DataFrame:
    """kept: a voxel stays set if it and all of 26 neighbours that are there are set, `rounds` times over; a halo of that width serves all rounds.

    A null flag says nothing: it clears no voxel.
    """

    def run(there: np.ndarray, arrays: list[np.ndarray]) -> dict[str, np.ndarray]:
        kept = arrays[0] | ~there
        for _ in range(rounds):
            kept = np.logical_and.reduce([moved(kept, d, True) for d in CUBE]) | ~there
        return {"kept": kept}

    rows = voxels.select(*KEY, F.coalesce(F.col(flag).cast("boolean"), F.lit(True)).alias("kept"))
    size = tuple(max(n, rounds) for n in size)
    return stencil(rows, ["kept"], run, "kept boolean", halo=rounds, size=size)


def robust_round(z: np.ndarray, img: np.ndarray, there: np.ndarray, lam: float, kind: str, scale: float, data_scale: float | None) -> np.ndarray:
    """One round of membrane smoothing for all voxels at once: z and img are slice x row x col x channel.

    Six neighbours, with a weight of their squared difference over all channels; data_scale: weights on each channel's own residual too.
    """
    m = np.ones_like(img) if data_scale is None else denoise.robust_weight((z - img) ** 2, kind, data_scale)
    num, den = m * img, m
    for a in range(3):
        if z.shape[a] < 2:
            continue
        lo, hi = (tuple(slice(*(s if k == a else (None, None))) for k in range(3)) for s in ((None, -1), (1, None)))
        w = lam * denoise.robust_weight(((z[hi] - z[lo]) ** 2).sum(-1), kind, scale) * (there[lo] & there[hi])
        w = w[..., None]
        num[lo] += w * z[hi]
        num[hi] += w * z[lo]
        den[lo] += w
        den[hi] += w
    return np.where(there[..., None], num / np.maximum(den, 1e-300), 0.0)


class TileStore:
    """Tables of tiles in the session's shared folder, in buckets by tile, so that joins on the tile move nothing."""

    def __init__(self, like: DataFrame):
        self.spark = like.sparkSession
        self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.tables: dict[str, tuple[str, str]] = {}

    def put(self, name: str, tiles: DataFrame) -> DataFrame:
        """Keep tiles under name in place of what was there, which must not be read again."""
        unique = f"tiles_{uuid.uuid4().hex}"
        path = f"{graph.shared_dir(self.spark)}/latticeflow/{unique}"
        tiles.write.bucketBy(self.buckets, *TILE).option("path", path).format("parquet").saveAsTable(unique)
        old, self.tables[name] = self.tables.get(name), (unique, path)
        if old:
            self._drop(*old)
        return self.spark.table(unique)

    def _drop(self, table: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        graph.delete(self.spark, path)

    def clear(self) -> None:
        for table in self.tables.values():
            self._drop(*table)
        self.tables = {}


def robust(voxels: DataFrame, values: list[str], lam: float, kind: str = "geman", scale: float = 2.0, data_scale: float | None = None, rounds: int = 900, tolerance: float = 1e-6, size: tuple[int, int, int] = SIZE, halo: int = HALO) -> DataFrame:
    """slice, row, col and the smoothed values of a volume, or with several values of a vector field.

    Ends when the mean change of a value in the last round is below tolerance, or after `rounds` as the method itself
    does; both are looked at after every `halo` rounds, between which tiles need nothing of each other.  Voxels with a
    null value are not there: they have no row and weigh nothing on their neighbours.
    """
    d, shape = len(values), tuple(n + 2 * halo for n in size)
    core = tuple(slice(halo, halo + n) for n in size)
    rows = voxels.select(*KEY, *[F.col(v).cast("double").alias(f"x{k}") for k, v in enumerate(values)]).dropna()
    names = [f"x{k}" for k in range(d)]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        there, arrays, _ = dense(pdf, key, names, halo, size)
        if not there[core].any():
            return pd.DataFrame(columns=[*TILE, "there", "img"])
        return pd.DataFrame([(*key, np.packbits(there).tobytes(), np.stack(arrays, -1).tobytes())], columns=[*TILE, "there", "img"])

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            img = [np.frombuffer(b).reshape(*shape, d)[core].tobytes() for b in pdf["img"]]
            yield pdf[TILE].assign(z=img, change=0.0, n=0)

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, z in zip(pdf[TILE].itertuples(index=False), pdf["z"], strict=True):
                own = np.frombuffer(z).reshape(*size, d)
                sides = [(*(t + s for t, s in zip(key, side, strict=True)), *side, own[tuple({-1: slice(0, halo), 0: slice(None), 1: slice(n - halo, None)}[s] for s, n in zip(side, size, strict=True))].tobytes()) for side in SIDES]
                yield pd.DataFrame(sides, columns=[*TILE, "s", "r", "c", "rim"])

    def go(steps: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key, bits, img, own, rims in zip(pdf[TILE].itertuples(index=False), pdf["there"], pdf["img"], pdf["z"], pdf["rims"], strict=True):
                    there = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=math.prod(shape)).astype(bool).reshape(shape)
                    img, z = np.frombuffer(img).reshape(*shape, d), np.zeros((*shape, d))
                    z[core] = np.frombuffer(own).reshape(*size, d)
                    for rim in [] if rims is None else rims:
                        side = (rim["s"], rim["r"], rim["c"])  # where this tile lies as seen from the one that gave the rim
                        at = tuple({-1: slice(halo + n, None), 0: slice(halo, halo + n), 1: slice(0, halo)}[s] for s, n in zip(side, size, strict=True))
                        z[at] = np.frombuffer(rim["rim"]).reshape(z[at].shape)
                    for _ in range(steps):
                        last, z = z, robust_round(z, img, there, lam, kind, scale, data_scale)
                    here = there[core]
                    yield pd.DataFrame([(*key, z[core].tobytes(), float(np.abs(z[core] - last[core])[here].sum()), int(here.sum()) * d)], columns=[*TILE, "z", "change", "n"])

        return run

    store, spec = TileStore(voxels), "ts int, tr int, tc int, z binary, change double, n bigint"
    still = store.put("still", with_halo(rows, names, halo, size).groupBy(*TILE).applyInPandas(build, "ts int, tr int, tc int, there binary, img binary"))
    now, done = store.put("now", still.mapInPandas(begin, spec)), 0
    while done < rounds:
        steps = min(halo, rounds - done)
        rims = now.select(*TILE, "z").mapInPandas(give, "ts int, tr int, tc int, s int, r int, c int, rim binary")
        rims = rims.groupBy(*TILE).agg(F.collect_list(F.struct("s", "r", "c", "rim")).alias("rims"))  # 26 at most
        now = store.put("now", still.join(now.select(*TILE, "z"), TILE).join(rims, TILE, "left").mapInPandas(go(steps), spec))
        done += steps
        change = now.agg(F.sum("change"), F.sum("n")).first()
        if not change[1] or change[0] < tolerance * change[1]:
            break

    def voxels_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, bits, z in zip(pdf[TILE].itertuples(index=False), pdf["there"], pdf["z"], strict=True):
                there = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=math.prod(shape)).astype(bool).reshape(shape)[core]
                at, own = np.nonzero(there), np.frombuffer(z).reshape(*size, d)
                yield pd.DataFrame({k: (p + t * n).astype(np.int32) for k, p, t, n in zip(KEY, at, key, size, strict=True)} | {f"x{k}": own[(*at, k)] for k in range(d)})

    spec = ", ".join([*[f"{k} int" for k in KEY], *[f"{x} double" for x in names]])
    out = graph.settle(still.join(now, TILE).select(*TILE, "there", "z").mapInPandas(voxels_of, spec))
    store.clear()
    return out.select(*KEY, *[F.col(f"x{k}").alias(v) for k, v in enumerate(values)])


def labels(voxels: DataFrame, size: tuple[int, int, int] = SIZE, near: int = 26) -> DataFrame:
    """slice, row, col, comp: components of the voxels in the table, by 6 or 26 neighbours; comp is the same for voxels that connect.

    Each tile labels its own voxels, with the rim of one voxel that it shares with the tiles after it; only the
    pairs of labels that meet in rims go through the rounds of graph.components, however long a path is.
    """
    sides = [d for d in SIDES if near == 26 or sum(map(abs, d)) == 1]

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        there, _, place = dense(pdf, key, [], 1, size)
        own = np.logical_and.reduce([(p >= 1) & (p < 1 + n) for p, n in zip(place, size, strict=True)])
        label = np.full(there.shape, -1, dtype=np.int64)
        label[place] = np.arange(len(pdf))
        parent = np.arange(len(pdf))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        inside = np.zeros(there.shape, dtype=bool)
        inside[1:-1, 1:-1, 1:-1] = there[1:-1, 1:-1, 1:-1]
        for d in sides[len(sides) // 2 :]:
            both = inside & moved(inside, d, False)
            for a, b in zip(label[both].tolist(), moved(label, d, -1)[both].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        at = pdf[KEY].to_numpy()
        roots = [root(x) for x in range(len(pdf))]
        name = lambda x: ",".join(map(str, at[x]))
        rows = [(*at[x], name(roots[x]), None) for x in np.flatnonzero(own)]
        for d in sides:  # a label and the voxel beyond the border that it touches
            edge = inside & moved(there & ~inside, d, False)
            met = {(roots[a], b) for a, b in zip(label[edge].tolist(), moved(label, d, -1)[edge].tolist(), strict=True)}
            rows += [(*at[b], None, name(a)) for a, b in met]
        return pd.DataFrame(rows, columns=[*KEY, "own", "other"])

    keys = ", ".join(f"{k} {voxels.schema[k].dataType.simpleString()}" for k in KEY)
    found = graph.settle(with_halo(voxels, [], 1, size).groupBy(*TILE).applyInPandas(each, f"{keys}, own string, other string"))
    place, met = found.where("own is not null").drop("other"), found.where("other is not null").drop("own")
    pairs = place.join(met, KEY).select(F.col("own").alias("src"), F.col("other").alias("dst")).distinct()
    vertices = place.select(F.col("own").alias("id")).distinct()
    comps = graph.components(vertices, pairs)
    return place.join(comps.withColumnsRenamed({"id": "own"}), "own").select(*KEY, "comp")
