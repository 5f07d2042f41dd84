"""Rides between cities: same city, half an hour, near destinations or overlapping routes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_km


def overlap(pairs: DataFrame, routes: DataFrame, close_km: float = 20.0, share: float = 0.8) -> DataFrame:
    """Adds overlap (share of the shorter route's points within `close_km` of the longer) and overlaps to pairs (a, b). The first route is the shorter in a tie; without points there is none."""
    r = routes.select("user_id", "pts")
    both = pairs.join(r.select(F.col("user_id").alias("a"), F.col("pts").alias("pa")), "a").join(r.select(F.col("user_id").alias("b"), F.col("pts").alias("pb")), "b")
    first = F.size("pa") <= F.size("pb")
    short, long = F.when(first, F.col("pa")).otherwise(F.col("pb")), F.when(first, F.col("pb")).otherwise(F.col("pa"))
    near = F.filter(short, lambda p: F.exists(long, lambda q: haversine_km(p.lat, p.lng, q.lat, q.lng) <= close_km))
    part = F.when((F.size(short) > 0) & (F.size(long) > 0), F.size(near) / F.size(short)).otherwise(0.0)
    return both.select(*pairs.columns, part.alias("overlap"), (part >= share).alias("overlaps"))


#: Riders of one city and slot that are compared with each other at a time, about; pairs that are looked at at once.
BLOCK, PAIRS = 2_000, 1 << 18
KM_A_DEGREE = np.pi / 180 * 6371.0


def _km(lat: np.ndarray, lng: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """`haversine_km` in arrays."""
    half = lambda a, b: np.sin(np.radians(b - a) / 2) ** 2
    a = half(lat, lat2) + np.cos(np.radians(lat)) * np.cos(np.radians(lat2)) * half(lng, lng2)
    return 12742.0 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


class Routes:
    """Points of routes, a row a route, filled up with nan; n is their number."""

    def __init__(self, lat: list, lng: list):
        self.n = np.array([len(x) if x is not None else 0 for x in lat], np.int64)
        self.lat, self.lng = np.full((2, len(lat), max(1, int(self.n.max(initial=0)))), np.nan)
        for out, lists in ((self.lat, lat), (self.lng, lng)):
            for row, x in zip(out, lists, strict=True):
                if x is not None:
                    row[: len(x)] = x

    def overlapping(self, a: np.ndarray, b: np.ndarray, close_km: float, share: float) -> np.ndarray:
        """Of pairs of rows those that `overlap` calls so. A point whose latitude alone is too far off is not near."""
        out = np.zeros(len(a), bool)
        first = self.n[a] <= self.n[b]
        short, long = np.where(first, a, b), np.where(first, b, a)
        at = np.flatnonzero(self.n[short] > 0)
        close = close_km / KM_A_DEGREE * (1 + 1e-9)
        lo, hi = self._ends
        step = max(1, (PAIRS << 2) // self.lat.shape[1] ** 2)
        for k in range(0, len(at), 16 * step):
            i = at[k : k + 16 * step]
            s, t = short[i], long[i]
            inside = (self.lat[s] >= (lo[t] - close)[:, None]) & (self.lat[s] <= (hi[t] + close)[:, None])
            i = i[inside.sum(1) / self.n[s] >= share]
            for j in range(0, len(i), step):
                part = i[j : j + step]
                s, t = short[part], long[part]
                near = np.abs(self.lat[s][:, :, None] - self.lat[t][:, None, :]) <= close
                may = near.any(2).sum(1) / self.n[s] >= share
                part, s, t = part[may], s[may], t[may]
                row, x, y = np.nonzero(near[may])
                good = _km(self.lat[s[row], x], self.lng[s[row], x], self.lat[t[row], y], self.lng[t[row], y]) <= close_km
                hit = np.zeros((len(part), self.lat.shape[1]), bool)
                hit[row[good], x[good]] = True
                out[part] = hit.sum(1) / self.n[s] >= share
        return out

    @functools.cached_property
    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        empty = np.isnan(self.lat)
        return np.where(empty, np.inf, self.lat).min(1), np.where(empty, -np.inf, self.lat).max(1)


def matching_pairs(requests: DataFrame, routes: DataFrame, minutes: float = 30, near_km: float = 30.0, seats: int = 3, close_km: float = 20.0, share: float = 0.8) -> DataFrame:
    """(a, b, minutes_apart, dest_km), a before b, who may ride together: null cities are one city, times at most `minutes` apart.

    Rows are dealt by city and slot of `minutes`, large ones in blocks of about BLOCK, and meet in arrays those of their own
    slot and the next; routes (one a rider at most; without one nothing overlaps) come along, and no pair is a row before it is one of the result.
    """
    slot = F.floor(F.unix_timestamp("stored_at") / (minutes * 60)).cast("long")
    lat, lng = (F.expr(f"transform(pts, p -> double(p.{c}))").alias(f"r_{c}") for c in ("lat", "lng"))
    cols = [F.col("user_id").cast("long").alias("user_id"), F.col("origin_city"), F.unix_timestamp("stored_at").alias("at"), F.col("destination_lat").cast("double").alias("lat"), F.col("destination_lng").cast("double").alias("lng"), F.col("passengers").cast("int").alias("passengers")]
    one = requests.where("stored_at IS NOT NULL AND user_id IS NOT NULL AND passengers IS NOT NULL").select(*cols, slot.alias("slot"))
    sizes = one.groupBy("origin_city", "slot").agg(F.count("*").alias("n")).groupBy(F.col("origin_city").alias("_city")).agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("blocks"))
    one = one.join(sizes, F.col("origin_city").eqNullSafe(F.col("_city"))).drop("_city").withColumn("own", F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int"))
    # Spark takes an array for one element, so it may think all routes small enough to be broadcast
    one = one.join(routes.select("user_id", lat, lng).dropDuplicates(["user_id"]).hint("merge"), "user_id", "left")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = one.withColumns({"i": F.col("own"), "j": every, "kind": F.lit(0)})
    later = one.withColumns({"i": every, "j": F.col("own"), "kind": F.lit(2), "slot": F.col("slot") - 1})
    same = one.where("blocks > 1").withColumns({"i": every, "j": F.col("own"), "kind": F.lit(1)}).where("i < j")

    def compare(data: pa.Table) -> pa.Table:
        ids, at, seats_of = (data.column(c).to_numpy() for c in ("user_id", "at", "passengers"))
        lat, lng = (data.column(c).to_numpy().astype(float) for c in ("lat", "lng"))
        kind, diagonal = data.column("kind").to_numpy(), data.column("i")[0] == data.column("j")[0]
        here, there = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
        there = np.concatenate([here, there]) if diagonal else there
        own, out, ways = np.arange(len(here)), [], None
        for k in range(0, len(here), step := max(1, PAIRS // max(1, len(there)))):
            w = here[k : k + step]
            met = (np.abs(at[w, None] - at[there]) / 60 <= minutes) & (seats_of[w, None] + seats_of[there] <= seats) & (ids[w, None] != ids[there])
            if diagonal:  # among those here each pair once
                met[:, : len(here)] &= own < own[k : k + step, None]
            r, c = np.nonzero(met)
            a, b = w[r], there[c]
            swap = ids[a] > ids[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            km = _km(lat[a], lng[a], lat[b], lng[b])
            good = km <= near_km
            far = np.flatnonzero(km > near_km)
            if len(far):
                ways = ways or Routes(*(data.column(x).to_pylist() for x in ("r_lat", "r_lng")))
                good[far] = ways.overlapping(a[far], b[far], close_km, share)
            out.append((ids[a[good]], ids[b[good]], np.abs(at[a[good]] - at[b[good]]) / 60, km[good]))
        a, b, apart, km = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.table({"a": a, "b": b, "minutes_apart": apart, "dest_km": km})

    return left.unionByName(same).unionByName(later).groupBy("origin_city", "slot", "i", "j").applyInArrow(compare, "a long, b long, minutes_apart double, dest_km double")
