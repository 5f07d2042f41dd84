"""Order-dependent grouping: pure folds over arrivals, and their application to the connected parts of the candidate graph.

Two riders can only influence each other through candidates, so the parts of the candidate graph are independent and each is
folded by itself in order of arrival. A part's fold is sequential by definition; what it reads are candidate rows, never the
network.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.bucketing import most_total
from wayfold.operators.network import checkpointed


def parts(edges: DataFrame) -> DataFrame:
    """(id, part) of the ids in edges (a, b): part is the least id that edges lead to. Minimum labels with pointer jumping."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("part")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("part").alias("p")), "b").groupBy("a").agg(F.min("p").alias("p"))
        step = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("part", F.coalesce("p", "part")).alias("part"))
        jump = step.join(label.select(F.col("id").alias("part"), F.col("part").alias("q")), "part", "left").select("id", F.least("part", F.coalesce("q", "part")).alias("part"))
        new = checkpointed(jump)
        if not new.join(label.withColumnRenamed("part", "old"), "id").where("part <> old").limit(1).count():
            return new
        label = new


class MeetingPoints:
    """The fold of arrivals and removals by meeting points. Buckets: side -> node -> candidate -> (members, distance)."""

    def __init__(self, threshold: float = 0.5):
        self.limit = most_total(threshold)
        self.near: dict[int, dict[str, dict[int, float]]] = {}
        self.group_of: dict[int, int] = {}
        self.groups: dict[int, dict] = {}
        self.buckets: dict[str, dict[int, dict[tuple, tuple[list[int], float]]]] = {"orig": {}, "dest": {}}
        self.next = 0

    def _index(self, key: tuple, members: list[int], near: dict[str, dict[int, float]]) -> None:
        for side, nodes in near.items():
            for node, dist in nodes.items():
                self.buckets[side].setdefault(node, {})[key] = (members, dist)

    def _forget(self, key: tuple, near: dict[str, dict[int, float]]) -> None:
        for side, nodes in near.items():
            for node in nodes:
                self.buckets[side].get(node, {}).pop(key, None)

    def add(self, user: int, near: dict[str, dict[int, float]]) -> int | None:
        """The user's group, or None. A known user keeps what it has."""
        if user in self.near:
            return self.group_of.get(user)
        self.near[user] = near
        best = None
        found: dict[tuple, dict[str, list[tuple[float, int, float]]]] = {}
        who: dict[tuple, list[int]] = {}
        for side in ("orig", "dest"):
            for node, dist in near[side].items():
                for key, (members, other) in self.buckets[side].get(node, {}).items():
                    who[key] = members
                    score = math.sqrt(dist**2 + other**2) / (len(members) + 1)
                    found.setdefault(key, {"orig": [], "dest": []})[side].append((score, node, other))
        for key, sides in found.items():
            if sides["orig"] and sides["dest"]:
                o, d = min(sides["orig"]), min(sides["dest"])
                if o[0] + d[0] <= self.limit and (best is None or (o[0] + d[0], min(who[key])) < best[:2]):
                    best = (o[0] + d[0], min(who[key]), key, o[1], d[1])
        if best is None:
            self._index(("user", user), [user], near)
            return None
        key, members = best[2], who[best[2]]
        if len(members) == 2:
            g = self.group_of[members[0]]
            group = self.groups[g]
            group["users"].append(user)
            self._forget(("group", g), group["near"])
            group["near"] = {"orig": {}, "dest": {}}
        else:
            g, self.next = self.next, self.next + 1
            mate = members[0]
            self._forget(("user", mate), self.near[mate])
            shared = {s: {n: math.sqrt(near[s][n] ** 2 + other**2) for _, n, other in found[key][s]} for s in ("orig", "dest")}
            group = self.groups[g] = {"users": [mate, user], "near": shared}
            self._index(("group", g), [mate, user], shared)
            self.group_of[mate] = g
        group["meet"] = (best[3], best[4])
        self.group_of[user] = g
        return g

    def remove(self, user: int) -> None:
        """Two left: the group is indexed anew at half the joint distance. One left: it is single again."""
        near = self.near.pop(user, None)
        if near is None:
            return
        g = self.group_of.pop(user, None)
        if g is None:
            self._forget(("user", user), near)
            return
        group = self.groups[g]
        group["users"].remove(user)
        self._forget(("group", g), group["near"])
        if len(group["users"]) == 1:
            last = group["users"][0]
            del self.groups[g], self.group_of[last]
            self._index(("user", last), [last], self.near[last])
            return
        a, b = (self.near[u] for u in group["users"])
        group["near"] = {s: {n: math.sqrt(a[s][n] ** 2 + b[s][n] ** 2) / 2 for n in a[s] if n in b[s]} for s in ("orig", "dest")}
        if all(group["near"].values()):
            group["meet"] = tuple(min((v, n) for n, v in group["near"][s].items())[1] for s in ("orig", "dest"))
        self._index(("group", g), list(group["users"]), group["near"])

    def rows(self) -> list[tuple]:
        return [(min(g["users"]), sorted(g["users"]), *g["meet"]) for g in self.groups.values()]


def _near_of(data: pd.DataFrame) -> dict[int, dict[str, dict[int, float]]]:
    out: dict[int, dict[str, dict[int, float]]] = {}
    for u, side, node, dist in data[["user_id", "side", "node", "dist"]].itertuples(index=False):
        out.setdefault(int(u), {"orig": {}, "dest": {}})[side][int(node)] = float(dist)
    return out


_GROUPS = "first_user long, users array<long>, orig_node long, dest_node long"


def _meeting_edges(pairs: DataFrame, removed: Iterable[int]) -> DataFrame:
    """The pairs (a, b) that can influence each other in `meeting_groups`."""
    limit = most_total() * (3.0 if frozenset(removed) else 1.5)
    return pairs.where(F.col("total") <= limit).select(F.col("user_id").alias("a"), F.col("cand_id").alias("b"))


def meeting_riders(who: DataFrame, pairs: DataFrame, removed: Iterable[int] = ()) -> DataFrame:
    """(user_id, side, src): the ends of those riders (who: user_id, o, d) whose near nodes `meeting_groups` reads. The others have no group, so their near nodes need not be rows."""
    edges = _meeting_edges(pairs, removed)
    linked = edges.select(F.col("a").alias("user_id")).union(edges.select("b")).distinct()
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("src")) for side, c in (("orig", "o"), ("dest", "d"))))
    return who.join(linked.hint("merge"), "user_id", "left_semi").select("user_id", F.inline(ends))


def meeting_groups(near: DataFrame, pairs: DataFrame, removed: Iterable[int] = ()) -> DataFrame:
    """Groups by meeting points of riders (near: user_id, side, node, dist) arriving in order of id; `removed` leave afterwards.

    `pairs` (user_id, cand_id, total) are all pairs that share nodes on both sides. Those whose total could not count even in
    a group of three are no edges: a third member's score is at least two thirds of the pair's, a third after removals.
    """
    gone = frozenset(removed)
    own = parts(_meeting_edges(pairs, gone)).select(F.col("id").alias("user_id"), "part")

    def fold(data: pd.DataFrame) -> pd.DataFrame:
        riders = _near_of(data)
        state = MeetingPoints()
        for u in sorted(riders):
            state.add(u, riders[u])
        for u in sorted(gone & riders.keys()):
            state.remove(u)
        return pd.DataFrame(state.rows(), columns=["first_user", "users", "orig_node", "dest_node"])

    # near nodes come from a Python step, whose size Spark does not know: no broadcast
    return near.join(own.hint("merge"), "user_id").groupBy("part").applyInPandas(fold, _GROUPS)


def minhash_fold(rows: Iterable[tuple[int, int, float]], users: Iterable[int], removed: Iterable[int] = ()) -> list[list[int]]:
    """Groups from similar pairs (user, earlier user, similarity), users in order: the two most similar with fewer than two companions decide.

    Two found: the second's pair is joined if the first is single, else the first's pair, else the two and the newcomer form a
    group. One found: its group is joined or formed. A removed user leaves its group; the sole survivor is single again.
    """
    similar: dict[int, list[tuple[float, int]]] = {}
    for u, c, s in rows:
        similar.setdefault(u, []).append((-s, c))
    group_of: dict[int, list[int]] = {}
    for u in users:
        mates = [c for _, c in sorted(similar.get(u, [])) if len(group_of.get(c, [c])) < 3][:2]
        if not mates:
            continue
        if len(mates) == 2 and mates[1] in group_of and mates[0] not in group_of:
            group = group_of[mates[1]]
        elif mates[0] in group_of:
            group = group_of[mates[0]]
        elif len(mates) == 2:
            group = list(mates)
        else:
            group = [mates[0]]
        for m in group:
            group_of[m] = group
        group.append(u)
        group_of[u] = group
    for u in removed:
        group = group_of.pop(u, None)
        if group:
            group.remove(u)
            if len(group) == 1:
                group_of.pop(group.pop(), None)
    return sorted({tuple(sorted(g)) for g in group_of.values()})


def cosine_fold(rows: Iterable[tuple[int, int, float]], users: Iterable[int]) -> list[list[int]]:
    """In input order, each unused user takes its two most similar unused users (ties: input order); users without any form nothing."""
    similar: dict[int, list[tuple[float, int]]] = {}
    for a, b, s in rows:
        similar.setdefault(a, []).append((-s, b))
        similar.setdefault(b, []).append((-s, a))
    used: set[int] = set()
    out = []
    for u in users:
        if u in used:
            continue
        mates = [c for _, c in sorted(similar.get(u, [])) if c not in used][:2]
        if mates:
            out.append([u, *mates])
            used.update(out[-1])
    return out


def pair_groups(pairs: DataFrame, how: str, removed: Iterable[int] = ()) -> DataFrame:
    """Groups (first_user, users) from pairs (user_id, cand_id, sim) by `minhash` or `cosine`, part by part of the pairs' graph."""
    own = parts(pairs.select(F.col("user_id").alias("a"), F.col("cand_id").alias("b")))
    gone = tuple(sorted(removed))

    def fold(data: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(a), int(b), float(s)) for a, b, s in data[["user_id", "cand_id", "sim"]].itertuples(index=False)]
        users = sorted({u for a, b, _ in rows for u in (a, b)})
        groups = minhash_fold(rows, users, gone) if how == "minhash" else cosine_fold(rows, users)
        return pd.DataFrame([(min(g), sorted(g)) for g in groups], columns=["first_user", "users"])

    return pairs.join(own.withColumnRenamed("id", "user_id"), "user_id").groupBy("part").applyInPandas(fold, "first_user long, users array<long>")


def intercity_fold(users: list[int], passengers: dict[int, int], may: set[tuple[int, int]], size: int = 3) -> list[list[int]]:
    """Each first unused user gathers later unused ones who may ride with it, while seats are left; single users are groups too."""
    place, mates = {u: n for n, u in enumerate(users)}, {}
    for u, v in may:
        if u in place and place.get(v, -1) > place[u]:
            mates.setdefault(u, []).append(v)
    used: set[int] = set()
    out = []
    for u in users:
        if u in used:
            continue
        group, taken = [u], passengers[u]
        used.add(u)
        for v in sorted(mates.get(u, ()), key=place.__getitem__):
            if len(group) >= size:
                break
            if v not in used and taken + passengers[v] <= size:
                group.append(v)
                used.add(v)
                taken += passengers[v]
        out.append(group)
    return out


def intercity_groups(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups (first_user, users) between cities. Riders without pairs ride alone; the others are folded by part of the pairs' graph, so a large city is not one task."""
    own = parts(pairs.select("a", "b")).withColumnRenamed("id", "user_id")
    links = pairs.select(F.col("a").alias("user_id"), F.col("b").alias("mate"))
    rows = requests.select("user_id", "passengers").join(own, "user_id").join(links, "user_id", "left")

    def fold(data: pd.DataFrame) -> pd.DataFrame:
        may = {(int(a), int(b)) for a, b in data[["user_id", "mate"]].dropna().itertuples(index=False)}
        seats = dict(zip(data["user_id"].astype(int), data["passengers"].astype(int), strict=True))
        groups = intercity_fold(sorted(seats), seats, may)
        return pd.DataFrame([(min(g), g) for g in groups], columns=["first_user", "users"])

    shape = "first_user long, users array<long>"
    alone = requests.join(own, "user_id", "left_anti").select(F.col("user_id").cast("long").alias("first_user"), F.array(F.col("user_id").cast("long")).alias("users"))
    return rows.groupBy("part").applyInPandas(fold, shape).unionByName(alone)


def storage_fold(events: Iterable[tuple[int, str, int]], group_size: int = 3) -> list[tuple[int, str]]:
    """(user, state) after events (seq, op, user): the first add stays, removals detach; pending users form groups as soon as there are enough, and a group of one dissolves."""
    state: dict[int, str] = {}
    groups: list[list[int]] = []
    for _, op, user in sorted(events):
        if op == "add" and user not in state:
            state[user] = "pending"
            waiting = [u for u, s in state.items() if s == "pending"]
            if len(waiting) >= group_size:
                groups.append(waiting[:group_size])
                state.update(dict.fromkeys(groups[-1], "assigned"))
        elif op == "remove" and user in state:
            del state[user]
            for g in [g for g in groups if user in g]:
                g.remove(user)
                if len(g) <= 1:
                    state.update(dict.fromkeys(g, "pending"))
                    groups.remove(g)
    return sorted(state.items())


def stored_states(events: DataFrame, key: str) -> DataFrame:
    """(key, user_id, state) of independent stores (`key`), each folded in order of seq."""

    def fold(data: pd.DataFrame) -> pd.DataFrame:
        rows = storage_fold([(int(s), o, int(u)) for s, o, u in data[["seq", "op", "user_id"]].itertuples(index=False)])
        out = pd.DataFrame(rows, columns=["user_id", "state"])
        out.insert(0, "store", int(data["store"].iloc[0]))
        return out

    return events.withColumn("store", F.col(key).cast("long")).groupBy("store").applyInPandas(fold, "store long, user_id long, state string")
