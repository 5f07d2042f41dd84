"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks, trained on labelled texts.

A text is a bag of units, its words without marks, with a letter for either end. The kernel compares two units by the
letter fours that they share as subsequences; a four over a wider stretch counts less, so letters put between those of an
insult weaken the match and do not end it. Landmarks give units their Nyström coordinates, and a linear machine in these is
a sum over kernel values with landmarks; collapsed over fours, it is one weight for each hashed four, from which any unit is
scored. A text's margin is that of its worst unit, and the machine is trained so too: in each toxic text on the unit that
scores highest (multiple-instance).
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import ChunkTable, chunks_of, held_out, large_batches, scratch, table, written
from wayfold.llm.labelled import labelled_sample

LETTERS = 64  # codes of letters; the last two are a unit's ends
FOURS_BITS = 19
FOURS = 1 << FOURS_BITS  # slots of hashed fours
SPAN = 7  # letters that a four may stretch over
DECAY = 0.85  # weight of a four: DECAY ** its stretch
LONG, WINDOW, STEP = 14, 12, 4  # units over LONG letters are scored by windows


def unit_of(chunk: str) -> str:
    """The letters of a chunk in lower case."""
    if not chunk.isalpha():
        chunk = "".join(filter(str.isalpha, chunk))
    return chunk.lower()


_SPELLED = re.compile(r"(?<!\S)(?:[^\W_]\s){2,}[^\W_](?!\S)")


def units_in(text: str) -> list[str]:
    """Chunks of a text, and runs of single letters (`i d i o t`) as one more chunk each."""
    out = chunks_of(text)
    out += [re.sub(r"\s", "", m[0]) for m in _SPELLED.finditer(text)]
    return out


@functools.cache
def _stretches(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the fours in a unit of this length, and their weights."""
    at = [c for i in range(length) for c in itertools.combinations(range(i, min(length, i + SPAN)), 4) if c[0] == i]
    at = np.array(at, np.int64).reshape(-1, 4).T
    w = DECAY ** (at[3] - at[0] + 1.0)
    return at, (w / np.sqrt((w * w).sum())).astype(np.float32)


def fours(units: list[str]) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For units of the same length at a time: their positions in the list, slots (a row each) and the weights, scaled to length one."""
    k = np.uint32(LETTERS)
    by_length: dict[int, list[int]] = {}
    for n, u in enumerate(units):
        by_length.setdefault(len(u), []).append(n)
    for length, rows in sorted(by_length.items()):
        if length < 2:
            continue
        at, w = _stretches(length + 2)
        most = max(1, (1 << 20) // at.shape[1])  # long units have very many slots
        for part in range(0, len(rows), most):
            own = np.array(rows[part : part + most])
            flat = np.frombuffer("".join(units[r] for r in own).encode("utf-32-le"), np.uint32).reshape(-1, length) - np.uint32(97)
            c = np.empty((len(own), length + 2), np.uint32)
            c[:, 0], c[:, -1] = LETTERS - 2, LETTERS - 1
            c[:, 1:-1] = np.where(flat < 26, flat, 26 + flat % np.uint32(LETTERS - 28))
            codes = ((c[:, at[0]] * k + c[:, at[1]]) * k + c[:, at[2]]) * k + c[:, at[3]]
            yield own, (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - FOURS_BITS), w


def parts_of(unit: str) -> list[str]:
    return [unit] if len(unit) <= LONG else [unit[a : a + WINDOW] for a in range(0, len(unit) - WINDOW + STEP, STEP)]


@dataclass
class SubsequenceSvm:
    weights: np.ndarray  # by slot
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, chunks: list[str]) -> np.ndarray:
        """Of each chunk, the highest over its windows."""
        units, owner = [], []
        for n, c in enumerate(chunks):
            own = parts_of(unit_of(c))
            units += own
            owner += [n] * len(own)
        part = np.full(len(units), self.bias)
        for rows, codes, w in fours(units):
            part[rows] += self.weights[codes] @ w
        out = np.full(len(chunks), self.bias)
        np.maximum.at(out, np.array(owner, np.int64), part)
        return out

    def chance(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * margin + self.shift))))


#: Landmarks, rounds of choosing units, and Newton steps in each.
LANDMARKS, ROUNDS, STEPS = 300, 4, 6
#: Weights of all toxic bags and of all clean units.
TOXIC_WEIGHT, CLEAN_WEIGHT, RIDGE = 400.0, 40_000.0, 1e-2


def _runs(unit: Column) -> Column:
    """Letter runs of five of a unit, its ends counted as letters."""
    u = F.concat(F.lit("^"), unit, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(u) - 4)), lambda k: F.substring(u, k, F.lit(5)))


class Landmarks:
    """Nyström coordinates: the kernel with the landmarks times the inverse root of their own kernel."""

    def __init__(self, marks: list[str]):
        rows: dict[int, int] = {}
        cells = []
        for own, codes, w in fours(marks):
            for r, cs in zip(own, codes, strict=True):
                cells += [(rows.setdefault(int(c), len(rows) + 1), r, v) for c, v in zip(cs, w, strict=True)]
        self.at = np.zeros((len(rows) + 1, len(marks)), np.float32)  # row 0: slots that no landmark has
        for a, b, v in cells:
            self.at[a, b] += v
        self.slots, self.places = np.array(list(rows), np.int64), np.array(list(rows.values()), np.int64)
        value, vector = np.linalg.eigh(self.kernel(marks).astype(float))
        self.root = (vector / np.sqrt(np.maximum(value, 1e-3))).astype(np.float32)

    def kernel(self, units: list[str]) -> np.ndarray:
        index = np.zeros(FOURS, np.int32)
        index[self.slots] = self.places
        out = np.zeros((len(units), self.at.shape[1]), np.float32)
        for own, codes, w in fours(units):
            slot = index[codes]
            unit, k = np.nonzero(slot)
            for part in range(0, len(unit), 1 << 13):  # few at a time, as each takes a row of kernel values
                u, c = unit[part : part + (1 << 13)], k[part : part + (1 << 13)]
                starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                out[own[u[starts]]] += np.add.reduceat(self.at[slot[u, c]] * w[c][:, None], starts, 0)
        return out

    def coordinates(self, units: list[str]) -> np.ndarray:
        return self.kernel(units) @ self.root

    def collapsed(self, w: np.ndarray) -> np.ndarray:
        """The linear machine `w` in coordinates as one weight for each slot."""
        out = np.zeros(FOURS, np.float32)
        out[self.slots] = (self.at @ (self.root @ w))[self.places]
        return out


def _hinge(x: np.ndarray, y: float, cost: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and slope of the squared hinge loss over rows `x` (the last column one) of label `y`."""
    slack = 1 - y * (x @ w)
    on = slack > 0
    own = x[on].astype(float)
    return own.T @ (own * cost[on, None]), own.T @ (cost[on] * y * slack[on])


#: Taught units whose coordinates the driver works on at a time.
BLOCK = 2_048
#: Letters that are put into each place inside a unit that is taught; what such units weigh beside the unit.
INSERTED, INSERTED_WEIGHT = 3, 0.5


def with_letters(unit: str) -> list[str]:
    """The unit with one letter more, at each place inside, INSERTED letters by hash."""
    h = zlib.crc32(unit.encode())
    return [unit[:at] + chr(97 + (h >> at) * (k + 1) % 26) + unit[at:] for at in range(1, len(unit)) for k in range(INSERTED)]


def _chances(margin: np.ndarray, label: np.ndarray, cut: float) -> tuple[float, float]:
    """Slope and shift: the slope by logistic regression, the shift such that `cut` is the chance at the margin of best F1 (a third into its gap from below, as insults with a letter more lie there)."""
    hits, rest = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (hits + 1) / (hits + 2), 1 / (rest + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        x = np.stack([margin, np.ones_like(margin)])
        h = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x @ (target - p) - 1e-3 * np.array([a, c]))
        a, c = a + np.clip(step[0], -1, 1), c + np.clip(step[1], -1, 1)
    a = max(a, 0.5)
    order = np.argsort(-margin, kind="stable")
    f1 = 2 * np.cumsum(label[order]) / (np.arange(1, len(label) + 1) + hits)
    best = int(np.argmax(f1))
    low = margin[order[best + 1]] if best + 1 < len(order) else margin[order[best]] - 1
    return a, math.log(cut / (1 - cut)) - a * (margin[order[best]] + 2 * low) / 3


def fit_svm(bags: DataFrame, cut: float = 0.3) -> SubsequenceSvm:
    """From `bags` (bag, grade: 1 toxic, 0 clean, held, units: distinct), a table that is read several times.

    Units and their coordinates stay with the executors: by unit they are counted over bags, and every Newton step adds up
    the curvature (as many numbers as LANDMARKS squared) and slope of each task. The driver has the landmarks, one unit of each toxic
    bag and the sums. All units of the clean bags are taught. Held bags set the slope and shift that turn margins into
    chances. Without bags of both labels every text gets the share of toxic ones as its chance.
    """
    spark = bags.sparkSession
    sizes = {(r.grade, r.held): r.n for r in bags.groupBy("grade", "held").agg(F.count("*").alias("n")).collect()}
    fit = bags.where("NOT held")
    pairs = fit.select("bag", "grade", F.explode("units").alias("unit"))
    units = written(pairs.groupBy("unit").agg(F.sum("grade").alias("pos"), F.sum(1 - F.col("grade")).alias("neg")), "toxic-units")
    known, new = units.where("neg > 0"), units.where("neg = 0")
    if not sizes.get((1, False)) or not new.limit(1).count() or not known.limit(1).count():
        toxic, all_ = sum(n for (y, _), n in sizes.items() if y), sum(sizes.values())
        share = (toxic + 0.5) / (all_ + 1)
        return SubsequenceSvm(np.zeros(FOURS, np.float32), -1.0, 0.0, math.log(share / (1 - share)))
    # log odds of letter runs by bags: a start from which the first units are picked
    grams = pairs.select("bag", "grade", F.explode(_runs(F.col("unit"))).alias("g")).distinct().groupBy("g").agg(F.sum("grade").alias("pos"), F.sum(1 - F.col("grade")).alias("neg"))
    a, b = sizes[1, False] + 1, sizes.get((0, False), 0) + 1
    odds = F.log(F.col("pos") / a) - F.log((F.col("neg") + 0.5) / b) + 0.5 * F.log("pos")
    scored = grams.where("pos >= 3").select("g", odds.alias("start"))
    starts = new.select("unit", F.explode(_runs(F.col("unit"))).alias("g")).join(scored, "g", "left").groupBy("unit").agg(F.coalesce(F.max("start"), F.lit(-9.0)).alias("start"))
    # a toxic bag whose units all stand in clean bags too can't teach a unit
    own = written(pairs.where("grade = 1").join(starts, "unit").select("bag", "unit", "start"), "toxic-own")
    first = own.groupBy("bag").agg(F.max(F.struct("start", "unit")).alias("m")).groupBy("m.unit").agg(F.max("m.start").alias("start")).collect()  # one a bag
    ranked = [r.unit for r in sorted(first, key=lambda r: (-r.start, r.unit))]
    third = LANDMARKS // 3
    spread = sorted(ranked, key=lambda u: zlib.crc32(u.encode()))
    clean = known.orderBy(F.crc32(F.col("unit").cast("binary")), "unit").limit(third).collect()
    marks = Landmarks(list(dict.fromkeys(ranked[:third] + spread[:third] + [r.unit for r in clean])))
    sent = spark.sparkContext.broadcast(marks)

    def coordinates(df: DataFrame, name: str) -> DataFrame:
        at = df.columns.index("unit")

        def add(batches):
            for x in batches:
                z = sent.value.coordinates(x.column(at).to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array([r.tobytes() for r in z], pa.binary())], [*x.schema.names, "z"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return written(df.mapInArrow(add, f"{fields}, z binary"), name)

    with large_batches(spark, 4_096):
        below = coordinates(known.select("unit", "neg"), "toxic-below")
        above = coordinates(own, "toxic-above")
    # clean units count by their bags: what many clean texts have must not be found toxic
    unit_cost = CLEAN_WEIGHT / below.agg(F.sum("neg")).first()[0]

    def matrix(column) -> np.ndarray:
        z = np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)
        return np.hstack([z, np.ones((len(z), 1), np.float32)])

    def picked(w: np.ndarray | None) -> list:
        """Of each toxic bag the unit that scores highest."""

        def best(batches):
            top: dict[int, tuple] = {}
            for x in batches:
                score = x.column(2).to_numpy() if w is None else matrix(x.column(3)) @ w
                for bag, unit, s in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), score.tolist(), strict=True):
                    if bag not in top or (s, unit) > top[bag]:
                        top[bag] = (s, unit)
            yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([u for _, u in top.values()], pa.string()), pa.array([s for s, _ in top.values()], pa.float64())], ["bag", "unit", "s"])

        with large_batches(spark, 4_096):
            return [r.m.unit for r in above.mapInArrow(best, "bag long, unit string, s double").groupBy("bag").agg(F.max(F.struct("s", "unit")).alias("m")).collect()]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches):
            total = None
            for x in batches:
                m = matrix(x.column(2))
                own = _hinge(m, -1.0, unit_cost * x.column(1).to_numpy(), w)
                total = own if total is None else (total[0] + own[0], total[1] + own[1])
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in total], ["h", "g"])

        with large_batches(spark, 4_096):
            rows = below.mapInArrow(part, "h binary, g binary").collect()  # one a task
        k = len(w)
        return sum(np.frombuffer(r.h).reshape(k, k) for r in rows), sum(np.frombuffer(r.g) for r in rows)

    w = None
    for _ in range(ROUNDS):
        names = Counter(picked(w))
        each = [(u, n, v) for u, n in names.items() for v in [[u], with_letters(u)]]
        taught = [v for *_, vs in each for v in vs]
        # a unit counts once for each bag that it was picked in, and the ones with a letter more share its weight
        cost = np.array([TOXIC_WEIGHT / names.total() * n * (1 if vs[0] == u else INSERTED_WEIGHT / len(vs)) for u, n, vs in each for _ in vs])
        # in blocks, so that the driver holds few of their numbers in full length at a time
        blocks = [(np.hstack([z := marks.coordinates(taught[k : k + BLOCK]).astype("<f4"), np.ones((len(z), 1), np.float32)]), cost[k : k + BLOCK]) for k in range(0, len(taught), BLOCK)]
        w = np.zeros(blocks[0][0].shape[1]) if w is None else w
        keep = np.full(len(w), RIDGE)
        keep[-1] = 1e-6
        for _ in range(STEPS):
            h, g = sums(w)
            for x, c in blocks:
                h2, g2 = _hinge(x, 1.0, c, w)
                h, g = h + h2, g + g2
            step = np.linalg.solve(h + np.diag(keep), g - keep * w)
            w = w + step
            if np.abs(step).max() < 1e-3:
                break
    svm = SubsequenceSvm(marks.collapsed(w[:-1]), float(w[-1]))

    def margins(batches):
        for x in batches:
            m = [float(svm.margins(u or [""]).max()) for u in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(m, pa.float64())], ["grade", "margin"])

    held = bags.where("held").select("grade", "units").mapInArrow(margins, "grade int, margin double").orderBy("margin", "grade").collect()  # two numbers a held bag
    label = np.array([r.grade for r in held], float)
    if 0 < label.sum() < len(label):
        svm.slope, svm.shift = _chances(np.array([r.margin for r in held]), label, cut)
    return svm


#: Labelled documents that the machine is fitted on, at most.
MOST_LABELLED = 2_400


def bags_of(texts: DataFrame) -> DataFrame:
    """(bag, grade, held, units: the distinct units of three letters and more) of (doc_id, grade, text); one in five is held."""

    def units(batches):
        for b in batches:
            lists = [sorted({p for c in units_in(t) for p in parts_of(unit_of(c)) if len(p) >= 3}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "grade", "units"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    made = texts.mapInArrow(units, f"doc_id {kind}, grade int, units array<string>")
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(5)) == 0
    return written(made.select(F.monotonically_increasing_id().alias("bag"), "grade", held.alias("held"), "units"), "toxic-bags", "zstd")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> SubsequenceSvm:
    """The machine from at most `most` labelled documents: half of them toxic where there are as many."""
    toxic = F.col("toxic")
    clean, bad = (labelled_sample(docs, labels, F.when(toxic == label, toxic), most // 2) for label in (0, 1))
    with scratch(docs.sparkSession):
        return fit_svm(bags_of(clean.union(bad)))


def score_toxicity(docs: DataFrame, svm: SubsequenceSvm, cut: float = 0.3, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds toxic_score (0 to 1) and toxic (score >= `cut`) to the columns `keep` of every row (by default doc_id).

    Null and empty texts have no units and get the score of the bare bias; very long texts are scored whole, by their worst
    unit. Equal texts get equal scores; every row gives one row; an empty table gives none. Columns of `docs` beside `keep`
    are left out; `keep` can't hold the two names that are added.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"toxic_score", "toxic"} & set(keep):
        raise ValueError(f"rename {', '.join(sorted(clash))} first")
    sent = docs.sparkSession.sparkContext.broadcast(svm)
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def score(batches):
        known = ChunkTable(lambda new: sent.value.margins(new).tolist())
        for b in batches:
            lists = [units_in(t) for t in b.column(len(keep)).to_pylist()]
            known.learn(lists)
            s = [sent.value.chance(max(map(known.__getitem__, x))) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "toxic_score"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(score, f"{fields}toxic_score double")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), "toxic_score", (F.col("toxic_score") >= cut).alias("toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score_toxicity` of all documents by the machine that `train` fits on those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score 0.3 or more go.

    Null and empty texts have no unit that could be toxic; equal texts are decided alike, rows with one doc_id or none each for
    itself. Columns of any name and type are kept; an empty table gives none; without labels of both kinds no document goes.
    """
    svm = train(docs, table(spark, sf_dir, "labels"))
    if not svm.weights.any():
        return docs
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    kept = score_toxicity(numbered, svm, keep=numbered.columns, text=numbered.columns[docs.columns.index("text")]).where(~F.col("toxic"))
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
