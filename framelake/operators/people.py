"""Faces and people: votes, covers, suggestions, and constrained batch clustering."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import vectors as V

#: Thresholds of assignment, linking, merging and suggestion, and least qualities.
ASSIGN, ASSIGN_LOW, LINK, MERGE, MERGE_NAMED, SUGGEST = 0.45, 0.52, 0.5, 0.6, 0.7, 0.4
SEED_QUALITY, LEAST_QUALITY, LEAST_FACES = 0.4, 0.12, 2
#: Clusters whose centres are compared with all earlier ones at once.
TILE = 1024


def person_list(faces: DataFrame) -> DataFrame:
    """Size and cover of each person; the cover is the face of best quality, then confidence, then smallest id."""
    cover = F.max_by("face_id", F.struct("quality", "confidence", -F.col("face_id")))
    return faces.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("faces"), cover.alias("cover_face_id"), F.avg("quality").alias("mean_quality"))


def person_centroids(faces: DataFrame) -> DataFrame:
    return V.centroids(faces.where("person_id is not null"), "person_id")


def votes(spark: SparkSession, faces: DataFrame, least: float = LINK, centre: float = ASSIGN, k: int = 10) -> DataFrame:
    """(face_id, person_id, weight, similarity): the person that each unassigned face of sufficient quality joins.

    Its k nearest faces, all others included, vote with their similarity; the winner's centroid must be near too.
    Ties go to the person whose nearest face ranks first.
    """
    asked = faces.where((F.col("person_id").isNull()) & (F.col("quality") >= SEED_QUALITY))
    near = V.batch_nearest(spark, faces, asked, k, id="face_id", least=least)
    known = faces.where("person_id is not null").select(F.col("face_id").alias("neighbour_id"), "person_id")
    tally = near.join(known, "neighbour_id").groupBy("query_id", "person_id").agg(F.sum("cosine").alias("weight"), F.min("rank").alias("first"))
    best = tally.groupBy("query_id").agg(F.max_by(F.struct("person_id", "weight"), F.struct(F.round("weight", 9), -F.col("first"))).alias("b")).select(F.col("query_id").alias("face_id"), "b.*")
    from framelake.functions.vector import dot

    out = best.join(faces.select("face_id", "embedding"), "face_id").join(person_centroids(faces).select("person_id", "centroid"), "person_id")
    out = out.withColumn("similarity", dot(F.col("embedding"), F.col("centroid"))).where(F.col("similarity") >= centre)
    return out.select("face_id", "person_id", "weight", "similarity")


def suggestions(people: DataFrame, dismissed: DataFrame, least: float = SUGGEST, limit: int = 20) -> DataFrame:
    """Pairs of people that may be one, closest first: not both named, not dismissed; where one is named, it is ``a``."""
    named = people.select(F.col("person_id").alias("id"), (F.coalesce("name", F.lit("")) != "").alias("named"))
    pairs = V.close_pairs(people, "person_id", least).join(dismissed, ["a", "b"], "left_anti")
    pairs = pairs.join(named.withColumnsRenamed({"id": "a", "named": "na"}), "a").join(named.withColumnsRenamed({"id": "b", "named": "nb"}), "b").where("not (na and nb)")
    first, second = F.when(F.col("nb"), F.col("b")).otherwise(F.col("a")), F.when(F.col("nb"), F.col("a")).otherwise(F.col("b"))
    out = pairs.select(first.alias("a"), second.alias("b"), "similarity", (F.col("na") | F.col("nb")).alias("named"))
    return out.orderBy(F.desc("similarity"), "a", "b").limit(limit)


@dataclass
class Cluster:
    total: np.ndarray
    count: float
    person: int | None = None
    named: bool = False
    faces: list[int] = field(default_factory=list)
    banned: set[int] = field(default_factory=set)

    @property
    def centre(self) -> np.ndarray:
        return self.total / (np.linalg.norm(self.total) or 1.0)


#: A face: id, vector, quality. A person: id, whether it has a name, centroid, number of faces.
Face = tuple[int, np.ndarray, float]
Person = tuple[int, bool, np.ndarray, float]


def plan_clusters(pending: list[Face], dormant: list[Face], people: list[Person], rejected: dict[int, set[int]], dismissed: set[tuple[int, int]]) -> dict:
    """One ordered block's plan: assign (face, person), create (lists of faces), merges (from, into), dormant (faces).

    Pending faces join the nearest admissible cluster from best to worst quality, or seed one; then clusters merge from
    the closest pair on; then changed clusters call dormant faces near their centre.
    """
    return plan_ordered(sorted(pending, key=lambda f: -f[2]), dormant, people, rejected, dismissed)


def plan_ordered(pending: Iterable[Face], dormant: list[Face], people: list[Person], rejected: dict[int, set[int]], dismissed: set[tuple[int, int]]) -> dict:
    """``plan_clusters`` of faces that come from best to worst quality; their vectors are not kept, only clusters are."""
    clusters = [Cluster(c * n, float(n), p, named) for p, named, c, n in people]
    number = {id(c): n for n, c in enumerate(clusters)}
    of_person = {c.person: n for n, c in enumerate(clusters)}
    centres = np.stack([c.centre for c in clusters]) if clusters else np.zeros((0, 1))  # rows beyond the clusters are spare
    quality: dict[int, float] = {}
    pool = sorted(dormant, key=lambda f: f[0])
    pool_vectors = np.stack([f[1] for f in pool]) if pool else np.zeros((0, 1))
    taken: set[int] = set()
    awaited: set[int] = set()
    rest: list[int] = []

    def admit(c: Cluster, face: int, v: np.ndarray) -> None:
        c.total = c.total + v
        centres[number[id(c)]] = c.centre
        c.count += 1
        c.faces.append(face)
        c.banned |= rejected.get(face, set())
        taken.add(face)

    def allowed(c: Cluster, face: int) -> bool:
        return c.person is None or c.person not in rejected.get(face, set())

    def call(c: Cluster, most: int, least: float, anchor: np.ndarray) -> None:
        """Of the nearest dormant faces, at most so many, those that are near enough, good enough, free and allowed."""
        if not pool:
            return
        near = pool_vectors @ anchor
        for n in np.argsort(-near, kind="stable")[:most].tolist():
            face, v, q = pool[n]
            if near[n] < least:
                break
            if face not in taken and q >= LEAST_QUALITY and allowed(c, face):
                quality[face] = q
                admit(c, face, v)

    for face, v, q in pending:
        quality[face] = q
        awaited.add(face)
        if q < LEAST_QUALITY:
            rest.append(face)
            continue
        near = centres[: len(clusters)] @ v if clusters else np.zeros(0)
        if face in rejected:
            near[[n for n, c in enumerate(clusters) if not allowed(c, face)]] = -np.inf
        n = int(np.argmax(near)) if len(near) else 0
        if len(near) and near[n] >= (ASSIGN if q >= SEED_QUALITY else ASSIGN_LOW):
            admit(clusters[n], face, v)
        elif q >= SEED_QUALITY:
            clusters.append(fresh := Cluster(np.zeros_like(v), 0.0))
            number[id(fresh)] = len(clusters) - 1
            if len(clusters) > len(centres):
                centres = np.concatenate([centres.reshape(-1, len(v)), np.zeros((len(centres) + 64, len(v)))])
            admit(fresh, face, v)
            call(fresh, 20, LINK, v)
        else:
            rest.append(face)

    root = list(range(len(clusters)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    def bans(i: int, j: int) -> bool:
        """Whether a face of cluster i rejected a person that cluster j is or has taken in."""
        return any(p in of_person and find(of_person[p]) == j for p in clusters[i].banned)

    changed = np.array([bool(c.faces) for c in clusters], bool)
    candidates = []
    for at in range(0, len(clusters), TILE):
        end = min(len(clusters), at + TILE)
        sims = centres[at:end] @ centres[:end].T
        i, j = np.nonzero(np.tril(sims >= MERGE, at - 1) & (changed[at:end, None] | changed[None, :end]))
        candidates += zip((-sims[i, j]).tolist(), (i + at).tolist(), j.tolist())
    candidates.sort()
    merges = []
    for _, i, j in candidates:
        # of two that rank alike the changed one stays; of two changed ones the person of the smaller id, or the newer cluster
        if changed[i] and changed[j]:
            i, j = (i, j) if clusters[i].person is None and clusters[j].person is None or clusters[j].person is not None and clusters[i].person is None else (j, i)
        elif changed[j]:
            i, j = j, i
        i, j = find(i), find(j)
        a, b = clusters[i], clusters[j]
        both = a.person is not None and b.person is not None
        if i == j or (a.named and b.named) or float(a.centre @ b.centre) < (MERGE_NAMED if a.named or b.named else MERGE):
            continue
        if bans(i, j) or bans(j, i) or (both and (min(a.person, b.person), max(a.person, b.person)) in dismissed):
            continue
        if (b.named, b.person is not None, b.count) > (a.named, a.person is not None, a.count):
            i, j, a, b = j, i, b, a
        if b.person is not None:
            merges.append((b.person, a.person))
        a.total, a.count, a.faces, a.banned = a.total + b.total, a.count + b.count, a.faces + b.faces, a.banned | b.banned
        root[j] = i
    merges = [(gone, clusters[find(of_person[stays])].person) for gone, stays in merges]  # who stays may go later
    out = {"assign": [], "create": [], "merges": merges, "dormant": rest}
    # a cluster that took another in has changed, even if neither got a face
    grown = {i for i, c in enumerate(clusters) if root[i] == i and (c.faces or changed[i])} | {find(j) for j in range(len(clusters)) if root[j] != j}
    for i in sorted(grown):
        c = clusters[i]
        if c.person is not None or c.count >= LEAST_FACES:
            call(c, 50, ASSIGN, c.centre)
    for i, c in enumerate(clusters):
        if root[i] != i or not c.faces:
            continue
        if c.person is not None:
            out["assign"] += [(f, c.person) for f in c.faces]
        elif c.count >= LEAST_FACES:
            out["create"].append(sorted(c.faces, key=lambda f: -quality.get(f, 0.0)))
        else:
            out["dormant"] += [f for f in c.faces if f in awaited]
    return out


def cluster_plan(spark: SparkSession, faces: DataFrame, names: DataFrame | None = None, rejections: DataFrame | None = None, dismissed: DataFrame | None = None) -> DataFrame:
    """(face_id, action, target): the plan of all faces as one ordered block.

    names: person_id, name. rejections: face_id, person_id. dismissed: pairs a, b of people. A boolean column ``dormant``
    of ``faces`` marks unassigned faces that wait to be called; they are in the plan only if they are. Actions: assign
    (to the person), create (a person for all faces of one target, the smallest of their ids), dormant (target -1), and
    merge, whose face_id is the person that goes and whose target the one that stays.

    The order of steps matters, so one task reads people, constraints, dormant faces and then the unassigned faces of
    sufficient quality, sorted by Spark (equal quality: smaller id first); it holds clusters, constraints and dormant
    faces. Nothing goes through the driver.
    """
    none = F.lit(None).cast("array<double>")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    row = lambda df, kind, id, other, value, vector: df.select(F.lit(kind).alias("kind"), F.col(id).cast("long").alias("id"), other.cast("long").alias("other"), value.alias("value"), vector.cast("array<double>").alias("vector"))
    people = person_centroids(faces)
    known = names.select("person_id", (F.coalesce(F.trim("name"), F.lit("")) != "").alias("named")) if names is not None else None
    people = people.join(known, "person_id", "left") if known is not None else people.withColumn("named", F.lit(False))
    waits = F.coalesce(F.col("dormant"), F.lit(False)) if "dormant" in faces.columns else F.lit(False)
    free = faces.where("person_id is null").withColumn("waits", waits).withColumn("quality", number("quality"))
    zero, poor = F.lit(0), F.col("quality") < LEAST_QUALITY
    parts = row(people, 0, "person_id", F.coalesce("named", F.lit(False)).cast("int"), number("n"), F.col("centroid"))
    if rejections is not None:
        parts = parts.unionByName(row(rejections, 1, "face_id", F.col("person_id"), F.lit(0.0), none))
    if dismissed is not None:
        parts = parts.unionByName(row(dismissed, 2, "a", F.col("b"), F.lit(0.0), none))
    parts = parts.unionByName(row(free.where(F.col("waits") & ~poor), 3, "face_id", zero, F.col("quality"), F.col("embedding")))
    parts = parts.unionByName(row(free.where(~F.col("waits") & ~poor), 4, "face_id", zero, F.col("quality"), F.col("embedding")))

    def run(batches):
        import pyarrow as pa

        def stream():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

        people, rejected, pairs, dormant, first = [], {}, set(), [], []
        rows = stream()
        for kind, i, other, value, vector in rows:
            if kind == 0:
                people.append((i, bool(other), np.asarray(vector, float), value))
            elif kind == 1:
                rejected.setdefault(i, set()).add(other)
            elif kind == 2:
                pairs.add((min(i, other), max(i, other)))
            elif kind == 3:
                dormant.append((i, np.asarray(vector, float), value))
            else:
                first = [(i, np.asarray(vector, float), value)]
                break
        pending = itertools.chain(first, ((i, np.asarray(vector, float), value) for _, i, _, value, vector in rows))
        plan = plan_ordered(pending, dormant, people, rejected, pairs)
        out = [(f, "assign", p) for f, p in plan["assign"]] + [(f, "create", min(c)) for c in plan["create"] for f in c] + [(f, "dormant", -1) for f in plan["dormant"]]
        out += [(a, "merge", b) for a, b in plan["merges"]]
        for at in range(0, len(out), 10_000):
            part = out[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["face_id", "action", "target"])

    ordered = parts.repartition(1).sortWithinPartitions("kind", F.desc(F.when(F.col("kind") == 4, F.col("value"))), "id")
    planned = ordered.mapInArrow(run, "face_id long, action string, target long")
    return planned.unionByName(free.where(~F.col("waits") & poor).select(F.col("face_id").cast("long").alias("face_id"), F.lit("dormant").alias("action"), F.lit(-1).cast("long").alias("target")))


def apply_plan(faces: DataFrame, plan: DataFrame) -> DataFrame:
    """Faces after a plan; only faces that are still unassigned change, then people merge. New people have negative ids."""
    to = plan.where("action <> 'merge'").select("face_id", F.when(F.col("action") == "dormant", None).when(F.col("action") == "create", -F.col("target") - 1).otherwise(F.col("target")).alias("to"), F.lit(True).alias("planned"))
    out = faces.drop("dormant").join(to, "face_id", "left")
    free = F.col("person_id").isNull() & F.coalesce("planned", F.lit(False))
    out = out.withColumn("dormant", free & F.col("to").isNull()).withColumn("person_id", F.when(free, F.col("to")).otherwise(F.col("person_id"))).drop("to", "planned")
    return merged(out, plan.where("action = 'merge'").select(F.col("face_id").alias("from_id"), F.col("target").alias("into_id")))


def merged(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Faces after people were merged: mapping (from_id, into_id)."""
    out = faces.join(mapping, faces.person_id == mapping.from_id, "left")
    return out.withColumn("person_id", F.coalesce("into_id", "person_id")).drop("from_id", "into_id")


def person_photos(faces: DataFrame, media: DataFrame, person_id: int) -> DataFrame:
    """Representatives of the contents that show a person; a face belongs to the content of its number."""
    from framelake.operators.browse import representatives

    shown = faces.where(F.col("person_id") == person_id).select(F.col("face_id").alias("id"))
    hashes = media.join(shown, "id", "left_semi").select("file_hash")
    return representatives(media).join(hashes, "file_hash", "left_semi")


def covers(faces: DataFrame, k: int = 3) -> DataFrame:
    """The k best faces of each person."""
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("quality"), F.desc("confidence"), "face_id"))
    return faces.where("person_id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("person_id", "face_id", "rank")


def dirty_pairs(people: DataFrame, least: float = MERGE) -> DataFrame:
    """Pairs of clusters of which one at least has changed (columns person_id, centroid, changed)."""
    return V.close_pairs(people, "person_id", least, "changed")


def renamed(people: DataFrame, names: DataFrame) -> DataFrame:
    """New names (person_id, new_name); an empty name becomes null."""
    out = people.join(names.withColumn("given", F.lit(True)), "person_id", "left")
    return out.withColumn("name", F.when(F.col("given"), F.nullif(F.trim("new_name"), F.lit(""))).otherwise(F.col("name"))).select(people.columns)


def hidden(people: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    mark = ids.select("person_id").distinct().withColumn("mark", F.lit(True))
    return people.join(mark, "person_id", "left").withColumn("hidden", F.when(F.col("mark"), F.lit(value)).otherwise(F.col("hidden"))).select(people.columns)


def rejected(faces: DataFrame, rejections: DataFrame, face_person: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces leave the person they were put to, and the pair (face_id, person_id) becomes a constraint."""
    mark = face_person.select("face_id", F.col("person_id").alias("refused"))
    out = faces.join(mark, "face_id", "left")
    out = out.withColumn("person_id", F.when(F.col("person_id") == F.col("refused"), None).otherwise(F.col("person_id"))).select(faces.columns)
    return out, rejections.unionByName(face_person.select("face_id", "person_id")).distinct()


def assigned(faces: DataFrame, rejections: DataFrame, face_person: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces that a user puts to a person; a rejection of that pair is lifted."""
    to = face_person.select("face_id", F.col("person_id").alias("to"))
    out = faces.join(to, "face_id", "left").withColumn("person_id", F.coalesce("to", "person_id")).select(faces.columns)
    return out, rejections.join(face_person, ["face_id", "person_id"], "left_anti")


def moved_constraints(rejections: DataFrame, dismissed: DataFrame, from_id: int, into_id: int) -> tuple[DataFrame, DataFrame]:
    """After a merge: rejections follow the person; dismissed pairs of the one that is gone are dropped."""
    person = F.when(F.col("person_id") == from_id, F.lit(into_id).cast("long")).otherwise(F.col("person_id"))
    return rejections.withColumn("person_id", person).distinct(), dismissed.where((F.col("a") != from_id) & (F.col("b") != from_id))


def dismiss(dismissed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that are not one person, smaller id first."""
    return dismissed.unionByName(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
