"""Joins and aggregates over vectors."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.vectors import comparable_cosine, cosine_distance, dot, length, normalised
from tideline.operators.lineage import checkpointed

#: Bytes of references up to which every probe meets all of them in one broadcast; more are dealt into blocks of this size.
MOST_BROADCAST = 32 << 20


#: References around which cells are drawn: what every task holds of them.
PIVOTS = 64
#: References of a cell that one task meets; more of them are dealt to several.
CELL_ROWS = 1 << 16


def measured(rows: DataFrame) -> int:
    """Bytes of a table's texts and arrays."""
    sized = [F.coalesce(F.size(f.name) * 8 if isinstance(f.dataType, T.ArrayType) else F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in rows.schema.fields if not isinstance(f.dataType, T.StructType)]
    return rows.agg(F.sum(sum(sized, F.lit(16)))).first()[0] or 0


def against(probes: DataFrame, references: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Every probe beside every reference. References of at most `most` bytes, as their texts and arrays were measured, are
    broadcast; larger ones are cut into blocks of that size, and probes are sent to each block by an equi-join."""
    total = measured(references)
    if total <= most:
        return probes.crossJoin(F.broadcast(references))
    blocks = -(-total // most)
    right = references.withColumn("_block", F.pmod(F.xxhash64(*references.columns), F.lit(blocks)))
    return probes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(right, "_block").drop("_block")


def compared(probes: DataFrame, references: DataFrame, vector: str = "embedding", under: float | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """Every comparable pair, or those at a distance under `under`: the columns of both sides but their vectors, and similarity.

    References of at most `most` bytes, as measured, are sent to all tasks, and the probes are dealt evenly over the cores, however
    few pieces their file has. Products are added in order of the dimensions, one by one, as comparable_cosine adds them, so both
    give the same doubles. More references meet the probes in blocks (see against). Null and empty vectors, those that hold a null,
    and pairs of different lengths give no row.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    left, right = [c for c in probes.columns if c != vector], [c for c in references.columns if c != vector]
    near = lambda s: F.lit(True) if under is None else 1 - s < under
    if measured(references) > most:
        pairs = against(probes, references.withColumnRenamed(vector, "_reference"), most)
        return pairs.select(*left, *right, comparable_cosine(F.col(vector), F.col("_reference")).alias("similarity")).filter(F.col("similarity").isNotNull() & near(F.col("similarity")))

    def grids(table):  # noqa: ANN001, ANN202
        """Rows and vectors of each length."""
        v = table.column(vector)
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        whole = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).copy()
        flat = v.flatten()
        if flat.null_count:
            whole[pc.list_parent_indices(v).to_numpy(zero_copy_only=False)[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
        for n in np.unique(whole[whole > 0]):
            rows = np.flatnonzero(whole == n)
            yield int(n), rows, v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)

    told = references.toArrow()
    known = {n: (rows, np.ascontiguousarray(grid.T)) for n, rows, grid in grids(told)}
    sent = probes.sparkSession.sparkContext.broadcast((told.select(right), known))

    def meet(batches):  # noqa: ANN001, ANN202
        names, others = sent.value
        for batch in batches:
            for n, rows, grid in grids(batch):
                if n not in others:
                    continue
                which, columns = others[n]
                step = max(1, (1 << 18) // len(which))
                for at in range(0, len(rows), step):
                    part = np.ascontiguousarray(grid[at : at + step].T)
                    sums = np.zeros((part.shape[1], len(which)))
                    for x, y in zip(part, columns, strict=True):
                        sums += x[:, None] * y
                    i, j = np.nonzero(np.ones_like(sums, dtype=bool) if under is None else 1 - sums < under)
                    mine, theirs = pa.array(rows[at + i]), pa.array(which[j])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(mine) for c in left), *(names.column(c).combine_chunks().take(theirs) for c in right), pa.array(sums[i, j])], [*left, *right, "similarity"])

    schema = T.StructType([*(probes.schema[c] for c in left), *(references.schema[c] for c in right), T.StructField("similarity", T.DoubleType())])
    return probes.select(*left, vector).repartition(4 * probes.sparkSession.sparkContext.defaultParallelism).mapInArrow(meet, schema)


def similarities(probes: DataFrame, references: DataFrame, probe: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """probe, name, similarity of each comparable pair. references: name and a vector column."""
    return compared(probes.select(probe, vector), references.select("name", vector), vector)


def ranked_names(probes: DataFrame, references: DataFrame, probe: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each name's best similarity for each probe, how many references it has, and its rank (ties: smaller name)."""
    counts = references.groupBy("name").agg(F.count("*").alias("n_references"))
    best = similarities(probes, references, probe, vector).groupBy(probe, "name").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy(probe).orderBy(F.desc("similarity"), "name")
    return best.join(counts, "name").withColumn("rank", F.row_number().over(order))


def reachable(probes: DataFrame, references: DataFrame, least: float, probe: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """probe, name, similarity of the pairs among which each probe's most similar reference is, if its similarity is above `least`.

    References lie in cells around up to `pivots` of them, each in that of its nearest pivot. In a cell of radius d around c no
    similarity to p is above p.c + |p| d, whatever the lengths of the vectors; as pivots are references, the best of them is a
    similarity that is reached. A probe opens the cells alone whose bound is not under both, so nothing is lost, and a
    cell of many references is dealt to several tasks. Defined cases: references without a pivot of their number of dimensions are
    met by all probes; null and empty vectors meet nothing; equal references count once.
    """
    size = lambda p: F.size(p["v"])
    known = references.filter(F.size(vector) > 0).select("name", F.col(vector).cast("array<double>").alias("v")).distinct()
    first = checkpointed(known.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).withColumn("cell", F.row_number().over(Window.orderBy(F.xxhash64("v"), "v"))))
    listed = first.agg(F.collect_list(F.struct("cell", "v")).alias("ps"))
    apart = lambda a, b: F.sqrt(F.greatest(dot(a, a) - 2 * dot(a, b) + dot(b, b), F.lit(0.0)))
    near = F.array_min(F.transform(F.filter("ps", lambda p: size(p) == F.size("v")), lambda p: F.struct(apart(F.col("v"), p["v"]).alias("d"), p["cell"].alias("cell"))))
    held = checkpointed(known.crossJoin(F.broadcast(listed)).withColumn("near", near).select("name", "v", F.coalesce("near.cell", F.lit(-1)).alias("cell"), F.col("near.d").alias("d")))
    cells = held.groupBy("cell").agg(F.max("d").alias("d"), F.ceil(F.count("*") / cell_rows).alias("parts"))
    table = checkpointed(cells.join(F.broadcast(first), "cell", "left"))  # one row for each pivot, and one for the rest
    bounds = table.agg(F.collect_list(F.struct("cell", "d", "parts", "v", length(F.col("v")).alias("length"))).alias("cs"))
    rows = probes.select(probe, F.col(vector).cast("array<double>").alias("p")).filter(F.size("p") > 0).crossJoin(F.broadcast(bounds)).withColumn("norm", length(F.col("p")))
    # A part in 1e9 for rounding.
    reach = lambda c: F.col("dots")[c["cell"]] + F.col("norm") * c["d"] + 1e-9 * (1 + F.col("norm") * (c["length"] + c["d"]))
    rows = rows.withColumn("dots", F.map_from_entries(F.transform("cs", lambda c: F.struct(c["cell"], comparable_cosine(F.col("p"), c["v"])))))
    rows = rows.withColumn("floor", F.greatest(F.lit(float(least)), F.array_max(F.map_values("dots"))))
    opened = rows.withColumn("c", F.explode(F.filter("cs", lambda c: (c["cell"] == -1) | (reach(c) >= F.col("floor")))))
    met = opened.select(probe, "p", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.parts") - 1)).alias("part"))
    dealt = held.join(F.broadcast(table.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("name", "v"), "parts"))
    return met.join(dealt, ["cell", "part"]).select(probe, "name", comparable_cosine(F.col("p"), F.col("v")).alias("similarity")).filter("similarity IS NOT NULL")


def nearest_name(probes: DataFrame, references: DataFrame, cut: float, probe: str = "vec_id", vector: str = "embedding", most: int = MOST_BROADCAST) -> DataFrame:
    """The most similar reference of each probe (ties: smaller name), kept where its distance is under the cut. References of more
    than `most` bytes are met by the cells that can hold the most similar one."""
    small = measured(references.select("name", vector)) <= most
    pairs = similarities(probes, references, probe, vector) if small else reachable(probes, references, 1 - cut, probe, vector)
    best = pairs.groupBy(probe).agg(F.min(F.struct((-F.col("similarity")).alias("d"), F.col("name"))).alias("_b"))
    return best.select(probe, F.col("_b.name").alias("name"), (-F.col("_b.d")).alias("similarity")).filter(1 - F.col("similarity") < cut)


def unique_vector_matches(clusters: DataFrame, labels: DataFrame, cluster: str, label: str, vector: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """Labels whose vector equals that of exactly one cluster, within keys: keys, label, cluster. A null vector equals none."""
    keys = keys or []
    right = clusters.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(cluster).alias("_cluster"), F.col(vector).alias("_v"))
    found = labels.join(right, [F.col(k) == F.col(f"_{k}") for k in keys] + [labels[vector] == right["_v"]])
    return found.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min("_cluster").alias(cluster)).filter("_n = 1").drop("_n")


def resolved_rows(clusters: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows (keys, order, name, embedding) as rows of the one cluster (keys, id) whose vector they hold: keys, order, id, name.
    Rows that match no cluster of their session, or several, go."""
    one = unique_vector_matches(clusters, rows, "id", order, keys=keys)
    return rows.select(*keys, order, "name").join(one, [*keys, order])


def denials(clusters: DataFrame, denied: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Names that were refused for a cluster, from stored rows (keys, order, name, embedding): distinct keys, id, name."""
    return resolved_rows(clusters, denied, keys, order).select(*keys, "id", "name").distinct()


def _conflicts(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    one = conflicts.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("a").alias("_a"), F.col("b").alias("_b"))
    return one.union(one.select(*[f"_c{k}" for k in keys], "_b", "_a")).distinct().withColumn("_c", F.lit(True))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], key: str, other: str, apart) -> DataFrame:  # noqa: ANN001
    """Pairs of one session whose vectors can be compared, with their distance."""
    there = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(key).alias(other), F.col("embedding").alias("_r"))
    met = left.select(*keys, key, F.col("embedding").alias("_l")).join(there, [F.col(k) == F.col(f"_{k}") for k in keys] + [apart])
    return met.select(*keys, key, other, (1 - comparable_cosine(F.col("_l"), F.col("_r"))).alias("distance")).filter("distance IS NOT NULL")


def directed_pairs(clusters: DataFrame, conflicts: DataFrame, short: Column, keys: list[str], key: str = "id") -> DataFrame:
    """Short clusters beside every other cluster of their session: keys, key, other, distance, conflict. Vectors of other
    lengths, and empty ones, are not compared. A session's clusters are few, so its pairs are too."""
    pairs = _pairs(clusters.filter(short), clusters, keys, key, "other", F.col(key) != F.col("other"))
    both = _conflicts(conflicts, keys)
    same = [F.col(k) == F.col(f"_c{k}") for k in keys] + [F.col(key) == F.col("_a"), F.col("other") == F.col("_b")]
    return pairs.join(both, same, "left").select(*keys, key, "other", "distance", F.coalesce("_c", F.lit(False)).alias("conflict"))


def labelled_pairs(clusters: DataFrame, conflicts: DataFrame, named: DataFrame, short: Column, keys: list[str]) -> DataFrame:
    """Pairs id < other of a session's short clusters with a label: overlapped where they conflict, else same or different where
    both have a name given by hand (keys, id, name; one a cluster), else unlabelled. Gives keys, id, other, distance, label."""
    some = clusters.filter(short)
    pairs = _pairs(some, some, keys, "id", "other", F.col("id") < F.col("other"))
    both = _conflicts(conflicts, keys)
    pairs = pairs.join(both, [F.col(k) == F.col(f"_c{k}") for k in keys] + [F.col("id") == F.col("_a"), F.col("other") == F.col("_b")], "left")
    pairs = pairs.select(*keys, "id", "other", "distance", F.col("_c").alias("conflict"))
    pairs = pairs.join(named.select(*keys, "id", F.col("name").alias("_mine")), [*keys, "id"], "left")
    pairs = pairs.join(named.select(*keys, F.col("id").alias("other"), F.col("name").alias("_theirs")), [*keys, "other"], "left")
    label = F.when(F.col("conflict"), "overlapped").when(F.col("_mine") == F.col("_theirs"), "same").when(F.col("_mine").isNotNull() & F.col("_theirs").isNotNull(), "different").otherwise("unlabelled")
    return pairs.select(*keys, "id", "other", "distance", label.alias("label"))


def trials_of(pairs: DataFrame) -> DataFrame:
    """Labelled pairs as trials: same is true for one person, false for different and for overlapping voices; unlabelled pairs go."""
    return pairs.filter("label <> 'unlabelled'").withColumn("same", F.col("label") == "same").drop("label")


def trial_pairs(voices: DataFrame, keys: list[str], session: str, order: str, speaker: str, vector: str = "embedding") -> DataFrame:
    """Every pair of recordings within keys, later beside earlier: order, other, same (one speaker), excluded (one session) and
    distance. Pairs of one session count as excluded and have no distance; the work is the pairs of each key."""
    other = voices.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(session).alias("_session"), F.col(order).alias("other"), F.col(speaker).alias("_speaker"), F.col(vector).alias("_vector"))
    met = voices.join(other, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(order) > F.col("other")])
    excluded = F.col(session) == F.col("_session")
    return met.select(*keys, order, "other", (F.col(speaker) == F.col("_speaker")).alias("same"), excluded.alias("excluded"), F.when(~excluded, cosine_distance(F.col(vector), F.col("_vector"))).alias("distance"))


def merged_rankings(ranked: DataFrame, group: list[str], name: str = "name", similarity: str = "similarity") -> DataFrame:
    """Rankings of a group's members as one: each name at its greatest similarity, with its rank (ties: smaller name)."""
    best = ranked.groupBy(*group, name).agg(F.max(similarity).alias(similarity))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(similarity), name)))


def bundles(members: DataFrame, ranked: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Groups of two members or more: keys, group, labels in order of place, speech_s, and the name that a member resembles most
    (null without references). members: keys, group, id, place, label, speech_s; ranked: keys, id, name, similarity."""
    g = members.groupBy(*keys, group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda s: s["label"]).alias("labels"), F.sum("speech_s").alias("speech_s"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    best = merged_rankings(ranked.join(members.select(*keys, group, "id"), [*keys, "id"]), [*keys, group]).filter("rank = 1")
    return g.join(best.select(*keys, group, F.col("name").alias("best"), "similarity"), [*keys, group], "left")


def group_means(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean of each group, at length one (unit; null for a zero mean), and the mean's length."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    means = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean"))
    size = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return means.withColumn("length", size).withColumn("unit", F.when(F.col("length") > 0, normalised(F.col("mean"))))
