"""Constrained assignment of names to clusters, label precedence, grouping and bounded reference sets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.lineage import checkpointed


def symmetric(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    return conflicts.select(*keys, "a", "b").union(conflicts.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def award_names(claims: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """Who gets the name: claims (keys, id, name, similarity; one a cluster) walked by falling similarity, then id; a claim
    goes if its cluster conflicts with one that already got that name. conflicts: keys, a, b.

    Names whose claimants do not conflict are settled by a join; only the others go, name by name, to a grouped function.
    """
    edges = symmetric(conflicts, keys)
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    e = edges.select(*[F.col(k).alias(f"_{k}") for k in keys], "a", "b")
    rival = claims.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("id").alias("_rid"), F.col("name").alias("_rname"))
    inside = claims.join(e, on + [F.col("id") == F.col("a")]).join(rival, [F.col(k) == F.col(f"_r{k}") for k in keys] + [F.col("b") == F.col("_rid"), F.col("name") == F.col("_rname")])
    rivals = inside.groupBy(*keys, "name", "id").agg(F.collect_set("b").alias("rivals"))
    marked = claims.join(rivals, [*keys, "name", "id"], "left")
    contested = rivals.select(*keys, "name").distinct()
    free = marked.join(contested, [*keys, "name"], "left_anti").select(*keys, "id", "name", "similarity")

    def walk(pdf):
        got, rows = set(), []
        for r in pdf.sort_values(["similarity", "id"], ascending=[False, True]).itertuples():
            if r.rivals is None or not got & set(r.rivals):
                got.add(r.id)
                rows.append(r.Index)
        return pdf.loc[rows, [*keys, "id", "name", "similarity"]]

    walked = marked.join(contested, [*keys, "name"], "left_semi").select(*keys, "id", "name", "similarity", "rivals").groupBy(*keys, "name").applyInPandas(walk, free.schema)
    return free.unionByName(walked)


def tentative_names(ranked: DataFrame, awarded: DataFrame, conflicts: DataFrame, keys: list[str], cut: float) -> DataFrame:
    """Names for short clusters that have none: ranked (keys, id, name, similarity) walked by id, then falling similarity, name.

    Only names already awarded in the session count, under `cut`; a name is refused to a cluster that conflicts with one
    that has it, awarded or tentative, and the next name is tried. Worked on session by session.
    """
    edges = symmetric(conflicts, keys)
    kind = ranked.schema["similarity"].dataType.simpleString()
    parts = awarded.select(*keys, "id", "name", F.lit(None).cast(kind).alias("similarity"), F.lit(None).cast("long").alias("b"), F.lit("held").alias("what"))
    parts = parts.unionByName(ranked.join(awarded.select(*keys, "name").distinct(), [*keys, "name"], "left_semi").join(awarded.select(*keys, "id"), [*keys, "id"], "left_anti").filter(1 - F.col("similarity") < cut).select(*keys, "id", "name", "similarity", F.lit(None).cast("long").alias("b"), F.lit("try").alias("what")))
    parts = parts.unionByName(edges.select(*keys, F.col("a").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(kind).alias("similarity"), F.col("b").cast("long").alias("b"), F.lit("edge").alias("what")))

    def walk(pdf):
        holders, rivals, rows, done = {}, {}, [], set()
        for r in pdf[pdf.what == "held"].itertuples():
            holders.setdefault(r.name, set()).add(r.id)
        for r in pdf[pdf.what == "edge"].itertuples():
            rivals.setdefault(r.id, set()).add(int(r.b))
        for r in pdf[pdf.what == "try"].sort_values(["id", "similarity", "name"], ascending=[True, False, True]).itertuples():
            if r.id not in done and not holders.get(r.name, set()) & rivals.get(r.id, set()):
                done.add(r.id)
                holders.setdefault(r.name, set()).add(r.id)
                rows.append(r.Index)
        return pdf.loc[rows, [*keys, "id", "name", "similarity"]]

    return parts.groupBy(*keys).applyInPandas(walk, ranked.select(*keys, "id", "name", "similarity").schema)


def hand_awards(resolved: DataFrame, forced: DataFrame, conflicts: DataFrame, keys: list[str], order: str, pending: DataFrame | None = None) -> DataFrame:
    """Names given by hand that stand: keys, id, name. resolved: keys, id, name and order, as vectors.resolved_rows gives them;
    forced: keys, id, name; pending: keys, id of the cluster whose row an answer would add.

    A cluster's first row counts, a forced name replaces it. A row goes where its cluster conflicts with one that was forced to
    that name; the pending cluster's row goes also where it conflicts with a cluster before it (by id) that stands under that
    name. Rows that stand do not contest each other, so joins settle it without a walk.
    """
    force = forced.select(*keys, "id", "name").distinct()
    first = resolved.groupBy(*keys, "id").agg(F.min_by("name", order).alias("name")).join(force.select(*keys, "id"), [*keys, "id"], "left_anti")
    edges = symmetric(conflicts, keys)
    against = edges.join(force.withColumnRenamed("id", "b"), [*keys, "b"]).select(*keys, F.col("a").alias("id"), "name").distinct()
    stands = first.join(against, [*keys, "id", "name"], "left_anti")
    if pending is not None:
        asked = stands.join(pending.select(*keys, "id").distinct(), [*keys, "id"])
        held = edges.join(stands.withColumnRenamed("id", "b"), [*keys, "b"]).filter("b < a").select(*keys, F.col("a").alias("id"), "name").distinct()
        stands = stands.join(asked.join(held, [*keys, "id", "name"], "left_semi").select(*keys, "id"), [*keys, "id"], "left_anti")
    return force.unionByName(stands)


def names_in_session(sims: list[tuple], short: set, rivals: dict[int, set[int]], cut: float, loose: float) -> tuple[dict, dict]:
    """What award_names and tentative_names give in one session, by cluster. sims: id, name, similarity, each name's best."""
    best, awarded, holders, guessed = {}, {}, {}, {}
    for i, name, sim in sims:
        if i not in best or (-sim, name) < best[i]:
            best[i] = (-sim, name)
    for minus, i in sorted((minus, i) for i, (minus, _) in best.items() if 1 + minus < cut):
        name = best[i][1]
        if holders.setdefault(name, set()).isdisjoint(rivals.get(i, ())):
            awarded[i] = name
            holders[name].add(i)
    for i, _, name in sorted((i, -sim, name) for i, name, sim in sims if i in short and i not in awarded and name in holders and 1 - sim < loose):
        if i not in guessed and holders[name].isdisjoint(rivals.get(i, ())):
            guessed[i] = name
            holders[name].add(i)
    return awarded, guessed


def labels_in_session(order: list[int], awarded: dict, guessed: dict, rivals: dict[int, set[int]], forced: dict, hand: dict, denied: set) -> list[tuple]:
    """What labels gives in one session: id, label, kind of each cluster, by first appearance. forced, hand: a name by cluster."""
    out = []
    free = lambda i, name: name is not None and not any(forced.get(x) == name or hand.get(x) == name for x in rivals.get(i, ()))
    for n, i in enumerate(order, 1):
        name, guess = awarded.get(i), guessed.get(i)
        if i in forced:
            out.append((i, forced[i], "forced"))
        elif i in hand:
            out.append((i, hand[i], "assigned"))
        elif free(i, name):
            out.append((i, name, "identified"))
        elif free(i, guess) and (i, guess) not in denied:
            out.append((i, guess, "tentative"))
        else:
            out.append((i, f"Unknown {n}", "unknown"))
    return out


def _facts(keys: list[str], clusters: DataFrame, ranked: DataFrame, conflicts: DataFrame, floor: float, most: float, **named: DataFrame) -> DataFrame:
    """What is known of each session as rows of one table: keys, what, i, j, k, name, x, y. Null keys have clusters only."""
    null = lambda kind: F.lit(None).cast(kind)

    def part(what: str, df: DataFrame, i: str, j=None, k=None, name=None, x=None, y=None) -> DataFrame:  # noqa: ANN001
        of = lambda c, kind: null(kind) if c is None else (F.col(c) if isinstance(c, str) else c).cast(kind)
        return df.select(*keys, F.lit(what).alias("what"), of(i, "long").alias("i"), of(j, "long").alias("j"), of(k, "long").alias("k"), of(name, "string").alias("name"), of(x, "double").alias("x"), of(y, "double").alias("y"))

    # nulls come first and NaN last, as in Spark's order
    place = F.coalesce(F.nanvl(F.col("first_s").cast("double"), F.lit(float("inf"))), F.lit(float("-inf")))
    near = ranked.filter(1 - F.col("similarity") < most)
    two = "reference" in ranked.columns
    parts = [part("sim", near, "id", k="reference" if two else None, name="name", x="similarity", y="second" if two else None), part("edge", conflicts, "a", j="b")]
    parts += [part(what, df, "id", name="name") for what, df in named.items()]
    rows = part("cluster", clusters, "id", j=F.col("speech_s") < floor, x=place)
    for more in parts:
        rows = rows.unionByName(more.dropna(subset=keys))
    # a number of its own, as few bytes of a session take long to walk
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _session(table) -> tuple[dict, list[int], set, dict[int, set[int]]]:  # noqa: ANN001
    """Of the rows of one session: those of each kind, clusters by first appearance, the short ones, and whom each conflicts with."""
    of: dict[str, list] = {}
    for what, *row in zip(*(table.column(c).to_pylist() for c in ("what", "i", "j", "k", "name", "x", "y")), strict=True):
        of.setdefault(what, []).append(row)
    order = [r[0] for r in sorted(of.get("cluster", []), key=lambda r: (r[4], r[0]))]
    rivals: dict[int, set[int]] = {}
    for a, b, *_ in of.get("edge", []):
        rivals.setdefault(a, set()).add(b)
        rivals.setdefault(b, set()).add(a)
    return of, order, {r[0] for r in of.get("cluster", []) if r[1]}, rivals


def _by_cluster(of: dict[str, list], what: str) -> dict[int, str]:
    """A session's rows of one kind as a name by cluster: of several the smallest."""
    return {r[0]: r[3] for r in sorted(of.get(what, []), key=lambda r: r[3] or "", reverse=True) if r[3] is not None}


def derived_labels(clusters: DataFrame, ranked: DataFrame, hand: DataFrame, denied: DataFrame, forced: DataFrame, conflicts: DataFrame, keys: list[str], cut: float, loose: float, floor: float = 5.0) -> DataFrame:
    """The label of each cluster from the whole of what is known: clusters (keys, id, first_s, speech_s), ranked (keys, id, name,
    similarity: each name's best), hand and forced (keys, id, name: one a cluster, of several the smallest), denied (keys, id,
    name). See award_names, tentative_names and labels. Scenarios that differ in what is known are told apart by one more key.

    A session is one group, from a single shuffle, and its names are walked there; of its similarities only those that are near
    enough to count are sent, and no vectors. Ids are integers. Null similarities don't count. Gives keys, id, label, kind.
    """
    import pyarrow as pa

    def walk(table):  # noqa: ANN001, ANN202
        of, order, short, rivals = _session(table)
        found = names_in_session([(r[0], r[3], r[4]) for r in of.get("sim", [])], short, rivals, cut, loose)
        told = labels_in_session(order, *found, rivals, _by_cluster(of, "forced"), _by_cluster(of, "hand"), {(r[0], r[3]) for r in of.get("denied", [])})
        head = [pa.array([table.column(k)[0].as_py()] * len(told), table.schema.field(k).type) for k in keys]
        return pa.table([*head, pa.array([r[0] for r in told], pa.int64()), pa.array([r[1] for r in told], pa.string()), pa.array([r[2] for r in told], pa.string())], [*keys, "id", "label", "kind"])

    schema = clusters.select(*keys, F.col("id").cast("long").alias("id"), F.lit("").alias("label"), F.lit("").alias("kind")).schema
    return _facts(keys, clusters, ranked, conflicts, floor, max(cut, loose), hand=hand, denied=denied, forced=forced).groupBy(*keys).applyInArrow(walk, schema)


def label_changes(clusters: DataFrame, ranked: DataFrame, hand: DataFrame, denied: DataFrame, forced: DataFrame, conflicts: DataFrame, keys: list[str], cut: float, loose: float, floor: float = 5.0, without: str | None = None, refused: bool = False) -> DataFrame:
    """What changed_labels gives between what derived_labels gives and what it would give without the references of one name
    (without), with the tentative labels refused (refused), or both: keys, id, label, new_label. The rest as in derived_labels.

    Both labellings are walked in a session's one group, from a single shuffle, and only changed labels leave it.
    """
    import pyarrow as pa

    def walk(table):  # noqa: ANN001, ANN202
        of, order, short, rivals = _session(table)
        sims, denials = [(r[0], r[3], r[4]) for r in of.get("sim", [])], {(r[0], r[3]) for r in of.get("denied", [])}
        by_force, by_hand = _by_cluster(of, "forced"), _by_cluster(of, "hand")
        found = names_in_session(sims, short, rivals, cut, loose)
        before, later = labels_in_session(order, *found, rivals, by_force, by_hand, denials), {}
        if without is not None:
            # a null name is not known to be another one
            found = names_in_session([r for r in sims if r[1] is not None and r[1] != without], short, rivals, cut, loose)
        if refused:
            denials |= {(i, label) for i, label, kind in before if kind == "tentative"}
        for i, label, _ in labels_in_session(order, *found, rivals, by_force, by_hand, denials):
            later.setdefault(i, []).append(label)
        out = [(i, label, new) for i, label, _ in before if i is not None for new in later[i] if new != label]
        head = [pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in keys]
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.table([*head, *(pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds))], [*keys, "id", "label", "new_label"])

    schema = clusters.select(*keys, F.col("id").cast("long").alias("id"), F.lit("").alias("label"), F.lit("").alias("new_label")).schema
    some = clusters.dropna(subset=keys)  # null keys meet nothing in changed_labels
    return _facts(keys, some, ranked, conflicts, floor, max(cut, loose), hand=hand, denied=denied, forced=forced).groupBy(*keys).applyInArrow(walk, schema)


def answer_verdicts(answers: DataFrame, clusters: DataFrame, ranked: DataFrame, hand: DataFrame, conflicts: DataFrame, keys: list[str], cut: float, loose: float, floor: float = 5.0) -> DataFrame:
    """What each answer (keys, id, name) would do to its session as it is, apart from the others: see judged_answers. hand: names
    given by hand that stand; an answer replaces its cluster's one, and stands as the pending row of hand_awards does. clusters,
    ranked, conflicts and the rules as in derived_labels; nothing is forced or denied.

    All answers of a session are tried in its one group, from a single shuffle. They don't change which names are near, so these
    are walked once; no session is copied for an answer, and only verdicts leave the group. Null ids and names are left out,
    null keys are no session. Gives keys, id, name, verdict, other.
    """
    import pyarrow as pa

    def walk(table):  # noqa: ANN001, ANN202
        of, order, short, rivals = _session(table)
        found, standing = names_in_session([(r[0], r[3], r[4]) for r in of.get("sim", [])], short, rivals, cut, loose), _by_cluster(of, "hand")
        label = lambda held: {i: (label, kind) for i, label, kind in labels_in_session(order, *found, rivals, {}, held, set())}
        before, out = label(standing), []
        for i, _, _, name, *_ in of.get("answer", []):
            held = standing | {i: name}
            if any(x < i and held.get(x) == name for x in rivals.get(i, ())):
                del held[i]
            after = label(held)
            holder = min((x for x in after if x != i and after[x][0] == name), default=None)
            loser = min((x for x in after if x != i and before[x][1] != "unknown" and before[x][0] != after[x][0]), default=None)
            out.append((i, name, *(("vetoed", holder) if i not in after or after[i][0] != name else ("taken", loser) if loser is not None else ("applied", None))))
        head = [pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in keys]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.table([*head, *(pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds))], [*keys, "id", "name", "verdict", "other"])

    schema = clusters.select(*keys, F.col("id").cast("long").alias("id"), F.lit("").alias("name"), F.lit("").alias("verdict"), F.lit(None).cast("long").alias("other")).schema
    asked, edges = answers.dropna(subset=["id", "name"]), conflicts.dropna(subset=["a", "b"])
    return _facts(keys, clusters, ranked, edges, floor, max(cut, loose), hand=hand, answer=asked).groupBy(*keys).applyInArrow(walk, schema)


def judged_answers(answers: DataFrame, corrected: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What an answer would do: answers (keys, id, name), the labels (keys, id, label, kind) once wrong references are gone and
    once the answer is in. Gives keys, id, name, verdict and other: vetoed where the cluster does not take the name (other is
    the smallest cluster that has it), taken where another named cluster loses its name (the smallest), else applied."""
    mine = after.select(*keys, "id", F.col("label").alias("_now"))
    lost = corrected.filter("kind <> 'unknown'").join(after.select(*keys, "id", F.col("label").alias("_now")), [*keys, "id"]).filter("label <> _now").select(*keys, F.col("id").alias("_lost"))
    a = answers.select(*keys, "id", "name").join(mine, [*keys, "id"], "left")
    holder = a.join(after.select(*keys, F.col("id").alias("_held"), F.col("label").alias("_label")), keys).filter("_held <> id AND _label = name").groupBy(*keys, "id").agg(F.min("_held").alias("_holder"))
    loser = a.join(lost, keys).filter("_lost <> id").groupBy(*keys, "id").agg(F.min("_lost").alias("_loser"))
    out = a.join(holder, [*keys, "id"], "left").join(loser, [*keys, "id"], "left")
    verdict = F.when(~F.col("_now").eqNullSafe(F.col("name")), "vetoed").when(F.col("_loser").isNotNull(), "taken").otherwise("applied")
    return out.select(*keys, "id", "name", verdict.alias("verdict"), F.when(verdict == "vetoed", F.col("_holder")).when(verdict == "taken", F.col("_loser")).alias("other"))


def folded_answers(answers: DataFrame, derive, conflicts: DataFrame, keys: list[str], authority: Column | None = None) -> DataFrame:  # noqa: ANN001
    """What a group's answers would do one after the other: answers (keys, id, name, first_s), a group for each value of keys.

    Members go by first_s, then id, each judged (see judged_answers) against what the applied ones before it left; a refused one
    changes nothing. In groups where authority (a condition on keys) holds, the applied members and the one at hand are forced to
    their name, and overridden says that a cluster heard with it had that name before. derive(groups, given, forced, pending)
    gives labels (keys, side, id, label, kind) of groups (keys, side), where given, forced and pending (keys, side, id, name) are
    the answers so far, those forced, and the one added; side tells apart what is known before, after, and before anything forced.

    Each step labels all groups that have a member left at once, so there are as many steps as the longest group has members;
    their number is all that reaches the driver. A cluster answered twice in a group counts once, with its smallest name and
    first_s; null ids and names are left out; without answers there are no rows. Gives keys, id, name, verdict, other, overridden.
    """
    by_hand = F.lit(False) if authority is None else F.coalesce(authority, F.lit(False))
    once = answers.filter("id IS NOT NULL AND name IS NOT NULL").groupBy(*keys, "id").agg(F.min("name").alias("name"), F.min("first_s").alias("first_s"))
    line = checkpointed(once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("first_s", "id"))))
    edges, done = symmetric(conflicts, keys), line.limit(0).select(*keys, "id", "name")
    steps = done.select("*", F.lit("").alias("verdict"), F.col("id").alias("other"), F.lit(False).alias("overridden"))
    on = lambda df, *sides: df.withColumn("side", F.explode(F.array(*map(F.lit, sides)))).select(*keys, "side", *[c for c in df.columns if c not in keys])
    for n in range(1, (line.agg(F.max("_n")).first()[0] or 0) + 1):
        one = line.filter(F.col("_n") == n).select(*keys, "id", "name")
        groups = one.select(*keys)
        before = done.join(groups, keys, "left_semi")
        given = on(before, "before", "after", "held").unionByName(on(one, "after"))
        forced = on(before, "before", "after", "held").unionByName(on(one, "before", "after")).filter(by_hand)
        sides = on(groups, "before", "after").unionByName(on(groups.filter(by_hand), "held"))
        labelled = checkpointed(derive(sides, given, forced, on(one, "after")).select(*keys, "side", "id", "label", "kind"))
        side = lambda name, df=labelled: df.filter(F.col("side") == name).drop("side")
        holders = side("held").select(*keys, F.col("id").alias("b"), F.col("label").alias("name"))
        beaten = edges.join(holders, [*keys, "b"]).select(*keys, F.col("a").alias("id"), "name", F.lit(True).alias("_beaten")).distinct()
        judged = judged_answers(one, side("before"), side("after"), keys).join(beaten, [*keys, "id", "name"], "left")
        step = checkpointed(judged.select(*keys, "id", "name", "verdict", "other", F.coalesce("_beaten", F.lit(False)).alias("overridden")))
        done = done.unionByName(step.filter("verdict = 'applied'").select(*keys, "id", "name"))
        steps = steps.unionByName(step)
    return steps


def walked_answers(answers: DataFrame, clusters: DataFrame, hand: DataFrame, identified: DataFrame, tentative: DataFrame, denied: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """What folded_answers gives, from what is known of a session, in one task for it: answers (keys, grp, id, name, first_s,
    authority boolean), clusters (keys, id, first_s), hand (keys, id, name and ord: rows given by hand before), identified, tentative
    and denied (keys, id, name), conflicts (keys, a, b). Answers don't change who is identified; see labels for what they change.

    An answer replaces its cluster's rows given by hand. All groups of a session are walked beside each other's state, each from
    the session as it is. Work and memory of a task are those of a session: its clusters, conflicts and answers, no vectors. A
    group has authority where any of its answers says so. Nulls, repeated answers and empty tables as in folded_answers; null
    keys are no session. Gives keys, grp, id, name, verdict, other, overridden.
    """
    null = lambda kind: F.lit(None).cast(kind)

    def part(what: str, df: DataFrame, i: str = "id", j=None, name: str | None = "name", at: str | None = None, grp=None, sure=None) -> DataFrame:  # noqa: ANN001
        return df.select(
            *keys, F.lit(what).alias("what"), F.col(i).cast("long").alias("i"), (null("long") if j is None else F.col(j).cast("long")).alias("j"), (null("string") if name is None else F.col(name).cast("string")).alias("name"),
            (null("double") if at is None else F.col(at).cast("double")).alias("at"), (null("long") if grp is None else F.col(grp).cast("long")).alias("grp"), (null("boolean") if sure is None else F.col(sure)).alias("sure"),
        )

    rows = part("answer", answers.filter("id IS NOT NULL AND name IS NOT NULL"), at="first_s", grp="grp", sure="authority")
    for more in (part("cluster", clusters, name=None, at="first_s"), part("hand", hand, j="ord"), part("identified", identified), part("tentative", tentative), part("denied", denied), part("edge", conflicts, i="a", j="b", name=None)):
        rows = rows.unionByName(more)
    asked = answers.select(*keys).distinct()

    def walk(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        of = {what: list(g.itertuples()) for what, g in pdf.groupby("what")}
        order = [int(r.i) for r in sorted(of.get("cluster", []), key=lambda r: (r.at, r.i))]
        unknown = {i: f"Unknown {n}" for n, i in enumerate(order, 1)}
        standing: dict[int, str] = {}
        for r in sorted(of.get("hand", []), key=lambda r: r.j):
            standing.setdefault(int(r.i), r.name)
        known = {what: {int(r.i): r.name for r in of.get(what, [])} for what in ("identified", "tentative")}
        refused = {(int(r.i), r.name) for r in of.get("denied", [])}
        rivals: dict[int, set[int]] = {}
        for r in of.get("edge", []):
            rivals.setdefault(int(r.i), set()).add(int(r.j))
            rivals.setdefault(int(r.j), set()).add(int(r.i))
        meets = lambda i, name, holders: any(holders.get(x) == name for x in rivals.get(i, ()))

        def labelled(given: dict[int, str], forced: dict[int, str], pending: int | None) -> dict[int, tuple[str, bool]]:
            """Each cluster's label, and whether it is a name."""
            stands = {i: n for i, n in given.items() if i not in forced and not meets(i, n, forced)}
            if pending in stands and any(x < pending and stands.get(x, forced.get(x)) == stands[pending] for x in rivals.get(pending, ())):
                del stands[pending]
            held = stands | forced
            out = {}
            for i in order:
                name = held.get(i)
                for what in ("identified", "tentative"):
                    guess = known[what].get(i)
                    if name is None and guess is not None and not meets(i, guess, held) and not (what == "tentative" and (i, guess) in refused):
                        name = guess
                out[i] = (unknown[i], False) if name is None else (name, True)
            return out

        out = []
        groups: dict[int, dict[int, list]] = {}
        sure: set[int] = set()
        for r in of.get("answer", []):
            seen = groups.setdefault(int(r.grp), {}).setdefault(int(r.i), [r.name, r.at])
            seen[0] = min(seen[0], r.name)
            seen[1] = r.at if seen[1] != seen[1] else min(seen[1], r.at) if r.at == r.at else seen[1]
            if r.sure is True or r.sure == 1:
                sure.add(int(r.grp))
        for grp, members in groups.items():
            given, done = dict(standing), {}
            for i, (name, _) in sorted(members.items(), key=lambda m: (m[1][1] == m[1][1], m[1][1] if m[1][1] == m[1][1] else 0.0, m[0])):
                forced = done | {i: name} if grp in sure else {}
                before, after = labelled(given, forced, None), labelled(given | {i: name}, forced, i)
                beaten = grp in sure and any(lab == name for x, (lab, _) in labelled(given, done, None).items() if x in rivals.get(i, ()))
                holder = min((x for x in order if x != i and after[x][0] == name), default=None)
                loser = min((x for x in order if x != i and before[x][1] and after[x][0] != before[x][0]), default=None)
                verdict, other = ("vetoed", holder) if i not in after or after[i][0] != name else ("taken", loser) if loser is not None else ("applied", None)
                if verdict == "applied":
                    given[i], done[i] = name, name
                out.append((grp, i, name, verdict, other, beaten))
        told = pd.DataFrame(out, columns=["grp", "id", "name", "verdict", "other", "overridden"]).astype({"other": "Int64"})
        for k in reversed(keys):
            told.insert(0, k, pdf[k].iloc[0])
        return told

    schema = answers.select(*keys).schema
    for name, kind in (("grp", "long"), ("id", "long"), ("name", "string"), ("verdict", "string"), ("other", "long"), ("overridden", "boolean")):
        schema = schema.add(name, kind)
    return rows.join(asked, keys, "left_semi").groupBy(*keys).applyInPandas(walk, schema)


def best_two(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Each name's best reference for a cluster (ties: the smaller), its similarity, and that of the next one (second), from
    ranked: keys, id, name, reference, similarity of every pair."""
    order = Window.partitionBy(*keys, "id", "name").orderBy(F.desc("similarity"), "reference")
    two = ranked.withColumn("_n", F.row_number().over(order)).filter("_n <= 2").groupBy(*keys, "id", "name")
    return two.agg(F.max(F.when(F.col("_n") == 1, F.col("reference"))).alias("reference"), F.max("similarity").alias("similarity"), F.max(F.when(F.col("_n") == 2, F.col("similarity"))).alias("second"))


def without_each(ranked: DataFrame, keys: list[str], loose: float) -> DataFrame:
    """Rankings as they would be without each single reference: scenario (the reference left out), keys, id, name, similarity.

    ranked: keys, id, name, reference, similarity of every pair. Leaving a reference out changes a name's best similarity only
    for those clusters that it is the best of, so a session is worked out again only for references that are within `loose`
    of one of its clusters and the best of their name there; others give no rows, as nothing changes.
    """
    two = best_two(ranked, keys)
    touched = two.filter(1 - F.col("similarity") < loose).select(*keys, F.col("reference").alias("scenario")).distinct()
    out = two.join(touched, keys)
    return out.select("scenario", *keys, "id", "name", F.when(F.col("reference") == F.col("scenario"), F.col("second")).otherwise(F.col("similarity")).alias("similarity")).filter("similarity IS NOT NULL")


def removal_changes(clusters: DataFrame, two: DataFrame, conflicts: DataFrame, keys: list[str], cut: float, loose: float, floor: float = 5.0) -> DataFrame:
    """What changes without each single reference, where nothing is given by hand: reference, keys, id, label, new_label. two: what
    best_two gives; clusters, conflicts and the rules as in derived_labels.

    Only references that are near enough to count and the best of their name for one of a session's clusters change anything
    there. All of them are tried in the session's one group, over its rankings as they are, so no ranking is copied for a
    reference, and only changed labels leave the group.
    """
    import pyarrow as pa

    def walk(table):  # noqa: ANN001, ANN202
        of, order, short, rivals = _session(table)
        sims = of.get("sim", [])
        label = lambda awarded, guessed: labels_in_session(order, awarded, guessed, rivals, {}, {}, set())
        awarded, guessed = names_in_session([(i, name, sim) for i, _, _, name, sim, _ in sims], short, rivals, cut, loose)
        before, out, most = label(awarded, guessed), [], {}
        for i, _, _, name, sim, _ in sims:
            most[i] = min(most.get(i, (float("inf"), "")), (-sim, name))
        held = set(awarded.values())
        # without the others no cluster's nearest name changes, and none that is tried
        for reference in {best for i, _, best, name, _, _ in sims if most[i][1] == name or (i in short and i not in awarded and name in held)}:
            left = [(i, name, second if best == reference else sim) for i, _, best, name, sim, second in sims]
            after = label(*names_in_session([r for r in left if r[2] is not None], short, rivals, cut, loose))
            out += [(reference, was[0], was[1], now[1]) for was, now in zip(before, after, strict=True) if was[1] != now[1]]
        head = [pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in keys]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        told = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
        return pa.table([told[0], *head, *told[1:]], ["reference", *keys, "id", "label", "new_label"])

    schema = clusters.select(F.lit(0).cast("long").alias("reference"), *keys, F.col("id").cast("long").alias("id"), F.lit("").alias("label"), F.lit("").alias("new_label")).schema
    return _facts(keys, clusters, two, conflicts, floor, max(cut, loose)).groupBy(*keys).applyInArrow(walk, schema)


def labels(clusters: DataFrame, forced: DataFrame, assigned: DataFrame, identified: DataFrame, tentative: DataFrame, denied: DataFrame, conflicts: DataFrame, keys: list[str], one_speaker: DataFrame | None = None) -> DataFrame:
    """The label of each cluster (keys, id, first_s) by precedence: the session's one speaker (one_speaker: keys, name), forced,
    assigned by hand, identified, tentative, Unknown N.

    Where a session is said to have one speaker, every cluster is theirs and reads as assigned, conflicts or not; of several
    names the smallest counts. An identified or tentative name gives way where the cluster conflicts with one that was assigned that name by hand; a
    tentative one also where it was denied. Unknown voices are numbered by their first appearance. Gives label and kind.
    """
    hand = forced.select(*keys, "id", "name").union(assigned.select(*keys, "id", "name")).distinct()
    edges = symmetric(conflicts, keys)
    taken = edges.join(hand.withColumnRenamed("id", "b"), [*keys, "b"]).select(*keys, F.col("a").alias("id"), "name").distinct()
    named = lambda df, kind: df.select(*keys, "id", F.col("name").alias(kind))
    strict = named(identified.join(taken, [*keys, "id", "name"], "left_anti"), "identified")
    loose = named(tentative.join(taken, [*keys, "id", "name"], "left_anti").join(denied.select(*keys, "id", "name"), [*keys, "id", "name"], "left_anti"), "tentative")
    out = clusters.select(*keys, "id", "first_s")
    for part in (named(forced, "forced"), named(assigned, "assigned"), strict, loose):
        out = out.join(part, [*keys, "id"], "left")
    said = (clusters.limit(0).select(*keys, F.lit("").alias("name")) if one_speaker is None else one_speaker).groupBy(*keys).agg(F.min("name").alias("_one"))
    out = out.join(said, keys, "left").withColumn("assigned", F.coalesce("_one", "assigned")).withColumn("forced", F.when(F.col("_one").isNull(), F.col("forced")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("first_s", "id"))
    kind = F.when(F.col("forced").isNotNull(), "forced").when(F.col("assigned").isNotNull(), "assigned").when(F.col("identified").isNotNull(), "identified").when(F.col("tentative").isNotNull(), "tentative").otherwise("unknown")
    return out.withColumn("_n", n).select(*keys, "id", F.coalesce("forced", "assigned", "identified", "tentative", F.concat(F.lit("Unknown "), F.col("_n"))).alias("label"), kind.alias("kind"))


def changed_labels(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters that both sides label, differently: keys, id, label, new_label."""
    return before.select(*keys, "id", "label").join(after.select(*keys, "id", F.col("label").alias("new_label")), [*keys, "id"]).filter(F.col("label") != F.col("new_label"))


def linkage_groups(pool: DataFrame, pairs: DataFrame, conflicts: DataFrame, keys: list[str], cut: float) -> DataFrame:
    """Constrained single linkage: pool (keys, pos, id), pairs (keys, i, j positions, distance), conflicts (keys, a, b ids).

    Pairs under the cut are merged by distance, then i, then j, unless any two members across them conflict. Gives keys,
    id and group (its smallest id). Pairs over the cut never leave the JVM.
    """
    close = pairs.filter((F.col("distance") < cut) & ~F.isnan("distance"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = pool.select(*keys, F.lit("member").alias("what"), F.col("pos").cast("long").alias("i"), F.col("id").cast("long").alias("j"), null("double").alias("d"))
    rows = rows.unionByName(close.select(*keys, F.lit("pair").alias("what"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("distance").cast("double").alias("d")))
    rows = rows.unionByName(conflicts.select(*keys, F.lit("edge").alias("what"), F.col("a").cast("long").alias("i"), F.col("b").cast("long").alias("j"), null("double").alias("d")))

    def merge(pdf):
        import pandas as pd

        member = {r.i: r.j for r in pdf[pdf.what == "member"].itertuples()}
        edge = {x for r in pdf[pdf.what == "edge"].itertuples() for x in ((r.i, r.j), (r.j, r.i))}
        group = {p: {p} for p in member}
        for r in pdf[pdf.what == "pair"].sort_values(["d", "i", "j"]).itertuples():
            a, b = group.get(r.i), group.get(r.j)
            if a is None or b is None or a is b or any((member[x], member[y]) in edge for x in a for y in b):
                continue
            a |= b
            for x in b:
                group[x] = a
        first = pdf[keys].iloc[0]
        return pd.DataFrame([{**first, "id": member[p], "group": min(member[x] for x in g)} for p, g in group.items()], columns=[*keys, "id", "group"])

    schema = pool.select(*keys, F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("group")).schema
    return rows.groupBy(*keys).applyInPandas(merge, schema)


def reservoir(offers: DataFrame, capacity: int = 10) -> DataFrame:
    """A name's references after its offers in order (name, ord, embedding, clip_s): an equal vector changes nothing; below
    capacity an offer is added; else it replaces the shortest timed clip if strictly longer.

    The outcome depends on the order, so a name's offers are walked one by one; the walk sees a number for each vector, not the
    vectors, and of offers that follow each other with one vector only the first, as those after it change nothing unless
    it was refused: a refused one is tried again if longer, so the longest of such a run stays too.
    """
    w = Window.partitionBy("name").orderBy("ord")
    o = offers.withColumn("_v", F.xxhash64("embedding"))
    o = o.withColumn("_run", F.sum(F.when(F.col("_v").eqNullSafe(F.lag("_v").over(w)), 0).otherwise(1)).over(w))
    longer = F.max("clip_s").over(Window.partitionBy("name", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("_m", longer).filter(F.col("_m").isNull() | (F.col("clip_s") > F.col("_m")))

    def fold(pdf):
        held = []
        for r in pdf.sort_values("ord").itertuples():
            if any(r.vector == h.vector for h in held):
                continue
            if len(held) < capacity:
                held.append(r)
                continue
            timed = [h for h in held if h.clip_s == h.clip_s and h.clip_s is not None]
            if timed and r.clip_s is not None and r.clip_s == r.clip_s:
                least = min(timed, key=lambda h: (h.clip_s, h.ord))
                if r.clip_s > least.clip_s:
                    held[held.index(least)] = r
        return pdf.loc[[h.Index for h in held], ["name", "ord", "clip_s"]]

    return o.select("name", "ord", "clip_s", F.col("_v").alias("vector")).groupBy("name").applyInPandas(fold, offers.select("name", "ord", "clip_s").schema)
