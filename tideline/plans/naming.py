"""SQL of queries whose names depend on an order, by recursion, and queries over answers to groups and sessions of one speaker."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import assign
from tideline.plans import answers
from tideline.plans.catalog import _BOTH, _CL, _REF, _SQL, LOOSE, SESSION_IDS, Tables, _awarded, _tentative, query


def awarded_sql(references: str = _REF) -> str:
    """Names awarded from a set of references."""
    return f"({_SQL['awarded_names'].replace(_REF, references)})"


def tentative_sql(references: str = _REF) -> str:
    """A walk over each session's tries by id, falling similarity and name; it knows who holds a name and who was named."""
    return (
        f"(WITH RECURSIVE aw AS (SELECT session, id, name FROM {awarded_sql(references)}),"
        f" sm AS (SELECT c.session, c.id, r.name, max(list_inner_product(c.embedding::DOUBLE[], r.rv::DOUBLE[])) AS sim FROM {_CL} c, {references} r WHERE c.speech_s < 5 GROUP BY ALL),"
        f" rv AS (SELECT session, a AS id, list(b) AS rivals FROM {_BOTH} GROUP BY ALL),"
        f" t AS (SELECT sm.*, coalesce(rivals, []) AS rivals, row_number() OVER (PARTITION BY sm.session ORDER BY sm.id, sim DESC, sm.name) AS n FROM sm LEFT JOIN rv USING (session, id) WHERE 1 - sim < {LOOSE} AND EXISTS (SELECT 1 FROM aw WHERE aw.session = sm.session AND aw.name = sm.name) AND NOT EXISTS (SELECT 1 FROM aw WHERE aw.session = sm.session AND aw.id = sm.id)),"
        f" h AS (SELECT session, list({{'name': name, 'id': id}}) AS held FROM aw GROUP BY session),"
        f" w AS (SELECT DISTINCT t.session, 0::BIGINT AS n, h.held, []::STRUCT(id BIGINT, name VARCHAR, sim DOUBLE)[] AS got FROM t JOIN h ON h.session = t.session"
        f" UNION ALL SELECT session, n, CASE WHEN ok THEN list_append(held, {{'name': name, 'id': id}}) ELSE held END, CASE WHEN ok THEN list_append(got, {{'id': id, 'name': name, 'sim': sim}}) ELSE got END"
        f" FROM (SELECT w.session, t.n, t.id, t.name, t.sim, held, got, len(list_filter(got, lambda g: g.id = t.id)) = 0 AND len(list_filter(held, lambda x: x.name = t.name AND list_contains(t.rivals, x.id))) = 0 AS ok FROM w JOIN t ON t.session = w.session AND t.n = w.n + 1))"
        f" SELECT session, g.id AS id, g.name AS name, round(g.sim, 6) AS similarity FROM (SELECT session, unnest(arg_max(got, n)) AS g FROM w GROUP BY session))"
    )


def labels_sql(references: str = _REF, one: str = "SELECT NULL::BIGINT AS session, NULL AS name WHERE false") -> str:
    """Every cluster's label by precedence, over the rows given by hand, denied and forced that the catalog's _labels has."""
    hand = f"(SELECT session, id, CASE WHEN id % 59 = 0 THEN 'Forced' ELSE 'Hand' END AS name FROM {_CL} WHERE id % 59 = 0 OR id % 37 = 0)"
    both = f"(SELECT session, id, 'Forced' AS name FROM {_CL} WHERE id % 59 = 0 UNION SELECT session, id, 'Hand' FROM {_CL} WHERE id % 37 = 0)"
    free = f"NOT EXISTS (SELECT 1 FROM {_BOTH} e JOIN {both} h ON h.id = e.b WHERE e.a = g.id AND h.name = g.name)"
    return (
        f"(SELECT c.session, c.id, coalesce(o.name, h.name, i.name, t.name, 'Unknown ' || row_number() OVER (PARTITION BY c.session ORDER BY c.first_s, c.id)) AS label,"
        f" CASE WHEN o.name IS NOT NULL THEN 'assigned' WHEN h.name = 'Forced' THEN 'forced' WHEN h.name IS NOT NULL THEN 'assigned' WHEN i.name IS NOT NULL THEN 'identified' WHEN t.name IS NOT NULL THEN 'tentative' ELSE 'unknown' END AS kind"
        f" FROM {_CL} c LEFT JOIN ({one}) o ON o.session = c.session LEFT JOIN {hand} h ON h.id = c.id"
        f" LEFT JOIN (SELECT * FROM {awarded_sql(references)} g WHERE {free}) i ON i.id = c.id"
        f" LEFT JOIN (SELECT g.* FROM {tentative_sql(references)} g JOIN {_CL} k ON k.id = g.id WHERE {free} AND NOT (g.id % 11 = 0 AND g.name = 'spk' || k.label)) t ON t.id = c.id)"
    )


_LESS = _REF.replace("FROM embeddings WHERE", "FROM embeddings WHERE label <> 3 AND")
_ONE_SPEAKER = f"SELECT DISTINCT session, 'Solo ' || session % 2 AS name FROM {_CL} WHERE session % 5 = 4"

_SQL["tentative_names"] = f"SELECT * FROM {tentative_sql()}"
_SQL["effective_labels"] = f"SELECT * FROM {labels_sql()}"
_SQL["labels_without_a_name"] = f"SELECT a.session, a.id, a.label, b.label AS new_label FROM {labels_sql()} a JOIN {labels_sql(_LESS)} b ON a.id = b.id WHERE a.label <> b.label"
_SQL["linkage_groups"] = (
    f"WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_s, id) AS pos FROM {_CL} WHERE speech_s < 6),"
    " d AS (SELECT a.session, a.pos AS i, b.pos AS j, 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM c a JOIN c b ON a.session = b.session AND a.pos < b.pos),"
    " p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY dist, i, j) AS n FROM d WHERE dist < 0.8),"
    f" e AS (SELECT x.session, list({{'i': x.pos, 'j': y.pos}}) AS edges FROM {_BOTH} b JOIN c x ON x.id = b.a JOIN c y ON y.id = b.b GROUP BY x.session),"
    " w AS (SELECT c.session, 0::BIGINT AS n, range(1, count(*)::BIGINT + 1) AS lab, coalesce(any_value(edges), []) AS edges FROM c LEFT JOIN e ON e.session = c.session GROUP BY c.session"
    " UNION ALL SELECT w.session, p.n, CASE WHEN lab[p.i] = lab[p.j] OR len(list_filter(edges, lambda x: lab[x.i] = lab[p.i] AND lab[x.j] = lab[p.j])) > 0 THEN lab ELSE list_transform(lab, lambda x: CASE WHEN x = lab[p.j] THEN lab[p.i] ELSE x END) END, edges FROM w JOIN p ON p.session = w.session AND p.n = w.n + 1),"
    " g AS (SELECT session, generate_subscripts(lab, 1) AS pos, unnest(lab) AS lab FROM (SELECT session, arg_max(lab, n) AS lab FROM w GROUP BY session))"
    " SELECT c.session, c.id, min(c.id) OVER (PARTITION BY c.session, g.lab) AS \"group\" FROM c JOIN g ON g.session = c.session AND g.pos = c.pos"
)


@query(f"SELECT * FROM {labels_sql(one=_ONE_SPEAKER)}")
def precedence_labels(spark, sf_dir):
    """All six sources of a label; every fifth session is said to have one speaker."""
    t = Tables(spark, sf_dir)
    c = t.clusters()
    hand = c.filter("id % 37 = 0").select("session", "id", F.lit("Hand").alias("name"))
    denied = c.filter("id % 11 = 0").select("session", "id", F.concat(F.lit("spk"), F.col("label")).alias("name"))
    forced = c.filter("id % 59 = 0").select("session", "id", F.lit("Forced").alias("name"))
    one = c.filter("session % 5 = 4").select("session", F.concat(F.lit("Solo "), F.col("session") % 2).alias("name")).distinct()
    return assign.labels(c, forced, hand, _awarded(t), _tentative(t), denied, t.conflicts(), ["session"], one)


def group_facts(t: Tables):
    """Four groups a session, of every tenth cluster and its neighbour; groups of odd number have authority."""
    c = t.clusters()
    of = F.floor(F.col("id") % SESSION_IDS / 10)
    a = c.filter("id % 10 IN (0, 1, 3, 4)").select("session", of.alias("grp"), "id", F.concat(F.lit("spk"), of % 3).alias("name"), "first_s", (of % 2 == 1).alias("authority"))
    denied = c.filter("id % 11 = 0").select("session", "id", F.concat(F.lit("spk"), F.col("label")).alias("name"))
    return a, c, answers._hand(t).withColumn("ord", F.lit(0)), _awarded(t).select("session", "id", "name"), _tentative(t).select("session", "id", "name"), denied, t.conflicts()


@query()
def group_answers(spark, sf_dir):
    """What each group's answers would do one after the other, over all sessions."""
    return assign.walked_answers(*group_facts(Tables(spark, sf_dir)), ["session"])
