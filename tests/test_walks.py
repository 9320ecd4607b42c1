"""Queries over answers, denials, removals and groups against a plain walk over the same tables, written from their rules."""

from collections import defaultdict

import pytest
from oracle import TABLES

from tideline.plans import answers, naming
from tideline.plans.catalog import CUT, LOOSE, Tables

SHORT = 5.0


class Session:
    """What is known of a session, and the labels that follow from it."""

    def __init__(self, clusters, sims, edges):
        self.clusters, self.sims = clusters, sims  # id: (first_s, speech_s); (id, name): similarity
        self.rivals = defaultdict(set)
        for a, b in edges:
            self.rivals[a].add(b)
            self.rivals[b].add(a)

    def identified(self):
        best = {}
        for (i, name), sim in self.sims.items():
            best[i] = min(best.get(i, (9.0, "")), (-sim, name))
        got = {}
        for i, (minus, name) in sorted(best.items(), key=lambda x: (x[1][0], x[0])):
            if 1 + minus < CUT and not any(got.get(x) == name for x in self.rivals[i]):
                got[i] = name
        return got

    def tentative(self, named):
        got, holders = {}, defaultdict(set)
        for i, name in named.items():
            holders[name].add(i)
        for i, minus, name in sorted((i, -sim, name) for (i, name), sim in self.sims.items()):
            if self.clusters[i][1] < SHORT and 1 + minus < LOOSE and i not in named and i not in got and name in named.values() and not holders[name] & self.rivals[i]:
                got[i] = name
                holders[name].add(i)
        return got

    def by_hand(self, rows, forced, pending=None):
        stands = {i: n for i, n in rows.items() if i not in forced and not any(forced.get(x) == n for x in self.rivals[i])}
        if pending in stands and any(x < pending and stands.get(x) == stands[pending] for x in self.rivals[pending]):
            del stands[pending]
        return stands

    def labels(self, stands, forced, denied=()):
        hand, named = stands | forced, self.identified()
        guessed, out = self.tentative(named), {}
        free = lambda i, n: not any(hand.get(x) == n for x in self.rivals[i])
        for n, i in enumerate(sorted(self.clusters, key=lambda i: (self.clusters[i][0], i)), 1):
            if i in hand:
                out[i] = (hand[i], "hand")
            elif i in named and free(i, named[i]):
                out[i] = (named[i], "identified")
            elif i in guessed and free(i, guessed[i]) and (i, guessed[i]) not in denied:
                out[i] = (guessed[i], "tentative")
            else:
                out[i] = (f"Unknown {n}", "unknown")
        return out


@pytest.fixture(scope="module")
def known(spark):
    return sessions_of(spark)


def sessions_of(spark):
    """Sessions with all references, each pair's similarity, and the names that stand by hand."""
    t = Tables(spark, TABLES)
    clusters, sims, refs, edges, hand = defaultdict(dict), defaultdict(dict), defaultdict(dict), defaultdict(list), defaultdict(dict)
    for r in t.clusters().collect():
        clusters[r["session"]][r["id"]] = (r["first_s"], r["speech_s"])
    for r in answers._ranked(t).collect():
        refs[r["session"]][r["id"], r["name"], r["reference"]] = r["similarity"]
        key = (r["id"], r["name"])
        sims[r["session"]][key] = max(sims[r["session"]].get(key, -9.0), r["similarity"])
    for r in t.conflicts().collect():
        edges[r["session"]].append((r["a"], r["b"]))
    for r in answers._hand(t).collect():
        hand[r["session"]][r["id"]] = r["name"]
    return {s: (Session(clusters[s], sims[s], edges[s]), refs[s], edges[s], hand[s]) for s in clusters}


def judged(before, after, i, name):
    holder = min((x for x in after if x != i and after[x][0] == name), default=None)
    loser = min((x for x in after if x != i and before[x][1] != "unknown" and before[x][0] != after[x][0]), default=None)
    if after[i][0] != name:
        return "vetoed", holder
    return ("applied", None) if loser is None else ("taken", loser)


def test_answer_previews(spark, known):
    want = set()
    for s, (session, _, _, hand) in known.items():
        for i in session.clusters:
            if i % 17 == 0:
                name = f"spk{i % 3}"
                after = session.labels(session.by_hand(hand | {i: name}, {}, i), {})
                want.add((s, i, name, *judged(session.labels(hand, {}), after, i, name)))
    got = {(r["session"], r["id"], r["name"], r["verdict"], r["other"]) for r in answers.answer_previews(spark, TABLES).collect()}
    assert got == want and len({v for *_, v, _ in want}) > 1


def test_denial_previews(spark, known):
    want = set()
    for s, (session, _, _, hand) in known.items():
        before = session.labels(hand, {})
        denied = {(i, label) for i, (label, kind) in before.items() if kind == "tentative"}
        after = session.labels(hand, {}, denied)
        want |= {(s, i, before[i][0], after[i][0]) for i in before if before[i][0] != after[i][0]}
    assert {(r["session"], r["id"], r["label"], r["new_label"]) for r in answers.denial_previews(spark, TABLES).collect()} == want and want


def test_removal_scan(spark, known):
    want = set()
    for s, (session, refs, edges, _) in known.items():
        before = session.labels({}, {})
        for reference, owner in {(r, n) for _, n, r in refs}:
            sims = {}
            for (i, name, r), sim in refs.items():
                if r != reference:
                    sims[i, name] = max(sims.get((i, name), -9.0), sim)
            after = Session(session.clusters, sims, edges).labels({}, {})
            want |= {(reference, s, i, before[i][0], after[i][0], before[i][0] == owner) for i in before if before[i][0] != after[i][0]}
    got = {(r["reference"], r["session"], r["id"], r["label"], r["new_label"], r["depends"]) for r in answers.removal_scan(spark, TABLES).collect()}
    assert got == want and want


def test_group_answers(spark, known):
    facts = naming.group_facts(Tables(spark, TABLES))
    groups, denied, want = defaultdict(list), defaultdict(set), set()
    for r in facts[0].collect():
        groups[r["session"], r["grp"], r["authority"]].append((r["first_s"], r["id"], r["name"]))
    for r in facts[5].collect():
        denied[r["session"]].add((r["id"], r["name"]))
    for (s, grp, authority), members in groups.items():
        session, _, _, hand = known[s]
        given, done = dict(hand), {}
        for _, i, name in sorted(members):
            forced = done | {i: name} if authority else {}
            before = session.labels(session.by_hand(given, forced), forced, denied[s])
            after = session.labels(session.by_hand(given | {i: name}, forced, i), forced, denied[s])
            held = session.labels(session.by_hand(given, done), done, denied[s]) if authority else {}
            verdict, other = judged(before, after, i, name)
            want.add((s, grp, i, name, verdict, other, any(held[x][0] == name for x in session.rivals[i] if x in held)))
            if verdict == "applied":
                given, done = given | {i: name}, done | {i: name}
    got = {(r["session"], r["grp"], r["id"], r["name"], r["verdict"], r["other"], r["overridden"]) for r in naming.group_answers(spark, TABLES).collect()}
    assert got == want
    assert {r[4] for r in want} == {"applied", "vetoed", "taken"} and {r[6] for r in want} == {True, False}
