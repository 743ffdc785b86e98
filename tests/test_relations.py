"""Groups merged, singletons linked and spelling written back, against plain loops."""

import random
import re
from collections import defaultdict

from filequarry.operators import naming, relations


def stem_of(name):
    return re.sub(r"^(.+)\.[^.]+$", r"\1", name)


def plain_merge(groups, members):
    out_groups, out_members = [], []
    for session in sorted({g[0] for g in groups}):
        own = sorted(g for g in groups if g[0] == session)
        of = {g[1]: sorted((m[2], m[3], m[4]) for m in members if m[:2] == (session, g[1])) for g in own}
        prefixes = defaultdict(list)
        for g in own:
            found = [p[0] for m in of[g[1]] if (p := re.match(r"\d+(?:\.\d+)*", stem_of(m[1])))]
            if len(found) >= 2 and len(set(found)) == 1:
                prefixes[found[0]].append(g)
        follow, gone = {}, set()
        for same in prefixes.values():
            order = sorted(same, key=lambda g: (not any(m[2] == "source" for m in of[g[1]]), -len(of[g[1]]), g[1]))
            follow[order[0][1]] = order[1:]
            gone |= {g[1] for g in order[1:]}
        for no, g in enumerate((g for g in own if g[1] not in gone), 1):
            rest = follow.get(g[1], [])
            seen = {}
            for h in [g, *rest]:
                for _, name, role in of[h[1]]:
                    seen.setdefault(name, role)
            reason = g[3] or ""
            extra = [h[3] for h in rest if h[3]]
            if extra:
                reason = " | ".join([reason, *extra]).strip(" |")[:500]
            out_groups.append((session, no, g[1], g[2], reason, g[4], len(seen)))
            out_members += [(session, no, k, name, role) for k, (name, role) in enumerate(seen.items(), 1)]
    return sorted(out_groups), sorted(out_members)


def test_merge_equals_plain_loop(spark):
    rng = random.Random(3)
    groups, members = [], []
    for session in ("s1", "s2"):
        for g in range(40):
            groups.append((session, g, f"label {g}", rng.choice([None, "", "why", "long " * 60]), rng.choice([0.3, 0.7])))
            lead = rng.choice(["10.8", "10.8", "12", "", "7"])
            for k in range(rng.randint(0, 5)):
                members.append((session, g, k, f"{lead}-{rng.choice('abcdef')}{rng.choice(['.pdf', '.dwg', ''])}", rng.choice(["source", "export", "sibling"])))
    g, m = relations.merged_groups(
        spark.createDataFrame(groups, "session_id string, group_id long, label string, reason string, confidence double"),
        spark.createDataFrame(members, "session_id string, group_id long, place long, filename string, role string"),
    )
    want_groups, want_members = plain_merge(groups, members)
    assert sorted(map(tuple, m.collect())) == want_members
    assert sorted(map(tuple, g.collect())) == want_groups
    assert len(want_groups) < len(groups)


def plain_links(alone, groups):
    for i, session, stem in alone:
        stem = stem.lower()
        number, word = re.match(r"\d+", stem), re.search(r"\b([a-z]{4,})\b", stem)
        for _, g, label, sure in sorted(g for g in groups if g[0] == session):
            label = label.lower()
            if sure >= 0.5 and (number and number[0] in label or word and label.startswith(word[1])):
                yield i, session, g, "sibling"
                break


def test_links_equal_plain_loop(spark):
    rng = random.Random(5)
    words = ["project", "font", "fonts", "Fonts", "plan", "10", "108", "2010", "8", "é", "cafés", "x1"]
    make = lambda: rng.choice(["", "_", "-", " ", "."]).join(rng.choices(words, k=rng.randint(1, 4)))
    alone = [(i, rng.choice(["a", "b"]), make()) for i in range(300)] + [(900, "a", "10.8_drawing"), (901, "a", ""), (902, "c", "fonts")]
    groups = [(rng.choice(["a", "b"]), k, make(), rng.choice([0.3, 0.5, 0.9])) for k in range(25)] + [("a", 99, "project_10_8", 0.5)]
    got = relations.link_singletons(spark.createDataFrame(alone, "id long, session_id string, stem string"), spark.createDataFrame(groups, "session_id string, group_id long, label string, confidence double"))
    rows = sorted(map(tuple, got.select("id", "session_id", "group_id", "role").collect()))
    assert rows == sorted(plain_links(alone, groups))
    assert any(r[0] == 900 for r in rows)


def test_respelling_equals_substitution(spark):
    rng = random.Random(6)
    canonical = {"colour": "color", "grammer": "grammar", "recieve": "receive"}
    words = ["Colour", "colour", "GRAMMER", "grammar", "recieve", "recieved", "tiny", "12", "é", "color"]
    make = lambda: rng.choice(["", "_", "-", " ", "."]).join(rng.choices(words, k=rng.randint(1, 5)))
    renames = [(i, f"/r/{make()}/{make()}{rng.choice(['.txt', '', '.colour'])}") for i in range(300)]
    want = []
    for i, path in renames:
        folder, name = path.rsplit("/", 1)
        stem = stem_of(name)
        new = re.sub("[a-zA-Z]{5,}", lambda m: canonical.get(m[0].lower(), m[0]), stem)
        if new != stem:
            want.append((i, f"{folder}/{new}{name[len(stem):]}"))
    got = naming.respelled(spark.createDataFrame(renames, "file_id long, proposed_value string"), spark.createDataFrame(list(canonical.items()), "token string, canonical string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
