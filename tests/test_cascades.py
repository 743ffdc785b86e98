"""Folder renames and actions against applying them one by one."""

import random

import pytest
from filequarry.operators import actions, cascades
from filequarry.operators.scratch import ranked
from pyspark.sql import functions as F


def one_by_one(renames, values):
    """Each rename acts on all values and on the renames after it, in order."""
    renames, values = [list(r) for r in sorted(renames) if r[1] is not None and r[2] is not None], dict(enumerate(values))
    moved = lambda p, old, new: new + p[len(old) :] if p is not None and (p == old or p.startswith(old + "/")) else p
    for k, (_, old, new) in enumerate(renames):
        if old != new:
            for later in renames[k + 1 :]:
                later[1], later[2] = moved(later[1], old, new), moved(later[2], old, new)
            values = {i: moved(p, old, new) for i, p in values.items()}
    return [tuple(r) for r in renames], [values[i] for i in range(len(values))]


def random_path(rng, deep):
    return "".join("/" + rng.choice(["a", "b", "ab", "c.d"]) for _ in range(rng.randint(1, deep)))


@pytest.mark.parametrize(("seed", "small"), [(0, cascades.SMALL), (1, 0)])
def test_renames_equal_one_by_one(spark, monkeypatch, seed, small):
    monkeypatch.setattr(cascades, "SMALL", small)
    rng = random.Random(seed)
    renames = [(s, random_path(rng, 3), random_path(rng, 3)) for s in rng.sample(range(100), 8)] + [(200, None, "/a"), (201, "/a", None), (202, "/b", "/b")]
    values = [f"{random_path(rng, 5)}/f{i}.txt" for i in range(150)] + [None, "/a/b/ab"]
    settled, want = one_by_one(renames, values)
    table = cascades.settled(spark.createDataFrame(renames, "step long, old string, new string"))
    assert sorted(map(tuple, table.collect())) == settled
    df = spark.createDataFrame(list(enumerate(values)), "id long, path string")
    got = {r.id: r.path for r in cascades.follow(df, table, "path").collect()}
    assert [got[i] for i in range(len(values))] == want


def test_renames_that_rest_on_each_other(spark):
    """Outer folders first, the inner ones given by their old paths; a folder moved below itself; a chain of names."""
    renames = [(1, "/r/a", "/r/A"), (2, "/r/a/b", "/r/a/B"), (3, "/r/a/b/c", "/r/a/b/C"), (4, "/r/x", "/r/x/y"), (5, "/r/p", "/r/q"), (6, "/r/q", "/r/s"), (7, "/r/ax", "/r/ay")]
    files = ["/r/a/b/c/f", "/r/ab/f", "/r/x/f", "/r/p/f", "/r/q/f", "/r/ax/f"]
    table = cascades.settled(spark.createDataFrame(renames, "step long, old string, new string"))
    got = cascades.follow(spark.createDataFrame(list(enumerate(files)), "id long, path string"), table, "path")
    settled, want = one_by_one(renames, files)
    assert sorted(map(tuple, table.collect())) == settled
    assert [r.path for r in got.orderBy("id").collect()] == want == ["/r/A/B/C/f", "/r/ab/f", "/r/x/y/f", "/r/s/f", "/r/s/f", "/r/ay/f"]


def test_proposals_and_tree_follow(spark):
    table = spark.createDataFrame([(1, "/r/a", "/r/b")], "step long, old string, new string")
    files = spark.createDataFrame([(1, "/r/a/1.txt", "/r/a"), (2, "/r/a/2.txt", "/r/a"), (3, "/r/c/3.txt", "/r/c")], "id long, path string, dir string")
    moves = spark.createDataFrame([(1, "/r/a/1.txt", "/r/b/1.txt"), (3, "/r/c/3.txt", "/r/a/3.txt")], "file_id long, current_value string, proposed_value string")
    got = {r.file_id: (r.current_value, r.proposed_value, r.no_op) for r in cascades.follow_proposals(moves, table).collect()}
    assert got == {1: ("/r/b/1.txt", "/r/b/1.txt", True), 3: ("/r/c/3.txt", "/r/b/3.txt", False)}
    tree = {r.dir: (r.before, r.after) for r in cascades.after_tree(files, table, moves).collect()}
    assert tree == {"/r/a": (2, 0), "/r/b": (0, 3), "/r/c": (1, 0)}


def test_no_renames_and_no_files(spark):
    none = spark.createDataFrame([], "step long, old string, new string")
    files = spark.createDataFrame([(1, "/a/f")], "id long, path string")
    assert cascades.settled(none).collect() == []
    assert [tuple(r) for r in cascades.follow(files, none, "path").collect()] == [(1, "/a/f")]
    assert cascades.follow(files.filter("false"), none, "path").collect() == []


def plain_actions(acts, files, existing, root):
    moved = {f for f, kind, _ in existing if kind == "move"}
    renamed = {p for _, kind, p in existing if kind == "rename_folder"}
    out = []
    norm = lambda n: "_".join(n.split()).strip("._/")
    under = lambda p, d: p.startswith(d + "/")
    for k, action, src, dst, new, names, words, why, sure in sorted(acts, key=lambda a: a[0]):
        sure = min(max(0.5 if sure is None else sure, 0.0), 1.0)
        kind = "rename_folder" if action == "rename_folder" else "move"
        add = lambda i, p, q, no, kind=kind, k=k, why=why, sure=sure: out.append((k, i, kind, p, None if no else q, None if no else why or "", None if no else sure, no))
        if kind == "rename_folder":
            name = norm((new or "").split("/")[-1])
            if not src or not name:
                add(None, None, None, "incomplete")
                continue
            old = f"{root}/{src}"
            to = f"{old.rsplit('/', 1)[0]}/{name}"
            ids = [f[0] for f in files if under(f[2], old)]
            no = "no_change" if old == to else "no_files" if not ids else "already_proposed" if old in renamed else None
            add(min(ids, default=None), old, to, no)
            if no is None:
                renamed.add(old)
            continue
        names = list(dict.fromkeys(n.strip() for n in names or [] if n.strip()))
        if not src or not dst or (action == "move_files" and not names):
            add(None, None, None, "incomplete")
            continue
        old, to = f"{root}/{src}", "/".join([root, *filter(None, map(norm, dst.split("/")))])
        own = [f for f in files if under(f[2], old) and f[4] in ("analyzed", "proposed")]
        if action == "move_files":
            chosen = []
            for n in names:
                found = [f for f in own if f[3] == n]
                if found:
                    chosen.append((min(found)[0], min(found)[2], f"{to}/{n}"))
                else:
                    add(None, None, None, "missing_file")
        else:
            if not own:
                add(None, None, None, "no_files")
            asked = [] if words == "all" else [w for w in (words or "").lower().replace(",", " ").split() if len(w) > 2]
            heard = lambda f, asked=asked: not asked or any(w in (f[6] or "").lower() or any(w in t.lower() for t in f[5] or []) for w in asked)
            chosen = [(f[0], f[2], to + f[2][len(old) :]) for f in own if heard(f)]
        for i, p, q in chosen:
            no = "no_change" if p == q else "already_proposed" if i in moved else None
            add(i, p, q, no)
            if no is None:
                moved.add(i)
    return out


def test_actions_equal_one_by_one(spark):
    rng = random.Random(4)
    root = "/r"
    files = []
    for i in range(120):
        d = root + random_path(rng, 3)
        name = f"f{i % 9}.txt"
        files.append((i, d, f"{d}/{name}", name, rng.choice(["analyzed", "proposed", "pending"]), rng.choice([None, [], ["Red", "blue sky"], ["green"]]), rng.choice([None, "Some Red thing", "nothing"])))
    folder = lambda: rng.choice([None, "", "none", "a b", *(random_path(rng, 2)[1:] for _ in range(6))])
    acts = [
        (k, rng.choice(["move", "merge", "move_files", "rename_folder", None]), folder(), folder(), rng.choice([None, "x/New  name", "...", "a"]), rng.choice([None, [], [" f1.txt ", "f2.txt", "f2.txt", "no.txt"]]), rng.choice([None, "all", "red, of", "blue"]), rng.choice([None, "why"]), rng.choice([None, 0.3, 1.7, -1.0]))
        for k in range(60)
    ]
    existing = [(3, "move", None), (5, "move", None), (None, "rename_folder", "/r/a"), (7, "rename", "/r/b")]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = actions.action_proposals(
        df(acts, "action_id long, action string, source_folder string, destination_folder string, new_name string, filenames array<string>, file_filter string, reasoning string, confidence double"),
        df(files, "id long, dir string, path string, filename string, status string, ai_tags array<string>, ai_description string"),
        df(existing, "file_id long, proposal_type string, current_value string"), root,
    )
    want = plain_actions(acts, files, existing, root)
    rows = list(map(tuple, got.collect()))
    assert set(rows) == set(want) and len(rows) == len(want)
    assert {r.rejected for r in got.collect()} == {None, "incomplete", "no_files", "missing_file", "no_change", "already_proposed"}


ACTION, FILE = "action_id long, action string, source_folder string, destination_folder string, new_name string, filenames array<string>, file_filter string, reasoning string, confidence double", "id long, dir string, path string, filename string, status string, ai_tags array<string>, ai_description string"


def test_tables_of_actions_do_not_hold_their_pairs_with_files(spark, monkeypatch):
    root, written = "/r", {}
    files = [(i, f"/r/a/{'bc'[i % 2]}", f"/r/a/{'bc'[i % 2]}/f{i % 50}", f"f{i % 50}", "analyzed", ["red"] if i % 3 else None, None) for i in range(200)]
    acts = [(k, ("move", "merge", "move_files", "rename_folder")[k % 4], ("a", "a/b", "a/c")[k % 3], ("x", "a", "a/b", "y z")[k % 5 % 4], "n", ["f1", "f2", "no"], ("all", "red", "blue, red", None)[k % 7 % 4], None, None) for k in range(400)]
    existing = [(8, "move", None)]

    def saved(df, label, save=actions.saved):
        out = save(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(actions, "saved", saved)
    for name, v in (("PIECE", 5), ("PAIRS_A_TASK", 1000)):
        monkeypatch.setattr(actions, name, v, raising=False)
    for share in (2000, 3):  # all kinds hot, and few
        monkeypatch.setattr("filequarry.operators.scratch.HOT_SHARE", share)
        got = list(map(tuple, actions.action_proposals(spark.createDataFrame(acts, ACTION), spark.createDataFrame(files, FILE), spark.createDataFrame(existing, "file_id long, proposal_type string, current_value string"), root).collect()))
        assert sorted(got, key=repr) == sorted(plain_actions(acts, files, existing, root), key=repr)
    assert len(got) > 20_000
    # each file with each of the kinds of ask (two folders times three filters), each action with each of its three names
    assert max(written.values()) <= max(200 * 6, 400 * 3), written


def test_ranks_of_a_key_in_many_ranges(spark):
    rows = [("hot", i) for i in range(900)] + [(None, i) for i in range(900)] + [(k, i) for k in "abc" for i in range(7)]
    got = ranked(spark.createDataFrame(rows, "k string, i long").repartition(5), ["k"], [F.desc("i")], "place")
    assert {(r.k, r.i): r.place for r in got.collect()} == {(k, i): (900 if k in ("hot", None) else 7) - i for k, i in rows}
