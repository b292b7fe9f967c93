"""Rules of the near-duplicate engine on small relations."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import config
from twinsift import queries as Q
from twinsift.functions import fingerprints, registry, scalars
from twinsift.operators import grouping, manifest, pairs, review, scoring
from twinsift.operators.components import connected_components
from twinsift.plans import views
from twinsift.sources import cache, files
from twinsift.streaming import incremental, progress

WEIGHTS = config.IMAGE_WEIGHTS
BASE = {"effective_resolution_px_equiv": 640.0, "sharpness_normalized": 31.0, "effective_resolution_fraction": 0.6, "noise_sigma": 7.0, "blockiness": 2.5, "brisque": 44.0, "niqe": 5.5}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("threshold", [0, 3, 10, 20])
def test_banded_join_finds_what_brute_force_finds(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = [(i, signed(base[i % 60] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12))))) for i in range(240)] + [(900, None)]
    fps = spark.createDataFrame(rows, "id long, fp long")
    every = [("bands", threshold // 3 + 1), ("combinations", threshold + 2)] if threshold < 10 else [("bands", 4 if threshold == 10 else 8)]
    (got,) = {frozenset(tuple(r) for r in pairs.banded_pairs(fps, threshold, keys=k).collect()) for k in (*every, None)}
    want = {(i, j, bin((a ^ b) & (2**64 - 1)).count("1")) for i, a in rows[:-1] for j, b in rows[:-1] if i < j and bin((a ^ b) & (2**64 - 1)).count("1") <= threshold}
    assert got == want == {tuple(r) for r in pairs.brute_pairs(fps, threshold).collect()}
    few = connected_components(pairs.linking_edges(fps, threshold))
    many = connected_components(pairs.linking_edges(fps, threshold, few=5)) 
    all_ = connected_components(pairs.brute_pairs(fps, threshold))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted(map(tuple, all_.collect()))


@pytest.mark.parametrize("threshold", [2, 10, 64])
def test_cells_find_what_brute_force_finds_and_link_the_same(spark, threshold, monkeypatch):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(9)]
    values = sorted({signed(base[i % 9] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8)))) for i in range(400)})
    monkeypatch.setattr(pairs, "BLOCK", 90)
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = [tuple(r) for r in pairs.cell_join(df, None, threshold).collect()]
    want = {(a, b, far(a, b)) for a in values for b in values if a < b and far(a, b) <= threshold}
    assert len(got) == len(set(got)) and set(got) == want
    some, rest = values[:150], values[100:]
    two = [tuple(r) for r in pairs.cell_join(*(spark.createDataFrame([(v,) for v in x], "fp long") for x in (some, rest)), threshold).collect()]
    assert len(two) == len(set(two)) and set(two) == {(a, b, far(a, b)) for a in some for b in rest if far(a, b) <= threshold}
    links = pairs.cell_join(df, None, threshold, links=True)
    assert {tuple(r) for r in links.collect()} <= want and links.count() <= 2 * len(values) * 5
    parted = [sorted(map(tuple, connected_components(e, "a", "b").collect())) for e in (links, spark.createDataFrame(sorted(want), "a long, b long, distance long"))]
    assert parted[0] == parted[1]


@pytest.mark.parametrize("shape, share", [((1, 1), 1), ((32, 4096), 0.001), ((3, 13), 0.5), ((32, 5), 0), ((32, 4091), 0.1)])
def test_places_are_those_of_nonzero(shape, share):
    near = np.random.default_rng(3).random(shape) < share
    for found, known in zip(pairs.places(near), near.nonzero()):
        assert (found == known).all() and len(found) == len(known)


def test_a_forest_over_several_portions_links_what_the_pairs_link():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 500), rng.integers(0, 40, 500)
    found = [(a[k : k + 70], b[k : k + 70], b[k : k + 70]) for k in range(0, 500, 70)]
    got = [(i, j) for p, q, _ in pairs.forest(found, 100, 60) for i, j in zip(p.tolist(), q.tolist())]
    assert set(got) <= set(zip(a.tolist(), b.tolist())) and len(got) == len(set(a)) + len(set(b)) - 1  # one tree


def test_wide_thresholds_meet_in_cells():
    # three bits of eleven: each of six parts sends up to 176 probes and meets the other rows many times
    assert all(pairs.plan(n, 20, 64)[0] == "cells" for n in (30_000, 102_562, 1_000_000))


def test_keys_of_many_parts_stay_few_expressions(spark):
    own, _ = pairs._keys(F.col("v"), 10, 60, "combinations", 14)
    assert len(own._jc.toString()) < 60_000
    assert pairs.plan(470_000, 10, 60)[0] == "cells" and pairs.plan(4_000_000, 2, 64)[0] != "cells"


def test_every_item_is_one_group_at_the_largest_threshold(spark):
    fps = spark.createDataFrame([(1, 5), (2, -5), (3, None), (4, 0)], "id long, fp long")
    assert {r["component"] for r in connected_components(pairs.linking_edges(fps, 64)).collect()} == {1}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300))
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=1)


def test_rounds_and_numbers_keep_no_size_estimate(spark):
    def bits(df):
        return df._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length()

    path = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert bits(connected_components(path)) <= 64  # the number's digits doubled each round
    large = path.crossJoin(path.select(F.col("src").alias("a"))).crossJoin(path.select(F.col("src").alias("b"))).filter("a = 0 AND b = 0")
    once = grouping.number(large, "src", "at").select("src", "at")
    assert bits(once) <= bits(grouping.number(path, "src", "at").select("src", "at"))
    assert [r["at"] for r in once.orderBy("src").collect()] == list(range(100))


def test_groups_are_numbered_by_their_first_member(spark):
    items = spark.createDataFrame([("a/b",), ("a-b/x",), ("a/B",), ("z",), ("q",)], "id string")
    edges = spark.createDataFrame([("z", "a-b/x"), ("a/b", "a/B")], "src string, dst string")
    got = {r["id"]: (r["group_id"], r["member_idx"]) for r in grouping.members(items, edges, "id", files.path_key("id")).collect()}
    assert got == {"a/B": (0, 0), "a/b": (0, 1), "a-b/x": (1, 0), "z": (1, 1)}


def scored(spark, rows):
    df = spark.createDataFrame([(0, i, *[float(r[k]) if r[k] is not None else None for k in WEIGHTS]) for i, r in enumerate(rows)], "group_id int, member_idx int, " + ", ".join(f"{k} double" for k in WEIGHTS))
    s = scoring.score(df, "group_id", WEIGHTS)
    return [r["quality_score"] for r in s.orderBy("member_idx").collect()], scoring.suggested(s).first()


def test_better_on_every_metric_scores_one(spark):
    worse = {k: v / 2 if WEIGHTS[k] > 0 else v * 2 for k, v in BASE.items()}
    s, top = scored(spark, [worse, BASE])
    assert s == pytest.approx([0.0, 1.0]) and top["suggested_idx"] == 1 and not top["is_close_call"]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_a_metric_that_one_member_lacks_is_left_out_for_all(spark, bad):
    s, _ = scored(spark, [BASE | {"brisque": bad, "sharpness_normalized": 20.0}, BASE | {"brisque": 1.0}])
    other = {k: w for k, w in WEIGHTS.items() if k != "brisque"}
    low = sum(abs(w) for w in other.values() if w < 0) / sum(map(abs, other.values()))
    assert s == pytest.approx([low, low + 0.2 / sum(map(abs, other.values()))])


def test_ties_singles_and_nothing_usable(spark):
    none = dict.fromkeys(WEIGHTS, float("nan"))
    assert scored(spark, [none, none])[0] == [0.0, 0.0]
    five = {k: None if k in ("brisque", "niqe") else v for k, v in BASE.items()}
    s, top = scored(spark, [five, five, five])
    assert s == pytest.approx([0.2 / 0.9] * 3) and top["is_close_call"] and top["suggested_idx"] == 0
    assert not scored(spark, [BASE])[1]["is_close_call"]
    huge = BASE | {"sharpness_normalized": 2.0**30}
    assert all(0 <= x <= 1 for x in scored(spark, [huge, huge])[0])


def test_mean_bits_match_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(50)] + [(98, [1.0]), (99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for r in df.select("id", "v", fingerprints.mean_bits("v").alias("fp")).collect():
        if r["id"] >= 98:
            assert r["fp"] is None
            continue
        mean, h = sum(r["v"][1:]) / 63, 0
        for x in r["v"]:
            h = (h << 1) | (x > mean)
        assert r["fp"] == signed(h)


def test_shown_sizes_and_numbers(spark):
    cases = {0: "0B", 1023: "1023B", 1024: "1.0KB", 1280: "1.2KB", 1024**2: "1.0MB", 5 * 1024**3 // 2: "2.5GB", 5000 * 1024**3: "5000.0GB"}
    df = spark.createDataFrame([(k,) for k in cases], "n long").select("n", scalars.humansize("n").alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == cases
    assert spark.sql("select cast(null as double) x").select(views.shown("x", 2)).first()[0] == "n/a"


def test_suffixes_and_scan_filters(spark):
    paths = ["/d/a.JPG", "/d/.png", "/d/x.tar.png", "/d/s/b.jpeg", "/d/_dup/c.png", "/d/note.txt", "/e/a.png", "/d/noext"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    pick = lambda *a: {r["path"] for r in files.select_files(df, *a).collect()}
    assert pick("/d") == {"/d/a.JPG", "/d/x.tar.png"}
    assert pick("/d", True, "/d/_dup") == {"/d/a.JPG", "/d/x.tar.png", "/d/s/b.jpeg"}
    assert pick("/d", True, "/d") == set()


def test_threshold_setting():
    assert config.ScanConfig("/x/", "64").threshold == 64 and config.ScanConfig("/x/").dest_dir == "/x/_duplicates"
    for bad in (-1, 65, "x"):
        with pytest.raises(ValueError):
            config.ScanConfig("/x", bad)


def test_cache_versions_and_rules(spark, tmp_path):
    schema, folder = "path string, mtime long, size long, hash long", str(tmp_path / "c")
    assert cache.read(spark, folder, schema).count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert cache.write_if_changed(spark, folder, cache.read(spark, folder, schema), rows(("a", 1, 1, 10), ("b", 1, 1, None)))
    assert not cache.write_if_changed(spark, folder, cache.read(spark, folder, schema), rows())
    cache.write_if_changed(spark, folder, cache.read(spark, folder, schema), rows(("a", 2, 1, 11)))
    now = cache.read(spark, folder, schema)
    assert {tuple(r) for r in now.collect()} == {("a", 2, 1, 11), ("b", 1, 1, None)}
    stats = spark.createDataFrame([("a", 2, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime long, size long")
    assert {r["path"]: r["is_hit"] for r in cache.lookup(stats, now, "hash").collect()} == {"a": True, "b": False, "c": False}
    assert {r["path"] for r in cache.misses(stats, now, "hash").collect()} == {"b", "c"}
    for text in ("gone", "v-00000000-0000-0000-0000-000000000000", "{not valid json", ""):
        (tmp_path / "c" / "CURRENT").write_text(text)
        assert cache.read(spark, folder, schema).count() == 0
    for n in range(3):
        cache.write(spark, folder, rows(("z", n, 1, 1)))
        assert [r["mtime"] for r in cache.read(spark, folder, schema).collect()] == [n]
    assert len(list((tmp_path / "c").glob("v-*"))) <= 3  # this one, the one before and what a corrupt pointer left
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):  # a store that can't be read isn't an empty cache
        cache.write(spark, str(tmp_path / "file"), rows())


def members_of(spark, paths, cfg=None, resolved=None):
    rows = [(0, i, p, 10 + i, (resolved or {}).get(p, p)) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "group_id int, member_idx int, path string, size long, resolved string")


def test_destinations_take_free_numbers_and_keep_folders(spark):
    cfg = config.ScanConfig("/d", recursive=True, dest_dir="/d/_dup")
    taken = spark.createDataFrame([("/d/_dup/s/a.png",), ("/d/_dup/s/a_dup2.png",)], "path string")
    rows = spark.createDataFrame([("/d/s/a.png",), ("/d/a.png",), ("/x/noext",)], "path string")
    got = {r["path"]: r["to_path"] for r in manifest.destinations(rows, cfg, taken).collect()}
    assert got == {"/d/s/a.png": "/d/_dup/s/a_dup1.png", "/d/a.png": "/d/_dup/a.png", "/x/noext": "/d/_dup/noext"}
    flat = config.ScanConfig("/d", dest_dir="/o")
    same = spark.createDataFrame([("/d/1/a.png",), ("/d/2/a.png",), ("/d/3/a.png",)], "path string")
    assert sorted(r["to_path"] for r in manifest.destinations(same, flat).collect()) == ["/o/a.png", "/o/a_dup1.png", "/o/a_dup2.png"]


def walked(paths, existing, cfg):
    """Targets one by one, each free among what is there and what was moved before."""
    there, out = set(existing), []
    for p in paths:
        name = p.removeprefix(f"{cfg.directory}/") if cfg.recursive else p.rsplit("/", 1)[1]
        folder, _, file = name.rpartition("/")
        dot = file.rfind(".")
        stem, end = (file, "") if dot <= 0 else (file[:dot], file[dot:])
        at, n = f"{cfg.dest_dir}/{name}", 1
        while at in there:
            at, n = f"{cfg.dest_dir}/{folder + '/' if folder else ''}{stem}_dup{n}{end}", n + 1
        if not cfg.dry_run:
            there.add(at)
        out.append(at)
    return out


@pytest.mark.parametrize("recursive", [False, True])
@pytest.mark.parametrize("dry_run", [False, True])
def test_destinations_are_those_of_moving_one_by_one(spark, recursive, dry_run):
    rng = random.Random(recursive)
    cfg = config.ScanConfig("/d", recursive=recursive, dest_dir="/o", dry_run=dry_run)
    stems = ["a", "a_dup1", "a_dup2", "a_dup1_dup1", "b", "b_dup01", "a_dup0", ".h", "c"]
    names = sorted({f"/d/{rng.randint(0, 9)}/{rng.choice(stems)}{rng.choice(['.png', '', '.jpg'])}" for _ in range(150)})
    rng.shuffle(names)
    rows = spark.createDataFrame(list(enumerate(names)), "place int, path string")
    folder = lambda: f"{rng.randint(0, 9)}/" if recursive else ""
    for existing in ([], [f"/o/{folder()}{rng.choice(stems[:-1])}{rng.choice(['.png', ''])}" for _ in range(12)]):
        there = spark.createDataFrame([(p,) for p in existing], "path string")
        got = {r["place"]: r["to_path"] for r in manifest.destinations(rows, cfg, there, order=("place",)).collect()}
        assert [got[i] for i in range(len(names))] == walked(names, existing, cfg)
        assert dry_run or len({*got.values(), *existing}) == len(names) + len(set(existing))


def test_moves_never_overwrite(spark, tmp_path):
    ps = make(tmp_path, ["a", "b.png", "c"])
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b.png").write_text("older")
    (tmp_path / "out" / "b_dup1.png").symlink_to("nowhere")
    mover = manifest.Mover()
    mover.apply(0, ps[0], [(ps[1], f"{tmp_path}/out/b.png")])
    assert mover.entries[0]["moved"] == [(ps[1], f"{tmp_path}/out/b_dup2.png")]
    assert (tmp_path / "out" / "b.png").read_text() == "older" and (tmp_path / "out" / "b_dup2.png").read_text() == "b.png"
    mover.unapply(0)
    assert (tmp_path / "b.png").read_text() == "b.png" and (tmp_path / "out" / "b.png").exists()


def test_numbers_within_large_groups_are_spread(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.xxhash64("id").alias("k")).repartition(9)
    got = grouping.ranked(df, "g", "k", "at").collect()
    for g in (0, 1):
        mine = sorted((r["k"], r["at"]) for r in got if r["g"] == g)
        assert [a for _, a in mine] == list(range(len(mine)))
    assert grouping.ranked(df.limit(0), "g", "k", "at").count() == 0


def test_targets_of_a_kept_link_stay(spark):
    m = members_of(spark, ["/d/link", "/d/real", "/d/other"], resolved={"/d/link": "/d/real"})
    picks = spark.createDataFrame([(0, 0)], "group_id int, pick int")
    assert [r["from_path"] for r in manifest.move_plan(m, picks, config.ScanConfig("/d")).collect()] == ["/d/other"]


class Flaky:
    """A move that fails on one call."""

    def __init__(self, at):
        self.at, self.calls = at, 0

    def __call__(self, a, b):
        self.calls += 1
        if self.calls == self.at:
            raise OSError("disk full")
        import shutil

        shutil.move(a, b)


def make(tmp_path, names):
    for n in names:
        (tmp_path / n).write_text(n)
    return [str(tmp_path / n) for n in names]


def test_a_failed_group_is_reported_and_the_rest_go_on(spark, tmp_path):
    ps = make(tmp_path, ["a", "b", "c", "d", "e", "f"])
    dest = str(tmp_path / "out")
    plan = [(0, ps[0], ps[1], f"{dest}/b", 1, False), (0, ps[0], ps[2], f"{dest}/c", 2, False), (1, ps[3], ps[4], f"{dest}/e", 4, False), (1, ps[3], ps[5], f"{dest}/f", 8, False)]
    df = spark.createDataFrame(plan, "group_id int, kept string, from_path string, to_path string, size long, dry_run boolean")
    mover = manifest.Mover(move=Flaky(2))
    outcomes = mover.auto(spark, df)
    s = manifest.auto_summary(outcomes).first()
    assert (s["confirmed"], s["failed"], s["files_moved"], s["bytes_reclaimed"]) == (1, 1, 3, 12)
    assert [tuple(f) for f in manifest.auto_failures(outcomes).collect()] == [(0, "disk full", 1, 1)]
    assert mover.entries[0]["moved"] == [(ps[1], f"{dest}/b")]
    mover.move = Flaky(0)
    mover.unapply(0), mover.unapply(1), mover.unapply(7)
    assert all((tmp_path / n).exists() for n in "abcdef") and not mover.entries


def test_a_partial_restore_keeps_the_rest_on_record(tmp_path):
    ps = make(tmp_path, ["a", "b", "c"])
    mover = manifest.Mover()
    mover.apply(0, ps[0], [(p, f"{p}.moved") for p in ps[1:]])
    mover.move = Flaky(2)
    with pytest.raises(OSError):
        mover.unapply(0)
    assert [a for a, _ in mover.entries[0]["moved"]] == [ps[2]] and (tmp_path / "b").exists()


def test_dry_runs_record_and_touch_nothing(spark, tmp_path):
    ps = make(tmp_path, ["a", "b"])
    df = spark.createDataFrame([(0, ps[0], ps[1], f"{tmp_path}/out/b", 5, True)], "group_id int, kept string, from_path string, to_path string, size long, dry_run boolean")
    mover = manifest.Mover(dry_run=True)
    s = manifest.auto_summary(mover.auto(spark, df)).first()
    assert (s["files_moved"], s["bytes_reclaimed"]) == (1, 0) and not (tmp_path / "out").exists()
    mover.unapply(0)
    assert not mover.entries and (tmp_path / "b").exists()


def test_replay_agrees_with_stepping(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in range(60):
        status, pick = "pending", None
        for i in range(rng.randint(1, 9)):
            a, v = rng.choice(["pick", "confirm", "skip", "none"]), rng.randint(0, 5)
            rows.append((g, i, a, v))
            if a == "pick":
                pick = v
            elif a == "confirm":
                status = "confirmed"
            elif a == "skip":
                status = "pending" if status == "skipped" else "skipped"
        want[g] = (status, pick)
    got = review.replay(spark.createDataFrame(rows, "group_id long, seq long, action string, value long"))
    assert {r["group_id"]: (r["status"], r["pick"]) for r in got.collect()} == want


def test_next_pending_wraps(spark):
    g = spark.createDataFrame([(0, "pending"), (1, "confirmed"), (2, "pending"), (3, "skipped")], "group_id int, status string")
    assert [review.next_pending(g, a, 4).first()[0] for a in range(4)] == [2, 2, 0, 0]
    assert review.next_pending(g.filter("status = 'skipped'"), 0, 4).first()[0] is None


def test_of_groups_equally_far_the_least_is_next(spark):
    far = [(g, "pending") for k in range(59, -1, -1) for g in (1000 * k + 5, 1000 * k + 7)] + [(None, "pending"), (4, "skipped")]
    for n in (1, 8):
        groups = spark.createDataFrame(far, "group_id long, status string").repartition(n)
        assert review.next_pending(groups, 2, 1000).first()["next_group"] == 5
    assert review.next_pending(groups.filter("status = 'gone'"), 2, 1000).first()["next_group"] is None


def test_review_session(tmp_path):
    ps = make(tmp_path, ["a", "b", "c"])
    moves = lambda k: [(p, f"{p}.moved") for i, p in enumerate(ps) if i != k]
    s = review.Session(config.ScanConfig(str(tmp_path)), manifest.Mover())
    s.rescan(lambda: [{"paths": ps, "suggested": 0, "moves": moves}])
    s.confirm(0)
    assert not (tmp_path / "b").exists() and s.state[0]["status"] == "confirmed"
    s.pick(0, 1)
    assert not (tmp_path / "b").exists()  # only staged
    s.confirm(0)
    assert (tmp_path / "b").exists() and not (tmp_path / "a").exists() and len(s.mover.entries) == 1
    s.skip(0)
    assert (tmp_path / "a").exists() and s.state[0]["status"] == "skipped"
    s.skip(0)
    assert s.state[0]["status"] == "pending"
    with pytest.raises(IndexError):
        s.pick(5, 0)
    with pytest.raises(ValueError):
        s.pick(0, 9)
    s.rescan(lambda: 1 / 0)
    assert s.status == "error" and s.generation == 1 and s.groups
    s.status = "scanning"
    with pytest.raises(RuntimeError):
        s.skip(0)
    s.require(None)
    guarded = review.Session(config.ScanConfig(str(tmp_path)), manifest.Mover(), token="key")
    guarded.require("key")
    for bad in (None, "", "keys"):
        with pytest.raises(PermissionError):
            guarded.require(bad)


def test_best_cells_need_two_numbers(spark):
    rows = [(0, "a", 1, "1"), (0, "a", 1, "3"), (0, "a", 1, "3"), (0, "b", -1, "2"), (0, "b", -1, "n/a"), (0, "c", 0, "9"), (0, "c", 0, "8")]
    t = spark.createDataFrame(rows, "group_id int, label string, direction int, value string")
    assert sorted((r["label"], r["value"]) for r in views.best_cells(t).filter("is_best").collect()) == [("a", "3"), ("a", "3")]


def test_user_fingerprints_and_metrics(spark):
    registry.register_fingerprint("length", lambda df, key: df.select(key, F.length("t").cast("long").alias("fp")))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "c")], "id long, t string")
    fps = registry.fingerprint("length")(df, "id")
    assert {tuple(r) for r in pairs.linking_edges(fps, 0).collect()} == {(1, 2)}
    m = registry.register_metric(registry.Metric("size", -0.5, F.length("t")))
    assert registry.metrics()["size"] is m and m.direction == -1


def test_stream_keeps_the_table_current(spark, tmp_path):
    src, folder = tmp_path / "in", str(tmp_path / "table")
    schema = "path string, mtime timestamp, size long"
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("b", 3), ("c", 4)]]):
        spark.createDataFrame(rows, "path string, size long").withColumn("mtime", F.timestamp_seconds("size")).select("path", "mtime", "size").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        incremental.fingerprint_stream(stream, F.col("size") * 2, folder, str(tmp_path / "ck")).awaitTermination()
    now = cache.read(spark, folder, schema + ", hash long")
    assert {(r["path"], r["hash"]) for r in now.collect()} == {("a", 2), ("b", 6), ("c", 8)}
    new = spark.createDataFrame([("d", 9)], "path string, hash long")
    assert {tuple(r) for r in incremental.new_pairs(new, now, 1).collect()} == {("c", "d", 1)}
    rng = random.Random(1)
    rows = [(f"p{i}", signed(rng.getrandbits(8) << 40)) for i in range(60)]
    old, fresh = (spark.createDataFrame(r, "path string, hash long") for r in (rows, [("p3", 0), ("q", 1 << 40), ("r", 1 << 40), ("s", None)]))
    all_ = dict(rows) | {"p3": 0, "q": 1 << 40, "r": 1 << 40}
    want = {(a, b, bin(all_[a] ^ all_[b]).count("1")) for a in all_ for b in all_ if a < b and {a, b} & {"p3", "q", "r"} and bin(all_[a] ^ all_[b]).count("1") <= 3}
    assert {tuple(r) for r in incremental.new_pairs(fresh, old, 3).collect()} == want


def test_progress_is_a_stream_of_events():
    p = progress.Progress()
    p("Hashing", 1, 3)
    told = p.events(timeout=5)
    assert json.loads(next(told)[6:]) == {"status": "scanning", "label": "Hashing", "done": 1, "total": 3}
    p("Hashing", 3, 3), p.finish()
    last = [json.loads(e[6:]) for e in told]
    assert last[-1]["status"] == "done" and last[-1]["done"] == 3
    assert [json.loads(e[6:])["status"] for e in p.events(timeout=5)] == ["done"]  # late readers get the end at once
    q = progress.Progress()
    assert len(list(q.events(timeout=0.05))) == 1
    q.finish("disk full")
    assert json.loads(next(q.events())[6:])["error"] == "disk full"


def test_a_streaming_scan_reports_its_rows(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as string) as path", "timestamp_seconds(id) as mtime", "id as size").write.parquet(f"{tmp_path}/in")
    p = progress.Progress()
    listener = progress.QueryProgress(p, total=40)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("path string, mtime timestamp, size long").parquet(f"{tmp_path}/in")
        incremental.fingerprint_stream(stream, F.col("size"), f"{tmp_path}/t", f"{tmp_path}/ck").awaitTermination()
        told = [json.loads(e[6:]) for e in p.events(timeout=30)]
    finally:
        spark.streams.removeListener(listener)
    assert told[-1]["status"] == "done" and told[-1]["done"] == told[-1]["total"] == 40


def test_status_text(spark):
    rows = [(0, "pending", 3, 1, "b", 0, "a", False), (1, "confirmed", 2, 1, "d", 1, "d", False), (2, "confirmed", 2, 0, "e", 1, "f", True), (3, "skipped", 2, 0, "g", 0, "g", True)]
    g = spark.createDataFrame(rows, "group_id int, status string, members int, pick int, pick_name string, suggested int, suggested_name string, needs_reapply boolean")
    head = "Groups: 4  confirmed=2  skipped=1  pending=1"
    got = {r[0]: r[1] for r in views.status_text(g).collect()}
    assert got == {
        0: f"{head}\nkeep [2] b, move 2 other files\nyour pick [2]  ·  ★ suggested [1] a", 1: f"{head}\nalready confirmed\n",
        2: f"{head}\nchange keep [1] e, move 1 other file  (press c/Enter to confirm)\nyour pick [1]  ·  ★ suggested [2] f", 3: f"{head}\nalready skipped\n",
    }
    assert views.status_text(g, dry_run=True).first()[1].split("\n")[0] == head + "  [DRY RUN]"


def test_flagship(spark):
    rows = Q.flagship(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 <= r["quality_score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["group_id"], []).append(r)
    assert sorted(by) == list(range(len(by))) and all(sum(r["is_suggested"] for r in g) == 1 and len(g) > 1 for g in by.values())


def test_every_oracle_has_its_query():
    assert set(Q.ORACLES) <= set(Q.QUERIES)


def test_exclude_prefix_takes_any_number_of_hosts(spark, tmp_path):
    urls = [u for i in range(1100) for u in (f"https://www{i}.org/en/a.html", f"https://www{i}.org/enough.html", f"https://www{i}.org/en")]
    urls += ["https://blog.org/en/a.html"]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["path"] for r in Q.exclude_prefix(spark, str(tmp_path)).collect()}
    assert got == {f"/archive/www{i}.org/enough.html" for i in range(1100)} | {"/archive/blog.org/en/a.html"}
