"""The reversible record of moves: plans as relations, moves on the driver.

A manifest is a relation of moves (group_id, kept, from_path, to_path, size, dry_run); a
group may have several entries' moves.  Planning is pure; only Mover touches files.
"""

import os
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions.scalars import display_path, stem
from twinsift.operators.grouping import ranked


DUP = r"(_dup\d+)+$"  # what planning adds to a stem, any number of times


def destinations(rows: DataFrame, cfg: config.ScanConfig, existing: DataFrame | None = None, path="path", order=("path",)) -> DataFrame:
    """Adds to_path: below the destination, in the same relative folder if the scan is
    recursive; where a name is taken, `_dup1`, `_dup2`, ... goes after its stem.

    Names are taken by `existing` paths and by rows of this plan that come before in `order`
    (a dry run's rows take none).  Names meet only inside a family: one folder, one suffix, and
    stems that differ by `_dup<n>` endings.  In a family without such stems and without existing
    names the n-th row gets number n, by a distributed ranking; the others stream, sorted,
    through `_free_names`, which holds the family's distinct names and existing ones.
    """
    kept = rows.columns
    rel = display_path(path, cfg.directory, cfg.recursive)
    out = rows.withColumn("_rel", rel).withColumn("_parent", F.regexp_replace("_rel", r"[^/]*$", "")).withColumn("_stem", stem("_rel"))
    out = out.withColumn("_suffix", F.expr("substring(_rel, length(_parent) + length(_stem) + 1)"))
    out = out.withColumn("_family", F.concat("_parent", F.regexp_replace("_stem", DUP, ""), "_suffix")).withColumn("_order", F.struct(*order, path))
    odd = out.filter(F.col("_stem").rlike(DUP)).select("_family")
    taken = None
    if existing is not None:
        name = existing.filter(F.col("path").startswith(f"{cfg.dest_dir}/")).select(F.expr(f"substring(path, {len(cfg.dest_dir) + 2})").alias("_rel"))
        name = name.withColumn("_parent", F.regexp_replace("_rel", r"[^/]*$", "")).withColumn("_stem", stem("_rel"))
        family = F.concat("_parent", F.regexp_replace("_stem", DUP, ""), F.expr("substring(_rel, length(_parent) + length(_stem) + 1)"))
        taken = name.select(family.alias("_family"), "_rel").join(out.select("_family"), "_family", "left_semi")
        odd = odd.unionByName(taken.select("_family"))
    odd = odd.distinct()
    if odd.isEmpty():
        plain = out.withColumn("_name", F.col("_rel")) if cfg.dry_run else _numbered(out)
        return plain.select(*kept, F.concat(F.lit(f"{cfg.dest_dir}/"), "_name").alias("to_path"))
    plain = out.join(odd, "_family", "left_anti")
    plain = plain.withColumn("_name", F.col("_rel")) if cfg.dry_run else _numbered(plain)
    hard = out.join(odd, "_family", "left_semi").select("_family", "_order", "_rel", "_parent", "_stem", "_suffix", F.struct(*kept).alias("_row"))
    if taken is not None:
        gone = [F.lit(None).cast(hard.schema[c].dataType).alias(c) for c in ("_order",)]
        gone_row = F.lit(None).cast(hard.schema["_row"].dataType).alias("_row")
        hard = hard.unionByName(taken.distinct().select("_family", *gone, "_rel", *[F.lit(None).cast("string").alias(c) for c in ("_parent", "_stem", "_suffix")], gone_row))
    hard = hard.repartition("_family").sortWithinPartitions("_family", F.asc_nulls_first("_order"), "_rel").drop("_order")
    named = hard.mapInArrow(_free_names(cfg.dry_run), hard.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",_name string")
    named = named.filter("_name is not null").select("_row.*", "_name")
    return plain.select(*kept, "_name").unionByName(named).select(*kept, F.concat(F.lit(f"{cfg.dest_dir}/"), "_name").alias("to_path"))


def _numbered(out):
    n = F.col("_n")
    out = ranked(out, "_rel", "_order", "_n")
    return out.withColumn("_name", F.when(n == 0, F.col("_rel")).otherwise(F.concat("_parent", "_stem", F.lit("_dup"), n.cast("string"), "_suffix")))


def _free_names(dry_run):
    """Names of the rows of sorted families: existing names come first in each and have no row."""

    def run(batches):
        now, fixed, own, following = None, set(), set(), {}
        for b in batches:
            names = []
            for family, rel, parent, root, suffix, row in zip(*(b[c] for c in ("_family", "_rel", "_parent", "_stem", "_suffix", "_row"))):
                family, rel = family.as_py(), rel.as_py()
                if family != now:
                    now, fixed, own, following = family, set(), set(), {}
                if not row.is_valid:
                    fixed.add(rel)
                    names.append(None)
                    continue
                parent, root, suffix = parent.as_py(), root.as_py(), suffix.as_py()

                def gone(stem_):
                    at = f"{parent}{stem_}{suffix}"
                    base, dup, k = stem_.rpartition("_dup")
                    # a number below a stem's next one was given out or passed over as taken
                    return at in fixed or at in own or (dup and k.isdigit() and str(int(k)) == k and 0 < int(k) < following.get(base, 1))

                if not gone(root):
                    name = root
                    if not dry_run:
                        own.add(rel)
                else:
                    k = following.get(root, 1)
                    while gone(f"{root}_dup{k}"):
                        k += 1
                    name = f"{root}_dup{k}"
                    if not dry_run:
                        following[root] = k + 1
                names.append(f"{parent}{name}{suffix}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], [*b.schema.names, "_name"])

    return run


def move_plan(members: DataFrame, picks: DataFrame, cfg: config.ScanConfig, existing=None) -> DataFrame:
    """Moves of every member that isn't its group's pick (picks: group_id, pick).

    A member whose resolved path is the resolved path of a kept symbolic link stays.
    """
    m = members if "resolved" in members.columns else members.withColumn("resolved", F.col("path"))
    kept = m.join(picks, "group_id").filter(F.col("member_idx") == F.col("pick")).select("group_id", F.col("path").alias("kept"), F.col("resolved").alias("_real"))
    rest = m.join(kept, "group_id").filter((F.col("path") != F.col("kept")) & ~((F.col("_real") != F.col("kept")) & (F.col("resolved") == F.col("_real"))))
    rest = destinations(rest, cfg, existing, order=("group_id", "member_idx"))
    return rest.select("group_id", "kept", F.col("path").alias("from_path"), "to_path", "size", F.lit(cfg.dry_run).alias("dry_run"))


def unapply_plan(moves: DataFrame, files: DataFrame, group=None) -> DataFrame:
    """Adds action: 'drop' for a dry run, 'restore' where the moved file is there and the
    original isn't, else 'keep' (the entry stays)."""
    m = moves if group is None else moves.filter(F.col("group_id") == group)
    here = files.select("path")
    m = m.join(here.select(F.col("path").alias("_to")), F.col("to_path") == F.col("_to"), "left").join(here.select(F.col("path").alias("_from")), F.col("from_path") == F.col("_from"), "left")
    action = F.when(F.col("dry_run"), "drop").when(F.col("_to").isNotNull() & F.col("_from").isNull(), "restore").otherwise("keep")
    return m.withColumn("action", action).drop("_to", "_from")


def without_group(moves: DataFrame, groups: DataFrame) -> DataFrame:
    """The manifest without the entries of those groups."""
    return moves.join(groups.select("group_id"), "group_id", "left_anti")


def needs_reapply(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """groups (group_id, pick_path) with needs_reapply: no entry, or the first entry's kept
    path isn't the pick."""
    first = entries.groupBy("group_id").agg(F.min_by("kept", "entry_no").alias("kept"))
    return groups.join(first, "group_id", "left").withColumn("needs_reapply", F.coalesce(F.col("kept") != F.col("pick_path"), F.lit(True)))


def auto_summary(outcomes: DataFrame) -> DataFrame:
    """One row over (group_id, error, files_moved, bytes_moved, dry_run): a partly moved
    group's files count; bytes count for groups that succeeded and aren't a dry run.  The
    failures themselves are `auto_failures`."""
    ok = F.col("error").isNull()
    return outcomes.agg(
        F.count_if(ok).alias("confirmed"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum("files_moved"), F.lit(0)).cast("long").alias("files_moved"),
        F.coalesce(F.sum(F.when(ok & ~F.col("dry_run"), F.col("bytes_moved"))), F.lit(0)).cast("long").alias("bytes_reclaimed"),
    )


def auto_failures(outcomes: DataFrame) -> DataFrame:
    """The groups that failed, with what was moved of them."""
    return outcomes.filter(F.col("error").isNotNull()).select("group_id", "error", "files_moved", "bytes_moved")


def free_path(path):
    """The path, or its first `_dup<n>` form at which nothing is, not even a dangling link."""
    head, tail = os.path.splitext(path)
    out, n = path, 1
    while os.path.lexists(out):
        out, n = f"{head}_dup{n}{tail}", n + 1
    return out


class Mover:
    """Moves files on the driver, a group at a time; the record is right after any failure.

    Plans know a listing; the disk may have changed since, so each target is looked at again
    and a taken one is never overwritten: the next free number is used and recorded.
    """

    def __init__(self, dry_run=False, move=shutil.move):
        self.dry_run, self.move, self.entries = dry_run, move, []

    def apply(self, group, kept, moves):
        """moves: [(from, to)]; raises what a move raises, with what was moved recorded."""
        done = []
        try:
            for a, b in moves:
                if not self.dry_run:
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    b = free_path(b)
                    self.move(a, b)
                done.append((a, b))
        finally:
            self.entries.append({"group": group, "kept": kept, "moved": done, "dry_run": self.dry_run})

    def reapply(self, group, kept, moves):
        """Confirms a pick: stale entries of the group go first."""
        self.entries = [e for e in self.entries if e["group"] != group]
        self.apply(group, kept, moves)

    def unapply(self, group):
        entry = next((e for e in self.entries if e["group"] == group), None)
        if entry is None:
            return
        back = []
        try:
            for a, b in [] if entry["dry_run"] else entry["moved"]:
                if os.path.exists(b) and not os.path.exists(a):
                    self.move(b, a)
                    back.append((a, b))
        finally:
            entry["moved"] = [] if entry["dry_run"] else [m for m in entry["moved"] if m not in back]
            if not entry["moved"]:
                self.entries.remove(entry)

    def auto(self, spark, plan: DataFrame) -> DataFrame:
        """Applies a plan group by group (rows stream to the driver in group order); a group
        that fails doesn't stop the others.  Returns outcomes for auto_summary."""
        out, now, rows = [], None, []

        def close():
            if now is None:
                return
            error, size = None, {r["from_path"]: r["size"] or 0 for r in rows}
            try:
                self.apply(now, rows[0]["kept"], [(r["from_path"], r["to_path"]) for r in rows])
            except Exception as e:  # one group's failure is reported, not raised
                error = str(e) or type(e).__name__
            moved = self.entries[-1]["moved"]
            out.append((now, error, len(moved), sum(size[a] for a, _ in moved), self.dry_run))

        for r in plan.orderBy("group_id", "from_path").toLocalIterator():
            if r["group_id"] != now:
                close()
                now, rows = r["group_id"], []
            rows.append(r)
        close()
        return spark.createDataFrame(out, "group_id long, error string, files_moved int, bytes_moved long, dry_run boolean")
