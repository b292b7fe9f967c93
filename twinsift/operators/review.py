"""The review state machine over groups, as a relation and as a driver-side session."""

import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift import config


def replay(actions: DataFrame, group="group_id", order="seq", action="action", value="value") -> DataFrame:
    """Latest state of each group from a log of pick, confirm and skip actions.

    confirm gives confirmed; skip gives skipped, and pending if it was skipped; pick only
    sets the pick.  What matters is the last confirm and the parity of skips after it, so
    the log isn't walked: two grouped aggregates, combined on the map side, so a group with
    much of the log is no single task.
    """
    last = actions.filter(F.col(action) == "confirm").groupBy(F.col(group).alias("_g")).agg(F.max(order).alias("_last"))
    log = actions.join(last, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    after = F.count_if((F.col(action) == "skip") & (F.col("_last").isNull() | (F.col(order) > F.col("_last"))))
    out = log.groupBy(group).agg(after.alias("_skips"), F.max("_last").alias("_last"), F.max_by(value, F.when(F.col(action) == "pick", F.col(order))).alias("pick"), F.count("*").alias("actions"))
    status = F.when(F.col("_skips") % 2 == 1, "skipped").when(F.col("_skips") > 0, "pending").when(F.col("_last").isNotNull(), "confirmed").otherwise("pending")
    return out.select(group, status.alias("status"), "pick", "actions")


def pick_relative(pick, delta, members):
    return F.pmod(F.col(pick) + F.col(delta), F.col(members))


def next_pending(groups: DataFrame, active: int, total: int, group="group_id") -> DataFrame:
    """The first pending group after the active one, wrapping round, itself last; of groups as
    far away, as numbers from `total` on give, the least."""
    away = F.pmod(F.col(group) - active - 1, F.lit(total))
    pending = groups.filter((F.col("status") == "pending") & F.col(group).isNotNull())
    return pending.agg(F.min(F.struct(away, group))[group].alias("next_group"))


class Session:
    """State of the groups that a reviewer touched; the rest are pending at their suggestion.

    `generation` changes with each successful rescan; a failed one keeps the old data.
    """

    def __init__(self, cfg: config.ScanConfig, mover, token=None):
        self.cfg, self.mover, self._token = cfg, mover, token
        self.generation, self.status, self.error = 0, "idle", None
        self.groups, self.state = [], {}

    def require(self, token):
        """Refuses a caller without the session's token, if it has one."""
        if self._token is not None and not hmac.compare_digest(self._token.encode(), (token or "").encode()):
            raise PermissionError("missing or invalid token")

    def rescan(self, build):
        """build() -> [{'paths': [...], 'suggested': i, 'moves': {pick: [(from, to)]}}]"""
        if self.status == "scanning":
            raise RuntimeError("a scan is in progress")
        self.status = "scanning"
        try:
            groups = build()
        except Exception as e:
            self.status, self.error = "error", str(e)
            return
        self.groups, self.state, self.mover.entries = groups, {}, []
        self.generation, self.status, self.error = self.generation + 1, "done", None

    def _at(self, i):
        if self.status == "scanning":
            raise RuntimeError("a scan is in progress")
        if not 0 <= i < len(self.groups):
            raise IndexError("no such group")
        return self.state.setdefault(i, {"status": "pending", "pick": self.groups[i]["suggested"]})

    def pick(self, i, idx):
        s = self._at(i)
        if not 0 <= idx < len(self.groups[i]["paths"]):
            raise ValueError("no such member")
        s["pick"] = idx

    def confirm(self, i):
        s, g = self._at(i), self.groups[i]
        kept = g["paths"][s["pick"]]
        entry = next((e for e in self.mover.entries if e["group"] == i), None)
        if s["status"] != "confirmed" or entry is None or entry["kept"] != kept:
            self.mover.unapply(i)
            self.mover.reapply(i, kept, g["moves"](s["pick"]))
            s["status"] = "confirmed"

    def skip(self, i):
        s = self._at(i)
        if s["status"] == "skipped":
            s["status"] = "pending"
        else:
            self.mover.unapply(i)
            s["status"] = "skipped"
