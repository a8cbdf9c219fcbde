"""Goals and funnels: definitions, matching and the ordered walk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.urls import glob
from footfall.schema import FUNNEL_STEP, GOAL

TYPES = ("url", "event", "element", "duration", "scroll")
LIVE = ("url", "event", "element")


@dataclass(frozen=True)
class Goal:
    handle: str
    type: str
    target: str
    name: str = ""
    value: str = "0"
    enabled: bool = True
    site_id: int | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown goal type: {self.type}")
        if not self.handle or not self.target:
            raise ValueError("a goal needs a handle and a target")
        if self.type in ("element", "duration", "scroll") and not self.target.isdigit():
            raise ValueError(f"the target of a goal of type {self.type} is a whole number")
        if self.type == "scroll" and int(self.target) not in (25, 50, 75, 100):
            raise ValueError("scroll goals are at 25, 50, 75 or 100")


@dataclass(frozen=True)
class Funnel:
    handle: str
    steps: tuple[str, ...]
    site_id: int | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if len(self.steps) < 2:
            raise ValueError("a funnel needs two steps")
        if len(set(self.steps)) != len(self.steps):
            raise ValueError("a funnel's steps must differ")


class Definitions:
    """Goals and funnels in order, kept consistent: handles are unique, steps name goals that exist."""

    def __init__(self, goals: tuple[Goal, ...] = (), funnels: tuple[Funnel, ...] = ()):
        self.goals: dict[str, Goal] = {}
        self.funnels: dict[str, Funnel] = {}
        for g in goals:
            self.save_goal(g)
        for f in funnels:
            self.save_funnel(f)

    def save_goal(self, goal: Goal) -> None:
        self.goals[goal.handle] = goal

    def delete_goal(self, handle: str) -> None:
        """The goal goes from funnels too; a funnel left with fewer than two steps goes with it."""
        self.goals.pop(handle, None)
        for name, f in list(self.funnels.items()):
            steps = tuple(s for s in f.steps if s != handle)
            if len(steps) < 2:
                del self.funnels[name]
            elif steps != f.steps:
                self.funnels[name] = Funnel(name, steps, f.site_id, f.enabled)

    def reorder(self, handles: list[str]) -> None:
        rest = [h for h in self.goals if h not in handles]
        self.goals = {h: self.goals[h] for h in [*handles, *rest] if h in self.goals}

    def save_funnel(self, funnel: Funnel) -> None:
        missing = [s for s in funnel.steps if s not in self.goals]
        if missing:
            raise ValueError(f"unknown goals: {missing}")
        self.funnels[funnel.handle] = funnel

    def goal_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, g.name or g.handle, g.handle, g.type, g.target, g.value, g.enabled, g.site_id) for i, g in enumerate(self.goals.values(), 1)]
        text = GOAL.replace("value decimal(14,2)", "value string")
        return spark.createDataFrame(rows, text).withColumn("value", F.col("value").cast("decimal(14,2)"))

    def step_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.handle, f.site_id, i, s) for f in self.funnels.values() if f.enabled for i, s in enumerate(f.steps, 1)]
        return spark.createDataFrame(rows, FUNNEL_STEP)


def live_goals(definitions: Definitions) -> list[tuple[int, str, Column]]:
    """(number, handle, whether a hit reaches it) of the goals that single hits can reach."""
    plain, view = F.substring_index("path", "?", 1), F.col("kind") == "view"
    out = []
    for i, g in enumerate(definitions.goals.values(), 1):
        if not g.enabled or g.type not in LIVE:
            continue
        if g.type == "url":
            ok = view & plain.rlike(glob(g.target))
        elif g.type == "event":
            ok = (F.col("kind") == "event") & F.col("event_name").eqNullSafe(g.target)
        else:
            ok = view & F.col("element_id").eqNullSafe(int(g.target))
        out.append((i, g.handle, ok if g.site_id is None else ok & (F.col("site_id") == g.site_id)))
    return out


def at_close(sessions: DataFrame, definitions: Definitions) -> DataFrame:
    """Sessions with `conversions`: live goals reached and duration and scroll goals met, in order of definition."""
    met = []
    for g in definitions.goals.values():
        if not g.enabled:
            continue
        here = F.lit(True) if g.site_id is None else F.col("site_id") == g.site_id
        if g.type in LIVE:
            ok = F.array_contains("goals", g.handle)
        elif g.type == "duration":
            ok = F.col("duration_ms") >= int(g.target) * 1000
        else:
            ok = F.col("max_scroll") >= int(g.target)
        met.append(F.when(here & ok, F.lit(g.handle)))
    found = F.filter(F.array(*met), lambda x: x.isNotNull()) if met else F.array().cast("array<string>")
    return sessions.withColumn("conversions", found)


def reached_step(steps: tuple[str, ...], types: dict[str, str]) -> Column:
    """How many of a funnel's steps a session (goals, conversions) took, one after the other.

    Live goals must follow each other in the order they were reached; duration and scroll goals must be met but
    have no place in that order; a step whose goal is gone ends the walk.
    """
    state = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("reached"), F.lit(True).alias("on"))
    for handle in steps:
        kind = types.get(handle)
        if kind is None:
            break
        if kind in LIVE:
            rest = F.slice("goals", state["pos"] + 1, F.size("goals") + 1)
            at = F.array_position(rest, handle).cast("int")
            ok, moved = at > 0, state["pos"] + at
        else:
            ok, moved = F.array_contains("conversions", handle), state["pos"]
        on = state["on"] & ok
        state = F.struct(F.when(on, moved).otherwise(state["pos"]).alias("pos"), (state["reached"] + F.when(on, 1).otherwise(0)).alias("reached"), on.alias("on"))
    return state["reached"]
