"""Checks of recorded histories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINEARIZABLE, VIOLATION, INCONCLUSIVE = "linearizable", "violation", "inconclusive"
BUDGET = 200_000
ABSENT = None


class Register:
    """One value: a write sets it, a read must see it, a compare-and-swap does both."""

    initial = ABSENT

    @staticmethod
    def step(state, op, argument, result):
        """(allowed, next state); an unknown result allows any."""
        if op == "write":
            return True, argument
        if op == "read":
            return result == "?" or result == state, state
        expected, new = argument
        if result == "?":
            return True, new if state == expected else state
        return (state == expected) == result, new if state == expected else state


class KeyValue:
    """A map of keys to values, as a sorted tuple of pairs so states can be remembered."""

    initial = ()

    @staticmethod
    def step(state, op, argument, result):
        held = dict(state)
        key, value = argument if op == "put" else (argument, None)
        if op == "put":
            held[key] = value
            return True, tuple(sorted(held.items()))
        if op == "delete":
            held.pop(key, None)
            return True, tuple(sorted(held.items()))
        return result == "?" or result == held.get(key), state


def linearize(history: list[tuple], model=Register, budget: int = BUDGET, initial=...) -> tuple[str, list[int]]:
    """(verdict, order) of operations (id, op, argument, result, invoked, returned or None).

    A depth-first search over the operations that may come next, those invoked before any
    other pending one returned, remembering (done, state) pairs. One without a return may
    have taken effect at any time after its invocation, or never. Beyond ``budget`` steps
    the verdict is inconclusive, which is neither of the others.
    """
    ops = sorted(history, key=lambda o: o[4])
    must = sum(1 << i for i, o in enumerate(ops) if o[5] is not None)
    end = float("inf")
    seen, stack, steps = set(), [(0, model.initial if initial is ... else initial, ())], 0
    while stack:
        done, state, order = stack.pop()
        if done & must == must:
            return LINEARIZABLE, list(order)
        if (done, state) in seen:
            continue
        seen.add((done, state))
        steps += 1
        if steps > budget:
            return INCONCLUSIVE, []
        left = [i for i in range(len(ops)) if not done >> i & 1]
        first_return = min((ops[i][5] if ops[i][5] is not None else end) for i in left)
        for i in reversed(left):
            ident, op, argument, result, invoked, returned = ops[i]
            if invoked <= first_return:
                fits, after = model.step(state, op, argument, "?" if returned is None else result)
                if fits:
                    stack.append((done | 1 << i, after, (*order, ident)))
    return VIOLATION, []


def linearizable(history: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(key, verdict, operations) a key; (key, op_id, kind, value, invoked, returned) in. Being linearizable is local, so
    keys are searched apart, and a key's history is cut where nothing is pending: before and after are searched in turn
    only if the cut leaves a single state, a write that ended alone."""

    def check(group: pd.DataFrame) -> pd.DataFrame:
        none = lambda v: None if v is None or v != v else int(v)
        rows = [(
            int(r.op_id), r.kind, none(r.value) if r.kind == "write" else None,
            none(r.value) if r.kind == "read" else None, int(r.invoked), none(r.returned),
        ) for r in group.itertuples()]
        # A read without an answer says nothing, and an unanswered write that no read saw may as well never have happened.
        read = {o[3] for o in rows if o[1] == "read" and o[5] is not None}
        total, rows = len(rows), sorted((o for o in rows if o[5] is not None or (o[1] == "write" and o[2] in read)), key=lambda o: o[4])
        verdict, part, initial, latest, open_ended = LINEARIZABLE, [], ABSENT, -1, False
        for row in [*rows, None]:
            settled = part and row and not open_ended and row[4] > latest and part[-1][1] == "write" and all(o[5] < part[-1][4] for o in part[:-1])
            if part and (row is None or settled):
                verdict = linearize(part, Register, budget, initial)[0]
                if verdict != LINEARIZABLE or row is None:
                    break
                initial, part = part[-1][2], []
            if row is not None:
                part.append(row)
                latest, open_ended = max(latest, row[5] or 0), open_ended or row[5] is None
        return pd.DataFrame({"key": [group["key"].iloc[0]], "verdict": [verdict], "operations": [total]})

    return history.groupBy("key").applyInPandas(check, "key long, verdict string, operations long")


def stale_reads(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Reads (key, op_id, invoked, version) of a version below one whose write had returned before: a cheap necessary check.

    One pass a key in order of time: the highest version acknowledged so far runs along, so no pair is ever formed.
    """
    marks = writes.where("returned IS NOT NULL").select(
        "key", F.col("returned").alias("at"), "version", F.lit(None).cast("long").alias("op_id"),
        F.lit(None).cast("long").alias("seen"),
    )
    asks = reads.select(
        "key", F.col("invoked").alias("at"), F.lit(None).cast("long").alias("version"), "op_id",
        F.col("version").alias("seen"),
    )
    before = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = marks.union(asks).withColumn("acknowledged", F.max("version").over(before))
    return rows.where("op_id IS NOT NULL AND seen < acknowledged").select("key", "op_id", "seen", "acknowledged")
