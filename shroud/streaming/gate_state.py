"""Per-session state for the live PII gate and downgrade guard (ST3/ST4).

A `StatefulProcessor` keyed by session. State is one typed value: the session's
scalars (epoch, provider, tiers, latch, last action, flags) and two maps from PII
type to a count (context hits, baseline), at most an entry a type. It is read once
and written once a micro-batch, as every call to the state store is a round trip
between the worker and the JVM. The decisions are the batch replay's, one event at
a time.

The streams take the form on rows (`GateRowProcessor`): most sessions have few
events in a micro-batch, and data frames of a few rows cost more than the events
in them. A row's cells are read one at a time, so events come in and decisions go
out as JSON, one cell each. Either way the rows of a micro-batch are put in `seq` order, so arrival
order inside it doesn't matter. A row of
a later micro-batch counts as arriving later, whatever its `seq`: a resolution
that lands after the next request was decided changes nothing about that request.

With an idle time, an event that comes so long (event time) after the session's
last one starts a new session state; a timer drops the old one when the watermark
gets there first.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections import namedtuple
from collections.abc import Iterable, Iterator
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import seeds
from ..operators.detect import SECRET_TYPES, TYPE_ORDER, col_name
from ..operators.session import DOWNGRADE_ANSWERS, PII_ANSWERS

EXPOSURE = {t[0]: t[5] for t in seeds.TIERS}

OUTPUT_DDL = ("session_id bigint, seq bigint, at timestamp, out_kind string, epoch bigint, tier string, gated boolean, fresh boolean, "
              "prompted boolean, action string, pass_no int, switch_seq bigint, from_tier string, to_tier string, severity string, "
              "decision string")
OUTPUT = [c.split()[0] for c in OUTPUT_DDL.split(", ")]
#: The session's scalars: (name, type, value of a new session).
SCALARS = [("epoch", "bigint", 0), ("provider", "string", None), ("tier", "string", None), ("before", "string", None),
           ("switch_seq", "bigint", None), ("armed", "boolean", False), ("latch", "string", None), ("last_action", "string", None),
           ("remembered", "boolean", False), ("redacting", "boolean", False), ("last_ms", "bigint", 0)]
STATE_DDL = ", ".join(f"{n} {t}" for n, t, _ in SCALARS) + ", context map<string, bigint>, baseline map<string, bigint>"
MERGED = ["session_id", "seq", "kind", "at", "provider", "ceiling", "resolved", "answer_i", "can_prompt", "unattended", "pii_policy",
          "downgrade_policy"]


def _known(tier):
    return None if tier is None or pd.isna(tier) or tier == "pending" else tier


class GateProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE_DDL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ordered = [frame.sort_values("seq", kind="stable").itertuples(index=False) for frame in rows]
        if out := self._replay(key, heapq.merge(*ordered, key=attrgetter("seq"))):
            yield pd.DataFrame(out, columns=OUTPUT, dtype=object)  # string columns as Python objects, as Arrow conversion expects

    def _replay(self, key, ordered: Iterable) -> list[dict]:
        """The session's events of a micro-batch, in order, from the state kept before to the state kept after."""
        *scalars, ctx, base = self.session.get() or (*(new for _, _, new in SCALARS), {}, {})
        self.st = {n: v for (n, _, _), v in zip(SCALARS, scalars)}
        self.ctx, self.base = dict(ctx), dict(base)
        out: list[dict] = []
        sid = None if key[0] is None else int(key[0])
        for r in ordered:
            if self.idle_ms and self.st["last_ms"] and int(r.at_ms) - self.st["last_ms"] >= self.idle_ms:
                self.st = {n: new for n, _, new in SCALARS}
                self.ctx.clear(), self.base.clear()
            if r.at_ms is not None:
                self.st["last_ms"] = max(self.st["last_ms"], int(r.at_ms))
            {"model_select": self._switch, "tier_resolved": self._resolved, "payload": self._payload}[r.kind](sid, r, out)
        self.session.update((*(self.st[n] for n, _, _ in SCALARS), self.ctx, self.base))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.st["last_ms"] + self.idle_ms)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _found(self, r) -> list[tuple[str, int]]:
        """(type, count) of the findings in a request's new message."""
        return [(t, n) for t in TYPE_ORDER if (n := int(getattr(r, f"m_{col_name(t)}")))]

    @staticmethod
    def _row(sid, r, kind, **kw) -> dict:
        return {"session_id": sid, "seq": int(r.seq), "at": r.at, "out_kind": kind, **kw}

    def _switch(self, sid, r, out) -> None:
        st = self.st
        before = _known(st["tier"])
        if r.provider != st["provider"]:
            self.base.clear()
            st["last_action"] = None
            st["epoch"] += 1
        st.update(provider=r.provider, tier="pending", before=before, armed=True, switch_seq=int(r.seq))
        self._guard(sid, r, 1, _known(r.ceiling), out)

    def _resolved(self, sid, r, out) -> None:
        self.st["tier"] = r.resolved
        if self.st["armed"]:
            self._guard(sid, r, 2, _known(r.resolved), out)

    def _guard(self, sid, r, pass_no: int, to: str | None, out: list) -> None:
        """The downgrade guard of one transition: fires at most once, then is disarmed."""
        st, carried = self.st, [t for t, n in self.ctx.items() if n > 0]
        if (r.downgrade_policy == "off" or not carried or st["before"] is None or to is None
                or EXPOSURE[to] <= EXPOSURE[st["before"]]):
            return
        st["armed"] = False
        severity = "secret" if any(t in SECRET_TYPES for t in carried) else "pii"
        answer = DOWNGRADE_ANSWERS[int(r.answer_i) % len(DOWNGRADE_ANSWERS)]
        if r.downgrade_policy == "block":
            decision = "revert"
        elif r.can_prompt:
            decision = "revert" if answer in ("stay", "cancel") else answer
        else:
            decision = "revert" if severity == "secret" else "notice"
        if decision == "switch+redact":
            st.update(latch="redact", redacting=True)
        out.append(self._row(sid, r, "downgrade", pass_no=pass_no, switch_seq=st["switch_seq"], from_tier=st["before"], to_tier=to,
                             severity=severity, decision=decision))

    def _payload(self, sid, r, out) -> None:
        st, ctx, base = self.st, self.ctx, self.base
        for t, n in self._found(r):
            ctx[t] = ctx.get(t, 0) + n
        tier = _known(st["tier"])
        hits = {t: n for t, n in ctx.items() if n > 0}
        gated = r.pii_policy != "off" and tier not in ("tee-verified", "local") and bool(hits)
        fresh = prompted = False
        action = "pass"
        if gated:
            fresh = any(n > base.get(t, 0) for t, n in hits.items())
            answer = PII_ANSWERS[int(r.answer_i) % len(PII_ANSWERS)]
            said = "redact" if answer.startswith("redact") else "send"
            asks = fresh and r.pii_policy == "warn" and not r.unattended and bool(r.can_prompt)
            decided = None
            if fresh:
                decided = "redact" if r.pii_policy == "redact" or r.unattended else said if r.can_prompt else "send"
            action = (st["latch"] or ("redact" if r.pii_policy == "redact" else None) or decided or st["last_action"] or "send")
            prompted = asks and st["latch"] is None
            for t, n in hits.items():
                base[t] = max(base.get(t, 0), n)
            if fresh:
                st["last_action"] = decided
            if asks and answer.endswith("+remember"):
                if not st["remembered"] and not st["redacting"]:
                    st["latch"] = said
                st["remembered"] = True
        out.append(self._row(sid, r, "pii", epoch=st["epoch"], tier=tier, gated=gated, fresh=fresh, prompted=prompted, action=action))


#: A session's event as the processor on rows holds it; `at` in microseconds.
STEP = [*(c for c in MERGED if c != "session_id"), "at_ms", "hits"]
Step = namedtuple("Step", STEP, defaults=[None] * len(STEP))
DECISIONS_A_ROW = 1_000


def packed_step() -> Column:
    """A timeline row as the JSON of its `Step`; what is null is left out."""
    return F.to_json(F.struct(*[F.unix_micros("at").alias("at") if c == "at" else F.unix_millis("at").alias(c) if c == "at_ms" else F.col(c)
                                for c in STEP])).alias("step")


def unpacked(decisions: DataFrame) -> DataFrame:
    """The rows (`OUTPUT_DDL`) that `GateRowProcessor` gives out."""
    ddl = OUTPUT_DDL.replace("at timestamp", "at bigint")
    rows = decisions.select(F.inline(F.from_json("decisions", f"array<struct<{ddl.replace(' ', ': ').replace(',: ', ', ')}>>")))
    return rows.select(*[F.timestamp_micros("at").alias("at") if c == "at" else c for c in OUTPUT])


class GateRowProcessor(GateProcessor):
    """The same on rows with a `step` (`packed_step`), which holds the findings of a request's message as one array."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # one copy of each word (kinds, tiers, policies) for all rows held
        steps = [Step(**{c: sys.intern(v) if type(v) is str else v for c, v in json.loads(r.step).items()}) for r in rows]
        steps.sort(key=attrgetter("seq"))
        out = self._replay(key, steps)
        for i in range(0, len(out), DECISIONS_A_ROW):
            yield Row(decisions=json.dumps(out[i:i + DECISIONS_A_ROW]))

    def _found(self, r: Step) -> list[tuple[str, int]]:
        return [(h["type"], h["count"]) for h in r.hits or ()]
