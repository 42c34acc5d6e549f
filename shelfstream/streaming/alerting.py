"""Alert rules on a stream of log rows: event-time timers move them from tick to tick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shelfstream.operators.alerts import NAMES, RULES, Rule, counters

OUTPUT = "rule string, at_unix long, state string"


class AlertState(StatefulProcessor):
    """Counts of the ticks that the rule's windows reach, and how far it has been evaluated.

    A tick is evaluated when the watermark has passed its end, whether or not it
    saw traffic, so silence resolves an alert or raises one. State per rule is
    one row of counts per tick of its longest window.
    """

    def __init__(self, rules: Sequence[Rule], every: int):
        self.rules, self.every = {r.name: r for r in rules}, every

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "tick long", "counts array<long>")
        self.place = handle.getValueState("place", "next long, since long, fired boolean, begun boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for row in rows:
            tick = (row.tick,)
            known = self.counts.getValue(tick)[0] if self.counts.containsKey(tick) else [0] * len(row.counts)
            self.counts.updateValue(tick, ([a + b for a, b in zip(known, row.counts, strict=True)],))
            first = row.tick if first is None else min(first, row.tick)
        if first is None:
            return iter(())
        # Until something has been evaluated an earlier tick may still come.
        known = self.place.get() if self.place.exists() else None
        if known is None or not known[3] and first < known[0]:
            self.place.update((first, None, False, False))
            self.handle.registerTimer((first + 1) * self.every * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rule, every = self.rules[key[0]], self.every
        tick, since, fired, begun = self.place.get()
        until = timerValues.getCurrentWatermarkInMs() // 1000 // every - 1
        held = {k[0]: list(v[0]) for k, v in self.counts.iterator()}
        columns = {c: (NAMES.index(c.counter), None if c.total is None else NAMES.index(c.total)) for c in rule.conditions}
        # Sums of each window as of the tick before.
        sums = {}
        for c, (a, b) in columns.items():
            inside = [v for t, v in held.items() if tick - c.seconds // every <= t < tick]
            sums[c] = [sum(v[a] for v in inside), 0 if b is None else sum(v[b] for v in inside)]
        while tick <= until:
            for c, (a, b) in columns.items():
                for at, sign in ((tick, 1), (tick - c.seconds // every, -1)):
                    if at in held:
                        sums[c][0] += sign * held[at][a]
                        sums[c][1] += sign * held[at][b] if b is not None else 0
            now = (tick + 1) * every
            if all(c.holds(*sums[c]) for c in rule.conditions):
                if since is None:
                    since = now
                    if rule.wait > 0:
                        yield Row(rule=rule.name, at_unix=now, state="pending")
                if not fired and now - since >= rule.wait:
                    fired = True
                    yield Row(rule=rule.name, at_unix=now, state="firing")
            elif since is not None:
                yield Row(rule=rule.name, at_unix=now, state="resolved" if fired else "cleared")
                since, fired = None, False
            tick += 1
        reach = max(c.seconds for c in rule.conditions) // every
        for t in held:
            if t < tick - reach:
                self.counts.removeKey((t,))
        self.place.update((tick, since, fired, begun or bool(held) and tick > min(held)))
        self.handle.registerTimer((tick + 1) * every * 1000)

    def close(self) -> None:
        pass


def alert_stream(
    log: DataFrame, rules: Sequence[Rule] = RULES, every: int = 30, lateness: str = "5 minutes"
) -> DataFrame:
    """(rule, at_unix, state) as it happens: equal to the batch transitions up to the watermark.

    Rows that arrive later than ``lateness`` behind the newest are not counted.
    A row without request_id is a heartbeat: it counts for nothing but moves
    the clock. Each row becomes one small row per rule; these are what is
    shuffled, so their number is cut first by counting within Arrow batches.
    """
    tick = F.floor(F.unix_timestamp("served_ts") / every).cast("long")
    real = F.col("request_id").isNotNull()
    shaped = log.filter("served_ts is not null").select(
        tick.alias("tick"), *[F.coalesce((real & c).cast("long"), F.lit(0).cast("long")).alias(n) for n, c in counters().items()]
    )
    fields = ", ".join(f"{n} long" for n in NAMES)

    def tally(batches):
        for batch in batches:
            yield batch.groupby("tick", as_index=False, sort=False).sum()

    counted = shaped.mapInPandas(tally, f"tick long, {fields}")
    return (
        counted.select(
            F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule"), "tick", F.array(*NAMES).alias("counts"),
            F.timestamp_seconds(F.col("tick") * every).alias("at"),
        )
        .withWatermark("at", lateness)
        .groupBy("rule")
        .transformWithState(AlertState(rules, every), OUTPUT, "Append", "EventTime")
    )
