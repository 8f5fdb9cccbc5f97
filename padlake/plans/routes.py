"""Join routes: chains of padded joins of two to four tables.

pipelined      the batches of one join are the buckets of the next
repartitioned  the dummies of a join's result go, its real rows are partitioned anew, maybe on another key
uniform        equal intervals, no budget for partitions
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from padlake.functions.metadata import Budget, JoinMeta, meta_sql
from padlake.functions.noise import Keyed, ShiftedGeometric
from padlake.operators import bucket, frequency, interval_join, partition
from padlake.operators.held import cut, held
from padlake.operators.interval_join import Side

SOURCE = Keyed()


@dataclass
class Run:
    """What a route has made: the last side, the batches of each join, and the cost events."""

    side: Side
    batches: list[DataFrame] = field(default_factory=list)
    events: list[DataFrame] = field(default_factory=list)

    def costs(self) -> DataFrame:
        first, *rest = self.events
        for e in rest:
            first = first.union(e)
        return first


@dataclass(frozen=True)
class Route:
    """kind: pipelined, repartitioned or uniform; merges: one for each join; bounded: whether padding is held at the bound."""

    name: str
    kind: str
    budget: Budget
    merges: tuple[int, ...]
    domain: int
    bounded: bool = False
    bins: int = 8

    def meta(self, freq: DataFrame, table: str) -> JoinMeta:
        """Noisy frequency bound; the only number of a table that the driver learns. Tables are apart, so each gets the whole share."""
        return JoinMeta.of_frequency(frequency.max_freq(freq).first().max_freq, *self.budget.meta, SOURCE, f"{self.name}/{table}")

    def prepared(self, freq: DataFrame, table: str, sens: int = 1) -> Side:
        """A table's histogram, partitioned and padded."""
        eps, delta = self.budget.stage
        tag = f"{self.name}/{table}"
        if self.kind == "uniform":
            parts = partition.uniform_parts(freq.sparkSession, self.domain, self.bins)
        else:
            parts = partition.private_parts(freq, partition.PrivateScan.offline(eps, delta, self.domain, sens), SOURCE, tag)
        return Side(freq, cut(bucket.buckets(freq, parts, self.domain, ShiftedGeometric(eps, delta, sens), SOURCE, tag)), self.domain)

    def joined(self, run: Run, other: Side, k: int, metas: tuple[JoinMeta, JoinMeta]) -> JoinMeta:
        """One more join of the run; returns the metadata of its result."""
        eps, delta = self.budget.stage
        meta = metas[0].join(metas[1])
        run.side, batches = interval_join.padded_join(run.side, other, self.merges[k], ShiftedGeometric(eps, delta, meta.b), SOURCE, f"{self.name}/join{k}", metas if self.bounded else None)
        run.batches.append(batches)
        run.events.append(interval_join.cost_events(f"join{k + 1}", batches))
        return meta

    def same_key(self, tables: dict[str, DataFrame]) -> Run:
        """A left-deep chain over tables of one key; ``tables``: name to keyed histogram, in join order, which noise depends on."""
        names = list(tables)
        freqs = {t: held(f) for t, f in tables.items()}
        metas = {t: self.meta(f, t) for t, f in freqs.items()}
        run, meta = Run(self.prepared(freqs[names[0]], names[0])), metas[names[0]]
        for k, t in enumerate(names[1:]):
            if k and self.kind == "repartitioned":
                before = run.side.buckets
                run.side = self.prepared(run.side.freq, f"again{k}", meta.b)
                run.events.append(interval_join.repartition_events(f"again{k}", before, run.side.buckets))
            meta = self.joined(run, self.prepared(freqs[t], t), k, (meta, metas[t]))
        return run

    def chain(self, first: DataFrame, bridge: DataFrame, last: DataFrame, rekey: Callable[[DataFrame], DataFrame], bridge_max: DataFrame) -> Run:
        """(first JOIN bridge ON key) JOIN last ON another key of bridge.

        ``rekey`` gives the histogram of the first join's real rows on the other key, ``bridge_max`` (max_freq) the
        larger of the bridge's frequencies on both keys.
        """
        first, bridge, last = held(first), held(bridge), held(last)
        m1, m3 = self.meta(first, "first"), self.meta(last, "last")
        m2 = JoinMeta.of_frequency(bridge_max.first().max_freq, *self.budget.meta, SOURCE, f"{self.name}/bridge")
        run = Run(self.prepared(first, "first"))
        meta = self.joined(run, self.prepared(bridge, "bridge"), 0, (m1, m2))
        before = run.side.buckets
        run.side = self.prepared(held(rekey(run.side.freq)), "again1", meta.b)
        run.events.append(interval_join.repartition_events("again1", before, run.side.buckets))
        self.joined(run, self.prepared(last, "last"), 1, (meta, m3))
        return run

    # The same as DuckDB SQL: ``ctes`` are common table expressions that define a histogram t_freq for each table t

    def _prepared_sql(self, table: str, tag: str, sens: str | None = None) -> str:
        """``sens``: SQL of the sensitivity, where it isn't 1."""
        eps, delta = self.budget.stage
        noise = (sens, eps, delta) if sens else ShiftedGeometric(eps, delta)
        if self.kind == "uniform":
            parts = f"{table}_parts AS ({partition.uniform_parts_sql(self.domain, self.bins)})"
        else:
            scan = partition.PrivateScan.offline(eps, delta, self.domain)
            parts = partition.private_parts_sql(f"{table}_parts", f"{table}_freq", scan, SOURCE, f"{self.name}/{tag}", (sens, eps, delta) if sens else None)
        return f"{parts},{bucket.buckets_sql(table, f'{table}_freq', f'{table}_parts', noise, SOURCE, f'{self.name}/{tag}')}"

    def _meta_sql(self, table: str, most: str) -> str:
        eps, delta = self.budget.meta
        return f"{table}_meta AS (SELECT {meta_sql('m', eps, delta, SOURCE, f'{self.name}/{table}')} AS a, 1::BIGINT AS b FROM ({most}))"

    def _joined_sql(self, k: int, left: str, left_meta: str, right: str) -> list[str]:
        eps, delta = self.budget.stage
        meta = f"j{k}_meta AS MATERIALIZED (SELECT x.a * y.a AS a, greatest(x.a * y.b, y.a * x.b) AS b FROM {left_meta} x, {right}_meta y)"
        metas = (f"(SELECT a FROM {left_meta})", f"(SELECT a FROM {right}_meta)") if self.bounded else None
        return [meta, interval_join.padded_join_sql(f"j{k}", left, right, self.merges[k], (f"(SELECT b FROM j{k}_meta)", eps, delta), SOURCE, f"{self.name}/join{k}", metas)]

    def same_key_sql(self, ctes: str, tables: list[str]) -> str:
        """WITH ... up to the last join, named j<n>; what is partitioned anew is named again<n>."""
        parts = [ctes, *(self._meta_sql(t, f"SELECT max(freq) AS m FROM {t}_freq") for t in tables), *(self._prepared_sql(t, t) for t in tables)]
        left, meta = tables[0], f"{tables[0]}_meta"
        for k, t in enumerate(tables[1:]):
            if k and self.kind == "repartitioned":
                parts.append(f"again{k}_freq AS (SELECT * FROM {left}_freq)")
                parts.append(self._prepared_sql(f"again{k}", f"again{k}", f"(SELECT b FROM {meta})"))
                left = f"again{k}"
            parts += self._joined_sql(k, left, meta, t)
            left, meta = f"j{k}", f"j{k}_meta"
        return "WITH RECURSIVE " + ",\n".join(parts)

    def chain_sql(self, ctes: str, bridge_max: str, again_freq: str) -> str:
        """WITH ... up to j1, the chain's last join. ``ctes`` define first_freq, bridge_freq and last_freq, ``again_freq`` selects the histogram of the first join on the other key."""
        most = {"first": "SELECT max(freq) AS m FROM first_freq", "bridge": bridge_max, "last": "SELECT max(freq) AS m FROM last_freq"}
        parts = [ctes, *(self._meta_sql(t, sql) for t, sql in most.items()), *(self._prepared_sql(t, t) for t in most)]
        parts += self._joined_sql(0, "first", "first_meta", "bridge")
        parts += [f"again1_freq AS MATERIALIZED ({again_freq})", self._prepared_sql("again1", "again1", "(SELECT b FROM j0_meta)")]
        parts += self._joined_sql(1, "again1", "j0_meta", "last")
        return "WITH RECURSIVE " + ",\n".join(parts)
