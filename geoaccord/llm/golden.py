"""Golden records: one record per cluster, each field from the record that its rule ranks first.

Every partition of the input prunes its own rows first (map-side dominance pruning): of a cluster it keeps the rows that
win a slot, which are the most recent one, and by each rule the first of every trust level or segment. A row that wins no
slot of its partition wins none at all, so nothing is lost; a cluster of any size leaves a bounded number of rows a
partition. Beside them go the counts of records. Whether a record is stale depends on the latest of the whole cluster:
those that are stale by the partition's own latest are added up at once; the others are counted by their time, as rows
without fields, and compared with the cluster's latest by a join that adaptive execution can split.

Where there are more partitions than ``FAN_IN``, survivors are dealt out by cluster and group of partitions and pruned
again, until ``FAN_IN`` are left; only then do the survivors of a cluster meet in one group.

Order of records. RECENT: latest time (null last), higher trust, smaller id (null last), then smaller fields, so that
records which repeat an id have an order. TRUSTED: fresh before stale, higher trust, then RECENT.

Cases: text that is empty or holds only white space counts as null, and so does a number that is not finite; an unknown
or null source has the lowest trust; a null time is stale; rows without a cluster are one cluster; rows that repeat are
records of their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SPACE, drop, materialize

#: Rows that a task holds before it prunes them, and partitions whose survivors one task takes.
BUFFER, FAN_IN = 100_000, 64
#: Groups of clusters for each shuffle partition, and rows of a group.
SPREAD, GROUP_ROWS = 8, 20_000


@dataclass(frozen=True)
class Rules:
    """Sources by falling trust, hours after which a record is stale, and the rule of each field.

    ``recent``: the first by RECENT; ``trusted``: the first by TRUSTED; ``longest``: most code points, then TRUSTED;
    ``within``: (field, by): records with the chosen ``by`` (itself a recent field) first, then RECENT; ``together``:
    (name, fields): one record gives all fields, the one with most of them, then TRUSTED. Each takes non-null values.
    """

    sources: tuple[str, ...] = ("crm", "web", "store", "partner")
    stale_hours: int = 60 * 24
    recent: tuple[str, ...] = ("segment",)
    trusted: tuple[str, ...] = ("email",)
    longest: tuple[str, ...] = ("name",)
    within: tuple[tuple[str, str], ...] = (("balance", "segment"),)
    together: tuple[tuple[str, tuple[str, ...]], ...] = (("address", ("city", "nation_id")),)

    def fields(self) -> list[str]:
        return list(dict.fromkeys([*self.recent, *self.trusted, *self.longest, *(f for f, _ in self.within), *(f for _, many in self.together for f in many)]))


def _present(df: DataFrame, name: str) -> Column:
    """The column, with blank texts and numbers that are not finite as null."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.when(F.translate(column, WORD_SPACE, "") != "", column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    return column


def _records(df: DataFrame, cluster: Column, rules: Rules, id_col: str, source_col: str, time_col: str) -> DataFrame:
    """The rows under names of our own: cluster, id, trust, time, the fields, and the counts that a row stands for."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in rules.sources)), F.col(f"`{source_col}`")), F.lit(0))
    trust = F.when(place > 0, len(rules.sources) + 1 - place).otherwise(0).cast("int")
    at = F.col(f"`{time_col}`")
    return df.select(
        cluster.alias("cluster"), F.col(f"`{id_col}`").alias("id"), trust.alias("trust"), at.alias("at"), *(_present(df, f).alias(f"f{k}") for k, f in enumerate(rules.fields())),
        F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n"), F.when(at.isNull(), 1).otherwise(0).cast("long").alias("n_stale"), F.when(at.isNull(), 0).otherwise(1).cast("long").alias("n_open"),
    )


class _Slots:
    """Rows of many clusters in the order RECENT, and the first of each slot of a rule."""

    def __init__(self, table: pa.Table, rules: Rules):
        fields = [f"f{k}" for k in range(len(rules.fields()))]
        keys = [("at", "descending"), ("trust", "descending"), ("id", "ascending"), *((f, "ascending") for f in fields)]
        self.table = table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
        self.name = dict(zip(rules.fields(), fields, strict=True))
        self.cluster = self.codes("cluster")
        self.clusters = int(self.cluster.max(initial=-1)) + 1
        self.trust = table["trust"].to_numpy()
        self.has_time = table["at"].is_valid().to_numpy()
        self.at = pc.fill_null(table["at"].cast(pa.int64()), 0).to_numpy()
        self.latest_row = self.first(np.ones(len(table), bool), self.cluster)
        self.fresh_from = np.where(self.has_time[self.latest_row], self.at[self.latest_row] - rules.stale_hours * 3_600_000_000, np.iinfo(np.int64).max)

    def codes(self, column: str) -> np.ndarray:
        """Whole numbers from 0 for the values of a column, null among them."""
        return self.table[column].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(self.table) else np.zeros(0, np.int64)

    def present(self, field: str) -> np.ndarray:
        return self.table[self.name[field]].is_valid().to_numpy()

    def length(self, field: str) -> np.ndarray:
        return pc.fill_null(pc.utf8_length(self.table[self.name[field]]), 0).to_numpy()

    def filled(self, fields) -> np.ndarray:
        return sum(self.present(f).astype(np.int64) for f in fields)

    @property
    def fresh(self) -> np.ndarray:
        return self.has_time & (self.at >= self.fresh_from[self.cluster])

    def first(self, where: np.ndarray, *slot: np.ndarray, by: tuple[np.ndarray, ...] = ()) -> np.ndarray:
        """Rows that come first in their slot, by falling ``by`` and then RECENT; in the order of the slots."""
        rows = np.flatnonzero(where)
        for key in reversed(by):
            rows = rows[np.argsort(-key[rows].astype(np.int64), kind="stable")]
        code = np.zeros(len(rows), np.int64)
        for part in slot:
            code = code * (int(part.max(initial=0)) + 1) + part[rows]
        return rows[np.unique(code, return_index=True)[1]]


def prune(table: pa.Table, rules: Rules) -> pa.Table:
    """The survivors of some rows, with the counts of those that went, and a row a time that is still undecided."""
    s = _Slots(table, rules)
    table, every = s.table, np.ones(len(s.table), bool)
    winners = [s.latest_row, *(s.first(s.present(f), s.cluster) for f in rules.recent), *(s.first(s.present(f), s.cluster, s.trust) for f in rules.trusted)]
    winners += [s.first(s.present(f), s.cluster, s.trust, by=(s.length(f),)) for f in rules.longest]
    winners += [s.first(s.present(f), s.cluster, s.codes(s.name[by])) for f, by in rules.within]
    winners += [s.first(every, s.cluster, s.trust, by=(s.filled(fields),)) for _, fields in rules.together]
    kept = np.zeros(len(table), bool)
    kept[np.concatenate(winners)] = True
    n, stale, undecided = (table[c].to_numpy().copy() for c in ("n", "n_stale", "n_open"))
    late = (undecided > 0) & ~s.fresh
    stale[late] += undecided[late]
    undecided[late] = 0
    # a row a cluster and time takes the undecided ones of that time, a survivor if there is one
    places = np.unique(s.at, return_inverse=True)[1]
    open_rows = undecided > 0
    taking = s.first(open_rows | (kept & s.has_time), s.cluster, places, by=(kept,))
    time_code = s.cluster * (int(places.max(initial=0)) + 1) + places
    sums = np.zeros(len(taking), np.int64)
    np.add.at(sums, np.searchsorted(time_code[taking], time_code[open_rows]), undecided[open_rows])
    undecided[:] = 0
    undecided[taking] = sums
    stays = kept | (undecided > 0)
    for counts in (n, stale):  # counts of rows that go move to the latest row of the cluster
        np.add.at(counts, s.latest_row[s.cluster[~stays]], counts[~stays])
    columns = {}
    for name in table.column_names:
        column = table[name]
        columns[name] = pc.if_else(pa.array(kept), column, pa.scalar(None, column.type)) if name.startswith("f") else column
    columns |= {"kept": pa.array(kept), "n": pa.array(n), "n_stale": pa.array(stale), "n_open": pa.array(undecided)}
    return pa.table(columns).filter(pa.array(stays))


def _pruned(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """Prunes a partition with a bounded buffer: what does not shrink in it leaves it."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.table(batch.columns, names=batch.schema.names))  # without the batch's own word on nulls, which pruned rows lack
        rows += batch.num_rows
        if rows >= BUFFER:
            one = prune(pa.concat_tables(held), rules)
            if one.num_rows > BUFFER // 2:
                yield from one.combine_chunks().to_batches()
                one = one.slice(0, 0)
            held, rows = [one], one.num_rows
    if rows:
        yield from prune(pa.concat_tables(held), rules).combine_chunks().to_batches()


def survivors(records: DataFrame, rules: Rules) -> DataFrame:
    """A written table of the rows that win a slot (``kept``) and of counts by time, after all levels of pruning."""
    def pruned(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda batches: _pruned(batches, rules), records.schema).withColumn("part", F.spark_partition_id())

    table = materialize(pruned(records), "survivors")
    while (parts := (table.agg(F.max("part")).first()[0] or 0) + 1) > FAN_IN:
        groups = -(-parts // FAN_IN)
        dealt = table.withColumn("part", F.col("part") % groups).repartition("cluster", "part").drop("part")
        again = dealt.mapInArrow(lambda batches: _pruned(batches, rules), records.schema)
        # a partition may hold several groups, so the number of the group is that of the cluster's survivors
        smaller = materialize(again.withColumn("part", F.spark_partition_id() % groups), "survivors")
        drop(table)
        table = smaller
    return table


def _chosen(table: pa.Table, rules: Rules) -> pa.Table:
    """The golden records of the clusters in a group of survivors."""
    s = _Slots(table, rules)
    trusted, out = (s.fresh, s.trust), {"cluster": s.table["cluster"].take(s.latest_row)}

    def put(name: str, column: str, rows: np.ndarray, empty: np.ndarray | None = None) -> None:
        at = np.full(s.clusters, -1)
        at[s.cluster[rows]] = rows
        if empty is not None:
            at[(at >= 0) & empty[at]] = -1
        clusters = s.cluster[s.latest_row]
        out[name] = s.table[column].take(pa.array(at[clusters], mask=at[clusters] < 0))

    every, recent = np.ones(len(s.table), bool), {}
    for f in rules.recent:
        recent[f] = rows = s.first(s.present(f), s.cluster)
        put(f, s.name[f], rows)
        put(f"{f}_from", "id", rows)
    for f in rules.trusted:
        rows = s.first(s.present(f), s.cluster, by=trusted)
        put(f, s.name[f], rows)
        put(f"{f}_from", "id", rows)
    for f in rules.longest:
        rows = s.first(s.present(f), s.cluster, by=(s.length(f), *trusted))
        put(f, s.name[f], rows)
        put(f"{f}_from", "id", rows)
    for f, by in rules.within:
        value, chosen = s.codes(s.name[by]), np.full(s.clusters, -1)
        chosen[s.cluster[recent[by]]] = value[recent[by]]
        rows = s.first(s.present(f), s.cluster, by=((value == chosen[s.cluster]),))
        put(f, s.name[f], rows)
        put(f"{f}_from", "id", rows)
    for name, fields in rules.together:
        rows = s.first(every, s.cluster, by=(s.filled(fields), *trusted))
        for f in fields:
            put(f, s.name[f], rows)
        put(f"{name}_from", "id", rows, empty=s.filled(fields) == 0)
    return pa.table(out)


def golden(df: DataFrame, cluster: Column, rules: Rules = Rules(), id_col: str = "client_id", source_col: str = "source", time_col: str = "updated_at") -> DataFrame:
    """One row per cluster: ``cluster_id``, ``n_records``, ``n_stale``, the fields, and ``<field>_from`` (for fields that go
    together ``<name>_from``), the id of the record that gave the value, or null."""
    spark, kinds = df.sparkSession, {f: df.schema[f].dataType for f in rules.fields()}
    table = survivors(_records(df, cluster, rules, id_col, source_col, time_col), rules)
    id_type = df.schema[id_col].dataType
    single = [*rules.recent, *rules.trusted, *rules.longest, *(f for f, _ in rules.within)]
    columns = [("cluster", table.schema["cluster"].dataType)]
    for f in single:
        columns += [(f, kinds[f]), (f"{f}_from", id_type)]
    for name, fields in rules.together:
        columns += [*((f, kinds[f]) for f in fields), (f"{name}_from", id_type)]
    names = [f"c{k}" for k in range(len(columns))]  # outputs may be called like anything, also "cluster"
    schema = T.StructType([T.StructField(n, kind) for n, (_, kind) in zip(names, columns, strict=True)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(SPREAD * parts, table.count() // GROUP_ROWS)
    grouped = table.where("kept").withColumn("group", F.pmod(F.xxhash64("cluster"), F.lit(groups))).groupBy("group")
    picked = grouped.applyInArrow(lambda rows: _chosen(rows, rules).rename_columns(names), schema)
    latest = materialize(table.where("kept").groupBy("cluster").agg(F.max("at").alias("latest")).select(F.col("cluster").alias("of"), "latest"), "latest")
    stale_now = (F.col("n_open") > 0) & (F.col("at") < F.col("latest") - F.expr(f"make_dt_interval(0, {int(rules.stale_hours)})"))
    counted = table.join(latest, F.col("cluster").eqNullSafe(F.col("of"))).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n_stale") + F.when(stale_now, F.col("n_open")).otherwise(0)).alias("n_stale"))
    joined = picked.join(counted, F.col("c0").eqNullSafe(F.col("cluster")))
    return joined.select(F.col("c0").alias("cluster_id"), F.col("n").alias("n_records"), "n_stale", *(F.col(n).alias(name) for n, (name, _) in list(zip(names, columns, strict=True))[1:]))
