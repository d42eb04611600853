"""Functions that users bring: column functions, table functions and aggregates, all on Arrow batches."""

import pickle

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def register_fn(spark: SparkSession, name: str, fn, returns: str):
    """fn: pandas series -> pandas series, usable as a column function and in SQL."""
    made = F.pandas_udf(fn, returns)
    spark.udf.register(name, made)
    return made


def register_table_fn(spark: SparkSession, name: str, cls, returns: str):
    """cls: has eval(...), which yields rows; usable in SQL with LATERAL."""
    made = F.udtf(cls, returnType=returns)
    spark.udtf.register(name, made)
    return made


def register_agg(spark: SparkSession, name: str, fn, returns: str):
    """fn: pandas series of a group -> one value, usable in SQL. A group's series must fit into a worker; :func:`two_step_agg` has no such bound."""

    def aggregate(values: pd.Series) -> float:
        return fn(values)

    made = F.pandas_udf(aggregate, returns)
    spark.udf.register(name, made)
    return made


#: Groups whose states a task holds before it lets them go on, rows that it groups at once, and rows of merged states that leave it at once, about.
GROUPS, ROWS, MERGED = 50_000, 1 << 18, 10_000


def two_step_agg(df: DataFrame, keys: list[str], column: str, init, update, merge, finish, name: str, returns: str, fan: int = 64) -> DataFrame:
    """keys, name: an aggregate whose groups may be of any size.

    init() -> state; update(state, pandas series) -> state; merge(state, state) -> state; finish(state) -> value. Each task makes one state of its rows of a
    group, ``fan`` tasks' states are merged at a time, then those: no worker sees a group's rows, and a hot group's states are spread, too. A task goes
    through its states in order of their groups, so that many small groups cost no call each. merge must not care about order. Null keys are a group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    named = df.select(*keys, F.col(column).alias("__v"))

    def partial(frames):
        from pyspark import TaskContext

        part, states = TaskContext.get().partitionId(), {}

        def out():
            at = list(states)
            made = pd.DataFrame({k: pd.Series([a[i] for a in at], dtype=object) for i, k in enumerate(keys)})
            made["__part"], made["__state"] = part % fan, [pickle.dumps(states[a]) for a in at]
            states.clear()
            return made

        for frame in together(frames):
            for at, rows in frame.groupby(keys, dropna=False, sort=False)["__v"]:
                at = tuple(None if pd.isna(k) else k for k in at)
                states[at] = update(states[at] if at in states else init(), rows)
            if len(states) > GROUPS:
                yield out()
        if states:
            yield out()

    def together(frames):
        some, n = [], 0
        for frame in frames:
            if some and (n >= ROWS or not some[0].dtypes.equals(frame.dtypes)):  # integers with nulls are floats
                yield pd.concat(some, ignore_index=True)
                some, n = [], 0
            some.append(frame)
            n += len(frame)
        if some:
            yield pd.concat(some, ignore_index=True)

    def merged(last):
        def each(batches):
            kinds_of, groups, values, at = None, [], [], None

            def out():
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*groups, strict=True), kinds_of, strict=True)]
                if last:
                    columns.append(pa.array([finish(pickle.loads(v) if isinstance(v, bytes) else v[0]) for v in values], value_kind))
                else:
                    columns += [pa.array([0] * len(values), pa.int32()), pa.array([v if isinstance(v, bytes) else pickle.dumps(v[0]) for v in values], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=[*keys, name] if last else [*keys, "__part", "__state"])

            for batch in batches:
                kinds_of = [batch.schema.field(i).type for i in range(len(keys))]
                parts, states = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
                for *key, part, state in zip(*[batch.column(i).to_pylist() for i in range(len(keys))], parts, states, strict=True):
                    group = (key, 0 if last else part)
                    if group == at:
                        so_far = values[-1]
                        values[-1] = [merge(pickle.loads(so_far) if isinstance(so_far, bytes) else so_far[0], pickle.loads(state))]
                        continue
                    if len(groups) >= MERGED:
                        yield out()
                        groups, values = [], []
                    groups.append(key)
                    values.append(state)
                    at = group
            if groups:
                yield out()

        return each

    value_kind = to_arrow_schema(df.sparkSession.createDataFrame([], f"v {returns}").schema).field(0).type
    in_order = lambda rows, *by: rows.repartition(*by).sortWithinPartitions(*by)
    states = named.mapInPandas(partial, f"{kinds}, __part int, __state binary")
    bundles = in_order(states, *keys, "__part").mapInArrow(merged(False), f"{kinds}, __part int, __state binary")
    return in_order(bundles, *keys).mapInArrow(merged(True), f"{kinds}, {name} {returns}")
