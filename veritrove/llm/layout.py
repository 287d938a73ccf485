"""Records that differ only in layout, collapsed into one each (problem 2).

Canonical records are range-partitioned by (key, id), sorted externally within each partition and
scanned once; adjacent full keys are compared.  As the id is part of the range key, a key that holds
a large share of all rows spreads over as many partitions as it needs.  A run that crosses a
partition edge is put together afterwards from one summary row per partition.

Defined results: a record whose doi or title is null, empty or holds no letter and no digit is no
case.  Ties are broken by the smallest id.  A payload that is null, holds no doi or no title, or
cannot be read gives no key.  Of a field given twice in one payload the first non-empty one counts.
Empty tables give no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.sources.scratch import Scratch

_OUT = "tag int, first_id bigint, other bigint, pid int, leading boolean, trailing boolean, edge_first string, edge_last string, last_first bigint, single boolean"
_SCHEMA = pa.schema([("tag", pa.int32()), ("first_id", pa.int64()), ("other", pa.int64()), ("pid", pa.int32()), ("leading", pa.bool_()), ("trailing", pa.bool_()), ("edge_first", pa.string()), ("edge_last", pa.string()), ("last_first", pa.int64()), ("single", pa.bool_())])


def bare(text: Column) -> Column:
    """Letters, marks and digits of ``text`` without regard to letter case."""
    return F.regexp_replace(F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}\p{M}]|[\x{FE00}-\x{FE0F}\x{34F}]", "")


def layout_key(doi: Column, title: Column) -> Column:
    """The canonical record, or null where doi or title is missing."""
    d, t = F.regexp_replace(bare(doi), "^(doi)+", ""), bare(title)
    return F.when((d != "") & (t != ""), F.concat(d, F.lit("\x1f"), t))


def payload_field(payload: Column, name: str) -> Column:
    """A field of a record sent as text: a JSON object, or one ``name: value`` or ``name=value`` a line."""
    as_json = F.from_json(payload, "map<string,string>")
    keys = F.filter(F.map_keys(as_json), lambda k: (F.lower(F.trim(k)) == name) & (F.trim(as_json[k]) != ""))
    line = F.regexp_extract(payload, rf"(?im)^[ \t]*{name}[ \t]*[:=][ \t]*(\S.*)$", 1)
    return F.when(payload.rlike(r"^\s*\{"), as_json[F.try_element_at(keys, F.lit(1))]).otherwise(line)


def _scan(runs: bool):
    """Scan of one sorted partition: rows of copies or of runs, and one summary row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        edge_first = last_key = None
        tag0 = last_first = count = 0
        n_runs = 0

        def emit(tags, first, other, leading, trailing):
            n = len(first)
            none = pa.nulls(n, pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(tags, pa.int32()), pa.array(first, pa.int64()), pa.array(other, pa.int64()), pa.array(np.full(n, pid), pa.int32()), pa.array(leading, pa.bool_()), pa.array(trailing, pa.bool_()), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())],
                schema=_SCHEMA,
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            tags = batch.column(2).to_numpy(zero_copy_only=False)
            start = np.empty(n, bool)
            start[0] = last_key is None or keys[0].as_py() != last_key
            start[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if edge_first is None:
                edge_first = keys[0].as_py()
            at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            first = np.where(at >= 0, ids[np.maximum(at, 0)], last_first)
            number = n_runs + np.cumsum(start)  # of the run within the partition, from 1
            if runs:
                edges = np.flatnonzero(start)
                # the run that came in, if it ends here, and every run that both begins and ends here
                bounds = np.append(edges, n)
                if len(edges):
                    size = np.diff(bounds)
                    done_first, done_size, done_tag, done_no = ids[edges][:-1], size[:-1], tags[edges][:-1], number[edges][:-1]
                    if n_runs:
                        head = count + (edges[0])
                        done_first, done_size = np.append(last_first, done_first), np.append(head, done_size)
                        done_tag, done_no = np.append(tag0, done_tag), np.append(n_runs, done_no)
                    if len(done_first):
                        yield emit(done_tag, done_first, done_size, done_no == 1, np.zeros(len(done_first), bool))
                    count = int(size[-1])
                else:
                    count += n
            else:
                copy = ~start
                lead = number == 1
                take = copy | (lead & start)  # the first row of the partition may continue an earlier run
                if take.any():
                    yield emit(tags[take], first[take], ids[take], lead[take], np.zeros(int(take.sum()), bool))
            n_runs += int(start.sum())
            last_key, last_first, tag0 = keys[n - 1].as_py(), int(first[-1]), int(tags[-1])
        if last_key is not None:
            if runs:
                yield emit([tag0], [last_first], [count], [n_runs == 1], [True])
            yield pa.RecordBatch.from_pylist([{"tag": tag0, "pid": pid, "edge_first": edge_first, "edge_last": last_key, "last_first": last_first, "single": n_runs == 1}], schema=_SCHEMA)

    return go


def _stitched(records: DataFrame, runs: bool, label: str) -> DataFrame:
    """The scan's rows with the runs that cross partition edges put together.

    ``records`` has ``key`` (STRING), ``id`` (BIGINT) and ``tag`` (INT, part of the key).
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = records.where("key is not null").select(F.concat(F.col("tag").cast("string"), F.lit("\x1e"), "key").alias("key"), F.col("id").cast("bigint").alias("id"), F.col("tag").cast("int").alias("tag"))
    # The keys are written first: a range partition reads its input twice, once for the bounds.
    scratch = Scratch(spark, label)
    keyed, _ = scratch.keep(keyed)
    ordered = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    scanned, _ = scratch.keep(ordered.mapInArrow(_scan(runs), _OUT))
    # One row for each partition, so as many as there are shuffle partitions.
    edges = sorted(scanned.where("edge_first is not null").select("pid", "edge_first", "edge_last", "last_first", "single").collect(), key=lambda e: e.pid)
    carried, last_key, last_first = [], None, None
    for e in edges:
        goes_on = e.edge_first == last_key
        if goes_on:
            carried.append((e.pid, last_first))
        last_first = last_first if goes_on and e.single else e.last_first
        last_key = e.edge_last
    carry = spark.createDataFrame(carried, "pid int, carried bigint")
    rows = scanned.where("edge_first is null").join(F.broadcast(carry), "pid", "left")
    return rows.withColumn("first_id", F.when(F.col("leading"), F.coalesce("carried", "first_id")).otherwise(F.col("first_id")))


def copies(records: DataFrame) -> DataFrame:
    """``tag``, ``first_id``, ``copy_id``: every record that is a copy of one with a smaller id."""
    return _stitched(records, False, "layout").where("other <> first_id").select("tag", "first_id", F.col("other").alias("copy_id"))


def collapse(records: DataFrame) -> DataFrame:
    """``tag``, ``first_id``, ``n_copies``: one representative of every record, with its exact count.

    Only runs at partition edges are aggregated again, at most two for each partition.
    """
    rows = _stitched(records, True, "collapse").select("tag", "first_id", F.col("other").alias("n"), (F.col("leading") | F.col("trailing")).alias("edge"))
    at_edge = rows.where("edge").groupBy("tag", "first_id").agg(F.sum("n").alias("n_copies"))
    return rows.where("not edge").select("tag", "first_id", F.col("n").alias("n_copies")).unionByName(at_edge)
