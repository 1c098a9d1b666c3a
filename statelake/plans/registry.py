"""One named query per operator, over whole tables; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from statelake import fixtures as X, schemas
from statelake.functions import (
    absolute_path, date_text, day_number, extension, iso_seconds, name_index, norm_hex, render_binary, short_hex, to_hex,
)
from statelake.operators.asof import asof_join
from statelake.operators.intervals import overlap_join
from statelake.operators import flatten as fl, increments as inc, lww as lw, sets
from statelake.plans import catalog as cat, reports as rep, tables as tab
from statelake.plans.sql import sql
from statelake.session import scratch_path
from statelake.sinks import tables as out
from statelake.sinks.diff_store import DiffStore
from statelake.sinks.history import HistoryStore
from statelake.sinks.layout import write_along_curve
from statelake.sinks.snapshots import SnapshotStore
from statelake.sources import arrow_ipc, blob, blob_items as bi, decoded_json as dj, formats, generator, words
from statelake.sources.files import replacing
from statelake.streaming import jobs, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BLOBS_PER_TASK = 128  # blobs of 128 KiB: 16 MiB, or half a million words


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _last_blob(state: DataFrame) -> int:
    return state.agg(F.max("blob_index")).first()[0]


def _windowed(spark: SparkSession, root: str, window: int) -> tuple[DataFrame, DataFrame]:
    events = X.state_events(spark, root)
    base, recent = lw.split_window(events, _last_blob(events), window)
    return lw.lww(base), recent


# -- last write wins ------------------------------------------------------------------------------------------------


@query
def lww_events(spark, root):
    return lw.lww(X.state_events(spark, root))


@query
def lww_orders(spark, root):
    return lw.lww(X.state_orders(spark, root))


@query
def lww_max_by_events(spark, root):
    return lw.lww_max_by(X.state_events(spark, root))


@query
def lww_address_and_key(spark, root):
    return lw.lww(X.state_events(spark, root), keys=("address", "key", "type"))


@query
def lww_filtered(spark, root):
    return lw.lww_between(
        X.state_orders(spark, root), min_timestamp=789264000, max_timestamp=793584000, min_blob_index=5, max_blob_index=50
    )


@query
def asof_blob_index(spark, root):
    return lw.as_of(X.state_events(spark, root), blob_index=10)


@query
def asof_timestamp(spark, root):
    return lw.as_of(X.state_orders(spark, root), timestamp=791510400)


@query
def split_base_count_w4(spark, root):
    base, recent = _windowed(spark, root, 4)
    counted = base.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("base").alias("part"), "rows")
    return counted.unionAll(recent.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("recent").alias("part"), "rows"))


@query
def delta_winners_w4(spark, root):
    return lw.delta_winners(_windowed(spark, root, 4)[1])


def _live_count(window: int) -> Query:
    return lambda spark, root: lw.live_count_as_written(*_windowed(spark, root, window))


def _live_view(window: int) -> Query:
    return lambda spark, root: lw.live_view(*_windowed(spark, root, window))


for _w in (1, 4, 16):
    QUERIES[f"live_count_as_written_w{_w}"] = _live_count(_w)
    QUERIES[f"live_view_w{_w}"] = _live_view(_w)


@query
def global_last(spark, root):
    return lw.global_last(X.state_events(spark, root)).select("value", "timestamp")


@query
def lww_key_count(spark, root):
    return lw.key_count(X.state_orders(spark, root))


@query
def last_ts_per_key(spark, root):
    return lw.last_timestamp(X.state_orders(spark, root))


@query
def snapshot_duplicates(spark, root):
    """Keys above one row in the raw table (all that were updated) and in its compaction (none)."""
    orders = X.state_orders(spark, root)
    raw = lw.duplicate_keys(orders).withColumn("part", F.lit("raw"))
    return raw.unionByName(lw.duplicate_keys(lw.lww(orders)).withColumn("part", F.lit("compacted")))


def _order_store(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, SnapshotStore]:
    orders = X.state_orders(spark, root)
    return orders, SnapshotStore(spark, scratch_path(spark, name), schema=orders.schema, buckets=8)


@query
def upsert_orders(spark, root):
    """Base, an upsert of newer blobs, then one that offers everything again, old rows included."""
    orders, store = _order_store(spark, root, "upsert")
    store.replace(orders.filter("blob_index <= 40"))
    store.upsert(orders.filter("blob_index > 40"))
    store.upsert(orders)
    return store.read()


@query
def delta_versions_orders(spark, root):
    """Deltas on a base, folded by a compaction, one more delta: the newest version is the compaction of all."""
    orders, store = _order_store(spark, root, "deltas")
    store.replace(orders.filter("blob_index <= 30"))
    store.append_delta(orders.filter("blob_index between 31 and 60"))
    store.compact()
    store.append_delta(orders.filter("blob_index > 60"))
    return store.read()


@query
def snapshot_version_read(spark, root):
    """An old version stays what it was: the first version after two more were published."""
    orders, store = _order_store(spark, root, "versions")
    first = store.replace(orders.filter("blob_index <= 30"))
    store.upsert(orders.filter("blob_index between 31 and 60"))
    store.append_delta(orders.filter("blob_index > 60"))
    return store.read(first)


@query
def snapshot_key_sketches(spark, root):
    """Keys of every version by sketches, without its rows, beside what a scan counts; and the median of the times."""
    orders = X.state_orders(spark, root)
    store = SnapshotStore(
        spark, scratch_path(spark, "sketches"), schema=orders.schema, buckets=8, sketches=["timestamp"],
    )
    versions = [store.replace(orders.filter("blob_index <= 30")), store.append_delta(orders.filter("blob_index > 30")), store.compact()]
    parts = []
    for version in versions:
        middle = store.quantiles("timestamp", [0.5], version).select(F.col("value").alias("middle"))
        estimate = store.key_estimate(version).select(F.col("keys").alias("estimate"), "exact")
        counted = store.read(version).agg(F.count(F.lit(1)).alias("keys"))
        parts.append(counted.crossJoin(estimate).crossJoin(middle).select(  # one row each
            F.lit(version).alias("version"), "keys", "exact", (F.abs(F.col("estimate") / F.col("keys") - 1) < 0.08).alias("near"),
            F.col("middle").between(788918400, 788918400 + 86400 * 90).alias("middle_in_range"),
        ))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query
def snapshot_live_count(spark, root):
    """Keys of a base and of later rows together, opening only buckets that may hold one of the later keys."""
    orders = X.state_orders(spark, root)
    store = SnapshotStore(spark, scratch_path(spark, "members"), schema=orders.schema, buckets=8, sketches=[])
    store.replace(orders.filter("blob_index <= 30"))
    return store.live_count(orders.filter("blob_index > 30"))


@query
def snapshot_changes(spark, root):
    """What an upsert and a delta change: rows that are new and rows that win."""
    orders, store = _order_store(spark, root, "changes")
    first = store.replace(orders.filter("blob_index <= 40 and position % 5 <> 0"))
    store.upsert(orders.filter("blob_index between 41 and 60"))
    last = store.append_delta(orders.filter("position % 5 = 0"))
    changes = store.changes(first, last)
    return changes.select("change", "after.key", F.col("before.value").alias("old_value"), F.col("after.value").alias("new_value"))


def _event_history(spark: SparkSession, root: str) -> HistoryStore:
    """Events by blob in three batches; rows of the last come late and split intervals."""
    events = X.state_events(spark, root)
    store = HistoryStore(spark, scratch_path(spark, "history"), events.schema, order=("blob_index", "position"), buckets=8)
    store.merge(events.filter("blob_index <= 10 and position % 10 <> 0"))
    store.merge(events.filter("blob_index between 11 and 20"))
    store.merge(events.filter("blob_index > 20 or position % 10 = 0"))
    return store


@query
def history_as_of(spark, root):
    """The state as it was at a blob, as a filter of intervals."""
    return _event_history(spark, root).as_of(12)


@query
def history_intervals(spark, root):
    return _event_history(spark, root).read().select("key", "position", "blob_index", "valid_to")


# -- joins by time --------------------------------------------------------------------------------------------------


def _user_events(spark: SparkSession, root: str) -> DataFrame:
    """Events by hour; a third of all users share one key, some have none."""
    return X.table(spark, root, "events").selectExpr(
        "event_id", "event_type", "value", "case when user_id % 50 = 7 then null when user_id % 3 = 0 then 0 else user_id end as k",
        "cast(datediff(cast(ts as date), date'2024-01-01') as bigint) * 24 + hour(ts) as t",
    )


@query
def asof_join_events(spark, root):
    """What a user had looked at last when they bought something."""
    events = _user_events(spark, root)
    seen = events.filter("event_type in ('view', 'click')").selectExpr("k", "t as seen_t", "event_id as seen_id", "value as seen_value")
    bought = events.filter("event_type = 'purchase'").select("event_id", "k", "t")
    return asof_join(bought, seen, ["k"], "t", "seen_t", ["seen_id"])


@query
def asof_join_next_error(spark, root):
    """The first error of a user later than a sign-up, within two days."""
    events = _user_events(spark, root)
    errors = events.filter("event_type = 'error'").selectExpr("k", "t as error_t", "event_id as error_id")
    joined = events.filter("event_type = 'signup'").select("event_id", "k", "t")
    return asof_join(joined, errors, ["k"], "t", "error_t", ["error_id"], "forward", strict=True, tolerance=48)


@query
def overlapping_orders(spark, root):
    """Pairs of orders of one customer that were open at the same time."""
    spans = X.table(spark, root, "orders").selectExpr(
        "case when o_custkey % 40 = 3 then null else o_custkey end as k", "o_orderkey as a",
        "cast(datediff(cast(o_orderdate as date), date'1990-01-01') as bigint) as a_start",
        "cast(datediff(cast(o_orderdate as date), date'1990-01-01') + pow(o_orderkey % 7, 3) - 1 as bigint) as a_end",
    )
    others = spans.selectExpr("k", "a as b", "a_start as b_start", "a_end as b_end")
    return overlap_join(spans, others, ("a_start", "a_end"), ("b_start", "b_end"), ["k"]).filter("a < b")


@query
def events_in_windows(spark, root):
    """Events inside windows of very different lengths, up to a month."""
    windows = X.table(spark, root, "supplier").selectExpr(
        "s_suppkey as window", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(s_suppkey * 7 % 720 as int)) as lo",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(s_suppkey * 7 % 720 as int), "
        "cast(if(s_suppkey % 500 = 0, 43200, pow(s_suppkey % 5, 4)) as int)) as hi",
    )
    events = X.table(spark, root, "events").select("event_id", "ts")
    return overlap_join(events, windows, ("ts", "ts"), ("lo", "hi")).select("event_id", "window")


# -- blobs ----------------------------------------------------------------------------------------------------------


def _event_blobs(spark: SparkSession, root: str) -> str:
    where = scratch_path(spark, "blobs")
    blob.write_blobs(X.binary_state(X.state_events(spark, root)), where)
    return where


def _cut_short(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            with replacing(path) as sink:
                sink.write(content[:-30])
        yield batch.select(["path"])


@query
def blob_decode_roundtrip(spark, root):
    return render_binary(blob.read_blobs(spark, _event_blobs(spark, root), mode="PERMISSIVE"))


@query
def blob_members_read(spark, root):
    """Blob files of several gzip members, read member by member."""
    where = scratch_path(spark, "members")
    blob.write_blobs(X.binary_state(X.state_events(spark, root)), where, rows_per_member=200)
    return render_binary(blob.read_members(spark, where))


@query
def blob_files_by_name(spark, root):
    decoded = blob.read_blobs(spark, _event_blobs(spark, root), min_index=3, max_index=20)
    return decoded.groupBy("blob_index").agg(F.count(F.lit(1)).alias("rows"), F.max("position").alias("last"))


@query
def blob_file_report(spark, root):
    report = blob.blob_report(spark, _event_blobs(spark, root))
    return report.groupBy(name_index(F.col("path")).alias("blob_index")).agg(
        F.sum("rows").alias("rows"), F.bool_and("ok").alias("ok")
    )


@query
def bad_blobs_left_out(spark, root):
    """Files cut short lie beside the good ones: their rows are left out whole, and the report names them."""
    where = _event_blobs(spark, root)
    blob.list_files(spark, where, blob.GLOB).select(
        F.concat(F.lit(where + "/cut_"), name_index(F.col("path")), F.lit(".blob.gz")).alias("path"), "content"
    ).filter(name_index(F.col("path")) % 3 == 0).mapInArrow(_cut_short, "path string").write.format("noop").mode("overwrite").save()
    good = blob.read_blobs(spark, where, mode="PERMISSIVE").groupBy("blob_index").agg(
        F.count(F.lit(1)).alias("rows"), F.max("position").alias("last"), F.lit(True).alias("ok")
    )
    bad = blob.blob_report(spark, where).filter("not ok").select(
        name_index(F.col("path")).alias("blob_index"), F.lit(None).cast("long").alias("rows"),
        F.lit(None).cast("long").alias("last"), "ok",
    )
    return good.unionAll(bad)


@query
def blob_words(spark, root):
    """A blob per supplier, made of 4,096 hashes; words of both byte orders.

    The greatest word is found by sorting the words of a task, so a task gets few blobs; bytes sort as their hex does.
    """
    blobs = X.dealt_out(X.table(spark, root, "supplier").select("s_suppkey"), BLOBS_PER_TASK).selectExpr(
        "concat('s', s_suppkey) as path",
        "unhex(array_join(transform(sequence(0, 4095), i -> sha2(concat(s_suppkey, '-', i), 256)), '')) as content",
    )
    big = words.split_words(blobs).groupBy("position").agg(to_hex(F.max("value")).alias("greatest"))
    little = words.split_words(blobs, "LE").groupBy("position").agg(to_hex(F.max("value")).alias("greatest_le"))
    return big.join(little, "position")


@query
def word_state_last(spark, root):
    """The toy state of the words of all suppliers' blobs, and its one last row."""
    blobs = X.table(spark, root, "supplier").selectExpr(
        "cast(s_suppkey as string) as path",
        "unhex(array_join(transform(sequence(0, 4095), i -> sha2(concat(s_suppkey, '-', i), 256)), '')) as content",
    )
    state = words.word_state(words.split_words(blobs), 1700000000, F.col("path").cast("long"))
    last = lw.global_last(state, ties=("value",))
    return last.select(to_hex(F.col("value")).alias("value"), "timestamp", "blob_index", "position")


@query
def arrow_scan(spark, root):
    state = X.binary_state(X.state_orders(spark, root))
    where = scratch_path(spark, "arrow")
    arrow_ipc.write_arrow(state, where)
    return render_binary(arrow_ipc.read_arrow(spark, where))


@query
def blob_source_sql(spark, root):
    """Blob files named in SQL, with bounds that reach the files."""
    formats.register(spark)
    spark.sql(f"create or replace temporary view blob_source using zkbl options (path '{_event_blobs(spark, root)}')")
    return spark.sql(
        "select blob_index, count(*) as rows, max(position) as last, concat('0x', lower(hex(max(key)))) as key from blob_source "
        "where blob_index between 3 and 20 and timestamp >= 1704067200 + 345600 and type = 'state_diff' group by blob_index"
    )


@query
def arrow_source_sql(spark, root):
    formats.register(spark)
    where = scratch_path(spark, "arrow")
    arrow_ipc.write_arrow(X.binary_state(X.state_orders(spark, root)), where)
    spark.sql(f"create or replace temporary view arrow_source using arrowfile options (path '{where}')")
    return render_binary(spark.sql("select * from arrow_source where blob_index > 40 and position % 3 = 0"))


@query
def partition_columns(spark, root):
    return out.with_partition_columns(X.state_events(spark, root), 167001).groupBy("chain_id", "date", "topic").agg(
        F.count(F.lit(1)).alias("rows"), F.min(date_text(F.col("timestamp"))).alias("day")
    )


@query
def partitioned_write_read(spark, root):
    where = scratch_path(spark, "lake")
    out.write_state(X.binary_state(X.state_orders(spark, root)), where, 5, max_records_per_file=5000)
    return render_binary(spark.read.schema(schemas.STATE_PARTITIONED).parquet(where))


@query
def partitioned_pruned_read(spark, root):
    """Whole folders are skipped by day and topic."""
    where = scratch_path(spark, "lake")
    out.write_state(X.binary_state(X.state_orders(spark, root)), where, 5, max_records_per_file=5000)
    lake = spark.read.schema(schemas.STATE_PARTITIONED).parquet(where)
    return render_binary(lake.filter("date >= 9140 and topic = 'state_diff'"))


CURVE_BOUNDS = ("blob_index between 10 and 12", "key < '0x08'", "position between 100 and 160")


@query
def curve_layout_read(spark, root):
    """Orders laid out along a curve over blob, customer key and position, read with a bound on each."""
    where = scratch_path(spark, "curve")
    write_along_curve(X.state_orders(spark, root), where, ["blob_index", "key", "position"])
    lake = spark.read.parquet(where)
    parts = [lake.filter(b).groupBy(F.lit(b).alias("bound")).agg(F.count(F.lit(1)).alias("rows"), F.max("key").alias("key")) for b in CURVE_BOUNDS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query
def state_union(spark, root):
    """Parquet files, Arrow files and a DataFrame as one state table."""
    orders = X.binary_state(X.state_orders(spark, root))
    arrow, parquet = scratch_path(spark, "union-arrow"), scratch_path(spark, "union-parquet")
    arrow_ipc.write_arrow(orders.filter("blob_index <= 20"), arrow)
    out.write_table(orders.filter("blob_index between 21 and 50"), parquet)
    both = tab.state_of(spark, [parquet], [arrow], [orders.filter("blob_index > 50")])
    return both.groupBy("blob_index").agg(F.count(F.lit(1)).alias("rows"), F.max(to_hex(F.col("key"))).alias("key"))


# -- functions ------------------------------------------------------------------------------------------------------


@query
def norm_hex_parts(spark, root):
    raw = X.table(spark, root, "part").selectExpr(
        "p_partkey",
        "case p_partkey % 5 when 0 then concat('0x000', hex(p_partkey)) when 1 then concat('0X0', hex(p_partkey)) "
        "when 2 then concat('0x', repeat('0', p_size % 7)) when 3 then cast(p_partkey as string) end as raw",
    )
    return raw.select("p_partkey", norm_hex(F.col("raw")).alias("norm"))


@query
def to_hex_customers(spark, root):
    binary = X.table(spark, root, "customer").selectExpr("c_custkey", "unhex(sha1(concat('A', c_custkey))) as address")
    return binary.select("c_custkey", to_hex(F.col("address")).alias("address"))


@query
def short_hex_parts(spark, root):
    binary = X.table(spark, root, "part").selectExpr(
        "p_partkey", "if(p_partkey % 4 = 0, encode(p_brand, 'UTF-8'), unhex(sha2(p_name, 256))) as b"
    )
    return binary.select("p_partkey", short_hex(F.col("b")).alias("shown"))


@query
def epoch_functions(spark, root):
    seconds = X.table(spark, root, "orders").selectExpr(
        "o_orderkey", "cast(datediff(cast(o_orderdate as date), date'1970-01-01') as bigint) * 86400 + o_orderkey % 86400 as s",
        "concat(cast(cast(o_orderdate as date) as string), 'T00:00:09.5Z') as iso",
    )
    return seconds.select(
        "o_orderkey", day_number(F.col("s")).alias("day_no"), date_text(F.col("s")).alias("day"),
        iso_seconds(F.col("iso")).alias("iso_s"),
    )


@query
def path_functions(spark, root):
    names = X.table(spark, root, "pages").selectExpr(
        "page_id", "case page_id % 3 when 0 then url when 1 then concat('././x/', page_id, '.ARROW') else concat('/y/p_', page_id) end as p"
    )
    return names.select(
        "page_id", absolute_path(F.col("p"), "https://lake.example/data/").alias("full"), extension(F.col("p")).alias("ext")
    )


# -- decoded JSON ---------------------------------------------------------------------------------------------------


def _diff_texts(spark: SparkSession, root: str) -> DataFrame:
    """A document per line item: two storage entries, none for line 7, with raw hex in mixed case."""
    return X.table(spark, root, "lineitem").selectExpr(
        "'lineitem' as src",
        "to_json(named_struct('storage_diffs', array(named_struct('address', concat('0x00', hex(l_suppkey)), "
        "'storage_entries', if(l_linenumber = 7, null, array("
        "named_struct('key', concat('0x0', hex(l_partkey)), 'value', concat('0x', hex(cast(l_quantity as bigint)))), "
        "named_struct('key', concat('0x', hex(l_orderkey)), 'value', '0x0'))))))) as text",
    )


@query
def flatten_storage_diffs(spark, root):
    documents = dj.documents_in(_diff_texts(spark, root), schemas.DIFF_DOCUMENT)
    flat = fl.storage_diffs(documents)
    return flat.groupBy("address", "key", "value", "src").agg(F.count(F.lit(1)).alias("n"))


@query
def flatten_nonces(spark, root):
    texts = X.table(spark, root, "conversations").selectExpr(
        "'conversations' as src",
        "concat('[1, {\"nonces\": [{\"contract_address\": \"0x0', hex(conv_id), '\", \"nonce\": \"0x', hex(turn * 5), '\"}]}]') as text",
    )
    return fl.nonces(dj.documents_in(texts, schemas.DIFF_DOCUMENT))


@query
def flatten_declared(spark, root):
    texts = X.table(spark, root, "part").selectExpr(
        "'part' as src",
        "concat('{\"declared_classes\": [{\"class_hash\": \"0x', sha2(p_name, 256), '\",\\n\"compiled_class_hash\": ', p_partkey, '}]}') as text",
    )
    return fl.declared_classes(dj.documents_in(texts, schemas.DIFF_DOCUMENT))


@query
def flatten_deployed(spark, root):
    texts = X.table(spark, root, "customer").selectExpr(
        "'customer' as src",
        "concat('{\"deployed_or_replaced\": [{\"address\": \"0x', hex(c_custkey), '\", \"class_hash\": \"0xA\"}]}\\n\\n', "
        "'{\"deployed_or_replaced\": [{\"address\": \"0x1\", \"class_hash\": \"', c_mktsegment, '\"}], \"nonces\": null}') as text",
    )
    return fl.deployed_or_replaced(dj.documents_in(texts, schemas.DIFF_DOCUMENT))


@query
def flatten_contracts(spark, root):
    texts = X.table(spark, root, "orders").selectExpr(
        "'orders' as src",
        "concat('{\"contracts\": [{\"address\": ', o_custkey, if(o_orderkey % 2 = 0, ', \"nonce\": 7', ''), "
        "if(o_orderkey % 3 = 0, concat(', \"class_hash\": \"00', o_orderkey, '\"'), ''), "
        "', \"storage\": [[', o_orderkey, ', 9], {\"key\": ', o_orderkey * 2, ', \"value\": \"0', o_custkey, '\"}]}]}') as text",
    )
    return fl.flatten_contracts(dj.documents_in(texts, schemas.CONTRACTS_DOCUMENT))


@query
def index_resolve(spark, root):
    """Half of the customers are in the index map; addresses below 2^127 are literals even where the map has them."""
    rows = X.table(spark, root, "orders").selectExpr(
        "if(o_orderkey % 3 = 0, cast(o_custkey as string), concat('9', lpad(o_custkey, 39, '0'))) as addr",
        "cast(o_orderkey as string) as key", "cast(o_custkey as string) as value",
    )
    index_map = X.table(spark, root, "customer").filter("c_custkey % 2 = 0").selectExpr(
        "explode(array(concat('9', lpad(c_custkey, 39, '0')), cast(c_custkey as string))) as idx",
        "cast(c_custkey * 1000 as string) as val",
    )
    return fl.resolve_indexes(rows, index_map)


@query
def json_lines_write_read(spark, root):
    """Flat rows as JSON lines and back; absent fields stay absent."""
    where = scratch_path(spark, "json")
    flat = flatten_contracts(spark, root)
    out.write_json_lines(flat, where)
    back = spark.read.schema(flat.schema).json(where)
    return back.groupBy("class_hash", "nonce").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key"))


@query
def diff_store_ingest(spark, root):
    """Files of JSON lines from two tables, ingested in two runs; the second run sees only the new files."""
    source, store = scratch_path(spark, "decoded"), DiffStore(spark, scratch_path(spark, "store"))
    deployed = X.table(spark, root, "customer").selectExpr(
        "concat('{\"deployed_or_replaced\": [{\"address\": \"0x', hex(c_custkey), '\", \"class_hash\": \"', c_mktsegment, '\"}]}') as value"
    )
    nonces = X.table(spark, root, "conversations").selectExpr(
        "concat('{\"nonces\": [{\"contract_address\": \"0x', hex(conv_id), '\", \"nonce\": \"0x0', hex(turn), '\"}]}') as value"
    )
    deployed.write.mode("append").text(source)
    store.ingest(source)
    nonces.write.mode("append").text(source)
    store.ingest(source)
    store.ingest(source)
    counted = store.read("deployed_or_replaced", replace_by_src=True).select("class_hash", F.lit(1).alias("n")).unionAll(
        store.read("nonces").select("nonce", F.lit(1).alias("n"))
    )
    return counted.groupBy(F.col("class_hash").alias("item")).agg(F.sum("n").alias("n"))


@query
def complete_sets(spark, root):
    return sets.complete_sets(X.blob_items(spark, root))


@query
def manifest_entries(spark, root):
    return sets.manifest_entries(sets.complete_sets(X.blob_items(spark, root)))


@query
def incremental_new_files(spark, root):
    files = X.table(spark, root, "documents").selectExpr("concat('d', doc_id, '.json') as name", "sha1(text) as sha1", "doc_id")
    ledger = files.filter("doc_id % 3 <> 0").selectExpr("name", "if(doc_id % 3 = 1, sha1(sha1), sha1) as sha1")
    return inc.new_files(files.select("name", "sha1"), ledger)


@query
def file_content_digests(spark, root):
    """Digests of real files, one per nation; those above the bound are hashed in pieces."""
    where = scratch_path(spark, "named")
    rows = X.table(spark, root, "customer").select("c_nationkey", "c_custkey", "c_name")
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "c_name").write.partitionBy(
        "c_nationkey"
    ).text(where)
    digests = inc.file_digests(spark, where, "*.txt", whole_bytes=1500, recursive=True)
    return digests.select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("long").alias("nation"), "sha1")


@query
def generated_hot_keys(spark, root):
    """Synthetic state drawn for the ids of the events: rows and blobs of every key, a few of which are hot."""
    ids = X.table(spark, root, "events").select(F.col("event_id").alias("id"))
    state = generator.state_of_ids(ids, 1000, keyspace=400, seed=3, number=generator.by_md5)
    return render_binary(state).groupBy("key", "address").agg(
        F.count(F.lit(1)).alias("rows"), F.max("blob_index").alias("last_blob"), F.max_by("value", F.struct("blob_index", "position")).alias("value")
    )


@query
def files_without_output(spark, root):
    pages = X.table(spark, root, "pages")
    files = pages.selectExpr("concat('raw/blob_', page_id, '.blob.gz') as path")
    done = pages.filter("page_id % 2 = 0").selectExpr("concat('hot/blob_', page_id, '.arrow') as path")
    return inc.without_output(files, done, suffix=".blob.gz")


# -- blob listings --------------------------------------------------------------------------------------------------


def _item_pages(spark: SparkSession, root: str) -> DataFrame:
    """A page per turn, with the alternative names of every field."""
    fields = (
        "case conv_id % 3 when 0 then concat('\"eth_block_number\": ', conv_id) "
        "when 1 then concat('\"eth_block_number\": 0, \"blockNumber\": ', conv_id) else '\"x\": 1' end",
        "if(turn % 2 = 0, concat('\"tx_hash\": \"\", \"txHash\": \"t', conv_id, '\"'), concat('\"tx_hash\": \"t', conv_id, '\"'))",
        "if(turn = 0, '\"y\": null', concat('\"index\": ', turn))",
        "case turn % 4 when 0 then concat('\"timestamp\": ', 1700000000 + conv_id, '.5') when 1 then "
        "'\"timestamp\": \"text\", \"blockTimestamp\": \"2024-01-02T03:04:05.000Z\"' when 2 then '\"time\": \"2024-01-02T03:04:05+01:00\"' "
        "else '\"time\": \"soon\"' end",
        "case turn % 5 when 0 then concat('\"dataStorageReferences\": [{\"url\": \"\"}, null, {\"url\": \"u', conv_id, '\"}]') "
        "when 1 then concat('\"dataStorageReferences\": [], \"data_storage_references\": [{\"url\": \"v', conv_id, '\"}]') "
        "when 2 then concat('\"storage\": {\"url\": \"w', conv_id, '\"}') when 3 then '\"storageUrl\": \"z\"' else '\"storageUrl\": \"\"' end",
    )
    item = "concat('{', concat_ws(', ', " + ", ".join(fields) + "), '}')"
    return X.table(spark, root, "conversations").selectExpr(f"{item} as item", "turn").selectExpr(
        "case turn % 3 when 0 then concat('{\"items\": [', item, ']}') when 1 then concat('{\"blobs\": [', item, ']}') "
        "else concat('[', item, ']') end as value"
    )


@query
def blob_item_rows(spark, root):
    return bi.normalise_items(bi.items_in(_item_pages(spark, root)))


@query
def blob_page(spark, root):
    items = bi.normalise_items(bi.items_in(_item_pages(spark, root)))
    return bi.page_of(items, page=2, page_size=15, start_block=5, end_block=60, max_items=12)


# -- reports --------------------------------------------------------------------------------------------------------


@query
def wallet_share(spark, root):
    return rep.wallet_share(X.deployed(spark, root), X.wallet_map(spark))


@query
def wallet_map_overlay(spark, root):
    """Every customer names a wallet for its segment and nation; blank and unknown names do not count."""
    external = X.table(spark, root, "customer").selectExpr(
        "concat(if(c_custkey % 11 = 0, '', '0x'), if(c_custkey % 2 = 0, upper(sha2(concat(c_mktsegment, c_nationkey % 3), 256)), "
        "sha2(concat(c_mktsegment, c_nationkey % 3), 256))) as class_hash",
        "case c_custkey % 4 when 0 then ' Unknown ' when 1 then ' \t' else concat(' W', c_custkey, '\n') end as wallet",
        "c_custkey as ord",
    )
    segments = external.filter("ord % 11 <> 0").selectExpr("lower(class_hash) as class_hash", "'seed' as wallet").distinct()
    return rep.overlay_wallets(segments.unionAll(X.wallet_map(spark)), external)


@query
def share_of_total(spark, root):
    shown = rep.share_of_shown(rep.wallet_share(X.deployed(spark, root), X.wallet_map(spark)), "cnt")
    return shown.select("wallet", "cnt", F.round("pct", 6).alias("pct"))


@query
def top_writers(spark, root):
    return rep.top_writers(X.storage_diffs(spark, root))


@query
def class_ranking(spark, root):
    return rep.class_ranking(X.deployed(spark, root))


@query
def value_ranking(spark, root):
    return rep.top(rep.count_by(X.storage_diffs(spark, root), "value", "c"), "c", "value", 10)


@query
def latest_nonce_text(spark, root):
    return rep.latest_nonce_text(X.nonces(spark, root))


@query
def latest_nonce_numeric(spark, root):
    return rep.latest_nonce_numeric(X.nonces(spark, root))


@query
def nonces_listing(spark, root):
    return rep.listing(X.nonces(spark, root), ["contract_address", "nonce"])


# -- catalogues -----------------------------------------------------------------------------------------------------


def _two_catalogs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    pages = X.table(spark, root, "pages").selectExpr(
        "page_id",
        "element_at(array('arrow', 'parquet', 'files', 'urls'), cast(page_id % 4 + 1 as int)) as kind",
        "concat('data/', page_id div 8, '.bin') as path", "page_id as ord",
    )
    names = ["kind", "path", "ord"]
    return pages.filter("page_id % 3 <> 0").select(names), pages.filter("page_id % 2 = 0 or page_id % 3 = 0").select(names)


def _two_segments(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    segments = X.table(spark, root, "pages").selectExpr(
        "page_id", "if(page_id % 4 = 0, concat('f', page_id div 16), if(page_id % 4 = 1, '', null)) as file",
        "if(page_id % 4 = 1, concat('f', page_id div 16), null) as path",
        "if(page_id % 4 = 2, concat('u', page_id div 8), null) as url", "page_id as ord",
    )
    names = ["file", "path", "url", "ord"]
    return segments.filter("page_id % 3 = 0").select(names), segments.filter("page_id % 3 <> 0").select(names)


@query
def catalog_merge(spark, root):
    return cat.merge_catalogs(*_two_catalogs(spark, root))


@query
def catalog_delta(spark, root):
    (local, remote), (few, more) = _two_catalogs(spark, root), _two_segments(spark, root)
    return cat.delta_counts(local, cat.merge_catalogs(local, remote), few, cat.merge_segments(few, more))


@query
def catalog_segments(spark, root):
    return cat.merge_segments(*_two_segments(spark, root))


@query
def catalog_absolute(spark, root):
    catalog = X.table(spark, root, "pages").selectExpr(
        "element_at(array('arrow', 'parquet', 'files', 'urls'), cast(page_id % 4 + 1 as int)) as kind", "if(page_id % 2 = 0, url, concat(if(page_id % 3 = 0, './', '/'), page_id div 4)) as path", "page_id as ord"
    )
    return cat.make_absolute(catalog, "https://lake.example/data")


@query
def catalog_remap(spark, root):
    pages = X.table(spark, root, "pages")
    kind = "element_at(array('arrow', 'parquet', 'files', 'urls'), cast(page_id % 4 + 1 as int)) as kind"
    catalog = pages.selectExpr(kind, "concat('p', page_id div 2) as path", "page_id as ord")
    mapping = pages.filter("page_id % 3 = 0").selectExpr("concat('p', page_id) as old", "concat('objects/', page_id) as new")
    return cat.remap_paths(catalog, mapping)


@query
def segments_absolute_remap(spark, root):
    """Files of segments made absolute and then moved; entries without a file stay."""
    pages = X.table(spark, root, "pages")
    segments = cat.absolute_segments(_two_segments(spark, root)[1], "https://lake.example/data")
    mapping = pages.filter("page_id % 3 = 0").selectExpr(
        "concat('https://lake.example/data/f', page_id) as old", "concat('objects/', page_id) as new"
    )
    return cat.remap_segments(segments, mapping)


@query
def catalog_fallback(spark, root):
    catalog = _two_catalogs(spark, root)[0]
    no_tables = catalog.filter("ord < 0")
    return cat.tables_or_fallback(no_tables, catalog)


@query
def catalog_build(spark, root):
    where = scratch_path(spark, "tree")
    out.write_table(X.table(spark, root, "documents").select("doc_id", "lang"), where, ("lang",))
    built = cat.build_catalog(spark, where, include_parquet=True)
    return built.select("kind", F.regexp_extract("path", "^lang=([^/]*)/[^/]*$", 1).alias("lang")).distinct()


@query
def manifest_write_read(spark, root):
    """A merged catalogue and its segments written as entries of a manifest and read back."""
    where = scratch_path(spark, "manifest")
    catalog = cat.merge_catalogs(*_two_catalogs(spark, root))
    cat.write_entries(catalog, cat.merge_segments(*_two_segments(spark, root)), where, base="https://lake.example/data")
    paths, segments = cat.read_entries(spark, where)
    base = F.lit(cat.entries_base(spark, where))
    named = F.coalesce(*[F.concat(F.lit(c + ":"), c) for c in ("file", "path", "url")])
    return paths.select("kind", "path", "ord", base.alias("base")).unionAll(
        segments.select(F.lit("segments").alias("kind"), named.alias("path"), "ord", base.alias("base"))
    )


@query
def catalog_to_views(spark, root):
    """Tables written to files, found by a listing, written as a table catalogue, read back and registered."""
    where = scratch_path(spark, "listed")
    out.write_table(X.storage_diffs(spark, root), f"{where}/storage_diffs")
    out.write_table(X.nonces(spark, root), f"{where}/nonces")
    built = cat.build_catalog(spark, where, include_parquet=True)
    tables = built.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("kind"), F.concat(F.lit("data/"), "path").alias("path"))
    cat.write_table_catalog(tables, f"{where}/_tables.json")
    found = cat.absolute_tables(tab.read_table_catalog(spark, [where]), where)
    tab.register_tables(spark, found)
    return sql(
        spark,
        "select address as name, count(*) as n from storage_diffs group by address union all "
        "select contract_address, count(*) from nonces group by contract_address union all "
        "select class_hash, count(*) from declared_classes group by class_hash",
    )


@query
def preferred_files(spark, root):
    """Orders from Parquet although Arrow files are there as well, events from Arrow files, there being no others."""
    orders, events = (X.binary_state(s(spark, root)) for s in (X.state_orders, X.state_events))
    parquet, arrow, other = (scratch_path(spark, f"preferred-{k}") for k in ("parquet", "arrow", "other"))
    out.write_table(orders, parquet)
    arrow_ipc.write_arrow(events, arrow)
    arrow_ipc.write_arrow(orders.limit(0), other)
    chosen = tab.prefer_parquet(spark, [parquet], [other]).unionAll(tab.prefer_parquet(spark, [], [arrow]))
    return chosen.groupBy("blob_index").agg(F.count(F.lit(1)).alias("rows"), F.max(to_hex(F.col("key"))).alias("key"))


@query
def empty_table(spark, root):
    """K4: a typed table without rows, and the rows of a full one that it does not hold."""
    where = scratch_path(spark, "empty")
    state = X.binary_state(X.state_orders(spark, root))
    out.write_empty(spark, schemas.STATE, where)
    empty = spark.read.parquet(where)
    return render_binary(state.join(empty.select("key"), "key", "left_anti").select(*empty.columns))


@query
def result_envelope(spark, root):
    """K9: the rows of a report by day as they reach the driver, binary cells as hex, and their number."""
    report = X.binary_state(X.state_events(spark, root)).groupBy("blob_index").agg(F.max("key").alias("key"))
    held = out.result_of(report, 1000)  # a day per row
    schema = "blob_index long, key string, row_count long, complete boolean"
    return spark.createDataFrame([(*row, held.row_count, held.complete) for row in held.rows], schema)


@query
def registered_tables(spark, root):
    """Two tables written to files, registered through a catalogue and queried as views; two have no files."""
    where = scratch_path(spark, "views")
    out.write_table(X.storage_diffs(spark, root), f"{where}/storage_diffs")
    out.write_table(X.nonces(spark, root), f"{where}/nonces")
    names = spark.createDataFrame([("storage_diffs", "/storage_diffs", 0), ("nonces", "/nonces", 0)], schemas.CATALOG)
    tab.register_tables(spark, names, base=where)
    return sql(
        spark,
        "select 'storage_diffs' as name, count(*) as n, count(src) as with_src from storage_diffs union all "
        "select 'nonces', count(*), count(src) from nonces union all "
        "select 'declared_classes', count(*), count(src) from declared_classes union all "
        "select 'deployed_or_replaced', count(*), count(src) from deployed_or_replaced;",
    )


# -- streams --------------------------------------------------------------------------------------------------------


def _event_files(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """The event state in several files that mix all times, so most files bring late rows."""
    events, where = X.state_events(spark, root), scratch_path(spark, "arrivals")
    events.repartition(4, "tx_hash").write.parquet(where)
    return events, where


def _event_stream(spark: SparkSession, root: str) -> DataFrame:
    events, where = _event_files(spark, root)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(where)


@query
def stream_lww_events(spark, root):
    updates, checkpoint = scratch_path(spark, "updates"), scratch_path(spark, "checkpoint")
    jobs.updates_to(jobs.current_values(_event_stream(spark, root)), updates, checkpoint).awaitTermination()
    return jobs.read_updates(spark, updates)


@query
def stream_keyed_changes(spark, root):
    """A stream that starts from a snapshot and emits only what changes it."""
    events = X.state_events(spark, root)
    start = lw.as_of(events, blob_index=5)
    updates, checkpoint = scratch_path(spark, "updates"), scratch_path(spark, "checkpoint")
    jobs.updates_to(keyed.changed_values(_event_stream(spark, root), start), updates, checkpoint).awaitTermination()
    return jobs.read_updates(spark, updates)


@query
def stream_late_data(spark, root):
    """Upserts by batch into snapshots, where late rows must lose."""
    stream = _event_stream(spark, root)
    store = SnapshotStore(spark, scratch_path(spark, "late"), schema=X.state_events(spark, root).schema, buckets=4)
    jobs.upsert_into(stream, store, scratch_path(spark, "checkpoint"), "late").awaitTermination()
    return store.read()


@query
def stream_blob_source(spark, root):
    """Blob files by the format's own stream, compacted from what it wrote."""
    formats.register(spark)
    found, checkpoint = scratch_path(spark, "found"), scratch_path(spark, "checkpoint")
    stream = spark.readStream.format("zkbl").option("settleSeconds", "0").load(_event_blobs(spark, root))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(found).awaitTermination()
    return render_binary(lw.lww(spark.read.schema(schemas.STATE).parquet(found)))


@query
def stream_catch_up(spark, root):
    """Blob files decoded once by a stream into the partitioned table."""
    lake = scratch_path(spark, "lake")
    blobs = jobs.stream_blobs(spark, _event_blobs(spark, root), max_files=20)
    jobs.catch_up(blobs, lake, scratch_path(spark, "checkpoint"), 7).awaitTermination()
    decoded = spark.read.schema(schemas.STATE_PARTITIONED).parquet(lake)
    return render_binary(decoded.select(*schemas.STATE_COLUMNS, "chain_id", "date"))


# -- ad-hoc SQL -----------------------------------------------------------------------------------------------------

# the text runs unchanged in Spark; the tables are the views below
PASSTHROUGH = {
    "sql_grouping_sets":
        "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty "
        "from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_rollup":
        "select c_mktsegment, c_nationkey, count(*) as n from customer group by rollup(c_mktsegment, c_nationkey)",
    "sql_semi_join":
        "select c_custkey, c_name from customer left semi join orders on o_custkey = c_custkey and o_orderstatus = 'F'",
    "sql_full_join":
        "select c_custkey, s_suppkey from customer full outer join supplier on c_custkey = s_suppkey",
    "sql_except":
        "select l_partkey from lineitem except select p_partkey from part where p_size > 10",
    "sql_intersect":
        "select o_custkey as k from orders intersect select c_custkey from customer where c_nationkey < 12",
    "sql_lag":
        "select event_id, lag(event_id) over (partition by user_id order by event_id) as previous, "
        "count(*) over (partition by user_id order by event_id rows between 2 preceding and current row) as n from events",
    "sql_cte_subquery":
        "with spent as (select o_custkey, count(*) as n from orders group by o_custkey) "
        "select c_custkey, n from customer join spent on o_custkey = c_custkey where n > (select avg(n) from spent)",
    "sql_in_and_exists":
        "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%') "
        "and exists (select 1 from customer where c_nationkey = n_nationkey)",
    "sql_count":
        "select count(*) as rows from lineitem",
}


def _passthrough(text: str) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        for name in ("lineitem", "customer", "orders", "supplier", "part", "events", "nation", "region"):
            X.table(spark, root, name).createOrReplaceTempView(name)
        return sql(spark, text + ";")

    return run


QUERIES.update({name: _passthrough(text) for name, text in PASSTHROUGH.items()})
