"""Queries over derived logs, one for each operator, with DuckDB SQL that must give the same rows.

Each entry of QUERIES is (function of (spark, sf_dir), SQL). Kinds of the events table have no meaning of their own, so
each query says which role each kind plays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlog.functions import columns as C
from foldlog.functions.ranking import dense_positions, together
from foldlog.operators import commands, evolve, folds, snapshots
from foldlog.operators.filters import EventFilter, Filters, field_of, scan
from foldlog.sources import envelope as E

QUERIES: dict[str, tuple] = {}

LOG = """WITH e AS (SELECT event_id AS position, CAST(user_id AS VARCHAR) AS aggregate_id, event_type AS kind,
  CAST(round(value * 100) AS BIGINT) AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS at_millis FROM events)"""
RUN = "PARTITION BY aggregate_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
T = 4000
is_ = lambda kind: F.col("kind") == kind


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.event_log(spark, sf_dir).withColumnRenamed("amount_cents", "c")


ENVELOPE = "aggregate_id, kind, position, c, k"
PLAIN = ["aggregate_id", "kind", "position", "c", "k"]


# --- scans ---------------------------------------------------------------------------------------------------------


@query(f"""{LOG} SELECT 'user' AS aggregate_kind, aggregate_id, kind, position, '{{"amount_cents":' || c || ',"k":' || k || '}}' AS data, '{{"at_millis":' || at_millis || '}}' AS metadata FROM e""")
def log_envelope(spark, sf_dir):
    return E.enveloped(E.event_log(spark, sf_dir), ["amount_cents", "k"], ["at_millis"])


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE kind = 'purchase'")
def scan_kind(spark, sf_dir):
    return scan(log(spark, sf_dir), [EventFilter.for_event("purchase")]).select(*PLAIN)


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE kind IN ('purchase', 'click')")
def scan_kinds(spark, sf_dir):
    return log(spark, sf_dir).where(Filters().events(["purchase", "click"]).predicate()).select(*PLAIN)


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE kind = 'purchase' AND aggregate_id = '7'")
def scan_kind_scoped(spark, sf_dir):
    return log(spark, sf_dir).where(Filters().event_for("user", "purchase", "7").predicate()).select(*PLAIN)


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE aggregate_id = '7' AND kind IN ('signup', 'purchase', 'click')")
def scan_all_scoped(spark, sf_dir):
    return log(spark, sf_dir).where(Filters().events_for("user", ["signup", "purchase", "click"], "7").predicate()).select(*PLAIN)


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE kind = 'purchase' OR (kind = 'click' AND aggregate_id = '3')")
def scan_overlap_dedup(spark, sf_dir):
    """A global filter and scoped ones that overlap it: each event once."""
    f = Filters().event("purchase").event_for("user", "purchase", "7").event_for("user", "click", "3")
    return log(spark, sf_dir).where(f.predicate()).select(*PLAIN)


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE (kind = 'purchase' AND position > {T}) OR (kind = 'view' AND position > 100 AND aggregate_id = '5') OR kind = 'signup'")
def scan_after_mixed(spark, sf_dir):
    f = [EventFilter("purchase").after_position(T), EventFilter("view", "user", "5").after_position(100), EventFilter("signup")]
    return scan(log(spark, sf_dir), f).select(*PLAIN)


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE kind = 'purchase' AND k > 50 AND at_millis % 2 = 0")
def scan_payload_metadata(spark, sf_dir):
    """Conditions on a field of the payload and one of the metadata, beside a filter."""
    rows = log_envelope(spark, sf_dir).where(Filters().event("purchase").predicate())
    rows = rows.where((field_of("data", "k", "long") > 50) & (field_of("metadata", "at_millis", "long") % 2 == 0))
    return rows.select("aggregate_id", "kind", "position", field_of("data", "amount_cents", "long").alias("c"), field_of("data", "k", "long").alias("k"))


@query(f"""{LOG}, n AS (SELECT position, at_millis // 86400000 AS day FROM e), x AS (SELECT min(day) + 3 AS day, max(position) // 2 AS position FROM n) SELECT position, day FROM n WHERE day > (SELECT day FROM x) OR (day = (SELECT day FROM x) AND position > (SELECT position FROM x))""")
def scan_after_pair(spark, sf_dir):
    """Events after a checkpoint of two parts, a day and a position, the day deciding first."""
    rows = log(spark, sf_dir).select("position", C.epoch_day(F.col("at_millis")).alias("day"))
    return rows.where(C.after(["day", "position"], [rows.agg(F.min("day") + 3).scalar(), rows.agg(F.floor(F.max("position") / 2)).scalar()]))


@query(f"{LOG} SELECT {ENVELOPE} FROM e WHERE false")
def scan_empty_filters(spark, sf_dir):
    return log(spark, sf_dir).where(Filters().predicate()).select(*PLAIN)


@query(f"{LOG} SELECT 'user' AS aggregate_kind, aggregate_id, max(position) AS last_position FROM e GROUP BY 2")
def stream_heads(spark, sf_dir):
    return log(spark, sf_dir).groupBy(*E.STREAM).agg(F.max("position").alias("last_position"))


@query(f"""{LOG} SELECT 'matching' AS name, max(CASE WHEN kind = 'signup' OR (kind = 'purchase' AND aggregate_id = '7') THEN position END) AS checkpoint FROM e
UNION ALL SELECT 'latest', max(position) FROM e UNION ALL SELECT 'exact', max(position) FROM e WHERE position = 5 UNION ALL SELECT 'beyond', NULL""")
def checkpoints(spark, sf_dir):
    """Of the matching events, of all, of one position, and of one that doesn't exist: one scan."""
    matching = Filters().event("signup").event_for("user", "purchase", "7").predicate()
    found = log(spark, sf_dir).agg(*[F.max(F.when(p, F.col("position"))).alias(n) for n, p in (("matching", matching), ("latest", F.lit(True)), ("exact", F.col("position") == 5), ("beyond", F.col("position") == 1 << 60))])
    return found.unpivot([], ["matching", "latest", "exact", "beyond"], "name", "checkpoint")


LINES = """, o AS (SELECT o_orderkey AS order_key, 0 AS phase, 'order.placed' AS kind, o_custkey AS customer_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderstatus AS status FROM orders),
l AS (SELECT l_orderkey AS order_key, 1 AS phase, l_linenumber AS line_number, l_partkey AS part_key, l_suppkey AS supplier_key, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
  CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS flag, l_linestatus AS line_status, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS ship_day FROM lineitem),
v AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY line_number, part_key, supplier_key, quantity, price_cents, discount, tax, flag, line_status, ship_day) AS version FROM l)"""
COMMERCE = "WITH" + LINES[1:]


@query(f"""{COMMERCE} SELECT row_number() OVER (ORDER BY order_key, phase, version) - 1 AS position, order_key, kind, line_number FROM
(SELECT order_key, phase, kind, NULL AS line_number, 0 AS version FROM o UNION ALL SELECT order_key, phase, 'order.line_added', line_number, version FROM v)""")
def commit_positions(spark, sf_dir):
    return dense_positions(E.order_log(spark, sf_dir), "order_key", E.LINE_ORDER).select("position", "order_key", "kind", "line_number")


# --- commutative and last-writer folds -----------------------------------------------------------------------------


@query(f"{LOG} SELECT CAST(sum(c) AS BIGINT) AS total FROM e WHERE kind = 'purchase'")
def proj_total_global(spark, sf_dir):
    return log(spark, sf_dir).where(is_("purchase")).agg(F.sum("c").alias("total"))


@query(f"{LOG} SELECT count(*) AS n FROM e WHERE kind = 'view'")
def proj_count_global(spark, sf_dir):
    return log(spark, sf_dir).where(is_("view")).agg(F.count("*").alias("n"))


@query(f"{LOG} SELECT aggregate_id, CAST(sum(c) AS BIGINT) AS total FROM e WHERE kind = 'purchase' GROUP BY 1")
def proj_total_by_stream(spark, sf_dir):
    return log(spark, sf_dir).where(is_("purchase")).groupBy("aggregate_id").agg(F.sum("c").alias("total"))


@query(f"{LOG} SELECT aggregate_id, CAST(sum(c) AS BIGINT) AS total FROM e WHERE kind = 'purchase' AND aggregate_id IN ('1', '2') GROUP BY 1")
def proj_total_scoped(spark, sf_dir):
    f = Filters().event_for("user", "purchase", "1").event_for("user", "purchase", "2")
    return log(spark, sf_dir).where(f.predicate()).groupBy("aggregate_id").agg(F.sum("c").alias("total"))


@query(f"""{LOG} SELECT aggregate_id, CAST(coalesce(sum(c) FILTER (kind = 'purchase'), 0) AS BIGINT) AS total, count(*) FILTER (kind = 'view') AS n_views,
arg_max(k, position) FILTER (kind = 'error') AS last_k FROM e WHERE kind IN ('purchase', 'view', 'error') GROUP BY 1""")
def proj_kind_mix(spark, sf_dir):
    rows = log(spark, sf_dir).where(Filters().events(["purchase", "view", "error"]).predicate())
    return rows.groupBy("aggregate_id").agg(folds.total_when(is_("purchase"), "c").alias("total"), folds.count_when(is_("view")).alias("n_views"), folds.last_when(is_("error"), "k").alias("last_k"))


@query(f"""{LOG} SELECT CASE kind WHEN 'purchase' THEN 'sold' WHEN 'click' THEN 'returned' ELSE 'seen' END AS measure, 'sku-' || (k % 10) AS sku, CAST(sum(c) AS BIGINT) AS total FROM e
WHERE kind = 'purchase' OR (kind = 'click' AND aggregate_id = '7') OR (kind = 'view' AND aggregate_id = '3') GROUP BY 1, 2""")
def proj_scoped_maps(spark, sf_dir):
    """A global and two scoped filters, each with a map of its own, keyed by a field of the payload."""
    f = Filters().event("purchase", "sold").event_for("user", "click", "7", "returned").event_for("user", "view", "3", "seen")
    measure = F.element_at(F.create_map(*[F.lit(x) for kv in f.handlers.items() for x in kv]), F.col("kind"))
    return log(spark, sf_dir).where(f.predicate()).groupBy(measure.alias("measure"), F.concat(F.lit("sku-"), F.col("k") % 10).alias("sku")).agg(F.sum("c").alias("total"))


@query(f"""{LOG}, s AS (SELECT aggregate_id, max(position) AS opened FROM e WHERE kind = 'signup' GROUP BY 1)
SELECT e.aggregate_id, CAST(coalesce(sum(c) FILTER (kind = 'purchase' AND position > coalesce(opened, -1)), 0) AS BIGINT) AS balance FROM e LEFT JOIN s USING (aggregate_id) WHERE kind IN ('signup', 'purchase') GROUP BY 1""")
def proj_balance_reopen(spark, sf_dir):
    """signup sets 0, purchase adds."""
    rows = folds.segmented(log(spark, sf_dir).where(Filters().events(["signup", "purchase"]).predicate()), is_("signup"), "aggregate_id")
    per = rows.groupBy("aggregate_id", "segment").agg(folds.total_when(is_("purchase"), "c").alias("balance"))
    return per.groupBy("aggregate_id").agg(F.max_by("balance", "segment").alias("balance"))


@query(f"""{LOG}, n AS (SELECT CAST(floor(at_millis / 86400000) AS BIGINT) AS epoch_day, kind, c FROM e)
SELECT epoch_day, CAST(sum(CASE WHEN kind = 'purchase' THEN c ELSE 0 END) AS BIGINT) AS gross, CAST(sum(CASE WHEN kind = 'error' THEN c ELSE 0 END) AS BIGINT) AS refunded,
CAST(sum(CASE WHEN kind = 'purchase' THEN c ELSE -c END) AS BIGINT) AS net FROM n WHERE kind IN ('purchase', 'error') GROUP BY 1""")
def proj_net_per_day(spark, sf_dir):
    rows = log(spark, sf_dir).where(Filters().events(["purchase", "error"]).predicate()).groupBy(C.epoch_day(F.col("at_millis")).alias("epoch_day"))
    out = rows.agg(folds.total_when(is_("purchase"), "c").alias("gross"), folds.total_when(is_("error"), "c").alias("refunded"))
    return out.withColumn("net", F.col("gross") - F.col("refunded"))


@query(f"{LOG} SELECT aggregate_id, arg_min(kind, position) AS created_by, arg_max(kind, position) AS status, count(*) AS n_events, max(position) AS version FROM e GROUP BY 1")
def agg_state_machine(spark, sf_dir):
    return log(spark, sf_dir).groupBy("aggregate_id").agg(F.min_by("kind", "position").alias("created_by"), F.max_by("kind", "position").alias("status"), F.count("*").alias("n_events"), F.max("position").alias("version"))


def versioned_lines(spark, sf_dir) -> DataFrame:
    lines = E.order_log(spark, sf_dir).where("phase = 1")
    return lines.withColumn("version", F.row_number().over(Window.partitionBy("order_key").orderBy(*E.LINE_ORDER)).cast("long"))


@query(f"{COMMERCE} SELECT order_key, version AS ordinal, part_key, quantity FROM v")
def agg_item_list(spark, sf_dir):
    return versioned_lines(spark, sf_dir).select("order_key", F.col("version").alias("ordinal"), "part_key", "quantity")


@query(f"{COMMERCE} SELECT order_key, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(CASE WHEN flag = 'R' THEN -price_cents ELSE price_cents END) AS BIGINT) AS total FROM l GROUP BY 1")
def agg_order_totals(spark, sf_dir):
    lines = E.order_log(spark, sf_dir).where("phase = 1")
    return lines.groupBy("order_key").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"), F.sum(F.when(F.col("flag") == "R", -F.col("price_cents")).otherwise(F.col("price_cents"))).alias("total"))


# --- ordered folds -------------------------------------------------------------------------------------------------


@query(f"""{LOG}, s AS (SELECT *, sum(CASE kind WHEN 'purchase' THEN c ELSE -c END) OVER ({RUN}) AS total FROM e WHERE kind IN ('purchase', 'click')),
b AS (SELECT *, total - least(min(total) OVER ({RUN}), 0) AS balance FROM s) SELECT aggregate_id, CAST(arg_max(balance, position) AS BIGINT) AS balance FROM b GROUP BY 1""")
def proj_clamped_balance(spark, sf_dir):
    """purchase adds, click subtracts, never below 0."""
    rows = log(spark, sf_dir).where(Filters().events(["purchase", "click"]).predicate())
    return folds.final(folds.clamped(rows, F.when(is_("purchase"), F.col("c")).otherwise(-F.col("c")), "aggregate_id"), ["balance"], "aggregate_id")


@query(f"""{LOG}, g AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER ({RUN}) AS seg FROM e),
s AS (SELECT *, sum(CASE kind WHEN 'purchase' THEN c WHEN 'click' THEN -c ELSE 0 END) OVER (PARTITION BY aggregate_id, seg ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM g),
b AS (SELECT *, total - least(min(total) OVER (PARTITION BY aggregate_id, seg ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS balance FROM s)
SELECT aggregate_id, CAST(arg_max(balance, position) AS BIGINT) AS balance, coalesce(arg_max(kind = 'signup', position) FILTER (kind IN ('signup', 'view')), false) AS active, arg_max(k, position) FILTER (kind = 'purchase') AS last_due,
arg_max(at_millis, position) AS last_at FROM b GROUP BY 1""")
def proj_clamp_reset_meta(spark, sf_dir):
    """purchase adds, click subtracts down to 0, error resets to 0, signup and view turn active on and off; the last event's metadata."""
    change = F.when(is_("purchase"), F.col("c")).when(is_("click"), -F.col("c")).otherwise(F.lit(0))
    rows = folds.clamped_with_resets(log(spark, sf_dir), change, is_("error"), "aggregate_id")
    active = F.coalesce(folds.last_when(F.col("kind").isin("signup", "view"), is_("signup")), F.lit(False))
    return rows.groupBy("aggregate_id").agg(F.max_by("balance", "position").alias("balance"), active.alias("active"), folds.last_when(is_("purchase"), "k").alias("last_due"), F.max_by("at_millis", "position").alias("last_at"))


@query(f"""{LOG}, p AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'signup' THEN c END IGNORE NULLS) OVER ({RUN}), 0) AS price,
max(CASE WHEN kind IN ('signup', 'view') THEN 1 ELSE 0 END) OVER ({RUN}) AS known FROM e)
SELECT aggregate_id, CAST(sum(CASE WHEN kind = 'signup' THEN k WHEN kind = 'view' THEN k - 50 WHEN kind = 'purchase' AND known = 1 THEN -k ELSE 0 END) AS BIGINT) AS stock,
CAST(sum(CASE WHEN kind = 'signup' THEN k * c WHEN kind = 'view' THEN (k - 50) * price WHEN kind = 'purchase' AND known = 1 THEN -k * price ELSE 0 END) AS BIGINT) AS stock_value,
CAST(sum(CASE WHEN kind = 'purchase' THEN k * c ELSE 0 END) AS BIGINT) AS revenue, CAST(sum(CASE WHEN kind = 'error' THEN c ELSE 0 END) AS BIGINT) AS refunds FROM p GROUP BY 1""")
def proj_asof_valuation(spark, sf_dir):
    """signup restocks k at price c, view adjusts by k - 50 and purchase sells k, both at the latest price; a sale counts in stock once the key is known; error refunds c."""
    rows = log(spark, sf_dir).withColumn("price", F.coalesce(folds.as_of(F.when(is_("signup"), F.col("c")), "aggregate_id"), F.lit(0))).withColumn("known", folds.known(F.col("kind").isin("signup", "view"), "aggregate_id"))
    sold = is_("purchase") & F.col("known")
    units = F.when(is_("signup"), F.col("k")).when(is_("view"), F.col("k") - 50).when(sold, -F.col("k")).otherwise(F.lit(0))
    price = F.when(is_("signup"), F.col("c")).otherwise(F.col("price"))
    return rows.groupBy("aggregate_id").agg(F.sum(units).alias("stock"), F.sum(units * price).alias("stock_value"), folds.total_when(is_("purchase"), F.col("k") * F.col("c")).alias("revenue"), folds.total_when(is_("error"), "c").alias("refunds"))


@query("""WITH q AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT event_id, CASE WHEN k % 7 = 0 THEN id WHEN k % 11 = 0 THEN id || '::' || k || '::x' ELSE id || '::' || k END AS key FROM q),
p AS (SELECT *, string_split(key, '::') AS parts FROM m) SELECT event_id, key, CASE WHEN len(parts) = 2 THEN parts[1] END AS sku, CASE WHEN len(parts) = 2 THEN parts[2] END AS number, 'sale:' || key AS stored FROM p""")
def key_codec(spark, sf_dir):
    """Composite keys into their two parts; others are null."""
    rows = log(spark, sf_dir)
    key = F.when(F.col("k") % 7 == 0, F.col("aggregate_id")).when(F.col("k") % 11 == 0, F.concat_ws("::", "aggregate_id", "k", F.lit("x"))).otherwise(F.concat_ws("::", "aggregate_id", "k"))
    rows = rows.select(F.col("position").alias("event_id"), key.alias("key")).withColumn("parts", C.split_key(F.col("key")))
    return rows.select("event_id", "key", F.col("parts.left").alias("sku"), F.col("parts.right").alias("number"), C.storage_key("sale:", "key").alias("stored"))


SEG = "PARTITION BY aggregate_id, seg ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(f"""{LOG}, g AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER ({RUN}) AS seg FROM e),
s AS (SELECT *, sum(CASE kind WHEN 'signup' THEN c WHEN 'view' THEN c WHEN 'error' THEN -c ELSE 0 END) OVER ({SEG}) AS h, sum(CASE kind WHEN 'purchase' THEN c WHEN 'click' THEN -c WHEN 'error' THEN -c ELSE 0 END) OVER ({SEG}) AS r FROM g),
b AS (SELECT *, h - least(min(h) OVER ({SEG}), 0) AS on_hand, r - least(min(r) OVER ({SEG}), 0) AS reserved FROM s),
f AS (SELECT aggregate_id, CAST(arg_max(on_hand, position) AS BIGINT) AS on_hand, CAST(arg_max(reserved, position) AS BIGINT) AS reserved FROM b GROUP BY 1) SELECT *, greatest(on_hand - reserved, 0) AS available FROM f""")
def proj_inventory(spark, sf_dir):
    """signup lists (on hand c, reserved 0), view replenishes, purchase reserves, click releases, error commits; nothing falls below 0."""
    on_hand = F.when(F.col("kind").isin("signup", "view"), F.col("c")).when(is_("error"), -F.col("c")).otherwise(F.lit(0))
    reserved = F.when(is_("purchase"), F.col("c")).when(F.col("kind").isin("click", "error"), -F.col("c")).otherwise(F.lit(0))
    rows = folds.segmented(log(spark, sf_dir), is_("signup"), "aggregate_id")
    rows = folds.clamped(folds.clamped(rows, on_hand, "aggregate_id", "segment", name="on_hand"), reserved, "aggregate_id", "segment", name="reserved")
    return folds.final(rows, ["on_hand", "reserved"], "aggregate_id").withColumn("available", C.saturating_sub("on_hand", "reserved"))


@query(f"""{LOG}, q AS (SELECT *, CASE kind WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'remove' WHEN 'error' THEN 'consume' END AS op FROM e WHERE kind IN ('purchase', 'click', 'error')),
w AS (SELECT *, lag(op) OVER (PARTITION BY aggregate_id, k ORDER BY position) AS before FROM q)
SELECT aggregate_id, count(*) FILTER (op = 'add' AND before IS DISTINCT FROM 'add') AS n_reserved, count(*) FILTER (op = 'consume' AND before = 'add') AS n_committed, count(*) FILTER (op = 'remove' AND before = 'add') AS n_released FROM w GROUP BY 1""")
def proj_reservation_effects(spark, sf_dir):
    """Per stream and element k: a commit or release counts only if the operation before it is a reservation."""
    op = F.when(is_("purchase"), F.lit("add")).when(is_("click"), F.lit("remove")).otherwise(F.lit("consume"))
    rows = log(spark, sf_dir).where(F.col("kind").isin("purchase", "click", "error")).withColumn("op", op)
    rows = rows.withColumn("found", F.coalesce(folds.effective(F.col("op"), "aggregate_id", "k"), F.lit(False)))
    counts = [folds.count_when((F.col("op") == o) & (F.col("found") == f)).alias(n) for n, o, f in (("n_reserved", "add", False), ("n_committed", "consume", True), ("n_released", "remove", True))]
    return rows.groupBy("aggregate_id").agg(*counts)


@query(f"""{LOG}, q AS (SELECT *, CASE kind WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'remove' WHEN 'error' THEN 'consume' END AS op FROM e WHERE kind IN ('purchase', 'click', 'error')),
w AS (SELECT position, lag(op) OVER (PARTITION BY aggregate_id, k ORDER BY position) AS before FROM q),
c AS (SELECT e.*, CASE WHEN kind IN ('signup', 'view') THEN c WHEN kind = 'error' AND before = 'add' THEN -c ELSE 0 END AS change FROM e LEFT JOIN w USING (position)),
s AS (SELECT *, sum(change) OVER ({RUN}) AS total FROM c), b AS (SELECT *, total - least(min(total) OVER ({RUN}), 0) AS on_hand FROM s) SELECT aggregate_id, CAST(arg_max(on_hand, position) AS BIGINT) AS on_hand FROM b GROUP BY 1""")
def proj_on_hand_effective(spark, sf_dir):
    """Stock that signup and view raise, and that a commit (error) lowers only if the operation before it on the same element k is a reservation."""
    op = F.when(is_("purchase"), F.lit("add")).when(is_("click"), F.lit("remove")).when(is_("error"), F.lit("consume"))
    rows = log(spark, sf_dir).withColumn("op", op)
    marked = Window.partitionBy("aggregate_id", "k").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("found", F.coalesce(F.last("op", ignorenulls=True).over(marked) == "add", F.lit(False)))
    change = F.when(F.col("kind").isin("signup", "view"), F.col("c")).when(is_("error") & F.col("found"), -F.col("c")).otherwise(F.lit(0))
    return folds.final(folds.clamped(rows, change, "aggregate_id", name="on_hand"), ["on_hand"], "aggregate_id")


@query(f"""{COMMERCE}, r AS (SELECT customer_id, CAST(sum(price_cents) AS BIGINT) AS refunded FROM l JOIN o USING (order_key) WHERE flag = 'R' GROUP BY 1),
a AS (SELECT customer_id, count(*) AS n_orders, string_agg(order_key, ',' ORDER BY order_key) AS orders, max(order_key) AS last_order, CAST(sum(total_cents) AS BIGINT) AS authorised, CAST(coalesce(sum(total_cents) FILTER (status = 'F'), 0) AS BIGINT) AS captured FROM o GROUP BY 1)
SELECT customer_id, n_orders, orders, last_order, authorised, captured, coalesce(refunded, 0) AS refunded, greatest(captured - coalesce(refunded, 0), 0) AS lifetime, greatest(authorised - captured, 0) AS outstanding FROM a LEFT JOIN r USING (customer_id)""")
def proj_customer_account(spark, sf_dir):
    """Events of several streams meet by the customer in their payload; lines find theirs by their order. The customer's orders are listed in log order."""
    rows = E.order_log(spark, sf_dir)
    per_order = rows.groupBy("order_key").agg(F.max("customer_id").alias("customer_id"), F.max("total_cents").alias("total_cents"), F.max("status").alias("status"), folds.total_when(F.col("flag") == "R", "price_cents").alias("refunded"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("order_key")), lambda x: x.cast("string")), ",").alias("orders")  # a customer's own
    per = per_order.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count("*").alias("n_orders"), listed, F.max("order_key").alias("last_order"), F.sum("total_cents").alias("authorised"), folds.total_when(F.col("status") == "F", "total_cents").alias("captured"), F.sum("refunded").alias("refunded"))
    return per.withColumn("lifetime", C.saturating_sub("captured", "refunded")).withColumn("outstanding", C.saturating_sub("authorised", "captured"))


@query(f"""{COMMERCE}, op AS (SELECT order_key, part_key, arg_max(flag, version) AS last FROM v WHERE flag IN ('N', 'R') GROUP BY 1, 2),
m AS (SELECT order_key, count(*) AS n_members, string_agg(part_key, ',' ORDER BY part_key) AS members FROM op WHERE last = 'N' GROUP BY 1), s AS (SELECT order_key, arg_max(line_status, version) AS last_line_status FROM v GROUP BY 1)
SELECT order_key, status, last_line_status, coalesce(n_members, 0) AS n_members, coalesce(members, '') AS members FROM o LEFT JOIN s USING (order_key) LEFT JOIN m USING (order_key)""")
def proj_fulfilment_status(spark, sf_dir):
    """Order status, last line status, and the products in the order's set (flag N adds, R removes), from orders and lines as one log.

    All rows of an order meet once: windows and aggregates share their partitioning. The order's number is read from its stream's key.
    """
    rows = E.order_log(spark, sf_dir).withColumn("stream", C.storage_key("order:", "order_key"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("stream").orderBy(*E.LINE_ORDER)))
    op = F.when(F.col("flag") == "N", F.lit("add")).when(F.col("flag") == "R", F.lit("remove"))
    rows = rows.withColumn("op", op).withColumn("is_last", F.lead("op").over(Window.partitionBy("stream", "part_key", F.col("op").isNotNull()).orderBy("position")).isNull())
    inside = F.when((F.col("op") == "add") & F.col("is_last"), F.col("part_key"))
    out = rows.groupBy("stream").agg(F.max("status").alias("status"), F.max_by("line_status", F.when(F.col("phase") == 1, F.col("position"))).alias("last_line_status"), F.sort_array(F.collect_list(inside)).alias("inside"), F.max("phase").alias("phase"), F.min("phase").alias("first"))
    number = F.regexp_extract("stream", "^order:([0-9]+)$", 1).cast("long").alias("order_key")
    return out.where("first = 0").select(number, "status", "last_line_status", F.size("inside").cast("long").alias("n_members"), F.array_join(F.transform("inside", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT l_orderkey AS order_key, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def price_nested_lines(spark, sf_dir):
    """Orders with nested lines, exploded and priced by their products."""
    nested = E.order_log(spark, sf_dir).where("phase = 1").groupBy("order_key").agg(F.collect_list(F.struct("part_key", "quantity")).alias("lines"))  # an order's own
    lines = nested.select("order_key", F.explode("lines").alias("line"))
    part = E.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), E.cents(F.col("p_retailprice")).alias("price"))
    return lines.select("order_key", "line.*").join(part, "part_key").groupBy("order_key").agg(F.sum(F.col("quantity") * F.col("price")).alias("total"))


@query(f"{LOG} SELECT aggregate_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS n, max(position) AS version FROM e WHERE kind = 'purchase' AND position <= {T} GROUP BY 1")
def time_travel(spark, sf_dir):
    return log(spark, sf_dir).where(is_("purchase") & (F.col("position") <= T)).groupBy("aggregate_id").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.max("position").alias("version"))


@query(f"{LOG} SELECT aggregate_id, position, CAST(sum(c) OVER ({RUN}) AS BIGINT) AS total, count(*) OVER ({RUN}) AS n FROM e WHERE kind = 'purchase'")
def updates_stream(spark, sf_dir):
    """The state after every event."""
    w = folds.running("aggregate_id")
    return log(spark, sf_dir).where(is_("purchase")).select("aggregate_id", "position", F.sum("c").over(w).alias("total"), F.count("*").over(w).alias("n"))


# --- snapshots -----------------------------------------------------------------------------------------------------


@query(f"{LOG}, r AS (SELECT aggregate_id, position, row_number() OVER (PARTITION BY aggregate_id ORDER BY position) AS n, CAST(sum(c) OVER ({RUN}) AS BIGINT) AS total FROM e WHERE kind = 'purchase') SELECT aggregate_id, position, total FROM r WHERE n % 5 = 0")
def snapshot_points(spark, sf_dir):
    """Where a policy of every 5 events stores, one event at a time, and what."""
    rows = log(spark, sf_dir).where(is_("purchase")).withColumn("total", F.sum("c").over(folds.running("aggregate_id")))
    return snapshots.stored_points(rows, snapshots.every(5), "aggregate_id").select("aggregate_id", "position", "total")


STATE = "SELECT aggregate_id, max(position) AS position, CAST(sum(c) AS BIGINT) AS total FROM e WHERE kind = 'purchase' AND position <= {} GROUP BY 1"


@query(f"""{LOG}, x AS (SELECT max(position) AS head FROM e), old AS ({STATE.format('(SELECT head * 3 // 5 FROM x)')}), new AS (SELECT * FROM ({STATE.format('(SELECT head FROM x)')}) WHERE CAST(aggregate_id AS BIGINT) % 3 = 0
UNION ALL SELECT * FROM ({STATE.format('(SELECT head * 2 // 5 FROM x)')}) WHERE CAST(aggregate_id AS BIGINT) % 3 = 1 UNION ALL SELECT * FROM ({STATE.format('(SELECT head * 3 // 5 FROM x)')}) WHERE CAST(aggregate_id AS BIGINT) % 3 = 2)
SELECT coalesce(n.aggregate_id, o.aggregate_id) AS aggregate_id, CASE WHEN o.position IS NULL OR n.position > o.position THEN n.position ELSE o.position END AS position, CASE WHEN o.position IS NULL OR n.position > o.position THEN n.total ELSE o.total END AS total,
CASE WHEN n.position IS NULL THEN 'none' WHEN o.position IS NULL OR n.position > o.position THEN 'stored' ELSE 'declined' END AS offer FROM old o FULL JOIN new n ON o.aggregate_id = n.aggregate_id""")
def snapshot_offer_merge(spark, sf_dir):
    """Snapshots taken after three fifths of the log; offers from its head, from two fifths, and equal ones: only a greater position replaces."""
    rows = log(spark, sf_dir)
    head, third = rows.agg(F.max("position")).scalar(), F.col("aggregate_id").cast("long") % 3
    part = lambda fifths: F.col("position") <= F.floor(head * fifths / 5)
    totals = lambda when, name: (F.max(F.when(when, F.col("position"))).alias(f"{name}_position"), F.sum(F.when(when, F.col("c"))).alias(f"{name}_total"))
    offered = F.when(third == 0, F.lit(True)).when(third == 1, part(2)).otherwise(part(3))
    per = rows.where(is_("purchase")).groupBy("aggregate_id").agg(*totals(part(3), "old"), *totals(offered, "new"))
    state = lambda name: per.where(F.col(f"{name}_position").isNotNull()).select("aggregate_id", F.col(f"{name}_position").alias("position"), F.col(f"{name}_total").alias("total"))
    return snapshots.merge(state("old"), state("new"), ["aggregate_id"], ["total"])


@query(f"{LOG} SELECT aggregate_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS n, max(position) AS version FROM e WHERE kind = 'purchase' GROUP BY 1")
def snapshot_plus_tail(spark, sf_dir):
    """State at a position and the fold of what came after it: the same as a full replay."""
    bought = log(spark, sf_dir).where(is_("purchase"))
    base = time_travel(spark, sf_dir)
    tail = bought.where(F.col("position") > T).groupBy("aggregate_id").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.max("position").alias("version"))
    return snapshots.resume(base, tail, ["aggregate_id"], {"total": F.sum, "n": F.sum, "version": F.max})


@query(f"{LOG}, r AS (SELECT position, row_number() OVER (ORDER BY position) AS n, count(*) OVER () AS total FROM e WHERE kind = 'purchase') SELECT position FROM r WHERE n > total - total % 8")
def checkpoint_redelivery(spark, sf_dir):
    """With a checkpoint every 8 events, what a restart after the last event delivers again."""
    bought = log(spark, sf_dir).where(is_("purchase")).select("position")
    late = bought.orderBy(F.desc("position")).limit(8).withColumn("n", F.row_number().over(Window.orderBy(F.desc("position"))))  # fewer than 8 are left
    return late.where(F.col("n") <= bought.agg(F.count("*")).scalar() % 8).select("position")


# --- commits and commands ------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT conv_id AS id, max(turn) AS actual FROM conversations GROUP BY 1),
c AS (SELECT id, CASE id % 3 WHEN 0 THEN actual WHEN 1 THEN actual - 1 END AS expected FROM h UNION ALL SELECT id + 1000000, CASE WHEN id % 2 = 1 THEN 0 END FROM h)
SELECT c.id AS stream, c.expected, h.actual, CASE WHEN c.expected IS NOT DISTINCT FROM h.actual THEN 'ok' ELSE 'conflict' END AS outcome FROM c LEFT JOIN h USING (id)""")
def optimistic_check(spark, sf_dir):
    """Expected versions against the heads of streams, also of streams that don't exist."""
    heads = E.conversation_log(spark, sf_dir).groupBy(F.col("aggregate_id").cast("long").alias("stream")).agg(F.max("version").alias("actual"))
    s = F.col("stream")
    wanted = heads.select("stream", F.when(s % 3 == 0, F.col("actual")).when(s % 3 == 1, F.col("actual") - 1).alias("expected"))
    wanted = wanted.union(heads.select(s + 1_000_000, F.when(s % 2 == 1, F.lit(0).cast("long"))))
    return commands.check_versions(wanted, heads, ["stream"])


@query("""WITH h AS (SELECT DISTINCT o_custkey AS id FROM orders), c AS (SELECT c_custkey AS customer_id, unnest(['create', 'update', 'upsert']) AS command FROM customer)
SELECT customer_id, command, CASE command WHEN 'create' THEN CASE WHEN id IS NULL THEN 'created' ELSE 'already_exists' END WHEN 'update' THEN CASE WHEN id IS NULL THEN 'not_found' ELSE 'updated' END
ELSE CASE WHEN id IS NULL THEN 'created' ELSE 'updated' END END AS outcome FROM c LEFT JOIN h ON customer_id = id""")
def lifecycle_outcome(spark, sf_dir):
    heads = E.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id")).distinct()
    wanted = E.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.explode(F.array(*map(F.lit, ("create", "update", "upsert")))).alias("command"))
    return commands.lifecycle(wanted, heads, ["customer_id"])


@query("""WITH RECURSIVE l AS (SELECT l_partkey AS part_key, l_orderkey AS order_key, CAST(l_quantity AS BIGINT) AS quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem),
r AS (SELECT part_key, 0::BIGINT AS n, 0::BIGINT AS order_key, 0::BIGINT AS quantity, 200::BIGINT AS available, []::BIGINT[] AS held, '' AS outcome FROM (SELECT DISTINCT part_key FROM l)
UNION ALL SELECT part_key, n, order_key, quantity, CASE WHEN o = 'reserved' THEN available - quantity ELSE available END, CASE WHEN o = 'reserved' THEN list_append(held, order_key) ELSE held END, o FROM
(SELECT l.part_key, l.n, l.order_key, l.quantity, r.available, r.held, CASE WHEN list_contains(r.held, l.order_key) THEN 'unchanged' WHEN r.available < l.quantity THEN 'rejected' ELSE 'reserved' END AS o FROM r JOIN l ON l.part_key = r.part_key AND l.n = r.n + 1))
SELECT part_key, n AS request, order_key, quantity, available, outcome FROM r WHERE n > 0""")
def reserve_decisions(spark, sf_dir):
    """Reservations against a stock of 200 for each product, in order: each decision depends on those before it."""
    i = E.table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = i.select(F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key"), F.col("l_quantity").cast("long").alias("quantity"), *order[1:])

    names = ["part_key", "request", "order_key", "quantity", "available", "outcome"]

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by product; a product's state lives until the next product."""
        part, n, available, held = None, 0, 200, set()
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            for p, o, q in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    part, n, available, held = p, 0, 200, set()
                n += 1
                outcome = "unchanged" if o in held else "rejected" if available < q else "reserved"
                if outcome == "reserved":
                    available -= q
                    held.add(o)
                out.append((n, available, outcome))
            request, left, outcomes = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(request, pa.int64()), b.column(1), b.column(2), pa.array(left, pa.int64()), pa.array(outcomes)], names)

    rows = together(rows, "part_key", "order_key", *order[1:])
    return rows.select("part_key", "order_key", "quantity").mapInArrow(decide, "part_key long, request long, order_key long, quantity long, available long, outcome string")


@query("SELECT i AS retry, CAST(least(50 * power(2, i), 5000) AS BIGINT) AS delay_ms FROM range(12) t(i)")
def retry_delays(spark, sf_dir):
    return spark.range(12).select(F.col("id").alias("retry"), C.retry_delay(F.col("id"), 50, 5000).alias("delay_ms"))


# --- evolution -----------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 13 > 2 THEN k % 3 + 1 END AS revision, CASE WHEN k % 13 > 2 THEN 'item-' || k END AS item, CASE WHEN k % 13 > 2 THEN k END AS pieces, CASE WHEN k % 13 > 2 THEN CASE WHEN k % 3 >= 1 THEN id ELSE 'anonymous' END END AS sender,
CASE WHEN k % 13 > 2 THEN CASE WHEN k % 3 = 2 THEN 'route ' || k ELSE 'standard' END END AS route FROM q""")
def event_upcast(spark, sf_dir):
    """Payloads of three versions, each brought to the last; what can't be read is null: broken JSON, no JSON object, a field of another type."""
    rows = log(spark, sf_dir)
    v, bad = F.col("k") % 3, F.col("k") % 13
    data = F.to_json(F.struct((v + 1).alias("revision"), F.concat(F.lit("item-"), F.col("k")).alias("item"), F.col("k").alias("pieces"), F.when(v >= 1, F.col("aggregate_id")).alias("sender"), F.when(v == 2, F.concat(F.lit("route "), F.col("k"))).alias("route")))
    data = F.when(bad == 0, F.substring(data, 1, 12)).when(bad == 1, F.lit("[1]")).when(bad == 2, F.lit('{"revision":"two","item":"x","pieces":1}')).otherwise(data)
    return evolve.PARCEL_SENT.decode(rows.select(F.col("position").alias("event_id"), data.alias("data"))).select("event_id", *[f"payload.{n}" for n in ("revision", "item", "pieces", "sender", "route")])


@query("""WITH q AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE k % 10 WHEN 0 THEN 'missing_field' WHEN 1 THEN 'bad_data' WHEN 2 THEN 'unknown_kind' WHEN 3 THEN 'bad_data' WHEN 4 THEN 'bad_data' ELSE 'ok' END AS outcome FROM q""")
def decode_errors(spark, sf_dir):
    """Events without a required field, with a required or an optional field of the wrong type, that are no JSON, and of an unknown kind."""
    rows = log(spark, sf_dir)
    bad = F.col("k") % 10
    parcel = F.to_json(F.struct(F.lit("item").alias("item"), F.col("k").alias("pieces")))
    data = F.when(bad == 0, F.lit('{"k":1}')).when(bad == 1, F.lit('{"amount_cents":"x","k":1}')).when(bad == 3, F.lit('{"item":"x","pieces":1,"revision":"one"}')).when(bad == 4, F.lit("not json")).when(bad == 5, parcel).otherwise(F.to_json(F.struct(F.col("c").alias("amount_cents"), "k")))
    kind = F.when(bad == 2, F.lit("never-registered")).when(bad.isin(3, 5), F.lit("parcel-sent")).otherwise(F.col("kind"))
    return evolve.check(rows.select("position", kind.alias("kind"), data.alias("data")), evolve.USER_EVENTS | {"parcel-sent": evolve.PARCEL_SENT}).select(F.col("position").alias("event_id"), "outcome")


# --- reactions -----------------------------------------------------------------------------------------------------


@query(f"{LOG} SELECT 'mirror' AS aggregate_kind, aggregate_id, c, position AS source, (SELECT max(position) FROM e) + row_number() OVER (ORDER BY position) AS position FROM e WHERE kind = 'purchase'")
def mirror_reactor(spark, sf_dir):
    """Each purchase copied to a mirror stream, at the positions after the log's head."""
    rows = log(spark, sf_dir)
    head = rows.agg(F.max("position")).scalar()
    copies = rows.where(is_("purchase")).select(F.lit("mirror").alias("aggregate_kind"), "aggregate_id", "c", F.col("position").alias("source"))
    return dense_positions(copies, "source", [], start=F.coalesce(head, F.lit(-1)) + 1)


@query(f"""{LOG}, w AS (SELECT *, lag(kind) OVER (PARTITION BY aggregate_id ORDER BY position) AS before, min(position) OVER (PARTITION BY aggregate_id) AS origin FROM e)
SELECT position, aggregate_id, 'c-' || origin AS correlation_id, before || '@' || aggregate_id AS causation_id FROM w WHERE kind = 'error'""")
def causation_chain(spark, sf_dir):
    w = Window.partitionBy("aggregate_id")
    rows = log(spark, sf_dir).withColumn("before", F.lag("kind").over(w.orderBy("position"))).withColumn("origin", F.min("position").over(w))
    return rows.where(is_("error")).select("position", "aggregate_id", F.concat(F.lit("c-"), F.col("origin")).alias("correlation_id"), C.causation(F.col("before"), F.col("aggregate_id")).alias("causation_id"))


@query(f"""{LOG} SELECT position // 1000 AS batch, count(*) FILTER (kind = 'purchase' AND aggregate_id = '7') AS n_matching, max(position) FILTER (kind = 'purchase' AND aggregate_id = '7') AS last_match, max(position) AS frontier FROM e GROUP BY 1""")
def frontier_progress(spark, sf_dir):
    """Per micro-batch of 1000 positions: matching events, and how far progress goes even without one."""
    match = Filters().event_for("user", "purchase", "7").predicate()
    rows = log(spark, sf_dir).groupBy(F.floor(F.col("position") / 1000).cast("long").alias("batch"))
    return rows.agg(folds.count_when(match).alias("n_matching"), F.max(F.when(match, F.col("position"))).alias("last_match"), F.max("position").alias("frontier"))


