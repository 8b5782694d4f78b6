"""Queries that go through a log: events are committed, loaded in bulk, subscribed to and reacted to, and what comes of it must equal SQL over the tables.

Each makes a log of its own in the shared folder (see foldlog.sources.commitlog.scratch). Commands run on the driver one
after another, as they would in a service, so those queries work on the small tables (nation, region); loads, reads and
folds of many streams run over the whole events, orders and lineitem tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlog.errors import AggregateAlreadyExists, AggregateNotFound, ConcurrencyConflict, Rejected
from foldlog.operators import snapshots
from foldlog.operators.filters import EventFilter, Filters
from foldlog.operators.process import Process
from foldlog.operators.repository import AggregateType, ProjectionType, Repository, SnapshotStore, aggregate, as_event, decide_rows, event, projection
from foldlog.sources import envelope as E
from foldlog.sources.commitlog import Event, EventLog, scratch
from foldlog.sources.datasource import register
from foldlog.streaming.live import LiveModel, LiveProjection, Reactor, Subscription

QUERIES: dict[str, tuple] = {}

LOG = """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, CAST(user_id AS VARCHAR) AS aggregate_id, event_type AS kind,
  CAST(round(value * 100) AS BIGINT) AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
NATIONS = "n AS (SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, row_number() OVER (ORDER BY n_nationkey) - 1 AS position FROM nation)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def loaded(spark: SparkSession, sf_dir: str) -> EventLog:
    """The whole events table, loaded into a new log."""
    log = EventLog(spark, scratch(spark))
    typed = E.event_log(spark, sf_dir)
    rows = E.enveloped(typed, ["amount_cents", "k"], ["at_millis"]).withColumnRenamed("position", "event_id")
    log.load_frame(rows, "event_id", [])
    return log


def nations(spark: SparkSession, sf_dir: str) -> list:
    """The rows of nation, by key: a fixed table of the schema, not one that grows."""
    return E.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def amount() -> Column:
    return F.get_json_object("data", "$.amount_cents").cast("long")


# --- a log of the whole table ----------------------------------------------------------------------------------------


@query(f"{LOG} SELECT position, aggregate_id, kind, c FROM e WHERE kind = 'purchase' OR (kind = 'view' AND aggregate_id = '7' AND position > 10)")
def log_load_events(spark, sf_dir):
    """What several filters select of a loaded log."""
    found = loaded(spark, sf_dir).load_events([EventFilter("purchase"), EventFilter("view", "user", "7").after_position(10)])
    return found.select("position", "aggregate_id", "kind", amount().alias("c"))


@query(f"{LOG} SELECT aggregate_id, max(position) AS last_position, count(*) AS n FROM e GROUP BY 1")
def log_after_compaction(spark, sf_dir):
    """Heads of streams from a log with a load, two commits and a compaction between them; the commit's stream isn't a user's."""
    log = loaded(spark, sf_dir)
    log.append("other", "x", [Event("noted", {"n": 1})])
    log.compact()
    log.append("other", "x", [Event("noted", {"n": 2})])
    return EventLog(spark, log.root).frame().where("aggregate_kind = 'user'").groupBy("aggregate_id").agg(F.max("position").alias("last_position"), F.count("*").alias("n"))


@query(f"{LOG} SELECT kind, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, min(position) AS first, max(position) AS last FROM e WHERE position > 99 AND kind IN ('purchase', 'click') GROUP BY 1")
def log_data_source(spark, sf_dir):
    """The log through the Python data source, which takes the conditions on kind and position over."""
    log = loaded(spark, sf_dir)
    register(spark)
    rows = spark.read.format("foldlog").load(log.root).where(F.col("kind").isin("purchase", "click") & (F.col("position") > 99))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(amount()).alias("total"), F.min("position").alias("first"), F.max("position").alias("last"))


@query(f"{LOG} SELECT aggregate_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS n FROM e WHERE kind = 'purchase' GROUP BY 1")
def live_model_state(spark, sf_dir):
    """State of a live mergeable model that has caught up with the log, restarted once between two halves of its life."""
    log = loaded(spark, sf_dir)
    model = LiveModel("totals", Filters().event("purchase"), ("aggregate_id",), {"total": F.sum(amount()), "n": F.count("*")}, {"total": F.sum, "n": F.sum})
    Subscription(log, model).start().stop()
    log.append("other", "x", [Event("noted", {"n": 1})])
    live = Subscription(log, model).start()
    live.stop()
    return live.current()


@query(f"{LOG}, s AS (SELECT *, sum(CASE kind WHEN 'purchase' THEN c ELSE -c END) OVER (PARTITION BY aggregate_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e WHERE kind IN ('purchase', 'click')), b AS (SELECT *, total - least(min(total) OVER (PARTITION BY aggregate_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS balance FROM s) SELECT aggregate_id, max(position) AS version, CAST(arg_max(balance, position) AS VARCHAR) AS state FROM b GROUP BY 1")
def fold_many_streams(spark, sf_dir):
    """Aggregates of all streams by Python handlers (a balance that never falls below 0), a task holding one state at a time."""
    account = AggregateType("User", apply={"purchase": lambda s, d: s + d["amount_cents"], "click": lambda s, d: max(0, s - d["amount_cents"])}, init=lambda: 0)
    log = loaded(spark, sf_dir)
    return Repository(log).load_many(account, log.frame().select("aggregate_id").distinct())


# --- commands for many streams ---------------------------------------------------------------------------------------


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
i AS (SELECT id, CAST(sum(CASE WHEN seq <= 2 THEN amount ELSE 0 END) AS BIGINT) AS due FROM l GROUP BY 1),
r AS (SELECT id, 0::BIGINT AS seq, due AS open, '' AS outcome, false AS settled FROM i
UNION ALL SELECT id, seq, CASE WHEN o = 'ok' THEN open - amount ELSE open END, o, settled OR (o = 'ok' AND amount = open) FROM (SELECT l.id, l.seq, l.amount, r.open, r.settled, CASE WHEN r.settled OR l.amount > r.open THEN 'rejected' ELSE 'ok' END AS o FROM r JOIN l ON l.id = r.id AND l.seq = r.seq + 1))
SELECT id AS invoice, seq AS payment, outcome, open, settled FROM r WHERE seq > 0""")
def settle_invoices(spark, sf_dir):
    """An invoice for each order over its first two lines, and each line's price as a payment: one that equals what is open settles it, one above it or after that is rejected."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    w = Window.partitionBy("l_orderkey")
    rows = E.table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isNotNull()).select("l_orderkey", E.cents(F.col("l_extendedprice")).alias("amount"), F.row_number().over(w.orderBy(*order)).cast("long").alias("seq"))
    lines = rows.select(F.col("l_orderkey").cast("string").alias("aggregate_id"), "seq", "amount", F.sum(F.when(F.col("seq") <= 2, F.col("amount")).otherwise(0)).over(w).alias("due"))
    row = lambda phase, seq, kind, data: F.struct(F.lit(phase).alias("phase"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), data.alias("data"))
    issued, paid = row(0, F.lit(0), "invoice-issued", F.to_json(F.struct("due"))), row(1, F.col("seq"), "pay", F.col("amount").cast("string"))
    both = lines.select("aggregate_id", F.explode(F.when(F.col("seq") == 1, F.array(issued, paid)).otherwise(F.array(paid))).alias("row")).select("aggregate_id", "row.*")
    out = decide_rows(both, invoice(), states=True).where("ordinal = 0").withColumn("state", F.from_json("state", "open long, settled boolean"))
    return out.select(F.col("aggregate_id").cast("long").alias("invoice"), F.col("seq").alias("payment"), "outcome", "state.open", "state.settled")


def invoice() -> AggregateType:
    def pay(state: dict, paid: int) -> list[Event]:
        if state["settled"] or paid > state["open"]:
            raise Rejected("settled" if state["settled"] else "more than is open")
        left = state["open"] - paid
        return [Event("payment-recorded", {"amount": paid, "open": left}), *([] if left else [Event("invoice-settled", {})])]

    return AggregateType(
        "Invoice",
        create={"invoice-issued": lambda d: {"open": d["due"], "settled": False}},
        apply={"payment-recorded": lambda s, d: s | {"open": d["open"]}, "invoice-settled": lambda s, d: s | {"settled": True}},
        handle={"pay": pay},
    )


# --- commits and commands one by one ---------------------------------------------------------------------------------


@query(f"WITH {NATIONS} SELECT CAST(region AS VARCHAR) AS aggregate_id, position, CAST(key AS BIGINT) AS key, lag(position) OVER (PARTITION BY region ORDER BY position) AS expected, 'conflict' AS second FROM n")
def commit_versions(spark, sf_dir):
    """Each nation committed to its region's stream at the version that was read before, and once more at that version: the second must conflict."""
    log, out = EventLog(spark, scratch(spark)), []
    for r in nations(spark, sf_dir):
        stream, new = str(r.n_regionkey), [Event("nation-joined", {"key": r.n_nationkey, "name": r.n_name})]
        expected = log.stream_version("region", stream)
        at = log.append_if_version("region", stream, expected, new)
        try:
            log.append_if_version("region", stream, expected, new)
            second = "committed"
        except ConcurrencyConflict as e:
            second = "conflict" if (e.expected, e.actual) == (expected, at) else "wrong"
        out.append((stream, at, r.n_nationkey, expected, second))
    return told(spark, out, "aggregate_id string, position long, key long, expected long, second string")


@event("nation-joined")
@dataclass
class Joined:
    key: int
    name: str


@aggregate(events=[Joined], kind="region")
@dataclass
class Region:
    names: list = field(default_factory=list)

    @classmethod
    def create_with_join(cls, c):
        return [Joined(*c)]

    def on_nation_joined(self, e):
        self.names.append(e.name)

    def handle_join(self, c):
        if c[1] in self.names:
            return []
        if len(self.names) >= 4:
            raise Rejected("full")
        return [Joined(*c)]


@query(f"""WITH {NATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY key) AS i FROM n)
SELECT CAST(region AS VARCHAR) AS region, CAST(key AS BIGINT) AS key, CASE WHEN i = 1 THEN 'not_found' WHEN i > 4 THEN 'rejected' ELSE 'committed' END AS updated, CASE WHEN i = 1 THEN 'committed' ELSE 'exists' END AS created, CASE WHEN i > 4 THEN 'rejected' ELSE 'unchanged' END AS upserted, least(i, 4) AS n_members FROM r""")
def command_outcomes(spark, sf_dir):
    """update, create and upsert of the same nation, one after another, with snapshots of every second event; a region takes four."""
    repo, out = Repository(EventLog(spark, scratch(spark))), []
    repo = repo.with_snapshots(SnapshotStore(repo.log, snapshots.every(2)))

    def outcome(call) -> str:
        try:
            return "unchanged" if call() is None else "committed"
        except AggregateNotFound:
            return "not_found"
        except AggregateAlreadyExists:
            return "exists"
        except Rejected:
            return "rejected"

    for r in nations(spark, sf_dir):
        region, c = str(r.n_regionkey), (r.n_nationkey, r.n_name)
        found = [outcome(lambda name=name, region=region, c=c: getattr(repo, name)(Region, region, "join", c)) for name in ("update", "create", "upsert")]
        out.append((region, r.n_nationkey, *found, len(repo.load(Region, region).names)))
    return told(spark, out, "region string, key long, updated string, created string, upserted string, n_members long")


@query(f"WITH {NATIONS} SELECT CAST(region AS VARCHAR) AS region, count(*) AS n, string_agg(name, ',' ORDER BY position) AS names, max(position) AS last_position FROM n GROUP BY 1")
def projection_loads(spark, sf_dir):
    """A projection by Python handlers over each region's stream, resumed from a snapshot after half of the commits; both ways to load agree, or n is negative."""
    repo, out, rows = Repository(EventLog(spark, scratch(spark))), [], nations(spark, sf_dir)
    store = SnapshotStore(repo.log)
    members = ProjectionType("members", lambda _: [], lambda i: Filters().event_for("region", "nation-joined", i, lambda s, context, d: [*s, d["name"]]))
    regions = sorted({str(r.n_regionkey) for r in rows})
    for i, r in enumerate(rows):
        if i == len(rows) // 2:
            for region in regions:
                repo.load_projection_with_snapshot(members, region, store)
        repo.log.append("region", str(r.n_regionkey), [Event("nation-joined", {"name": r.n_name})])
    for region in regions:
        names = repo.load_projection_with_snapshot(members, region, store)
        n = len(names) if names == repo.load_projection(members, region) else -1
        out.append((region, n, ",".join(names), store.load("members", region).position))
    return told(spark, out, "region string, n long, names string, last_position long")


# --- reactions -------------------------------------------------------------------------------------------------------


@query(f"WITH {NATIONS} SELECT CAST(region AS VARCHAR) AS region, count(*) AS n, string_agg(name, ',' ORDER BY position) AS names, 'nation-joined@' || CAST(region AS VARCHAR) AS causation_id, count(*) * 2 AS reactions FROM n GROUP BY 1")
def process_to_fixpoint(spark, sf_dir):
    """A process that sends each event of a region on to a mirror of it, whose events it sees too, until nothing is left; the mirrors' events name their cause."""
    repo = Repository(EventLog(spark, scratch(spark)))
    mirror = AggregateType("Mirror", apply={"mirrored": lambda s, d: [*s, d["name"]]}, init=list, handle={"add": lambda s, name: [Event("mirrored", {"name": name})]}, handle_create={"add": lambda name: [Event("mirrored", {"name": name})]})
    seen: dict[str, int] = {}

    def joined(step):
        region = step.event["aggregate_id"]
        seen[region] = seen.get(region, 0) + 1
        step.tell(mirror, region, "add", step.data["name"], create=step.load(mirror, region) is None)

    def mirrored(step):
        seen[step.event["aggregate_id"]] += 1

    for r in nations(spark, sf_dir):
        repo.log.append("region", str(r.n_regionkey), [Event("nation-joined", {"key": r.n_nationkey, "name": r.n_name})])
    Process(repo, "mirroring", {"nation-joined": joined, "mirrored": mirrored}).run()
    copies = repo.log.frame().where("kind = 'mirrored'").groupBy(F.col("aggregate_id").alias("region"))
    found = copies.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.get_json_object("data", "$.name").alias("name")))), lambda x: x["name"]), ",").alias("names"), F.max(F.get_json_object("metadata", "$.causation_id")).alias("causation_id"))
    return found.join(told(spark, list(seen.items()), "region string, reactions long"), "region")


@query(f"WITH {NATIONS}, x AS (SELECT count(*) AS total FROM n) SELECT CAST(key AS BIGINT) AS key, CASE WHEN position >= total - total % 8 THEN 2 ELSE 1 END AS deliveries FROM n, x")
def reactor_redelivery(spark, sf_dir):
    """A reactor with a checkpoint every 8 events, stopped and started again: what came after the last checkpoint is delivered twice."""
    log, seen = EventLog(spark, scratch(spark)), {}
    for r in nations(spark, sf_dir):
        log.append("region", str(r.n_regionkey), [Event("nation-joined", {"key": r.n_nationkey})])

    def react(e):
        seen[e["data"]["key"]] = seen.get(e["data"]["key"], 0) + 1

    for _ in range(2):
        Reactor(log, "counting", Filters().event("nation-joined"), react, snapshots.every(8)).start().stop()
    return told(spark, sorted(seen.items()), "key long, deliveries long")


@projection(events=[Joined])
@dataclass
class Members:
    names: list = field(default_factory=list)

    def on_nation_joined(self, context, e):
        self.names.append(e.name)


@query(f"WITH {NATIONS} SELECT position, position + 1 AS n, name AS last_name FROM n WHERE position >= 5")
def live_updates(spark, sf_dir):
    """Every state of a live projection after the fifth event, one for each event, as updates() gives them."""
    log, rows = EventLog(spark, scratch(spark)), nations(spark, sf_dir)
    send = lambda r: log.append("region", str(r.n_regionkey), [as_event(Joined(r.n_nationkey, r.n_name))])
    for r in rows[:5]:
        send(r)
    live = LiveProjection(log, Members).start("10 milliseconds")
    first, later = live.updates()
    for r in rows[5:]:
        send(r)
    live.wait_for(log.token(), 60)
    live.stop()
    out = [(at, len(s.names), s.names[-1]) for at, s in later]
    return told(spark, out if len(first.names) == 5 else [], "position long, n long, last_name string")
