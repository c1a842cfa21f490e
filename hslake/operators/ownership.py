"""Process and socket ownership of connections: lifetimes that don't overlap after supersession, and a sweep over the events of each socket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hslake.functions.intervals import covering, next_in_key, sweep
from hslake.plans.registry import query
from hslake.sources.shared import discard, stored

def current_lifetimes(lifespans: DataFrame) -> DataFrame:
    """(pid, start_us, from_us, until_us): when a process id surely belongs to each lifetime, the end exclusive.

    From its start, or the last end of an older lifetime of that id, until its end, its last verification or a newer start. Of lifetimes with one
    start the longest counts, from the end of the second longest.
    """
    own = F.when(F.col("ended_us").isNotNull(), F.col("ended_us")).otherwise(F.col("verified_us") + 1)
    ranked = lifespans.select("pid", "start_us", own.alias("own_us")).withColumn("r", F.row_number().over(Window.partitionBy("pid", "start_us").orderBy(F.desc("own_us"))))
    one = ranked.groupBy("pid", "start_us").agg(*[F.max(F.when(F.col("r") == k, F.col("own_us"))).alias(n) for k, n in ((1, "own_us"), (2, "second_us"))])
    known = sweep(one, ["pid"], "start_us", [], {}, {}, ["start_us"], {"older_us": F.col("own_us")}, 86_400_000_000)
    return known.select("pid", "start_us", F.greatest("start_us", "second_us", "older_us").alias("from_us"), F.least("own_us", "next.start_us").alias("until_us")).where("from_us < until_us")


def owned(rows: DataFrame, lifespans: DataFrame, first: str, last: str, *, pid: str = "pid") -> DataFrame:
    """(id, start_us) of the rows (id, pid, first, last) whose interval lies within one lifetime of the pid and overlaps no other, nor comes after a newer start.

    The stretches of ``current_lifetimes`` don't overlap, so each row meets at most one.
    """
    return within(rows, current_lifetimes(lifespans), first, last, pid=pid)


def within(rows: DataFrame, lifetimes: DataFrame, first: str, last: str, *, pid: str = "pid") -> DataFrame:
    """``owned`` for stretches of ``current_lifetimes`` that are at hand."""
    asked = rows.select("id", F.col(pid).alias("pid"), F.col(first).alias("_f"), F.col(last).alias("_l"))
    return covering(asked, lifetimes, ["pid"], "_f", "from_us", "until_us").where("_l < until_us").select("id", "start_us")


LOOKUP = """select {id} as id, case when count(l.pid) filter (where l.start_us <= {last} and coalesce(l.ended_us, l.verified_us) >= {first} and (l.ended_us is null or l.ended_us > {first})) = 1
   and count(l.pid) filter (where l.start_us <= {first} and coalesce(l.ended_us, l.verified_us) >= {last} and (l.ended_us is null or {last} < l.ended_us)) = 1
   and max(l.start_us) filter (where l.start_us <= {last}) = max(l.start_us) filter (where l.start_us <= {first} and coalesce(l.ended_us, l.verified_us) >= {last} and (l.ended_us is null or {last} < l.ended_us))
 then max(l.start_us) filter (where l.start_us <= {first} and coalesce(l.ended_us, l.verified_us) >= {last} and (l.ended_us is null or {last} < l.ended_us)) end as start_us
 from {rows} left join lifespans l on l.pid = {pid} group by 1"""


@query("process_lifetime", "select id as flow_id, start_us, start_us is null as ambiguous from (" + LOOKUP.format(id="c.flow_id", first="c.first_us", last="c.last_us", pid="c.source_pid", rows="(select * from connections where source_pid is not null) c") + ") x")
def process_lifetime(j):
    c = j.connections.where("source_pid is not null").select(F.col("flow_id").alias("id"), F.col("source_pid").alias("pid"), "first_us", "last_us")
    found = owned(c, j.lifespans, "first_us", "last_us")
    return c.select("id").join(found, "id", "left").select(F.col("id").alias("flow_id"), "start_us", F.col("start_us").isNull().alias("ambiguous"))


@query("lifetime_supersession", "select l.pid, l.start_us, min(n.start_us) as superseded_us from lifespans l left join lifespans n on n.pid = l.pid and n.start_us > l.start_us group by l.pid, l.start_us, l.ended_us")
def lifetime_supersession(j):
    return next_in_key(j.lifespans, ["pid"], "start_us", "superseded_us").select("pid", "start_us", "superseded_us")


SOCKET = ["source_address", "source_port"]


def socket_history(events: DataFrame) -> DataFrame:
    """Socket events with, for an open, the time of its close, and for a close whether it has its open.

    A close belongs to the only open of its endpoint, process and socket id that is pending; once two are pending, closes of that socket are unmatched.
    """
    w = Window.partitionBy(*SOCKET, "pid", "socket_id").orderBy("at_us", F.desc("kind"), "seq")
    seen = events.withColumn("_prior", F.lag("kind").over(w)).withColumn("_double", F.coalesce(((F.col("kind") == "open") & (F.col("_prior") == "open")).cast("int"), F.lit(0)))
    seen = seen.withColumn("_broken", F.max("_double").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("matched", (F.col("kind") == "close") & F.coalesce(F.col("_prior") == "open", F.lit(False)) & (F.col("_broken") == 0))
    ended = F.when((F.col("kind") == "open") & F.lead("matched").over(w), F.lead("at_us").over(w))
    return seen.withColumn("ended_us", ended).drop("_prior", "_double", "_broken")


#: Observations by which one more round is made, and the most rounds.
ROUND_ROWS, MOST_ROUNDS = 1_000_000, 12


def socket_owners(observations: DataFrame, events: DataFrame, lifespans: DataFrame, round_rows: int = ROUND_ROWS) -> DataFrame:
    """(id, pid, start_us) of observations (id, source_address, source_port, first_us, last_us) with one owner.

    Owner is the only socket open at any time of the observation; no close may fall into it, nor an unmatched close between the open and its end.
    A sweep over an endpoint's events tells how many sockets are open after each and, by a sum of their numbers, which one if it is one. Between two events nothing
    changes, so these stretches don't overlap and each observation meets the one that it begins in; what it may hold besides is one open. Sockets have nothing to do with
    each other: many observations are taken in rounds, each over its share of the sockets, and only one round's tables lie on disk at a time.
    """
    rounds = min(MOST_ROUNDS, 1 + observations.count() // round_rows)
    share = lambda df, k: df.where(F.pmod(F.hash(*SOCKET), F.lit(rounds)) == k)
    lifetimes, out = stored(current_lifetimes(lifespans), "lifetimes"), []
    for k in range(rounds):
        out.append(_owners(share(observations, k), share(events, k), lifetimes))
    return reduce(DataFrame.union, out)


def _owners(observations: DataFrame, events: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """The owners of one round, stored; what they were made of goes."""
    history = stored(socket_history(events), "sockets")
    opens = F.col("kind") == "open"
    alive = F.when(opens, 1).when(F.col("matched"), -1).otherwise(0)
    at_open = F.when(opens, F.col("seq")).when(F.col("matched"), -F.lag("seq").over(Window.partitionBy(*SOCKET, "pid", "socket_id").orderBy("at_us", F.desc("kind"), "seq"))).otherwise(0)
    lone = F.when((F.col("kind") == "close") & ~F.col("matched"), F.col("at_us"))
    marked = history.withColumn("_alive", alive).withColumn("_token", at_open)
    swept = sweep(marked, SOCKET, "at_us", ["kind", "seq"], {"depth": F.col("_alive"), "token": F.col("_token")}, {"unmatched_us": lone}, ["at_us", "kind", "seq"])
    swept = stored(swept, "stretches")
    before = swept.groupBy(*SOCKET).agg(F.min(F.struct("at_us", "kind", "seq")).alias("one")).select(*SOCKET, F.lit(0).cast("long").alias("from_us"), F.col("one.at_us").alias("to_us"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("token"), F.lit(None).cast("long").alias("unmatched_us"), F.col("one").alias("next"))
    stretches = swept.select(*SOCKET, F.col("at_us").alias("from_us"), F.col("next.at_us").alias("to_us"), "depth", "token", "unmatched_us", "next")
    # Before the first event nothing is open; the event after the next is the next one's own next.
    seconds = swept.select(*SOCKET, F.col("seq").alias("_seq"), F.col("next.at_us").alias("second_us"))
    spans = before.unionByName(stretches)
    spans = spans.withColumn("_seq", F.col("next.seq")).join(seconds, [*SOCKET, "_seq"], "left").drop("_seq")
    seen = covering(observations.select("id", *SOCKET, "first_us", "last_us"), spans, SOCKET, "first_us", "from_us", "to_us")
    quiet = F.coalesce(F.col("to_us") > F.col("last_us"), F.lit(True))
    single = (F.col("depth") == 1) & quiet
    arriving = (F.col("depth") == 0) & ~quiet & (F.col("next.kind") == "open") & F.coalesce(F.col("second_us") > F.col("last_us"), F.lit(True))
    fine = seen.where(single | arriving)
    chosen = fine.select("id", "first_us", "last_us", *SOCKET, F.when(single, F.col("token")).otherwise(F.col("next.seq")).alias("seq"), "unmatched_us")
    sockets = history.where("kind = 'open'").select(*SOCKET, "seq", "pid", F.col("at_us").alias("open_us"))
    # The stretch doesn't tell of a close at the very begin of the observation.
    found = chosen.join(sockets, [*SOCKET, "seq"]).where("unmatched_us is null or open_us > unmatched_us")
    closing = history.where("kind = 'close'").select(*SOCKET, F.col("at_us").alias("first_us")).distinct()
    found = found.join(closing, [*SOCKET, "first_us"], "left_anti").select("id", "pid", F.least("first_us", "open_us").alias("from_us"), "last_us")
    found = stored(found, "found")
    lives = within(found, lifetimes, "from_us", "last_us")
    owners = stored(found.select("id", "pid").join(lives, "id", "left").select("id", "pid", "start_us"), "owners")
    discard(history, swept, found)
    return owners


HISTORY = """(select *, case when kind = 'open' and lead(matched) over w then lead(at_us) over w end as ended_us from (
  select *, kind = 'close' and prior = 'open' and coalesce(max(case when kind = 'open' and prior = 'open' then 1 else 0 end) over (partition by source_address, source_port, pid, socket_id order by at_us, kind desc, seq), 0) = 0 as matched
  from (select *, lag(kind) over (partition by source_address, source_port, pid, socket_id order by at_us, kind desc, seq) as prior from socket_history) p) m
 window w as (partition by source_address, source_port, pid, socket_id order by at_us, kind desc, seq))"""
SOCKETS = f"""(select c.flow_id, min(h.pid) filter (where live) as pid, min(h.at_us) filter (where live) as open_us, any_value(c.first_us) as first_us, any_value(c.last_us) as last_us
  from connections c join (select *, kind = 'open' as opened from {HISTORY} z) h on h.source_address = c.source_address and h.source_port = c.source_port,
  lateral (select h.opened and h.at_us <= c.last_us and (h.ended_us is null or h.ended_us > c.first_us) as live) v
  group by c.flow_id
  having count(*) filter (where live) = 1 and count(*) filter (where live and (h.ended_us is null or h.ended_us > c.last_us)) = 1 and count(*) filter (where not h.opened and h.at_us between c.first_us and c.last_us) = 0
   and coalesce(max(h.at_us) filter (where not h.opened and not coalesce(h.matched, false) and h.at_us <= c.last_us) < min(h.at_us) filter (where live), true))"""


@query("socket_owner", f"with o as (select *, least(first_us, open_us) as from_us from {SOCKETS} s), l as (" + LOOKUP.format(id="o.flow_id", first="o.from_us", last="o.last_us", pid="o.pid", rows="o") + ") select o.flow_id, o.pid, l.start_us from o join l on l.id = o.flow_id")
def socket_owner(j):
    c = j.connections.select(F.col("flow_id").alias("id"), *SOCKET, "first_us", "last_us")
    return socket_owners(c, j.socket_history, stored(j.lifespans, "lifespans")).withColumnRenamed("id", "flow_id")
