"""Rate limits over the event table."""

from passim.operators.requests import token_bucket, two_level_bucket
from passim.operators.runs import token_bucket_by_runs
from passim.registry import query
from passim.registry import tables as t
from passim.registry.tables import with_tables

# The given users send an event every few hours, so the published limits would
# refuse nothing; these refuse some.
RATE, BURST = 1 / 36000, 3.0
COARSE_RATE, COARSE_BURST = 1 / 1800, 20.0


def _bucket_sql(source: str, key: str, rate: str, burst: str) -> str:
    """State after each event of a key, one step of the recursion per event."""
    return f"""
with recursive numbered as (
  select event_id, {key} as k, epoch_us(ts) / 1000000::double as s,
         row_number() over (partition by {key} order by ts, event_id) as n from {source}),
run as (
  select k, n, event_id, s, {burst}::double - 1 as tokens, true as admitted from numbered where n = 1
  union all
  select x.k, x.n, x.event_id, x.s, if(x.u >= 1, x.u - 1, x.u), x.u >= 1
  from (select e.k, e.n, e.event_id, e.s, least({burst}::double, r.tokens + (e.s - r.s) * {rate}) as u
        from run r join numbered e on e.k = r.k and e.n = r.n + 1) x)
select event_id, admitted from run"""


_CLIENT = "(1::double / 36000)"
_COARSE = "(1::double / 1800)"
t.SQL["limited"] = _bucket_sql("events", "user_id", _CLIENT, "3")
t.SQL["coarse"] = _bucket_sql("events", "event_type", _COARSE, "20")
t.SQL["through"] = "select e.* from events e join «coarse» c using (event_id) where c.admitted"
t.SQL["fine"] = _bucket_sql("«through»", "user_id", _CLIENT, "3")

LIMITED_SQL = with_tables("limited") + "select event_id, user_id, admitted from limited join events using (event_id)"


def events(spark, folder):
    return t.table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")


@query("token_bucket", LIMITED_SQL)
def limit_users(spark, folder):
    return token_bucket(events(spark, folder), "user_id", RATE, BURST).select("event_id", "user_id", "admitted")


# In whole units: 36,000,000,000 to a token, one a microsecond, three tokens at most.
t.SQL["limited_exactly"] = """
with recursive numbered as (
  select event_id, user_id as k, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
run as (
  select k, n, event_id, us, 108000000000 - 36000000000 as units, true as admitted from numbered where n = 1
  union all
  select x.k, x.n, x.event_id, x.us, if(x.u >= 36000000000, x.u - 36000000000, x.u), x.u >= 36000000000
  from (select e.k, e.n, e.event_id, e.us, least(108000000000, r.units + (e.us - r.us)) as u
        from run r join numbered e on e.k = r.k and e.n = r.n + 1) x)
select event_id, admitted from run"""


@query("token_bucket_by_runs", with_tables("limited_exactly") + "select event_id, user_id, admitted from limited_exactly join events using (event_id)")
def limit_users_by_runs(spark, folder):
    return token_bucket_by_runs(events(spark, folder), "user_id", RATE, BURST).select("event_id", "user_id", "admitted")


@query(
    "two_level_bucket",
    with_tables("coarse", "fine")
    + """select c.event_id, c.admitted and coalesce(f.admitted, false) as admitted
         from coarse c left join fine f using (event_id)""",
)
def limit_types_then_users(spark, folder):
    """One coarse bucket per event type, then one bucket per user."""
    rows = two_level_bucket(
        events(spark, folder), "event_type", "user_id", COARSE_RATE, COARSE_BURST, RATE, BURST
    )
    return rows.select("event_id", "admitted")
