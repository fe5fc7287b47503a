"""Per-period aggregates by event time, corrected as late rows arrive, with a cut-off. SQL only.

Rows arrive in order of (received_at, delivery_id). The watermark before a row is the greatest
occurred_at of all rows before it, over all tenants. A row more than ``lateness`` behind it is late:
it corrects its period, or is dropped if it is more than ``cutoff`` behind.

The watermark is found without one sorted task: rows fall into arrival slots, which are aggregated to their
greatest occurred_at; these maxima are accumulated level by level (months; the minutes of a month, the seconds of
a minute, the milliseconds of a second, the microseconds of a millisecond, then delivery ids by 16 bits at a time),
each window within one slot of the level above, so that none holds more than 65,536 slots (of months there are
twelve a year). Slots are minutes, and finer, down to blocks of 65,536 delivery ids in one microsecond, only if some
slot would hold more than ``HOT_ROWS`` rows. Only then rows are ordered, within their slot.

Aggregates form a triangle of event period by arrival period: each cell is summed, and windows
accumulate the cells of an event period across arrivals, so every revision it ever had comes out.

Defined results: a null occurred_at is never late, moves no watermark and belongs to no period, so
it is in no cell; a null received_at sorts before all; null event types and tenants are groups of
their own; a null or NaN value, and one of 1e20 or more in size (infinities too), counts as a row and adds 0; ties in received_at go by delivery_id;
equal rows each count; an empty table gives no rows; columns named watermark and fate are replaced, other extra columns pass through. Each delivery counts (see message_store for
collapsing deliveries first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftline import scratch

LATENESS = "INTERVAL 30 SECONDS"
CUTOFF = "INTERVAL 2 DAYS"
#: Slots are made finer while one holds more rows than this.
HOT_ROWS = 1_000_000

_US = "unix_micros(received_at)"
_ID = "coalesce(delivery_id, -9223372036854775808)"
#: Levels of arrival, from coarse to fine: each slot lies in one of the level before, which has at most 65,536 of it.
LEVELS = (
    "year(received_at) * 12L + month(received_at)",
    f"({_US} - pmod({_US}, 60000000)) div 60000000",
    f"({_US} - pmod({_US}, 1000000)) div 1000000",
    f"({_US} - pmod({_US}, 1000)) div 1000",
    _US,
    f"shiftright({_ID}, 48)",
    f"shiftright({_ID}, 32)",
    f"shiftright({_ID}, 16)",
)
#: Up to here a slot's number alone says which it is, and in which coarser ones it lies; beyond, within its microsecond.
MINUTE, MICROSECOND = 1, 4


def _slots(events: DataFrame, level: int) -> DataFrame:
    """Rows and greatest occurred_at of each slot of ``level``: p0 ... p<level>, n, top."""
    path = ", ".join(f"{LEVELS[i]} AS p{i}" for i in range(level + 1))
    return events.sparkSession.sql(f"SELECT {path}, count(*) AS n, max(occurred_at) AS top FROM {{e}} GROUP BY ALL", e=events)


def _before(slots: DataFrame, level: int) -> DataFrame:
    """p0 ... p<level>, ``before``: the greatest occurred_at of all slots before each."""
    spark, out = slots.sparkSession, None
    for k in range(level + 1):
        path, above = ", ".join(f"p{i}" for i in range(k + 1)), ", ".join(f"p{i}" for i in range(k))
        inside = f"max(top) OVER ({f'PARTITION BY {above}' if k else ''} ORDER BY p{k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        here = spark.sql(f"SELECT {path}, {inside} AS inside FROM (SELECT {path}, max(top) AS top FROM {{s}} GROUP BY ALL)", s=slots)
        if out is None:
            out = here.withColumnRenamed("inside", "before")
        else:
            same = " AND ".join(f"h.p{i} <=> b.p{i}" for i in range(k))
            out = spark.sql(f"SELECT {', '.join(f'h.p{i}' for i in range(k + 1))}, greatest(b.before, h.inside) AS before FROM {{h}} h JOIN {{b}} b ON {same}", h=here, b=out)
    return out


def classify(events: DataFrame, hot_rows: int = HOT_ROWS, floor: str | None = None) -> DataFrame:
    """Events with ``watermark`` (before the row) and ``fate``: on_time, corrects or dropped.

    ``floor`` (yyyy-mm-dd hh:mm:ss.ffffff, UTC) is the watermark reached before all these rows, by earlier batches.
    """
    spark, level = events.sparkSession, MINUTE
    events = events.drop("watermark", "fate")
    start = f"CAST('{floor}' AS TIMESTAMP)" if floor else "CAST(NULL AS TIMESTAMP)"
    while True:
        slots = scratch.table(_slots(events, level), "arrival-slots")
        if level == len(LEVELS) - 1 or not slots.where(f"n > {hot_rows}").limit(1).count():
            break
        scratch.drop(slots)
        level += 1
    # What tells a row's slot: its time, and beyond the microsecond its block of delivery ids.
    keys = [min(level, MICROSECOND), *([level] if level > MICROSECOND else [])]
    own = ", ".join(f"{LEVELS[k]} AS __p{k}" for k in keys)
    same = " AND ".join(f"e.__p{k} <=> b.p{k}" for k in keys)
    slot = ", ".join(f"e.__p{k}" for k in keys)
    return spark.sql(f"""
        WITH marked AS (
            SELECT e.*, greatest({start}, b.before, max(e.occurred_at) OVER (PARTITION BY {slot} ORDER BY e.received_at, e.delivery_id
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS watermark
            FROM (SELECT *, {own} FROM {{events}}) e JOIN {{before}} b ON {same}
        )
        SELECT * EXCEPT ({", ".join(f"__p{k}" for k in keys)}),
               CASE WHEN occurred_at < watermark - {CUTOFF} THEN 'dropped'
                    WHEN occurred_at < watermark - {LATENESS} THEN 'corrects' ELSE 'on_time' END AS fate
        FROM marked""", events=events, before=_before(slots, level))


def late_rows(classified: DataFrame) -> DataFrame:
    """delivery_id and fate of each late row."""
    return classified.sparkSession.sql("SELECT delivery_id, fate FROM {c} WHERE fate <> 'on_time'", c=classified)


def revisions(classified: DataFrame, period: str = "HOUR", arrival: str = "HOUR") -> DataFrame:
    """The triangle: every revision of every (tenant_id, event_type, event period).

    Columns tenant_id, event_type, period_start, arrival_start, revision (1 is the first),
    event_count and sum_value as of that arrival period, late_count (rows of it that came late), and
    is_final (the last revision). The accumulation never mixes groups, and a group's cells are bounded
    by its arrival periods within the cut-off, not by its rows.
    """
    return classified.sparkSession.sql(f"""
        WITH cells AS (
            SELECT tenant_id, event_type, date_trunc('{period}', occurred_at) AS period_start,
                   date_trunc('{arrival}', received_at) AS arrival_start,
                   count(*) AS n, count_if(fate = 'corrects') AS n_late,
                   sum(CAST(CASE WHEN NOT isnan(value) AND abs(value) < 1e20 THEN value END AS decimal(28, 4))) AS v
            FROM {{c}} WHERE fate <> 'dropped' AND occurred_at IS NOT NULL
            GROUP BY ALL
        )
        SELECT tenant_id, event_type, period_start, arrival_start,
               row_number() OVER seen AS revision,
               sum(n) OVER seen AS event_count,
               CAST(coalesce(sum(v) OVER seen, 0) AS double) AS sum_value,
               sum(n_late) OVER seen AS late_count,
               lead(arrival_start) OVER (PARTITION BY tenant_id, event_type, period_start ORDER BY arrival_start) IS NULL AS is_final
        FROM cells
        WINDOW seen AS (PARTITION BY tenant_id, event_type, period_start ORDER BY arrival_start
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", c=classified)
