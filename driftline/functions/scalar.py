"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that are masked, in the order in which they are.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PHONE = r"\b\+?[1-9]\d{1,2}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}\b"
CATEGORIES = {"email": EMAIL, "ip_address": IPV4, "phone": PHONE}
REDACTED = "[REDACTED]"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
MIB = 1 << 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains_text(payload, query: str) -> Column:
    """Case-insensitive substring; % and _ in the query stay wildcards."""
    return _c(payload).ilike(f"%{query}%")


def stream_name(tenant) -> Column:
    return F.concat(F.lit("tenant-"), _c(tenant))


def shard_of(tenant, shards: int) -> Column:
    """First eight bytes of the SHA-256 of the tenant, big-endian and unsigned, modulo the number of shards."""
    head = F.conv(F.substring(F.sha2(_c(tenant), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(shards).cast("decimal(20,0)")).cast("int")


def shard_name(database: str, shard) -> Column:
    return F.concat(F.lit(f"{database}_shard"), _c(shard))


def pii_categories(text, wanted: list[str] | None = None) -> Column:
    """Categories found in the raw text, in fixed order."""
    hits = [F.when(_c(text).rlike(p), F.lit(k)) for k, p in CATEGORIES.items() if wanted is None or k in wanted]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def contains_pii(text) -> Column:
    out = F.lit(False)
    for p in CATEGORIES.values():
        out = out | _c(text).rlike(p)
    return out


def mask_pii(text, wanted: list[str] | None = None) -> Column:
    """Cascade: each pattern sees what the one before left."""
    out = _c(text)
    for k, p in CATEGORIES.items():
        if wanted is None or k in wanted:
            out = F.regexp_replace(out, p, REDACTED)
    return out


def masked_categories(text) -> Column:
    """Categories that masking reports: found in the partly masked text."""
    hits, t = [], _c(text)
    for k, p in CATEGORIES.items():
        hits.append(F.when(t.rlike(p), F.lit(k)))
        t = F.regexp_replace(t, p, REDACTED)
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def is_masked(text) -> Column:
    return _c(text).contains(REDACTED)


def key_prefix(key) -> Column:
    return F.substring(_c(key), 1, 16)


def key_hash(key) -> Column:
    return F.unhex(F.sha2(_c(key), 256))


def fingerprint(method, path, body) -> Column:
    return F.sha2(F.concat_ws("\n", _c(method), _c(path), F.coalesce(_c(body), F.lit(""))), 256)


def namespaced_key(tenant, key) -> Column:
    """Idempotency keys live per tenant; without a tenant in a space of their own."""
    return F.when(_c(tenant).isNotNull() & (_c(tenant) != ""), F.concat(F.lit("t:"), _c(tenant), F.lit(":"), _c(key))).otherwise(F.concat(F.lit("k:"), _c(key)))


def parse_window_key(key) -> Column:
    """Struct (duration, tenant_id, event_type, window_start, is_late) of window:<duration>:<tenant>:<type>:<unix|late>, null if malformed."""
    p = F.split(_c(key), ":")
    at = F.try_element_at(p, F.lit(5)).try_cast("long")
    late = F.try_element_at(p, F.lit(5)) == "late"
    ok = (F.size(p) == 5) & (F.element_at(p, 1) == "window") & (late | at.isNotNull())
    part = lambda i: F.try_element_at(p, F.lit(i))
    return F.when(ok, F.struct(part(2).alias("duration"), part(3).alias("tenant_id"), part(4).alias("event_type"),
                               F.timestamp_seconds(at).alias("window_start"), late.alias("is_late")))


def truncate_to(ts, seconds: int) -> Column:
    """Truncate to a multiple of a duration counted from the year 1."""
    shift = (-62135596800) % seconds
    s = F.unix_seconds(_c(ts))
    return F.timestamp_seconds(s - F.pmod(s - F.lit(shift), F.lit(seconds)))


def duration_label(seconds: int) -> str:
    """1m and 1h by name, others as hours, minutes and seconds."""
    if seconds == 60:
        return "1m"
    if seconds == 3600:
        return "1h"
    h, rest = divmod(seconds, 3600)
    m, s = divmod(rest, 60)
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"


def month_partition(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMM")


def from_nanos(ns) -> Column:
    ns = _c(ns)
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def iso_date(text) -> Column:
    """Strict yyyy-MM-dd in UTC, null otherwise."""
    return F.when(_c(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), _c(text).try_cast("date"))


def rfc3339(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ulid_time(ulid) -> Column:
    """Time of a ULID from its first ten characters."""
    ms = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0).cast("long"),
                     lambda acc, i: acc * 32 + F.instr(F.lit(CROCKFORD), F.upper(F.substring(_c(ulid), i, F.lit(1)))) - 1)
    return F.timestamp_millis(ms)


def backoff_ms(attempt, base_ms: int, cap_ms: int) -> Column:
    """Capped exponential: base * 2^(attempt-1)."""
    return F.least(F.lit(cap_ms).cast("double"), base_ms * F.pow(F.lit(2.0), _c(attempt) - 1)).cast("long")


def lag_status(lag_bytes) -> Column:
    x = _c(lag_bytes)
    return F.when(x == 0, "caught_up").when(x < MIB, "healthy").when(x < 10 * MIB, "lagging").otherwise("critical")


def lag_bytes(primary, replay) -> Column:
    return F.greatest(F.lit(0), _c(primary) - _c(replay))


def retry_after(seconds) -> Column:
    return F.greatest(F.ceil(_c(seconds)), F.lit(1))


def default_payload(payload) -> Column:
    return F.coalesce(F.nullif(_c(payload), F.lit("")), F.lit("{}"))


def clamp_skew(client_time, now) -> Column:
    """Client time if it is less than a day old and less than an hour ahead (both strict), else now."""
    age = F.unix_micros(_c(now)) - F.unix_micros(_c(client_time))
    return F.when((age > -3_600_000_000) & (age < 86_400_000_000), _c(client_time)).otherwise(_c(now))


def merge_maps(*maps) -> Column:
    """Later maps win, key by key."""
    out = _c(maps[0])
    for m in maps[1:]:
        m = _c(m)
        out = F.map_concat(_without_keys_of(out, m), m)
    return out


def _without_keys_of(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))


def faster_ratio(a, b) -> Column:
    """Ratio of two durations, null when the divisor is 0."""
    return F.try_divide(_c(a), _c(b))


def times_faster(a, b) -> Column:
    """The greater of two durations over the lesser; null when that is 0."""
    return F.try_divide(F.greatest(_c(a), _c(b)), F.least(_c(a), _c(b)))


def faster_label(a, b) -> Column:
    """Whether the second of two durations is the shorter, as expected."""
    return F.when(_c(a) > _c(b), "faster").otherwise("slower")


def url_safe_secret(random_bytes) -> Column:
    return F.translate(F.regexp_replace(F.base64(_c(random_bytes)), "=", ""), "+/", "-_")


def limit_or(n: int | None, default: int, most: int) -> int:
    """A limit out of range takes the default, not the maximum."""
    return n if n is not None and 1 <= n <= most else default
