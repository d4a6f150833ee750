"""Text, identifiers and clock expressions."""
import re

from pyspark.sql import Column, functions as F

from highwater.functions.geometry import col
from highwater.settings import FLOOD_DETOUR_MINUTES, PEAK_EXTRA_MINUTES, PEAK_HOURS, SEARCH_DEFAULT_MINUTES, \
    SEARCH_MINUTES, SEED, TEXT, TIME_ZONE, WALK_DETOUR, WALK_M_PER_MIN


def fill(name: str, /, **parts) -> Column:
    """One of the fixed texts with columns in place of its {fields}; null when a field is null."""
    out = []
    for i, piece in enumerate(re.split(r"[{}]", TEXT[name])):
        if piece:
            out.append(F.lit(piece) if i % 2 == 0 else col(parts[piece]))
    return F.concat(*out)


def is_tagged(tags) -> Column:
    """True when any element of a tag list is present and not "no"."""
    return F.coalesce(F.exists(col(tags), lambda t: F.coalesce(t != "no", F.lit(False))), F.lit(False))


def join_tags(tags) -> Column:
    return F.when(col(tags).isNotNull(), F.array_join(col(tags), ";"))


def edge_id(u, v, key) -> Column:
    return F.concat_ws("_", col(u).cast("string"), col(v).cast("string"), col(key).cast("string"))


def stable_id(prefix: str, text, n: int) -> Column:
    """A short id that stays the same for the same text."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(col(text).cast("binary")), 1, n))


def run_id(ts, scenario) -> Column:
    return F.concat(F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm'Z'"), F.lit("-"), col(scenario))


def hash_fraction_bits(text) -> Column:
    """First eight hex digits of sha-256 as a number."""
    return F.conv(F.substring(F.sha2(col(text).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def held_out(group, seed=SEED) -> Column:
    return hash_fraction_bits(F.concat(F.lit(f"{seed}:"), col(group).cast("string"))) % 5 == 0


def split_name(date, heldout, train_end, validation_end) -> Column:
    d, te, ve = col(date), F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    return (F.when(col(heldout), F.when(d > ve, "unseen_streets_test").otherwise("unused"))
            .when(d <= te, "train").when(d <= ve, "validation").otherwise("future_test"))


def from_epoch_ms(ms) -> Column:
    return F.timestamp_millis(col(ms))


def from_epoch_s(s) -> Column:
    """Null or 0 means unknown."""
    return F.timestamp_seconds(F.when(col(s) != 0, col(s)))


def local_date(ts, zone=TIME_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def local_day(date, zone=TIME_ZONE) -> tuple[Column, Column]:
    """UTC start and end of a local calendar day (23, 24 or 25 hours)."""
    d = col(date)
    return (F.to_utc_timestamp(d.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(d, 1).cast("timestamp"), zone))


def local_iso(date, zone=TIME_ZONE) -> Column:
    """Local midnight with its UTC offset, e.g. 2026-03-08T00:00:00-05:00."""
    start = local_day(date, zone)[0]
    offset = F.timestamp_diff("MINUTE", start, F.from_utc_timestamp(start, zone))
    size = F.abs(offset)
    return F.concat(F.date_format(col(date), "yyyy-MM-dd'T'00:00:00"), F.when(offset < 0, "-").otherwise("+"),
                    F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((size % 60).cast("string"), 2, "0"))


def iso_utc(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock(ts, zone=TIME_ZONE) -> Column:
    """8:25 AM, local."""
    return F.date_format(F.from_utc_timestamp(col(ts), zone), "h:mm a")


def distance_text(m) -> Column:
    """Whole metres, or kilometres to one decimal rounded on the exact value of the double m / 1000.

    Java's formatter rounds the printed digits instead, which differs when they end in 5; so that case compares the
    double's exact bits (times 2^52, an integer) with the true quotient.
    """
    m = F.bround(col(m), 0).cast("bigint")
    tenth, rest = F.floor(m / 100).cast("bigint"), m % 100
    exact = (m / 1000.0 * F.lit(2.0**52)).cast("bigint").cast("decimal(20,0)") * F.lit(1000).cast("decimal(5,0)")
    true = m.cast("decimal(12,0)") * F.lit(2**52).cast("decimal(17,0)")
    up = (rest > 50) | ((rest == 50) & ((exact > true) | ((exact == true) & (tenth % 2 == 1))))
    k = tenth + up.cast("int")
    km = F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(" km"))
    return F.when(m >= 1000, km).otherwise(F.concat(m.cast("string"), F.lit(" m")))


def number_text(x) -> Column:
    """Up to one decimal, none when whole."""
    r = F.bround(col(x), 1)
    return F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(r.cast("string"))


def extra_text(minutes) -> Column:
    return F.when(col(minutes) > 0, fill("extra", min=number_text(minutes))).otherwise(fill("no_extra"))


def walk_minutes(dist_m) -> Column:
    return F.bround(col(dist_m) * WALK_DETOUR / WALK_M_PER_MIN, 0).cast("bigint")


def search_minutes(lot_type, arrive, zone=TIME_ZONE) -> Column:
    """Minutes from reaching a lot to being parked; more on weekday mornings, local time."""
    base = F.lit(SEARCH_DEFAULT_MINUTES)
    for name, minutes in SEARCH_MINUTES.items():
        base = F.when(col(lot_type) == name, minutes).otherwise(base)
    local = F.from_utc_timestamp(col(arrive), zone)
    hour = F.hour(local) + F.minute(local) / 60.0
    peak = (F.weekday(local) < 5) & (hour >= PEAK_HOURS[0]) & (hour < PEAK_HOURS[1])
    return base + F.when(peak, PEAK_EXTRA_MINUTES).otherwise(0.0)


def minus_minutes(ts, minutes) -> Column:
    return F.timestamp_micros(F.unix_micros(col(ts)) - F.bround(col(minutes) * 60e6, 0).cast("bigint"))


def leave_by(start, buffer_min, walk_min, search_min, drive_s) -> Column:
    """Latest departure, rounded down to the minute."""
    return F.date_trunc("minute", minus_minutes(start, col(buffer_min) + col(walk_min) + col(search_min)
                                                + col(drive_s) / 60.0))


def recommend(compromised, same_route, usual_m, safe_m, extra_min, avoided_m, street,
              compromised_m=200.0) -> tuple[Column, Column]:
    """(action, message) for a pair of routes."""
    extra = extra_text(extra_min)
    reroute = col(safe_m) < compromised_m
    action = (F.when(~col(compromised), "safe").when(col(same_route), "no_alternative")
              .when(reroute, "reroute").otherwise("reroute_caution"))
    where = F.coalesce(fill("on_street", street=street), fill("on_route"))
    message = (F.when(action == "safe", fill("safe")).when(action == "no_alternative", fill("no_alternative", m=distance_text(usual_m)))
               .when(action == "reroute", fill("reroute", where=where, extra=extra))
               .otherwise(fill("reroute_caution", avoided=distance_text(avoided_m), m=distance_text(safe_m), extra=extra)))
    return action, message


def time_saved(compromised, avoided_m, usual_m, extra_min) -> Column:
    share = F.when(col(usual_m) != 0, col(avoided_m) / col(usual_m)).otherwise(0.0)
    return F.when(col(compromised), F.greatest(F.lit(0.0), FLOOD_DETOUR_MINUTES * share - col(extra_min))).otherwise(0.0)


def traffic_delay(traffic_s, free_s, incident_s) -> Column:
    """Delay is the larger of the incident delay and the time lost to congestion, never negative."""
    return F.greatest(F.coalesce(col(incident_s), F.lit(0.0)), col(traffic_s) - F.coalesce(col(free_s), col(traffic_s)),
                      F.lit(0.0))
