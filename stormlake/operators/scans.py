"""Catalogue of scans: sequences, as-of lookups, neighbours in time, eviction and quota.

Tables: scans(site, ts_us, event_id, size), ts_us in microseconds since 1970.
Ties in time are broken by event_id everywhere, so that results are unique.
"""

from __future__ import annotations

from stormlake.functions.constants import MOSAIC_SKEW_S, PRIOR_MAX_AGE_S, SEQUENCE_GAP_S, STORM_MOTION_AGE_S


def sequences(gap_s: int = SEQUENCE_GAP_S) -> str:
    """Runs of a site's scans with no gap above ``gap_s``: gaps and islands."""
    return f"""
    WITH marked AS (SELECT site, ts_us, event_id,
        CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY site ORDER BY ts_us, event_id) <= {gap_s * 1_000_000} THEN 0 ELSE 1 END AS new FROM {{scans}}),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM marked)
    SELECT site, cast(seq AS bigint) AS seq, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_scans FROM numbered GROUP BY site, seq"""


def newest_per_site() -> str:
    """Newest scan of each site."""
    return "SELECT site, max(ts_us) AS ts_us, max_by(event_id, {pair:ts_us:event_id}) AS event_id, count(*) AS n_scans FROM {scans} GROUP BY site"


def last_before(events: str, requests: str, key: str) -> str:
    """For each request the last event of its key and day at or before it, else the last one of the day before.

    events: (key, at_us, id) and requests: (key, at_us, req_id) as SQL. Both are sorted together within a key's day; a running
    count of events numbers stretches that begin with an event, so the join needs neither a range condition nor a product.
    """
    day = "cast(floor(at_us / 86400e6) AS bigint)"
    return f"""
    WITH happened AS (SELECT {key}, {day} AS day, at_us, id FROM ({events}) e),
    together AS (SELECT {key}, day, at_us, 0 AS asks, id, at_us AS event_us, cast(NULL AS bigint) AS req_id FROM happened
        UNION ALL SELECT {key}, {day} AS day, at_us, 1 AS asks, cast(NULL AS bigint) AS id, cast(NULL AS bigint) AS event_us, req_id FROM ({requests}) r),
    numbered AS (SELECT *, count(id) OVER (PARTITION BY {key}, day ORDER BY at_us, asks, id ROWS UNBOUNDED PRECEDING) AS stretch FROM together),
    found AS (SELECT req_id, asks, {key}, day, max(event_us) OVER (PARTITION BY {key}, day, stretch) AS event_us, max(id) OVER (PARTITION BY {key}, day, stretch) AS id FROM numbered),
    ranked AS (SELECT {key}, day, at_us, id, row_number() OVER (PARTITION BY {key}, day ORDER BY at_us DESC, id DESC) AS k FROM happened)
    SELECT f.req_id, coalesce(f.event_us, n.at_us) AS event_us, coalesce(f.id, n.id) AS id FROM found f LEFT JOIN (SELECT {key}, day, at_us, id FROM ranked WHERE k = 1) n ON n.{key} = f.{key} AND n.day = f.day - 1
    WHERE f.asks = 1 AND coalesce(f.id, n.id) IS NOT NULL"""


def scan_at() -> str:
    """For each request (req_id, site, at_us) the newest scan at or before it, of the same day or the one before."""
    text = last_before("SELECT site, ts_us AS at_us, event_id AS id FROM {scans}", "SELECT site, at_us, req_id FROM {requests}", "site")
    return f"SELECT req_id, event_us AS ts_us, id AS event_id FROM ({text}) q"


def scans_between(start_us: int, end_us: int) -> str:
    """Scans of a closed range, in order of site and time."""
    return f"SELECT site, ts_us, event_id FROM {{scans}} WHERE ts_us BETWEEN {start_us} AND {end_us} ORDER BY site, ts_us, event_id"


def prior_scans(max_age_s: int = PRIOR_MAX_AGE_S) -> str:
    """Each scan's latest earlier scan of its site if that is at most ``max_age_s`` older."""
    return f"""
    WITH instants AS (SELECT site, ts_us, max(event_id) AS id FROM {{scans}} GROUP BY site, ts_us),
    before AS (SELECT site, ts_us, lag(ts_us) OVER (PARTITION BY site ORDER BY ts_us) AS prior_us, lag(id) OVER (PARTITION BY site ORDER BY ts_us) AS prior_id FROM instants)
    SELECT s.event_id, b.prior_id, s.ts_us - b.prior_us AS age_us FROM {{scans}} s JOIN before b ON b.site = s.site AND b.ts_us = s.ts_us WHERE s.ts_us - b.prior_us <= {max_age_s * 1_000_000}"""


def mosaic_partners(skew_s: int = MOSAIC_SKEW_S, repeated: bool = True, parts: int | None = None, also: tuple[str, ...] = ()) -> str:
    """For each scan the scan of every other site nearest in time, at most ``skew_s`` away; the earlier one wins ties.

    Scans are dealt once, by buckets of the skew's width. There a scan takes a row for each site that has scans in its bucket or one beside it, and sees of that site the
    last before and the first after it by two windows over its own bucket, and of the buckets on either side only the last or first scan: rows grow with the result, however
    many scans a bucket holds, and none of them is shuffled. Both windows begin at the partition's start, as Spark works out those that reach its end anew for every row.

    repeated: whether scans may share an event_id; they have one result then, so rows are dealt a second time, by it, one for each id, bucket and site. parts: tasks that buckets are dealt to. also: b, the
    bucket, if rows are to be put together where they are, which needs ids that don't repeat.
    """
    width = skew_s * 1_000_000
    by_bucket = f"REPARTITION({parts}, b)" if parts else "REPARTITION(b)"
    held = lambda sign: f"struct(ts_us, {sign}event_id AS id)"
    seen = ", ".join(f"struct(abs({x}.ts_us - ts_us) AS away, {x}.ts_us AS ts_us, {sign}{x}.id AS id)" for x, sign in (("before", "-"), ("after", ""), ("last", "-"), ("first", "")))
    in_place = "SELECT /*+ REPARTITION(event_id) */ event_id, other_site, min(struct(away, other_us, other_id, offset_us)) AS c FROM met GROUP BY b, event_id, other_site"
    one_each = f"SELECT event_id, other_site, c.other_id, c.offset_us FROM (SELECT event_id, other_site, min(c) AS c FROM ({in_place}) q GROUP BY event_id, other_site) r"
    return f"""
    WITH buckets AS (SELECT site, ts_us, event_id, cast(floor(ts_us / {width}e0) AS bigint) AS b FROM {{scans}} WHERE site IS NOT NULL AND ts_us IS NOT NULL),
    dealt AS (SELECT /*+ {by_bucket} */ site, ts_us, event_id, b FROM buckets),
    ends AS (SELECT site AS other_site, b, max({held("-")}) AS last, min({held("")}) AS first FROM buckets GROUP BY site, b),
    steps AS (SELECT other_site, b, last, first, {{explode:array(-1, 0, 1)}} AS step FROM ends),
    moved AS (SELECT /*+ {by_bucket} */ other_site, b + step AS b, CASE WHEN step = 1 THEN last END AS last, CASE WHEN step = -1 THEN first END AS first FROM steps),
    beside AS (SELECT other_site, b, max(last) AS last, max(first) AS first FROM moved GROUP BY other_site, b),
    looking AS (SELECT s.event_id, s.ts_us, s.b, e.other_site, e.last, e.first, s.site = e.other_site AS own FROM dealt s JOIN beside e ON e.b = s.b),
    within AS (SELECT *, max(CASE WHEN own THEN {held("-")} END) OVER (PARTITION BY b, other_site ORDER BY ts_us) AS before, min(CASE WHEN own THEN {held("")} END) OVER (PARTITION BY b, other_site ORDER BY ts_us DESC) AS after FROM looking),
    met AS (SELECT event_id, other_site, c.away, c.ts_us AS other_us, c.id AS other_id, c.ts_us - at_us AS offset_us, b FROM (
        SELECT event_id, other_site, ts_us AS at_us, b, array_min(filter(array({seen}), c -> c.away <= {width})) AS c FROM within WHERE NOT own) q WHERE c IS NOT NULL)
    {one_each if repeated else f"SELECT event_id, other_site, other_id, offset_us{''.join(f', {c}' for c in also)} FROM met"}"""


def _nearest_in_time(name: str, rows: str, key: str, width: int) -> str:
    """Common tables up to ``name`` (event_id, motion_id): for each row of ``rows`` that asks the row nearest in time that has a profile, within ``width``
    and of the same key (columns, each with a comma after it).

    Rows lie in buckets of ``width`` in time. A row sees the last before and the first after it in its own bucket by two windows, and of the buckets on
    either side only the last or first row: no row meets all of an hour. Both windows begin at the partition's start, the second in falling order, as Spark works out
    one that reaches its end anew for every row.
    """
    held = lambda sign: f"struct(ts_us, {sign}event_id AS id)"
    found = ", ".join(f"struct(abs(w.ts_us - {x}.ts_us) AS away, {sign}{x}.id AS id)" for x, sign in (("w.before", "-"), ("w.after", ""), ("e.last", "-"), ("e.first", "")))
    return f"""
    {name}_ends AS (SELECT {key}b, max({held("-")}) AS last, min({held("")}) AS first FROM {rows} WHERE has GROUP BY {key}b),
    {name}_beside AS (SELECT {key}b, max(last) AS last, max(first) AS first FROM (SELECT {key}b + 1 AS b, last, NULL AS first FROM {name}_ends UNION ALL SELECT {key}b - 1 AS b, NULL AS last, first FROM {name}_ends) q GROUP BY {key}b),
    {name}_within AS (SELECT *, max(CASE WHEN has THEN {held("-")} END) OVER (PARTITION BY {key}b ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
        min(CASE WHEN has THEN {held("")} END) OVER (PARTITION BY {key}b ORDER BY ts_us DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM {rows}),
    {name} AS (SELECT w.event_id, array_min(filter(array({found}), c -> c.away <= {width})).id AS motion_id FROM {name}_within w LEFT JOIN {name}_beside e ON {"".join(f"e.{k.strip()} = w.{k.strip()} AND " for k in key.split(",") if k.strip())}e.b = w.b WHERE w.asks)"""


def storm_motion_near(max_age_s: int = STORM_MOTION_AGE_S) -> str:
    """For each scan the nearest one with a profile: its own site's before others, then nearest in time, the lower id on ties; at most an hour away. Only
    scans whose own site has none look at the others."""
    width = max_age_s * 1_000_000
    return f"""
    WITH timed AS (SELECT site, ts_us, event_id, cast(floor(ts_us / {width}e0) AS bigint) AS b, size >= 2000 AS has, true AS asks FROM {{scans}}),
    {_nearest_in_time("own", "timed", "site, ", width)},
    lacking AS (SELECT t.ts_us, t.event_id, t.b, coalesce(t.has, false) AS has, o.motion_id IS NULL AS asks FROM timed t JOIN own o ON o.event_id = t.event_id WHERE t.has OR o.motion_id IS NULL),
    {_nearest_in_time("other", "lacking", "", width)}
    SELECT event_id, motion_id FROM own WHERE motion_id IS NOT NULL UNION ALL SELECT event_id, motion_id FROM other WHERE motion_id IS NOT NULL"""


def quota_prune(budget: int, keep_from_us: int, keep_to_us: int, also: tuple[str, ...] = ()) -> str:
    """Scans to delete, oldest first, until the rest fits the budget; never a site's newest nor one in the kept window.

    Protected scans free nothing; a scan goes while total minus what went before is above the budget. Running sums are
    taken within days and carried over a table of days. also: further columns of scans that pass through and break ties after event_id.
    """
    of = lambda t: "".join(f", {t}.{c}" for c in also)
    return f"""
    WITH newest AS (SELECT site, max(ts_us) AS newest_us FROM {{scans}} GROUP BY site),
    total AS (SELECT sum(size) AS bytes FROM {{scans}}),
    open AS (SELECT s.site, s.ts_us, s.event_id, s.size{of("s")}, cast(floor(s.ts_us / 86400e6) AS bigint) AS day FROM {{scans}} s JOIN newest n ON n.site = s.site
        WHERE s.ts_us < n.newest_us AND NOT (s.ts_us BETWEEN {keep_from_us} AND {keep_to_us})),
    days AS (SELECT day, coalesce(sum(sum(size)) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM open GROUP BY day),
    freed AS (SELECT o.site, o.ts_us, o.event_id, o.size{of("o")}, d.before + coalesce(sum(o.size) OVER (PARTITION BY o.day ORDER BY o.ts_us, o.site, o.event_id{of("o")} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM open o JOIN days d ON d.day = o.day)
    SELECT f.site, f.event_id, cast(f.freed_before AS bigint) AS freed_before, cast(f.size AS bigint) AS size{of("f")} FROM freed f CROSS JOIN total t WHERE t.bytes - f.freed_before > {budget}"""


def eviction_order(window_from_us: int, window_to_us: int, budget: int) -> str:
    """Scans that leave a memory budget: those outside the window first, then oldest first, while the site is over budget."""
    return f"""
    WITH ranked AS (SELECT site, event_id, size, sum(size) OVER (PARTITION BY site) AS total,
        coalesce(sum(size) OVER (PARTITION BY site ORDER BY CASE WHEN ts_us BETWEEN {window_from_us} AND {window_to_us} THEN 1 ELSE 0 END, ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {{scans}})
    SELECT site, event_id, cast(before AS bigint) AS before FROM ranked WHERE total - before > {budget}"""


def next_frames(gap_s: int = SEQUENCE_GAP_S, fps: float = 8.0, dwell_s: float = 1.0) -> str:
    """Playback of sequences: each frame's next one, wrapping to the sequence's start, how long that is shown (longer for the
    sequence's last), and the first frame of the next sequence."""
    return f"""
    WITH marked AS (SELECT site, ts_us, event_id, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY site ORDER BY ts_us, event_id) <= {gap_s * 1_000_000} THEN 0 ELSE 1 END AS new FROM {{scans}}),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM marked),
    w AS (SELECT site, event_id, seq, lead(event_id) OVER s AS nxt, lead(event_id, 2) OVER s AS after, first_value(event_id) OVER s AS head, last_value(event_id) OVER (PARTITION BY site, seq ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail
        FROM numbered WINDOW s AS (PARTITION BY site, seq ORDER BY ts_us, event_id)),
    heads AS (SELECT site, seq, min(head) AS head FROM w GROUP BY site, seq)
    SELECT w.event_id, coalesce(w.nxt, w.head) AS next_id, w.nxt IS NULL AS wraps, CASE WHEN coalesce(w.nxt, w.head) = w.tail THEN {1 / fps + dwell_s!r}e0 ELSE {1 / fps!r}e0 END AS wait_s, h.head AS jump_id
    FROM w LEFT JOIN heads h ON h.site = w.site AND h.seq = w.seq + 1"""


def hourly_counts() -> str:
    """Tumbling hours: scans and bytes of each site and hour."""
    return "SELECT site, cast(floor(ts_us / 3600e6) AS bigint) AS hour, count(*) AS n_scans, cast(sum(size) AS bigint) AS bytes FROM {scans} GROUP BY site, cast(floor(ts_us / 3600e6) AS bigint)"


def hourly_inventory(gap_s: int = SEQUENCE_GAP_S) -> str:
    """Tumbling hours with their pauses: scans, bytes, first and last scan, the longest gap of the hour's scans to the scan before
    them (of the same day or the day before; null without one), and how many begin a loop: those over ``gap_s`` after the one before, or after none.

    Gaps are taken within hours and carried over the table of hours, so that no task sees a site's whole history.
    """
    wide = gap_s * 1_000_000
    return f"""
    WITH timed AS (SELECT site, ts_us, size, cast(floor(ts_us / 3600e6) AS bigint) AS hour FROM {{scans}}),
    stepped AS (SELECT site, hour, ts_us, size, ts_us - lag(ts_us) OVER (PARTITION BY site, hour ORDER BY ts_us) AS gap FROM timed),
    hours AS (SELECT site, hour, count(*) AS n_scans, cast(sum(size) AS bigint) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us, max(gap) AS inner_us, sum(CASE WHEN gap > {wide} THEN 1 ELSE 0 END) AS inner_loops FROM stepped GROUP BY site, hour),
    carried AS (SELECT *, lag(last_us) OVER (PARTITION BY site ORDER BY hour) AS prior_us, lag(hour) OVER (PARTITION BY site ORDER BY hour) AS prior_hour FROM hours),
    entered AS (SELECT *, CASE WHEN floor(prior_hour / 24e0) >= floor(hour / 24e0) - 1 THEN first_us - prior_us END AS entry_us FROM carried)
    SELECT site, hour, n_scans, bytes, first_us, last_us, greatest(inner_us, entry_us) AS longest_gap_us, cast(inner_loops + CASE WHEN entry_us <= {wide} THEN 0 ELSE 1 END AS bigint) AS loops FROM entered"""


def new_keys() -> str:
    """Set difference: listed scans that weren't seen (here: even ids are seen)."""
    return "SELECT site, event_id FROM {scans} EXCEPT SELECT site, event_id FROM {scans} WHERE event_id % 2 = 0"


def sizes_summary() -> str:
    """Share of the quota that each site holds."""
    return "SELECT site, cast(sum(size) AS bigint) AS bytes, round(100e0 * sum(size) / sum(sum(size)) OVER (), 4) AS percent FROM {scans} GROUP BY site"


def cell_motion(frames: int = 4) -> str:
    """Displacement of a track over its last positions, km/h per 1000 units; null for a single position. Also 15, 30 and 45 minute forecasts."""
    return f"""
    WITH w AS (SELECT event_id, x, y, ts_us, first_value(x) OVER f AS x0, first_value(y) OVER f AS y0, first_value(ts_us) OVER f AS t0, count(*) OVER f AS n FROM {{points}}
        WINDOW f AS (PARTITION BY track ORDER BY ts_us, event_id ROWS BETWEEN {frames - 1} PRECEDING AND CURRENT ROW)),
    v AS (SELECT event_id, x, y, CASE WHEN n > 1 AND ts_us > t0 THEN (x - x0) * 3600e6 / (ts_us - t0) END AS u, CASE WHEN n > 1 AND ts_us > t0 THEN (y - y0) * 3600e6 / (ts_us - t0) END AS w FROM w)
    SELECT event_id, round(u, 4) AS u, round(w, 4) AS v, round(x + u * 0.25e0, 4) AS x15, round(y + w * 0.25e0, 4) AS y15, round(x + u * 0.5e0, 4) AS x30, round(y + w * 0.5e0, 4) AS y30, round(x + u * 0.75e0, 4) AS x45, round(y + w * 0.75e0, 4) AS y45 FROM v"""
