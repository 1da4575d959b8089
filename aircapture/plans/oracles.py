"""The registered queries once more, as SQL over the given tables, for the check against DuckDB.

Written independently of the operators: nothing here is generated from them.
"""

from __future__ import annotations

from math import exp, factorial, floor

from aircapture.sources.operators import PACKAGED

# ---------------------------------------------------------------- shared relations


def _decode(source: str, columns: str, guard: str = "true") -> str:
    """Decoded frame columns of ``source(id, payload, ...)``; null where ``guard`` is false."""
    byte = lambda i: f"try_cast('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER)"
    rev = lambda i, n: " || ".join(f"substr(h, {2 * j + 1}, 2)" for j in reversed(range(i, i + n)))
    return f"""
  SELECT {columns},
    CASE WHEN {guard} THEN n END AS len,
    CASE WHEN {guard} AND n >= 5 THEN right(h, 8) END AS mic,
    CASE WHEN {guard} AND n >= 5 THEN mt END AS mtype,
    CASE WHEN {guard} AND n >= 5 THEN b0 & 3 END AS major,
    CASE WHEN {guard} AND mt >= 2 AND n >= 12 THEN {rev(1, 4)} END AS dev,
    CASE WHEN {guard} AND mt >= 2 AND n >= 12 THEN try_cast('0x' || {rev(6, 2)} AS INTEGER) END AS fcnt,
    CASE WHEN {guard} AND mt >= 2 AND n >= 12 THEN b5 END AS fctrl,
    CASE WHEN {guard} AND mt >= 2 AND n >= 12 AND 8 + (b5 & 15) < n - 4
         THEN try_cast('0x' || substr(h, 2 * (8 + (b5 & 15)) + 1, 2) AS INTEGER) END AS fport,
    CASE WHEN {guard} AND mt = 0 AND n = 23 THEN {rev(1, 8)} END AS app_eui,
    CASE WHEN {guard} AND mt = 0 AND n = 23 THEN {rev(9, 8)} END AS dev_eui,
    CASE WHEN {guard} AND mt = 0 AND n = 23 THEN {rev(17, 2)} END AS nonce,
    CASE WHEN {guard} AND mt = 1 AND n >= 5 THEN substr(substr(h, 3, 2 * (n - 5)), 1, 6) END AS appnonce,
    CASE WHEN {guard} AND mt = 1 AND n >= 5 THEN substr(substr(h, 3, 2 * (n - 5)), 7, 6) END AS netid,
    CASE WHEN {guard} AND mt = 1 AND n >= 5 THEN substr(substr(h, 3, 2 * (n - 5)), 13, 8) END AS join_dev
  FROM (SELECT *, length(h) // 2 AS n, {byte(0)} AS b0, {byte(5)} AS b5, {byte(0)} >> 5 AS mt
        FROM (SELECT *, lower(hex(from_base64(payload))) AS h FROM {source}))"""


_LE = "substr({0}, {1}, 2)"


def _le(text: str, n: int) -> str:
    return " || ".join(_LE.format(text, 2 * i + 1) for i in reversed(range(n)))


PK = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
fr AS (
  SELECT event_id, ts, user_id, k,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 4 ELSE 2 END AS mt,
    printf('%08X', CAST(((user_id // 2) * 28554695) % 4294967296 AS BIGINT)) AS dev8,
    printf('%04X', CAST(((user_id % 2) * 20000 + (user_id // 2) * 13 + rn + (rn // 7) * 2) % 65536 AS BIGINT)) AS fc4,
    (k % 2 = 0)::INT * 128 + (k % 5 = 0)::INT * 32 + (k % 10 = 0)::INT * 16 + k % 3 AS fctrl,
    k % 3 + (k % 25 = 0)::INT AS last_copy
  FROM ev),
hx AS (
  SELECT *, CASE
    WHEN k = 99 THEN printf('%02X', mt * 32) || upper(substr(md5('b' || event_id), 1, 14))
    WHEN mt = 0 THEN '00' || upper(substr(md5('j' || event_id) || md5('J' || event_id), 1, 44))
    ELSE printf('%02X', mt * 32) || {_le('dev8', 4)} || printf('%02X', fctrl) || {_le('fc4', 2)}
      || repeat('0A', k % 3) || printf('%02X', 1 + k % 4)
      || upper(substr(md5('p' || event_id), 1, 2 * (4 + k % 8))) || upper(substr(md5('m' || event_id), 1, 8))
    END AS frame
  FROM fr),
pk AS MATERIALIZED (
  SELECT event_id || '-' || j AS id,
    ts + to_milliseconds(CASE WHEN j > k % 3 THEN 7200000 ELSE j * 120 END) AS t,
    to_base64(unhex(frame)) AS payload,
    'gw' || ((user_id + j) % 5) AS gw,
    CAST(-40 - k % 60 - 5 * j AS INTEGER) AS rssi,
    CAST(k % 20 - 10 - j AS DOUBLE) AS snr,
    CAST(k % 8 AS INTEGER) AS channel,
    CASE WHEN k = 97 THEN 'BAD_CRC' ELSE 'CRC_OK' END AS crc,
    CAST(868100000 + 200000 * (k % 3) AS BIGINT) AS freq,
    CASE WHEN k = 98 THEN 'FSK' ELSE 'LORA' END AS modt,
    CAST(125000 AS BIGINT) AS bw,
    CAST(7 + user_id % 6 AS INTEGER) AS sf,
    'C_4_5' AS cr
  FROM (SELECT *, unnest(generate_series(0, last_copy)) AS j FROM hx))"""


def _flags(source: str, keys: str = "payload", same: str = "sf, bw, cr, freq", name: str = "fl") -> str:
    differs = " OR ".join(f"lag({c}) OVER w IS DISTINCT FROM {c}" for c in same.split(", ")) if same else "false"
    return f"""
{name}_head AS (
  SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > INTERVAL 60 MINUTE OR {differs}
            THEN 1 ELSE 0 END AS head
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t, id)),
{name}_run AS (
  SELECT *, sum(head) OVER (PARTITION BY {keys} ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM {name}_head),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (head, run), head = 0 AS dup,
    first_value(id) OVER (PARTITION BY {keys}, run ORDER BY t, id) AS copy_of
  FROM {name}_run)"""


FL = PK + "," + _flags("pk")
EN = FL + ", en AS MATERIALIZED (" + _decode("fl", "* EXCLUDE (h, n, b0, b5, mt)", "modt = 'LORA'") + ")"

WEIRD = (
    PK
    + """,
wd AS (
  SELECT id, to_base64(unhex(substr(
      printf('%02X', (code % 8) * 32 + code % 4) || substr(hex(from_base64(payload)), 3),
      1, CASE WHEN code % 3 = 0 THEN 2048 ELSE 2 * ((code // 8) % 40) END))) AS payload
  FROM (SELECT *, CAST('0x' || substr(md5(id), 1, 7) AS INTEGER) AS code FROM pk)),
wdd AS MATERIALIZED ("""
    + _decode("wd", "id, payload")
    + ")"
)
PKD = PK + ", pkd AS MATERIALIZED (" + _decode("pk", "id, t, payload") + ")"


def _fold(source: str = "en", condition: str = "true", out: str = "fp") -> str:
    """Flow packets of the recursive definition: the n-th packet of every device at step n."""
    fits = (
        "s.fcnt - x.lf >= 1 AND s.fcnt - x.lf < 10000 AND s.ms - x.lt > 0 AND s.ms - x.lt < 604800000 "
        "AND (x.mx = 0 OR 2 * x.mx >= (s.ms - x.lt) / (s.fcnt - x.lf)::DOUBLE)"
    )
    return f"""
seq AS MATERIALIZED (
  SELECT dev, id, t, epoch_us(t) // 1000 AS ms, CAST(fcnt AS BIGINT) AS fcnt, sf, payload,
    row_number() OVER (PARTITION BY dev ORDER BY epoch_us(t) // 1000, id) AS n
  FROM {source} WHERE mtype = 2 AND dev IS NOT NULL AND NOT dup AND {condition}),
fold(dev, n, id, nth, flows, ipt, fd) AS (
  SELECT DISTINCT dev, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT),
    CAST([] AS STRUCT(lt BIGINT, lf BIGINT, mx DOUBLE)[]), CAST(0 AS DOUBLE), CAST(0 AS BIGINT)
  FROM seq
  UNION ALL
  SELECT dev, n, id, coalesce(pos, len(flows) + 1),
    CASE WHEN pos IS NULL
      THEN list_append(flows, CAST({{'lt': ms, 'lf': fcnt, 'mx': 0}} AS STRUCT(lt BIGINT, lf BIGINT, mx DOUBLE)))
      ELSE list_transform(flows, lambda x, i: CASE WHEN i = pos
        THEN CAST({{'lt': ms, 'lf': fcnt, 'mx': greatest(x.mx, (ms - x.lt) / (fcnt - x.lf)::DOUBLE)}}
             AS STRUCT(lt BIGINT, lf BIGINT, mx DOUBLE))
        ELSE x END) END,
    CASE WHEN pos IS NULL THEN 0 ELSE (ms - flows[pos].lt) / (fcnt - flows[pos].lf)::DOUBLE END,
    CASE WHEN pos IS NULL THEN 0 ELSE fcnt - flows[pos].lf END
  FROM (
    SELECT s.dev, s.n, s.id, s.ms, s.fcnt, f.flows,
      CAST(list_position(list_transform(f.flows, lambda x: {fits}), true) AS BIGINT) AS pos
    FROM fold f JOIN seq s ON s.dev = f.dev AND s.n = f.n + 1)),
told AS MATERIALIZED (
  SELECT seq.dev, f.nth - 1 AS flow_id, f.ipt, f.fd, seq.fcnt, seq.sf, seq.t, seq.payload, seq.id,
    first_value(seq.t) OVER (PARTITION BY seq.dev, f.nth ORDER BY seq.n) AS t1
  FROM fold f JOIN seq ON seq.dev = f.dev AND seq.n = f.n),
copies AS (SELECT copy_of, count(*) AS c FROM {source} WHERE mtype = 2 AND dev IS NOT NULL AND dup GROUP BY 1),
{out} AS MATERIALIZED (
  SELECT told.*, coalesce(copies.c, 0) AS nd FROM told LEFT JOIN copies ON copies.copy_of = told.id)"""


FP = "WITH RECURSIVE " + EN + "," + _fold()
FS = (
    FP
    + """,
fs AS MATERIALIZED (
  SELECT dev, flow_id, arg_min(fcnt, n) AS f1, arg_max(fcnt, n) AS f2, arg_min(t, n) AS t1, arg_max(t, n) AS t2,
    avg(fd) AS mean_fd, quantile_cont(fd, 0.5) AS median_fd, max(fd) AS max_fd, CAST(sum(nd) AS BIGINT) AS nd,
    quantile_cont(ipt, 0.5) AS median_ipt, max(ipt) AS max_ipt, min(ipt) AS min_ipt, count(*) AS nb
  FROM (SELECT fp.*, row_number() OVER (PARTITION BY dev, flow_id ORDER BY t, fcnt) AS n FROM fp)
  GROUP BY dev, flow_id),
fq AS (SELECT *, (epoch_us(t2) - epoch_us(t1)) / 1000.0::DOUBLE / nullif(f2 - f1, 0) AS mean_ipt
       FROM fs WHERE nb >= 5 AND mean_fd <= 100)"""
)


def _ops() -> str:
    """The packaged operator table as VALUES."""
    rows = []
    with open(PACKAGED, encoding="utf-8") as f:
        for line in [x for x in f if not x.startswith("#")][1:]:
            cells = line.rstrip("\n").split("\t")
            lo, hi = cells[2].split(" - ")
            name = cells[3].replace("'", "''")
            rows.append(f"({int(lo, 16)}, {int(hi, 16)}, '{name}')")
    return ", ops(lo, hi, name) AS (VALUES " + ", ".join(rows) + ")"


WITH = "WITH "
RAW = "id AS _id, t AS time, payload AS \"phyPayload\", {v} AS src_version, gw AS gateway, rssi, snr, channel, crc, freq AS frequency, modt AS modulation, bw AS bandwidth, sf, cr AS code_rate"
RAW4 = RAW.format(v="CAST(4 AS INTEGER)")
PERIOD = "t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-10'"
DEV = "dev = '03676b8e'"


def _sql(base: str, body: str) -> str:
    return (base if base.startswith("WITH") else WITH + base) + "\n" + body


ORACLES: dict[str, str] = {}


def _add(name: str, base: str, body: str) -> None:
    ORACLES[name] = _sql(base, body)


# ---------------------------------------------------------------- sources and upkeep

_add("s1_read_packet_dump", PK, f"SELECT {RAW4} FROM pk")
_add("s2_export_monthly", PK, "SELECT CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, count(*) AS docs, count(DISTINCT id) AS ids FROM pk GROUP BY 1, 2")
_add("s3_normalise_v3", PK, "SELECT id AS _id, t AS time, CAST(3 AS INTEGER) AS src_version, gw AS gateway, snr, 'up-' || id AS uplink, modt AS modulation, cr AS code_rate, sf FROM pk")
_add("s4_normalise_v4", PK, "SELECT " + RAW4.replace("modt AS modulation", "'LORA' AS modulation") + " FROM pk")
LISTS = "k AS (SELECT *, split_part(id, '-', 1) AS event, CAST(split_part(id, '-', 2) AS INTEGER) AS copy FROM pk)"
_add(
    "s4_normalise_v4_receptions", PK + ", " + LISTS,
    "SELECT CASE WHEN copy = 0 THEN event ELSE event || '#' || copy END AS _id, first_value(t) OVER (PARTITION BY event ORDER BY copy) AS time,"
    " CAST(4 AS INTEGER) AS src_version, gw AS gateway, rssi, snr, 'LORA' AS modulation, sf FROM k",
)
_add(
    "s4_dropped_receptions", PK + ", " + LISTS,
    "SELECT count(DISTINCT event) AS packets, count(*) AS receptions, count(*) - count(DISTINCT event) AS dropped FROM k",
)
_add(
    "s5_unify", PK,
    "SELECT " + RAW.format(v="CAST(CASE WHEN t < TIMESTAMP '2024-01-16' THEN 3 ELSE 4 END AS INTEGER)").replace(
        "modt AS modulation", "CASE WHEN t < TIMESTAMP '2024-01-16' THEN modt ELSE 'LORA' END AS modulation") + " FROM pk",
)
_add(
    "s6_anonymise", PK,
    # three-character names never leave the 32-bit range
    "SELECT id AS _id, t AS time, CAST((ord(gw[1]) * 31 + ord(gw[2])) * 31 + ord(gw[3]) AS BIGINT) AS gateway_hash, rssi FROM pk",
)
_add("s7_subset_period", PK, f"SELECT {RAW4} FROM pk WHERE {PERIOD}")
_add("s8_delete_from_table", PK, f"SELECT {RAW4} FROM pk WHERE NOT ({PERIOD})")
_add("s8_delete_period", PK, f"SELECT {RAW4} FROM pk WHERE NOT ({PERIOD})")
_add(
    "s12_upsert", PK,
    f"SELECT {RAW.format(v='CAST(CASE WHEN ' + PERIOD + ' THEN 5 ELSE 4 END AS INTEGER)')} FROM pk "
    f"UNION ALL SELECT {RAW4.replace('id AS _id', chr(39) + chr(39) + ' || id || ' + chr(39) + '-new' + chr(39) + ' AS _id')} FROM pk WHERE channel = 7",
)
_add(
    "s13_parse_time", PK,
    "SELECT id AS _id, CASE epoch_us(t) % 5 WHEN 0 THEN date_trunc('second', t) WHEN 1 THEN make_timestamp(epoch_us(t) // 1000 * 1000) ELSE t END AS parsed FROM pk",
)

# ---------------------------------------------------------------- predicates

_add("f1_has_extra", EN, "SELECT id AS _id FROM en WHERE modt = 'LORA'")
_add("f2_has_extra_nodup", EN, "SELECT id AS _id FROM en WHERE modt = 'LORA' AND NOT dup")
_add("f3_needs_decode", PK, "SELECT id AS _id FROM pk WHERE modt = 'LORA' AND t < TIMESTAMP '2024-01-10'")
_add("f4_not_data", EN, "SELECT id AS _id FROM en WHERE modt = 'LORA' AND mtype IS DISTINCT FROM 2")
_add("f5_data", EN, "SELECT id AS _id FROM en WHERE modt = 'LORA' AND mtype = 2 AND t >= TIMESTAMP '2020-09-01'")
_add("f6_data_with_channel", EN, "SELECT id AS _id FROM en WHERE modt = 'LORA' AND mtype = 2 AND channel IS NOT NULL AND snr IS NOT NULL AND rssi IS NOT NULL AND crc IS NOT NULL AND sf IS NOT NULL")
_add("f7_data_for_device", EN, f"SELECT id AS _id FROM en WHERE mtype = 2 AND {DEV}")
_add("f8_all_ok", PK, "SELECT id AS _id FROM pk WHERE modt = 'LORA' AND crc = 'CRC_OK'")
_add("f9_all_ok_nodup", FL, "SELECT id AS _id FROM fl WHERE modt = 'LORA' AND crc = 'CRC_OK' AND NOT dup")
_add("f10_needs_dup_flag", PK, "SELECT id AS _id FROM pk WHERE channel < 3 AND t >= TIMESTAMP '2024-01-10'")
_add("f11_time_between", PK, f"SELECT id AS _id FROM pk WHERE {PERIOD}")
_add("f12_lookup_id", PK, f"SELECT {RAW4} FROM pk WHERE id = '500-0'")
_add("f12_lookup_payload", PK, f"SELECT {RAW4} FROM pk WHERE payload = (SELECT min(payload) FROM pk)")
ORACLES["f13_match_any_token"] = (
    "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), ['license', 'network'])"
)
_add("f14_device_packets", EN, f"SELECT dev AS \"devAddr\", payload AS \"phyPayload\", t AS time, fcnt AS \"fCnt\" FROM en WHERE {DEV} AND NOT dup")
for _indexed, _plain in (("f12_indexed_id", "f12_lookup_id"), ("f12_indexed_payload", "f12_lookup_payload"), ("f13_indexed_tokens", "f13_match_any_token"), ("f14_indexed_device", "f14_device_packets")):
    ORACLES[_indexed] = ORACLES[_plain]
_add("f15_first_unflagged_payload", PK, "SELECT min(payload) AS \"phyPayload\" FROM pk WHERE channel = 3")
_add("f15_undecoded", PK, "SELECT id AS _id, t AS time, payload AS \"phyPayload\" FROM pk WHERE modt <> 'LORA'")
_add("f17_drop_incomplete", PK, "SELECT id AS _id, rssi, snr AS \"loRaSNR\", channel, sf AS \"spreadingFactor\" FROM pk WHERE channel <> 2 AND sf <> 9")
_add("p1_flatten_hits", PK, "SELECT id AS _id, t AS time, rssi, snr AS \"loRaSNR\", crc AS \"crcStatus\", channel, sf AS \"spreadingFactor\" FROM pk")

# ---------------------------------------------------------------- decoding

_BITS = """(fctrl & 128) <> 0 AS adr, (fctrl & 64) <> 0 AS "adrAckReq", (fctrl & 32) <> 0 AS ack,
  CASE WHEN mtype IN (2, 4) THEN (fctrl & 16) <> 0 END AS "classB",
  CASE WHEN mtype NOT IN (2, 4) THEN (fctrl & 16) <> 0 END AS "fPending", fctrl & 15 AS "fOptsLen\""""
_add(
    "e1_decode_frames", WEIRD,
    f"""SELECT id AS _id, '1.1' AS version, CAST(nullif(len, 0) AS INTEGER) AS length, mic, mtype, major, fport, dev AS dev_addr, fcnt,
  {_BITS}, app_eui AS "appEUI", dev_eui AS "devEUI", nonce AS "devNonce", appnonce, netid, join_dev AS join_devaddr FROM wdd""",
)
_add("e2_mhdr", PKD, "SELECT id AS _id, mtype, major, mic, CAST(len AS INTEGER) AS length FROM pkd")
_add("e3_length_class", WEIRD, "SELECT CASE WHEN len = 0 THEN 'empty' WHEN len < 5 THEN 'too_short' ELSE 'decoded' END AS class, count(*) AS count FROM wdd GROUP BY 1")
_add("e4_join_request", PKD, "SELECT id AS _id, app_eui AS \"appEUI\", dev_eui AS \"devEUI\", nonce AS \"devNonce\" FROM pkd WHERE mtype = 0")
_add("e5_join_accept", WEIRD, "SELECT id AS _id, appnonce, netid, join_dev AS join_devaddr FROM wdd WHERE mtype = 1")
_add("e6_data_frame", PKD, "SELECT id AS _id, dev AS dev_addr, fcnt, fport FROM pkd WHERE dev IS NOT NULL")
_add("e7_fctrl", WEIRD, f"SELECT *, count(*) AS count FROM (SELECT {_BITS} FROM wdd WHERE dev IS NOT NULL) GROUP BY ALL")
_add("e8_content_hash", PK, "SELECT id AS _id, sha256(from_base64(payload)) AS random FROM pk")
_add(
    "e9_mtype_name", WEIRD,
    """SELECT CASE mtype WHEN 0 THEN 'Join-request' WHEN 1 THEN 'Join-Accept' WHEN 2 THEN 'Unconfirmed Uplink'
  WHEN 3 THEN 'Unconfirmed Downlink' WHEN 4 THEN 'Confirmed Uplink' WHEN 5 THEN 'Confirmed Downlink'
  WHEN 6 THEN 'RFU' WHEN 7 THEN 'Proprietary' END AS name, count(*) AS count FROM wdd GROUP BY 1""",
)
_REASON = """CASE WHEN len < 5 THEN 'invalid_length' WHEN mtype = 0 AND len <> 23 THEN 'join_length'
  WHEN mtype > 1 AND len < 12 THEN 'short_mac' END"""
_add(
    "e10_bad_frames",
    WEIRD + ", pkd AS (" + _decode("pk", "id, payload") + ")",
    f"""SELECT payload AS "phyPayload", reason, count(*) AS count FROM (
  SELECT payload, {_REASON} AS reason FROM wdd UNION ALL SELECT payload, {_REASON} FROM pkd)
  WHERE reason IS NOT NULL GROUP BY 1, 2""",
)
_add(
    "e11_decode_incremental", PK + ", pkd AS (" + _decode("pk", "id, t, modt, payload") + ")",
    """SELECT id AS _id,
  CASE WHEN modt = 'LORA' THEN '1.1' WHEN t < TIMESTAMP '2024-01-10' THEN '1.0' END AS version,
  CASE WHEN modt = 'LORA' OR t < TIMESTAMP '2024-01-10' THEN dev END AS dev_addr,
  CASE WHEN modt = 'LORA' OR t < TIMESTAMP '2024-01-10' THEN mtype END AS mtype FROM pkd""",
)

# ---------------------------------------------------------------- duplicates

_FLAG = "id AS _id, '1.0' AS version, dup AS is_duplicate, copy_of"
_add("d1_flag_duplicates", FL, f"SELECT {_FLAG} FROM fl")
_add("d1_flag_duplicates_strict", PK + "," + _flags("pk", "payload, sf, bw, cr, freq", ""), f"SELECT {_FLAG} FROM fl")
_add("d1_flag_duplicates_sliced", FL, f"SELECT {_FLAG} FROM fl")
_add("d1_flag_incremental", FL, f"SELECT {_FLAG} FROM fl")
_EVENT = "CAST(split_part(id, '-', 1) AS BIGINT)"
_add(
    "d1_flag_incremental_late",
    PK
    + f""",
pkl AS (SELECT * REPLACE (CASE WHEN {_EVENT} % 97 <> 1 THEN payload END AS payload, CASE WHEN {_EVENT} % 97 <> 2 THEN t END AS t) FROM pk),"""
    + _flags("pkl", "(CASE WHEN payload IS NULL OR t IS NULL THEN id ELSE payload END)"),
    f"SELECT {_FLAG} FROM fl",
)


def _messages(window_ms: int) -> str:
    """Anchors by recursion: the first reception of a key, then the first one beyond the open window."""
    key = "payload, freq, bw, sf, cr"
    return (
        "WITH RECURSIVE "
        + PK
        + f""",
anchor(payload, freq, bw, sf, cr, a) AS (
  SELECT {key}, min(t) FROM pk GROUP BY {key}
  UNION ALL
  SELECT payload, freq, bw, sf, cr, min(t) FROM (
    SELECT p.payload, p.freq, p.bw, p.sf, p.cr, p.t, a.a
    FROM anchor a JOIN pk p ON p.payload = a.payload AND p.freq = a.freq AND p.bw = a.bw AND p.sf = a.sf AND p.cr = a.cr
      AND p.t > a.a + INTERVAL {window_ms} MILLISECOND)
  GROUP BY payload, freq, bw, sf, cr, a),
ms AS (
  SELECT p.*, max(a.a) AS a FROM pk p JOIN anchor a
    ON p.payload = a.payload AND p.freq = a.freq AND p.bw = a.bw AND p.sf = a.sf AND p.cr = a.cr AND a.a <= p.t
  GROUP BY ALL),
msg AS MATERIALIZED (
  SELECT *, first_value(id) OVER (PARTITION BY {key}, a ORDER BY t, id) AS message_id FROM ms)"""
    )


_add("d2_assign_messages", _messages(300), "SELECT id AS _id, message_id FROM msg")
_add("d2_assign_messages_150ms", _messages(150), "SELECT id AS _id, message_id FROM msg")
_add("d2_assign_messages_sliced", _messages(300), "SELECT id AS _id, message_id FROM msg")
_add(
    "d2_collapse_receptions", _messages(300),
    """SELECT message_id AS _id, any_value(payload) AS "phyPayload", any_value(freq) AS frequency,
  any_value(cr) AS code_rate, CAST(count(*) AS INTEGER) AS receptions, string_agg(gw, ',' ORDER BY t, id) AS gateways,
  max(rssi) AS best_rssi FROM msg GROUP BY message_id""",
)
_add(
    "d2_receptions", _messages(300),
    "SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY t, id) AS INTEGER) AS position, id AS _id, t AS time, gw AS gateway, rssi FROM msg",
)
_add("d3_reception_stats", _messages(300), "SELECT count(DISTINCT message_id) AS messages, count(*) AS receptions FROM msg")
_add("d4_payload_inventory", PK, "SELECT payload AS \"phyPayload\", count(*) AS doc_count, min(t) AS time FROM pk WHERE t >= TIMESTAMP '2024-01-16' GROUP BY 1")
_add(
    "d5_candidate_window", PK,
    """SELECT id AS _id FROM pk JOIN (SELECT payload AS p, min(t) AS t0 FROM pk WHERE t >= TIMESTAMP '2024-01-16' GROUP BY 1)
  ON p = payload AND t >= t0 - INTERVAL 60 MINUTE""",
)
_add("d6_dups_per_original", FL, "SELECT copy_of, CAST(sum(dup::INT) AS BIGINT) AS nb_duplicates FROM fl GROUP BY 1")

# ---------------------------------------------------------------- flows

_PACKET = """dev AS "devAddr", flow_id, t1 AS time_1st, round(ipt, 6) AS interpkt_time_ms, fd AS "fCnt_diff", fcnt AS "fCnt",
  sf AS "SF", t AS time, payload AS "phyPayload", id AS _id"""
_FLOW = """dev AS "devAddr", flow_id, f1 AS "fCnt_1st", f2 AS "fCnt_last", t1 AS time_1st, t2 AS time_last,
  round(mean_fd, 6) AS "mean_fCnt_diff", round(median_fd, 6) AS "median_fCnt_diff", max_fd AS "max_fCnt_diff",
  nd AS nb_duplicates, round(median_ipt, 6) AS median_interpkt_time_ms, round(max_ipt, 6) AS max_interpkt_time_ms,
  round(min_ipt, 6) AS min_interpkt_time_ms, nb AS nb_pkts"""
_add("s10_write_read_flows", FS, f"SELECT {_FLOW} FROM fs")
_add("s11_write_read_flow_packets", FP, f"SELECT {_PACKET}, nd AS nb_duplicates FROM fp")
_add("f16_flow_quality", FS, "SELECT dev AS \"devAddr\", flow_id, nb AS nb_pkts FROM fq")
_add("w1_device_list", EN, "SELECT dev AS \"devAddr\", count(*) AS doc_count FROM en WHERE mtype = 2 AND dev IS NOT NULL GROUP BY 1")
_add("w2_assign_flows", FP, "SELECT dev AS \"devAddr\", id AS _id, flow_id FROM fp")
_add("w2_assign_flows_epochs", FP, "SELECT dev AS \"devAddr\", id AS _id, flow_id FROM fp")
_add("w3_flow_packets", FP, f"SELECT {_PACKET} FROM fp")
_add("w4_attach_duplicates", FP, f"SELECT {_PACKET}, nd AS nb_duplicates FROM fp")
_add(
    "w4_unmatched_duplicates", EN,
    """SELECT id AS _id FROM en WHERE mtype = 2 AND dev IS NOT NULL AND dup AND copy_of NOT IN (
  SELECT id FROM en WHERE mtype = 2 AND dev IS NOT NULL AND NOT dup AND t < TIMESTAMP '2024-01-16')""",
)
_add("w5_summarise_flows", FS, f"SELECT {_FLOW} FROM fs")
_add(
    "w6_pending_devices", EN,
    """SELECT dev AS "devAddr", count(*) AS doc_count FROM en WHERE mtype = 2 AND dev IS NOT NULL AND dev NOT IN (
  SELECT dev FROM en WHERE mtype = 2 AND dev IS NOT NULL AND t < TIMESTAMP '2024-01-02') GROUP BY 1""",
)
ORACLES["w2_continued_flows"] = ORACLES["w4_attach_duplicates"]
_add(
    "w2_late_packets", EN,
    """SELECT dev AS "devAddr", id AS _id FROM en WHERE mtype = 2 AND dev IS NOT NULL AND NOT dup AND t < TIMESTAMP '2024-01-16' AND dev IN (
  SELECT dev FROM en WHERE mtype = 2 AND NOT dup AND t >= TIMESTAMP '2024-01-16')""",
)
_add(
    "w6_changed_flows", FS,
    f"""SELECT {_FLOW} FROM fs WHERE (dev, flow_id) IN (SELECT (dev, flow_id) FROM fp WHERE t >= TIMESTAMP '2024-01-16')
  OR (dev, flow_id) IN (SELECT (fp.dev, fp.flow_id) FROM fp JOIN en ON en.copy_of = fp.id WHERE en.dup AND en.t >= TIMESTAMP '2024-01-16')""",
)
_add("w7_flow_lookup", FP, f"SELECT {_PACKET}, nd AS nb_duplicates FROM fp WHERE {DEV}")
_add(
    "w7_flow_lookup_first", FP,
    f"SELECT {_PACKET}, nd AS nb_duplicates FROM fp WHERE {DEV} AND t1 = (SELECT max(t1) FROM fp WHERE {DEV})",
)

# ---------------------------------------------------------------- joins

_OPERATOR = "LEFT JOIN ops ON CAST('0x' || dev AS BIGINT) BETWEEN ops.lo AND ops.hi"
_SHORT = """CASE coalesce(name, 'UNKOWN') WHEN 'Shenzhen Tencent Computer Systems Company Limited' THEN 'Shenzhen Tencent'
  WHEN 'NTT (Nippon Telephone and Telegraph)' THEN 'NTT' ELSE coalesce(name, 'UNKOWN') END"""
_add("j1_with_operator", EN + _ops(), f"SELECT id AS _id, dev AS \"devAddr\", coalesce(name, 'UNKOWN') AS operator FROM en {_OPERATOR} WHERE dev IS NOT NULL")
_add("s9_read_operators", EN + _ops(), f"SELECT coalesce(name, 'UNKOWN') AS operator, count(*) AS docs FROM en {_OPERATOR} WHERE dev IS NOT NULL GROUP BY 1")
_ADDRESS = "CAST('0x' || dev AS BIGINT)"
_add(
    "j1_with_operator_overlap", EN,
    f"""SELECT id AS _id, dev AS "devAddr", CASE WHEN {_ADDRESS} BETWEEN 33554432 AND 134217733 THEN 'mid'
  WHEN {_ADDRESS} <= 67108864 THEN 'low' ELSE 'all' END AS operator FROM en WHERE dev IS NOT NULL""",
)
_add("j2_shorten_names", EN + _ops(), f"SELECT DISTINCT dev AS \"devAddr\", {_SHORT} AS operator FROM en {_OPERATOR} WHERE mtype = 2 AND dev IS NOT NULL")
_add("j3_duplicate_to_original", FL, "SELECT o.id AS original_id, o.t AS original_time, d.id AS duplicate_id, d.t AS duplicate_time FROM fl d JOIN fl o ON o.id = d.copy_of WHERE d.dup AND NOT o.dup")
_add("j4_flow_series", FS, "SELECT dev AS \"devAddr\", flow_id, id AS _id FROM fp WHERE (dev, flow_id) IN (SELECT dev, flow_id FROM fq)")
_add("j5_skip_processed", EN, "SELECT id AS _id FROM en WHERE mtype = 2 AND dev IS NOT NULL AND dev NOT IN (SELECT dev FROM en WHERE mtype = 2 AND dev IS NOT NULL AND t < TIMESTAMP '2024-01-02')")
_add("j6_payload_batch", PK, "SELECT id AS _id FROM pk WHERE payload IN (SELECT payload FROM pk WHERE gw = 'gw1')")

# ---------------------------------------------------------------- aggregates


def _nested(rows: str, k1: str, k2: str, n1: int, n2: int, metric: str = "", names: tuple[str, str] = ("k1", "k2")) -> str:
    extra = f", {metric}" if metric else ""
    alias = f", {metric.split(' AS ')[-1]}" if metric else ""
    return f"""SELECT k1 AS "{names[0]}", k2 AS "{names[1]}", c AS count{alias} FROM (
  SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY c DESC, k2) AS r FROM (
    SELECT {k1} AS k1, {k2} AS k2, count(*) AS c{extra} FROM {rows} AND {k1} IS NOT NULL AND {k2} IS NOT NULL GROUP BY 1, 2))
  WHERE r <= {n2} AND k1 IN (
    SELECT {k1} FROM {rows} AND {k1} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {k1} LIMIT {n1})"""


_add("a1_nested_counts", EN, _nested("en WHERE true", "dev", "gw", 10, 3, "max(rssi) AS best_rssi", ("devAddr", "gateway")))
ORACLES["a1_nested_counts_lineitem"] = _nested("lineitem WHERE true", "l_suppkey", "l_partkey", 10, 10, names=("l_suppkey", "l_partkey"))
_GOOD = "modt = 'LORA' AND crc = 'CRC_OK' AND NOT dup"
_WEEK = "timezone('UTC', timezone('Europe/Paris', date_trunc('week', timezone('Europe/Paris', timezone('UTC', t)))))"
_add("a2_weekly_by_sf", FL, f"SELECT sf AS \"SF\", {_WEEK} AS week, count(*) AS count FROM fl WHERE {_GOOD} GROUP BY 1, 2")
_add("a3_weekly_by_modulation", FL, f"SELECT modt AS modulation, {_WEEK} AS week, count(*) AS count FROM fl WHERE {_GOOD} GROUP BY 1, 2")
_add("a4_per_weekday_per_day", FL, f"SELECT strftime(t, '%a') AS day_of_week, CAST(t AS DATE) AS day, count(*) AS count FROM fl WHERE {_GOOD} GROUP BY 1, 2")
_add("a5_per_hour_per_day", FL, f"SELECT CAST(hour(t) AS INTEGER) AS hour, CAST(t AS DATE) AS day, count(*) AS count FROM fl WHERE {_GOOD} GROUP BY 1, 2")
_add("a6_per_weekday", PK, "SELECT strftime(t, '%a') AS day_of_week, count(*) AS count FROM pk WHERE crc = 'CRC_OK' AND t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-26' GROUP BY 1")
_OKP = f"crc = 'CRC_OK' AND {PERIOD}"
_add("a6_per_hour", PK, f"SELECT CAST(hour(t) AS INTEGER) AS hour, count(*) AS count FROM pk WHERE {_OKP} GROUP BY 1")
_add("a7_am_pm", PK, f"SELECT CASE WHEN hour(t) < 12 THEN 'AM' ELSE 'PM' END AS half, count(*) AS count FROM pk WHERE {_OKP} GROUP BY 1")
_add("a8_day_night", PK, f"SELECT CASE WHEN hour(t) <= 7 OR hour(t) >= 19 THEN 'night' ELSE 'day' END AS period, count(*) AS count FROM pk WHERE {_OKP} GROUP BY 1")
_add("a9_per_mtype", EN, "SELECT mtype AS \"mType\", count(*) AS count FROM en WHERE dev IS NOT NULL GROUP BY 1")
_CHARTS = {
    "weekly_by_modulation": ("modt", _WEEK, f"{_GOOD}"), "per_weekday_per_day": ("strftime(t, '%a')", "CAST(CAST(t AS DATE) AS TIMESTAMP)", _GOOD),
    "per_hour_per_day": ("CAST(hour(t) AS VARCHAR)", "CAST(CAST(t AS DATE) AS TIMESTAMP)", _GOOD),
    "per_weekday": ("strftime(t, '%a')", "CAST(NULL AS TIMESTAMP)", _OKP), "per_hour": ("CAST(hour(t) AS VARCHAR)", "CAST(NULL AS TIMESTAMP)", _OKP),
    "am_pm": ("CASE WHEN hour(t) < 12 THEN 'AM' ELSE 'PM' END", "CAST(NULL AS TIMESTAMP)", _OKP),
    "day_night": ("CASE WHEN hour(t) <= 7 OR hour(t) >= 19 THEN 'night' ELSE 'day' END", "CAST(NULL AS TIMESTAMP)", _OKP),
    "per_mtype": ("CAST(mtype AS VARCHAR)", "CAST(NULL AS TIMESTAMP)", "dev IS NOT NULL"),
}
_add(
    "a_traffic_cube", EN,
    " UNION ALL ".join(f"SELECT '{c}' AS chart, {k} AS key, {at} AS at, count(*) AS count FROM en WHERE {rows} GROUP BY ALL" for c, (k, at, rows) in _CHARTS.items()),
)
_add("a10_gateway_first_seen", EN, "SELECT gw AS \"gatewayId\", min(t) AS min_time FROM en WHERE modt = 'LORA' GROUP BY 1")
_NODUP = "en WHERE modt = 'LORA' AND NOT dup"
_PER_DEVICE = "SELECT dev AS \"devAddr\", gw AS \"gatewayId\", count(*) AS count FROM en WHERE modt = 'LORA' AND NOT dup AND dev IS NOT NULL GROUP BY 1, 2"
_add("a11_per_device_gateway", EN, _PER_DEVICE)
_add("a12_per_deveui_gateway", EN, "SELECT dev_eui AS \"devEUI\", gw AS \"gatewayId\", count(*) AS count FROM en WHERE modt = 'LORA' AND NOT dup AND dev_eui IS NOT NULL GROUP BY 1, 2")
_add(
    "a13_class_ack_matrix", EN,
    """SELECT b AS "classB", a AS ack, c AS count, round(c / sum(c) OVER (), 6) AS share, round(c / sum(c) OVER (PARTITION BY b), 6) AS share_of_class
  FROM (SELECT (fctrl & 16) <> 0 AS b, (fctrl & 32) <> 0 AS a, count(*)::DOUBLE AS c0, count(*) AS c FROM en
        WHERE modt = 'LORA' AND NOT dup AND mtype IN (2, 4) AND dev IS NOT NULL GROUP BY 1, 2)""",
)
_add("a14_operator_traffic", EN + _ops(), f"SELECT {_SHORT} AS operator, count(*) AS doc_count FROM en {_OPERATOR} WHERE mtype = 2 AND dev IS NOT NULL GROUP BY 1")
_HOURS = ", ".join(f"count(*) FILTER (hour(t) = {h}) AS h{h:02d}" for h in range(24))
_add("a15_dups_by_hour", FP, f"SELECT nd AS nb_duplicates, {_HOURS} FROM fp GROUP BY 1")
_add(
    "a16_progress", EN,
    """SELECT modt AS modulation, count(*) AS docs, CAST(0 AS BIGINT) AS without_dup_infos,
  count(*) FILTER (modt <> 'LORA') AS without_extra_infos, count(*) FILTER (modt = 'LORA') AS with_extra_infos,
  count(*) FILTER (modt = 'LORA') AS with_extra_version, count(*) FILTER (t >= TIMESTAMP '2024-01-10') AS since_date FROM en GROUP BY 1""",
)
_add("a17_packet_sizes", EN, "SELECT id AS _id, CAST(len AS INTEGER) AS size FROM en WHERE modt = 'LORA' AND NOT dup")

# ---------------------------------------------------------------- statistics


def _ecdf(rows: str, value: str, weight: str = "1", by: str = "", by_name: str = "", value_name: str = "") -> str:
    """``by`` may list several columns, named alike in ``by_name``."""
    keys = [k for k in by.split(", ") if k]
    names = [k for k in by_name.split(", ") if k]
    inner = "".join(f"{k} AS k{i}, " for i, k in enumerate(keys))
    ks = ", ".join(f"k{i}" for i in range(len(keys)))
    part = f"PARTITION BY {ks}" if keys else ""
    outer = "".join(f'k{i} AS "{n}", ' for i, n in enumerate(names))
    known = "".join(f" AND k{i} IS NOT NULL" for i in range(len(keys)))
    group = (ks + ", " if ks else "") + "v"
    return f"""SELECT {outer}v AS "{value_name or value}", w AS weight, CAST(sum(w) OVER ({part} ORDER BY v) AS BIGINT) AS cumulative,
  CAST(sum(w) OVER ({part}) AS BIGINT) AS total, round(sum(w) OVER ({part} ORDER BY v) / (sum(w) OVER ({part}))::DOUBLE, 9) AS ecdf
  FROM (SELECT {group}, CAST(sum(w0) AS BIGINT) AS w FROM (SELECT {inner}{value} AS v, {weight} AS w0 FROM {rows})
        WHERE v IS NOT NULL{known} GROUP BY {group})"""


_add("x1_ecdf_packet_size", EN, _ecdf("(SELECT CAST(len AS INTEGER) AS size FROM en WHERE modt = 'LORA' AND NOT dup)", "size"))
_add("x1_ecdf_device_gateway", EN, _ecdf(f"({_PER_DEVICE})", "count", by='"gatewayId"', by_name="gatewayId"))
ORACLES["x1_ecdf_lineitem_price"] = _ecdf(
    "lineitem", "CAST(l_extendedprice AS DOUBLE)", "CAST(l_quantity AS BIGINT)", "l_returnflag", "l_returnflag", "price"
)
_add("x2_prr_span", FS, "SELECT dev AS \"devAddr\", flow_id, round(nb / nullif(f2 - f1, 0)::DOUBLE, 6) AS prr FROM fs")
_RATES = """(SELECT dev, flow_id, 1 / nullif(avg(fd), 0) AS prr, CAST(round_even(avg(sf), 0) AS INTEGER) AS sf, avg(nd) AS nd, count(*) AS nb
  FROM fp WHERE (dev, flow_id) IN (SELECT dev, flow_id FROM fq) GROUP BY 1, 2)"""
_add("x3_prr_by_sf", FS, "SELECT * REPLACE (round(prr, 9) AS prr) FROM (" + _ecdf(f"{_RATES} WHERE sf IS NOT NULL", "prr", "nb", "sf", "SF") + ")")
_add("x4_prr_vs_dups", FS, f"SELECT dev AS \"devAddr\", flow_id, round(prr, 6) AS prr, round(nd, 6) AS nb_duplicates, nb AS nb_pkts FROM {_RATES}")
_LASTED = "(epoch_us(t2) - epoch_us(t1))"
_add("x5_mean_interpkt", FS, f"SELECT dev AS \"devAddr\", flow_id, round({_LASTED} / 1000.0::DOUBLE / nullif(f2 - f1, 0), 3) AS mean_ms FROM fs")
_add(
    "x6_interpkt_ecdf", FS,
    _ecdf(
        f"""(SELECT 'mean' AS kind, CAST(ceil({_LASTED} / 1000.0::DOUBLE / nullif(f2 - f1, 0) / 1000) AS BIGINT) AS seconds FROM fs
  UNION ALL SELECT 'median', CAST(ceil(median_ipt / 1000) AS BIGINT) FROM fs)""",
        "seconds", by="kind", by_name="kind",
    ),
)
_add("x7_duration_ecdf", FS, _ecdf(f"(SELECT CAST(ceil({_LASTED} / 1000000.0::DOUBLE / 3600) AS BIGINT) * 3600 AS seconds FROM fs)", "seconds"))
_CHOSEN = "(SELECT dev, flow_id, nb FROM {0} ORDER BY md5(dev || '|' || epoch_us(t1) || '|' || flow_id), dev, flow_id LIMIT 12)"
_add(
    "x8_flow_interpkt_ecdf", FS,
    "SELECT * REPLACE (round(seconds, 9) AS seconds) FROM ("
    + _ecdf(
        f"(SELECT fp.dev, fp.flow_id, ipt / 1000 AS seconds FROM fp JOIN {_CHOSEN.format('fq')} c ON c.dev = fp.dev AND c.flow_id = fp.flow_id)",
        "seconds", by="dev, flow_id", by_name="devAddr, flow_id",
    )
    + ")",
)
_add("x9_pearson", FS, "SELECT round(r, 6) AS r, n, round(t, 4) AS t, round(1 - 2 * abs(t) / 3000 * (SELECT sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * pow(1 + pow(t * i / 1000.0, 2) / (n - 2), -(n - 1) / 2.0)) FROM generate_series(0, 1000) AS g(i)), 6) AS p FROM (SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT corr(mean_ipt, nb) AS r, count(*) AS n FROM fq WHERE mean_ipt IS NOT NULL))")
_COLS = {
    "mean_fCnt_diff": "mean_fd", "median_fCnt_diff": "median_fd", "max_fCnt_diff": "max_fd",
    "mean_interpkt_time_ms": "mean_ipt", "median_interpkt_time_ms": "median_ipt", "nb_pkts": "nb",
}
_names = list(_COLS)
_add(
    "x10_pair_correlations", FS,
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({_COLS[a]}, {_COLS[b]}), 6) AS r FROM fq"
        for i, a in enumerate(_names) for b in _names[i + 1:]
    ),
)


def _bin(column: str, bins: int) -> str:
    ends = f"(SELECT max({column})::DOUBLE - min({column}) FROM pk)"
    return f"CAST(least({bins - 1}, floor(({column} - (SELECT min({column})::DOUBLE FROM pk)) * {bins} / {ends})) AS INTEGER)"


_add("x10_histogram", PK, f"SELECT {_bin('rssi', 16)} AS bin, count(*) AS count FROM pk GROUP BY 1")
_add("x10_density_grid", PK, f"SELECT {_bin('rssi', 8)} AS x_bin, {_bin('snr', 8)} AS y_bin, count(*) AS count FROM pk GROUP BY 1, 2")


def _matrix(rows: str, columns: dict[str, str], bins: int) -> str:
    """Cells of all histograms and lower grids, one SELECT each."""
    cell = lambda c: (
        f"CASE WHEN (SELECT max({c}) = min({c}) FROM {rows}) THEN 0 ELSE CAST(least(floor(({c} - (SELECT min({c}) FROM {rows})::DOUBLE) * {bins} / "
        f"(SELECT max({c})::DOUBLE - min({c}) FROM {rows})), {bins - 1}) AS INTEGER) END"
    )
    names, parts = list(columns), []
    for i, x in enumerate(names):
        parts.append(f"SELECT '{x}' AS x, '{x}' AS y, {cell(columns[x])} AS x_bin, CAST(NULL AS INTEGER) AS y_bin, count(*) AS count FROM {rows} WHERE {columns[x]} IS NOT NULL GROUP BY ALL")
        for y in names[:i]:
            parts.append(
                f"SELECT '{x}' AS x, '{y}' AS y, {cell(columns[x])} AS x_bin, {cell(columns[y])} AS y_bin, count(*) AS count FROM {rows} "
                f"WHERE {columns[x]} IS NOT NULL AND {columns[y]} IS NOT NULL GROUP BY ALL"
            )
    return " UNION ALL ".join(parts)


_add("x10_pair_matrix", FS, _matrix("fq", _COLS, 10))
_add("x10_pair_matrix_links", PK, _matrix("pk", {"rssi": "rssi", "loRaSNR": "snr", "channel": "channel"}, 8))
# a Poisson(1) number of a uniform one below 2^32: how many of the cumulative shares it has passed
_SHARES = [floor(2**32 * exp(-1) * sum(1 / factorial(j) for j in range(k + 1))) for k in range(9)]
_DRAWN = "CAST('0x' || substr(md5(k || '|' || d || '|' || replica), 1, 8) AS BIGINT)"
_DAILY = FL + f", dc AS (SELECT CAST(hour(t) AS INTEGER) AS k, CAST(t AS DATE) AS d, count(*) AS c FROM fl WHERE {_GOOD} GROUP BY 1, 2)"
_add(
    "x11_bootstrap_hour", _DAILY,
    f"""SELECT a.k AS hour, round(mean, 5) AS mean, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high, any_value(n) AS n
FROM (SELECT k, avg(c) AS mean, count(*) AS n FROM dc GROUP BY k) a JOIN (
  SELECT k, replica, CAST(sum(w * c) AS DOUBLE) / sum(w) AS m FROM (
    SELECT k, c, replica, {" + ".join(f"CAST({_DRAWN} >= {s} AS INTEGER)" for s in _SHARES)} AS w FROM dc, generate_series(1, 200) AS g(replica))
  GROUP BY k, replica HAVING sum(w) > 0) b ON a.k = b.k
GROUP BY a.k, mean""",
)
ORACLES["x1_merged_sketches"] = "SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q, true AS within"


def _ci(key: str, name: str) -> str:
    half = "1.959963984540054 * sd / sqrt(n)"
    return f"""SELECT k AS {name}, round(m, 5) AS mean, round(m - {half}, 5) AS low, round(m + {half}, 5) AS high, n FROM (
  SELECT k, avg(c) AS m, stddev_samp(c) AS sd, count(*) AS n FROM (
    SELECT {key} AS k, CAST(t AS DATE) AS d, count(*) AS c FROM fl WHERE {_GOOD} GROUP BY 1, 2) GROUP BY 1)"""


_add("x11_mean_ci_weekday", FL, _ci("strftime(t, '%a')", "day_of_week"))
_add("x11_mean_ci_hour", FL, _ci("CAST(hour(t) AS INTEGER)", "hour"))
_add("x12_dups_ecdf", FS, _ecdf("(SELECT nd FROM fp WHERE (dev, flow_id) IN (SELECT dev, flow_id FROM fq))", "nd", value_name="nb_duplicates"))

# ---------------------------------------------------------------- samples, sorts, pages

_KEY = "md5(payload || '|' || epoch_us(t))"
_add(
    "k1_hash_sample", EN,
    f"""SELECT id AS _id, t AS time, rssi, snr AS "loRaSNR", crc AS "crcStatus", channel, sf AS "spreadingFactor"
  FROM en WHERE modt = 'LORA' AND mtype = 2 ORDER BY {_KEY}, id LIMIT 1000""",
)
_add("k1_hash_sample_large", PK, f"SELECT id AS _id FROM pk ORDER BY {_KEY}, id LIMIT 15000")
_add("k2_random_flows", FS, f"SELECT dev AS \"devAddr\", flow_id, nb AS nb_pkts FROM {_CHOSEN.format('fs')}")
_add("k3_sorts", FL, "SELECT id AS _id, t AS time, dup AS is_duplicate FROM fl ORDER BY t, dup, id")
_add("k4_top_k_per_level", EN, _nested(_NODUP, "dev", "gw", 15, 2, names=("devAddr", "gatewayId")))
_add("k5_page", PK, "SELECT t AS time, id AS _id, payload AS \"phyPayload\" FROM pk WHERE t >= TIMESTAMP '2024-01-12' ORDER BY t, id LIMIT 500")
ORACLES["k5_page_lineitem"] = (
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (300, 2) "
    "ORDER BY l_orderkey, l_linenumber LIMIT 1000"
)
_add(
    "u1_weekday_names", PK,
    "SELECT CAST(isodow(t) - 1 AS INTEGER) AS day, strftime(t, '%a') AS short, dayname(t) AS long, count(*) AS count FROM pk GROUP BY 1, 2, 3",
)

# ---------------------------------------------------------------- streams: the batch results

_add("t1_stream_decode", EN, "SELECT id AS _id, mtype, dev AS dev_addr, fcnt FROM en")
_add("t2_stream_collapse", _messages(300), "SELECT id AS _id, message_id FROM msg")
ORACLES["t3_stream_traffic"] = ORACLES["a2_weekly_by_sf"]
ORACLES["t3_stream_weeks"] = ORACLES["a2_weekly_by_sf"]
ORACLES["t2_stream_collapse_rows"] = ORACLES["d2_collapse_receptions"]
_STRICT = PK + "," + _flags("pk", "payload, sf, bw, cr, freq", "")
_add("t4_stream_flags", FL, "SELECT id AS _id, dup AS is_duplicate, copy_of FROM fl")
_add("t4_stream_flags_strict", _STRICT, "SELECT id AS _id, dup AS is_duplicate, copy_of FROM fl")
_add(
    "t4_stream_chains", _STRICT,
    "SELECT copy_of, count(*) - 1 AS nb_duplicates, min(t) AS first_time, max(t) AS last_time FROM fl GROUP BY 1",
)
