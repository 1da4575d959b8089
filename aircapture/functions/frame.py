"""Frame header decoding as plain column expressions over the lower-case hex text of a frame.

Everything stays in whole-stage code generation; only the optional SHA-3 digest
leaves the JVM.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The version stamps and the message types of the frame format.
EXTRA_VERSION = "1.1"
DUP_VERSION = "1.0"
JOIN_REQUEST = 0
JOIN_ACCEPT = 1
UPLINKS = (2, 4)
MTYPE_NAMES = {
    0: "Join-request",
    1: "Join-Accept",
    2: "Unconfirmed Uplink",
    3: "Unconfirmed Downlink",
    4: "Confirmed Uplink",
    5: "Confirmed Downlink",
    6: "RFU",
    7: "Proprietary",
}
MIN_FRAME = 5  # header byte and four bytes of integrity code
MIN_DATA_FRAME = 12  # the above and a seven-byte frame header
JOIN_REQUEST_FRAME = 23


def payload_bytes(payload: Column) -> Column:
    """Bytes of a base64 payload; null for text that is not base64."""
    return F.try_to_binary(payload, F.lit("base64"))


def payload_hex(payload: Column) -> Column:
    return F.lower(F.hex(payload_bytes(payload)))


def payload_size(payload: Column) -> Column:
    return F.length(payload_bytes(payload))


def mtype_name(mtype: Column) -> Column:
    pairs = [F.lit(x) for item in MTYPE_NAMES.items() for x in item]
    return F.element_at(F.create_map(*pairs), mtype)


def _slice(h: Column, start: int, n: int) -> Column:
    """Hex text of bytes ``start`` .. ``start + n - 1``."""
    return F.substring(h, 2 * start + 1, 2 * n)


def _reversed(h: Column, start: int, n: int) -> Column:
    return F.concat(*[_slice(h, start + n - 1 - i, 1) for i in range(n)])


def _unsigned(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("int")


def _bit(byte: Column, mask: int) -> Column:
    return byte.bitwiseAND(F.lit(mask)) != 0


def mtype(h: Column) -> Column:
    return F.shiftright(_unsigned(_slice(h, 0, 1)), 5)


HEADER_COLUMNS = ("_n", "_b0", "_b5", "_mt")


def with_header(df: DataFrame, h: str) -> DataFrame:
    """Add the working columns every field is read from: size, first byte, control byte, message type.

    Each is a column of its own so that it is computed once per frame, and so
    that the generated code stays in pieces small enough to be compiled.
    """
    text = F.col(h)
    return df.withColumns(
        {
            "_n": F.shiftright(F.length(text), 1),
            "_b0": _unsigned(_slice(text, 0, 1)),
            "_b5": _unsigned(_slice(text, 5, 1)),
        }
    ).withColumn("_mt", F.shiftright("_b0", 5))


def phy_payload(h: Column) -> Column:
    """The decoded frame, from its hex text and the columns of ``with_header``.

    Conditions sit on the leaves and the structs are never null, so that a
    filter or projection of one field reduces to the expression of that field.
    A frame too short for a header and code has only a length, an empty one nothing.
    """
    n, first, control, mt = (F.col(c) for c in HEADER_COLUMNS)
    whole = n >= MIN_FRAME
    data = (mt > JOIN_ACCEPT) & (n >= MIN_DATA_FRAME)
    uplink = mt.isin(*UPLINKS)
    request = (mt == JOIN_REQUEST) & (n == JOIN_REQUEST_FRAME)
    accept = (mt == JOIN_ACCEPT) & whole
    mac = F.substr(h, F.lit(3), (n - MIN_FRAME) * 2)
    options = control.bitwiseAND(F.lit(0x0F))
    port_at = options + 8
    fctrl = F.struct(
        F.when(data, _bit(control, 0x80)).alias("adr"),
        F.when(data, _bit(control, 0x40)).alias("adrAckReq"),
        F.when(data, _bit(control, 0x20)).alias("ack"),
        F.when(data & uplink, _bit(control, 0x10)).alias("classB"),
        F.when(data & ~uplink, _bit(control, 0x10)).alias("fPending"),
        F.when(data, options).alias("fOptsLen"),
    )
    fhdr = F.struct(
        F.when(data, _reversed(h, 1, 4)).alias("devAddr"),
        F.when(data, _unsigned(_reversed(h, 6, 2))).alias("fCnt"),
        fctrl.alias("fCtrl"),
    )
    return F.struct(
        F.when(n > 0, n).alias("length"),
        F.when(whole, F.right(h, F.lit(8))).alias("mic"),
        F.struct(
            F.when(whole, mt).alias("mType"), F.when(whole, first.bitwiseAND(F.lit(3))).alias("major")
        ).alias("mhdr"),
        F.struct(
            F.when(data & (port_at < n - 4), _unsigned(F.substr(h, port_at * 2 + 1, F.lit(2)))).alias("fPort"),
            fhdr.alias("fhdr"),
            F.when(request, _reversed(h, 1, 8)).alias("appEUI"),
            F.when(request, _reversed(h, 9, 8)).alias("devEUI"),
            F.when(request, _reversed(h, 17, 2)).alias("devNonce"),
            F.when(accept, F.substring(mac, 1, 6)).alias("appnonce"),
            F.when(accept, F.substring(mac, 7, 6)).alias("netid"),
            F.when(accept, F.substring(mac, 13, 8)).alias("devaddr"),
        ).alias("macPayload"),
    )


def content_hash(payload: Column, exact: bool = False) -> Column:
    """Repeatable pseudo-random value of a frame: SHA-256, or SHA3-256 when ``exact``."""
    data = payload_bytes(payload)
    if not exact:
        return F.sha2(data, 256)

    # a local function, so that it is shipped by value
    def sha3(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else hashlib.sha3_256(bytes(b)).hexdigest())

    return F.pandas_udf(StringType())(sha3)(data)


def bad_reason(h: Column, payload: Column) -> Column:
    """Why a frame could not be decoded; null for a decoded one."""
    n = F.length(h) / 2
    mt = mtype(h)
    return (
        F.when(payload.isNull(), "missing_payload")
        .when(h.isNull(), "invalid_base64")
        .when(n < MIN_FRAME, "invalid_length")
        .when((mt == JOIN_REQUEST) & (n != JOIN_REQUEST_FRAME), "join_length")
        .when((mt > JOIN_ACCEPT) & (n < MIN_DATA_FRAME), "short_mac")
    )
