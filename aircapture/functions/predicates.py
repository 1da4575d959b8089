"""Row predicates of the common packet schema.

Each returns a ``Column``; they combine with ``&``, are pushed to the scan where
the source can use them, and treat a missing field as "does not match" except
where the name says ``needs`` or ``not``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from aircapture.functions.frame import DUP_VERSION, EXTRA_VERSION
from aircapture.functions.text import tokens

# Fixed value: the date of the first correct packet of the corpus, for callers that want data from then on only.
DATASET_START = "2020-09-01"

MTYPE = "extra_infos.phyPayload.mhdr.mType"
DEVADDR = "extra_infos.phyPayload.macPayload.fhdr.devAddr"
DEVEUI = "extra_infos.phyPayload.macPayload.devEUI"
SF = "txInfo.modulation.lora.spreadingFactor"
DATA_UP = 2


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _is_date(text: str) -> bool:
    return len(text) == 10


def modulation_is(name: str, field: str = "txInfo.modulation.type") -> Column:
    """Case-insensitive, as analysed text is compared."""
    return F.lower(F.col(field)) == name.lower()


def is_lora(field: str = "txInfo.modulation.type") -> Column:
    return modulation_is("LORA", field)


def crc_ok() -> Column:
    return F.lower(F.col("rxInfo.crcStatus")) == "crc_ok"


def flagged() -> Column:
    return F.col("dup_infos.is_duplicate").isNotNull()


def decoded() -> Column:
    """Decoded fields exist: the version stamp is set on every decoded row."""
    return F.col("extra_infos.version").isNotNull()


def original() -> Column:
    return F.col("dup_infos.is_duplicate") == F.lit(False)


def has_extra(modulation: str = "rxInfo.modulation") -> Column:
    """Decoded LORA rows; the modulation is read from the field used before unification."""
    return decoded() & is_lora(modulation)


def has_extra_nodup() -> Column:
    return original() & decoded() & is_lora()


def needs_decode(version: str = EXTRA_VERSION) -> Column:
    return ~F.col("extra_infos.version").eqNullSafe(F.lit(version)) & is_lora()


def not_data() -> Column:
    return ~F.col(MTYPE).eqNullSafe(F.lit(DATA_UP)) & is_lora()


def _since(start: str | None) -> Column:
    return F.lit(True) if start is None else F.col("time") >= _day(start)


def data(start: str | None = None) -> Column:
    return (F.col(MTYPE) == DATA_UP) & is_lora() & _since(start) & flagged()


def data_with_channel(start: str | None = None) -> Column:
    present = data(start)
    for name in ("rxInfo.channel", "rxInfo.snr", "rxInfo.rssi", "rxInfo.crcStatus", SF):
        present = present & F.col(name).isNotNull()
    return present


def data_for_device(dev_addr: str | None = None) -> Column:
    """Data packets with a duplicate flag, of one device or (``None``) of any known device."""
    # decoded addresses are lower case
    of_device = F.col(DEVADDR).isNotNull() if dev_addr is None else F.col(DEVADDR) == dev_addr.lower()
    return (F.col(MTYPE) == DATA_UP) & of_device & flagged()


def all_ok(start: str | None = None) -> Column:
    return is_lora() & crc_ok() & _since(start)


def all_ok_nodup(start: str | None = None) -> Column:
    return all_ok(start) & original()


def needs_dup_flag(version: str = DUP_VERSION, start: str | None = None) -> Column:
    todo = ~F.col("dup_infos.version").eqNullSafe(F.lit(version))
    return todo if start is None else todo & (F.col("time") >= _day(start))


def time_between(lo: str | None = None, hi: str | None = None, field: str = "time") -> Column:
    """Both ends included; a date as upper end means to the end of that day."""
    t, ok = F.col(field), F.lit(True)
    if lo is not None:
        ok = ok & (t >= _day(lo))
    if hi is not None and _is_date(hi):
        ok = ok & (t < _day((dt.date.fromisoformat(hi) + dt.timedelta(days=1)).isoformat()))
    elif hi is not None:
        ok = ok & (t <= _day(hi))
    return ok


def match_any_token(field: str, text: str) -> Column:
    """At least one word of ``text`` occurs in the field, ignoring case."""
    return F.arrays_overlap(tokens(F.col(field)), tokens(F.lit(text)))


def flow_quality(min_pkts: int = 50, max_mean_fcnt_diff: float = 100) -> Column:
    return (F.col("nb_pkts") >= min_pkts) & (F.col("mean_fCnt_diff") <= max_mean_fcnt_diff)
