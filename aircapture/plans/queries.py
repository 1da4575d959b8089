"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from aircapture import schema
from aircapture.functions import frame, predicates as P, text
from aircapture.operators import aggregates as A
from aircapture.operators import decode as E
from aircapture.operators import duplicates as D
from aircapture.operators import flows as W
from aircapture.operators import joins as J
from aircapture.operators import maintenance as M
from aircapture.operators import sampling as K
from aircapture.operators import statistics as X
from aircapture.operators.flowruns import FlowRuns
from aircapture.plans import relations as R
from aircapture.session import scratch_path
from aircapture.sources import dumps, flowstore
from aircapture.sources.lookup import Lookup, write_lookup
from aircapture.sources.operators import packaged_operators, read_operators
from aircapture.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LO, HI = "2024-01-05", "2024-01-09"
SPLIT = "2024-01-16"
SINCE = "2024-01-10"
LOOKUP_EVENT = "500-0"
DEVICE = "03676b8e"  # the fourth device address of the derived relation


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        return fn

    return register


def _plain(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock time, so that no client applies a zone to them."""
    stamps = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, TimestampType)}
    return df.withColumns(stamps) if stamps else df


def _r(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _flat(df: DataFrame) -> DataFrame:
    """Packets with their main fields under flat names."""
    lora = R.LORA
    return df.select(
        "_id", "time", "phyPayload", "src_version",
        F.col("rxInfo.gatewayId").alias("gateway"),
        F.col("rxInfo.rssi").alias("rssi"),
        F.col("rxInfo.snr").alias("snr"),
        F.col("rxInfo.channel").alias("channel"),
        F.col("rxInfo.crcStatus").alias("crc"),
        F.col("txInfo.frequency").alias("frequency"),
        F.col("txInfo.modulation.type").alias("modulation"),
        F.col(f"{lora}.bandwidth").alias("bandwidth"),
        F.col(f"{lora}.spreadingFactor").alias("sf"),
        F.col(f"{lora}.codeRate").alias("code_rate"),
    )


# ---------------------------------------------------------------- sources and upkeep


@query("s1_read_packet_dump")
def _(spark, sf):
    path = scratch_path(spark, "dump")
    dumps.write_packet_dump(R.packets(spark, sf), path)
    return _flat(dumps.read_packet_dump(spark, path))


@query("s2_export_monthly")
def _(spark, sf):
    path = scratch_path(spark, "export")
    dumps.export_monthly(R.packets(spark, sf), path)
    back = spark.read.schema("_id string, year int, month int").json(path)
    return back.groupBy("year", "month").agg(F.count("*").alias("docs"), F.countDistinct("_id").alias("ids"))


@query("s3_normalise_v3")
def _(spark, sf):
    rows = M.normalise_v3(R.as_v3(R.packets(spark, sf)))
    return rows.select(
        "_id", "time", "src_version",
        F.col("rxInfo.gatewayId").alias("gateway"),
        F.col("rxInfo.snr").alias("snr"),
        F.col("rxInfo.uplinkIdText").alias("uplink"),
        F.col("txInfo.modulation.type").alias("modulation"),
        F.col(f"{R.LORA}.codeRate").alias("code_rate"),
        F.col(f"{R.LORA}.spreadingFactor").alias("sf"),
    )


@query("s4_normalise_v4")
def _(spark, sf):
    return _flat(M.normalise_v4(R.as_v4(R.packets(spark, sf))))


@query("s4_normalise_v4_receptions")
def _(spark, sf):
    rows = M.normalise_v4(R.as_v4_lists(R.packets(spark, sf)), explode=True)
    return _flat(rows).select("_id", "time", "src_version", "gateway", "rssi", "snr", "modulation", "sf")


@query("s4_dropped_receptions")
def _(spark, sf):
    return M.dropped_receptions(R.as_v4_lists(R.packets(spark, sf)))


@query("s5_unify")
def _(spark, sf):
    rows = R.packets(spark, sf)
    old = M.normalise_v3(R.as_v3(rows.where(P.time_between(None, "2024-01-15"))))
    new = M.normalise_v4(R.as_v4(rows.where(P.time_between(SPLIT, None))))
    return _flat(M.unify(old, new))


@query("s6_anonymise")
def _(spark, sf):
    rows = M.anonymise(R.packets(spark, sf))
    return rows.select("_id", "time", F.col("rxInfo.gatewayId_hash").alias("gateway_hash"), F.col("rxInfo.rssi").alias("rssi"))


@query("s7_subset_period")
def _(spark, sf):
    return _flat(M.subset_period(R.packets(spark, sf), LO, HI))


@query("s8_delete_from_table")
def _(spark, sf):
    path = scratch_path(spark, "months")
    dumps.with_month(R.packets(spark, sf)).write.partitionBy("year", "month").parquet(path)
    M.delete_period_from_table(spark, path, LO, HI)
    return _flat(spark.read.parquet(path))


@query("s8_delete_period")
def _(spark, sf):
    return _flat(M.delete_period(R.packets(spark, sf), LO, HI))


@query("s10_write_read_flows")
def _(spark, sf):
    path = scratch_path(spark, "flows")
    flowstore.write_flows(R.flows(spark, sf), path)
    return _flow_columns(flowstore.read_flows(spark, path))


@query("s11_write_read_flow_packets")
def _(spark, sf):
    path = scratch_path(spark, "series")
    flowstore.write_flow_packets(R.flow_packets(spark, sf), path)
    return _packet_columns(flowstore.read_flow_packets(spark, path))


@query("s12_upsert")
def _(spark, sf):
    base = R.packets(spark, sf)
    changed = base.where(P.time_between(LO, HI)).withColumn("src_version", F.lit(5))
    added = base.where(F.col("rxInfo.channel") == 7).withColumn("_id", F.concat("_id", F.lit("-new")))
    return _flat(M.upsert(base, changed.unionByName(added)))


@query("s13_parse_time")
def _(spark, sf):
    t = F.col("time")
    us = F.date_format(t, "SSSSSS")
    stem = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    shape = F.pmod(F.unix_micros(t), F.lit(5))
    written = (
        F.when(shape == 0, F.concat(stem, F.lit("Z")))
        .when(shape == 1, F.concat(stem, F.lit("."), F.substring(us, 1, 3), F.lit("Z")))
        .when(shape == 2, F.concat(stem, F.lit("."), us, F.lit("Z")))
        .when(shape == 3, F.concat(stem, F.lit("."), us, F.lit("789Z")))
        .otherwise(F.concat(stem, F.lit("."), us))
    )
    return R.packets(spark, sf).select("_id", text.parse_time(written).alias("parsed"))


# ---------------------------------------------------------------- predicates


def _ids(df: DataFrame) -> DataFrame:
    return df.select("_id")


@query("f1_has_extra")
def _(spark, sf):
    rows = R.enriched(spark, sf)
    rows = rows.withColumn("rxInfo", F.col("rxInfo").withField("modulation", F.col("txInfo.modulation.type")))
    return _ids(rows.where(P.has_extra()))


def _register_predicate(name: str, condition: Callable[[], Column], relation=R.enriched):
    query(name)(lambda spark, sf: _ids(relation(spark, sf).where(condition())))


_register_predicate("f2_has_extra_nodup", P.has_extra_nodup)
_register_predicate("f4_not_data", P.not_data)
_register_predicate("f5_data", P.data)
_register_predicate("f6_data_with_channel", P.data_with_channel)
_register_predicate("f7_data_for_device", lambda: P.data_for_device(DEVICE))
_register_predicate("f8_all_ok", P.all_ok, R.packets)
_register_predicate("f9_all_ok_nodup", P.all_ok_nodup, R.enriched)
_register_predicate("f11_time_between", lambda: P.time_between(LO, HI), R.packets)


@query("f3_needs_decode")
def _(spark, sf):
    rows = R.enriched(spark, sf)
    old = F.when(F.col("time") < SINCE, F.lit("1.0")).otherwise(F.col("extra_infos.version"))
    rows = rows.withColumn("extra_infos", F.col("extra_infos").withField("version", old))
    return _ids(rows.where(P.needs_decode()))


@query("f10_needs_dup_flag")
def _(spark, sf):
    rows = R.enriched(spark, sf)
    old = F.when(F.col("rxInfo.channel") < 3, F.lit("0.9")).otherwise(F.col("dup_infos.version"))
    rows = rows.withColumn("dup_infos", F.col("dup_infos").withField("version", old))
    return _ids(rows.where(P.needs_dup_flag(start=SINCE)))


@query("f12_lookup_id")
def _(spark, sf):
    return _flat(K.lookup_id(R.packets(spark, sf), LOOKUP_EVENT))


@query("f12_lookup_payload")
def _(spark, sf):
    rows = R.packets(spark, sf)
    one = rows.agg(F.min("phyPayload").alias("p")).scalar()
    return _flat(K.lookup_payload(rows, one))


@query("f13_match_any_token")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.where(P.match_any_token("text", "License, network!")).select("doc_id")


@query("f14_device_packets")
def _(spark, sf):
    return K.device_packets(R.enriched(spark, sf), DEVICE)


def _packet_lookup(spark: SparkSession, sf: str) -> Lookup:
    keys = {"payload": F.array("phyPayload"), "device": F.array(P.DEVADDR)}
    return write_lookup(R.enriched(spark, sf), scratch_path(spark, "lookup"), "_id", keys, 16)


@query("f12_indexed_id")
def _(spark, sf):
    return _flat(_packet_lookup(spark, sf).by_id(LOOKUP_EVENT))


@query("f12_indexed_payload")
def _(spark, sf):
    one = R.packets(spark, sf).agg(F.min("phyPayload")).first()[0]
    return _flat(_packet_lookup(spark, sf).by_key("payload", one))


@query("f13_indexed_tokens")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = write_lookup(docs, scratch_path(spark, "lookup"), "doc_id", {"text": text.tokens(F.col("text"))}, 16)
    return index.by_any_token("text", "License, network!").select("doc_id")


@query("f14_indexed_device")
def _(spark, sf):
    return K.device_packets(_packet_lookup(spark, sf).by_key("device", DEVICE), DEVICE)


@query("f15_first_unflagged_payload")
def _(spark, sf):
    rows = R.enriched(spark, sf)
    todo = F.when(F.col("rxInfo.channel") != 3, F.col("dup_infos"))
    return K.first_unflagged_payload(rows.withColumn("dup_infos", todo))


@query("f15_undecoded")
def _(spark, sf):
    return K.undecoded(R.enriched(spark, sf)).select("_id", "time", "phyPayload")


@query("f16_flow_quality")
def _(spark, sf):
    return R.flows(spark, sf).where(P.flow_quality(5)).select("devAddr", "flow_id", "nb_pkts")


@query("f17_drop_incomplete")
def _(spark, sf):
    rows = K.flatten_fields(R.packets(spark, sf))
    holes = rows.withColumns(
        {
            "rssi": F.when(F.col("channel") != 2, F.col("rssi")),
            "loRaSNR": F.when(F.col("spreadingFactor") != 9, F.col("loRaSNR")),
        }
    )
    return K.drop_incomplete(holes).select("_id", "rssi", "loRaSNR", "channel", "spreadingFactor")


@query("p1_flatten_hits")
def _(spark, sf):
    rows = R.packets(spark, sf)
    listed = rows.withColumn("rxInfo", F.col("rxInfo").withField("rssi", F.array("rxInfo.rssi")))
    return K.flatten_fields(listed)


# ---------------------------------------------------------------- decoding

_MAC = "extra_infos.phyPayload.macPayload"


@query("e1_decode_frames")
def _(spark, sf):
    fhdr, fc = f"{_MAC}.fhdr", f"{_MAC}.fhdr.fCtrl"
    return E.decode_frames(R.reshaped_frames(spark, sf)).select(
        "_id",
        F.col("extra_infos.version").alias("version"),
        F.col("extra_infos.phyPayload.length").alias("length"),
        F.col("extra_infos.phyPayload.mic").alias("mic"),
        F.col("extra_infos.phyPayload.mhdr.mType").alias("mtype"),
        F.col("extra_infos.phyPayload.mhdr.major").alias("major"),
        F.col(f"{_MAC}.fPort").alias("fport"),
        F.col(f"{fhdr}.devAddr").alias("dev_addr"),
        F.col(f"{fhdr}.fCnt").alias("fcnt"),
        *[F.col(f"{fc}.{n}").alias(n) for n in ("adr", "adrAckReq", "ack", "classB", "fPending", "fOptsLen")],
        *[F.col(f"{_MAC}.{n}").alias(n) for n in ("appEUI", "devEUI", "devNonce", "appnonce", "netid")],
        F.col(f"{_MAC}.devaddr").alias("join_devaddr"),
    )


@query("e2_mhdr")
def _(spark, sf):
    return E.decode_frames(R.packets(spark, sf)).select(
        "_id",
        F.col("extra_infos.phyPayload.mhdr.mType").alias("mtype"),
        F.col("extra_infos.phyPayload.mhdr.major").alias("major"),
        F.col("extra_infos.phyPayload.mic").alias("mic"),
        F.col("extra_infos.phyPayload.length").alias("length"),
    )


@query("e3_length_class")
def _(spark, sf):
    body = F.col("extra_infos.phyPayload")
    kind = F.when(body["length"].isNull(), "empty").when(body["mic"].isNull(), "too_short").otherwise("decoded")
    return E.decode_frames(R.reshaped_frames(spark, sf)).groupBy(kind.alias("class")).agg(F.count("*").alias("count"))


@query("e4_join_request")
def _(spark, sf):
    rows = E.decode_frames(R.packets(spark, sf)).where(F.col(P.MTYPE) == frame.JOIN_REQUEST)
    return rows.select("_id", *[F.col(f"{_MAC}.{n}").alias(n) for n in ("appEUI", "devEUI", "devNonce")])


@query("e5_join_accept")
def _(spark, sf):
    rows = E.decode_frames(R.reshaped_frames(spark, sf)).where(F.col(P.MTYPE) == frame.JOIN_ACCEPT)
    names = {"appnonce": "appnonce", "netid": "netid", "devaddr": "join_devaddr"}
    return rows.select("_id", *[F.col(f"{_MAC}.{n}").alias(a) for n, a in names.items()])


@query("e6_data_frame")
def _(spark, sf):
    rows = E.decode_frames(R.packets(spark, sf)).where(F.col(P.DEVADDR).isNotNull())
    return rows.select(
        "_id", F.col(P.DEVADDR).alias("dev_addr"), F.col(f"{_MAC}.fhdr.fCnt").alias("fcnt"), F.col(f"{_MAC}.fPort").alias("fport")
    )


@query("e7_fctrl")
def _(spark, sf):
    names = ("adr", "adrAckReq", "ack", "classB", "fPending", "fOptsLen")
    rows = E.decode_frames(R.reshaped_frames(spark, sf)).where(F.col(P.DEVADDR).isNotNull())
    flat = rows.select(*[F.col(f"{_MAC}.fhdr.fCtrl.{n}").alias(n) for n in names])
    return flat.groupBy(*names).agg(F.count("*").alias("count"))


@query("e8_content_hash")
def _(spark, sf):
    return R.packets(spark, sf).select("_id", frame.content_hash(F.col("phyPayload")).alias("random"))


@query("e9_mtype_name")
def _(spark, sf):
    rows = E.decode_frames(R.reshaped_frames(spark, sf))
    return rows.groupBy(frame.mtype_name(F.col(P.MTYPE)).alias("name")).agg(F.count("*").alias("count"))


@query("e10_bad_frames")
def _(spark, sf):
    return E.bad_frames(R.packets(spark, sf).select("phyPayload").unionByName(R.reshaped_frames(spark, sf).select("phyPayload")))


@query("e11_decode_incremental")
def _(spark, sf):
    rows = R.packets(spark, sf)
    done = E.decode_frames(rows, version="1.0")
    started = done.withColumn("extra_infos", F.when(F.col("time") < SINCE, F.col("extra_infos")))
    fresh = E.decode_incremental(started)
    return fresh.select(
        "_id", F.col("extra_infos.version").alias("version"), F.col(P.DEVADDR).alias("dev_addr"), F.col(P.MTYPE).alias("mtype")
    )


# ---------------------------------------------------------------- duplicates


def _flags(df: DataFrame) -> DataFrame:
    return df.select(
        "_id",
        F.col("dup_infos.version").alias("version"),
        F.col("dup_infos.is_duplicate").alias("is_duplicate"),
        F.col("dup_infos.copy_of").alias("copy_of"),
    )


@query("d1_flag_duplicates")
def _(spark, sf):
    return _flags(D.flag_duplicates(R.packets(spark, sf)))


@query("d1_flag_duplicates_strict")
def _(spark, sf):
    return _flags(D.flag_duplicates(R.packets(spark, sf), strict_keys=True))


@query("d1_flag_duplicates_sliced")
def _(spark, sf):
    # every payload with three receptions counts as heavy
    return _flags(D.flag_duplicates(R.packets(spark, sf), hot_min_rows=3, slice_rows=2))


@query("d1_flag_incremental")
def _(spark, sf):
    # the first half was flagged by an earlier run
    rows = R.packets(spark, sf)
    before = D.flag_duplicates(rows.where(F.col("time") < SPLIT))
    path = scratch_path(spark, "flagged")
    M.unify(before, rows.where(F.col("time") >= SPLIT)).write.parquet(path)
    base = spark.read.parquet(path)
    return _flags(M.upsert(base, D.flag_incremental(base)))


@query("d1_flag_incremental_late")
def _(spark, sf):
    # rows of any time arrive late, and some have no payload or no time
    event = F.split("_id", "-")[0].cast("long")
    bare = F.pmod(event, F.lit(97))
    rows = R.packets(spark, sf).withColumns(
        {"phyPayload": F.when(bare != 1, F.col("phyPayload")), "time": F.when(bare != 2, F.col("time"))}
    )
    late = F.pmod(event, F.lit(5)) == 0
    path = scratch_path(spark, "flagged")
    M.unify(D.flag_duplicates(rows.where(~late)), rows.where(late)).write.parquet(path)
    base = spark.read.parquet(path)
    return _flags(M.upsert(base, D.flag_incremental(base)))


def _message_rows(df: DataFrame) -> DataFrame:
    return df.select("_id", "message_id")


@query("d2_assign_messages")
def _(spark, sf):
    return _message_rows(D.assign_messages(R.gateway_rx(spark, sf)))


@query("d2_assign_messages_150ms")
def _(spark, sf):
    # a window shorter than the spread of the copies, so that messages are anchored inside chains
    return _message_rows(D.assign_messages(R.gateway_rx(spark, sf), window_ms=150))


@query("d2_assign_messages_sliced")
def _(spark, sf):
    return _message_rows(D.assign_messages(R.gateway_rx(spark, sf), hot_min_rows=3, slice_rows=2))


def _collapsed(messages: DataFrame) -> DataFrame:
    rx = F.col("rxInfo")
    return messages.select(
        "_id", "phyPayload", "frequency", F.col("codeRate").alias("code_rate"),
        F.size(rx).alias("receptions"),
        F.array_join(F.transform(rx, lambda x: x["mac"]), ",").alias("gateways"),
        F.array_max(F.transform(rx, lambda x: x["rssi"])).alias("best_rssi"),
    )


@query("d2_collapse_receptions")
def _(spark, sf):
    return _collapsed(D.collapse_receptions(R.gateway_rx(spark, sf)))


@query("d2_receptions")
def _(spark, sf):
    rows = D.message_receptions(R.gateway_rx(spark, sf))
    return rows.select("message_id", "position", "_id", "time", F.col("mac").alias("gateway"), "rssi")


@query("d3_reception_stats")
def _(spark, sf):
    return D.reception_stats(D.assign_messages(R.gateway_rx(spark, sf)))


def _half_flagged(spark, sf) -> DataFrame:
    """Packets of which those from SPLIT on have no flag yet."""
    flag = F.when(F.col("time") < SPLIT, F.col("dup_infos"))
    return R.enriched(spark, sf).withColumn("dup_infos", flag)


@query("d4_payload_inventory")
def _(spark, sf):
    return D.payload_inventory(_half_flagged(spark, sf))


@query("d5_candidate_window")
def _(spark, sf):
    return _ids(D.candidate_window(_half_flagged(spark, sf)))


@query("d6_dups_per_original")
def _(spark, sf):
    return D.dups_per_original(R.enriched(spark, sf))


# ---------------------------------------------------------------- flows


def _packet_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "devAddr", "flow_id", "time_1st", _r("interpkt_time_ms").alias("interpkt_time_ms"), "fCnt_diff", "fCnt", "SF",
        "time", "phyPayload", "_id", "nb_duplicates",
    )


def _flow_columns(df: DataFrame) -> DataFrame:
    rounded = {
        n: _r(n)
        for n in ("mean_fCnt_diff", "median_fCnt_diff", "median_interpkt_time_ms", "max_interpkt_time_ms", "min_interpkt_time_ms")
    }
    return df.select(*schema.FLOW_COLUMNS).withColumns(rounded)


@query("w1_device_list")
def _(spark, sf):
    return W.device_list(R.enriched(spark, sf))


@query("w2_assign_flows")
def _(spark, sf):
    told = W.assign_flows(W.flow_input(R.enriched(spark, sf)))
    return told.select("devAddr", "_id", "flow_id")


@query("w2_assign_flows_epochs")
def _(spark, sf):
    # the busier devices count as heavy and are folded in a few epochs
    packets = W.flow_input(R.enriched(spark, sf))
    mean = packets.where("not is_duplicate").groupBy("devAddr").count().agg(F.avg("count")).first()[0] or 1
    return W.assign_flows(packets, hot_min_rows=int(mean), epoch_rows=int(mean / 2) + 1).select("devAddr", "_id", "flow_id")


def _in_two_runs(spark: SparkSession, sf: str, first: str, second: str) -> FlowRuns:
    runs, packets = FlowRuns(spark, scratch_path(spark, "flow-runs")), W.flow_input(R.enriched(spark, sf))
    for part in (first, second):
        runs.add(packets.where(f"time {part} timestamp '{SPLIT}'"))
    return runs


@query("w2_continued_flows")
def _(spark, sf):
    # two deliveries, the second of which goes on from the states of the first
    return _packet_columns(_in_two_runs(spark, sf, "<", ">=").flow_packets())


@query("w2_late_packets")
def _(spark, sf):
    # the later delivery comes first, so what its devices have sent before is late
    return _in_two_runs(spark, sf, ">=", "<").late_packets().select("devAddr", "_id")


@query("w6_changed_flows")
def _(spark, sf):
    return _flow_columns(_in_two_runs(spark, sf, "<", ">=").changed_flows())


@query("w3_flow_packets")
def _(spark, sf):
    told = W.assign_flows(W.flow_input(R.enriched(spark, sf)))
    return told.withColumn("interpkt_time_ms", _r("interpkt_time_ms"))


@query("w4_attach_duplicates")
def _(spark, sf):
    return _packet_columns(W.infer_flow_packets(R.enriched(spark, sf)))


@query("w4_unmatched_duplicates")
def _(spark, sf):
    # flows of the first half only, so that the copies of the rest have no original
    packets = W.flow_input(R.enriched(spark, sf))
    told = W.assign_flows(packets.where(F.col("time") < SPLIT))
    return _ids(W.unmatched_duplicates(told, packets))


@query("w5_summarise_flows")
def _(spark, sf):
    return _flow_columns(R.flows(spark, sf))


@query("w6_pending_devices")
def _(spark, sf):
    rows = R.enriched(spark, sf)
    done = W.flow_input(rows).where(F.col("time") < "2024-01-02").select("devAddr")
    return W.pending_devices(W.device_list(rows), done)


@query("w7_flow_lookup")
def _(spark, sf):
    path = scratch_path(spark, "series")
    flowstore.write_flow_packets(R.flow_packets(spark, sf), path)
    return _packet_columns(W.flow_lookup(flowstore.read_flow_packets(spark, path, DEVICE), DEVICE))


@query("w7_flow_lookup_first")
def _(spark, sf):
    path = scratch_path(spark, "series")
    flowstore.write_flow_packets(R.flow_packets(spark, sf), path)
    device = flowstore.read_flow_packets(spark, path, DEVICE)
    began = device.agg(F.max("time_1st")).first()[0]
    return _packet_columns(W.flow_lookup(flowstore.read_flow_packets(spark, path, DEVICE, began), DEVICE, began))


# ---------------------------------------------------------------- joins


@query("s9_read_operators")
def _(spark, sf):
    # the table as a file, as a user has it, on the addresses of the data
    path = scratch_path(spark, "operators")
    lines = packaged_operators(spark).select(F.concat_ws("\t", "netid", "prefix", "range", "name", F.coalesce("area", F.lit(""))))
    lines.coalesce(1).write.text(path)
    rows = R.enriched(spark, sf).where(F.col(P.DEVADDR).isNotNull()).select(F.col(P.DEVADDR).alias("devAddr"))
    ops = read_operators(spark, path, header=False)
    return J.with_operator(rows, ops).groupBy("operator").agg(F.count("*").alias("docs"))


@query("j1_with_operator_overlap")
def _(spark, sf):
    # later rows: one over everything, then two over parts of it
    rows = R.enriched(spark, sf).where(F.col(P.DEVADDR).isNotNull()).select("_id", F.col(P.DEVADDR).alias("devAddr"))
    whole, low, mid = ("all", 0, 2**32 - 1), ("low", 0, 2**26), ("mid", 2**25, 2**27 + 5)
    ops = spark.createDataFrame([whole, low, mid], "name string, lo long, hi long").coalesce(1)
    return J.with_operator(rows, ops)


@query("j1_with_operator")
def _(spark, sf):
    rows = R.enriched(spark, sf).where(F.col(P.DEVADDR).isNotNull()).select("_id", F.col(P.DEVADDR).alias("devAddr"))
    return J.with_operator(rows, packaged_operators(spark))


@query("j2_shorten_names")
def _(spark, sf):
    rows = W.device_list(R.enriched(spark, sf)).select("devAddr")
    return J.shorten_names(J.with_operator(rows, packaged_operators(spark)))


@query("j3_duplicate_to_original")
def _(spark, sf):
    return J.duplicate_to_original(R.enriched(spark, sf))


@query("j4_flow_series")
def _(spark, sf):
    told = R.flow_packets(spark, sf)
    kept = W.summarise_flows(told).where(P.flow_quality(5))
    return W.flow_series(kept, told).select("devAddr", "flow_id", "_id")


@query("j5_skip_processed")
def _(spark, sf):
    rows = W.flow_input(R.enriched(spark, sf))
    done = rows.where(F.col("time") < "2024-01-02").select("devAddr").distinct()
    return _ids(rows.join(done, "devAddr", "left_anti"))


@query("j6_payload_batch")
def _(spark, sf):
    rows = R.packets(spark, sf)
    return _ids(D.payload_batch(rows, rows.where(F.col("rxInfo.gatewayId") == "gw1")))


# ---------------------------------------------------------------- aggregates


@query("a1_nested_counts")
def _(spark, sf):
    rows = R.enriched(spark, sf)
    return A.nested_counts(
        rows, P.DEVADDR, "rxInfo.gatewayId", 10, 3, {"best_rssi": F.max("rxInfo.rssi")}, ("devAddr", "gateway")
    )


@query("a1_nested_counts_lineitem")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return A.nested_counts(items, "l_suppkey", "l_partkey", 10, 10, names=("l_suppkey", "l_partkey"))


@query("a2_weekly_by_sf")
def _(spark, sf):
    return A.weekly_by_sf(R.enriched(spark, sf))


@query("a3_weekly_by_modulation")
def _(spark, sf):
    return A.weekly_by_modulation(R.enriched(spark, sf))


@query("a4_per_weekday_per_day")
def _(spark, sf):
    return A.per_weekday_per_day(R.enriched(spark, sf))


@query("a5_per_hour_per_day")
def _(spark, sf):
    return A.per_hour_per_day(R.enriched(spark, sf))


@query("a6_per_weekday")
def _(spark, sf):
    return A.per_weekday(R.packets(spark, sf), LO, "2024-01-25")


@query("a6_per_hour")
def _(spark, sf):
    return A.per_hour(R.packets(spark, sf), LO, HI)


@query("a7_am_pm")
def _(spark, sf):
    return A.am_pm(R.packets(spark, sf), LO, HI)


@query("a8_day_night")
def _(spark, sf):
    return A.day_night(R.packets(spark, sf), LO, HI)


@query("a9_per_mtype")
def _(spark, sf):
    return A.per_mtype(R.enriched(spark, sf))


@query("a_traffic_cube")
def _(spark, sf):
    return A.traffic_cube(R.enriched(spark, sf), LO, HI)


@query("a10_gateway_first_seen")
def _(spark, sf):
    return A.gateway_first_seen(R.enriched(spark, sf))


@query("a11_per_device_gateway")
def _(spark, sf):
    return A.per_device_gateway(R.enriched(spark, sf))


@query("a12_per_deveui_gateway")
def _(spark, sf):
    return A.per_deveui_gateway(R.enriched(spark, sf))


@query("a13_class_ack_matrix")
def _(spark, sf):
    return A.class_ack_matrix(R.enriched(spark, sf)).withColumns(
        {"share": _r("share"), "share_of_class": _r("share_of_class")}
    )


@query("a14_operator_traffic")
def _(spark, sf):
    return A.operator_traffic(R.enriched(spark, sf), packaged_operators(spark))


@query("a15_dups_by_hour")
def _(spark, sf):
    return A.dups_by_hour(R.flow_packets(spark, sf))


@query("a16_progress")
def _(spark, sf):
    return A.progress(R.enriched(spark, sf), SINCE)


@query("a17_packet_sizes")
def _(spark, sf):
    return A.packet_sizes(R.enriched(spark, sf))


# ---------------------------------------------------------------- statistics


def _ecdf(df: DataFrame) -> DataFrame:
    return df.withColumn("ecdf", _r("ecdf", 9))


@query("x1_ecdf_packet_size")
def _(spark, sf):
    return _ecdf(X.ecdf(A.packet_sizes(R.enriched(spark, sf)), "size"))


@query("x1_ecdf_device_gateway")
def _(spark, sf):
    return _ecdf(X.ecdf(A.per_device_gateway(R.enriched(spark, sf)), "count", by=["gatewayId"]))


@query("x1_ecdf_lineitem_price")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_returnflag"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("long").alias("q")
    )
    return _ecdf(X.ecdf(items, "price", "q", ["l_returnflag"]))


@query("x2_prr_span")
def _(spark, sf):
    return X.prr_span(R.flows(spark, sf)).select("devAddr", "flow_id", _r("prr").alias("prr"))


@query("x3_prr_by_sf")
def _(spark, sf):
    told = R.flow_packets(spark, sf)
    kept = W.summarise_flows(told).where(P.flow_quality(5))
    return _ecdf(X.prr_by_sf(kept, told)).withColumn("prr", _r("prr", 9))


@query("x4_prr_vs_dups")
def _(spark, sf):
    told = R.flow_packets(spark, sf)
    kept = W.summarise_flows(told).where(P.flow_quality(5))
    return X.prr_vs_dups(kept, told).withColumns({"prr": _r("prr"), "nb_duplicates": _r("nb_duplicates")})


@query("x5_mean_interpkt")
def _(spark, sf):
    return X.mean_interpkt(R.flows(spark, sf)).select("devAddr", "flow_id", _r("mean_interpkt_time_ms", 3).alias("mean_ms"))


@query("x6_interpkt_ecdf")
def _(spark, sf):
    return _ecdf(X.interpkt_ecdf(R.flows(spark, sf)))


@query("x7_duration_ecdf")
def _(spark, sf):
    return _ecdf(X.duration_ecdf(R.flows(spark, sf)))


@query("x8_flow_interpkt_ecdf")
def _(spark, sf):
    told = R.flow_packets(spark, sf)
    chosen = K.random_flows(W.summarise_flows(told).where(P.flow_quality(5)), 12)
    return _ecdf(X.flow_interpkt_ecdf(chosen, told)).withColumn("seconds", _r("seconds", 9))


@query("x9_pearson")
def _(spark, sf):
    rows = X.mean_interpkt(R.flows(spark, sf).where(P.flow_quality(5)))
    return X.pearson(rows, "mean_interpkt_time_ms", "nb_pkts").select(
        _r("r").alias("r"), "n", _r("t", 4).alias("t"), _r("p").alias("p")
    )


_PAIR = ["mean_fCnt_diff", "median_fCnt_diff", "max_fCnt_diff", "mean_interpkt_time_ms", "median_interpkt_time_ms", "nb_pkts"]


@query("x10_pair_correlations")
def _(spark, sf):
    rows = X.mean_interpkt(R.flows(spark, sf).where(P.flow_quality(5)))
    return X.pair_correlations(rows, _PAIR).withColumn("r", _r("r"))


@query("x10_histogram")
def _(spark, sf):
    return X.histogram(K.flatten_fields(R.packets(spark, sf)), "rssi", 16)


@query("x10_density_grid")
def _(spark, sf):
    return X.density_grid(K.flatten_fields(R.packets(spark, sf)), "rssi", "loRaSNR", 8)


@query("x10_pair_matrix")
def _(spark, sf):
    return X.pair_matrix(X.mean_interpkt(R.flows(spark, sf).where(P.flow_quality(5))), _PAIR)


@query("x10_pair_matrix_links")
def _(spark, sf):
    return X.pair_matrix(K.flatten_fields(R.packets(spark, sf)), ["rssi", "loRaSNR", "channel"], 8)


@query("x11_bootstrap_hour")
def _(spark, sf):
    return _rounded_ci(X.bootstrap_ci(A.per_hour_per_day(R.enriched(spark, sf)), "hour", "day"))


@query("x1_merged_sketches")
def _(spark, sf):
    # stored month by month and merged; told is whether each value lies where the exact distribution has its share
    path, packets = scratch_path(spark, "sketches"), R.packets(spark, sf).withColumn("size", frame.payload_size(F.col("phyPayload")))
    X.monthly_sketches(packets, "size").write.parquet(path)
    found = X.merged_quantiles(spark.read.parquet(path), [0.1, 0.25, 0.5, 0.75, 0.9])
    exact = X.ecdf(packets, "size").select("size", "ecdf", (F.col("ecdf") - F.col("weight") / F.col("total")).alias("below"))
    near = (F.col("ecdf") >= F.col("q") - 0.02) & (F.col("below") <= F.col("q") + 0.02)
    return found.join(exact, found["value"] == exact["size"]).select("q", near.alias("within"))


@query("x11_mean_ci_weekday")
def _(spark, sf):
    return _rounded_ci(X.mean_ci(A.per_weekday_per_day(R.enriched(spark, sf)), "day_of_week"))


@query("x11_mean_ci_hour")
def _(spark, sf):
    return _rounded_ci(X.mean_ci(A.per_hour_per_day(R.enriched(spark, sf)), "hour"))


def _rounded_ci(df: DataFrame) -> DataFrame:
    return df.withColumns({n: _r(n, 5) for n in ("mean", "low", "high")})


@query("x12_dups_ecdf")
def _(spark, sf):
    told = R.flow_packets(spark, sf)
    return _ecdf(X.dups_ecdf(W.summarise_flows(told), told))


# ---------------------------------------------------------------- samples, sorts, pages


@query("k1_hash_sample")
def _(spark, sf):
    return K.link_quality_sample(R.enriched(spark, sf), 1000)


@query("k1_hash_sample_large")
def _(spark, sf):
    return _ids(K.hash_sample(R.packets(spark, sf), 15_000))


@query("k2_random_flows")
def _(spark, sf):
    return K.random_flows(R.flows(spark, sf), 12).select("devAddr", "flow_id", "nb_pkts")


@query("k3_sorts")
def _(spark, sf):
    return R.enriched(spark, sf).orderBy("time", "dup_infos.is_duplicate", "_id").select(
        "_id", "time", F.col("dup_infos.is_duplicate").alias("is_duplicate")
    )


@query("k4_top_k_per_level")
def _(spark, sf):
    return A.per_device_gateway(R.enriched(spark, sf), 15, 2)


@query("k5_page")
def _(spark, sf):
    rows = R.packets(spark, sf).select("time", "_id", "phyPayload")
    return K.page(rows, ["time", "_id"], 500, (dt.datetime(2024, 1, 12), ""))


@query("k5_page_lineitem")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return K.page(items, ["l_orderkey", "l_linenumber"], 1000, (300, 2))


@query("u1_weekday_names")
def _(spark, sf):
    name = F.date_format("time", "EEEE")
    rows = R.packets(spark, sf).groupBy(text.day_index(name).alias("day")).agg(F.count("*").alias("count"))
    return rows.select(
        "day",
        text.day_name(F.col("day"), text.SHORT_DAYS).alias("short"),
        text.day_name(F.col("day"), text.LONG_DAYS).alias("long"),
        "count",
    )


# ---------------------------------------------------------------- streams


def _with_clock(spark: SparkSession, relation: R.Stored, sf: str, kind: Column) -> DataFrame:
    """The stored relation as a stream, and one row of that kind a month later that moves the watermark past all."""
    path = scratch_path(spark, "clock")
    late = relation(spark, sf).where(kind).orderBy(F.desc("time")).limit(1)
    moved = F.col("time") + F.expr("INTERVAL 30 DAYS")
    late = late.withColumns({"_id": F.lit("clock"), "time": moved})
    late.withColumn("rxInfo", F.col("rxInfo").withField("time", F.col("time"))).write.parquet(path)
    clock = spark.readStream.schema(late.schema).parquet(path)
    return relation.stream(spark, sf).unionByName(clock)


def _finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = scratch_path(spark, "stream")
    jobs.run_available(stream, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


def _finished_keyed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    with jobs.state_on_disk(spark):
        return _finished(spark, stream)


@query("t1_stream_decode")
def _(spark, sf):
    return _finished(spark, jobs.stream_decode(R.packets.stream(spark, sf))).select(
        "_id", F.col(P.MTYPE).alias("mtype"), F.col(P.DEVADDR).alias("dev_addr"), F.col(f"{_MAC}.fhdr.fCnt").alias("fcnt")
    )


@query("t2_stream_collapse")
def _(spark, sf):
    receptions = _with_clock(spark, R.packets, sf, F.lit(True)).select(
        "_id", "phyPayload", "time",
        F.col("txInfo.frequency").alias("frequency"),
        F.col(f"{R.LORA}.bandwidth").alias("bandwidth"),
        F.col(f"{R.LORA}.spreadingFactor").alias("spreadFactor"),
        F.col(f"{R.LORA}.codeRate").alias("codeRate"),
    )
    return _message_rows(_finished(spark, jobs.stream_collapse(receptions)))


@query("t2_stream_collapse_rows")
def _(spark, sf):
    receptions = R.as_gateway_rx(_with_clock(spark, R.packets, sf, F.lit(True)))
    return _collapsed(_finished_keyed(spark, jobs.stream_messages(receptions))).where("_id <> 'clock'")


def _flag_rows(flags: DataFrame) -> DataFrame:
    return flags.where("_id <> 'clock'").select("_id", "is_duplicate", "copy_of")


@query("t4_stream_flags")
def _(spark, sf):
    return _flag_rows(_finished_keyed(spark, jobs.stream_flags(_with_clock(spark, R.packets, sf, F.lit(True)))))


@query("t4_stream_flags_strict")
def _(spark, sf):
    return _flag_rows(_finished_keyed(spark, jobs.stream_flags(_with_clock(spark, R.packets, sf, F.lit(True)), strict_keys=True)))


@query("t4_stream_chains")
def _(spark, sf):
    chains = _finished(spark, jobs.stream_chains(_with_clock(spark, R.packets, sf, F.lit(True))))
    return chains.where("copy_of <> 'clock'")


@query("t3_stream_weeks")
def _(spark, sf):
    return _finished(spark, jobs.stream_weekly(_with_clock(spark, R.enriched, sf, P.all_ok_nodup()), P.SF, "SF"))


@query("t3_stream_traffic")
def _(spark, sf):
    hours = _finished(spark, jobs.stream_hourly(_with_clock(spark, R.enriched, sf, P.all_ok_nodup()), P.SF, "SF"))
    return hours.groupBy("SF", text.week_start(F.col("hour_start"), A.ZONE).alias("week")).agg(F.sum("count").alias("count"))
