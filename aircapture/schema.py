"""Explicit schemas, as DDL text. Nothing in the package infers a schema from data."""

from __future__ import annotations

LORA = "struct<bandwidth:bigint,spreadingFactor:int,codeRate:string,polarizationInversion:boolean>"
MODULATION = f"struct<type:string,lora:{LORA}>"
FSK = "struct<datarate:bigint,frequencyDeviation:bigint>"
RX_COMMON = (
    "time:timestamp,rssi:int,channel:int,rfChain:int,board:int,antenna:int,crcStatus:string,context:string,"
    "mac:string,fineTimestampType:string,timeSinceGpsEpoch:string,"
    "location:struct<latitude:double,longitude:double,altitude:double,source:string>,"
    "metadata:struct<region_common_name:string,region_config_id:string>"
)
RX = f"struct<gatewayId:string,snr:double,uplinkId:bigint,uplinkIdText:string,{RX_COMMON}>"
TX = f"struct<frequency:bigint,fskModulationInfo:{FSK},modulation:{MODULATION}>"

FCTRL = "struct<adr:boolean,adrAckReq:boolean,ack:boolean,classB:boolean,fPending:boolean,fOptsLen:int>"
FHDR = f"struct<devAddr:string,fCnt:int,fCtrl:{FCTRL}>"
MAC = (
    f"struct<fPort:int,fhdr:{FHDR},appEUI:string,devEUI:string,devNonce:string,"
    "appnonce:string,netid:string,devaddr:string>"
)
EXTRA = (
    "struct<version:string,random:string,phyPayload:struct<length:int,mic:string,"
    f"mhdr:struct<mType:int,major:int>,macPayload:{MAC}>>"
)
DUP = "struct<version:string,is_duplicate:boolean,copy_of:string>"

#: one reception, the common form of both generations of dumps
PACKET = (
    f"_id string, src_version int, time timestamp, phyPayload string, rxInfo {RX}, txInfo {TX}, "
    f"extra_infos {EXTRA}, dup_infos {DUP}"
)

#: third-generation dump: flat modulation, other field names
PACKET_V3 = (
    "_id string, mqtt_time timestamp, phyPayload string, "
    f"rxInfo struct<gatewayID:string,loRaSNR:double,uplinkID:string,{RX_COMMON}>, "
    "txInfo struct<frequency:bigint,modulation:string,"
    f"loRaModulationInfo:{LORA},fskModulationInfo:{FSK}>"
)

#: fourth-generation dump: rxInfo may be a list of receptions
PACKET_V4 = (
    f"_id string, time timestamp, phyPayload string, rxInfo array<{RX}>, txInfo {TX}"
)

#: raw reception log, the input of the 300 ms collapse
GATEWAY_RX = (
    "_id string, phyPayload string, rxInfo struct<mac:string,time:timestamp,timestamp:bigint,rssi:int,"
    "loRaSNR:double,crcStatus:string,channel:int,rfChain:int,antenna:int,board:int,size:int,"
    "frequency:bigint,codeRate:string,dataRate:struct<bandwidth:bigint,spreadFactor:int,modulation:string>>"
)

#: packets of a flow, in time order
FLOW_PACKET = (
    "devAddr string, flow_id long, time_1st timestamp, interpkt_time_ms double, fCnt_diff long, fCnt long, "
    "SF int, time timestamp, phyPayload string, _id string, nb_duplicates long"
)

#: one row per flow
FLOW = (
    "devAddr string, flow_id long, fCnt_1st long, fCnt_last long, time_1st timestamp, time_last timestamp, "
    "mean_fCnt_diff double, median_fCnt_diff double, max_fCnt_diff long, nb_duplicates long, "
    "median_interpkt_time_ms double, max_interpkt_time_ms double, min_interpkt_time_ms double, nb_pkts long"
)

#: prefix table as shipped by network operators (tab separated)
OPERATORS = ("netid string, prefix string, range string, name string, area string")


FLOW_PACKET_COLUMNS = tuple(part.split()[0] for part in FLOW_PACKET.split(", "))
FLOW_COLUMNS = tuple(part.split()[0] for part in FLOW.split(", "))
