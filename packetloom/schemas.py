"""Fixed column sets of the log tables. ``wire`` names are those in the logs."""

#: our name -> (name in the log, kind); kinds: string, double, int, boolean, set (text or array)
_CONNECTION = {"ts": ("ts", "double"), "uid": ("uid", "string"), "src": ("id.orig_h", "string"), "src_port": ("id.orig_p", "int"), "dst": ("id.resp_h", "string"), "port": ("id.resp_p", "int")}

LOGS = {
    "conn": _CONNECTION
    | {c: (c, "string") for c in ("proto", "service", "conn_state")}
    | {c: (c, "double") for c in ("duration", "orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes")},
    "dns": _CONNECTION | {"query": ("query", "string"), "qtype_name": ("qtype_name", "string"), "rcode": ("rcode_name", "string"), "answers": ("answers", "set")},
    "http": _CONNECTION
    | {c: (c, "string") for c in ("method", "host", "uri", "user_agent")}
    | {"status_code": ("status_code", "int"), "resp_mime_types": ("resp_mime_types", "set"), "orig_ip_bytes": ("orig_ip_bytes", "double"), "resp_ip_bytes": ("resp_ip_bytes", "double")},
    "ssl": _CONNECTION | {c: (c, "string") for c in ("version", "cipher", "server_name", "ja3", "ja4", "subject", "issuer")} | {"established": ("established", "boolean")},
    "x509": {
        "ts": ("ts", "double"),
        "uid": ("uid", "string"),
        "subject": ("certificate.subject", "string"),
        "issuer": ("certificate.issuer", "string"),
        "not_before": ("certificate.not_valid_before", "string"),
        "not_after": ("certificate.not_valid_after", "string"),
    },
    "files": {"ts": ("ts", "double"), "fuid": ("fuid", "string"), "tx": ("tx_hosts", "set"), "rx": ("rx_hosts", "set"), "src": ("id.orig_h", "string"), "dst": ("id.resp_h", "string")}
    | {c: (c, "string") for c in ("mime_type", "filename", "md5", "sha1", "sha256")},
    "notice": {"ts": ("ts", "double"), "uid": ("uid", "string"), "src": ("id.orig_h", "string"), "dst": ("id.resp_h", "string"), "note": ("note", "string"), "msg": ("msg", "string")},
}

FINDINGS = (
    "id long, type string, severity string, score int, src_ip string, dst_ip string, dst_port string, detail string, timestamp string, "
    "source_file string, sensor string, status string, analyst string, analyst_note string, status_ts long, ioc_match boolean, ioc_source string, "
    "is_new boolean, detected_at string, hostname string, uri string, correlations array<long>, ts_score double, ds_score double, hist_score double, "
    "dur_score double, ts_raw double, ts_mm double, ts_ent double, spectral_rescued boolean, spectral_period double, mean_interval double, "
    "median_interval double, jitter double, sample_size int, ja3 string, ja4 string, channel string, service string, orig_bytes long, resp_bytes long, "
    "top_uris array<struct<uri:string,count:long>>, ts_data array<struct<ts:double,orig:double,resp:double>>, notes array<string>"
)
