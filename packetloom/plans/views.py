"""Log-shaped views of the given tables, for queries and (in the other dialect) for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {"K": "_k", "TS": "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6", "U": "CAST(floor(user_id / 256) AS INT)", "STR": "STRING", "TEXT": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"}
_DUCK = {"K": "CAST(json_extract_string(props, '$.k') AS INT)", "TS": "epoch_us(ts) / 1e6", "U": "(user_id // 256)", "STR": "VARCHAR", "TEXT": "strftime(ts, '%Y-%m-%d %H:%M:%S')"}

_DST = """CASE event_type WHEN 'signup' THEN '203.0.113.10' WHEN 'error' THEN '203.0.113.20'
    WHEN 'click' THEN '198.51.100.5' WHEN 'view' THEN '192.168.1.10' ELSE '224.0.0.251' END"""
_PORT = """CASE {K} % 10 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 4444
    WHEN 5 THEN 8443 WHEN 6 THEN 3389 WHEN 7 THEN 8080 WHEN 8 THEN 6667 ELSE 25 END"""

#: name -> (table, columns)
VIEWS = {
    "conn_v": (
        "events",
        f"""concat('C', event_id) AS uid, {{TS}} AS ts, concat('s', user_id % 2) AS sensor, concat('10.0.', {{U}}, '.', user_id % 256) AS src,
  {_DST} AS dst, {_PORT} AS port,
  CASE {{K}} % 7 WHEN 0 THEN 'ssl' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' WHEN 3 THEN 'ssh' WHEN 4 THEN 'mysql' WHEN 5 THEN 'ssl,http' ELSE NULL END AS service,
  CAST(floor(value * 1000) AS DOUBLE) AS orig_bytes, CAST({{K}} * 10 AS DOUBLE) AS resp_bytes, CAST(value * 60 AS DOUBLE) AS duration""",
    ),
    "dns_v": (
        "events",
        """{TS} AS ts, concat('s', user_id % 2) AS sensor, concat('10.0.', {U}, '.', user_id % 256) AS src, '10.0.255.53' AS resolver, 53 AS port,
  CASE {K} % 4 WHEN 0 THEN concat(substr(md5(CAST(event_id AS {STR})), 1, 30 + {K} % 3), '.tun.example.com')
    WHEN 1 THEN concat('h', {K}, '.', event_type, '.co.uk') WHEN 2 THEN concat(event_type, '.badzone.xyz')
    ELSE concat('www.', event_type, '.example.org') END AS query,
  CASE WHEN event_type = 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat('203.0.113.', {K}) END AS answers""",
    ),
    "http_v": (
        "pages",
        r"""CAST(1704067200 + page_id * 60 AS DOUBLE) AS ts, 's0' AS sensor, concat('H', page_id) AS uid, concat('10.0.0.', page_id % 16) AS src,
  concat('203.0.113.', page_id % 10) AS dst, 80 AS port, regexp_extract(url, '://([^/:]+)', 1) AS host,
  CASE page_id % 11 WHEN 0 THEN '/submit.php' WHEN 1 THEN concat('/ab12C', 100 + page_id % 100) WHEN 2 THEN concat('/files/f', page_id, '.exe')
    ELSE regexp_extract(url, '://[^/]+(/[^#]*)', 1) END AS uri,
  CASE page_id % 5 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'Python-Requests/2' WHEN 2 THEN NULL ELSE 'Mozilla/5.0' END AS user_agent""",
    ),
    "web_v": (
        "events",
        """{TS} AS ts, concat('s', user_id % 2) AS sensor, concat('W', event_id) AS uid, concat('10.0.0.', user_id % 8) AS src,
  CASE event_type WHEN 'signup' THEN '203.0.113.10' WHEN 'error' THEN '203.0.113.20' ELSE '198.51.100.5' END AS dst, 80 AS port,
  concat(event_type, '.example.net') AS host, concat('/p', {K} % 4) AS uri, CAST(floor(value * 1000) AS DOUBLE) AS orig_bytes""",
    ),
    "wide_v": (
        "events",
        f"""event_id AS id, CASE {{K}} % 9 WHEN 0 THEN 'Beacon' WHEN 1 THEN 'Strobe' WHEN 2 THEN 'Suspicious URL' WHEN 3 THEN 'C2 Port' WHEN 4 THEN 'DNS Tunneling'
    WHEN 5 THEN 'TI Hit (Domain)' WHEN 6 THEN 'Malicious JA3' WHEN 7 THEN 'HTTP Beacon' ELSE 'DNS Beacon' END AS type,
  CASE WHEN {{K}} >= 80 THEN 'CRITICAL' WHEN {{K}} >= 60 THEN 'HIGH' WHEN {{K}} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {{K}} AS score, concat('10.0.', {{U}}, '.', user_id % 256) AS src_ip, {_DST} AS dst_ip, CAST({_PORT} AS {{STR}}) AS dst_port,
  CASE WHEN {{K}} % 8 = 3 THEN concat('Spectral signal (informational, unscored): period ', {{K}} * 2, '.5s, x [artifact ', {{K}}, 's suppressed]') ELSE concat('kind=', event_type) END AS detail,
  {{TEXT}} AS timestamp, concat('s', user_id % 2) AS sensor, CASE {{K}} % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'escalated' WHEN 2 THEN 'dismissed' ELSE '' END AS status,
  '' AS analyst, '' AS analyst_note, false AS ioc_match, ({{K}} % 3 = 0) AS is_new, {{TEXT}} AS detected_at, md5(CAST({{K}} % 12 AS {{STR}})) AS ja3,
  CASE WHEN {{K}} % 11 = 0 THEN 'c1' ELSE '' END AS channel, ({{K}} % 4 = 1) AS spectral_rescued, CAST({{K}} % 10 AS DOUBLE) / 10 AS ts_score, CAST({{K}} % 10 AS DOUBLE) / 10 AS ts_raw,
  CAST({{K}} % 7 AS DOUBLE) / 7 AS ts_mm, CAST({{K}} % 6 AS DOUBLE) / 6 AS ts_ent, CAST({{K}} * 10 AS DOUBLE) AS median_interval, {{K}} AS sample_size, {{TS}} AS seen,
  CASE {{K}} % 7 WHEN 0 THEN 'ssl' WHEN 3 THEN '' ELSE 'http' END AS service""",
    ),
    "ssl_v": (
        "events",
        """concat('C', event_id) AS uid, {TS} AS ts, concat('s', user_id % 2) AS sensor, concat('10.0.', {U}, '.', user_id % 256) AS src,
  CASE {K} % 9 WHEN 1 THEN '8.8.8.8' ELSE concat('203.0.113.', {K} % 20) END AS dst, CASE {K} % 3 WHEN 0 THEN 4444 ELSE 443 END AS port,
  CASE {K} % 12 WHEN 0 THEN '72a589da586844d7f0818ce684948eea' ELSE md5(CAST({K} % 12 AS {STR})) END AS ja3,
  CASE WHEN {K} % 5 = 0 THEN NULL ELSE concat('h', {K} % 20, '.example.net') END AS server_name, ({K} % 2 = 0) AS established""",
    ),
    "x509_v": (
        "customer",
        """CAST(1704067200 + c_custkey AS DOUBLE) AS ts, concat('X', c_custkey) AS uid,
  CASE c_custkey % 6 WHEN 0 THEN 'CN=localhost' WHEN 1 THEN concat('CN=', c_name) ELSE concat('CN=host', c_custkey) END AS subject,
  CASE c_custkey % 3 WHEN 0 THEN 'CN=Some CA' WHEN 1 THEN concat('CN=', c_name) ELSE 'CN=Other CA' END AS issuer,
  '1704067200' AS not_before, CAST(1704067200 + 86400 * (c_custkey % 5000) AS {STR}) AS not_after""",
    ),
    "files_v": (
        "documents",
        """CAST(1704067200 + doc_id * 30 AS DOUBLE) AS ts, concat('203.0.113.', doc_id % 50) AS tx, concat('10.0.1.', doc_id % 200) AS rx,
  CASE doc_id % 6 WHEN 0 THEN 'application/x-dosexec' WHEN 1 THEN 'text/html' ELSE 'image/png' END AS mime_type,
  concat(source, CASE doc_id % 9 WHEN 0 THEN '.exe' WHEN 1 THEN '.ps1' ELSE '.png' END) AS filename, md5(text) AS md5""",
    ),
    "notice_v": (
        "orders",
        """CAST(1704067200 + o_orderkey AS DOUBLE) AS ts, concat('N', o_orderkey) AS uid, concat('10.1.0.', o_custkey % 200) AS src, concat('203.0.113.', o_custkey % 7) AS dst,
  CASE o_orderstatus WHEN 'F' THEN 'Scan::Port_Scan' WHEN 'O' THEN 'Weird::Activity' ELSE 'SSH::Password_Guessing' END AS note, o_orderpriority AS msg""",
    ),
    "findings_v": (
        "events",
        f"""event_id AS id, CASE {{K}} % 9 WHEN 0 THEN 'Beacon' WHEN 1 THEN 'Strobe' WHEN 2 THEN 'Data Exfiltration' WHEN 3 THEN 'C2 Port' WHEN 4 THEN 'DNS Tunneling'
    WHEN 5 THEN 'Long Connection' WHEN 6 THEN 'Malicious JA3' WHEN 7 THEN 'HTTP Beacon' ELSE 'Host Risk Score' END AS type,
  CASE WHEN {{K}} >= 80 THEN 'CRITICAL' WHEN {{K}} >= 60 THEN 'HIGH' WHEN {{K}} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {{K}} AS score, concat('10.0.', {{U}}, '.', user_id % 256) AS src_ip, {_DST} AS dst_ip, CAST({_PORT} AS {{STR}}) AS dst_port,
  concat('Events: ', {{K}}, ' | kind=', event_type) AS detail, {{TEXT}} AS timestamp, concat('s', user_id % 2) AS sensor,
  CASE {{K}} % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'escalated' WHEN 2 THEN 'dismissed' ELSE '' END AS status, '' AS analyst, '' AS analyst_note,
  ({{K}} % 7 = 0) AS ioc_match, ({{K}} % 3 = 0) AS is_new, {{TEXT}} AS detected_at, concat('h', {{K}} % 20, '.example.net') AS hostname,
  concat('/u', {{K}} % 4) AS uri, CASE {{K}} % 7 WHEN 0 THEN 'ssl' WHEN 3 THEN 'rfb' ELSE 'http' END AS service,
  CAST(floor(value * 1000) AS DOUBLE) AS orig_bytes, CAST(({{K}} % 4) * 10 AS DOUBLE) AS resp_bytes, {{TS}} AS at""",
    ),
    "staged_v": (
        "events",
        """event_id AS id, CASE {K} % 10 WHEN 0 THEN 'HTTP Beacon' WHEN 1 THEN 'DNS Beacon' WHEN 2 THEN 'Port-Hopping Beacon' WHEN 3 THEN 'Lateral Movement'
    WHEN 4 THEN CASE WHEN {K} % 20 = 4 THEN 'TI Hit (IP)' ELSE 'Malicious JA3' END WHEN 5 THEN 'Strobe' ELSE 'Beacon' END AS type,
  CAST({K} AS INT) AS score, concat('s', user_id % 2) AS sensor, concat('10.0.0.', user_id % 12) AS src_ip,
  CASE WHEN {K} % 10 = 3 THEN concat('10.0.0.', {K} % 12) ELSE concat('203.0.', CAST(floor(event_id / 700) AS INT) % 250, '.', event_id % 200) END AS dst_ip,
  '443' AS dst_port, {TEXT} AS timestamp, ({K} % 3 = 0) AS is_new, '' AS hostname, '' AS uri""",
    ),
}


#: Views most of whose columns rest on the JSON field.
_BY_FIELD = ("dns_v", "wide_v", "ssl_v", "findings_v", "staged_v")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if "{K}" in columns:  # read once a row: the columns ask for it many times
        field = F.get_json_object("props", "$.k").cast("int")
        # Exploded, it isn't copied into the filters on such columns, which would read it anew for every branch.
        source = source.withColumn("_k", F.explode(F.array(field)) if name in _BY_FIELD else field)
    # Spark reads the columns from SQL text, so that both dialects have one source.
    return spark.sql(f"SELECT {_fill(columns, _SPARK)} FROM {{source}}", source=source)


def ctes(*names: str) -> str:
    """The views as a WITH clause without its keyword."""
    return ",\n".join(f"{n} AS (SELECT {_fill(VIEWS[n][1], _DUCK)} FROM {VIEWS[n][0]})" for n in names)


def _fill(text: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        text = text.replace("{" + k + "}", v)
    return text
