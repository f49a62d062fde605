"""Fixed values that detections rest on: ports, fingerprints, names, patterns and weights.

All tables here are fixed values, given as they must be for right results.
"""

C2_PORTS = {
    1080: "SOCKS proxy",
    3128: "HTTP proxy (Squid)",
    4444: "Metasploit default",
    4445: "Metasploit alt",
    4899: "Radmin RAT",
    6666: "IRC / C2",
    6667: "IRC",
    6668: "IRC",
    6669: "IRC",
    8008: "C2 generic",
    8888: "C2 / JupyterLab",
    9001: "Tor relay",
    9030: "Tor directory",
    31337: "Back Orifice / Elite",
}

BAD_JA4 = {
    "t12i190700_d83cc789557e_16bbda4055b2": "Cobalt Strike v4.9.1 wininet (no SNI)",
    "t12i210700_76e208dd3e22_16bbda4055b2": "Cobalt Strike v4.9.1 winhttp (no SNI)",
    "t12d190800_d83cc789557e_16bbda4055b2": "Cobalt Strike v4.9.1 wininet",
    "t12d210800_76e208dd3e22_16bbda4055b2": "Cobalt Strike v4.9.1 winhttp",
    "t13d201100_2b729b4bf6f3_9e7b989ebec8": "IcedID loader",
}

BAD_JA3 = {
    "72a589da586844d7f0818ce684948eea": "Cobalt Strike beacon",
    "a0e9f5192cc6583673b72155f5a851c1": "Cobalt Strike SMB",
    "e7d705a3286e19ea42f587b344ee6865": "Metasploit/Meterpreter",
    "bc6c386f480f367c02e5d7c0f31d6b3b": "Meterpreter reverse",
    "1aa7bf3b03eb4b20e561a3c9fe46e04a": "Cobalt Strike v4",
    "b386946a5a44d1ddcc843bc75336dfce": "Sliver C2",
    "6bea65232daa92d19e56f2a8c62b2ebf": "Cobalt Strike Malleable",
    "d0ec4b50a944b182f9159c61f5e00da4": "Brute Ratel",
    "f4febc55ea12b31ae17cfb7e8028f33c": "Brute Ratel alt",
}

SUSPICIOUS_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "top", "xyz", "pw", "cc", "to", "biz", "icu", "club", "live", "work", "date", "download",
    "racing", "review", "science", "trade", "win", "stream", "faith", "men", "loan",
)

DOH_RESOLVERS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220",
    "94.140.14.14", "94.140.15.15", "76.76.19.19", "76.223.122.150",
)

DEFAULT_SUBJECTS = (
    "internet widgits", "example.com", "localhost", "default company", "my company", "test", "acme", "openssl", "self-signed", "ca-cert",
)

C2_URIS = (
    (r"^/submit\.php$", "Cobalt Strike /submit.php"),
    (r"^/ca$", "Cobalt Strike /ca"),
    (r"^/dpixel$", "Cobalt Strike /dpixel"),
    (r"^/pixel\.gif$", "Cobalt Strike /pixel.gif"),
    (r"^/ptj$", "Cobalt Strike /ptj"),
    (r"^/j\.ad$", "Cobalt Strike /j.ad"),
    (r"^/updates\.rss$", "Cobalt Strike /updates.rss"),
    (r"^/news\.php$", "Empire /news.php"),
    (r"^/admin/get\.php$", "Empire /admin/get.php"),
    (r"^/login/process\.php$", "Empire /login/process.php"),
    (r"^/[a-zA-Z0-9]{8}$", "Metasploit stager (8-char alphanumeric)"),
)

SUSPICIOUS_AGENTS = ("python-requests", "python-urllib", "curl/", "wget/", "go-http-client", "powershell", "libwww-perl")

SUSPICIOUS_EXTENSIONS = (".exe", ".dll", ".bat", ".ps1", ".vbs", ".js", ".hta", ".scr", ".sh", ".elf", ".com", ".msi")

SUSPICIOUS_MIME = ("application/x-dosexec", "application/x-executable", "application/x-elf", "application/x-msdos-program", "application/octet-stream")

LATERAL_PORTS = (445, 3389, 135, 5985, 5986, 22, 23, 5900)

LATERAL_SERVICES = {"ssh": "SSH", "rdp": "RDP", "rfb": "VNC", "telnet": "Telnet", "smb": "SMB", "dce_rpc": "WMI/RPC"}

ADMIN_SERVICES = {"telnet": "Telnet", "rdp": "RDP", "rfb": "VNC", "ssh": "SSH"}

DATABASE_SERVICES = {"mysql": "MySQL", "postgresql": "PostgreSQL", "mongodb": "MongoDB", "redis": "Redis"}

EXPECTED_PORTS = {
    "http": (80, 8080, 8000, 8008, 8081, 8888, 3128),
    "ssl": (443, 8443, 993, 995, 465, 990, 636, 989, 992, 994, 5061, 853),
    "ssh": (22, 2222),
    "dns": (53, 5353),
    "smtp": (25, 587, 2525),
    "ftp": (20, 21, 2121),
}

SERVICE_CATEGORIES = {
    "ssh": "remoting",
    "rdp": "remoting",
    "rfb": "remoting",
    "telnet": "remoting",
    "http": "web",
    "ssl": "web",
    "smtp": "mail",
    "pop3": "mail",
    "imap": "mail",
    "ftp": "file_transfer",
    "ftp-data": "file_transfer",
    "tftp": "file_transfer",
    "smb": "file_transfer",
    "mysql": "database",
    "postgresql": "database",
    "mongodb": "database",
    "redis": "database",
    "dns": "infra",
    "dhcp": "infra",
    "ntp": "infra",
    "snmp": "infra",
    "ldap": "infra",
    "krb": "infra",
    "krb_tcp": "infra",
    "kerberos": "infra",
    "gssapi": "infra",
    "ntlm": "infra",
    "dce_rpc": "infra",
    "radius": "infra",
}

TECHNIQUES = {
    "T1071": ("Application Layer Protocol", "Command and Control"),
    "T1071.001": ("Application Layer Protocol: Web Protocols", "Command and Control"),
    "T1071.004": ("Application Layer Protocol: DNS", "Command and Control"),
    "T1573": ("Encrypted Channel", "Command and Control"),
    "T1571": ("Non-Standard Port", "Command and Control"),
    "T1572": ("Protocol Tunneling", "Command and Control"),
    "T1090.004": ("Proxy: Domain Fronting", "Command and Control"),
    "T1568.002": ("Dynamic Resolution: Domain Generation Algorithms", "Command and Control"),
    "T1105": ("Ingress Tool Transfer", "Command and Control"),
    "T1048": ("Exfiltration Over Alternative Protocol", "Exfiltration"),
    "T1029": ("Scheduled Transfer", "Exfiltration"),
    "T1021": ("Remote Services", "Lateral Movement"),
}

TYPE_TECHNIQUES = {
    "Beacon": ("T1071",),
    "HTTP Beacon": ("T1071.001",),
    "DNS Beacon": ("T1071.004",),
    "Port-Hopping Beacon": ("T1071", "T1571"),
    "Strobe": ("T1071",),
    "Long Connection": ("T1071",),
    "Data Exfiltration": ("T1048",),
    "Off-Hours Transfer": ("T1029",),
    "Lateral Movement": ("T1021",),
    "DNS Tunneling": ("T1071.004", "T1048"),
    "DNS NXDOMAIN Flood": ("T1568.002",),
    "DNS Subdomain DGA": ("T1568.002",),
    "Protocol Anomaly": ("T1071",),
    "C2 Port": ("T1571",),
    "C2 URI Pattern": ("T1071.001",),
    "Protocol on Unexpected Port": ("T1571",),
    "Admin Protocol Egress": ("T1021",),
    "Database Protocol Egress": ("T1048",),
    "Cobalt Strike URI": ("T1071.001",),
    "Domain Fronting": ("T1090.004",),
    "DoH Bypass": ("T1071.004", "T1572"),
    "Malicious JA3": ("T1573",),
    "Malicious JA4": ("T1573",),
    "Weak TLS": ("T1573",),
    "SSL No-SNI": ("T1573",),
    "SSL No-SNI on C2 Port": ("T1573", "T1571"),
    "Suspicious Certificate": ("T1573",),
    "Suspicious File Download": ("T1105",),
    "Suspicious TLD": ("T1071",),
    "Suspicious UA": ("T1071.001",),
    "Suspicious URL": ("T1071.001",),
    "Multi-Stage Beacon": ("T1071", "T1021"),
}

RISK_WEIGHTS = {
    "Beacon": 30,
    "Port-Hopping Beacon": 30,
    "HTTP Beacon": 28,
    "DNS Beacon": 30,
    "Cobalt Strike URI": 40,
    "C2 URI Pattern": 38,
    "Domain Fronting": 32,
    "Malicious JA3": 40,
    "Malicious JA4": 40,
    "TI Hit (IP)": 35,
    "TI Hit (Domain)": 35,
    "TI Hit (Hash)": 35,
    "Threat Intel Hit": 35,
    "Data Exfiltration": 25,
    "Lateral Movement": 20,
    "Strobe": 15,
    "Long Connection": 10,
    "DNS Tunneling": 35,
    "DNS NXDOMAIN Flood": 18,
    "DNS Subdomain DGA": 22,
    "SSL No-SNI": 15,
    "SSL No-SNI on C2 Port": 30,
    "Suspicious Certificate": 20,
    "Suspicious File Download": 25,
    "Suspicious URL": 30,
    "Suspicious UA": 12,
    "DoH Bypass": 18,
    "C2 Port": 22,
    "Protocol on Unexpected Port": 25,
    "Admin Protocol Egress": 20,
    "Database Protocol Egress": 22,
}

CDN_SUFFIXES = (
    ".cloudfront.net", ".cloudflare.net", ".cloudflare.com", ".azureedge.net", ".azurewebsites.net", ".azurefd.net",
    ".amazonaws.com", ".s3.amazonaws.com", ".elasticloadbalancing.amazonaws.com", ".akamaihd.net", ".akamaized.net",
    ".akamai.net", ".fastly.net", ".fastlylb.net", ".edgekey.net", ".edgesuite.net", ".googleusercontent.com",
    ".googleapis.com", ".gstatic.com", ".doubleclick.net", ".cdninstagram.com", ".fbcdn.net", ".twimg.com", ".cdn-apple.com",
    ".windowsupdate.com", ".windows.net", ".sharepoint.com", ".office.com", ".office365.com", ".live.com", ".herokuapp.com",
    ".github.io", ".githubusercontent.com", ".pages.dev", ".workers.dev", ".vercel.app", ".netlify.app", ".bunnycdn.com",
    ".b-cdn.net", ".keycdn.com",
)

#: Two-label public suffixes of a small curated table; callers with a full list pass their own.
PUBLIC_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.za", "co.in", "com.cn", "com.mx")

ROLLUPS = ("Host Risk Score", "Correlated Activity", "Multi-Stage Beacon")

BEACONS = ("Beacon", "HTTP Beacon", "DNS Beacon", "Port-Hopping Beacon")

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

SERVICE_ALIASES = {"vnc": "rfb", "tls": "ssl", "https": "ssl", "kerberos": "krb"}

#: Types of findings that are indicator hits by themselves.
INDICATOR_TYPES = ("TI Hit (IP)", "TI Hit (Domain)", "TI Hit (Hash)", "Threat Intel Hit", "Suspicious URL")

#: The logs in which a finding's records are.
LOG_TYPES = {
    "Beacon": ("conn",),
    "Port-Hopping Beacon": ("conn",),
    "Long Connection": ("conn",),
    "Strobe": ("conn",),
    "Data Exfiltration": ("conn",),
    "Lateral Movement": ("conn",),
    "C2 Port": ("conn",),
    "Protocol on Unexpected Port": ("conn", "http", "ssl"),
    "Admin Protocol Egress": ("conn",),
    "Database Protocol Egress": ("conn",),
    "Off-Hours Transfer": ("conn",),
    "HTTP Beacon": ("http",),
    "Suspicious UA": ("http",),
    "Cobalt Strike URI": ("http",),
    "C2 URI Pattern": ("http",),
    "Domain Fronting": ("http", "ssl"),
    "Suspicious File Download": ("http", "files"),
    "Suspicious URL": ("http",),
    "DNS Tunneling": ("dns",),
    "DNS Subdomain DGA": ("dns",),
    "DNS NXDOMAIN Flood": ("dns",),
    "DNS Beacon": ("dns",),
    "Suspicious TLD": ("dns",),
    "DoH Bypass": ("ssl",),
    "Malicious JA3": ("ssl",),
    "Malicious JA4": ("ssl",),
    "Weak TLS": ("ssl",),
    "SSL No-SNI": ("ssl",),
    "SSL No-SNI on C2 Port": ("ssl", "conn"),
    "Suspicious Certificate": ("x509",),
    "Zeek Notice": ("notice",),
    "TI Hit (IP)": ("conn", "http", "ssl"),
    "TI Hit (Domain)": ("dns", "http"),
    "TI Hit (Hash)": ("files", "http"),
}

#: Where a type is not listed.
ANY_LOG = ("conn", "http", "dns", "ssl")

#: The trend family of each type; others are "other".
TREND_FAMILIES = {
    "TI Hit (IP)": "ti",
    "TI Hit (Domain)": "ti",
    "TI Hit (Hash)": "ti",
    "Threat Intel Hit": "ti",
    "Suspicious URL": "ti",
    "Malicious JA3": "ti",
    "Malicious JA4": "ti",
    "Beacon": "beaconing",
    "DNS Beacon": "beaconing",
    "HTTP Beacon": "beaconing",
    "Port-Hopping Beacon": "beaconing",
    "Strobe": "beaconing",
    "Data Exfiltration": "exfil",
    "Off-Hours Transfer": "exfil",
    "Database Protocol Egress": "exfil",
    "Admin Protocol Egress": "exfil",
    "DNS Tunneling": "dns",
    "DNS NXDOMAIN Flood": "dns",
    "DNS Subdomain DGA": "dns",
    "Lateral Movement": "lateral",
    "Weak TLS": "tls",
    "SSL No-SNI": "tls",
    "SSL No-SNI on C2 Port": "tls",
    "Suspicious Certificate": "tls",
    "DoH Bypass": "tls",
    "Domain Fronting": "tls",
}

WELL_KNOWN_PORTS = {
    "22": "SSH",
    "23": "Telnet",
    "25": "SMTP",
    "53": "DNS",
    "67": "DHCP",
    "68": "DHCP",
    "80": "HTTP",
    "88": "Kerberos",
    "110": "POP3",
    "123": "NTP",
    "135": "MSRPC",
    "137": "NetBIOS",
    "138": "NetBIOS",
    "139": "NetBIOS-SMB",
    "143": "IMAP",
    "161": "SNMP",
    "389": "LDAP",
    "443": "HTTPS",
    "445": "SMB",
    "465": "SMTPS",
    "514": "syslog",
    "587": "SMTP",
    "636": "LDAPS",
    "993": "IMAPS",
    "995": "POP3S",
    "1433": "MSSQL",
    "1521": "Oracle",
    "3306": "MySQL",
    "3389": "RDP",
    "5353": "mDNS",
    "5432": "PostgreSQL",
    "5985": "WinRM",
    "5986": "WinRM",
    "5900": "VNC",
    "6379": "Redis",
    "8080": "HTTP-alt",
    "8443": "HTTPS-alt",
    "27017": "MongoDB",
}
