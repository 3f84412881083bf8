"""Names, addresses, paths and client stacks as columns: everything here is a built-in expression.

Null counts as empty throughout; none of the functions fails on odd input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results have to name things as these do.
SERVICE_PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 88: "kerberos", 110: "pop3",
    123: "ntp", 135: "msrpc", 139: "netbios", 143: "imap", 161: "snmp", 389: "ldap", 443: "https", 445: "smb", 465: "smtps",
    514: "syslog", 587: "submission", 636: "ldaps", 993: "imaps", 995: "pop3s", 1433: "mssql", 1521: "oracle", 2049: "nfs",
    3306: "mysql", 3389: "rdp", 5432: "postgres", 5900: "vnc", 5985: "winrm", 5986: "winrm-s", 6379: "redis",
    8080: "http-alt", 8443: "https-alt", 9200: "elastic", 27017: "mongo",
}
QTYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 43: "DS", 48: "DNSKEY", 64: "SVCB", 65: "HTTPS", 255: "ANY", 257: "CAA"}
OS_FROM_TTL = {32: "win", 64: "linux", 128: "win", 255: "net"}
PORT_LIMIT, DEPTH, LITERAL = 65535, 6, 64

#: Suffixes of two labels under which names are registered; a deployment gives its own list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.br", "com.tw", "com.hk", "co.nz", "co.za")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _like(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_host(host: Column) -> Column:
    """Lower case, without scheme, path, port, brackets or a full stop at the end."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_s(host))), "^.*?://", ""), "(?s)/.*$", "")
    one_colon = F.char_length(h) - F.char_length(F.replace(h, F.lit(":"))) == 1
    bare = F.when(F.startswith(h, F.lit("[")), F.regexp_extract(h, r"^\[([^\]]*)", 1)).when(one_colon, F.split_part(h, F.lit(":"), F.lit(1))).otherwise(h)
    return F.regexp_replace(bare, r"\.+$", "")


def _groups(h: Column) -> Column:
    """The eight groups of an IPv6 address without leading zeros; null if it isn't one (none that ends in IPv4)."""
    part = lambda k: F.filter(F.split(F.split_part(h, F.lit("::"), F.lit(k)), ":"), lambda x: x != "")
    gap = F.concat(part(1), F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(part(1)) - F.size(part(2)), F.lit(0))), part(2))
    whole = F.when(h.contains("::"), gap).otherwise(F.split(h, ":"))
    right = h.contains(":") & ~_like(h, "::.*::|:::") & (F.size(whole) == 8) & F.forall(whole, lambda g: _like(g, "^[0-9a-f]{1,4}$"))
    return F.when(right, F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))


def is_ip(host: Column) -> Column:
    h = F.lower(_s(host))
    return _like(h, _V4) | _groups(h).isNotNull()


def ip_prefix(address: Column, level: int) -> Column:
    """The network at level 0, 1 or 2: /32, /24, /16, or /128, /64, /48. What is no address stays as it is."""
    h = F.lower(_s(address))
    if level == 0:
        v4 = h
    else:
        keep = 4 - level
        v4 = F.concat(F.array_join(F.slice(F.split(h, r"\."), 1, keep), "."), F.lit(".0" * level + f"/{8 * keep}"))

    def v6(groups: Column) -> Column:
        if level == 0:
            return h
        head = F.slice(groups, 1, 5 - level)
        last = F.coalesce(F.array_max(F.transform(head, lambda g, i: F.when(g != "0", i + 1))), F.lit(0))
        return F.concat(F.array_join(F.slice(head, F.lit(1), last), ":"), F.lit(f"::/{64 if level == 1 else 48}"))

    return F.when(_like(h, _V4), v4).otherwise(_let(_groups(h), lambda g: F.when(g.isNotNull(), v6(g)).otherwise(_s(address))))


def peer_bucket(peer: Column) -> Column:
    """What peers are counted by: an IPv4 /24, an IPv6 /64, else the host."""
    return ip_prefix(normal_host(peer), 1)


def etld1(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registrable domain; addresses and names of one or two labels are returned as they are."""
    h = normal_host(host)

    def cut(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
        return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))

    return F.when(is_ip(h), h).otherwise(_let(F.filter(F.split(h, r"\."), lambda x: x != ""), cut))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 of an empty text."""
    chars = F.regexp_extract_all(_s(text), F.lit("(?s)."), F.lit(0))

    def of(c: Column) -> Column:
        part = lambda d: _let(F.size(F.filter(c, lambda x: x == d)).cast("double"), lambda k: k * F.log2(k))
        summed = F.aggregate(F.transform(F.array_distinct(c), part), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(c) > 0, F.log2(F.size(c).cast("double")) - summed / F.size(c)).otherwise(0.0)

    return _let(chars, of)


def _digits(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, "[^0-9]", ""))


_M, _D, _Y = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:19|2[01])[0-9]{2}"
_MM, _DD = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_DATES = "|".join((
    rf"{_Y}-{_MM}-{_DD}(?:[T ][0-9:.]+(?:Z|[+-][0-9:]+)?)?", rf"{_Y}([-_.]){_M}\1{_D}", rf"{_Y}-{_MM}", rf"{_D}([-.])(?:{_M})\2{_Y}", rf"{_M}([-.])(?:{_D})\3{_Y}",
    rf"(?:19[7-9]|20[0-9])[0-9]{_MM}{_DD}(?:T[0-9]{{4}}(?:[0-9]{{2}})?Z?)?",
))


def _mask(seg: Column) -> Column:
    """The mask of a whole segment, null where it is a literal."""
    hexadecimal = _like(seg, "^[0-9a-fA-F]{16,}$") & _like(seg, "[0-9]") & _like(seg, "[a-fA-F]")
    chunk = F.array_join(F.regexp_extract_all(seg, F.lit("[A-Za-z0-9]{8,}"), F.lit(0)), " ")
    mixed = sum((_like(chunk, p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0)) >= 2
    parts = F.size(F.regexp_extract_all(chunk, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)))
    letters = F.char_length(F.replace(chunk, F.lit(" ")))
    random = _like(seg, r"^\p{ASCII}+$") & mixed & (parts >= 0.4 * letters)
    token = random & (_like(seg, "^[A-Za-z0-9_-]{16,}$") | (char_entropy(seg) >= 3.5))
    return (
        F.when(_like(seg, "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}")
        .when(_like(seg, r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), "{email}")
        .when(_like(seg, f"^(?:{_DATES})$"), "{date}")
        .when(hexadecimal, "{hex}")
        .when(_like(seg, "^[0-9]+$"), "{num}")
        .when(_like(seg, "^[A-Za-z0-9]{8,}$") & (_digits(seg) >= 3), "{id}")
        .when(token, "{tok}")
    )


def mask_segment(segment: Column) -> Column:
    """A path segment, or {uuid}, {email}, {date}, {hex}, {num}, {id} or {tok}; with a short extension the stem is looked at too."""
    seg = _s(segment)
    plain = F.coalesce(F.try_url_decode(F.replace(seg, F.lit("+"), F.lit("%2B"))), seg)
    stem, ending = F.regexp_extract(plain, r"^(.+)\.([A-Za-z0-9]{0,4}[A-Za-z][A-Za-z0-9]{0,4})$", 1), F.regexp_extract(plain, r"^.+\.([A-Za-z0-9]{1,5})$", 1)
    literal = seg
    for c in "|{}?#& \t":
        literal = F.replace(literal, F.lit(c), F.lit(f"%{ord(c):02X}"))
    short = (stem != "") & (ending != "")
    return F.coalesce(_mask(plain), F.when(short, F.concat(_mask(stem), F.lit("."), ending)), F.substring(literal, 1, LITERAL))


def path_segments(path: Column) -> Column:
    """Segments without scheme, host, query, fragment, matrix parameters and empty ones."""
    bare = F.regexp_replace(F.regexp_replace(_s(path), "(?s)[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.filter(F.transform(F.split(bare, "/"), lambda s: F.split_part(s, F.lit(";"), F.lit(1))), lambda s: s != "")


def mask_path(path: Column, depth: int = DEPTH) -> Column:
    """The path with its segments masked; what lies below `depth` segments is one {var}."""

    def joined(segs: Column) -> Column:
        masked = F.transform(F.slice(segs, 1, depth), mask_segment)
        return F.concat(F.lit("/"), F.array_join(F.when(F.size(segs) > depth, F.concat(masked, F.array(F.lit("{var}")))).otherwise(masked), "/"))

    return _let(path_segments(path), joined)


def query_names(url: Column, most: int = 16) -> Column:
    """Names of the query's parameters, masked, sorted, each once, `most` at most."""
    query = F.split_part(F.regexp_extract(_s(url), r"\?([^#]*)", 1), F.lit("#"), F.lit(1))
    names = F.filter(F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))), lambda n: n != "")
    return F.slice(F.array_sort(F.array_distinct(F.transform(names, mask_segment))), 1, most)


def status_class(status: Column) -> Column:
    s = status.try_cast("int")
    return F.when(s.between(100, 599), F.concat(F.floor(s / 100).cast("string"), F.lit("xx"))).otherwise("0xx")


def size_class(up: Column, down: Column) -> Column:
    level = lambda c: F.when(c.cast("double") > 1, F.floor(F.log2(c.cast("double")) + 1e-12)).otherwise(0).cast("long").cast("string")
    return F.concat(F.lit("u"), level(F.coalesce(up, F.lit(0))), F.lit("/d"), level(F.coalesce(down, F.lit(0))))


def _port(port: Column) -> Column:
    p = F.coalesce(port.cast("int"), F.lit(0))
    return F.when(p.between(0, PORT_LIMIT), p).otherwise(0)


def _named(key: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def random_label(label: Column) -> Column:
    """Whether a DNS label looks random: 20 characters, 30 % digits, or 3.2 bits a character, or more."""
    n = F.char_length(_s(label))
    return (n > 0) & ((n >= 20) | (_digits(_s(label)) / F.greatest(n, F.lit(1)) >= 0.3) | (char_entropy(label) >= 3.2))


def dns_template(name: Column) -> Column:
    """The registrable domain with the labels before it, runs of random ones as {rnd}."""
    h, domain = normal_host(name), etld1(name)
    left = F.when((h == domain) | is_ip(h), F.array().cast("array<string>")).otherwise(F.filter(F.split(F.left(h, F.char_length(h) - F.char_length(domain)), r"\."), lambda x: x != ""))
    shown = F.transform(left, lambda x: F.when(random_label(x), F.lit("{rnd}")).otherwise(x))
    once = _let(shown, lambda xs: F.filter(xs, lambda x, i: ~((x == "{rnd}") & F.coalesce(F.get(xs, i - 1) == "{rnd}", F.lit(False)))))
    return F.when(domain == "", ".").otherwise(F.array_join(F.concat(once, F.array(domain)), "."))


def dns_token(qtype: Column, name: Column) -> Column:
    q = F.upper(F.trim(_s(qtype)))
    number = q.try_cast("int")
    known = F.coalesce(_named(number, QTYPES), F.concat(F.lit("TYPE"), number.cast("string")))
    return F.concat(F.when(q == "", "UNK").when(_like(q, "^[0-9]+$"), known).when(_like(q, "^[A-Z0-9]{1,12}$"), q).otherwise("UNK"), F.lit(" "), dns_template(name))


def tls_token(sni: Column, port: Column, up: Column, down: Column) -> Column:
    e = etld1(sni)
    host = F.when(e == "", "-").when(e.contains(":"), F.concat(F.lit("["), e, F.lit("]"))).otherwise(e)
    return F.concat(host, F.lit(":"), _port(port).cast("string"), F.lit(" "), size_class(up, down))


def l4_token(proto: Column, port: Column, up: Column, down: Column) -> Column:
    p = F.regexp_replace(F.lower(_s(proto)), "[^a-z0-9]", "")
    service = F.coalesce(_named(_port(port), SERVICE_PORTS), _port(port).cast("string"))
    return F.concat(F.when(p == "", "ip").otherwise(p), F.lit("/"), service, F.lit(" "), size_class(up, down))


def channel(app_proto: Column, http_method: Column, http_path: Column, http_host: Column, tls_version: Column, tls_sni: Column, qname: Column) -> Column:
    """http, tls, dns or l4, by what a record holds."""
    app = F.lower(_s(app_proto))
    some = lambda c: _s(c) != ""
    http = some(http_method) | ((app == "http") & (some(http_path) | some(http_host)))
    return F.when(http, "http").when((app == "dns") | some(qname), "dns").when(some(tls_version) | some(tls_sni) | app.isin("tls", "https", "ssl"), "tls").otherwise("l4")


def ttl_class(ttl: Column) -> Column:
    t = ttl.cast("double")
    return F.when(~(F.coalesce(t, F.lit(0.0)) > 0), 0).when(t <= 32, 32).when(t <= 64, 64).when(t <= 128, 128).otherwise(255)


def win_class(size: Column) -> Column:
    w = size.cast("double")
    level = F.ceil(F.log2(w) - 1e-12).cast("long")
    return F.when(~(F.coalesce(w, F.lit(0.0)) > 0), "w0").otherwise(F.concat(F.lit("w"), F.least(F.greatest(level, F.lit(10)), F.lit(20)).cast("string")))


#: Client families in the order they are tried, as a version follows the name and a slash.
CLIENTS = (("edge", "Edg(?:e|A|iOS)?"), ("other", "OPR|SamsungBrowser|HeadlessChrome|Electron"), ("firefox", "Firefox|FxiOS"), ("chrome", "Chrome|CriOS"), ("safari", "Version(?=/[0-9.]+ (?:Mobile/\\S+ )?Safari/)"), ("python-requests", "python-requests"), ("curl", "curl"), ("go", "Go-http-client"), ("java", "Java"), ("okhttp", "okhttp"), ("wget", "Wget"), ("postman", "PostmanRuntime"))
SYSTEMS = (("android", "Android"), ("ios", "iPhone|iPad|iPod"), ("win", "Windows"), ("mac", "Mac OS X|Macintosh"), ("linux", "Linux|X11"))


def ua_parse(agent: Column) -> Column:
    """family, major, os of a user agent; none and 0 of an empty one, other of an unknown one."""
    ua = F.substring(F.trim(_s(agent)), 1, 512)
    missing = F.lower(ua).isin("", "-", "none", "null", "nan")
    family, major, system = F.when(missing, "none"), F.when(missing, "0"), F.when(missing, F.lit(None).cast("string"))
    for name, pattern in CLIENTS:
        version = F.regexp_extract(ua, rf"(?:^|[\s;(])(?:{pattern})/([0-9]{{1,9}})", 1)
        family, major = family.when(version != "", name), major.when(version != "", F.coalesce(F.nullif(F.ltrim(version, F.lit("0")), F.lit("")), F.lit("0")))
    for name, pattern in SYSTEMS:
        system = system.when(_like(ua, pattern), name)
    return F.struct(family.otherwise("other").alias("family"), major.otherwise("0").alias("major"), system.alias("os"))


def stack_token(fingerprint: Column, agent: Column, ttl: Column, window: Column) -> Column:
    """fingerprint|family/major|os|ttl class|window class; the system comes from the agent, else from the ttl class."""
    ua, level = ua_parse(agent), ttl_class(ttl)
    system = F.coalesce(ua["os"], _named(level, OS_FROM_TTL), F.lit("?"))
    mark = F.when(F.lower(F.trim(_s(fingerprint))).isin("", "-", "none", "null", "nan"), "-").otherwise(F.lower(F.trim(_s(fingerprint))))
    return F.concat_ws("|", mark, F.concat(ua["family"], F.lit("/"), ua["major"]), system, level.cast("string"), win_class(window))
