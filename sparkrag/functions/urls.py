"""URL functions: hosts, domain rules and static checks. No name is resolved."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Networks whose addresses are never fetched.
PRIVATE_NETWORKS = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")
PAGE_TYPES = ("text/html", "text/plain", "application/xhtml+xml")


def url_host(url: Column) -> Column:
    """Lower-case host without port or final dot; '' without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host; the whole host for addresses and localhost."""
    host = url_host(url)
    parts = F.split(host, r"\.")
    whole = (host == "") | F.rlike(F.replace(host, F.lit(".")), F.lit("^[0-9]+$")) | F.contains(host, F.lit("localhost")) | (F.size(parts) < 2)
    return F.when(whole, host).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def _in_domain(host: Column, domains: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(host == d) | F.endswith(host, F.lit("." + d)) for d in domains], F.lit(False))


def domain_allowed(url: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """Exact or subdomain matches; deny wins; an empty allow list allows all; no host is never allowed."""
    host = url_host(url)
    return (host != "") & ~_in_domain(host, deny or []) & (_in_domain(host, allow) if allow else F.lit(True))


def domain_rules(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`domain_allowed` for rule tables (domain, kind allow|deny) of any length, as a column `allowed`:
    every suffix of a host is looked up with an equi-join."""
    hosts = rows.select(url_host(F.col(url)).alias("host")).distinct()
    labels = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    hit = suffixes.join(rules.select("domain", "kind").distinct(), "domain").groupBy("host").agg(F.bool_or(F.col("kind") == "deny").alias("denied"), F.bool_or(F.col("kind") == "allow").alias("listed"))
    closed = rules.agg(F.coalesce(F.bool_or(F.col("kind") == "allow"), F.lit(False)).alias("closed"))  # one row
    flags = hosts.join(hit, "host", "left").join(F.broadcast(closed), F.lit(True))
    ok = (F.col("host") != "") & ~F.coalesce("denied", F.lit(False)) & (~F.col("closed") | F.coalesce("listed", F.lit(False)))
    return rows.withColumn("_host", url_host(F.col(url))).join(flags.select(F.col("host").alias("_host"), ok.alias("allowed")), "_host").drop("_host")


def _whole(text: Column, base: int, digits: str) -> Column:
    """text as a number of that base if it has these digits only, else null."""
    return F.when(F.rlike(text, F.lit(f"^[{digits}]+$")), F.conv(text, base, 10).try_cast("long"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as a number, else null: one to four parts, decimal, octal (0...) or hexadecimal (0x...), of
    which the last fills the bytes that are left."""
    hexadecimal = lambda p: F.when(F.length(p) <= 10, _whole(F.substring(p, 3, 9), 16, "0-9a-f"))
    number = lambda p: F.when(F.startswith(p, F.lit("0x")), hexadecimal(p)).when(F.startswith(p, F.lit("0")), F.when(F.length(p) <= 12, _whole(p, 8, "0-7"))).otherwise(F.when(F.length(p) <= 10, _whole(p, 10, "0-9")))

    def total(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        room = F.element_at(F.array(*[F.lit(256**i) for i in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        head = F.aggregate(F.slice(parts, 1, n - 1), F.lit(0).cast("long"), lambda a, p: a * 256 + p) * room
        good = (n <= 4) & F.forall(parts, lambda p: p.isNotNull()) & F.forall(F.slice(parts, 1, n - 1), lambda p: p <= 255) & (last < room)
        return F.when(good, head + last)

    return F.when(F.rlike(host, F.lit("^[0-9a-fx.]+$")), _let(F.transform(F.split(host, r"\."), number), total))


def _hex_groups(bare: Column) -> Column:
    """The address with a dotted end written as two groups; null if that isn't one."""
    tail = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
    pair = lambda b: F.when(F.forall(b, lambda p: p <= 255), F.lower(F.concat_ws(":", F.hex(F.get(b, F.lit(0)) * 256 + F.get(b, F.lit(1))), F.hex(F.get(b, F.lit(2)) * 256 + F.get(b, F.lit(3))))))
    octets = lambda dotted: F.transform(F.split(dotted, r"\."), lambda p: p.try_cast("long"))
    joined = lambda dotted: F.when(dotted == "", bare).otherwise(F.concat(F.regexp_replace(bare, tail, ""), _let(octets(dotted), pair)))
    return _let(F.regexp_extract(bare, f"(?:^|:)({tail[:-1]})$", 1), joined)


def ipv6_halves(text: Column) -> Column:
    """An IPv6 literal (no brackets) as a struct (hi, lo) of its upper and lower 64 bits, else null: with or without
    leading zeros, one run of zero groups left out, the last two groups dotted, a zone."""
    half = lambda numbers, at: F.aggregate(F.slice(numbers, at, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(g))
    halves = lambda numbers: F.struct(half(numbers, 1).alias("hi"), half(numbers, 5).alias("lo"))

    def whole(sides: Column) -> Column:
        """sides: one or two lists of groups, what stands on either side of ::."""
        groups = F.flatten(sides)
        n, short = F.size(groups), F.size(sides) == 2
        good = (F.size(sides) <= 2) & ((short & (n <= 7)) | (~short & (n == 8))) & F.forall(groups, lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        filled = F.concat(F.element_at(sides, 1), zeros, F.when(short, F.element_at(sides, -1)).otherwise(F.array().cast("array<string>")))
        return F.when(good, _let(F.transform(filled, lambda g: F.conv(g, 16, 10).try_cast("long")), halves))

    sides = lambda plain: F.transform(F.split(plain, "::", -1), lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1)))
    return _let(_hex_groups(F.regexp_replace(F.lower(text), "%.*$", "")), lambda plain: _let(sides(plain), whole))


_MAPPED = 0xFFFF << 32


def address_halves(host: Column) -> Column:
    """An address literal as (hi, lo) of 128 bits, IPv4 as its mapped IPv6 address; null for names."""
    v4 = lambda number: F.when(number.isNotNull(), F.struct(F.lit(0).cast("long").alias("hi"), (number + _MAPPED).alias("lo")))
    inner = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    return F.when(F.startswith(host, F.lit("[")), F.when(inner != "", ipv6_halves(inner))).otherwise(_let(ipv4_number(host), v4))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def in_networks(address: Column, networks: tuple[str, ...] = PRIVATE_NETWORKS) -> Column:
    """Whether (hi, lo) lies in one of the networks, by prefix length; mapped addresses count as IPv4. False for null."""

    def inside(a: Column) -> Column:
        tests = []
        for text in networks:
            net = ipaddress.ip_network(text)
            number, bits = (int(net.network_address), net.prefixlen) if net.version == 6 else (_MAPPED + int(net.network_address), net.prefixlen + 96)
            mask = (1 << 128) - (1 << 128 - bits)
            for half, shift in (("hi", 64), ("lo", 0)):
                kept, want = (_signed(x >> shift & (1 << 64) - 1) for x in (mask, number))
                tests.append(a[half].bitwiseAND(F.lit(kept)) == F.lit(want))
        return reduce(lambda x, y: x | y, [tests[i] & tests[i + 1] for i in range(0, len(tests), 2)])

    return F.coalesce(_let(address, inside), F.lit(False))


def private_address(host: Column) -> Column:
    """Loopback, private, link-local (with the metadata address) and unique local literals, however they are spelled."""
    return in_networks(address_halves(host))


def url_static_check(url: Column) -> Column:
    """null if the URL may be fetched, else the reason."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    of_host = lambda host: F.when(host.isin("", "[]"), "No hostname in URL").when(private_address(host), F.concat(F.lit("Private address: "), host))
    return F.when(~scheme.isin("http", "https"), F.concat(F.lit("Unsupported scheme: "), scheme)).otherwise(_let(url_host(url), of_host))


def page_gate(final_url: Column, status: Column, content_type: Column, n_bytes: Column, most: int = 200_000, types: tuple[str, ...] = PAGE_TYPES) -> Column:
    """null if a stored response is accepted, else the reason."""
    kind = F.element_at(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";"), 1)
    known = reduce(lambda a, b: a | b, [F.contains(kind, F.lit(t)) for t in types])
    unsafe = url_static_check(final_url)
    return (
        F.when(unsafe.isNotNull(), F.concat(F.lit("Redirect to unsafe URL: "), unsafe))
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .when((kind != "") & ~known, F.concat(F.lit("Blocked content-type: "), kind))
        .when(n_bytes > most, F.concat(F.lit("Response too large: "), n_bytes.cast("string"), F.lit(" bytes")))
    )
