"""Validity of http(s) URLs as a WHATWG-style parser decides it, as one SQL
expression: surrounding blanks are trimmed, tabs and line feeds dropped,
slashes after the scheme may be missing or backslashes; user information ends
at the last ``@``; the host is a bracketed IPv6 address, an IPv4 address if
its last label is a number, or a domain without forbidden characters; a port
is a number up to 65535."""

from __future__ import annotations

from .text import let, q, var

# Messages of the validation library.
EMPTY_INPUT = "Input should be a valid URL, input is empty"
NO_SCHEME = "Input should be a valid URL, relative URL without a base"
SCHEME = "URL scheme should be 'http' or 'https'"
EMPTY_HOST = "Input should be a valid URL, empty host"
BAD_PORT = "Input should be a valid URL, invalid port number"
BAD_DOMAIN = "Input should be a valid URL, invalid domain character"
BAD_IPV4 = "Input should be a valid URL, invalid IPv4 address"
BAD_IPV6 = "Input should be a valid URL, invalid IPv6 address"
TOO_LONG = "URL should have at most 2083 characters"
MAX_CHARS = 2083

FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
_ENDS_IN_NUMBER = r"(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?\z"
_NUMBER = r"^(?:0[xX][0-9A-Fa-f]*|0[0-7]*|[1-9][0-9]*)\z"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _ipv6_re() -> str:
    """Eight groups; one ``::`` stands for any number of zero groups; the last two groups may be an IPv4 address."""
    g, v4 = "[0-9A-Fa-f]{1,4}", rf"{_BYTE}(?:\.{_BYTE}){{3}}"
    forms = [f"(?:{g}:){{7}}{g}", f"(?:{g}:){{6}}{v4}"]
    for left in range(8):  # groups ahead of "::", then those that still fit behind it
        head = f"{g}(?::{g}){{{left - 1}}}" if left else ""
        forms.append(f"{head}::(?:{g}(?::{g}){{0,{6 - left}}})?" if left < 7 else f"{head}::")
        if left < 6:
            forms.append(f"{head}::(?:{g}:){{0,{5 - left}}}{v4}")
    return r"^\[(?:" + "|".join(forms) + r")\]\z"


def _ipv4_ok(host: str) -> str:
    """Up to four numbers, decimal, octal or hexadecimal; the last one fills the remaining bytes."""
    p, n, x = var("p"), var("n"), var("x")
    value = (f"CASE WHEN NOT {x} RLIKE {q(_NUMBER)} OR length({x}) > 20 THEN 1e30D WHEN {x} RLIKE '^0[xX]' THEN "
             f"coalesce(CAST(conv(concat('0', substring({x}, 3)), 16, 10) AS DOUBLE), 1e30D) "
             f"WHEN {x} RLIKE '^0.' THEN coalesce(CAST(conv({x}, 8, 10) AS DOUBLE), 1e30D) ELSE CAST({x} AS DOUBLE) END")
    numbers = let(f"transform(split(regexp_replace({host}, {q(r'[.]\z')}, ''), '[.]', -1), {x} -> {value})", lambda a: (
        f"size({a}) <= 4 AND forall(slice({a}, 1, size({a}) - 1), {n} -> {n} <= 255) AND element_at({a}, -1) < power(256D, 5 - size({a}))"))
    return f"transform(array(0), {p} -> {numbers})[0]"


def http_url_error_sql(u: str) -> str:
    """Why ``u`` is no http(s) URL, NULL where it is one (NULL for NULL)."""
    clean = f"regexp_replace(regexp_replace({u}, {q(r'^[\x00-\x20]+|[\x00-\x20]+\z')}, ''), {q(r'[\t\n\r]')}, '')"

    def host_error(h):
        decoded = f"IF({h} LIKE '%\\%%', coalesce(try_url_decode(replace({h}, '+', '%2B')), '%'), {h})"
        return let(decoded, lambda d: (
            f"CASE WHEN {d} = '' THEN {q(EMPTY_HOST)} WHEN {d} RLIKE {q(FORBIDDEN)} THEN {q(BAD_DOMAIN)} "
            f"WHEN {d} RLIKE {q(_ENDS_IN_NUMBER)} AND NOT {_ipv4_ok(d)} THEN {q(BAD_IPV4)} END"))

    def authority_error(a):
        host = rf"regexp_extract({a}, {q(r'^(\[[^\]]*+\]?|[^:]*+)')}, 1)"
        return let(host, lambda h: let(f"substring({a}, length({h}) + 1)", lambda port: (
            f"CASE WHEN {h} LIKE '[%' THEN IF({h} RLIKE {q(_ipv6_re())}, NULL, {q(BAD_IPV6)}) ELSE {host_error(h)} END, "
            f"CASE WHEN {port} <> '' AND (NOT {port} RLIKE {q(r'^:[0-9]*\z')} OR coalesce(try_cast(nullif(substring({port}, 2), '') AS DOUBLE), 0) > 65535) "
            f"THEN {q(BAD_PORT)} END").join(("coalesce(", ")"))))

    def error(t):
        authority = f"regexp_replace(regexp_extract({t}, {q(r'(?is)^https?:[/\\]*([^/\\?#]*)')}, 1), {q(r'(?s)^.*@')}, '')"
        return (f"CASE WHEN {u} = '' THEN {q(EMPTY_INPUT)} WHEN length({u}) > {MAX_CHARS} THEN {q(TOO_LONG)} "
                f"WHEN NOT {t} RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN {q(NO_SCHEME)} WHEN NOT {t} RLIKE '(?i)^https?:' THEN {q(SCHEME)} "
                f"ELSE {let(authority, authority_error)} END")

    return f"CASE WHEN {u} IS NOT NULL THEN {let(clean, error)} END"
