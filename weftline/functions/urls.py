"""URL functions: parsing by the WHATWG rules, joining, and plain string forms.

A URL is reduced to (domain, path, query): scheme, user, port and fragment are
dropped. Only hosts that are names count, so addresses and schemes without a
host give null.
"""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.schemas import S, struct

PARSED = struct(domain=S, path=S, query=S)
#: URLs that are already in their normal form, which Spark's own functions can cut.
PLAIN = r"^https?://(?:[a-z0-9][a-z0-9-]*\.)*[a-z][a-z0-9-]*(?:/[A-Za-z0-9._~!$&()*+,;=:@%/-]*)?(?:\?[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?(?:#[!-~]*)?$"
DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|[?#]|$)"
CUT = r"^https?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_SPECIAL = {"http", "https", "ws", "wss", "ftp"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)", re.S)
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def _escape(text: str, unsafe: str) -> str:
    """Percent-encodes controls, the given characters and everything beyond ASCII."""
    return "".join(c if "!" <= c <= "~" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(raw: str) -> str | None:
    name = raw.rpartition("@")[2]
    name, _, port = name.partition(":")
    if port and not (port.isascii() and port.isdigit() and int(port) < 65536):
        return None
    try:
        name = unquote_to_bytes(name).decode("utf-8").lower()
        if not name.isascii():
            name = name.replace("。", ".").encode("idna").decode()
    except UnicodeError:
        return None
    last = name.rstrip(".").rpartition(".")[2]
    if not name or _FORBIDDEN.search(name) or re.fullmatch(r"\d+|0x[0-9a-f]*", last):  # numbers make an address
        return None
    return name


def _segments(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(part)
        if k == len(parts) - 1 and plain in (".", ".."):
            out.append("")
    return "/" + "/".join(out)


def _split(url: str) -> tuple[str, str, str | None, str] | None:
    """(scheme, authority, query, path) of an absolute URL of a scheme with hosts."""
    m = _SCHEME.fullmatch(url)
    if not m or m[1].lower() not in _SPECIAL:
        return None
    rest, _, _ = m[2].partition("#")
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/").lstrip("/")
    authority, slash, path = rest.partition("/")
    return m[1].lower(), authority, query if mark else None, slash + path


def _clean(url: str) -> str:
    return re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))


def parse(url: str | None) -> tuple[str, str, str | None] | None:
    """(domain, path, query) of an absolute URL, or None."""
    if url is None or (parts := _split(_clean(url))) is None:
        return None
    _, authority, query, path = parts
    domain = _host(authority)
    if domain is None:
        return None
    path = _escape(_segments(path) if path else "/", " \"#<>?`{}^")
    return domain, path, None if query is None else _escape(query, " \"#<>'")


def join(base: str | None, href: str | None) -> tuple[str, str, str | None] | None:
    """The link that href means on the page base."""
    if href is None:
        return None
    href = _clean(href)
    m = _SCHEME.fullmatch(href)
    start = _split(_clean(base or ""))
    if m and not (start and m[1].lower() == start[0] and not m[2].replace("\\", "/").startswith("/")):
        return parse(href)
    if start is None:
        return None
    scheme, authority, query, path = start
    rest = (m[2] if m else href).partition("#")[0]
    slashed = rest.replace("\\", "/")
    if slashed.startswith("//"):
        return parse(f"{scheme}:{rest}")
    if slashed.startswith("/"):
        return parse(f"{scheme}://{authority}{rest}")
    if rest.startswith("?"):
        return parse(f"{scheme}://{authority}{path}{rest}")
    if not rest:
        return parse(f"{scheme}://{authority}{path}" + (f"?{query}" if query is not None else ""))
    return parse(f"{scheme}://{authority}{(path or '/').rpartition('/')[0]}/{rest}")


def _frame(rows: list[tuple[str, str, str | None] | None]) -> pd.DataFrame:
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["domain", "path", "query"], dtype=object)


@F.pandas_udf(PARSED)
def _parse(url: pd.Series) -> pd.DataFrame:
    return _frame([parse(u) for u in url])


@F.pandas_udf(PARSED)
def _join(base: pd.Series, href: pd.Series) -> pd.DataFrame:
    return _frame([join(b, h) for b, h in zip(base, href, strict=True)])


def _plain(url: Column) -> Column:
    return url.rlike(PLAIN) & ~url.rlike(DOTS)


def _cut(url: Column) -> Column:
    path = F.regexp_extract(url, CUT, 2)
    query = F.when(url.rlike(r"^[^#?]*\?"), F.regexp_extract(url, CUT, 3))
    return F.struct(F.regexp_extract(url, CUT, 1).alias("domain"), F.when(path == "", "/").otherwise(path).alias("path"), query.alias("query"))


def parse_link(url: Column) -> Column:
    """struct(domain, path, query), null fields where the URL has no host name.

    URLs in normal form are cut by Spark; only the others go to the Python rules.
    """
    plain = F.coalesce(_plain(url), F.lit(False))
    return F.when(plain, _cut(url)).otherwise(_parse(F.when(~plain, url)))


def resolve_href(base: Column, href: Column) -> Column:
    """The link that an anchor means: ``https://`` hrefs as they are, all others joined to the page's URL."""
    plain = F.coalesce(href.startswith("https://") & _plain(href), F.lit(False))
    # A root path on a page whose URL is in normal form needs no joining.
    rooted = F.coalesce(href.rlike(r"^/(?!/)[A-Za-z0-9._~!$&()*+,;=:@%/-]*$") & ~href.rlike(DOTS) & _plain(base), F.lit(False))
    here = F.struct(F.regexp_extract(base, CUT, 1).alias("domain"), href.alias("path"), F.lit(None).cast("string").alias("query"))
    slow = ~(plain | rooted)
    return F.when(plain, _cut(href)).when(rooted, here).otherwise(_join(F.when(slow, base), F.when(slow, href)))


def full_link(path: Column, query: Column) -> Column:
    return F.when(query.isNull(), path).otherwise(F.concat(path, F.lit("?"), query))


def full_url(domain: Column, path: Column, query: Column) -> Column:
    return F.concat(F.lit("https://"), domain, full_link(path, query))


def resolve_asset(base: Column, src: Column) -> Column:
    """An asset's URL: ``http…`` as it is, all else joined to the root of the page's site."""
    link = _join(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.when(~src.startswith("http"), src))
    return F.when(src.startswith("http"), src).otherwise(F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("://"), link["domain"], full_link(link["path"], link["query"])))


def host_name(url: Column) -> Column:
    return F.regexp_replace(url, r"^(?:https?://)?(?:www\.)?", "")


def extract_urls(text: Column) -> Column:
    """All ``https`` URLs in a text, in order (those that do not parse are left to the caller's parse_link)."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: u.startswith("https://"))
