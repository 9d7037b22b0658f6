"""Scalar functions as column expressions: formats, dates, headers, URLs, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by class, as the server and the desktop view have them.
SERVER_CLASSES = {
    "archive": "zip tar gz bz2 xz 7z rar",
    "document": "pdf doc docx txt md",
    "image": "png jpg jpeg gif webp svg",
    "code": "rs js ts py c cpp go html css json",
}
DESKTOP_CLASSES = {
    "archive": "zip tar gz 7z rar",
    "document": "pdf doc docx txt md csv",
    "image": "png jpg jpeg gif webp bmp",
    "code": "rs js ts py go html css json toml yaml",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fixed(x: Column, places: int) -> Column:
    """Decimal text, ties to even."""
    return F.format_string(f"%.{places}f", F.bround(x, places))


def format_bytes_long(size: Column | str) -> Column:
    """``1.50 MiB (1572864 bytes)``; below 1 KiB only bytes."""
    n = _col(size)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes")))
    for unit, k in (("KiB", 1), ("MiB", 2), ("GiB", 3)):
        text = F.concat(_fixed(n.cast("double") / 1024**k, 2), F.lit(f" {unit} ("), n.cast("string"), F.lit(" bytes)"))
        out = out.when(n < 1024 ** (k + 1), text) if k < 3 else out.otherwise(text)
    return out


def format_bytes_short(size: Column | str) -> Column:
    """``2 KB``, ``1.5 MB``, ``1.25 GB``; below 1 KB ``N B``."""
    n = _col(size)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(_fixed(n / 1024.0, 0), F.lit(" KB")))
        .when(n < 1024**3, F.concat(_fixed(n / 1024.0**2, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(n / 1024.0**3, 2), F.lit(" GB")))
    )


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long").cast("string")


def relative_age(then: Column | str, now: Column | str) -> Column:
    """``5s ago`` to ``3d ago``; a time to come is ``0s ago``. Both in seconds."""
    d = F.greatest(_col(now) - _col(then), F.lit(0).cast("long"))
    return F.concat(
        F.when(d < 60, F.concat(d.cast("string"), F.lit("s"))).when(d < 3600, F.concat(_div(d, 60), F.lit("m"))).when(d < 86400, F.concat(_div(d, 3600), F.lit("h"))).otherwise(F.concat(_div(d, 86400), F.lit("d"))),
        F.lit(" ago"),
    )


def expiry_badge(expires_at: Column | str, now: Column | str) -> Column:
    """Time left of a share in its largest unit; 0 never expires."""
    e, left = _col(expires_at), _col(expires_at) - _col(now)
    return (
        F.when(e == 0, "never")
        .when(left <= 0, "expired")
        .when(left >= 86400, F.concat(_div(left, 86400), F.lit(" days left")))
        .when(left >= 3600, F.concat(_div(left, 3600), F.lit(" hours left")))
        .when(left >= 60, F.concat(_div(left, 60), F.lit(" minutes left")))
        .otherwise(F.concat(left.cast("string"), F.lit(" seconds left")))
    )


def http_date(seconds: Column | str) -> Column:
    """RFC 1123 date; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(_col(seconds)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def parse_range(header: Column | str, total: Column | str) -> Column:
    """struct<start, len> of a single ``bytes=`` range; null if there is none that can be met.

    ``a-b`` is cut at the end, ``a-`` goes to it, ``-n`` are the last n bytes. An
    empty resource has (0, 0) for any well-formed range.
    """
    h, n = _col(header), _col(total).cast("long")
    a = F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 1).try_cast("long")
    b = F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 2).try_cast("long")
    made = lambda s, k: F.struct(s.cast("long").alias("start"), k.cast("long").alias("len"))
    zero = F.lit(0).cast("long")
    return (
        F.when(~h.rlike(r"^bytes=(\d+-\d*|-\d+)$") | (a.isNull() & b.isNull()), F.lit(None))
        .when(n == 0, made(zero, zero))
        .when(a.isNull(), made(F.greatest(n - b, zero), F.least(b, n)))
        .when((a >= n) | (b < a), F.lit(None))
        .otherwise(made(a, F.least(F.coalesce(b, n - 1), n - 1) - a + 1))
    )


def percent_decode(text: Column | str) -> Column:
    """Percent escapes taken back; ``+`` stays. Of a malformed escape the percent sign stays and up to two characters after it go; bytes that are no UTF-8 become U+FFFD."""
    whole = F.regexp_replace(_col(text), r"(?s)%(?![0-9A-Fa-f]{2}).{0,2}", "%25")
    return F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B")))


def checked_sum(*parts: Column | str) -> Column:
    """The sum of sizes; an error where it does not fit 64 bits or a part is negative."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = F.try_add(out, F.when(_col(p) >= 0, _col(p).cast("long")))
    return F.coalesce(out, F.raise_error(F.lit("payload size overflows")).cast("long"))


def fits(*parts: Column | str) -> Column:
    """Whether :func:`checked_sum` has a value."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = F.try_add(out, F.when(_col(p) >= 0, _col(p).cast("long")))
    return out.isNotNull()


def percent_encode(text: Column | str) -> Column:
    """All but unreserved characters escaped, in upper-case hex."""
    t = F.url_encode(_col(text))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def xml_escape(text: Column | str) -> Column:
    t = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def query_param(url: Column | str, key: str) -> Column:
    """Value of a key of the query string: pairs split at ``&``, only those of exactly two parts; the first counts."""
    q = F.regexp_extract(_col(url), r"\?([^#]*)", 1)
    pairs = F.filter(F.transform(F.split(q, "&"), lambda p: F.split(p, "=")), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) == key))
    return F.get(F.get(pairs, F.lit(0)), F.lit(1))


def _class(ext: Column, classes: dict[str, str], other: str) -> Column:
    out = None
    for kind, names in classes.items():
        hit = ext.isin(names.split())
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def server_class(ext: Column | str) -> Column:
    return _class(_col(ext), SERVER_CLASSES, "generic")


def desktop_class(ext: Column | str) -> Column:
    return _class(_col(ext), DESKTOP_CLASSES, "file")


def is_hex_id(text: Column | str, digits: int) -> Column:
    return _col(text).rlike(f"^[0-9a-fA-F]{{{digits}}}$")


def file_attributes(kind: Column | str, size: Column | str) -> Column:
    """struct<blocks, perm, nlink> of a read-only view: folders 0555 and 2 links, files 0444 and 1."""
    folder = _col(kind) == "dir"
    return F.struct(F.ceil(_col(size) / 512).cast("long").alias("blocks"), F.when(folder, 0o555).otherwise(0o444).alias("perm"), F.when(folder, 2).otherwise(1).alias("nlink"))


def allowed_origin(origin: Column | str, hosts: list[str]) -> Column:
    """True where the origin's host is one of ``hosts``."""
    return F.parse_url(_col(origin), F.lit("HOST")).isin(hosts)
