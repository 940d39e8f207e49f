"""Column functions on keys, names, addresses and links of a media catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions a gallery holds, by class.
STILLS = ["jpg", "jpeg", "png", "webp"]
CLIPS = ["gif", "mp4", "m4v", "webm"]
VIDEOS = ["mp4", "m4v", "webm"]
ALLOWED = ["jpg", "jpeg", "png", "gif", "webp", "mp4", "m4v", "webm"]
SOURCE_NAME = r"^[A-Za-z0-9_]{3,21}$"


def extension(key: Column) -> Column:
    """Lower-cased text after the last dot, wherever it stands; '' without one."""
    return F.when(F.contains(key, F.lit(".")), F.lower(F.substring_index(key, ".", -1))).otherwise("")


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(VIDEOS), "video").otherwise("image")


def bucket_class(ext: Column) -> Column:
    """'stills', 'clips' or NULL."""
    return F.when(ext.isin(STILLS), "stills").when(ext.isin(CLIPS), "clips")


def buckets(ext: Column) -> Column:
    """The buckets that a row belongs to: all, its class, its extension."""
    return F.array_compact(F.array(F.lit("all"), bucket_class(ext), F.when(ext.isin(ALLOWED), ext)))


def requested_bucket(name: str | None) -> str:
    low = (name or "").lower()
    return low if low in ("stills", "clips", *ALLOWED) else "all"


def allowed(ext: Column, size: Column, most_mb: int) -> Column:
    return ext.isin(ALLOWED) & (size > 0) & (size <= most_mb * 1024 * 1024)


def safe_name(name: Column) -> Column:
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
    return F.when(clean == "", "media.bin").otherwise(F.substring(clean, F.greatest(F.char_length(clean) - 159, F.lit(1)), F.lit(160)))


def object_key(prefix: str, relative: Column, name: Column, content: Column) -> Column:
    """prefix/ and 20 hex of sha1(relative, zero byte, content), then the safe name."""
    digest = F.sha1(F.concat(F.encode(relative, "UTF-8"), F.lit(b"\x00"), content))
    head = prefix.strip("/")
    return F.concat(F.lit(f"{head}/" if head else ""), F.substring(digest, 1, 20), F.lit("_"), safe_name(name))


def _bare(value: Column) -> Column:
    """Without white space of any kind at either end; '' for NULL."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$", "")


def normalize_source(value: Column, base: str) -> Column:
    """A listing's address for a source name or address; '' for placeholders and bad names."""
    v = _bare(value)
    bare = F.regexp_replace(F.regexp_replace(v, "^/+|/+$", ""), "^[rR]/", "")
    return (
        F.when(v.rlike(r"(?i)^placeholder\d+$"), "")
        .when(v.rlike("^https?://"), F.concat(F.regexp_replace(v, "/+$", ""), F.lit("/")))
        .when(bare.rlike(SOURCE_NAME), F.concat(F.lit(base), bare, F.lit("/new/")))
        .otherwise("")
    )


def source_name(value: Column, hosts: list[str]) -> Column:
    """The bare name of a source: from an address its host must be known and its path r/<name>; '' if invalid."""
    v = _bare(value)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(v, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    known = F.lower(F.coalesce(F.try_parse_url(v, F.lit("HOST")), F.lit(""))).isin(hosts) & (F.size(parts) >= 2) & (F.lower(F.get(parts, F.lit(0))) == "r")
    bare = F.get(F.split(F.regexp_replace(F.regexp_replace(v, "^/+|/+$", ""), "^[rR]/", ""), "/"), F.lit(0))
    name = F.when(v.rlike("(?i)^https?://"), F.when(known, F.get(parts, F.lit(1)))).otherwise(bare)
    return F.when(name.rlike(SOURCE_NAME), name).otherwise("")


def media_url(base: str, key: Column) -> Column:
    """The whole key percent-encoded, slashes too; unreserved marks stay."""
    return F.concat(F.lit(base), F.replace(F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def component_url(key: Column) -> Column:
    """The key as one percent-encoded component of a path; the marks that browsers leave stay."""
    out = F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.concat(F.lit("/media/"), out)


def human_bytes(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """B as an integer, else one decimal (half to even) in the units, the last of which has no end."""
    out = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        text = F.concat(F.bround(size / F.lit(float(1024**k)), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == units[-1] else out.when(size < 1024 ** (k + 1), text)
    return out


def parse_address(address: Column) -> Column:
    """struct(local, domain) split at the last @, domain lower; NULL if a side is empty."""
    domain = F.substring_index(address, "@", -1)
    local = F.substring(address, F.lit(1), F.char_length(address) - F.char_length(domain) - 1)
    return F.when(F.contains(address, F.lit("@")) & (local != "") & (domain != ""), F.struct(local.alias("local"), F.lower(domain).alias("domain")))


def clean_recipient(local: Column, suffix: str, fixed: list[str]) -> Column:
    """A fixed address' name lower, or the name before the secret suffix; NULL if neither."""
    clean = F.substring(local, F.lit(1), F.char_length(local) - len(suffix))
    good = F.endswith(local, F.lit(suffix)) & (clean != "") & ~clean.rlike(r"^\.|\.$") & clean.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+$")
    return F.when(F.lower(local).isin(fixed), F.lower(local)).when(good, clean)


def scrub(value: Column, original: str, clean: str) -> Column:
    return F.regexp_replace(value, "(?i)" + re.escape(original), clean.replace("\\", "\\\\").replace("$", "\\$"))


def header_value(value: Column) -> Column:
    """Line breaks to spaces; other than printable ASCII as an encoded word."""
    flat = F.regexp_replace(value, r"[\r\n]+", " ")
    plain64 = F.regexp_replace(F.base64(F.encode(flat, "UTF-8")), r"[\r\n]", "")
    return F.when(flat.rlike(r"^[\x20-\x7E]*$"), flat).otherwise(F.concat(F.lit("=?UTF-8?B?"), plain64, F.lit("?=")))


def attachment_name(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, r'[\r\n"\\/]+', "_"), 1, 180)


def mime_type(value: Column, fallback: str = "application/octet-stream") -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+$"), value).otherwise(fallback)


def is_email(value: Column) -> Column:
    return value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
